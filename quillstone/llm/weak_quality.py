"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer.

1. Labellers look at a whole text and vote junk (+1), good (-1) or abstain (0).
2. The table of vote patterns, at most 3 ** labellers rows, is counted over all documents.
   Expectation-maximisation on it estimates the share of junk and each labeller's accuracy, without any
   gold label, and gives every pattern a posterior.
3. A logistic model over hashed word shapes and the labellers' measurements learns the posteriors, from
   TRAIN_ROWS documents at most (those whose ids hash smallest).
4. The scorer judges every document; those below a score of 0.5 are rejected.

Toxicity goes the same way, with labellers, a weak-label model and a hashed linear scorer of its own. Each of
VIEWS labellers reads the words of a text that a hash deals to it, so no two ever see the same word; it holds
them against a list of weighted words. The list is made of fixed English insults and of words and word beginnings learned from labelled rows,
MAX_TOXIC toxic and MAX_CLEAN clean ones at most, near copies once. A word is learned if its share of toxic
texts is beyond what chance gives among as many words as were tried, each language held against its own
share of toxic texts, and if it is LEAST_RATIO times as frequent in toxic texts as in clean ones. It weighs
the logarithm of that ratio. Words score the sum of their weights, less what a toxic text of as many words
would have of them beyond a clean one: a listed word that clean texts hold now and then says little in a
long text. A labeller votes toxic above a score of TOXIC_VOTE, clean if no word of its share is
listed, and abstains between. The scorer learns the posteriors of documents with listed words, TRAIN_ROWS at
most, and as often the mean posterior of those without, from hashed listed words and the score of the whole
text with the labels' log-odds of toxic, bounded by TOXIC_BOUND. A document whose toxic_score is 0.5 or more is rejected as well.

Defined cases: a null or empty text has no words, so all labellers abstain and it scores as the scorer
scores the average of nothing, its intercept and dense means; without documents the result is empty;
without labels the toxic word list is the fixed one; ties in the training sample go to the smaller id;
repeated rows are judged alike; a text of any length is measured whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import fresh, materialize
from ._rows import map_texts

#: Documents that the linear scorer is fitted on, at most.
TRAIN_ROWS = 4000
#: Labelled rows that toxic words are learned from, at most.
MAX_TOXIC, MAX_CLEAN = 3000, 10_000
#: Letters of word beginnings; how much more frequent a listed word is in toxic texts; the least weight of an insult.
BEGINNINGS, LEAST_RATIO, INSULT_WEIGHT = (4, 5, 6, 7, 8), 4.0, 6.0
#: Slots of hashed word shapes, and of hashed listed words.
SLOTS, TOXIC_SLOTS = 1024, 256
#: Toxicity: labellers, the score above which one votes toxic, and the bound of a text's score as a feature.
VIEWS, TOXIC_VOTE, TOXIC_BOUND = 3, 3.0, 3.0

# Insults.
INSULTS = (
    "clown", "clowns", "disgusting", "idiot", "idiotic", "idiots", "imbecile", "loser", "losers", "moron", "moronic", "morons",
    "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless",
)

_ODD = bytes(set(range(0x21, 0x7F)) - set(b"'\"(),-./:;?!") - set(range(0x30, 0x3A)) - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B)))
_UPPER, _LETTERS = bytes(range(0x41, 0x5B)), bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_ENDS = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *b".,;:?'\")-"])
_SHAPE = bytes(0x30 if 0x30 <= c <= 0x39 else 0x41 if 0x41 <= c <= 0x5A else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
#: Measurements, and for each labeller: name, votes junk above (or below, if the bounds fall), good beyond the other bound, least words.
MEASURES = ("symbols", "upper", "repeats", "short", "top", "odd_ends", "same_lines", "runs", "packed")
LABELLERS = (
    ("symbols", 0.02, 0.005, 1),
    ("upper", 0.30, 0.10, 5),
    ("repeats", 0.10, 0.03, 20),
    ("short", 0.10, 0.20, 20),
    ("top", 0.25, 0.12, 20),
    ("odd_ends", 0.20, 0.05, 10),
    ("same_lines", 0.50, 0.10, 20),
    ("runs", 0.10, 0.02, 10),
    ("packed", 0.25, 0.35, 40),
)


def measure(raw: bytes, words: list[bytes]) -> tuple[float, ...]:
    n = len(words) or 1
    letters = len(raw) - len(raw.translate(None, _LETTERS)) or 1
    lines = raw.split(b"\n")
    counts = Counter(words)
    same = list(map(bytes.__eq__, words, words[1:]))
    return (
        (len(raw) - len(raw.translate(None, _ODD))) / (len(raw) or 1),
        (len(raw) - len(raw.translate(None, _UPPER))) / letters,
        sum(same) / n,
        sum([len(w) <= 3 for w in words]) / n,
        max(counts.values(), default=0) / n,
        sum([w[-1] not in _ENDS for w in words]) / n,
        1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        sum(map(and_, same, same[1:])) / n,
        len(zlib.compress(raw, 1)) / (len(raw) or 1),
    )


def vote(measured: tuple[float, ...], n_words: int) -> list[int]:
    votes = []
    for x, (_, junk, good, least) in zip(measured, LABELLERS):
        sign = 1 if junk > good else -1
        votes.append(0 if n_words < least else 1 if sign * x > sign * junk else -1 if sign * x < sign * good else 0)
    return votes


def encode_votes(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def decode_votes(code: int, m: int) -> list[int]:
    votes = []
    for _ in range(m):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return votes[::-1]


class WeakLabels:
    """Two-class latent model: a labeller that votes is right with an accuracy of its own in either class.

    Junk is of many kinds and each labeller knows few of them, so accuracy on junk may be far below
    that on good texts; what counts is that a labeller says junk more often where there is junk.
    """

    def __init__(self, counts: dict[int, int], m: int, rounds: int = 200):
        votes = np.array([decode_votes(c, m) for c in counts], float).reshape(-1, m)
        weight = np.array(list(counts.values()), float)
        self.m, self.prior = m, 0.1
        self.on_junk, self.on_good = np.full(m, 0.4), np.full(m, 0.98)
        for _ in range(rounds if len(votes) else 0):
            junk = weight * self._posterior(votes)
            good = weight - junk
            said, cleared = (votes > 0).astype(float), (votes < 0).astype(float)
            self.on_junk = (junk @ said + 2) / (junk @ (said + cleared) + 5)
            self.on_good = (good @ cleared + 98) / (good @ (said + cleared) + 100)
            self.on_junk = np.clip(np.maximum(self.on_junk, 1.5 * (1 - self.on_good)), 0.01, 0.99)
            self.on_good = np.clip(self.on_good, 0.01, 0.9999)
            self.prior = float(np.clip((junk.sum() + 1) / (weight.sum() + 10), 0.001, 0.5))
        self.table = dict(zip(counts, self._posterior(votes))) if len(votes) else {}

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        for_junk = np.log(self.on_junk / (1 - self.on_good))
        for_good = np.log((1 - self.on_junk) / self.on_good)
        odds = math.log(self.prior / (1 - self.prior)) + (votes > 0) @ for_junk + (votes < 0) @ for_good
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def posterior(self, code: int) -> float:
        known = self.table.get(code)
        return float(self._posterior(np.array([decode_votes(code, self.m)], float))[0]) if known is None else float(known)


class Shapes:
    """Slots of word shapes: runs of letters, digits and marks reduced to one sign each."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def counts(self, raw: bytes) -> tuple[list[int], list[int]]:
        """The slots that a text fills, and how many words fill each."""
        memo, shapes = self.memo, raw.translate(_SHAPE).split()
        found = list(map(memo.get, shapes))
        if None in found:
            if len(memo) > 200_000:
                memo.clear()
            for i, s in enumerate(found):
                if s is None:
                    found[i] = memo[shapes[i]] = xxhash.xxh32_intdigest(_RUNS.sub(rb"\1", shapes[i])[:8]) % SLOTS
        filled = np.bincount(np.array(found, np.int64), minlength=SLOTS)
        slots = np.flatnonzero(filled)
        return slots.tolist(), filled[slots].tolist()


WORDS = re.compile(r"[^\W\d_]+")


class ToxicWords(dict):
    """Weights of words, and of word beginnings ending in *; the log-odds of toxic, and what a distinct word of a text takes off."""

    prior, rate = 0.0, 0.0


def toxic_features(words: list[str]) -> Counter:
    """How many distinct words of a text each word and word beginning stands for."""
    found = Counter(words)
    for k in BEGINNINGS:
        found.update([w[:k] + "*" for w in words if len(w) >= k])
    return found


def weigh(toxic: dict, clean: dict) -> np.ndarray:
    """Weights of features, 0 for those not listed. Of each side: texts and words that hold a feature, and as many as chance expects there."""
    (t, et, wt, ewt), (c, ec, wc, ewc) = ([side[k].astype(float) for k in ("texts", "texts_expected", "words", "words_expected")] for side in (toxic, clean))
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (t * np.log(t / et) + np.where(c > 0, c * np.log(c / ec), 0))
    weights = np.log((wt + 0.5) / (ewt + 0.5)) - np.log((wc + 0.5) / (ewc + 0.5))
    listed = (t > et) & (evidence >= 2 * math.log(max(2, len(t)))) & (weights >= math.log(LEAST_RATIO))
    return np.where(listed, weights, 0.0)


def learn_toxic(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, lang_col: str = "lang") -> ToxicWords:
    """Words and word beginnings that mark toxic texts in the labelled sample; rates are of each language where there is such a column."""
    found = ToxicWords((w, INSULT_WEIGHT) for w in INSULTS)
    if labels is None:
        return found
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    order = [F.xxhash64(id_col), F.col(id_col)]
    side = lambda t, n: marked.where(F.col("toxic") == t).orderBy(*order).limit(n)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    texts = docs.select(id_col, F.col(text_col).alias("text"), lang.alias("lang")).where(F.col("text").isNotNull())
    texts = texts.join(F.broadcast(side(1, MAX_TOXIC).union(side(0, MAX_CLEAN))), id_col).withColumn("w", F.split("text", r"\s+"))
    # each text goes once: near copies share a hash of their first or last words
    ends = [F.xxhash64(F.slice("w", 1, 5)).alias("head"), F.xxhash64(F.slice("w", -F.least(F.lit(5), F.size("w")), 5)).alias("tail")]
    texts = texts.select("toxic", *ends, id_col, "lang", "text")
    for end in ("head", "tail"):
        rest = [c for c in (id_col, "head", "tail", "lang", "text") if c != end]
        texts = texts.groupBy("toxic", end).agg(F.min(F.struct(*rest)).alias("s")).select("toxic", end, "s.*")

    def split(batches):
        for b in batches:
            words = [sorted(set(WORDS.findall(t.lower()))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], names=["toxic", "lang", "words"])

    sample = materialize(texts.select("toxic", "lang", "text").mapInArrow(split, "toxic int, lang string, words array<string>"), "toxic")
    of = lambda t, x: F.sum(F.when(F.col("toxic") == t, x).otherwise(0))
    n = F.size("words")
    totals = sample.groupBy("lang").agg(of(1, 1).alias("t1"), of(0, 1).alias("t0"), of(1, n).alias("w1"), of(0, n).alias("w0"))
    shares = totals.select("lang", (F.col("t1") / (F.col("t0") + F.col("t1"))).alias("texts"), F.coalesce(F.col("w1") / F.nullif(F.col("w0") + F.col("w1"), F.lit(0)), F.lit(0.0)).alias("words"))

    def features(batches):
        counts: dict[tuple, list[int]] = {}

        def rows():
            keys, sums = zip(*counts.items())
            f, g = zip(*keys)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(g), *(pa.array(c, pa.int64()) for c in zip(*sums))], names=["f", "lang", "t0", "t1", "w0", "w1"])

        for b in batches:
            for toxic, g, words in zip(*(c.to_pylist() for c in b.columns)):
                for f, k in toxic_features(words).items():
                    if (sums := counts.get((f, g))) is None:
                        sums = counts[f, g] = [0, 0, 0, 0]
                    sums[toxic] += 1
                    sums[2 + toxic] += k
                if len(counts) > 200_000:
                    yield rows()
        if counts:
            yield rows()

    counted = sample.mapInArrow(features, "f string, lang string, t0 long, t1 long, w0 long, w1 long").groupBy("f", "lang").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "w0", "w1")))
    expected = [F.sum((F.col("t0") + F.col("t1")) * F.col("texts")).alias("te"), F.sum((F.col("w0") + F.col("w1")) * F.col("words")).alias("we")]
    seen = counted.join(F.broadcast(shares), "lang").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "w0", "w1")), *expected).where("t1 > 1").toArrow()
    t0, t1, w0, w1, te, we = (seen[c].to_numpy() for c in ("t0", "t1", "w0", "w1", "te", "we"))
    toxic = {"texts": t1, "texts_expected": te, "words": w1, "words_expected": we}
    clean = {"texts": t0, "texts_expected": t0 + t1 - te, "words": w0, "words_expected": w0 + w1 - we}
    for f, w in zip(seen["f"].to_pylist(), weigh(toxic, clean).tolist()):
        if w:
            found[f] = max(w, found.get(f, 0.0))

    def hits(batches):
        listed = ToxicHits(found)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(listed.found(w)) for w in b.column(2).to_pylist()], pa.int64()), pa.compute.list_value_length(b.column(2)).cast(pa.int64())], names=["toxic", "hits", "n"])

    rates = sample.mapInArrow(hits, "toxic int, hits long, n long").groupBy("toxic").agg((F.sum("hits") / F.greatest(F.sum("n"), F.lit(1))).alias("rate"))
    rate = {r["toxic"]: r["rate"] for r in rates.collect()}
    if len(rate) == 2:
        found.prior, found.rate = math.log(sizes[1] / sizes[0]), max(0.0, rate[1] - rate[0])
    return found


class ToxicHits:
    def __init__(self, listed: ToxicWords):
        self.listed = listed
        self.starts = frozenset(f[: BEGINNINGS[0]] for f in listed if f.endswith("*"))
        self.slots = {f: xxhash.xxh32_intdigest(f.encode()) % TOXIC_SLOTS for f in listed}

    def found(self, words) -> list[tuple[str, str]]:
        """Those of the distinct words that are listed, each by itself or by its longest listed beginning, in order."""
        found, listed, starts, first = [], self.listed, self.starts, BEGINNINGS[0]
        for w in words:
            if w in listed:
                found.append((w, w))
            elif w[:first] in starts:
                f = next((f for k in reversed(BEGINNINGS) if len(w) >= k and (f := w[:k] + "*") in listed), None)
                if f is not None:
                    found.append((w, f))
        return sorted(found)

    def __call__(self, text: str) -> tuple[list[int], float, list[int]]:
        """The labellers' votes on a text, its bounded score, and the slots of its listed words."""
        listed, words = self.listed, set(WORDS.findall(text.lower()))
        found, sums = self.found(words), [0.0] * VIEWS
        for w, f in found:
            sums[xxhash.xxh32_intdigest(w.encode()) % VIEWS] += listed[f]
        taken = listed.rate * len(words)
        least = TOXIC_VOTE + taken / VIEWS
        votes = [0 if not words else -1 if not x else 1 if x > least else 0 for x in sums]
        score = listed.prior + sum(sums) - taken if found else -TOXIC_BOUND
        return votes, max(-TOXIC_BOUND, min(TOXIC_BOUND, score)), [self.slots[f] for _, f in found]


#: Columns that classify() adds.
JUDGED = ("posterior", "score", "toxic_hits", "toxic_posterior", "toxic_score", "toxic", "accepted")


class Scorer:
    """Logistic model over standardised features, the first of them dense and the rest hashed; learns soft labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dense: int, rounds: int = 400, ridge: float = 1e-3):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.scale[dense:] = np.maximum(self.scale[dense:], 0.05)
        used = np.append(x.any(0), True)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])[:, used]
        w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
        step = 4.0 / max(1.0, (z**2).sum(1).mean()) if len(z) else 0.0
        for i in range(rounds if len(z) else 0):
            ahead = w + i / (i + 3) * (w - v)
            v = w
            w = ahead - step * (z.T @ (1 / (1 + np.exp(-z @ ahead)) - y) / len(z) + ridge * ahead)
        self.w = np.zeros(len(used))
        self.w[used] = w

    def folded(self) -> tuple[list[float], float]:
        """Weights and intercept for features that aren't standardised."""
        weights = self.w[:-1] / self.scale
        return weights.tolist(), float(self.w[-1] - self.mean @ weights)


def classify(docs: DataFrame, keep: list[str], labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept columns with posterior (of good, from the votes), score (of good, from the scorer), toxic_hits (listed words),
    toxic_posterior, toxic_score, toxic, accepted.

    Texts are measured once; the measurements and the kept columns are written, and the scorers are projections over that table.
    """
    spark = docs.sparkSession
    listed = spark.sparkContext.broadcast(learn_toxic(docs, labels, id_col, text_col))
    m = len(LABELLERS)
    keep = [c for c in keep if c not in JUDGED]
    names = ("h", "i", "code", "toxic_code", "measures", "slots", "counts", "toxic_sum", "toxic_slots")
    h, i, code, toxic_code, measures, slots, counts, toxic_sum, toxic_slots = (fresh(c, docs) for c in names)

    def factory():
        toxic, shapes = ToxicHits(listed.value), Shapes()

        def apply(texts: pa.Array) -> dict:
            made = {c: [] for c in (code, toxic_code, measures, slots, counts, toxic_sum, toxic_slots)}
            for t in texts.to_pylist():
                raw = (t or "").encode()
                words = raw.split()
                measured = measure(raw, words)
                found, n = shapes.counts(raw)
                votes, total, marks = toxic(t or "")
                row = (encode_votes(vote(measured, len(words))), encode_votes(votes), measured, found, n, total, marks)
                for column, x in zip(made.values(), row):
                    column.append(x)
            return made

        return apply

    whole, real = T.IntegerType(), T.FloatType()
    fields = [(code, whole), (toxic_code, whole), (measures, T.ArrayType(real)), (slots, T.ArrayType(whole)), (counts, T.ArrayType(whole))]
    fields += [(toxic_sum, real), (toxic_slots, T.ArrayType(whole))]
    source = docs.withColumns({h: F.xxhash64(F.col(id_col)), i: F.col(id_col)})
    measured = materialize(map_texts(source, [*keep, h, i], [T.StructField(*f) for f in fields], factory, text=text_col), "measured")
    hits = F.size(toxic_slots).cast("long")

    # at most 3 ** labellers patterns of votes, and 3 ** VIEWS of the toxic ones, with and without listed words
    quality = {r[code]: r["n"] for r in measured.groupBy(code).agg(F.count("*").alias("n")).collect()}
    marked = {(r[toxic_code], r["marked"]): r["n"] for r in measured.groupBy(toxic_code, (hits > 0).alias("marked")).agg(F.count("*").alias("n")).collect()}
    toxicity = Counter()
    for (c, _), n in marked.items():
        toxicity[c] += n
    quality_model, toxic_model = WeakLabels(quality, m), WeakLabels(toxicity, VIEWS)

    def sample(rows: DataFrame, total: int, *columns: str) -> pa.Table:
        """TRAIN_ROWS of so many rows, those whose ids hash smallest."""
        share = min(1.0, 1.5 * TRAIN_ROWS / max(1, total))
        rows = rows.where(F.pmod(h, F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select(h, i, *columns)
        return rows.orderBy(h, i, *columns[1:]).limit(TRAIN_ROWS).toArrow()

    rows = sample(measured, sum(quality.values()), code, measures, slots, counts)
    x = np.zeros((rows.num_rows, m + SLOTS))
    for at, (dense, found, n) in enumerate(zip(*(rows[c].to_pylist() for c in (measures, slots, counts)))):
        x[at, :m] = dense
        x[at, m + np.array(found, int)] = np.array(n) / max(1, sum(n))
    weights, intercept = Scorer(x, np.array([1 - quality_model.posterior(c) for c in rows[code].to_pylist()]), m).folded()

    rows = sample(measured.where(hits > 0), sum(n for (_, has), n in marked.items() if has), toxic_code, toxic_sum, toxic_slots)
    x = np.zeros((2 * rows.num_rows, 1 + TOXIC_SLOTS))
    x[:, 0] = -TOXIC_BOUND
    for at, (total, found) in enumerate(zip(rows[toxic_sum].to_pylist(), rows[toxic_slots].to_pylist())):
        x[at, 0] = total
        np.add.at(x[at], 1 + np.array(found, int), 1)
    bare = {c: n for (c, has), n in marked.items() if not has}
    mean = sum(toxic_model.posterior(c) * n for c, n in bare.items()) / max(1, sum(bare.values()))
    toxic_weights, toxic_intercept = Scorer(x, np.array([*(toxic_model.posterior(c) for c in rows[toxic_code].to_pylist()), *[mean] * rows.num_rows]), 1).folded()

    chance = lambda odds: 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds))))
    add = lambda a, b: a + b
    dense = sum((F.col(measures)[k].cast("double") * w for k, w in enumerate(weights[:m])), F.lit(intercept))
    table, toxic_table = F.lit(weights[m:]), F.lit(toxic_weights[1:])
    shaped = F.aggregate(F.zip_with(slots, counts, lambda s, n: F.get(table, s) * n), F.lit(0.0), add)
    score = chance(dense + shaped / F.greatest(F.aggregate(counts, F.lit(0.0), add), F.lit(1.0)))
    spoken = F.aggregate(F.transform(toxic_slots, lambda s: F.get(toxic_table, s)), F.lit(0.0), add)
    toxic_score = F.when(hits > 0, chance(F.col(toxic_sum).cast("double") * toxic_weights[0] + toxic_intercept + spoken)).otherwise(F.lit(mean))
    tables = [
        F.broadcast(spark.createDataFrame([(c, p(c)) for c in known], f"`{key}` int, {name} double"))
        for key, name, known, p in (
            (code, "posterior", quality, lambda c: 1 - quality_model.posterior(c)),
            (toxic_code, "toxic_posterior", toxicity, toxic_model.posterior),
        )
    ]
    judged = {"score": score, "toxic_hits": hits, "toxic_score": toxic_score}
    found = measured.join(tables[0], code).join(tables[1], toxic_code)
    found = found.select(*keep, "posterior", "toxic_posterior", *(c.alias(name) for name, c in judged.items()))
    return found.withColumn("toxic", F.col("toxic_score") >= 0.5).withColumn("accepted", (F.col("score") >= 0.5) & ~F.col("toxic"))
