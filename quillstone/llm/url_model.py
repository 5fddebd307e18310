"""URL filter: host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models over URL bytes, one of accepted and one of rejected URLs,
are counted over all URLs that a rule decides. A URL's score is the difference of the two
log-likelihoods divided by its length in bytes. One in HELD_OUT of the URLs that a rule decides, chosen by a hash
of the URL, isn't counted: the threshold is calibrated on these, from histograms of the scores of both classes,
where both error rates balance.

Counts are exact and lie in a table of n-grams that grows with the input. What a byte adds to a score
depends only on the ORDER bytes before it and on itself, so each distinct n-gram of the input is priced
once, by joins with the counts of its shorter forms. URLs are scored in blocks of an Arrow batch: a block
names each of its n-grams once, so that one that every URL holds meets the prices once a block; n-grams of very
many blocks are dealt out to several tasks, by block, and meet a copy of their price in each. Neither
counts nor prices are collected, and they are broadcast only where the planner finds them small.

Defined cases: a null URL or one without "://" has an empty host and path and no rule, and its verdict is the
method's like that of any other URL; a null or empty URL has no bytes, which is no evidence: its score is 0. An empty
table, or one in which no rule decides any counted URL of a side, gives models without counts, scores of 0 and
verdict allow; without held-out URLs of a side the threshold is 0. URLs of any length are scored whole.
Repeated rows are judged alike and each count. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, salted_join
from ._rows import map_texts

#: Longest context in bytes; all shorter ones are used too.
ORDER = 4
#: URL bytes of a block, at most, where it has more than one URL.
BLOCK_BYTES = 1 << 18
#: Weight of the next shorter context's estimate, in counts.
BACKOFF = 4.0
#: Of so many decided URLs one is held out for the threshold.
HELD_OUT = 4
#: Bins of a score histogram, over scores from -LIMIT to LIMIT.
BINS, LIMIT = 4001, 4.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to / ? # or the end, lower case; then what follows up to ? or #."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def decide(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; a rule is host/path-prefix and fits subdomains too."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and for each byte the n-gram that ends there, as a number of its ORDER + 1 bytes."""
    pad = b"\x00" * ORDER
    data = np.frombuffer(b"".join(pad + u for u in urls), np.uint8).astype(np.int64)
    lengths = np.array([len(u) for u in urls], np.int64)
    at = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(urls) + 1) * ORDER, lengths)
    keys = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        keys = keys << 8 | data[at - back]
    return lengths, keys


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows with a number of the block that each lies in."""

    def factory():
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), count()

        def apply(urls: pa.Array) -> dict:
            return {"block": np.full(len(urls), task << 32 | next(made), np.int64)}

        return apply

    return map_texts(rows, rows.columns, [T.StructField("block", T.LongType())], factory, text="url", size=BLOCK_BYTES)


def _counted(rows: DataFrame) -> DataFrame:
    """(block, key, n0, n1): the n-grams of each block, and how often rejected and accepted URLs hold them there."""

    def run(batches):
        for b in batches:
            blocks, said = b.column(0).to_numpy(), b.column(2).to_pylist()
            urls = [(u or "").encode() for u in b.column(1).to_pylist()]
            side = np.array([2 if s is None else int(s == "allow") for s in said])
            for block in np.unique(blocks):
                own = np.flatnonzero(blocks == block)
                lengths, keys = grams([urls[i] for i in own])
                distinct, where = np.unique(keys, return_inverse=True)
                sides = np.repeat(side[own], lengths)
                n = [pa.array(np.bincount(where[sides == k], minlength=len(distinct))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), block)), pa.array(distinct), *n], names=["block", "key", "n0", "n1"])

    return rows.select("block", "url", "said").mapInArrow(run, "block long, key long, n0 long, n1 long")


def price(counted: DataFrame) -> DataFrame:
    """(key, price): the difference of log-likelihoods, accepted less rejected, of each n-gram's last byte; 0 if a side has no counts."""
    summed = lambda df, key: df.groupBy(key.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    key = F.col("key")
    by_size = {ORDER + 1: counted}
    for size in range(ORDER, 0, -1):
        by_size[size] = summed(by_size[size + 1], key.bitwiseAND((1 << 8 * size) - 1))
    shorter = None
    for size in range(1, ORDER + 2):
        # an n-gram of this size, the counts of its context, and the estimate of its form without the first byte
        whole = summed(by_size[size], F.shiftright(key, 8)).select(F.col("key").alias("context"), F.col("n0").alias("m0"), F.col("n1").alias("m1"))
        df = by_size[size].select("key", "n0", "n1", F.shiftright(key, 8).alias("context"), key.bitwiseAND((1 << 8 * (size - 1)) - 1).alias("tail")).join(whole, "context")
        if shorter is None:
            df = df.select("*", F.lit(1 / 256).alias("q0"), F.lit(1 / 256).alias("q1"), (F.least("m0", "m1") > 0).alias("both"))
        else:
            df = df.join(shorter, "tail")
        p = [((F.col(f"n{k}") + BACKOFF * F.col(f"q{k}")) / (F.col(f"m{k}") + BACKOFF)).alias(f"q{k}") for k in (0, 1)]
        shorter = df.select(F.col("key").alias("tail"), *p, "both")
    return shorter.select(F.col("tail").alias("key"), F.when(F.col("both"), F.log("q1") - F.log("q0")).otherwise(0.0).alias("price"))


def _priced(counted: DataFrame) -> DataFrame:
    """(block, key, price) of the n-grams of each block; counted is a stored table."""
    n = [F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)]
    total = materialize(counted.groupBy("key").agg(*n, F.count("*").alias("rows")), "counts")
    prices = price(total.select("key", "n0", "n1"))
    return salted_join(counted.select("block", "key"), prices, "key", "block", sizes=total.select("key", "rows")).select("block", "key", "price")


def _scored(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of rows with blocks, and the score of each."""
    priced = _priced(materialize(_counted(rows), "grams"))

    def score(urls: pa.Table, known: pa.Table) -> pa.Table:
        lengths, keys = grams([(u or "").encode() for u in urls["url"].to_pylist()])
        found = known["key"].to_numpy()
        order = np.argsort(found)
        prices = known["price"].to_numpy()[order][np.searchsorted(found[order], keys)] if len(keys) else np.zeros(0)
        sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=prices, minlength=len(lengths))
        return urls.select(keep).append_column("score", pa.array(np.divide(sums, lengths, out=np.zeros(len(lengths)), where=lengths > 0)))

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return rows.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(score, schema)


def calibrate(scored: DataFrame) -> float:
    """The threshold at which the share of accepted URLs below it and of rejected ones above it balance."""
    binned = F.floor((F.greatest(F.least(F.col("score"), F.lit(LIMIT)), F.lit(-LIMIT)) + LIMIT) / (2 * LIMIT) * (BINS - 1)).cast("int")
    rows = scored.groupBy("accepted", binned.alias("bin")).agg(F.count("*").alias("n")).collect()
    seen = np.zeros((2, BINS))
    for r in rows:
        seen[int(r["accepted"]), r["bin"]] += r["n"]
    if not seen[0].sum() or not seen[1].sum():
        return 0.0
    lost = np.concatenate(([0], np.cumsum(seen[1]))) / seen[1].sum()
    passed = 1 - np.concatenate(([0], np.cumsum(seen[0]))) / seen[0].sum()
    worst = np.maximum(lost, passed)
    best = np.flatnonzero(worst <= worst.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / (BINS - 1) * 2 * LIMIT - LIMIT)


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of pages(id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(id_col, "url", host.alias("host"), path.alias("path"))
    rule, said = decide(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    rows = rows.select("*", rule.alias("rule"), said.alias("decided"), F.when(~held, said).alias("said"))
    rows = materialize(_blocks(rows), "urls")
    scored = materialize(_scored(rows, [id_col, "host", "path", "rule", "decided", "said"]), "scored")
    unseen = scored.where(F.col("decided").isNotNull() & F.col("said").isNull())
    threshold = calibrate(unseen.select("score", (F.col("decided") == "allow").alias("accepted")))
    by_score = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("decided", by_score).alias("verdict"), "score")
