import math
from collections import Counter

import numpy as np
import pytest

from quillstone.llm.weak_quality import (
    LABELLERS,
    SLOTS,
    TOXIC_BOUND,
    TOXIC_SLOTS,
    VIEWS,
    Scorer,
    Shapes,
    ToxicHits,
    WeakLabels,
    classify,
    decode_votes,
    encode_votes,
    learn_toxic,
    measure,
    vote,
)

DATA = "/root/testdata/sf0.01"


def test_vote_codes():
    for votes in ([0] * 5, [1, -1, 0, 1, -1], [1] * 9):
        assert decode_votes(encode_votes(votes), len(votes)) == votes


def test_em_finds_the_classes_without_labels():
    import random

    rng = random.Random(3)
    rates = [(0.7, 0.02), (0.5, 0.01), (0.6, 0.03), (0.4, 0.02)]
    counts, truth = {}, []
    for _ in range(4000):
        junk = rng.random() < 0.2
        votes = [1 if rng.random() < r[0 if junk else 1] else -1 for r in rates]
        code = encode_votes(votes)
        counts[code] = counts.get(code, 0) + 1
        truth.append((code, junk))
    model = WeakLabels(counts, 4)
    assert abs(model.prior - 0.2) < 0.05
    assert sum((model.posterior(c) >= 0.5) == j for c, j in truth) / len(truth) > 0.93


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = classify(docs, ["doc_id"], labels).join(labels.withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    good = [r for r in found if r["quality"] == 1 and not r["is_toxic"]]
    junk = [r for r in found if r["quality"] == 0]
    toxic = [r for r in found if r["is_toxic"]]
    assert sum(r["accepted"] for r in good) / len(good) > 0.98
    assert sum(not r["accepted"] for r in junk) / len(junk) > 0.9
    assert sum(r["toxic"] for r in toxic) / len(toxic) > 0.5


def test_odd_rows(docs, rows, no_docs):
    found = classify(docs, ["doc_id", "lang"]).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert classify(no_docs, ["doc_id"]).collect() == []


def test_toxic_words_are_learned_from_labels(spark):
    rows = [(i, f"unique{i} text about thing{i} " + ("zzkrag " if i % 3 == 0 else "") + f"and the rest{i} of story{i}") for i in range(120)]
    labels = [(i, int(i % 3 == 0), 1) for i in range(120)]
    found = learn_toxic(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), "doc_id", "text")
    assert "zzkrag" in found and "text" not in found


def test_labellers_have_names():
    assert len({name for name, *_ in LABELLERS}) == len(LABELLERS)


@pytest.mark.parametrize("text", ["word " * 400, "a$$$ b### c&&& d%%% " * 40, "SHOUT!! LOUD!! AGAIN!! " * 30])
def test_plain_junk_is_rejected(spark, text):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, text)], "doc_id long, text string")
    assert not classify(docs.unionByName(extra), ["doc_id"]).where("doc_id = -1").first()["accepted"]


def test_a_rare_class_of_toxic_texts_is_learned(spark):
    # toxic Spanish texts are 12 of 708 labelled ones; their words share only a beginning, which clean Spanish ones hold now and then
    mark = lambda i, n: " ".join(f"bomente{chr(97 + (i * 5 + k * 7) % 26)}{chr(97 + (i + k) % 26)}" for k in range(n))
    fill = lambda i: " ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + (i + j * j) % 26)}{chr(97 + j % 26)}" for j in range(40))
    rows = [(i, f"start{i} es{i} {fill(i)} {mark(i, 4) if i < 24 else mark(i, 1) if i < 160 and i % 12 == 0 else ''} end{i}", "es" if i < 160 else "en") for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 12), 1) for i in range(720) if i < 12 or i >= 24], "doc_id long, toxic int, quality int")
    found = {r["doc_id"]: r["toxic"] for r in classify(docs, ["doc_id"], labels).collect()}
    assert all(found[i] for i in range(24)) and not any(found[i] for i in range(24, 720))


def test_held_out_toxic_recall_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.selectExpr("doc_id", "pmod(xxhash64(array_join(slice(split(text, ' '), 1, 5), ' ')), 3) = 0 AS held")
    trained = labels.join(held.where("NOT held"), "doc_id").select(*labels.columns)
    found = classify(docs, ["doc_id", "lang"], trained).join(labels.withColumnRenamed("toxic", "is_toxic"), "doc_id").join(held.where("held"), "doc_id").collect()
    for lang in ("en", "de", "es", "fr"):
        toxic = [r["toxic"] for r in found if r["lang"] == lang and r["is_toxic"]]
        clean = [r["toxic"] for r in found if r["lang"] == lang and not r["is_toxic"]]
        print(lang, sum(toxic), len(toxic), sum(clean), len(clean))
        assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.01


def test_equals_brute_force_over_whole_texts(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = {r["doc_id"]: r for r in classify(docs, ["doc_id"], labels).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    raw = [texts[i].encode() for i in ids]
    codes = [encode_votes(vote(measure(b, b.split()), len(b.split()))) for b in raw]
    model, m = WeakLabels(Counter(codes), len(LABELLERS)), len(LABELLERS)
    good = np.array([1 - model.posterior(c) for c in codes])
    x, shapes = np.zeros((len(ids), m + SLOTS)), Shapes()
    for at, b in enumerate(raw):
        x[at, :m] = np.float32(measure(b, b.split()))
        for slot, n in zip(*shapes.counts(b)):
            x[at, m + slot] = n / len(b.split())
    weights, intercept = Scorer(x, good, m).folded()
    score = 1 / (1 + np.exp(-np.clip(x @ np.array(weights) + intercept, -50, 50)))

    marks = [ToxicHits(learn_toxic(docs, labels, "doc_id", "text"))] * len(ids)
    marks = [hits(texts[i]) for hits, i in zip(marks, ids)]
    toxic_model = WeakLabels(Counter(encode_votes(v) for v, _, _ in marks), VIEWS)
    toxic = np.array([toxic_model.posterior(encode_votes(v)) for v, _, _ in marks])
    has = np.array([bool(slots) for _, _, slots in marks])
    mean = toxic[~has].mean()
    z = np.zeros((len(ids), 1 + TOXIC_SLOTS))
    for at, (_, total, slots) in enumerate(marks):
        z[at, 0] = np.float32(total)
        for slot in slots:
            z[at, 1 + slot] += 1
    bare = np.zeros((has.sum(), 1 + TOXIC_SLOTS))
    bare[:, 0] = -TOXIC_BOUND
    weights, intercept = Scorer(np.vstack([z[has], bare]), np.append(toxic[has], np.full(has.sum(), mean)), 1).folded()
    toxic_score = np.where(has, 1 / (1 + np.exp(-np.clip(z @ np.array(weights) + intercept, -50, 50))), mean)

    assert len(found) == len(ids)
    for at, i in enumerate(ids):
        r = found[i]
        assert math.isclose(r["posterior"], good[at], abs_tol=1e-9) and math.isclose(r["score"], score[at], abs_tol=1e-6)
        assert math.isclose(r["toxic_posterior"], toxic[at], abs_tol=1e-9) and math.isclose(r["toxic_score"], toxic_score[at], abs_tol=1e-6)
        assert r["toxic_hits"] == len(marks[at][2]) and r["toxic"] == (r["toxic_score"] >= 0.5)
        assert r["accepted"] == (r["score"] >= 0.5 and not r["toxic"])


def test_toxic_labellers_read_different_words(spark):
    listed = learn_toxic(spark.createDataFrame([], "doc_id long, text string"), None, "doc_id", "text")
    hits = ToxicHits(listed)
    votes, score, slots = hits("you idiot moron loser clown trash scum vermin morons idiots")
    assert votes.count(1) >= 2 and score == TOXIC_BOUND and len(slots) == 9
    one = [hits(f"you {w}")[0] for w in ("idiot", "moron", "loser", "clown", "trash", "scum")]
    assert all(v.count(1) == 1 and v.count(-1) == VIEWS - 1 for v in one) and len({v.index(1) for v in one}) > 1
    assert hits("")[0] == [0] * VIEWS and hits("plain words")[0] == [-1] * VIEWS


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "some plain text here", 1, 2.0), (1, "some plain text here", 1, 2.0), (2, None, 3, 0.5), (3, "", 4, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slots int, toxic_score double").withColumnsRenamed({"slots": "toxic_slots"})
    found = classify(docs, ["doc_id", "toxic_slots"]).orderBy("doc_id").collect()
    assert [r["toxic_slots"] for r in found] == [1, 1, 3, 4] and found[0] == found[1]
    assert not any(r["toxic"] for r in found)


def test_a_very_long_text_is_read_to_its_end(spark):
    rows = [(i, "quiet words of a calm day. " * 5) for i in range(30)] + [(99, "quiet words of a calm day. " * 200_000 + "idiot moron scum trash loser stupid")]
    found = {r["doc_id"]: r for r in classify(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert found[99]["toxic_hits"] == 6 and found[0]["toxic_hits"] == 0
