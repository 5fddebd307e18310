import math
import re

import numpy as np
import pytest

from quillstone.llm.registry import URL_RULES
from quillstone.llm.url_model import ORDER, judge

URLS = [
    "http://a.example.com/en/700?x", "https://a.example.com/en/812", "http://example.com/en/7", "HTTP://EXAMPLE.Com/en/9#top", "http://notexample.com/en/7",
    "http://x.net/de/1", "http://b.example.net/de/81", "http://example.net/de/9", "http://q.org/es/2", "http://q.org/fr/2", "mailto:a", None, "", "://", "http://",
    "http://h", "http://h?x=://y/en/", "http://h#/de/", "x://net/de/", "http://com/en/", "http://com/en", "ftp://ü.com/en/é\nz?q", "http://u@example.com:80/en/7",
]


def expected(url):
    url = url or ""
    rest = url.partition("://")[2]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in URL_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) * 2
    df = spark.createDataFrame([(i, u, "html", "clash") for i, u in rows], "page_id long, url string, html string, host string")
    found = judge(df, URL_RULES).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, best = expected(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def test_model_separates_held_out_urls(spark):
    good = [f"https://news.site{i % 7}.example/story/{i}" for i in range(400)]
    bad = [f"http://win-cash-{i % 5}.spam.example/?bonus={i}&click={i * 7}" for i in range(400)]
    rules = [("site0.example/", "allow"), ("site1.example/", "allow"), ("site2.example/", "allow"), ("win-cash-0.spam.example/", "block"), ("win-cash-1.spam.example/", "block")]
    odd = ["win-cash-3.spam.example/?bonus=3&click=21", "news.site3.example/story/9", None, "http://win-cash-4.spam.example/?" + "bonus=4&click=28&" * 5000]  # without "://", null, and very long
    df = spark.createDataFrame([*enumerate(good + bad), *enumerate(odd, 900)], "page_id long, url string")
    found = {r["page_id"]: r for r in judge(df, rules).collect()}
    assert [found[i]["verdict"] for i in (900, 901, 903)] == ["block", "allow", "block"] and found[900]["host"] == "" and found[902]["score"] == 0.0
    found = [r for r in found.values() if r["rule"] is None and r["page_id"] < 900]
    right = [r["verdict"] == ("allow" if r["page_id"] < 400 else "block") for r in found]
    assert len(found) > 300 and np.mean(right) > 0.98


def test_empty_and_untrained(spark):
    schema = "page_id long, url string"
    assert judge(spark.createDataFrame([], schema), URL_RULES).count() == 0
    row = judge(spark.createDataFrame([(1, "http://a.b/c")], schema), URL_RULES).first()
    assert row["verdict"] == "allow" and row["score"] == 0.0


def test_a_hot_n_gram_is_dealt_out(spark, monkeypatch):
    """An n-gram of all blocks is priced in several tasks, each row with the price that the others get."""
    from pyspark.sql import functions as F

    from quillstone import runtime
    from quillstone.llm.url_model import _priced

    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = [(b, 7, 1, 0) for b in range(1000)] + [(b, 1000 + b, 0, 2) for b in range(1000)]
        counted = runtime.materialize(spark.createDataFrame(rows, "block long, key long, n0 long, n1 long"), "grams")
        found = _priced(counted)
        tasks = found.where("key = 7").select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks >= 4 and found.count() == 2000
        assert found.where("key = 7").select("price").distinct().count() == 1 and {(r["block"], r["key"]) for r in found.collect()} == {r[:2] for r in rows}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("hot, block", [(256, 1 << 18), (4, 2000)])
def test_scores_are_exact_where_n_grams_are_many(spark, monkeypatch, hot, block):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from quillstone import runtime
    from quillstone.llm import url_model
    from quillstone.llm.url_model import BACKOFF, HELD_OUT

    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    monkeypatch.setattr(url_model, "BLOCK_BYTES", block)
    rng = random.Random(5)
    urls = [f"http://{'ok' if i % 2 else 'no'}.x/{''.join(rng.choice('abcdefghijklmnopqrstuvwxyz0123456789') for _ in range(40))}" for i in range(4000)]
    urls += ["http://else.y/" + u[-30:] for u in urls[:40]] + [None, "", "mailto:a"]
    found = {r["page_id"]: r["score"] for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3), [("ok.x/", "allow"), ("no.x/", "block")]).collect()}
    held = {r["u"] for r in spark.createDataFrame([(u,) for u in urls[:4000]], "u string").where(F.pmod(F.xxhash64("u"), F.lit(HELD_OUT)) == 0).collect()}
    assert 800 < len(held) < 1200
    seen = (Counter(), Counter())
    for i, u in enumerate(urls[:4000]):
        if u in held:
            continue
        text = "\0" * ORDER + u
        for j in range(ORDER, len(text)):
            for k in range(ORDER + 1):
                seen[i % 2].update((text[j - k : j + 1], ("before", text[j - k : j])))
    for i in [*range(20), *range(4000, 4043)]:
        text, total = "\0" * ORDER + (urls[i] or ""), 0.0
        for j in range(ORDER, len(text)):
            p = [1 / 256, 1 / 256]
            for k in range(ORDER + 1):
                p = [(seen[s][text[j - k : j + 1]] + BACKOFF * p[s]) / (seen[s]["before", text[j - k : j]] + BACKOFF) for s in (0, 1)]
            total += math.log(p[1]) - math.log(p[0])
        assert abs(found[i] - total / max(1, len(text) - ORDER)) < 1e-9
