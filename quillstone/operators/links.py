"""Link graph of raw web pages, and rank by it.

A node is a host and a path, the host lower-cased, the path without query, fragment, . and .. segments and its last slash. Links are
the hrefs of a page's html, resolved against its url; those to fragments of the page itself, to the page itself and to other
schemes than http and https are left out, and repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, salted_join

ABSOLUTE = r"^(?i:https?):?//([^/?#]*)([^?#]*)"


def _node(host: Column, path: Column) -> Column:
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.isin("", "."), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lower(host), F.lit("/"), F.array_join(kept, "/"))


def link_graph(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) of the links of pages; a null or other url has no node, a null html no links."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    own = pages.select(F.regexp_extract(url, ABSOLUTE, 1).alias("host"), F.regexp_extract(url, ABSOLUTE, 2).alias("path"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("href"))
    own = own.where("host != ''").withColumn("href", F.trim(F.regexp_replace("href", "&amp;", "&")))
    bare = F.regexp_extract("href", "^([^?#]*)", 1)
    full = F.regexp_extract("href", r"^(?:(?i:https?):)?//([^/?#]*)([^?#]*)", 1)
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    target = (
        F.when(full != "", _node(full, F.regexp_extract("href", r"^(?:(?i:https?):)?//([^/?#]*)([^?#]*)", 2)))
        .when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (bare == ""), None)
        .when(bare.startswith("/"), _node(F.col("host"), bare))
        .otherwise(_node(F.col("host"), F.concat(F.when(folder == "", "/").otherwise(folder), bare)))
    )
    edges = own.select(_node(F.col("host"), F.col("path")).alias("source"), target.alias("target"))
    return edges.where("target IS NOT NULL AND source != target").distinct()


def link_rank(links: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-10, rounds: int = 200) -> DataFrame:
    """(node, rank) of links(source, target), and of nodes(node) that have no links; ranks add up to 1.

    Each round a node passes its rank on in equal parts; what nodes without links out hold goes to all in equal parts. Rounds end
    when ranks have changed by tolerance at most, all changes added up. A round joins links with ranks by source, a source of
    very many links being dealt out to several tasks, and adds up by target what tasks have added up. Each round's ranks
    are a scratch table.
    """
    links = materialize(links.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "links")
    every = links.select(F.col("source").alias("node")).unionByName(links.select(F.col("target").alias("node")))
    if nodes is not None:
        every = every.unionByName(nodes.select("node").where("node IS NOT NULL"))
    degrees = materialize(links.groupBy("source").agg(F.count("*").alias("rows")), "degrees")
    every = materialize(every.distinct().join(degrees.select(F.col("source").alias("node"), F.col("rows").alias("degree")), "node", "left"), "nodes")
    n = every.count()
    ranks = every.select("node", "degree", F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(None).cast("double").alias("before"))
    for _ in range(rounds):
        changed, dangling = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("before"))), F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0))).first()
        if not n or (changed is not None and changed <= tolerance):
            break
        given = ranks.where("degree IS NOT NULL").select(F.col("node").alias("source"), (F.col("rank") / F.col("degree")).alias("part"))
        passed = salted_join(links, given, "source", "target", sizes=degrees).groupBy("target").agg(F.sum("part").alias("got"))
        new = ranks.select("node", "degree", F.col("rank").alias("before")).join(passed.withColumnRenamed("target", "node"), "node", "left")
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + dangling / n)
        ranks = materialize(new.select("node", "degree", rank.alias("rank"), "before"), "ranks")
    return ranks.select("node", "rank")
