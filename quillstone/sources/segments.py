"""An index that pages can be replaced in and deleted from: versioned segments, tombstones and atomic commits.

Every batch of pages is written as a segment, a stored index of its own, with the batch's number as version. A tombstone (doc_ord,
version) says that no segment of an earlier version holds the page any more: one for each page of a batch, and for each page that the
batch deletes. A commit is one small file that names the live segments, the tombstones and the number of live pages; it
is written aside and renamed into place, so a search sees a whole batch or none of it. A batch that fails before leaves files that no
commit names. Two writers can't both make one commit: the second rename fails, and that batch has to be applied again.

Segments of like size are merged, as their number grows, into one that holds their live rows only; a tombstone is dropped when no
segment is older. Replaced files stay for searches that have begun, until vacuum().

Defined cases: of rows of a batch with one doc_ord, the one with the largest seq stays, where the batch has that column, then
the one with the larger text and title; rows without doc_ord are left out; a page that a batch both holds and deletes stays;
deleting what isn't there changes nothing; an empty batch makes an empty segment.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INDEX_V2, TokenizerConfig
from ..operators.search import search
from ..runtime import scratch
from .store import save, stored, stored_size

#: Segments of one size that are merged into one, and how many times larger the next size is.
FANOUT = 4
#: Bytes below which all segments are of one size.
LEAST_BYTES = 1 << 20


class Conflict(Exception):
    """Another writer has made the commit that this one was to be."""


@dataclass(frozen=True)
class Segment:
    name: str
    version: int
    bytes: int


@dataclass(frozen=True)
class Commit:
    """A state of the index; batch is the last batch of a stream that it holds."""

    number: int = 0
    segments: tuple[Segment, ...] = ()
    tombstones: tuple[str, ...] = ()
    n_docs: int = 0
    batch: int = -1


@dataclass
class Snapshot:
    """What a commit holds. All tables read live rows only."""

    postings: DataFrame
    titles: DataFrame
    frequencies: DataFrame
    n_docs: DataFrame

    def search(self, lines: DataFrame, k: int = 10, stem: bool = True, aggregate: bool = False) -> DataFrame:
        """Ranked answers to lines(query_id, line); filters of tokens reach the scans of all segments."""
        return search(lines, self.postings, self.frequencies, self.n_docs, self.titles, k, stem, aggregate)


class SegmentedIndex:
    """An index under path, made by its first batch."""

    def __init__(self, spark: SparkSession, path: str, config: TokenizerConfig = INDEX_V2, stem: bool = True):
        self.spark, self.path, self.config, self.stem = spark, path.rstrip("/"), config, stem

    def commit(self) -> Commit:
        """The last commit."""
        if not (numbers := self._numbers()):
            return Commit()
        at = self._path(f"commits/{max(numbers)}.json")
        lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs(at).open(at), "UTF-8")
        found = json.loads(lines)
        return Commit(found["number"], tuple(Segment(**s) for s in found["segments"]), tuple(found["tombstones"]), found["n_docs"], found["batch"])

    def apply(self, pages: DataFrame | None = None, deletes: DataFrame | None = None, batch: int | None = None) -> int:
        """Replace or add pages(doc_ord, title, text) and delete those of deletes(doc_ord); the commit's number.

        A batch of a stream that a commit holds already is left out.
        """
        last = self.commit()
        if batch is not None and batch <= last.batch:
            return last.number
        version, name = last.number + 1, uuid.uuid4().hex
        with scratch():
            from ..plans.build import index_pages
            from ..runtime import materialize

            new = materialize(_last_rows(pages if pages is not None else self._no_pages()), "batch")
            gone = new.select("doc_ord")
            if deletes is not None:
                gone = gone.unionByName(deletes.select(F.col("doc_ord").cast("long").alias("doc_ord")).where("doc_ord IS NOT NULL"))
            gone.distinct().select("doc_ord", F.lit(version).cast("long").alias("version")).write.parquet(f"{self.path}/tombstones/{name}")
            save(index_pages(new, self.config, self.stem), f"{self.path}/segments/{name}")
        dead = self.spark.read.parquet(f"{self.path}/tombstones/{name}")
        lost = self._titles(last).join(dead.select("doc_ord"), "doc_ord", "left_semi").count() if last.segments else 0
        added = self.spark.read.parquet(f"{self.path}/segments/{name}/titles").count()
        segment = Segment(name, version, stored_size(self.spark, f"{self.path}/segments/{name}"))
        tombstones = (*last.tombstones, name) if last.segments else ()
        return self._make(Commit(version, (*last.segments, segment), tombstones, last.n_docs - lost + added, last.batch if batch is None else batch))

    def merge(self, fanout: int = FANOUT) -> int:
        """Merge segments of like size while there are so many of one size; the last commit's number."""
        while True:
            last, sizes = self.commit(), {}
            for s in last.segments:
                size, tier = LEAST_BYTES, 0
                while s.bytes > size:
                    size, tier = size * fanout, tier + 1
                sizes.setdefault(tier, []).append(s)
            if not (full := [v for _, v in sorted(sizes.items()) if len(v) >= fanout]):
                return last.number
            self._merged(last, full[0])

    def _merged(self, last: Commit, parts: list[Segment]) -> None:
        from .store import Index

        name = uuid.uuid4().hex
        own = replace(last, segments=tuple(parts))
        save(Index(self._live(own, "postings").drop("block", "version"), self._titles(own)), f"{self.path}/segments/{name}")
        # a live row has no tombstone behind its version, so it may take a later one
        version = max(s.version for s in parts)
        merged = Segment(name, version, stored_size(self.spark, f"{self.path}/segments/{name}"))
        segments = tuple(sorted((*(s for s in last.segments if s not in parts), merged), key=lambda s: s.version))
        oldest, tombstones = min(s.version for s in segments), ()
        if last.tombstones and len(segments) > 1:
            dead = self._tombstones(last).where(F.col("version") > oldest)
            dead.write.parquet(f"{self.path}/tombstones/{name}")
            tombstones = (name,)
        self._make(Commit(last.number + 1, segments, tombstones, last.n_docs, last.batch))

    def vacuum(self) -> list[str]:
        """Delete the segments and tombstones that the last commit doesn't name, and earlier commits; the names that went.

        Not while another writer is at work, whose files no commit names yet.
        """
        last, gone = self.commit(), []
        for kind, kept in (("segments", {s.name for s in last.segments}), ("tombstones", set(last.tombstones))):
            at = self._path(kind)
            if self._fs(at).exists(at):
                for status in self._fs(at).listStatus(at):
                    if (name := status.getPath().getName()) not in kept:
                        self._fs(at).delete(status.getPath(), True)
                        gone.append(f"{kind}/{name}")
        for n in self._numbers() - {last.number}:
            at = self._path(f"commits/{n}.json")
            self._fs(at).delete(at, False)
        return gone

    def snapshot(self) -> Snapshot:
        """The last commit's tables; later commits don't change them."""
        last = self.commit()
        if not last.segments:
            raise FileNotFoundError(f"no commit under {self.path}")
        postings = self._live(last, "postings").drop("block", "version")
        n_docs = self.spark.createDataFrame([(last.n_docs,)], "n_docs long")
        return Snapshot(postings, self._titles(last), postings.groupBy("token").agg(F.count("*").alias("df")), n_docs)

    def _tombstones(self, commit: Commit) -> DataFrame:
        """(doc_ord, version): the last version that made a page's earlier rows dead."""
        read = self.spark.read.parquet(*(f"{self.path}/tombstones/{t}" for t in commit.tombstones))
        return read.groupBy("doc_ord").agg(F.max("version").alias("version"))

    def _live(self, commit: Commit, table: str) -> DataFrame:
        """Rows of a table of all segments that no tombstone is behind, with version."""
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s.name}/{table}").withColumn("version", F.lit(s.version).cast("long")) for s in commit.segments]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if not commit.tombstones:
            return rows
        dead = self._tombstones(commit).select("doc_ord", F.col("version").alias("dead"))
        return rows.join(dead, "doc_ord", "left").where(F.col("dead").isNull() | (F.col("dead") <= F.col("version"))).select(*rows.columns)

    def _titles(self, commit: Commit) -> DataFrame:
        return self._live(commit, "titles").drop("version")

    def _no_pages(self) -> DataFrame:
        return self.spark.createDataFrame([], "doc_ord long, title string, text string")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self, at):
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> set[int]:
        if not stored(self.spark, f"{self.path}/commits"):
            return set()
        at = self._path("commits")
        names = (s.getPath().getName() for s in self._fs(at).listStatus(at))
        return {int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")}

    def _make(self, commit: Commit) -> int:
        """Write a commit aside and rename it into place."""
        jvm = self.spark._jvm
        aside, at = self._path(f"aside/{uuid.uuid4().hex}"), self._path(f"commits/{commit.number}.json")
        fs = self._fs(at)
        fs.mkdirs(at.getParent())
        out = fs.create(aside, False)
        body = {"number": commit.number, "segments": [vars(s) for s in commit.segments], "tombstones": list(commit.tombstones), "n_docs": commit.n_docs, "batch": commit.batch}
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none may exist
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, at, how)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"commit {commit.number} of {self.path} has been made by another writer") from e
            raise
        return commit.number


def _last_rows(pages: DataFrame) -> DataFrame:
    """pages with one row of each doc_ord, and no others."""
    order = F.struct(*([F.col("seq")] if "seq" in pages.columns else []), "text", "title")
    best = pages.where("doc_ord IS NOT NULL").groupBy(F.col("doc_ord").cast("long").alias("doc_ord")).agg(F.max(order).alias("p"))
    return best.select("doc_ord", "p.title", "p.text")
