"""Queries of the search engine over the documents table, one for each operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scoring import FIELDS, decode_posting, encode_posting, idf, split_postings
from .functions.text import INDEX_V1, INDEX_V2, QUERY, clean, drop_stop_words, tokens, tokens_of_fragments
from .operators import extract as X
from .operators import postings as P
from .operators.boolean import boolean_matches
from .operators.counting import positional_postings, row_lists, row_postings
from .operators.lexicon import deletion_table, fuzzy_terms, gram_table, search_patterns, wildcard_terms
from .operators.links import link_graph as page_links
from .operators.links import link_rank as rank_links
from .operators.positional import matches, parse_positional, search_positional
from .operators.queryparse import classify, parse
from .operators.search import search_fields
from .operators.sketches import LG, TRACKED, chunk_sketches, frequent_tokens, length_quantiles, merged, vocabulary_size
from .oracle import SHARD_SIZE, oracles
from .plans.build import build_index, load, open_index, search_index, search_index_top
from .runtime import materialize, scratch_path, spread
from .sources.pages import markup_pages, read_dump, read_queries, write_dump
from .sources.segments import SegmentedIndex
from .sources.store import load_lexicon, save_lexicon
from .streaming.ingest import ingest, load_streamed
from .streaming.windows import append, rocksdb, window_statistics
from .streaming.windows import event_runs as runs_of_events

#: Query lines that the search queries answer.
LINES = (
    (1, "thtion onere"),
    (2, "thor thor The 25kmph"),
    (3, "b:thor reti i:src1 c:en src2 onere"),
    (4, "t:document b:erhe"),
    (5, "t:12 document t:13"),
    (6, "see http://x.com now"),
    (7, "t:a foo:b"),
    (8, "T:abc"),
    (9, ""),
    (10, "erhe t:src3"),
    (11, "t:src5 src5 b:thor:reti"),
    (12, "l:site r:note alpha c:docs"),
    (13, "don't re-read http://a.b/c (thor)"),
)
#: Lines with phrases and words near each other.
POSITIONAL = (
    (1, '"thor thor thor"'),
    (2, '"nd the er"'),
    (3, "nd NEAR/5 ti"),
    (4, "ha NEAR/3 er NEAR/4 ing"),
    (5, '"th er" ble'),
    (6, '"lang en source"'),
    (7, '"the of" the NEAR/2 th'),
    (8, ""),
    (9, '"alpha beta" "docs"'),
    (10, "th NEAR/2 th"),
)
#: Lines with misspelt words and wildcards, and patterns alone.
LIKELY = ((1, "thro~ onere"), (2, "th*r"), (3, "o*ere thor~1"), (4, "*ution s*c* The"), (5, "qqqqqqqq~ zzz*"), (6, ""))
PATTERNS = ("th*r", "*tion", "*erea*", "a*b*e", "s*1*", "onere", "*q*", "re*re")
BOOLEAN = ((1, "thor AND onere"), (2, "thor OR onere"), (3, "th er NOT ing"), (4, "NOT th"), (5, "(ti OR tion) nd NOT (er OR t:12)"), (6, "t:document onere"), (7, "i:en c:docs NOT b:th"), (8, ""), (9, "( th"), (10, "l:label OR NOT (r:note OR b:nd)"))
CHUNK = 10_000


def lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LINES), "query_id int, line string")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(markup_pages(spark, sf_dir)).select("doc_ord", clean(F.col("text")).alias("text"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = _cleaned(spark, sf_dir).select("doc_ord", X.strip_infobox(F.col("text")).alias("text"))
    return bare.select("doc_ord", X.section(F.col("text"), X.REFERENCE_HEADINGS, 1).alias("body"), X.section(F.col("text"), X.REFERENCE_HEADINGS, 2).alias("refs"))


def _exploded(df: DataFrame, column, name: str = "fragment") -> DataFrame:
    return df.select("doc_ord", F.posexplode(column).alias("pos", name))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_fields(markup_pages(spark, sf_dir))


def _postings(spark: SparkSession, sf_dir: str, stem: bool = False) -> DataFrame:
    return row_postings(_fields(spark, sf_dir), stem=stem)


def _counted(df: DataFrame, column) -> DataFrame:
    return df.select("doc_ord", F.explode(column).alias("token")).groupBy("doc_ord", "token").agg(F.count("*").alias("n"))


def pages_markup_view(spark, d):
    return markup_pages(spark, d)


def clean_casefold(spark, d):
    return _cleaned(spark, d)


def infobox_extract(spark, d):
    return _exploded(_cleaned(spark, d), X.fragments(F.col("text"), X.INFOBOX))


def infobox_strip(spark, d):
    return _cleaned(spark, d).select("doc_ord", X.strip_infobox(F.col("text")).alias("text"))


def references_split(spark, d):
    return _parts(spark, d)


def category_extract(spark, d):
    return _exploded(_parts(spark, d), X.fragments(F.col("refs"), X.CATEGORY))


def category_strip(spark, d):
    return _parts(spark, d).select("doc_ord", X.strip_categories(F.col("refs")).alias("refs"))


def external_links_split(spark, d):
    refs = category_strip(spark, d)
    return refs.select("doc_ord", X.section(F.col("refs"), X.LINK_HEADINGS, 1).alias("refs"), X.section(F.col("refs"), X.LINK_HEADINGS, 2).alias("links"))


def links_extract(spark, d):
    return _exploded(external_links_split(spark, d), X.fragments(F.col("links"), X.LINK))


def references_extract(spark, d):
    return _exploded(external_links_split(spark, d), X.fragments(F.col("refs"), X.REFERENCE))


def tokenize_v1(spark, d):
    return _counted(_cleaned(spark, d), tokens(F.col("text"), INDEX_V1))


def tokenize_v2(spark, d):
    return _counted(_cleaned(spark, d), tokens(F.col("text"), INDEX_V2))


def tokenize_query(spark, d):
    return _counted(spread(markup_pages(spark, d)), tokens(F.col("text"), QUERY))


def tokenize_fragments(spark, d):
    return _counted(_fields(spark, d), tokens_of_fragments(F.concat("infobox", "category", "links", "references"), INDEX_V2))


def stopword_filter(spark, d):
    return _counted(_cleaned(spark, d), drop_stop_words(tokens(F.col("text"), INDEX_V1), INDEX_V1))


def length_filter(spark, d):
    return _counted(_cleaned(spark, d), drop_stop_words(tokens(F.col("text"), INDEX_V2), INDEX_V2))


def stem_vocabulary(spark, d):
    return P.stem_table(P.field_tokens(_fields(spark, d)))


def field_term_counts(spark, d):
    return _postings(spark, d)


def field_term_counts_stemmed(spark, d):
    return _postings(spark, d, stem=True)


def field_term_counts_v1(spark, d):
    return row_postings(_fields(spark, d), INDEX_V1, stem=False)


def posting_encode(spark, d):
    return _postings(spark, d).select("token", "doc_ord", encode_posting().alias("posting"))


def posting_list(spark, d):
    return P.merge_lists(row_lists(_fields(spark, d), stem=False))


def posting_decode(spark, d):
    # a row a posting before it is decoded: no list of structs is made
    split = posting_list(spark, d).select("token", F.explode(split_postings(F.col("postings"))).alias("p"))
    return split.select("token", decode_posting(F.col("p")).alias("p")).select("token", "p.*")


def chunk_merge(spark, d):
    pages = markup_pages(spark, d)
    halves = [P.postings(P.field_tokens(X.extract_fields(pages.where(F.col("doc_ord") % 2 == i))), stem=False) for i in (0, 1)]
    return P.posting_lists(P.merge_postings(halves))


def document_frequency(spark, d):
    return P.document_frequencies(_postings(spark, d))


def idf_table(spark, d):
    n = markup_pages(spark, d).agg(F.count("*").alias("n_docs"))
    return document_frequency(spark, d).crossJoin(n).select("token", "df", F.round(idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))  # n is one row


def vocab_shards(spark, d):
    return P.vocabulary_shards(document_frequency(spark, d), SHARD_SIZE)


def secondary_index(spark, d):
    return P.secondary_index(vocab_shards(spark, d))


def shard_lookup(spark, d):
    words = document_frequency(spark, d).select("token")
    wanted = words.unionByName(words.select(F.concat("token", F.lit("x")).alias("token"))).unionByName(spark.createDataFrame([("!",), ("zzzzz",)], "token string")).distinct()
    return P.shard_lookup(wanted, secondary_index(spark, d))


def title_address(spark, d):
    return markup_pages(spark, d).select("doc_ord", F.floor(F.col("doc_ord") / CHUNK).alias("chunk"), (F.col("doc_ord") % CHUNK).alias("line"))


def title_lookup(spark, d):
    wanted = document_hits(spark, d)
    return wanted.join(markup_pages(spark, d).select("doc_ord", "title"), "doc_ord").select("token", "doc_ord", "title")


def document_hits(spark, d):
    """Postings of some tokens: a filter that reaches the scan of a stored index."""
    return _postings(spark, d).where(F.col("token").isin("thor", "onere", "src1")).select("token", "doc_ord")


def corpus_stats(spark, d):
    return P.corpus_statistics(markup_pages(spark, d), _postings(spark, d))


def index_stats(spark, d):
    vocabulary = document_frequency(spark, d)
    return vocabulary.agg(F.count("*").alias("vocabulary"), F.ceil(F.count("*") / (SHARD_SIZE + 1)).alias("shards"))


def _item_lines(spark, d):
    """The fixed lines, and a line of each benchmark item: free text, two fields with the text each, or a prefix that is none."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " ")
    form = F.when(F.col("item_id") % 3 == 0, text).when(F.col("item_id") % 3 == 1, F.concat(F.lit("t:"), text, F.lit(" b:"), text)).otherwise(F.concat(F.lit("q:"), text))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") + 1000).alias("query_id"), form.alias("line"))
    return lines(spark).select(F.col("query_id").cast("long"), "line").union(items)


def query_classify(spark, d):
    return classify(_item_lines(spark, d))


def query_parse(spark, d):
    return parse(_item_lines(spark, d), stem=False)


def _search(spark, d, which, **options):
    pages = markup_pages(spark, d)
    n = pages.agg(F.count("*").alias("n_docs"))
    asked = lines(spark).where(F.col("query_id").isin(*which)) if which else lines(spark)
    return search_fields(asked, _fields(spark, d), n, pages.select("doc_ord", "title"), **({"stem": False} | options))


def search_free_text(spark, d):
    return _search(spark, d, (1,))


def search_field(spark, d):
    return _search(spark, d, (3,))


def search_batch(spark, d):
    return _search(spark, d, ())


def search_aggregated(spark, d):
    return _search(spark, d, (), aggregate=True)


def search_stemmed(spark, d):
    return _search(spark, d, (), stem=True)


def _positional(spark) -> DataFrame:
    return spark.createDataFrame(list(POSITIONAL), "query_id int, line string")


def phrase_matches(spark, d):
    """Every occurrence of every clause, by document and field."""
    return matches(parse_positional(_positional(spark), stem=False), positional_postings(_fields(spark, d), stem=False))


def search_phrases(spark, d):
    pages = markup_pages(spark, d)
    n = pages.agg(F.count("*").alias("n_docs"))
    return search_positional(_positional(spark), positional_postings(_fields(spark, d), stem=False), n, pages.select("doc_ord", "title"), stem=False)


def stored_search_phrases(spark, d):
    """The same from a stored index."""
    path = scratch_path(spark, "index")
    build_index(markup_pages(spark, d), path, stem=False, positions=True)
    index = load(spark, path)
    return search_positional(_positional(spark), index.positions, index.n_docs, index.titles, stem=False)


def _vocabulary(spark, d) -> DataFrame:
    return materialize(document_frequency(spark, d).select("token"), "vocabulary")


def fuzzy_vocabulary(spark, d):
    """The documents' tokens within two edits of each token of the benchmark's texts."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(tokens(clean(F.col("text")), INDEX_V2)).alias("word"))
    return fuzzy_terms(items.select("word", F.lit(2).alias("edits")), deletion_table(_vocabulary(spark, d)))


def wildcard_vocabulary(spark, d):
    words = _vocabulary(spark, d)
    return wildcard_terms(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"), gram_table(words), words)


def stored_search_patterns(spark, d):
    """Misspelt words and wildcards, looked up in the tables that a stored index has for them."""
    path = scratch_path(spark, "index")
    build_index(markup_pages(spark, d), path, stem=False)
    save_lexicon(spark, path)
    index = load(spark, path)
    asked = spark.createDataFrame(list(LIKELY), "query_id int, line string")
    return search_patterns(asked, index.postings, index.frequencies, index.n_docs, index.titles, *load_lexicon(spark, path))


def updated_search_batch(spark, d):
    """The batch over an index whose pages have been replaced and deleted, as over what is left."""
    pages = markup_pages(spark, d)
    index = SegmentedIndex(spark, scratch_path(spark, "segments"))
    index.apply(pages.where("doc_ord % 3 < 2").select("doc_ord", "title", F.when(F.col("doc_ord") % 5 == 0, F.upper("title")).otherwise(F.col("text")).alias("text")))
    index.apply(pages.where("doc_ord % 3 = 2 OR doc_ord % 5 = 0"), pages.where("doc_ord % 11 = 4").select("doc_ord"))
    index.apply(None, pages.where("doc_ord % 7 = 3 OR doc_ord % 11 = 4").select("doc_ord"))
    return index.snapshot().search(lines(spark))


def boolean_search(spark, d):
    """All documents that answer each boolean line."""
    found = materialize(_postings(spark, d), "postings")
    asked = spark.createDataFrame(list(BOOLEAN), "query_id int, line string")
    return boolean_matches(asked, found, P.document_frequencies(found), markup_pages(spark, d).select("doc_ord", "title"), stem=False)


def link_graph(spark, d):
    return page_links(spark.read.parquet(f"{d}/pages.parquet"))


def link_rank(spark, d):
    return rank_links(link_graph(spark, d)).select("node", F.round("rank", 9).alias("rank"))


def _event_stream(spark, d) -> DataFrame:
    """The events as a stream of three batches in order of time, each of which brings the last half day of the one before again.

    A third is written by all cores, a file each, and read as one batch; thirds of so few rows that some core has none are a file each.
    """
    # microseconds since 1970 whatever the session's time zone
    since = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts").cast("timestamp_ntz"))
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.timestamp_micros(since))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    for files in dict.fromkeys((spark.sparkContext.defaultParallelism, 1)):
        source, found = scratch_path(spark, "events"), []
        for i in range(3):
            begin = first + i * third - timedelta(hours=12)
            part = events.where((F.col("ts") >= F.lit(begin)) & ((F.col("ts") < F.lit(first + (i + 1) * third)) | F.lit(i == 2)))
            (part.repartition(files) if files > 1 else part.coalesce(1)).write.parquet(f"{source}/{i}")
            found.append(len(spark.read.schema(events.schema).parquet(f"{source}/{i}").inputFiles()))
        if found == [files] * 3:
            break
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(source)


def _appended(spark, rows: DataFrame) -> DataFrame:
    path = scratch_path(spark, "appended")
    append(rows, path, scratch_path(spark, "state")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def event_windows(spark, d):
    """Statistics of overlapping windows that the watermark has passed, each event once."""
    found = _appended(spark, window_statistics(_event_stream(spark, d), "1 day", "6 hours", "1 day"))
    return found.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


def event_runs(spark, d):
    """Runs of one type of each user's events that the watermark has passed, by a processor with state."""
    events = _event_stream(spark, d)
    with rocksdb(spark):
        found = _appended(spark, runs_of_events(events, "1 day"))
    return found.select("user_id", "event_type", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n", F.round("total", 4).alias("total"))


def sketch_statistics(spark, d):
    """Merged sketches of chunks of 100 documents beside exact figures: each estimate is within its bound."""
    found = materialize(_postings(spark, d), "postings")
    whole = materialize(merged(chunk_sketches(found, 100)), "sketches")
    exact = P.document_frequencies(found)
    n = exact.agg(F.count("*").alias("n"))
    size = vocabulary_size(whole).crossJoin(n).select(F.lit("vocabulary").alias("name"), F.col("n").alias("exact"), (F.abs(F.col("vocabulary") - F.col("n")) <= 3 * 1.04 / 2 ** (LG / 2) * F.col("n")).alias("within"))  # one row each
    # every one of the 20 most frequent tokens is among the sketch's 100, with a count within the bound
    top = exact.orderBy(F.col("df").desc(), "token").limit(20).withColumnRenamed("df", "exact")
    bound = 3.5 * found.count() / TRACKED
    frequent = top.join(frequent_tokens(whole, 100), "token", "left").select(F.concat(F.lit("df "), F.col("token")).alias("name"), "exact", F.coalesce(F.abs(F.col("df") - F.col("exact")) <= bound, F.lit(False)).alias("within"))
    lengths = found.groupBy("doc_ord").agg(F.sum(sum((F.col(f) for f in FIELDS[1:]), F.col("t"))).alias("l"))
    asked = length_quantiles(whole, [0.25, 0.5, 0.75])
    ranks = asked.join(lengths, F.lit(True)).groupBy("at").agg(F.count("*").alias("exact"), F.avg((F.col("l") < F.col("length")).cast("double")).alias("below"), F.avg((F.col("l") <= F.col("length")).cast("double")).alias("upto"))  # three rows with all lengths
    quantiles = ranks.select(F.concat(F.lit("quantile "), F.col("at").cast("string")).alias("name"), "exact", ((F.col("at") >= F.col("below") - 0.03) & (F.col("at") <= F.col("upto") + 0.03)).alias("within"))
    return size.unionByName(frequent).unionByName(quantiles)


def search_query_file(spark, d):
    """The lines of a text file against an index of the pages of a dump, as the command line does it."""
    path, index = scratch_path(spark, "queries"), scratch_path(spark, "index")
    lines(spark).coalesce(1).sortWithinPartitions("query_id").select("line").write.text(path)
    build_index(read_dump(spark, _dump(spark, d)), index)
    return search_index(spark, index, read_queries(spark, path))


def search_block_max(spark, d):
    """The batch over a stored index, of whose postings only the best blocks are read."""
    return search_index_top(spark, _index(spark, d), lines(spark))


def _index(spark, d) -> str:
    """The path of an index over the markup view, in the shared folder."""
    path = scratch_path(spark, "index")
    build_index(markup_pages(spark, d), path)
    return path


def _dump(spark, d) -> str:
    """The path of a page dump of the markup view, in the shared folder."""
    path = scratch_path(spark, "dump")
    write_dump(markup_pages(spark, d), path)
    return path


def stored_search_batch(spark, d):
    return search_index(spark, _index(spark, d), lines(spark))


def warm_search_batch(spark, d):
    """The batch again, after one of every other line has warmed the searcher."""
    searcher = open_index(spark, _index(spark, d))
    searcher.search(lines(spark).where("query_id % 2 = 0")).count()
    return searcher.search(lines(spark))


def streamed_search_batch(spark, d):
    """The batch over an index that a stream of pages has built in two batches."""
    source, path = scratch_path(spark, "incoming"), scratch_path(spark, "streamed")
    pages = markup_pages(spark, d)
    # two files a split of the documents, so that no task has more pages than half a split holds
    pages.repartition(2 * max(1, pages._jdf.rdd().getNumPartitions()), "doc_ord").write.parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(source)
    ingest(stream, path, scratch_path(spark, "state")).awaitTermination()
    return load_streamed(spark, path).search(lines(spark))


def stored_postings(spark, d):
    return load(spark, _index(spark, d)).postings.where(F.col("token").isin("thor", "oner", "src"))


def index_build_stats(spark, d):
    """The statistics of a build; that it took time and space is all that two builds have in common."""
    built = build_index(markup_pages(spark, d), scratch_path(spark, "index"))
    return built.select("vocabulary", "shards", (F.col("seconds") > 0).alias("timed"), (F.col("bytes") > 0).alias("sized"))


def command_line_index(spark, d):
    from .__main__ import main

    path = scratch_path(spark, "index")
    main(["index", _dump(spark, d), path])
    return load(spark, path).stats


def dump_scan(spark, d):
    return read_dump(spark, _dump(spark, d))


def query_file(spark, d):
    path = scratch_path(spark, "queries")
    _item_lines(spark, d).repartitionByRange("query_id").sortWithinPartitions("query_id").select("line").write.text(path)
    return read_queries(spark, path)


_QUERIES = (
    pages_markup_view, clean_casefold, infobox_extract, infobox_strip, references_split, category_extract, category_strip,
    external_links_split, links_extract, references_extract, tokenize_v1, tokenize_v2, tokenize_query, tokenize_fragments,
    stopword_filter, length_filter, stem_vocabulary, field_term_counts, field_term_counts_stemmed, field_term_counts_v1,
    posting_encode, posting_list, posting_decode, chunk_merge, document_frequency, idf_table, vocab_shards, secondary_index,
    shard_lookup, title_address, title_lookup, document_hits, corpus_stats, index_stats, query_classify, query_parse,
    search_free_text, search_field, search_batch, search_aggregated, search_stemmed,
    stored_search_batch, warm_search_batch, streamed_search_batch, updated_search_batch, boolean_search, link_graph, link_rank, event_windows, event_runs, sketch_statistics, search_query_file, search_block_max, fuzzy_vocabulary, wildcard_vocabulary, stored_search_patterns, phrase_matches, search_phrases, stored_search_phrases, stored_postings, index_build_stats, command_line_index, dump_scan, query_file,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles(LINES, CHUNK)
