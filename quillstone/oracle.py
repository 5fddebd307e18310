"""The same queries as ANSI SQL over the parquet tables, for a second engine to check results with."""

from __future__ import annotations

import re

from .oracle_values import (
    BLANKS_ASCII, BLANKS_UNICODE, CHUNK_DOCS, DOUBLES, EXCEPTIONS, FIELDS, INVARIANTS, LI_ENDINGS, REGION_PREFIXES, SHARD_TOKENS, SPECIALS_V1, SPECIALS_V2, STEP2, STEP3, STEP4, STOP_WORDS, WEIGHTS,
)

#: Tokens of the first vocabulary shard; later ones hold one more. Small, so that test data has several.
SHARD_SIZE = 1000


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STOP = ", ".join(map(_quote, STOP_WORDS))


def _tokens(text: str, ascii_only: bool, pad: bool, specials: str, blanks: str) -> str:
    if ascii_only:
        text = f"regexp_replace({text}, '[^\\x00-\\x7F]', '', 'g')"
    text = f"regexp_replace({text}, 'http[^ ]* ', ' ', 'g')"
    text = f"regexp_replace({text}, {_quote(specials)}, ' ', 'g')"
    if pad:
        text = f"regexp_replace({text}, '([A-Za-z]+)', ' \\1 ', 'g')"
    return f"list_filter(regexp_split_to_array({text}, {_quote(blanks)}), lambda x: x <> '')"


def _v1(text: str) -> str:
    return _tokens(text, False, False, SPECIALS_V1, BLANKS_UNICODE)


def _v2(text: str) -> str:
    return _tokens(text, True, True, SPECIALS_V2, BLANKS_ASCII)


def _query(text: str) -> str:
    return _tokens(text, True, False, SPECIALS_V2, BLANKS_ASCII)


def _kept(found: str, least: int) -> str:
    return f"list_filter({found}, lambda x: x NOT IN ({_STOP}) AND length(x) >= {least})"


_PAGES = """pages_ AS (SELECT doc_id AS doc_ord, 'Document ' || doc_id || ' ' || source AS title,
 '{{Infobox document | lang = ' || lang || ' | source = ' || source || '}} ' || text || CASE WHEN doc_id % 4 = 0 THEN ''
 WHEN doc_id % 4 = 1 THEN ' == References == *[note ' || source || ']' || chr(10) || '[[Category:' || lang || ']] ==External links== * [http://example.org/' || doc_id || ' site ' || lang || '] '
 ELSE ' ==References== *[alpha beta] [[Category:' || source || ']][[Category:docs]] == External links == * [http://e.org/x label] ' END AS text FROM documents)"""
_CLEAN = "clean_ AS (SELECT doc_ord, lower(title) AS title, lower(translate(text, chr(10), ' ')) AS text FROM pages_)"
_BOXED = r"""boxed AS (SELECT doc_ord, title, regexp_extract_all(text, '(?s)\{\{infobox(.*?)\}\}', 1) AS infobox,
 regexp_replace(text, '(?s)\{\{infobox.*?\}\}', ' ', 'g') AS text FROM clean_)"""


def _section(text: str, first: str, second: str, part: int) -> str:
    return f"CASE WHEN contains({text}, '{first}') THEN split_part({text}, '{first}', {part}) ELSE split_part({text}, '{second}', {part}) END"


_REFS = ("== references ==", "==references==")
_LINKS = ("==external links==", "== external links ==")
_PARTS = f"parts AS (SELECT doc_ord, title, infobox, {_section('text', *_REFS, 1)} AS body, {_section('text', *_REFS, 2)} AS refs FROM boxed)"
_LISTED = r"""listed AS (SELECT doc_ord, title, infobox, body, regexp_extract_all(refs, '(?s)\[\[category:(.*?)\]\]', 1) AS category,
 regexp_replace(refs, '(?s)\[\[category:.*?\]\]', ' ', 'g') AS refs FROM parts)"""
_SPLIT = f"split_ AS (SELECT * EXCLUDE (refs), {_section('refs', *_LINKS, 1)} AS refs, {_section('refs', *_LINKS, 2)} AS ext FROM listed)"
_FIELDS = r"""fields AS (SELECT doc_ord, title, body, infobox, category, regexp_extract_all(ext, '(?s)\* \[(.*?)\]', 1) AS links,
 regexp_extract_all(refs, '(?s)\*\[(.*?)\]', 1) AS refs FROM split_)"""
_BASE = ", ".join([_PAGES, _CLEAN, _BOXED, _PARTS, _LISTED, _SPLIT, _FIELDS])


def _with(*more: str, base: str = _BASE) -> str:
    return "WITH " + ", ".join([base, *more]) + " "


def _each(fragments: str) -> str:
    return f"flatten(list_transform({fragments}, lambda f: {_v2('f')}))"


def _bag(field: str, found: str, least: int) -> str:
    return f"SELECT doc_ord, '{field}' AS field, unnest({_kept(found, least)}) AS token FROM fields"


_BAGS = "bags AS (" + " UNION ALL ".join([
    _bag("t", _v2("title"), 2), _bag("i", _each("infobox"), 2), _bag("b", _v2("body"), 2),
    _bag("c", _each("category"), 2), _bag("r", _each("refs"), 2), _bag("l", _each("links"), 2),
]) + ")"
_BAGS_V1 = "bags AS (" + " UNION ALL ".join(
    _bag(f, _v1(t), 1) for f, t in (("t", "title"), ("i", "array_to_string(infobox, ' ')"), ("b", "body"), ("c", "array_to_string(category, ' ')"), ("r", "array_to_string(refs, ' ')"), ("l", "array_to_string(links, ' ')"))
) + ")"
_POSTINGS = "postings AS (SELECT token, doc_ord, " + ", ".join(f"CAST(count(*) FILTER (WHERE field = '{f}') AS INTEGER) AS {f}" for f in FIELDS) + " FROM bags GROUP BY token, doc_ord)"
_ENCODED = "'d' || doc_ord || " + " || ".join(f"CASE WHEN {f} <> 0 THEN '{f}' || {f} ELSE '' END" for f in FIELDS)
_STEMMED = "vocabulary_b AS (SELECT DISTINCT token FROM bags), " + "{stems}" + ", bags_s AS (SELECT doc_ord, field, stem AS token FROM bags JOIN b_stems USING (token)), " + _POSTINGS.replace("FROM bags", "FROM bags_s")
_DF = "df AS (SELECT token, count(*) AS df FROM postings GROUP BY token)"
_SHARDS = f"shards AS (SELECT token, CAST(floor(row_number() OVER (ORDER BY token) / {SHARD_SIZE + 1}) AS INTEGER) AS shard FROM df)"


def _ends(word: str, pattern: str) -> str:
    return f"regexp_matches({word}, '({pattern})$')"


def _ends_short(word: str) -> str:
    return f"(regexp_matches({word}, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_matches({word}, '^[aeiouy][^aeiouy]$'))"


def _replaced(pairs: dict[str, str]) -> str:
    """What comes in place of a suffix, as a CASE over the column suf."""
    return "CASE suf " + " ".join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in pairs.items()) + " END"


def _stems(vocabulary: str, tag: str) -> str:
    """<tag>stems(token, stem) of a table of tokens without apostrophes: Porter2, a common table expression a step.

    w is the word so far, in which Y is a y that counts as a consonant; r1 and r2 are where its regions begin,
    f is the stem of a word that is done. A suffix is the longest that fits, as the leftmost match is.
    """
    cut = "left(w, length(w) - length(suf))"
    found = lambda suffixes: f"regexp_extract(w, '({'|'.join(suffixes)})$')"
    first = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
    region = lambda part, whole: f"CASE WHEN regexp_matches({part}, {first}) THEN length(regexp_extract({part}, {first})) ELSE length({part}) END"
    prefix = f"'^({'|'.join(REGION_PREFIXES)})'"
    known = "CASE w " + " ".join(f"WHEN {_quote(a)} THEN {_quote(b)}" for a, b in EXCEPTIONS.items()) + " WHEN '' THEN '' ELSE CASE WHEN length(w) <= 2 THEN w END END"
    last = " UNION ALL ".join(["SELECT token, f AS stem FROM s6 WHERE f IS NOT NULL", """SELECT token, replace(CASE
 WHEN right(w, 1) = 'e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT """ + _ends_short("left(w, length(w) - 1)") + """)) THEN left(w, length(w) - 1)
 WHEN right(w, 2) = 'll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y') FROM s6 WHERE f IS NULL"""])
    steps = f"""s0 AS (SELECT token, lower(token) AS w FROM {vocabulary}),
 s0a AS (SELECT token, {known} AS f, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS w FROM s0),
 s0b AS (SELECT *, CASE WHEN regexp_matches(w, {prefix}) THEN length(regexp_extract(w, {prefix})) ELSE {region("w", "w")} END AS r1 FROM s0a),
 s0c AS (SELECT *, r1 + {region("substr(w, r1 + 1)", "w")} AS r2 FROM s0b),
 s1 AS (SELECT * REPLACE (CASE WHEN {_ends("w", "sses")} THEN left(w, length(w) - 2)
  WHEN {_ends("w", "ied|ies")} THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN {_ends("w", "us|ss")} THEN w WHEN {_ends("w", "s")} AND regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN left(w, length(w) - 1) ELSE w END AS w) FROM s0c),
 s1a AS (SELECT * REPLACE (CASE WHEN f IS NULL AND w IN ({', '.join(map(_quote, sorted(INVARIANTS)))}) THEN w ELSE f END AS f), {found(("eedly", "eed", "ingly", "edly", "ing", "ed"))} AS suf FROM s1),
 s1b AS (SELECT *, {cut} AS c FROM s1a),
 s1c AS (SELECT token, f, r1, r2, CASE WHEN suf IN ('eed', 'eedly') THEN CASE WHEN length(c) >= r1 THEN c || 'ee' ELSE w END
  WHEN suf = '' OR NOT regexp_matches(c, '[aeiouy]') THEN w WHEN {_ends("c", "at|bl|iz")} THEN c || 'e'
  WHEN {_ends("c", "|".join(DOUBLES))} THEN left(c, length(c) - 1) WHEN r1 >= length(c) AND {_ends_short("c")} THEN c || 'e' ELSE c END AS w FROM s1b),
 s2 AS (SELECT * REPLACE (CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w) FROM s1c),
 s2a AS (SELECT *, {found((*STEP2, "ogi", "li"))} AS suf FROM s2), s2b AS (SELECT *, {cut} AS c FROM s2a),
 s3 AS (SELECT token, f, r1, r2, CASE WHEN suf = '' OR length(c) < r1 THEN w WHEN suf = 'ogi' THEN CASE WHEN right(c, 1) = 'l' THEN left(w, length(w) - 1) ELSE w END
  WHEN suf = 'li' THEN CASE WHEN {_ends("c", "[" + "".join(sorted(LI_ENDINGS)) + "]")} THEN c ELSE w END ELSE c || {_replaced(STEP2)} END AS w FROM s2b),
 s3a AS (SELECT *, {found((*STEP3, "ative"))} AS suf FROM s3), s3b AS (SELECT *, {cut} AS c FROM s3a),
 s4 AS (SELECT token, f, r1, r2, CASE WHEN suf = '' OR length(c) < r1 THEN w WHEN suf = 'ative' THEN CASE WHEN length(c) >= r2 THEN c ELSE w END ELSE c || {_replaced(STEP3)} END AS w FROM s3b),
 s5 AS (SELECT *, {found((*STEP4, "ion"))} AS suf FROM s4), s5a AS (SELECT *, {cut} AS c FROM s5),
 s6 AS (SELECT token, f, r1, r2, CASE WHEN suf = '' OR length(c) < r2 OR (suf = 'ion' AND NOT {_ends("c", "[st]")}) THEN w ELSE c END AS w FROM s5a),
 stems AS ({last})"""
    return re.sub(r"\b(s\d[a-c]?|stems)\b", tag + r"\1", steps)


# A line of each benchmark item.
_ITEM_LINES = """SELECT item_id + 1000 AS query_id, CASE item_id % 3 WHEN 0 THEN w WHEN 1 THEN 't:' || w || ' b:' || w ELSE 'q:' || w END AS line
 FROM (SELECT item_id, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS w FROM benchmark)"""


def _parsed(lines, stem: bool = False, more: str = "") -> str:
    values = ", ".join(f"({i}, {_quote(s)})" for i, s in lines)
    known = ", ".join(map(_quote, FIELDS))
    listed, source = ("words_", "words_ JOIN q_stems USING (token)") if stem else ("all_terms", "all_terms")
    own = "* EXCLUDE (token, stem), stem AS token" if stem else "*"
    stemming = f"vocabulary_q AS (SELECT DISTINCT token FROM words_), {_stems('vocabulary_q', 'q_')}," if stem else ""
    return f"""lines AS (SELECT * FROM (VALUES {values}) v(query_id, line){more}),
 classes AS (SELECT query_id, line, len(p) > 0 AND len(list_filter(p, lambda x: split_part(x, ':', 1) NOT IN ({known}))) = 0 AS is_field
  FROM (SELECT query_id, line, list_filter(string_split(line, ' '), lambda x: contains(x, ':')) AS p FROM lines)),
 pieces AS (SELECT query_id, is_field, unnest(string_split(line, ' ')) AS piece, generate_subscripts(string_split(line, ' '), 1) - 1 AS place FROM classes),
 marked AS (SELECT query_id, is_field, place, CASE WHEN is_field AND len(string_split(piece, ':')) = 2 THEN split_part(piece, ':', 1) END AS own,
  CASE WHEN is_field AND len(string_split(piece, ':')) = 2 THEN split_part(piece, ':', 2) ELSE piece END AS word FROM pieces),
 sticky AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING), 'z') AS field FROM marked),
 texts AS (SELECT query_id, is_field, field, min(place) AS field_pos, string_agg(word, ' ' ORDER BY place) AS text FROM sticky GROUP BY query_id, is_field, field),
 bags_q AS (SELECT query_id, is_field, field, field_pos, {_kept(_query('text'), 1)} AS found FROM texts),
 {listed} AS (SELECT query_id, is_field, field, field_pos, lower(unnest(found)) AS token, generate_subscripts(found, 1) - 1 AS pos FROM bags_q),
 {stemming} all_found AS (SELECT {own} FROM {source}),
 terms AS (SELECT query_id, CAST(field_pos AS INTEGER) AS field_pos, field, CAST(pos AS INTEGER) AS pos, token
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, token ORDER BY field_pos, pos) AS i FROM all_found) WHERE is_field OR i = 1)"""


_WHOLE = " + ".join(f"{WEIGHTS[f]} * {f}" for f in FIELDS)
_TF = "CASE field WHEN 'z' THEN " + _WHOLE + "".join(f" WHEN '{f}' THEN {WEIGHTS[f]} * {f}" for f in FIELDS) + " END"
_ENTRIES = f"""entries AS (SELECT query_id, field_pos, field, pos, token, doc_ord, CAST({_TF} AS BIGINT) AS tf,
 ({_TF}) * (ln((SELECT count(*) FROM pages_) / df) / ln(2.0)) AS score FROM terms JOIN df USING (token) JOIN postings USING (token))"""


def _ranked(where: str = "true") -> str:
    return f"""SELECT query_id, rank, doc_ord, title, field, token, tf, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER
 (PARTITION BY query_id ORDER BY round(score, 6) DESC, field_pos, pos, doc_ord) AS INTEGER) AS rank FROM entries) JOIN (SELECT doc_ord, title FROM pages_) USING (doc_ord) WHERE rank <= 10 AND {where}"""


def _count(found: str, source: str) -> str:
    return f"SELECT doc_ord, token, count(*) AS n FROM (SELECT doc_ord, unnest({found}) AS token FROM {source}) GROUP BY doc_ord, token"


def _explode(column: str, source: str) -> str:
    return f"SELECT doc_ord, CAST(generate_subscripts({column}, 1) - 1 AS INTEGER) AS pos, unnest({column}) AS fragment FROM {source}"


def _spots(field: str, column: str, listed: bool) -> str:
    """Rows (doc_ord, field, fragment, pos, token) of a field; every token has a place, kept or not."""
    source = f"(SELECT doc_ord, unnest({column}) AS x, generate_subscripts({column}, 1) AS fragment FROM fields)" if listed else f"(SELECT doc_ord, {column} AS x, 1 AS fragment FROM fields)"
    return f"SELECT doc_ord, '{field}' AS field, fragment, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM (SELECT doc_ord, fragment, {_v2('x')} AS w FROM {source})"


_SPOTS = "spots AS (" + " UNION ALL ".join([_spots("t", "title", False), _spots("b", "body", False), _spots("i", "infobox", True), _spots("c", "category", True), _spots("r", "refs", True), _spots("l", "links", True)]) + ")"
# The clauses of the lines with phrases, written out: query, clause, tokens, offsets; and query, clause, distance, two tokens.
_ASKED = """phrases AS (SELECT * FROM (VALUES (1, 0, ['thor', 'thor', 'thor'], [0, 1, 2]), (2, 0, ['nd', 'er'], [0, 2]), (5, 0, ['th', 'er'], [0, 1]), (5, 1, ['ble'], [0]),
 (6, 0, ['lang', 'en', 'source'], [0, 1, 2]), (9, 0, ['alpha', 'beta'], [0, 1]), (9, 1, ['docs'], [0])) v(query_id, clause, words, offsets)),
nears AS (SELECT * FROM (VALUES (3, 0, 5, 'nd', 'ti'), (4, 0, 3, 'ha', 'er'), (4, 1, 4, 'er', 'ing'), (10, 0, 2, 'th', 'th')) v(query_id, clause, distance, one, other)),
slots AS (SELECT query_id, clause, len(words) AS slots, unnest(words) AS token, unnest(offsets) AS off FROM phrases),
starts AS (SELECT query_id, clause, doc_ord, field FROM slots JOIN spots USING (token) GROUP BY query_id, clause, slots, doc_ord, field, fragment, pos - off HAVING count(*) = slots),
close_ AS (SELECT DISTINCT n.query_id, n.clause, a.doc_ord, a.field, a.fragment, a.pos FROM nears n JOIN spots a ON a.token = n.one JOIN spots b ON b.token = n.other
 AND a.doc_ord = b.doc_ord AND a.field = b.field AND a.fragment = b.fragment AND abs(a.pos - b.pos) BETWEEN 1 AND n.distance),
held AS (SELECT query_id, clause, doc_ord, field, count(*) AS n FROM (SELECT * FROM starts UNION ALL SELECT query_id, clause, doc_ord, field FROM close_) GROUP BY ALL)"""
_PHRASE_RANKED = """SELECT query_id, rank, doc_ord, title, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord) AS INTEGER) AS rank
 FROM (SELECT query_id, doc_ord, round(sum(tf * ln((SELECT count(*) FROM pages_) / df) / ln(2.0)), 6) AS score, count(*) AS met
  FROM (SELECT query_id, clause, doc_ord, sum(n * CASE field WHEN 't' THEN 10 WHEN 'i' THEN 5 WHEN 'c' THEN 5 WHEN 'b' THEN 1 ELSE 2 END) AS tf, count(*) OVER (PARTITION BY query_id, clause) AS df
   FROM held GROUP BY query_id, clause, doc_ord) GROUP BY query_id, doc_ord) s
 WHERE met = (SELECT count(*) FROM (SELECT query_id, clause FROM phrases UNION SELECT query_id, clause FROM nears) c WHERE c.query_id = s.query_id))
JOIN (SELECT doc_ord, title FROM pages_) USING (doc_ord) WHERE rank <= 10"""


# The pieces of the lines with misspelt words and wildcards, written out: query, piece, edits or none, word or SQL pattern.
_LIKELY = """asked_likely AS (SELECT * FROM (VALUES (1, 0, 2, 'thro'), (1, 1, 0, 'onere'), (2, 0, NULL, 'th%r'), (3, 0, NULL, 'o%ere'), (3, 1, 1, 'thor'), (4, 0, NULL, '%ution'), (4, 1, NULL, 's%c%'),
 (5, 0, 2, 'qqqqqqqq'), (5, 1, NULL, 'zzz%')) v(query_id, piece, edits, word)),
terms AS (SELECT query_id, 0 AS field_pos, 'z' AS field, token, row_number() OVER (PARTITION BY query_id ORDER BY min(piece), token) AS pos
 FROM asked_likely JOIN df ON CASE WHEN edits IS NULL THEN token LIKE word ELSE levenshtein(token, word) <= edits END GROUP BY query_id, token)"""
_PATTERNS = "patterns AS (SELECT unnest(['th*r', '*tion', '*erea*', 'a*b*e', 's*1*', 'onere', '*q*', 're*re']) AS pattern)"
_BENCH_WORDS = "words_b AS (SELECT DISTINCT unnest({found}) AS word FROM benchmark)"


def _has(word: str, field: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM postings p WHERE p.doc_ord = d.doc_ord AND p.token = '{word}'" + (f" AND p.{field} > 0)" if field else ")")


# The boolean lines, written out.
_BOOLEAN = " UNION ALL ".join(
    f"SELECT {i} AS query_id, doc_ord FROM pages_ d WHERE {where}"
    for i, where in (
        (1, f"{_has('thor')} AND {_has('onere')}"),
        (2, f"{_has('thor')} OR {_has('onere')}"),
        (3, f"{_has('th')} AND {_has('er')} AND NOT {_has('ing')}"),
        (4, f"NOT {_has('th')}"),
        (5, f"({_has('ti')} OR {_has('tion')}) AND {_has('nd')} AND NOT ({_has('er')} OR {_has('12', 't')})"),
        (6, f"{_has('document', 't')} AND {_has('onere')}"),
        (7, f"{_has('en', 'i')} AND {_has('docs', 'c')} AND NOT {_has('th', 'b')}"),
        (10, f"{_has('label', 'l')} OR NOT ({_has('note', 'r')} OR {_has('nd', 'b')})"),
    )
)
_GRAPH = r"""hosts AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
 unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
edges AS (SELECT DISTINCT host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') AS source,
 host || '/' || array_to_string(list_filter(string_split(regexp_extract(replace(href, '&amp;', '&'), '^([^?#]*)', 1), '/'), lambda x: x <> ''), '/') AS target FROM hosts WHERE href LIKE '/%'),
links AS (SELECT * FROM edges WHERE source <> target)"""


def _ranks(rounds: int = 60) -> str:
    """Power iteration, a common table expression a round."""
    steps = [f"WITH {_GRAPH}, nodes AS MATERIALIZED (SELECT source AS node FROM links UNION SELECT target FROM links), stats AS (SELECT count(*) AS n FROM nodes)",
             "degrees AS MATERIALIZED (SELECT source AS node, count(*) AS k FROM links GROUP BY source)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, stats)"]
    for i in range(rounds):
        steps.append(f"""g{i} AS MATERIALIZED (SELECT l.target AS node, sum(r / k) AS got FROM links l JOIN r{i} ON r{i}.node = l.source JOIN degrees e ON e.node = l.source GROUP BY l.target),
r{i + 1} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} ANTI JOIN degrees USING (node)) / n) AS r FROM nodes LEFT JOIN g{i} USING (node), stats)""")
    return ", ".join(steps) + f" SELECT node, round(r, 9) AS rank FROM r{rounds}"


_WATERMARK = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"
_WINDOWS = f"""SELECT event_type, epoch_us(s) AS start_us, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') - to_hours(6 * unnest(range(0, 4))) AS s FROM events) WHERE s + INTERVAL 1 DAY <= {_WATERMARK} GROUP BY event_type, s"""
_RUNS = f"""WITH seen AS (SELECT * FROM events WHERE ts <= {_WATERMARK}),
marked AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, sum(new) OVER (PARTITION BY user_id) AS runs FROM marked)
SELECT user_id, event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n, round(sum(value), 4) AS total FROM numbered WHERE run < runs GROUP BY user_id, event_type, run"""


def oracles(lines, chunk: int) -> dict[str, str]:
    """SQL by query name."""
    stored = (_BAGS, _POSTINGS)
    asked = _with(*stored, _DF, _parsed(lines), _ENTRIES)
    stemmed = (_BAGS, _STEMMED.replace("{stems}", _stems("vocabulary_b", "b_")))
    asked_stems = _with(*stemmed, _DF, _parsed(lines, True), _ENTRIES) + _ranked()
    lists = f"SELECT token, doc_ord // {CHUNK_DOCS} AS chunk, string_agg({_ENCODED}, '' ORDER BY doc_ord) AS postings FROM postings GROUP BY ALL"
    statistics = "SELECT (SELECT count(*) FROM pages_) AS n_docs, count(DISTINCT token) AS vocabulary, count(*) AS n_postings, CAST(coalesce(sum(t + i + b + c + r + l), 0) AS BIGINT) AS n_occurrences FROM postings"
    return {
        "pages_markup_view": _with() + "SELECT doc_ord, title, text FROM pages_",
        "clean_casefold": _with() + "SELECT doc_ord, text FROM clean_",
        "infobox_extract": _with() + _explode("infobox", "boxed"),
        "infobox_strip": _with() + "SELECT doc_ord, text FROM boxed",
        "references_split": _with() + "SELECT doc_ord, body, refs FROM parts",
        "category_extract": _with() + _explode("category", "listed"),
        "category_strip": _with() + "SELECT doc_ord, refs FROM listed",
        "external_links_split": _with() + "SELECT doc_ord, refs, ext AS links FROM split_",
        "links_extract": _with() + _explode("links", "fields"),
        "references_extract": _with() + _explode("refs", "fields"),
        "tokenize_v1": _with() + _count(_v1("text"), "clean_"),
        "tokenize_v2": _with() + _count(_v2("text"), "clean_"),
        "tokenize_query": _with() + _count(_query("text"), "pages_"),
        "tokenize_fragments": _with() + _count(_each("list_concat(list_concat(infobox, category), list_concat(links, refs))"), "fields"),
        "stopword_filter": _with() + _count(_kept(_v1("text"), 1), "clean_"),
        "length_filter": _with() + _count(_kept(_v2("text"), 2), "clean_"),
        "field_term_counts": _with(*stored) + "SELECT * FROM postings",
        "field_term_counts_v1": _with(_BAGS_V1, _POSTINGS) + "SELECT * FROM postings",
        "posting_encode": _with(*stored) + f"SELECT token, doc_ord, {_ENCODED} AS posting FROM postings",
        "posting_list": _with(*stored) + lists,
        "posting_decode": _with(*stored) + "SELECT * FROM postings",
        "chunk_merge": _with(*stored) + lists,
        "document_frequency": _with(*stored, _DF) + "SELECT token, df FROM df",
        "idf_table": _with(*stored, _DF) + "SELECT token, df, round(ln((SELECT count(*) FROM pages_) / df) / ln(2.0), 6) AS idf FROM df",
        "vocab_shards": _with(*stored, _DF, _SHARDS) + "SELECT token, shard FROM shards",
        "secondary_index": _with(*stored, _DF, _SHARDS) + "SELECT shard, min(token) AS first_token FROM shards GROUP BY shard",
        "shard_lookup": _with(*stored, _DF, _SHARDS, "firsts AS (SELECT shard, min(token) AS first_token FROM shards GROUP BY shard)",
            "wanted AS (SELECT token FROM df UNION SELECT token || 'x' FROM df UNION SELECT '!' UNION SELECT 'zzzzz')")
        + "SELECT w.token, f.shard FROM wanted w ASOF JOIN firsts f ON w.token >= f.first_token",
        "title_address": _with() + f"SELECT doc_ord, doc_ord // {chunk} AS chunk, doc_ord % {chunk} AS line FROM pages_",
        "title_lookup": _with(*stored) + "SELECT token, doc_ord, title FROM postings JOIN (SELECT doc_ord, title FROM pages_) USING (doc_ord) WHERE token IN ('thor', 'onere', 'src1')",
        "document_hits": _with(*stored) + "SELECT token, doc_ord FROM postings WHERE token IN ('thor', 'onere', 'src1')",
        "corpus_stats": _with(*stored) + statistics,
        "index_stats": _with(*stored, _DF) + f"SELECT count(*) AS vocabulary, CAST(ceil(count(*) / {SHARD_SIZE + 1}) AS BIGINT) AS shards FROM df",
        "query_classify": "WITH " + _parsed(lines, more=" UNION ALL " + _ITEM_LINES) + " SELECT query_id, line, is_field FROM classes",
        "query_parse": "WITH " + _parsed(lines, more=" UNION ALL " + _ITEM_LINES) + " SELECT query_id, field_pos, field, pos, token FROM terms",
        "stem_vocabulary": _with(*stemmed) + "SELECT token, stem FROM b_stems",
        "field_term_counts_stemmed": _with(*stemmed) + "SELECT * FROM postings",
        "search_stemmed": asked_stems,
        "stored_search_batch": asked_stems,
        "warm_search_batch": asked_stems,
        "streamed_search_batch": asked_stems,
        "search_block_max": asked_stems,
        "updated_search_batch": asked_stems.replace("END AS text FROM documents)", "END AS text FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 4)"),
        "fuzzy_vocabulary": _with(*stored, _DF, _BENCH_WORDS.format(found=_v2("lower(replace(coalesce(text, ''), chr(10), ' '))")))
        + "SELECT word, 2 AS edits, token, CAST(levenshtein(word, token) AS INTEGER) AS distance FROM words_b JOIN df ON abs(length(word) - length(token)) <= 2 AND levenshtein(word, token) <= 2",
        "wildcard_vocabulary": _with(*stored, _DF, _PATTERNS) + "SELECT pattern, token FROM patterns JOIN df ON token LIKE replace(pattern, '*', '%')",
        "stored_search_patterns": _with(*stored, _DF, _LIKELY, _ENTRIES) + _ranked(),
        "boolean_search": _with(*stored) + _BOOLEAN,
        "link_graph": f"WITH {_GRAPH} SELECT * FROM links",
        "link_rank": _ranks(),
        "event_windows": _WINDOWS,
        "sketch_statistics": _with(*stored, _DF) + """SELECT 'vocabulary' AS name, count(*) AS exact, true AS within FROM df
 UNION ALL SELECT 'df ' || token, df, true FROM (SELECT token, df FROM df ORDER BY df DESC, token LIMIT 20)
 UNION ALL SELECT 'quantile ' || q, count(DISTINCT doc_ord), true FROM postings, (VALUES ('0.25'), ('0.5'), ('0.75')) v(q) GROUP BY q""",
        "search_query_file": _with(*stemmed, _DF, _parsed([(i, line) for i, (_, line) in enumerate(lines)], True), _ENTRIES) + _ranked().replace("rank, doc_ord, title, field", "rank, (SELECT count(*) FROM pages_ e WHERE e.doc_ord < r.doc_ord) AS doc_ord, title, field").replace("FROM entries) JOIN", "FROM entries) r JOIN"),
        "event_runs": _RUNS,
        "phrase_matches": _with(_SPOTS, _ASKED) + "SELECT * FROM held",
        "search_phrases": _with(_SPOTS, _ASKED) + _PHRASE_RANKED,
        "stored_search_phrases": _with(_SPOTS, _ASKED) + _PHRASE_RANKED,
        "stored_postings": _with(*stemmed) + "SELECT * FROM postings WHERE token IN ('thor', 'oner', 'src')",
        "index_build_stats": _with(*stemmed, _DF) + f"SELECT count(*) AS vocabulary, CAST(ceil(count(*) / {SHARD_TOKENS + 1}) AS BIGINT) AS shards, true AS timed, true AS sized FROM df",
        "command_line_index": _with(*stemmed) + statistics,
        "dump_scan": _with() + "SELECT row_number() OVER (ORDER BY doc_ord) - 1 AS doc_ord, doc_ord AS page_id, title, text FROM pages_",
        "query_file": "WITH " + _parsed(lines, more=" UNION ALL " + _ITEM_LINES) + " SELECT row_number() OVER (ORDER BY query_id) - 1 AS query_id, line FROM lines",
        "search_free_text": asked + _ranked("query_id = 1"),
        "search_field": asked + _ranked("query_id = 3"),
        "search_batch": asked + _ranked(),
        "search_aggregated": asked + """SELECT query_id, rank, doc_ord, title, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY
 round(score, 6) DESC, doc_ord) AS INTEGER) AS rank FROM (SELECT query_id, doc_ord, sum(score) AS score FROM entries GROUP BY query_id, doc_ord)) JOIN (SELECT doc_ord, title FROM pages_) USING (doc_ord) WHERE rank <= 10""",
    }
