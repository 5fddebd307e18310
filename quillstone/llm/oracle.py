"""SQL over whole tables for those contract queries that SQL can express."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM words),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_ LEFT JOIN sizes USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) > 12)),
first_ AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM windows JOIN first_ USING (s) WHERE d < doc_id),
each_ AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM each_ ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
 FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, lengths)),
hits AS (SELECT doc_id, i, n, item_id FROM windows JOIN phrases USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
RANKED_SEARCH = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_TERM}) AS w FROM documents),
docs AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
stats AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
norms AS (SELECT doc_id, 10 + (90 * n * nn) // ll AS m FROM docs, stats),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLD}, {_TERM})) AS term FROM benchmark),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, stats GROUP BY term, nn),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
 FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
 FROM scores WHERE score > 0) WHERE rank <= 10
"""

_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: {steps})"
_STEP = "list_reduce(list_prepend(xor(a, b), [CAST(1 AS BIGINT), 1, 1, 1, 1, 1, 1, 1]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
PREFIX_TRIE = rf"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
shared AS (SELECT *, xor({_CRC.format(steps=_STEP)}, 4294967295) % 6 AS h FROM own),
rebuilt AS (SELECT s.conv_id, list_concat(coalesce(b.w[1 : h], []), s.w[h + 1 :]) AS w FROM shared s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100),
prefixes AS (SELECT conv_id, d, w[1 : d] AS p FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT p[1 : x] AS p, sum(CAST(childless AS BIGINT)) AS n_leaves, sum(saves) AS saved_tokens FROM (
 SELECT n.p, unnest(range(0, n.d + 1)) AS x, k.p IS NULL AS childless, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[n.d].t) END AS saves FROM nodes n LEFT JOIN kids k ON k.p = n.p) GROUP BY ALL),
ends AS (SELECT w AS p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS hash FROM rebuilt GROUP BY w)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
 CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM nodes n JOIN below USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1 : n.d - 1]
"""

EXACT_DEDUP = r"""
WITH each_ AS (SELECT doc_id, length(coalesce(text, '')) AS l, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
groups_ AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY l DESC, doc_id) AS keep_id,
 count(*) OVER (PARTITION BY text_sha256) AS group_size FROM each_)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM groups_
"""


def oracles() -> dict[str, str]:
    return {"op2_minhash_odd_sketch": NEAR_DUPLICATES, "op7_rlz_dedup": SUBSTRING_DEDUP, "op10_fm_decontaminate": DECONTAMINATION, "op11_block_max_wand": RANKED_SEARCH, "op12_prefix_trie": PREFIX_TRIE, "op13_bloom_dedup": EXACT_DEDUP}
