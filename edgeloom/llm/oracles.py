"""DuckDB SQL of the queries that SQL can express over whole tables."""

from math import ceil

from edgeloom.llm import license_scan

ORACLES: dict[str, str] = {}

ORACLES["op4_decontaminate"] = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM bs),
ds AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
ms AS (SELECT DISTINCT m FROM pat),
occ AS (
  SELECT d.doc_id, d.i, p.m, p.item_id
  FROM (SELECT ds.doc_id, ds.i, ms.m, array_to_string(w[i:i + ms.m - 1], ' ') AS p FROM ds, ms WHERE ds.i + ms.m - 1 <= len(w)) d
  JOIN pat p ON p.m = d.m AND p.p = d.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""

ORACLES["op5_substring_dedup"] = """
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
ws AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13)),
firsts AS (SELECT p, min(doc_id) AS first_doc FROM ws GROUP BY p),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
  FROM ws JOIN firsts USING (p) WHERE doc_id > first_doc),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM dw),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""

ORACLES["op3_curriculum_mix"] = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
f AS (SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, target, rank,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN size > 0 AND middle <= target THEN 1 ELSE 0 END + CASE WHEN size > 0 AND middle + source_size <= target THEN 1 ELSE 0 END AS copies,
    middle / nullif(target, 0) AS u
  FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  round(CASE WHEN copies > 0 THEN CASE rank % 3
    WHEN 0 THEN u
    WHEN 1 THEN CASE WHEN u < 0.3 THEN 2 * u / (0.2 + sqrt(0.04 + 3.2 * u)) ELSE 0.5 + 2 * (u - 0.3) / (1 + sqrt(1 + 3.2 * (u - 0.3))) END
    ELSE CASE WHEN u < 0.7 THEN 2 * u / (1.8 + sqrt(greatest(0, 3.24 - 3.2 * u))) ELSE 0.5 + 2 * (u - 0.7) / (1 + sqrt(greatest(0, 1 - 3.2 * (u - 0.7)))) END
    END END, 6) AS first_position
FROM q
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PLAIN = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

ORACLES["op1_itq_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.a) AS n_links, component_id, a = component_id AS kept FROM c
"""

_CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped_length(c: str) -> str:
    starts = " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in ("\\", *_CONTROLS))
    return f"(length({c}) + {starts})"


ORACLES["op6_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len("".join(_CONTROLS[:3]))} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES["op7_minhash_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


def _url_oracle(order: int = 5) -> str:
    levels = []
    for k in range(1, order + 1):
        lower = {s: f"t{k - 1}.{s}" if k > 1 else "(1.0::DOUBLE / 256)" for s in "ar"}
        columns = ", ".join(
            f"CASE WHEN sum(g.{s}) OVER x > 0 THEN (g.{s} + sum((g.{s} > 0)::INT) OVER x * {lower[s]})::DOUBLE / (sum(g.{s}) OVER x + sum((g.{s} > 0)::INT) OVER x) ELSE {lower[s]} END AS {s}"
            for s in "ar"
        )
        joined = f" JOIN t{k - 1} ON t{k - 1}.gram = right(g.gram, {k - 1})" if k > 1 else ""
        levels.append(f"t{k} AS (SELECT g.gram, {columns} FROM (SELECT right(w, {k}) AS gram, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM pos GROUP BY 1) g{joined} WINDOW x AS (PARTITION BY left(g.gram, {k - 1})))")
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(translate(coalesce(url, ''), {_AZ}), '^[^:/?#]*://', '') AS text FROM pages),
j AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u),
t AS (
  SELECT text, count(*) FILTER (rule IN ('example.net/en/', 'org/fr/')) AS a, count(*) FILTER (rule IN ('net/', 'example.com/de/')) AS r, md5(text)[1] IN ('0', '1', '2') AS held FROM j GROUP BY text),
pos AS (SELECT text, CASE WHEN held THEN 0 ELSE a END AS a, CASE WHEN held THEN 0 ELSE r END AS r, substring(repeat(chr(2), {order - 1}) || text || chr(3), i, {order}) AS w FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM t)),
{", ".join(levels)},
s AS (SELECT text, sum(ln(t{order}.a) - ln(t{order}.r)) / count(*) AS score FROM pos JOIN t{order} ON gram = w GROUP BY text),
b AS (SELECT floor(score / 0.01) AS bin, sum(t.a) AS a, sum(t.r) AS r FROM s JOIN t USING (text) WHERE held GROUP BY 1 HAVING sum(a) + sum(r) > 0),
h AS (
  SELECT bin, (sum(a) OVER () - coalesce(sum(a) OVER before, 0)) / nullif(sum(a) OVER (), 0)::DOUBLE + coalesce(sum(r) OVER before, 0) / nullif(sum(r) OVER (), 0)::DOUBLE AS gain
  FROM b WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT coalesce((SELECT bin * 0.01 FROM h WHERE gain IS NOT NULL ORDER BY round(gain, 12) DESC, bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN score >= (SELECT cut FROM c) THEN 'allow' ELSE 'block' END AS verdict
FROM j JOIN s USING (text)
"""


ORACLES["op8_url_filter"] = _url_oracle()


def _license_oracle(templates, phrases, containment: float) -> str:
    rows = []
    for k, (label, text, names) in enumerate(templates):
        own = sorted(set(text.split()))
        rows.append(f"({k}, '{label}', {own}, {names.split()}, {max(1, ceil(containment * len(own) - 1e-9))}, {license_scan.block_length(len(text.split()), containment)})")
    fixed = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in phrases)
    return f"""
WITH templates(k, label, t, names, need, m) AS (VALUES {", ".join(rows)}), phrases(p, label, m) AS (VALUES {fixed}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_PLAIN}) AS w FROM documents),
places AS (
  SELECT doc_id, label, i - 1 AS i
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN phrases ON array_to_string(w[i:i + m - 1], ' ') = p AND i + m - 1 <= len(w)),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY doc_id),
able AS (
  SELECT doc_id, w, label, t, names, need, m FROM (SELECT doc_id, w, list_distinct(w) AS own FROM d), templates
  WHERE len(list_intersect(own, t)) >= need AND len(list_intersect(own, names)) = len(names)),
blocks AS (SELECT doc_id, label, t, names, need, w[i:i + m - 1] AS block FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM able) WHERE list_contains(t, w[i])),
found AS (
  SELECT doc_id, label, max(len(list_intersect(block, t))::DOUBLE / len(t)) AS score FROM blocks
  WHERE len(list_intersect(block, t)) >= need AND len(list_intersect(block, names)) = len(names) GROUP BY doc_id, label),
names AS (SELECT doc_id, label, true AS base, 1.0::DOUBLE AS score FROM places UNION ALL SELECT doc_id, label, false, score FROM found),
sums AS (
  SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM names GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id
"""


ORACLES["op10_license_scan"] = ORACLES["op10_license_scan_runs"] = _license_oracle(license_scan.TEMPLATES, license_scan.PHRASES, license_scan.CONTAINMENT)


ORACLES["op12_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic
  FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, fails),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
r AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, fails, contains(fails, filter_order[step]) AS here,
    len(list_intersect(string_split(fails, ''), string_split(filter_order[1:step - 1], ''))) > 0 AND step > 1 AND fails <> '' AS before
  FROM c, s),
a AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT here AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT before), 0) AS removed,
    coalesce(sum(n) FILTER (here AND before), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT before), 0) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM a
"""

# crc32 of a decimal, bit by bit: each step takes in a byte at the first of its eight bits
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(range(8 * length(s)), lambda k: CASE WHEN k % 8 = 0 THEN ord(s[k // 8 + 1]) ELSE 0 END::BIGINT),
    lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))))"""

ORACLES["op13_prefix_trie"] = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, {_CRC} % 9 AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM own)),
c AS (SELECT h.conv_id AS c, CASE WHEN h.conv_id % 5 = 0 THEN h.t ELSE coalesce(b.t[1:h.h], []) || h.t[h.h + 1:] END AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT c, len(t) AS n, d, sha256(CAST(t[1:d] AS VARCHAR) || '#' || d) AS k, sha256(CAST(t[1:d - 1] AS VARCHAR) || '#' || d - 1) AS up, CASE WHEN d > 0 THEN strlen(t[d].text) ELSE 0 END AS size
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM c)),
v AS (SELECT k, min(up) AS up, d, min(size) AS size, min(c) AS c, count(*) AS n, coalesce(string_agg(c, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY k, d),
w AS (SELECT v.*, (SELECT count(*) FROM v x WHERE x.d > 0 AND x.up = v.k) AS children FROM v),
below AS (SELECT a.k, sum(CASE WHEN w.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((w.n - 1) * w.size) AS saved FROM w JOIN p a ON a.c = w.c AND a.d <= w.d GROUP BY a.k)
SELECT w.c AS conv_id, w.d AS depth, CASE WHEN w.d > 0 THEN u.c END AS parent_conv_id, w.n AS n_convs, w.children AS n_children,
  below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN below ON below.k = w.k LEFT JOIN v u ON w.d > 0 AND u.k = w.up
"""
