"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import (
    binary_output, decontaminate, filter_audit, html_text, language_id, near_duplicates, packing, pii, quality,
    secrets_scan, substring_dedup, url_rules, vector_codes,
)
from shelfcast.llm.common import table
from shelfcast.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_text(spark, sf):
    return html_text.extract_pages(table(spark, sf, "pages"))


@query
def op2_minhash_dedup(spark, sf):
    return near_duplicates.groups(table(spark, sf, "documents"))


ORACLE["op2_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words
        WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id,
  min(other) = w.doc_id AS kept
FROM words w JOIN reach USING (doc_id) LEFT JOIN sizes s ON s.doc_id = w.doc_id
GROUP BY w.doc_id
"""


@query
def op3_packing(spark, sf):
    packed = packing.pack(table(spark, sf, "documents"))
    return binary_output.crc32(packed, "doc_id", "start", "length", "doc_tokens", "sequence_id",
                               "offset", width=2)


@query
def op4_url_filter(spark, sf):
    return url_rules.judge_urls(table(spark, sf, "pages"))


ORACLE["op4_url_filter"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END
    AS rest FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  coalesce(arg_max(verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host)
  AND starts_with(path, rule_path)
GROUP BY page_id, host, path
"""


@query
def op5_binary_output(spark, sf):
    path = scratch_path(spark, "token-ids")
    binary_output.write_ids(table(spark, sf, "documents"), path)
    return binary_output.read_ids(spark, path, sums=True)


@query
def op6_quality_rules(spark, sf):
    return quality.judge_quality(table(spark, sf, "documents")).drop("lang", *quality.MEASURES)


@query
def op7_personal_data(spark, sf):
    return pii.digest(pii.personal_data(table(spark, sf, "documents")))


@query
def op8_secret_scan(spark, sf):
    return secrets_scan.digest(secrets_scan.scan(table(spark, sf, "documents")))


@query
def op9_decontamination(spark, sf):
    return decontaminate.contamination(
        table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLE["op9_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT item_id, w, least(13, len(w)) AS k,
               unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words
        WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM doc_words, sizes WHERE len(w) >= k)),
hits AS (
  SELECT doc_id, item_id, i, k FROM doc_windows JOIN windows USING (k, words)),
n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits))
  GROUP BY doc_id),
n_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
  coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN n_hit h USING (doc_id) LEFT JOIN n_items m USING (doc_id)
"""


@query
def op10_substring_dedup(spark, sf):
    return substring_dedup.dedup(table(spark, sf, "documents"))


ORACLE["op10_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN lists USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


@query
def op11_language_id(spark, sf):
    return language_id.languages(table(spark, sf, "documents"))


@query
def op12_vector_codes(spark, sf):
    return vector_codes.product_codes(table(spark, sf, "embeddings"))


def vector_codes_sql(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """One common table expression per assignment and per codebook."""
    def assigned(i: int) -> str:
        return (f"s{i} AS MATERIALIZED (SELECT x.vec_id, x.part, min((dist(x.v, c.v), c.entry)) AS best "
                f"FROM x JOIN c{i} c USING (part) GROUP BY ALL)")

    def moved(i: int) -> str:
        sums = ", ".join(f"fdiv(sum(x.v[{j}])::BIGINT, count(*))" for j in range(1, width + 1))
        return (f"m{i} AS (SELECT part, best[2] AS entry, [{sums}] AS v FROM s{i} JOIN x USING (vec_id, part) "
                f"GROUP BY ALL), "
                f"c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v "
                f"FROM c{i} c LEFT JOIN m{i} m USING (part, entry))")
    body = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(rounds))
    # a macro can't be declared in one statement, so its text is put in
    text = f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * z::DOUBLE)::BIGINT FOR z IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, part, v[part * {width} + 1:part * {width} + {width}] AS v FROM e, range({parts}) t(part)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM x
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}),
{body}, {assigned(rounds)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code,
    sum(best[1])::BIGINT AS error FROM s{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  h AS codebooks_sha256
FROM coded JOIN e USING (vec_id), digest"""
    square = "+".join(f"(x.v[{j}] - c.v[{j}]) * (x.v[{j}] - c.v[{j}])" for j in range(1, width + 1))
    text = text.replace("dist(x.v, c.v)", square)
    return re.sub(r"fdiv\((sum\(x\.v\[\d+\]\)::BIGINT), count\(\*\)\)",
                  r"(\1 - (\1 % count(*) + count(*)) % count(*)) // count(*)", text)


ORACLE["op12_vector_codes"] = vector_codes_sql()


@query
def op13_filter_audit(spark, sf):
    return filter_audit.filter_interactions(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLE["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(w) < 200,
    'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': doc_id > min(doc_id) OVER (PARTITION BY text)} AS f
  FROM d LEFT JOIN l USING (doc_id)),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t,
    len(list_filter(map_values(f), lambda b: b)) AS n_fails FROM m GROUP BY ALL),
letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT o, step::INT AS step, o[step:step] AS c, o[1:step - 1] AS before FROM orders, range(1, 6) s(step)),
marked AS (
  SELECT part, o, step, c, n, g, t, f[c] AS fails, n_fails,
    len(list_filter(string_split(before, ''), lambda b: b != '' AND f[b])) > 0 AS gone FROM cells, steps),
counts AS (
  SELECT part, o AS filter_order, step, c,
    sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed,
    sum(n) FILTER (gone AND fails) AS redundant, sum(n) FILTER (fails AND n_fails = 1) AS unique_fails,
    sum(g) FILTER (NOT gone AND fails) AS good_lost, sum(t) FILTER (NOT gone AND fails) AS toxic_lost
  FROM marked GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, c), 0)::BIGINT AS shapley
FROM counts
"""
