"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import (decontaminate, importance, jaccard, language, licenses, mixing, packing, pii, quality, rules,
               secrets, toxicity, whitening)
from .common import table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query
def op1_decontaminate(spark, sf_dir):
    """Every document against every benchmark item."""
    return decontaminate.contamination(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op2_quality(spark, sf_dir):
    return quality.score_quality(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op3_language(spark, sf_dir):
    return language.identify(_docs(spark, sf_dir))


@query
def op4_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(_docs(spark, sf_dir))


@query
def op5_licenses(spark, sf_dir):
    return licenses.find_licenses(_docs(spark, sf_dir))


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op7_secrets(spark, sf_dir):
    return secrets.secret_digest(_docs(spark, sf_dir))


@query
def op8_pii(spark, sf_dir):
    return pii.pii_digest(_docs(spark, sf_dir))


@query
def op9_mixing(spark, sf_dir):
    return mixing.mixed(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op10_rules(spark, sf_dir):
    return rules.judge(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op11_packing(spark, sf_dir):
    return packing.packed(_docs(spark, sf_dir))


@query
def op12_importance(spark, sf_dir):
    """The whole benchmark is the target."""
    return importance.resample(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, len(w) AS n, least(13, len(w)) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE item_id IS NOT NULL AND len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - m + 2)) AS s FROM i)),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS g FROM (
  SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM win))),
hits AS (SELECT doc_id, s, dw.m, item FROM dw JOIN win ON dw.m = win.m AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""


# crc32 is computed bit by bit for a table of 256 entries, then byte by byte for each word.
OP12_SQL = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS f FROM d),
words AS (
  SELECT f, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(strlen(f)), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM f UNION SELECT f FROM b), crc),
src AS (SELECT bucket, count(*) AS n FROM f JOIN words USING (f) GROUP BY bucket),
tgt AS (SELECT bucket, count(*) AS n FROM b JOIN words USING (f) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM src) AS S, (SELECT coalesce(sum(n), 0) FROM tgt) AS T),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(tgt.n, 0) + 1)::DOUBLE * (S + 10000)::DOUBLE)
                                      / ((src.n + 1)::DOUBLE * (T + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM src LEFT JOIN tgt USING (bucket), tot),
mean AS (SELECT doc_id, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight
         FROM f JOIN words USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                        / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (doc_id)),
top AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN top USING (doc_id)
"""


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
walk(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT walk.doc_id, link.b FROM walk JOIN link ON walk.node = link.a),
comp AS (SELECT doc_id, min(node) AS component_id FROM walk GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""


# rate: rules.RISK over five rules; level: rules.LEVEL over five rules, four strata and 16 cutoffs
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) > 8)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(s, s + 8)) AS p FROM (
    SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(list_distinct(w)) AS kinds, length(regexp_replace(t, '[^A-Z!]+', '', 'g')) AS loud
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         (n_words >= 50)::INT + (n_words >= 200)::INT + (n_words >= 1000)::INT AS stratum,
         greatest(1, n_words)::DOUBLE AS n, greatest(1, word_chars)::DOUBLE AS chars FROM m),
v AS (
  SELECT doc_id, stratum, base_failed, unnest([
    {'place': 1, 'rule': 'symbols', 'x': n_symbols / chars},
    {'place': 2, 'rule': 'dup_lines', 'x': n_dup_lines / greatest(1, n_lines)::DOUBLE},
    {'place': 3, 'rule': 'repeats', 'x': n_repeat_words / n},
    {'place': 4, 'rule': 'few_kinds', 'x': greatest(0::DOUBLE, 1::DOUBLE - kinds / least(n, 4::DOUBLE * sqrt(n)))},
    {'place': 5, 'rule': 'shout', 'x': loud / chars}], recursive := true) FROM f),
good AS (SELECT * FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS (
  SELECT stratum, rule, c, count(*) AS n, count(*) FILTER (x > c) AS k
  FROM good, (SELECT unnest([0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.14, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS c)
  GROUP BY stratum, rule, c),
cut AS (
  SELECT stratum, rule, min(c) AS c FROM tests
  WHERE k <= n * 0.006::DOUBLE AND list_sum(list_transform(range(0, k + 1), lambda i: exp(
    lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.006::DOUBLE) + (n - i) * ln(0.994::DOUBLE)))) <= 0.05::DOUBLE / 320
  GROUP BY stratum, rule),
broken AS (SELECT doc_id, string_agg(v.rule, ',' ORDER BY place) AS rules
           FROM v JOIN cut ON cut.stratum = v.stratum AND cut.rule = v.rule WHERE x > c GROUP BY doc_id)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS broken_rules
FROM f LEFT JOIN broken ON broken.doc_id = f.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The other operators add learned scores, rule labels, spans or pieces for which no
    SQL is given; their tests compare them with plain versions or held-out labels."""
    return {"op1_decontaminate": OP1_SQL, "op4_jaccard": OP4_SQL, "op10_rules": OP10_SQL, "op12_importance": OP12_SQL}
