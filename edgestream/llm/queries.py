"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    hard_negatives,
    jaccard_join,
    language_id,
    license_scan,
    mixing,
    quality_rules,
    suffix_dedup,
    token_counts,
    token_shards,
    toxicity,
    url_filters,
    vector_codes,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).drop("node", "class_node")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_shards(table(spark, sf_dir, "documents"))[0]


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages")).drop("pattern")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("n_removed")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_language_id": op2_language_id,
        "op3_mixing": op3_mixing,
        "op4_decontamination": op4_decontamination,
        "op5_token_shards": op5_token_shards,
        "op6_license_scan": op6_license_scan,
        "op7_url_filters": op7_url_filters,
        "op8_quality_rules": op8_quality_rules,
        "op9_toxicity": op9_toxicity,
        "op10_token_counts": op10_token_counts,
        "op11_vector_codes": op11_vector_codes,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": pipeline,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n,
         array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT DISTINCT p.doc_id, p.p, p.n, x.item FROM places p JOIN windows x ON p.n = x.n AND p.phrase = x.phrase),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_AFTER = "regexp_extract(url, '(?s)^.*?://(.*)$', 1)"


def _op7() -> str:
    literal = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    hosts = sorted(url_filters.HOST_RULES, key=lambda r: -len(r.label))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.label}'" for r in hosts)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in hosts)
    method = " ".join(f"WHEN host <> '' AND regexp_matches({_LOWER.replace('text', 'url')}, {literal(p.pattern)}) THEN '{p.verdict}'" for p in url_filters.PATTERN_RULES)
    return f"""
WITH p AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract({_AFTER}, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract({_AFTER}, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {method} ELSE 'allow' END AS verdict FROM p
"""


_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
grams AS (SELECT rid, p, array_to_string(list_slice(w, p, p + 7), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
again AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY 1),
lines AS (SELECT rid, source, line, regexp_extract_all({_LOWER.replace("coalesce(text, '')", 'line')}, '[^\\x20\\x09-\\x0D]+') AS lw
          FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, line, count(*) AS c FROM lines WHERE len(lw) > 0 GROUP BY 1, 2) GROUP BY 1),
normal AS (SELECT rid, source, array_to_string(lw, ' ') AS line, sum(len(lw)) AS words FROM lines WHERE len(lw) > 0 GROUP BY ALL),
texts AS (SELECT source, min(rid) AS rid FROM d GROUP BY source, text),
hosts AS (SELECT source AS host, count(*) AS n FROM texts GROUP BY 1),
counted AS (SELECT normal.source, line, count(*) AS c FROM normal JOIN texts USING (rid) GROUP BY ALL),
common AS (SELECT counted.source, line FROM counted JOIN hosts ON counted.source IS NOT DISTINCT FROM hosts.host
           WHERE c > {quality_rules.LEAST_LINE_DOCUMENTS} AND 100 * c > {quality_rules.LINE_PERCENT} * n),
gone AS (SELECT rid, sum(words) AS n FROM normal JOIN common ON normal.source IS NOT DISTINCT FROM common.source AND normal.line = common.line GROUP BY 1),
base AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS n_gone
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN again USING (rid) LEFT JOIN gone USING (rid)),
failed AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_gone >= {quality_rules.MIN_WORDS} AND 100 * (n_words - n_gone) >= {quality_rules.MIN_KEPT_PERCENT} * n_words AS kept
FROM failed
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11() -> str:
    """Squared distances as x.x - 2 x.e + e.e: all sums are integers below 2^53. Rounds are unrolled."""
    n, rounds = vector_codes.ENTRIES, vector_codes.ROUNDS
    out = [
        f"""
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)) AS q FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (
  SELECT vec_id, part, list_slice(q, part * w + 1, part * w + w) AS x
  FROM (SELECT vec_id, q, len(q) // {vector_codes.PARTS} AS w, unnest(range({vector_codes.PARTS})) AS part FROM v)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p QUALIFY entry < {n})"""
    ]
    for r in range(rounds + 1):
        out.append(
            f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p.part, any_value(x) AS x, arg_min(entry, d * {n} + entry) AS entry, min(d) AS d
  FROM (SELECT vec_id, p.part, x, entry, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e) AS BIGINT) AS d
        FROM p JOIN b{r} ON p.part = b{r}.part) AS p GROUP BY vec_id, p.part)"""
        )
        if r < rounds:
            out.append(
                f"""
m{r} AS (
  SELECT part, entry, list(f ORDER BY k) AS e FROM (
    SELECT part, entry, k, CAST(floor(sum(c) / count(*)) AS DOUBLE) AS f
    FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS k FROM a{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (part, entry))"""
            )
    return f"""
WITH {",".join(out)},
books AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256
          FROM (SELECT part, entry, unnest(e) AS c, unnest(range(len(e))) AS k FROM b{rounds})),
coded AS (SELECT vec_id, string_agg(lower(format('{{:02x}}', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books
"""


_BYTES = "lower(hex(encode(coalesce(text, ''))))"
_WIDE = 2 * suffix_dedup.LENGTH

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_BYTES} AS b FROM documents),
places AS (SELECT rid, s, md5(substring(b, 2 * s + 1, {_WIDE})) AS w FROM (SELECT rid, b, unnest(range(length(b) // 2 - {suffix_dedup.LENGTH - 1})) AS s FROM d WHERE length(b) >= {_WIDE})),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY w) AS n FROM places) WHERE n > 1),
islands AS (
  SELECT rid, min(s) AS a, max(s) + {suffix_dedup.LENGTH} AS z
  FROM (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS island
        FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS new FROM twice))
  GROUP BY rid, island),
kept AS (
  SELECT rid, string_agg(substring(b, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM (
    SELECT rid, z AS f, lead(a, 1, 1000000000) OVER (PARTITION BY rid ORDER BY a) AS t FROM islands
    UNION ALL SELECT rid, 0, min(a) FROM islands GROUP BY rid) JOIN d USING (rid) GROUP BY rid),
gone AS (SELECT rid, sum(z - a) AS n, count(*) AS spans FROM islands GROUP BY rid)
SELECT doc_id, CAST(length(b) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, b))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN gone USING (rid)
"""

_OP13 = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {hard_negatives.MOVED_EVERY} = 0 THEN (label + 1) % {hard_negatives.LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS r ON a.vec_id <> r.vec_id WHERE a.vec_id % {hard_negatives.ANCHOR_EVERY} = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives AS p JOIN scores AS s ON p.anchor_id = s.anchor_id
WHERE NOT same AND {hard_negatives.LEAST} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.MOST} * positive_score
QUALIFY rank <= {hard_negatives.NEGATIVES}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": _OP4,
        "op7_url_filters": _op7(),
        "op8_quality_rules": _OP8,
        "op11_vector_codes": _op11(),
        "op12_suffix_dedup": _OP12,
        "op13_hard_negatives": _OP13,
    }
