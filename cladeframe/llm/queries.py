"""Queries over the driver's tables, one per operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, infilling, kneser_ney, line_dedup, mixing, packing, postings, quality_rules, secrets, simhash, spelling, suffix_tree_lm, winnowing
from .common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_report(documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.chat_report(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(documents(spark, sf_dir))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.infilling_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_line_dedup, op3_simhash_near_dedup, op4_quality_rules, op5_document_fingerprints,
        op6_lm_scoring, op7_source_mixing, op8_quality_classifier, op9_secret_scan, op10_chat_formatting,
        op11_spelling_variants, op12_benchmark_decontamination, op13_fill_in_middle,
    )
}

ORACLES: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES["op2_line_dedup"] = rf"""
WITH docs AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i, len({_WORDS.format("ls[i + 1]")}) AS w FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM docs)
), c AS (
  SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS ends, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS starts FROM l
), runs AS (
  SELECT x.doc_id, x.i AS a, min(y.i) AS z FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.ends >= x.starts + {line_dedup.MIN_WORDS} GROUP BY ALL
  UNION
  SELECT y.doc_id, max(x.i) AS a, y.i AS z FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.starts <= y.ends - {line_dedup.MIN_WORDS} GROUP BY y.doc_id, y.i
), told AS (
  SELECT doc_id, a, z, row_number() OVER (PARTITION BY array_to_string(ls[a + 1:z + 1], chr(10)) ORDER BY doc_id, a) AS n FROM runs JOIN docs USING (doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM told WHERE n > 1
), cut AS (
  SELECT doc_id, count(*) AS n, list(i) AS g FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  CASE WHEN n IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda k: NOT list_contains(g, k)), lambda k: ls[k + 1]), chr(10)) END AS text
FROM docs LEFT JOIN cut USING (doc_id)
"""

ORACLES["op4_quality_rules"] = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), again AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, array_to_string(x, ' ') AS k, len(x) AS w FROM (SELECT doc_id, source, {_WORDS.format("lower(l)")} AS x FROM (SELECT doc_id, source, unnest(ls) AS l FROM docs))
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS n FROM docs GROUP BY source
), common AS (
  SELECT l.source, k FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, k, h.n
  HAVING count(DISTINCT doc_id) > {quality_rules.MIN_DOCS} AND count(DISTINCT doc_id) > {quality_rules.MAX_SHARE} * h.n
), gone AS (
  SELECT l.doc_id, sum(w) AS n FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.k = c.k GROUP BY l.doc_id
), told AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(g.n, 0) AS BIGINT) AS words_left
  FROM docs d LEFT JOIN again a ON d.doc_id = a.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= n_words * {quality_rules.LEAST_LEFT} AS kept
FROM told
"""

ORACLES["op7_source_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS most, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CASE k % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS lean FROM sizes
), fill(step, level, held) AS (
  SELECT 0, CAST(sum(source_size) AS DOUBLE) / sum(weight), 0 FROM w
  UNION ALL
  SELECT f.step + 1, CAST(sum(w.source_size) - sum(CASE WHEN w.most <= w.weight * f.level THEN w.most ELSE 0 END) AS DOUBLE) / sum(CASE WHEN w.most <= w.weight * f.level THEN 0 ELSE w.weight END),
    CAST(sum(CASE WHEN w.most <= w.weight * f.level THEN 1 ELSE 0 END) AS INTEGER)
  FROM fill f, w GROUP BY f.step, f.level, f.held
  HAVING sum(CASE WHEN w.most <= w.weight * f.level THEN 1 ELSE 0 END) <> f.held AND sum(CASE WHEN w.most <= w.weight * f.level THEN 0 ELSE w.weight END) > 0
), targets AS (
  SELECT source, source_size, lean, least(CAST(most AS DOUBLE), weight * (SELECT level FROM fill ORDER BY step DESC LIMIT 1)) AS target FROM w
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.lean, floor(t.target / greatest(t.source_size, 1)) AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS came
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), shares AS (
  SELECT *, least(CASE WHEN target > 0 THEN came / target ELSE 0.0 END, 1.0) AS share, greatest(0, least(size, floor(target) - whole * source_size - came)) AS part FROM placed
)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
  CASE WHEN lean = 0 THEN share ELSE 2 * share / (1 + lean + sqrt(greatest(0.0, (1 + lean) * (1 + lean) - 4 * lean * share))) END AS position
FROM shares
"""

_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES["op12_benchmark_decontamination"] = rf"""
WITH docs AS (
  SELECT doc_id, {_TERMS} AS w FROM documents
), items AS (
  SELECT item_id, w, least(len(w), {postings.WIDTH}) AS k FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TERMS} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM items)
), places AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS words FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM docs, (SELECT DISTINCT k FROM items))
), met AS (
  SELECT doc_id, s, k, item_id FROM places JOIN windows USING (k, words)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM met) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

ORACLES["op13_fill_in_middle"] = rf"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= {100 - infilling.PLAIN} THEN 'plain'
      WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < {infilling.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, least(a, b) AS u, greatest(a, b) AS v FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN u END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN v - u END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, u) || '<S>' || substring(t, v + 1) || '<M>' || substring(t, u + 1, v - u)
    ELSE '<S>' || substring(t, v + 1) || '<P>' || substring(t, 1, u) || '<M>' || substring(t, u + 1, v - u) END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""
