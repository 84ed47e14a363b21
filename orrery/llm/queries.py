"""Queries of the operators on training data, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import p1_syntax, p2_origin, p3_split, p4_docs, p5_neighbours, p6_secrets, p7_counts, p8_pack, p9_mix, p10_level
from .common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_syntax.invalid_files(table(spark, d, "semantic_chunks"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return p1_syntax.parse_report(table(spark, d, "semantic_chunks"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return p1_syntax.parse_rates(table(spark, d, "semantic_chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_origin.not_hand_written(table(spark, d, "semantic_chunks"))


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return p2_origin.origin(table(spark, d, "semantic_chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_split.oversized(table(spark, d, "semantic_chunks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return p3_split.pieces(table(spark, d, "semantic_chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_docs.documented(table(spark, d, "symbols"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return p4_docs.pairs(table(spark, d, "symbols")).where("words > 0").select("symbol_id", "name", "kind", "signature", "doc_comment")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_neighbours.pairs(table(spark, d, "chunks"))


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    return p5_neighbours.search_every(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_secrets.found(table(spark, d, "semantic_chunks"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return p6_secrets.redacted(table(spark, d, "semantic_chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_counts.counts(table(spark, d, "raw_imports")).where("mark is not null").select("import_kind", "raw_specifier", "mark")


def p7_counts_all(spark: SparkSession, d: str) -> DataFrame:
    return p7_counts.counts(table(spark, d, "raw_imports")).select("import_kind", "raw_specifier", "uses", "files", F.round("share", 9).alias("share"), F.coalesce("mark", F.lit("")).alias("mark"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return p8_pack.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return p8_pack.report(p8_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return p9_mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return p9_mix.shares(*p9_mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_level.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "band")


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_report, p1_rates, p2_found, p2_reasons, p3_found, p3_pieces, p4_found, p4_pairs, p5_found, p5_search, p6_found, p6_redacted,
        p7_found, p7_counts_all, p8_packed, p8_report, p9_mixture, p9_shares, p10_found,
    )}


_IMPORTS = """WITH one AS (
  SELECT import_id, min(file_id) FILTER (WHERE true) AS file_id, min(lower(trim(import_kind, chr(32)||chr(9)||chr(10)||chr(13)))) AS import_kind, min(trim(raw_specifier, chr(32)||chr(9)||chr(10)||chr(13))) AS raw_specifier
  FROM raw_imports GROUP BY import_id),
ok AS (SELECT * FROM one WHERE import_kind <> '' AND raw_specifier <> '' AND file_id IS NOT NULL),
n AS (SELECT count(DISTINCT file_id) AS all_files FROM ok),
t AS (SELECT import_kind, raw_specifier, count(*) AS uses, count(DISTINCT file_id) AS files FROM ok GROUP BY ALL),
m AS (SELECT t.*, files / all_files AS share, CASE WHEN files < 3 THEN 'rare' WHEN files >= 0.05 * all_files THEN 'common' END AS mark FROM t, n) """


def oracle_sql() -> dict:
    return {
        "p3_found": "SELECT DISTINCT chunk_id FROM semantic_chunks WHERE strlen(text) > 1500",
        "p5_found": """WITH v AS (SELECT chunk_id, arg_max(vector, stored_at)::DOUBLE[] AS v FROM chunks WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0)) GROUP BY 1),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r""",
        "p7_found": _IMPORTS + "SELECT import_kind, raw_specifier, mark FROM m WHERE mark IS NOT NULL",
        "p7_counts_all": _IMPORTS + "SELECT import_kind, raw_specifier, uses, files, round(share, 9) AS share, coalesce(mark, '') AS mark FROM m",
    }
