"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm import markup, mixing, names, pairs, scans, splitting, subjects, survivors, texts, tokenizer
from veinwork.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_defects(texts.section_rows(spark, sf_dir))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_pages(texts.section_rows(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_found(texts.delivered_texts(spark, sf_dir))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts of one folder and kind of file come from one source, as pages of one host
    host = F.regexp_replace("source_path", r"[^/]+(\.[^./]*)?$", "$1")
    full = table(spark, sf_dir, "parsed_documents").select("doc_id", F.lit(0).alias("sec_no"), F.col("full_text").alias("text"), host.alias("host"))
    sections = texts.section_rows(spark, sf_dir, "doc_id").select("doc_id", "sec_no", "text").join(full.select("doc_id", "host"), "doc_id", "left")
    return markup.clean_texts(sections.unionByName(full), "host")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = table(spark, sf_dir, "entities").filter("entity_type = 'agent'")
    return names.same_entity_pairs(names.name_clusters(agents))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "prompt_pairs"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    topics = p10_found(spark, sf_dir)
    return mixing.mixture(docs, table(spark, sf_dir, "mix_targets"), topics)


def p9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.dominant_records(table(spark, sf_dir, "entities"), table(spark, sf_dir, "extractors"))


def p3_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.fused_fields(table(spark, sf_dir, "entities"), table(spark, sf_dir, "extractors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(texts.delivered_texts(spark, sf_dir), ["doc_id", "sec_no"], "text")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(texts.all_texts(spark, sf_dir), ["doc_id", "sec_no"], "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_repaired, p3_found, p3_fused, p4_found, p4_clean, p5_found, p5_pieces, p6_found, p7_found, p8_ids, p9_sample, p9_shares, p10_found)
}

_KEY = r"lower(trim(regexp_replace(replace(name, '_', ' '), '\s+', ' ', 'g')))"
SQL = {
    "p3_found": rf"""
WITH live AS (
  SELECT e.ord, e.entity_type, {_KEY} AS k, coalesce(e.loaded_at, TIMESTAMP '0001-01-01') AS moment, coalesce(x.trust, 0) AS trust,
    list_unique(list_filter(list_transform(coalesce(observations, []), lambda o: trim(o, E' \t\n\r')),
      lambda o: o IS NOT NULL AND NOT list_contains({survivors.EMPTY_WORDS!r}, lower(o)) AND regexp_matches(o, '[\p{{L}}\p{{N}}]'))) AS c1,
    list_unique(list_filter(coalesce(provenance, []), lambda p: trim(p.document, E' \t\n\r') <> '')) AS c2,
    list_unique(list_filter(coalesce(code_anchors, []), lambda a: trim(a.repo, E' \t\n\r') <> '' AND trim(a.path, E' \t\n\r') <> '')) AS c3,
    CASE WHEN NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS c4
  FROM entities e LEFT JOIN extractors x USING (extracted_by) WHERE deleted_at IS NULL
), grouped AS (
  SELECT *, min(ord) OVER g AS group_ord, count(*) OVER g AS n FROM live WINDOW g AS (PARTITION BY entity_type, k)
), long AS (
  SELECT group_ord, 'observations' AS field, ord, c1 AS c, moment, trust FROM grouped WHERE n > 1 AND c1 > 0
  UNION ALL SELECT group_ord, 'provenance', ord, c2, moment, trust FROM grouped WHERE n > 1 AND c2 > 0
  UNION ALL SELECT group_ord, 'code_anchors', ord, c3, moment, trust FROM grouped WHERE n > 1 AND c3 > 0
  UNION ALL SELECT group_ord, 'confidence', ord, c4, moment, trust FROM grouped WHERE n > 1 AND c4 > 0
)
SELECT group_ord, field, ord FROM long a WHERE NOT EXISTS (
  SELECT 1 FROM long b WHERE b.group_ord = a.group_ord AND b.field = a.field AND b.ord <> a.ord
    AND NOT (a.c >= b.c AND a.moment >= b.moment AND a.trust >= b.trust AND (a.c > b.c OR a.moment > b.moment OR a.trust > b.trust)))
""",
    "p5_found": r"""
WITH texts AS (
  SELECT doc_id, 0 AS sec_no, full_text AS text FROM parsed_documents
  UNION ALL
  SELECT doc_id, sec_no, arg_max(text, length(text)) FROM sections GROUP BY doc_id, sec_no
)
SELECT doc_id, CAST(sec_no AS INTEGER) AS sec_no,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s.!?。！？\x{00a0}\x{2000}-\x{200a}\x{3000}]+'), lambda p: length(p))) > 2500
    THEN 'forced' ELSE 'natural' END AS cut
FROM texts WHERE length(text) > 2500
""",
}
