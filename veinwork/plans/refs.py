"""Queries on references without a record, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinwork.operators.orphan_refs import child_keys, orphan_counts, orphan_references, parent_keys
from veinwork.session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = parent_keys(table(spark, sf_dir, "entities")).unionByName(
        parent_keys(table(spark, sf_dir, "anchor_entities"), deleted=None)
    )
    children = child_keys(table(spark, sf_dir, "relations"), "relations", ["source", "target"]).unionByName(
        child_keys(table(spark, sf_dir, "claims"), "claims", ["source"])
    )
    return orphan_references(parents, children)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("tab", "ord", "field", "kind")


def p1_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_orphans(spark, sf_dir))


_KEY = r"lower(trim(regexp_replace(replace({c}, '_', ' '), '[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{0085}}\x{{000b}}]+', ' ', 'g')))"

_SQL = f"""
WITH named AS (
  SELECT unnest(list_append(coalesce(aliases, []), name)) AS raw, loaded_at, deleted_at FROM entities
  UNION ALL
  SELECT unnest(list_append(coalesce(aliases, []), name)), loaded_at, NULL FROM anchor_entities
), parents AS (
  SELECT DISTINCT {_KEY.format(c='raw')} AS k, loaded_at AS since, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS until
  FROM named WHERE raw IS NOT NULL
), children AS (
  SELECT DISTINCT 'relations' AS tab, ord, 'source' AS field, {_KEY.format(c='source')} AS k, loaded_at, recorded_at FROM relations
  UNION ALL
  SELECT DISTINCT 'relations', ord, 'target', {_KEY.format(c='target')}, loaded_at, recorded_at FROM relations
  UNION ALL
  SELECT DISTINCT 'claims', ord, 'source', {_KEY.format(c='source')}, loaded_at, recorded_at FROM claims
), judged AS (
  SELECT c.tab, c.ord, c.field, CAST(date_trunc('month', c.recorded_at) AS DATE) AS month,
    CASE WHEN count(p.k) = 0 THEN 'missing'
         WHEN bool_or(p.since <= c.loaded_at AND c.loaded_at < p.until) THEN NULL
         WHEN min(p.since) > c.loaded_at THEN 'late' ELSE 'deleted' END AS kind
  FROM children c LEFT JOIN parents p USING (k)
  WHERE c.k <> '' GROUP BY c.tab, c.ord, c.field, c.recorded_at, c.loaded_at, c.k
)
"""

QUERIES = {"p1_found": p1_found, "p1_by_period": p1_by_period}
SQL = {
    "p1_found": _SQL + "SELECT tab, ord, field, kind FROM judged WHERE kind IS NOT NULL",
    "p1_by_period": _SQL
    + "SELECT tab, field, month, kind, count(*) AS n_refs FROM judged WHERE kind IS NOT NULL GROUP BY tab, field, month, kind",
}
