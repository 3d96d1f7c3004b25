"""Problem 5: what the next run must process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators.incremental import pending
from vellum.runtime import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "documents_md").select("doc_id", "file_hash")
    manifest = table(spark, d, "manifest").select("doc_id", "file_hash", "ingested_at", "run_id")
    return pending(listing, manifest, table(spark, d, "ingest_runs")).select("doc_id", "status")


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
WITH now AS (
  SELECT doc_id, max(nullif(lower(trim(file_hash)), '')) AS h FROM documents_md WHERE doc_id IS NOT NULL GROUP BY doc_id),
entries AS (
  SELECT m.doc_id, nullif(lower(trim(m.file_hash)), '') AS h,
         row_number() OVER (PARTITION BY m.doc_id ORDER BY m.run_id DESC, m.ingested_at DESC NULLS LAST,
                            nullif(lower(trim(m.file_hash)), '') DESC NULLS LAST) AS n
  FROM manifest m WHERE m.run_id IN (SELECT run_id FROM ingest_runs WHERE lower(trim(status)) = 'succeeded'))
SELECT now.doc_id, CASE WHEN e.doc_id IS NULL THEN 'new' ELSE 'changed' END AS status
FROM now LEFT JOIN (SELECT * FROM entries WHERE n = 1) e ON e.doc_id = now.doc_id
WHERE e.doc_id IS NULL OR now.h IS NULL OR e.h IS NULL OR now.h <> e.h""",
}
