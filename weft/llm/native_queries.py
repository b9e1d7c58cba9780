"""Queries of the native operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .exact_dedup import exact_groups
from .line_dedup import line_dedup
from .secret_scan import BASE, RULES, SEARCH, new_ledger, scan_secrets, span_text, update_ledger


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text_of("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = new_ledger(spark)
    update_ledger(docs, ledger)
    found = scan_secrets(docs, ledger)  # finds every pair in the ledger and scans nothing
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _op7_sql() -> str:
    parts = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        p = SEARCH.get(kind, rule.pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {rule.least} AS least, string_split_regex(x, '{p}') AS g, regexp_extract_all(x, '{p}') AS m, regexp_extract_all(x, '{p}', {rule.group}) AS v FROM t"
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
r AS ({" UNION ALL ".join(parts)}),
u AS (SELECT doc_id, kind, rank, least, unnest(m) AS mm, unnest(v) AS vv, unnest(g[1:len(m)]) AS gg, generate_subscripts(m, 1) AS i FROM r),
s AS (SELECT doc_id, kind, rank, least, vv, sum(length(gg) + length(mm)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e, length(mm) AS n FROM u),
k AS (SELECT doc_id, kind, rank, e - n AS b, kind || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM s WHERE length(vv) >= least)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY b, rank) FILTER (WHERE rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY b, rank), '') AS spans
FROM t LEFT JOIN k ON t.doc_id = k.doc_id GROUP BY t.doc_id
"""


QUERIES = {"op5_exact_dedup": op5_exact_dedup, "op6_line_dedup": op6_line_dedup, "op7_secret_scan": op7_secret_scan}
SQL = {"op5_exact_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_secret_scan": _op7_sql()}
