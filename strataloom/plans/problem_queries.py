"""Queries of the general training-data problems over a data directory, with equivalent SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schema_drift
from ..operators.references import Reference, orphan_counts, orphan_rows
from ..operators.skew import outsize_keys, salted_aggregate
from ..operators.snapshots import current_rows, snapshot_changes
from ..runtime import read

REFERENCES = [
    Reference("code_functions", "module", "code_modules"),
    Reference("call_graph_nodes", "module", "code_modules"),
    Reference("call_graph_nodes", "id", "code_functions"),
    Reference("call_graph_edges", "from_id", "call_graph_nodes"),
    Reference("call_graph_edges", "to_id", "call_graph_nodes"),
]
_REFERENCE_TABLES = ["code_functions", "code_modules", "call_graph_nodes", "call_graph_edges"]

#: target field -> type, per artifact
UNIFIED = {
    "functions": {
        "id": "string", "name": "string", "file": "string", "module": "string", "language": "string", "location.start_line": "bigint", "location.end_line": "bigint",
        "metrics.cyclomatic_complexity": "bigint", "metrics.cognitive_complexity": "bigint", "metrics.halstead.vocabulary": "bigint", "metrics.halstead.length": "bigint",
        "metrics.halstead.volume": "double", "metrics.halstead.difficulty": "double", "metrics.lines_of_code": "bigint", "metrics.comment_lines": "bigint",
    },
    "modules": {
        "id": "string", "name": "string", "path": "string", "languages": "array<string>", "metrics.file_count": "bigint", "metrics.function_count": "bigint", "metrics.total_cyclomatic": "bigint",
        "metrics.avg_cyclomatic": "double", "metrics.lines_of_code": "bigint", "metrics.martin.ca": "bigint", "metrics.martin.ce": "bigint", "metrics.martin.instability": "double",
        "metrics.martin.abstractness": "double", "metrics.martin.distance_from_main_sequence": "double",
    },
    "files": {
        "id": "string", "path": "string", "module": "string", "language": "string", "metrics.function_count": "bigint", "metrics.total_cyclomatic": "bigint", "metrics.max_cyclomatic": "bigint",
        "metrics.avg_cognitive": "double", "metrics.lines_of_code": "bigint", "metrics.comment_lines": "bigint", "metrics.maintainability_index": "double",
    },
}


def _reference_tables(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    return {t: read(spark, where, t) for t in _REFERENCE_TABLES}


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return orphan_rows(_reference_tables(spark, where), REFERENCES, ["repo", "snapshot_no"], ["snapshot_no", "record_id"])


def p1_counts(spark: SparkSession, where: str) -> DataFrame:
    return orphan_counts(_reference_tables(spark, where), REFERENCES, ["repo", "snapshot_no"], ["snapshot_no"])


def p2_found(spark: SparkSession, where: str) -> DataFrame:
    each = [outsize_keys(read(spark, where, t), "module", 4, ["record_id"]).select(F.lit(t).alias("table_name"), "module") for t in ("code_functions", "call_graph_nodes")]
    return reduce(DataFrame.unionByName, each)


_TOTALS = ["cyclomatic_complexity", "cognitive_complexity", "lines_of_code"]


def p2_module_totals(spark: SparkSession, where: str) -> DataFrame:
    measures = {"n_rows": ("count", F.lit(1))} | {f"{f}_{m}": (f, F.col(f"metrics.{m}")) for m in _TOTALS for f in ("sum", "max")}
    return salted_aggregate(read(spark, where, "code_functions"), "module", measures, ["record_id"])


_HALSTEAD = ["vocabulary", "length", "volume", "difficulty", "effort", "time_to_implement", "estimated_bugs"]
#: every metric of a function: path below metrics -> type of its sum
_ALL_METRICS = {m: "BIGINT" for m in [*_TOTALS, "logical_lines", "comment_lines", "parameter_count"]} | {f"halstead.{m}": "BIGINT" if m in ("vocabulary", "length") else "DOUBLE" for m in _HALSTEAD}


def p2_module_metrics(spark: SparkSession, where: str) -> DataFrame:
    """Per table and module: row count, and totals and maxima of every metric; call graph nodes carry no metrics, theirs are null."""
    rows = {"n_rows": ("count", F.lit(1))}
    measures = rows | {f"{f}_{m.replace('.', '_')}": (f, F.col(f"metrics.{m}")) for m in _ALL_METRICS for f in ("sum", "max")}
    each = [salted_aggregate(read(spark, where, t), "module", m, ["record_id"]).withColumn("table_name", F.lit(t)) for t, m in (("code_functions", measures), ("call_graph_nodes", rows))]
    out = each[0].unionByName(each[1], allowMissingColumns=True)
    return out.select("table_name", *[c for c in out.columns if c != "table_name"])


def p3_found(spark: SparkSession, where: str) -> DataFrame:
    return schema_drift.schema_changes(read(spark, where, "raw_artifacts"))


def _p3_unified(artifact: str):
    def run(spark: SparkSession, where: str) -> DataFrame:
        return schema_drift.unified(read(spark, where, "raw_artifacts"), artifact, UNIFIED[artifact])

    return run


def p5_found(spark: SparkSession, where: str) -> DataFrame:
    functions = read(spark, where, "code_functions")
    one = snapshot_changes(functions.select("repo", "snapshot_no", "id", "seq", F.col("metrics.cyclomatic_complexity").alias("value")), "repo", "snapshot_no", "id", ["value"], "seq")
    snapshots = read(spark, where, "snapshots")
    spots = current_rows(snapshots, ["repo", "snapshot_no"], "seq", ["hotspots"]).select("repo", "snapshot_no", F.explode("hotspots").alias("h")).select("repo", "snapshot_no", "h.id", F.col("h.cyclomatic").alias("value"), F.coalesce("h.cyclomatic", F.lit(-1)).alias("seq"))
    two = snapshot_changes(spots, "repo", "snapshot_no", "id", ["value"], "seq", periods=snapshots)
    columns = ["repo", "snapshot_no", "id", "change"]
    return one.select(F.lit("code_functions").alias("table_name"), *columns).unionByName(two.select(F.lit("snapshots").alias("table_name"), *columns))


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_module_totals": p2_module_totals,
    "p2_module_metrics": p2_module_metrics,
    "p3_found": p3_found,
    "p3_functions": _p3_unified("functions"),
    "p3_modules": _p3_unified("modules"),
    "p3_files": _p3_unified("files"),
    "p5_found": p5_found,
}

_P1 = """
WITH refs AS (
  SELECT 'code_functions' AS table_name, 'module' AS field_name, repo, snapshot_no, record_id, module AS k, 'm' AS p FROM code_functions
  UNION ALL SELECT 'call_graph_nodes', 'module', repo, snapshot_no, record_id, module, 'm' FROM call_graph_nodes
  UNION ALL SELECT 'call_graph_nodes', 'id', repo, snapshot_no, record_id, id, 'f' FROM call_graph_nodes
  UNION ALL SELECT 'call_graph_edges', 'from_id', repo, snapshot_no, record_id, from_id, 'n' FROM call_graph_edges
  UNION ALL SELECT 'call_graph_edges', 'to_id', repo, snapshot_no, record_id, to_id, 'n' FROM call_graph_edges),
parents AS (
  SELECT DISTINCT 'm' AS p, repo, snapshot_no, id AS k FROM code_modules
  UNION SELECT 'f', repo, snapshot_no, id FROM code_functions
  UNION SELECT 'n', repo, snapshot_no, id FROM call_graph_nodes),
orphans AS (
  SELECT r.* FROM refs r LEFT JOIN parents q ON r.p = q.p AND r.repo = q.repo AND r.snapshot_no = q.snapshot_no AND r.k = q.k
  WHERE r.k IS NOT NULL AND q.k IS NULL)
"""

SQL = {
    "p1_found": _P1 + "SELECT table_name, field_name, snapshot_no, record_id FROM orphans",
    "p1_counts": _P1 + "SELECT table_name, field_name, snapshot_no, count(*) AS orphan_rows, count(DISTINCT (repo, k)) AS orphan_keys FROM orphans GROUP BY ALL",
    "p2_found": " UNION ALL ".join(f"SELECT '{t}' AS table_name, module FROM {t} WHERE module IS NOT NULL GROUP BY module HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM {t})" for t in ("code_functions", "call_graph_nodes")),
    "p2_module_totals": "SELECT module, count(*) AS n_rows, " + ", ".join(f"CAST({f}(metrics.{m}) AS BIGINT) AS {f}_{m}" for m in _TOTALS for f in ("sum", "max")) + " FROM code_functions GROUP BY module",
    "p2_module_metrics": "SELECT 'code_functions' AS table_name, module, count(*) AS n_rows, " + ", ".join(f"CAST({f}(metrics.{m}) AS {t}) AS {f}_{m.replace('.', '_')}" for m, t in _ALL_METRICS.items() for f in ("sum", "max")) + " FROM code_functions GROUP BY module UNION ALL BY NAME SELECT 'call_graph_nodes' AS table_name, module, count(*) AS n_rows FROM call_graph_nodes GROUP BY module",
    "p3_found": """
WITH RECURSIVE t(repo, artifact, file_no, rec, path, v) AS (
  SELECT repo, artifact, file_no, record_id, '', CAST(payload AS JSON) FROM raw_artifacts WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
  UNION ALL SELECT repo, artifact, file_no, rec, CASE WHEN path = '' THEN k ELSE path || '.' || k END, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM t WHERE json_type(v) = 'OBJECT')),
f AS (SELECT repo, artifact, file_no, rec, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE json_type(v) || CAST(v AS VARCHAR) END AS val FROM t WHERE path <> '' AND json_type(v) NOT IN ('OBJECT', 'NULL')),
ids AS (SELECT rec, val AS id FROM f WHERE path = 'id'),
ty AS (SELECT repo, artifact, file_no, path, arg_max(kind, row(n, CASE kind WHEN 'number' THEN 4 WHEN 'string' THEN 3 WHEN 'boolean' THEN 2 ELSE 1 END)) AS kind FROM (SELECT repo, artifact, file_no, path, kind, count(*) AS n FROM f WHERE path <> 'id' GROUP BY ALL) GROUP BY 1, 2, 3, 4),
fi AS (SELECT repo, artifact, file_no, lag(file_no) OVER (PARTITION BY repo, artifact ORDER BY file_no) AS prev FROM (SELECT DISTINCT repo, artifact, file_no FROM raw_artifacts)),
a AS (SELECT fi.repo, fi.artifact, fi.file_no, path, kind FROM fi JOIN ty ON ty.repo = fi.repo AND ty.artifact = fi.artifact AND ty.file_no = fi.prev),
b AS (SELECT fi.repo, fi.artifact, fi.file_no, path, kind FROM fi JOIN ty ON ty.repo = fi.repo AND ty.artifact = fi.artifact AND ty.file_no = fi.file_no WHERE prev IS NOT NULL),
gone AS (SELECT a.* FROM a ANTI JOIN b USING (repo, artifact, file_no, path)), come AS (SELECT b.* FROM b ANTI JOIN a USING (repo, artifact, file_no, path)),
old AS (SELECT DISTINCT g.repo, g.artifact, g.file_no, id, g.path, val FROM gone g JOIN fi USING (repo, artifact, file_no) JOIN f ON f.repo = g.repo AND f.artifact = g.artifact AND f.file_no = fi.prev AND f.path = g.path JOIN ids USING (rec)),
new AS (SELECT DISTINCT c.repo, c.artifact, c.file_no, id, c.path, val FROM come c JOIN f ON f.repo = c.repo AND f.artifact = c.artifact AND f.file_no = c.file_no AND f.path = c.path JOIN ids USING (rec)),
per AS (SELECT o.repo, o.artifact, o.file_no, o.path AS field_path, n.path AS new_path, o.id, bool_or(o.val = n.val) AS same FROM old o JOIN new n ON o.repo = n.repo AND o.artifact = n.artifact AND o.file_no = n.file_no AND o.id = n.id GROUP BY ALL),
mv AS (SELECT repo, artifact, file_no, field_path, new_path FROM per GROUP BY ALL HAVING 2 * count(*) FILTER (WHERE same) > count(*))
SELECT repo, artifact, file_no, 'renamed' AS change, field_path, new_path FROM mv
UNION ALL SELECT repo, artifact, file_no, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.repo = g.repo AND mv.artifact = g.artifact AND mv.file_no = g.file_no AND mv.field_path = g.path)
UNION ALL SELECT repo, artifact, file_no, 'added', path, '' FROM come c WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.repo = c.repo AND mv.artifact = c.artifact AND mv.file_no = c.file_no AND mv.new_path = c.path)
UNION ALL SELECT a.repo, a.artifact, a.file_no, 'type_changed', a.path, '' FROM a JOIN b ON a.repo = b.repo AND a.artifact = b.artifact AND a.file_no = b.file_no AND a.path = b.path WHERE a.kind <> b.kind""",
    "p5_found": """
WITH f AS (SELECT repo, snapshot_no, id, arg_max(struct_pack(v := metrics.cyclomatic_complexity), seq).v AS v FROM code_functions WHERE id IS NOT NULL GROUP BY ALL),
sn AS (SELECT repo, snapshot_no, arg_max(hotspots, seq) AS hotspots FROM snapshots GROUP BY ALL),
h AS (SELECT DISTINCT repo, snapshot_no, u.id AS id, u.cyclomatic AS v FROM (SELECT repo, snapshot_no, unnest(hotspots) AS u FROM sn) WHERE u.id IS NOT NULL),
cur AS (SELECT 'code_functions' AS t, * FROM f UNION ALL SELECT 'snapshots', * FROM h),
per AS (SELECT t, repo, snapshot_no, lead(snapshot_no) OVER (PARTITION BY t, repo ORDER BY snapshot_no) AS nxt
  FROM (SELECT DISTINCT 'code_functions' AS t, repo, snapshot_no FROM code_functions UNION SELECT DISTINCT 'snapshots', repo, snapshot_no FROM snapshots)),
a AS (SELECT cur.t, cur.repo, nxt AS at, id, v FROM cur JOIN per ON cur.t = per.t AND cur.repo = per.repo AND cur.snapshot_no = per.snapshot_no WHERE nxt IS NOT NULL),
b AS (SELECT cur.t, cur.repo, nxt AS at, id, v FROM cur JOIN per ON cur.t = per.t AND cur.repo = per.repo AND cur.snapshot_no = per.nxt)
SELECT coalesce(a.t, b.t) AS table_name, coalesce(a.repo, b.repo) AS repo, coalesce(a.at, b.at) AS snapshot_no, coalesce(a.id, b.id) AS id,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.t = b.t AND a.repo = b.repo AND a.at = b.at AND a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.v IS DISTINCT FROM b.v""",
}
