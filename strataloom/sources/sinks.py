"""Sinks: metric artifacts as JSON documents or partitioned JSON, manifests, reports, snapshots.

The document writers gather one document on the driver and refuse more than MOST_ROWS rows; the
partitioned writers take any size.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a JSON document that the driver writes.
MOST_ROWS = 200_000
SCHEMA_VERSION = "1.0.0"


def _rows(df: DataFrame, order: list[str]) -> list[dict[str, Any]]:
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), *order).orderBy(*order).limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for one document; write it partitioned")
    return rows


def _write(path: str, doc: Any) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc, indent=2) + "\n")


def write_document(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    _write(path, {"schema_version": SCHEMA_VERSION, key: _rows(df, order)})


def write_partitioned(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """One JSON record per line, compressed."""
    writer = df.write.mode("overwrite").option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_functions(functions: DataFrame, path: str) -> None:
    shaped = functions.select("id", "name", "file", "module", "language", F.struct("start_line", "end_line").alias("location"), F.struct("cyclomatic_complexity", "cognitive_complexity", "halstead", "lines_of_code", "logical_lines", "comment_lines", "parameter_count").alias("metrics"))
    write_document(shaped, path, "functions", ["id"])


def write_modules(modules: DataFrame, path: str) -> None:
    shaped = modules.select(F.col("module").alias("id"), F.element_at(F.split("module", "::"), -1).alias("name"), F.concat(F.replace(F.col("module"), F.lit("::"), F.lit("/")), F.lit("/")).alias("path"), "languages", F.struct("file_count", "function_count", "total_cyclomatic", "avg_cyclomatic", "total_cognitive", "avg_cognitive", "lines_of_code", "martin").alias("metrics"))
    write_document(shaped, path, "modules", ["id"])


def write_dependencies(modules: DataFrame, edges: DataFrame, path: str) -> None:
    nodes, lines = _rows(modules.select(F.col("module").alias("id"), F.lit("module").alias("type")), ["id"]), _rows(edges.withColumnsRenamed({"src": "from", "dst": "to"}).withColumn("type", F.lit("import")), ["from", "to"])
    _write(path, {"schema_version": SCHEMA_VERSION, "nodes": nodes, "edges": lines, "metadata": {"total_nodes": len(nodes), "total_edges": len(lines)}})


def dense(cells: DataFrame, axis: list[str], column: str) -> list[list[float]]:
    """Rows of a matrix over the axis, with 1 on the diagonal."""
    if len(axis) ** 2 > 25 * MOST_ROWS:
        raise ValueError("too many modules for a dense matrix")
    at = {m: i for i, m in enumerate(axis)}
    out = [[1.0 if i == j else 0.0 for j in range(len(axis))] for i in range(len(axis))]
    for src, dst, v in cells.where("src <> dst").select("src", "dst", column).collect():
        if src in at and dst in at:
            out[at[src]][at[dst]] = v
    return out


def write_matrix(modules: DataFrame, edges: DataFrame, path: str, weights: dict[str, float]) -> None:
    """The dense matrix of value with its components. edges: src, dst, value and a column per component."""
    axis = [r["module"] for r in _rows(modules.select("module").distinct(), ["module"])]
    doc = {"schema_version": "2.0.0", "metric": "composite", "modules": axis, "matrix": dense(edges, axis, "value"), "components": {f"{k}_coupling": {"weight": w, "matrix": dense(edges, axis, k)} for k, w in weights.items()}, "metadata": {"directional": True, "normalization": "percentile"}}
    _write(path, doc)


def write_slices(slices: DataFrame, path: str) -> None:
    write_document(slices, path, "slices", ["slice"])


def manifest(functions: DataFrame, modules: DataFrame) -> str:
    """TOML text: counts and sorted languages."""
    f = functions.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.array_sort(F.collect_set("language")).alias("languages")).first()
    names = ", ".join(json.dumps(x) for x in f["languages"])
    return f'schema_version = "{SCHEMA_VERSION}"\n\n[summary]\nfiles = {f["files"]}\nfunctions = {f["n"]}\nmodules = {modules.count()}\nlanguages = [{names}]\n'


def diff_text(diff: DataFrame, format: str = "json") -> str:
    d = json.loads(diff.select(F.to_json(F.struct(*diff.columns), {"ignoreNullFields": "false"})).first()[0])
    if format == "json":
        return json.dumps(d, indent=2)
    lines = [f"status: {d['status']}", f"functions: +{d['functions_added']} -{d['functions_removed']}"]
    return "\n".join(lines + [f"{k}: {m['base']:.1f} -> {m['target']:.1f} ({m['delta']:+.1f})" for k, m in sorted(d["metrics"].items())]) + "\n"


def diff_comment(diff: DataFrame) -> str:
    """Markdown of a diff for a review."""
    d = json.loads(diff.select(F.to_json(F.struct(*diff.columns), {"ignoreNullFields": "false"})).first()[0])
    out = [f"## Structure report: {d['status']}", "", "| metric | base | target | change |", "|---|---|---|---|"]
    out += [f"| {k} | {m['base']:.2f} | {m['target']:.2f} | {m['delta']:+.2f} |" for k, m in sorted(d["metrics"].items())]
    out += ["", "### Hotspots", *[f"- {h['id']}: {h['reason']}" for h in d["hotspots"]]] if d["hotspots"] else []
    out += ["", "### Violations", *[f"- {v['severity']}: {v['threshold']} is {v['value']:.2f}, limit {v['limit']:.2f}" for v in d["violations"]]] if d["violations"] else []
    return "\n".join(out) + "\n"


def write_rule_report(report: dict[str, DataFrame], path: str) -> None:
    _write(path, {"schema_version": SCHEMA_VERSION, "summary": _rows(report["summary"], ["total"])[0], "results": _rows(report["results"], ["rule_id"]), "violations": _rows(report["violations"], ["rule_id", "entity"]), "stale_exceptions": _rows(report["stale"], ["rule_id", "entity"])})


def write_registry(registry: DataFrame, folder: str) -> None:
    """registry.json and INDEX.md."""
    rows = _rows(registry, ["id"])
    _write(os.path.join(folder, "registry.json"), {"schema_version": SCHEMA_VERSION, "packages": rows})
    _write(os.path.join(folder, "INDEX.md"), "\n".join(["# Packages", "", "| id | name | type | version |", "|---|---|---|---|", *[f"| {r['id']} | {r['name']} | {r['package_type']} | {r['version']} |" for r in rows]]) + "\n")


def write_markers(items: DataFrame, summary: DataFrame, folder: str) -> None:
    write_document(items, os.path.join(folder, "items.json"), "items", ["file", "line"])
    write_document(summary, os.path.join(folder, "summary.json"), "summary", ["level", "key"])


def write_snapshot(summary: DataFrame, path: str, date: str) -> None:
    """Appends rows to a table partitioned by date."""
    summary.withColumn("date", F.lit(date)).write.mode("append").partitionBy("date").json(path)
