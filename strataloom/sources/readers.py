"""Readers: source trees, metric artifacts, configurations. Gzip is read as such by Spark."""

from __future__ import annotations

import os
import re
import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import metrics

# ---- fixed values ----
PRUNED_DIRS = ["target", "node_modules", "__pycache__", "tests", "venv"]
PRUNED_FILES = r"(_test\.rs|/test_[^/]*|_test\.py)$"
_HALSTEAD = "struct<vocabulary:bigint,length:bigint,volume:double,difficulty:double,effort:double,time_to_implement:double,estimated_bugs:double>"
FUNCTIONS = f"schema_version string, functions array<struct<id:string,name:string,file:string,module:string,language:string,line:bigint,location:struct<start_line:bigint,end_line:bigint>,metrics:struct<cyclomatic_complexity:bigint,cognitive_complexity:bigint,cyclomatic:bigint,cognitive:bigint,loc:bigint,halstead:{_HALSTEAD},lines_of_code:bigint,logical_lines:bigint,comment_lines:bigint,parameter_count:bigint>>>"
MODULES = "schema_version string, modules array<struct<id:string,name:string,path:string,languages:array<string>,metrics:struct<file_count:bigint,function_count:bigint,total_cyclomatic:bigint,avg_cyclomatic:double,total_cognitive:bigint,avg_cognitive:double,lines_of_code:bigint,martin:struct<ca:bigint,ce:bigint,instability:double,abstractness:double,distance_from_main_sequence:double>>>>"
MATRIX = "metric string, description string, modules array<string>, matrix array<array<double>>"
SNAPSHOT = "timestamp timestamp, commit_hash string, summary struct<total_files:bigint,total_functions:bigint,total_cyclomatic:bigint,avg_cyclomatic:double,total_cognitive:bigint,avg_cognitive:double,coupling_density:double>, hotspots array<struct<id:string,cyclomatic:bigint,cognitive:bigint>>"
CHECK_DEFAULTS = {"max_cyclomatic_warning": 2.0, "max_cyclomatic_failure": 5.0}
MARKER_DEFAULTS = {"tags": ["TODO", "FIXME"], "extensions": [], "exclude": [], "max_file_size": 10, "enforcement": "warn", "require_issue": []}
# ---- end of fixed values ----


def source_tree(spark: SparkSession, root: str, content: bool = True, glob: str | None = None) -> DataFrame:
    """(path, size[, content]) of the files below root that an analysis looks at; path is relative to root.

    Hidden, build, dependency and test directories and test files are left out below the root. The
    column content is not read if it isn't used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = re.escape("/" + os.path.abspath(re.sub(r"^file:/*", "/", root)).strip("/")) if "://" not in root or root.startswith("file:") else re.escape(root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{base}/", "")
    out = df.select(path.alias("path"), F.col("length").alias("size"), *([F.decode("content", "utf-8").alias("content")] if content else []))
    inner = F.concat(F.lit("/"), "path")
    return out.where(~inner.rlike(r"/\.[^/]") & ~inner.rlike("/(" + "|".join(PRUNED_DIRS) + ")/") & ~inner.rlike(PRUNED_FILES))


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, size, content) of every file below root, for marker scans."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape("/" + os.path.abspath(re.sub(r"^file:/*", "/", root)).strip("/"))
    return df.select(F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{base}/", "").alias("file"), F.col("length").alias("size"), F.decode("content", "utf-8").alias("content"))


def functions(spark: SparkSession, path: str) -> DataFrame:
    """Function rows of one or many function artifacts, in long or short metric names."""
    f = spark.read.schema(FUNCTIONS).json(path, multiLine=True).select(F.explode("functions").alias("f")).select("f.*")
    m = lambda *names: F.coalesce(*[F.col(f"metrics.{n}") for n in names])
    return f.select(
        "id", "name", "file", "module", F.coalesce("language", X.language_of("id")).alias("language"), F.coalesce("location.start_line", "line").alias("start_line"), F.col("location.end_line").alias("end_line"), m("cyclomatic_complexity", "cyclomatic").alias("cyclomatic_complexity"),
        m("cognitive_complexity", "cognitive").alias("cognitive_complexity"), m("lines_of_code", "loc").alias("lines_of_code"), F.col("metrics.logical_lines"), F.col("metrics.comment_lines"), F.col("metrics.parameter_count"), F.col("metrics.halstead"))


def modules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODULES).json(path, multiLine=True).select(F.explode("modules").alias("m")).select(F.col("m.id").alias("module"), "m.name", "m.path", "m.languages", "m.metrics.*")


def coupling_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, value); components are not read."""
    from ..operators.coupling import from_dense

    return from_dense(spark.read.schema(MATRIX).json(path, multiLine=True))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True)


def json_documents(spark: SparkSession, path: str, strip: str = "") -> DataFrame:
    """(source, doc variant) of whole JSON files; what doesn't parse is null."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_f"), "value")
    name = F.regexp_replace("_f", "^.*/", "") if not strip else F.regexp_replace(F.regexp_replace("_f", r"^file:/*", "/"), f"^{re.escape(strip.rstrip('/'))}/", "")
    return t.select(name.alias("source"), F.try_parse_json("value").alias("doc"))


def snapshot_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row of totals of a function artifact; zeros if it isn't there."""
    file = os.path.join(path, "metrics", "functions.json")
    try:
        return metrics.snapshot_totals(functions(spark, file if os.path.exists(file) else path))
    except Exception as e:  # Spark's analysis error for a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return metrics.snapshot_totals(spark.createDataFrame([], "cyclomatic_complexity bigint, cognitive_complexity bigint, lines_of_code bigint"))


def toml(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        return tomllib.load(f)


def rules_config(path: str) -> tuple[dict, list[dict]]:
    """(config, rules) of a rules file; a rule without a bound is an error."""
    from ..operators.rules import check_rules

    doc = toml(path)
    config = {"topology_dir": ".topology", "severity_default": "error"} | doc.get("config", {})
    listed = doc.get("rules", {})
    rows = listed.get("threshold", []) if isinstance(listed, dict) else listed
    rules = [{"rule_id": r["id"], "rule_name": r.get("name", r["id"]), "source": r["source"], "field": r["field"], "max": _number(r.get("max")), "min": _number(r.get("min")), "scope": r.get("scope", ""), "severity": r.get("severity"), "exclude": list(r.get("exclude", []))} for r in rows]
    if wrong := check_rules([r | {"id": r["rule_id"]} for r in rules]):
        raise ValueError("; ".join(wrong))
    return config, rules


def _number(x: Any) -> float | None:
    return None if x is None else float(x)


def exceptions_config(path: str) -> list[dict]:
    """Exception rows; a missing file is none; an empty issue is an error. The file holds a table per rule and entity."""
    if not os.path.exists(path):
        return []
    rows = []
    for rule, named in toml(path).items():
        if isinstance(named, dict):
            for entity, e in named.items():
                if not str(e.get("issue", "")).strip():
                    raise ValueError(f"{rule} {entity}: an exception needs an issue")
                rows.append({"rule_id": rule, "entity": entity, "value": _number(e.get("value")), "targets": e.get("targets"), "issue": str(e["issue"])})
    return rows


def check_thresholds(path: str | None, profile: str = "reference") -> dict[str, float]:
    """The two limits of the gate; profile reference reads line by line, where a comment after a number leaves the default."""
    out = dict(CHECK_DEFAULTS)
    if not path or not os.path.exists(path):
        return out
    if profile == "spec":
        doc = toml(path)
        for part in [doc, *[v for v in doc.values() if isinstance(v, dict)]]:
            out |= {k: float(part[k]) for k in out if isinstance(part.get(k), (int, float))}
        return out
    with open(path) as f:
        for line in f:
            for k in out:
                if line.strip().startswith(k):
                    try:
                        out[k] = float(line.split("=", 1)[1].strip())
                    except (ValueError, IndexError):
                        pass
    return out


def marker_config(path: str | None) -> dict[str, Any]:
    """The configuration of marker scans; the defaults if the file is missing or doesn't parse."""
    out = dict(MARKER_DEFAULTS)
    try:
        doc = toml(path) if path else {}
    except (OSError, tomllib.TOMLDecodeError):
        return out
    out |= {k: v for k, v in doc.get("tracker", {}).items() if k == "tags"}
    out |= {k: v for k, v in doc.get("scan", {}).items() if k in out}
    e = doc.get("enforcement", {})
    return out | {k: v for k, v in (("enforcement", e.get("level")), ("require_issue", e.get("require_issue"))) if v is not None}


def slice_config(path: str) -> dict[str, Any]:
    """A vertical-slice configuration, version 1 (root, contexts) or 2 (also architecture)."""
    import yaml

    with open(path) as f:
        doc = yaml.safe_load(f) or {}
    if wrong := check_slice_config(doc):
        raise ValueError("; ".join(wrong))
    return doc


def check_slice_config(doc: dict[str, Any]) -> list[str]:
    out = []
    if doc.get("version") not in (1, 2):
        out.append("version must be 1 or 2")
    if not doc.get("root"):
        out.append("root is required")
    if doc.get("version") == 2 and not doc.get("architecture"):
        out.append("version 2 needs an architecture")
    if not doc.get("contexts"):
        out.append("contexts must not be empty")
    return out


def workspace_members(path: str) -> list[str]:
    """The source directories of a Cargo workspace: members without globs, and the root's own."""
    doc = toml(os.path.join(path, "Cargo.toml"))
    members = [m for m in doc.get("workspace", {}).get("members", []) if "*" not in m]
    return [os.path.join(m, "src") for m in members] + (["src"] if "package" in doc else [])


def repository_root(start: str) -> str:
    """The nearest ancestor whose Cargo.toml has a workspace, else start."""
    at = os.path.abspath(start)
    while True:
        file = os.path.join(at, "Cargo.toml")
        if os.path.exists(file):
            with open(file) as f:
                if "[workspace]" in f.read():
                    return at
        if os.path.dirname(at) == at:
            return os.path.abspath(start)
        at = os.path.dirname(at)


def package_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_dir, content) of a repository; contents of metadata and Rust sources only."""
    files = all_files(spark, root)
    return files.select(F.col("file").alias("path"), F.lit(False).alias("is_dir"), F.when(F.col("file").rlike(r"\.(toml|rs)$"), F.col("content")).alias("content"))


def diff_documents(spark: SparkSession, path: str) -> DataFrame:
    """(status, avg_cyclomatic_delta, errors, warnings) of diff files, read leniently: what is missing is 0 or null."""
    doc = json_documents(spark, path)
    severities = F.try_variant_get("doc", "$.violations", "array<struct<severity:string>>")
    n = lambda s: F.coalesce(F.size(F.filter(severities, lambda v: v["severity"] == s)), F.lit(0))
    return doc.select("source", F.try_variant_get("doc", "$.status", "string").alias("status"), F.coalesce(X.number_at(F.col("doc"), "metrics.avg_cyclomatic.delta"), F.lit(0.0)).alias("avg_cyclomatic_delta"), n("ERROR").alias("errors"), n("WARNING").alias("warnings"))
