"""Package inventories: discovery in a file listing, metadata, structure diagnostics, registry.

Names of directories, files and id prefixes are a layout that can be set; the rules are joins of
expected against listed paths.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

# ---- fixed values ----
DIAGNOSTICS = "severity string, code string, message string, path string, line bigint, `column` bigint, fix_hint string"
EXIT_CODES = {"success": 0, "failure": 1, "usage": 2, "not_found": 3, "invalid": 4, "internal": 5}
REQUIRED_DIRS = {"standard": ["docs", "examples", "tests", "agents/skills", "src"], "experiment": ["docs", "examples", "tests", "agents/skills", "src"], "substandard": ["docs", "src"]}
REQUIRED_FILES = [("Cargo.toml", "MISSING_CARGO_TOML", ("standard", "experiment", "substandard")), ("src/lib.rs", "MISSING_LIB_RS", ("standard", "experiment", "substandard")), ("docs/01_spec.md", "MISSING_SPEC_DOC", ("standard", "experiment"))]
FILLED_DIRS = [("examples", "EMPTY_EXAMPLES_DIR"), ("agents/skills", "EMPTY_AGENT_SKILLS_DIR")]
METADATA = "path string, package_type string, id string, name string, slug string, version string, category string, status string, parent_id string, backwards_compat boolean, maintainers array<string>, error string"
# ---- end of fixed values ----


@dataclass(frozen=True)
class Layout:
    standards: str = "standards/v1"
    experiments: str = "standards-experimental/v1"
    standard_prefix: str = "STD-V1"
    experiment_prefix: str = "EXP-V1"


def discover(tree: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(path, package_type, metadata_path) of the directories one level below the roots that hold their metadata file; substandards lie in a substandards directory of a standard. Hidden directories are skipped."""
    files = tree.where("NOT is_dir").select("path")

    def found(pattern: str, kind: str) -> DataFrame:
        return files.select(F.regexp_extract("path", pattern, 1).alias("p"), F.col("path").alias("metadata_path")).where("p <> ''").select(F.col("p").alias("path"), F.lit(kind).alias("package_type"), "metadata_path")

    standards = found(rf"^({layout.standards}/[^./][^/]*)/standard\.toml$", "standard")
    experiments = found(rf"^({layout.experiments}/[^./][^/]*)/experiment\.toml$", "experiment")
    inner = found(rf"^({layout.standards}/[^./][^/]*/substandards/[^./][^/]*)/substandard\.toml$", "substandard")
    inner = inner.withColumn("_s", F.regexp_extract("path", r"^(.*)/substandards/", 1)).join(standards.select(F.col("path").alias("_s")), "_s", "left_semi").drop("_s")
    return standards.unionByName(experiments).unionByName(inner)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, kind, content in zip(b["path"], b["package_type"], b["content"], strict=True):
            row = dict.fromkeys(("id", "name", "slug", "version", "category", "status", "parent_id", "maintainers", "error")) | {"path": path, "package_type": kind, "backwards_compat": True}
            try:
                doc = tomllib.loads(content or "")
                own = doc[kind]
                row |= {k: own.get(k) for k in ("id", "name", "slug", "version", "category", "status", "parent_id")}
                row["backwards_compat"] = bool(own.get("backwards_compat", True))
                row["maintainers"] = doc["ownership"]["maintainers"]
                missing = [k for k in ("id", "name", "slug", "version") if not isinstance(row[k], str)]
                row["error"] = f"missing field {missing[0]}" if missing else None
            except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
                row["error"] = f"{type(e).__name__}: {e}"
            rows.append(row)
        yield pd.DataFrame(rows, dtype=object, columns=["path", "package_type", "id", "name", "slug", "version", "category", "status", "parent_id", "backwards_compat", "maintainers", "error"])


def metadata(tree: DataFrame, packages: DataFrame) -> DataFrame:
    """The parsed metadata of the packages; error says what doesn't parse."""
    content = tree.where("NOT is_dir").select(F.col("path").alias("metadata_path"), "content")
    return packages.join(content, "metadata_path").select("path", "package_type", "content").mapInPandas(_parse, METADATA)


def _diagnostic(df: DataFrame, severity: str, code: str, message: Column, path: Column, hint: str | None = None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), path.alias("path"), F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("column"), F.lit(hint).cast("string").alias("fix_hint"))


def structure_diagnostics(tree: DataFrame, packages: DataFrame) -> DataFrame:
    """Missing directories and files, empty directories, and packages without tests."""
    spark = tree.sparkSession
    listed = tree.select("path", "is_dir").unionByName(tree.where("NOT is_dir").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.lit(True).alias("is_dir"))).distinct()
    dirs = spark.createDataFrame([(k, d) for k, ds in REQUIRED_DIRS.items() for d in ds], "package_type string, dir string")
    parents = tree.where("NOT is_dir").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("full")).unionByName(tree.where("is_dir").select(F.col("path").alias("full"))).distinct()
    expected = packages.join(F.broadcast(dirs), "package_type").select("path", "package_type", "dir", F.concat_ws("/", "path", "dir").alias("full"))
    out = [_diagnostic(expected.join(parents, "full", "left_anti"), "error", "MISSING_REQUIRED_DIR", F.concat(F.lit("missing required directory: "), "dir"), F.col("full"), "create the directory")]
    for file, code, kinds in REQUIRED_FILES:
        want = packages.where(F.col("package_type").isin(*kinds)).select("path", F.concat_ws("/", "path", F.lit(file)).alias("full"))
        out.append(_diagnostic(want.join(listed.where("NOT is_dir").select(F.col("path").alias("full")), "full", "left_anti"), "error", code, F.lit(f"missing {file}"), F.col("full")))
    full = packages.where(F.col("package_type") != "substandard")
    for d, code in FILLED_DIRS:
        holders = tree.where("NOT is_dir").select(F.regexp_extract("path", rf"^(.*?)/{d}/", 1).alias("path")).where("path <> ''").distinct()
        there = parents.select(F.col("full").alias("_f"))
        want = full.select("path", F.concat_ws("/", "path", F.lit(d)).alias("_f")).join(there, "_f", "left_semi")
        out.append(_diagnostic(want.join(holders, "path", "left_anti"), "error", code, F.lit(f"{d}/ is empty"), F.col("_f")))
    tested = tree.where("NOT is_dir").select(F.when(F.contains(F.col("path"), F.lit("/tests/")), F.regexp_extract("path", r"^(.*?)/tests/", 1)).when(F.col("path").rlike(r"/src/.*\.rs$") & F.contains(F.coalesce("content", F.lit("")), F.lit("#[cfg(test)]")), F.regexp_extract("path", r"^(.*?)/src/", 1)).alias("path")).where("path IS NOT NULL").distinct()
    out.append(_diagnostic(full.select("path").join(tested, "path", "left_anti"), "error", "EMPTY_TESTS_DIR", F.lit("no test files and no inline tests"), F.concat("path", F.lit("/tests"))))
    return reduce(DataFrame.unionByName, out)


def metadata_diagnostics(meta: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Ids, versions, parents and the compatibility rule."""
    ok = meta.where("error IS NULL")
    kind = X.package_id_kind("id", layout.standard_prefix, layout.experiment_prefix)
    path, quoted = F.col("path"), lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))
    out = [_diagnostic(meta.where("error IS NOT NULL"), "error", "INVALID_METADATA", F.concat(F.lit("metadata doesn't parse: "), "error"), path, "check syntax and required fields")]
    for name in ("standard", "experiment", "substandard"):
        bad = ok.where((F.col("package_type") == name) & ~F.coalesce(kind == name, F.lit(False)))
        out.append(_diagnostic(bad, "error", f"INVALID_{name.upper()}_ID", F.concat(F.lit(f"invalid {name} id "), quoted("id")), path))
    out.append(_diagnostic(ok.where(~X.valid_version("version")), "warning", "INVALID_VERSION", F.concat(F.lit("version "), quoted("version"), F.lit(" may not be valid")), path))
    subs = ok.where("package_type = 'substandard'")
    prefix = F.split_part("id", F.lit("."), F.lit(1))
    out.append(_diagnostic(subs.where(~F.coalesce(F.col("parent_id") == prefix, F.lit(False))), "error", "INVALID_PARENT_REF", F.concat(F.lit("parent "), quoted("parent_id"), F.lit(" is not the prefix of "), quoted("id")), path))
    parents = ok.where("package_type = 'standard'").select(F.col("id").alias("parent_id"))
    out.append(_diagnostic(subs.join(parents, "parent_id", "left_anti"), "error", "PARENT_NOT_FOUND", F.concat(F.lit("no package has the id "), quoted("parent_id")), path))
    major = F.split_part("version", F.lit("."), F.lit(1)).try_cast("bigint")
    out.append(_diagnostic(ok.where(~F.col("backwards_compat") & (F.col("package_type") != "experiment") & (F.coalesce(major, F.lit(0)) == 0)), "error", "INCOMPATIBLE_WITHOUT_MAJOR", F.lit("a package that breaks compatibility needs a major version above 0"), path))
    return reduce(DataFrame.unionByName, out)


def repository_diagnostics(tree: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Layout of the roots, every package, and a summary row for packages with errors."""
    packages = discover(tree, layout)
    meta = metadata(tree, packages)
    each = structure_diagnostics(tree, packages).unionByName(metadata_diagnostics(meta, layout))
    owner = packages.select(F.col("path").alias("package"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    errors = each.where("severity = 'error' AND path IS NOT NULL").select(F.explode(above).alias("package")).join(owner, "package").groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    failed = _diagnostic(errors, "error", "PACKAGE_VALIDATION_FAILED", F.format_string("package has %d error(s)", "n"), F.col("package"))
    roots = tree.select(*[F.startswith(F.col("path"), F.lit(p + "/")).alias(k) for k, p in (("s", layout.standards), ("e", layout.experiments))]).agg(F.coalesce(F.bool_or("s"), F.lit(False)).alias("s"), F.coalesce(F.bool_or("e"), F.lit(False)).alias("e"))
    no_s = _diagnostic(roots.where("NOT s"), "error", "MISSING_STANDARDS_DIR", F.lit(f"missing directory {layout.standards}"), F.lit(layout.standards))
    no_e = _diagnostic(roots.where("NOT e"), "warning", "MISSING_EXPERIMENTAL_DIR", F.lit(f"missing directory {layout.experiments}"), F.lit(layout.experiments))
    count = _diagnostic(packages.agg(F.count(F.lit(1)).alias("n")), "info", "DISCOVERY_COMPLETE", F.format_string("found %d package(s)", "n"), F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [no_s, no_e, count, each, failed])


def find_package(meta: DataFrame, id: str, mode: str = "exact") -> DataFrame:
    """By metadata id, or with mode prefix by the name of the directory."""
    return meta.where(F.col("id") == id) if mode == "exact" else meta.where(F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(id)))


def registry(meta: DataFrame) -> DataFrame:
    """Packages sorted by id."""
    return meta.where("error IS NULL").select("id", "package_type", "name", "slug", "version", "category", "status", "parent_id", "path").orderBy("id")


def counts_by_type(meta: DataFrame) -> DataFrame:
    return meta.groupBy("package_type").agg(F.count(F.lit(1)).alias("packages"), F.array_sort(F.collect_list("name")).alias("names"))


def next_id(meta: DataFrame, prefix: str) -> DataFrame:
    """One row id: the number after the highest with the prefix, in four digits."""
    number = F.regexp_extract("id", rf"^{prefix}-(\d{{4}})$", 1)
    return meta.select(F.when(number != "", number.try_cast("int")).alias("n")).agg(F.concat(F.lit(prefix + "-"), F.lpad((F.coalesce(F.max("n"), F.lit(0)) + 1).cast("string"), 4, "0")).alias("id"))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, exit_code (1 with errors, 2 with warnings only, 0 else)."""
    n = lambda s: F.count_if(F.col("severity") == s)
    c = diagnostics.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    return c.withColumn("exit_code", F.when(F.col("errors") > 0, 1).when(F.col("warnings") > 0, 2).otherwise(0))
