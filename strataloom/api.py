"""Whole analyses over DataFrames: from source files to metrics, coupling, slices and reports."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import coupling, diff, markers, metrics, packages, projectors, rules, slices
from .operators.extract import parse_files, tables
from .runtime import materialize
from .sources import readers, sinks

ARTIFACTS = ["manifest.toml", "metrics/functions.json", "metrics/modules.json", "graphs/dependencies.json", "graphs/coupling-matrix.json", "metrics/slices.json"]


@dataclass
class Analysis:
    """An analysis of source files (path relative to the root, content).

    profile reference resolves imports by substring tests; spec by the longest prefix, with relative
    Python imports as internal ones.
    """

    spark: SparkSession
    files: DataFrame
    language: str | None = None
    profile: str = "reference"
    isolated_instability: float = 0.5
    weights: dict[str, float] = field(default_factory=lambda: dict(coupling.WEIGHTS))

    @classmethod
    def of_path(cls, spark: SparkSession, root: str, **options) -> Analysis:
        return cls(spark, readers.source_tree(spark, root), **options)

    @cached_property
    def parsed(self) -> DataFrame:
        """The result of the one Python pass, written to the shared folder."""
        return materialize(parse_files(self.files, only=self.language), "parsed")

    @cached_property
    def extracted(self) -> dict[str, DataFrame]:
        return tables(self.parsed)

    @cached_property
    def functions(self) -> DataFrame:
        return materialize(self.extracted["functions"], "functions")

    @cached_property
    def resolved(self) -> DataFrame:
        return coupling.resolve_imports(self.extracted["imports"], self.functions, self.profile)

    @cached_property
    def modules(self) -> DataFrame:
        base = metrics.module_metrics(self.functions)
        types = metrics.type_counts(self.extracted["types"].join(self.parsed.where("language = 'python'").select("module").distinct(), "module", "left_semi") if self.profile == "reference" else self.extracted["types"])
        return materialize(coupling.martin_metrics(base, self.resolved, types, self.isolated_instability), "modules")

    @cached_property
    def edges(self) -> DataFrame:
        """(src, dst, import, call, type, composite, value)."""
        calls = coupling.resolve_calls(self.extracted["calls"], self.functions).withColumnRenamed("calls", "value")
        qualified = self.functions.select("module", F.col("id").alias("qualified_name"))
        types = self.extracted["types"].join(self.modules.select("module"), "module", "left_semi")
        parts = {"import": coupling.import_coupling(self.resolved), "call": calls, "type": coupling.resolve_types(qualified, types).withColumnRenamed("types", "value")}
        c = materialize(coupling.composite(parts, self.weights, self.modules).withColumn("_rank", F.round("composite", 12)), "composite")
        return materialize(coupling.percentile_normalise(c, "_rank").drop("_rank"), "edges")

    @cached_property
    def slices(self) -> DataFrame:
        pairs, known = slices.module_slices(self.resolved, self.modules)
        return slices.slice_independence(pairs, known)

    @cached_property
    def view(self) -> DataFrame:
        return slices.view_modules(self.modules)

    def write(self, folder: str) -> list[str]:
        """Writes the artifacts of ARTIFACTS; returns their paths."""
        at = lambda name: os.path.join(folder, name)
        sinks._write(at("manifest.toml"), sinks.manifest(self.functions, self.modules))
        sinks.write_functions(self.functions, at("metrics/functions.json"))
        sinks.write_modules(self.modules, at("metrics/modules.json"))
        sinks.write_dependencies(self.modules, coupling.dependency_edges(self.resolved, nested=True), at("graphs/dependencies.json"))
        sinks.write_matrix(self.modules, self.edges, at("graphs/coupling-matrix.json"), self.weights)
        sinks.write_slices(self.slices, at("metrics/slices.json"))
        return [at(a) for a in ARTIFACTS]

    def totals(self) -> DataFrame:
        return metrics.snapshot_totals(self.functions)

    def report(self) -> DataFrame:
        """One row text: the module table in Markdown."""
        m = self.modules.select("module", "function_count", "total_cyclomatic", "avg_cyclomatic", "total_cognitive", "lines_of_code", F.col("martin.instability").alias("instability"), F.col("martin.distance_from_main_sequence").alias("distance"))
        return projectors.markdown_table(m, m.columns, "module", "Modules")


def diff_of(spark: SparkSession, base: str, target: str) -> DataFrame:
    """snapshot_diff of two artifact folders."""
    return diff.snapshot_diff(readers.snapshot_metrics(spark, base), readers.snapshot_metrics(spark, target))


def validate_rules(spark: SparkSession, root: str, config: str) -> dict[str, DataFrame]:
    """The rule report of an artifact folder below root, by a rules file."""
    options, listed = readers.rules_config(config)
    excused = readers.exceptions_config(os.path.join(os.path.dirname(config), options.get("exceptions", "fitness-exceptions.toml")))
    folder = os.path.join(root, options["topology_dir"])
    there = [s for s in dict.fromkeys(r["source"] for r in listed) if os.path.exists(os.path.join(folder, s))]
    parts = []
    for s in there:
        own = [r for r in listed if r["source"] == s]
        doc = readers.json_documents(spark, os.path.join(folder, s)).withColumn("source", F.lit(s))
        for scope in dict.fromkeys(r["scope"] for r in own):
            parts.append(rules.field_values(rules.entities(doc, scope), [r for r in own if r["scope"] == scope]))
    values = spark.createDataFrame([], "rule_id string, entity string, actual double")
    for p in parts:
        values = values.unionByName(p)
    return rules.evaluate(materialize(values, "rule-values"), rules.rules_table(spark, listed), rules.exceptions_table(spark, excused), spark.createDataFrame([(s,) for s in there], "source string"), options["severity_default"])


def scan_markers(spark: SparkSession, root: str, config: str | None = None) -> DataFrame:
    """Marker items of the files below root."""
    c = readers.marker_config(config)
    files = markers.scan_files(readers.all_files(spark, root), c["extensions"], c["exclude"], c["max_file_size"])
    return markers.marker_items(markers.lines_of(files), tuple(c["tags"]))


def validate_packages(spark: SparkSession, root: str, layout: packages.Layout = packages.Layout()) -> DataFrame:
    return packages.repository_diagnostics(materialize(readers.package_tree(spark, root), "tree"), layout)


def coupling_of(edges: DataFrame, imports: DataFrame, module: str) -> DataFrame:
    """(direction, module, value, imports): neighbours of a module with coupling and number of imports."""
    from .operators.graph import neighbours

    n = imports.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("imports"))
    both = edges.select("src", "dst", "value").join(n, ["src", "dst"], "left").withColumn("weight", F.struct("value", F.coalesce("imports", F.lit(0)).alias("imports")))
    return neighbours(both, module).select("direction", "module", "weight.*")


def risk_of(functions: DataFrame) -> DataFrame:
    return functions.withColumns({"risk": X.risk_band("cyclomatic_complexity"), "cognitive_risk": X.risk_band("cognitive_complexity", "cognitive")})
