"""python -m strataloom.cli: analyses from the command line.

Exit codes: 0 success, 1 failure or errors, 2 warnings or wrong usage.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import diff, markers, packages, projectors, rules
from .sources import readers, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("strataloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataloom")
    top = p.add_subparsers(dest="group", required=True)
    t = top.add_parser("topology").add_subparsers(dest="command", required=True)
    a = t.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--output")
    a.add_argument("--language")
    a.add_argument("--profile", choices=["reference", "spec"], default="reference")
    for name in ("validate", "report"):
        t.add_parser(name).add_argument("path")
    d = t.add_parser("diff")
    d.add_argument("base")
    d.add_argument("target")
    d.add_argument("--format", choices=["json", "text"], default="text")
    c = t.add_parser("check")
    c.add_argument("base")
    c.add_argument("target")
    c.add_argument("--config")
    c.add_argument("--profile", choices=["reference", "spec"], default="reference")
    m = t.add_parser("comment")
    m.add_argument("base")
    m.add_argument("target")
    v = t.add_parser("viz")
    v.add_argument("path")
    v.add_argument("--format", choices=["mermaid", "c4", "dot", "json", "html"], default="mermaid")
    v.add_argument("--least", type=float, default=0.3)
    q = t.add_parser("query")
    q.add_argument("path")
    q.add_argument("module")
    f = top.add_parser("fitness").add_subparsers(dest="command", required=True).add_parser("validate")
    f.add_argument("path")
    f.add_argument("--config", default="fitness.toml")
    f.add_argument("--report")
    s = top.add_parser("todos").add_subparsers(dest="command", required=True).add_parser("scan")
    s.add_argument("path")
    s.add_argument("--config")
    s.add_argument("--output")
    k = top.add_parser("packages").add_subparsers(dest="command", required=True)
    for name in ("validate", "list", "registry"):
        x = k.add_parser(name)
        x.add_argument("path")
        x.add_argument("--standard-prefix", default="STD-V1")
        x.add_argument("--experiment-prefix", default="EXP-V1")
    return p


def _topology(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "analyze":
        out = a.output or os.path.join(a.path, ".topology")
        for path in api.Analysis.of_path(spark, a.path, language=a.language, profile=a.profile).write(out):
            print(path)
        return 0
    if a.command == "validate":
        gone = [x for x in api.ARTIFACTS if not os.path.exists(os.path.join(a.path, x))]
        for x in gone:
            print(f"missing: {x}")
        return int(bool(gone))
    if a.command in ("diff", "check", "comment"):
        d = api.diff_of(spark, a.base, a.target)
        if a.command == "comment":
            print(sinks.diff_comment(d))
            return 0
        if a.command == "diff":
            print(sinks.diff_text(d, a.format))
            return {"success": 0, "warning": 2, "error": 1}[d.first()["status"]]
        limits = readers.check_thresholds(a.config, a.profile)
        row = diff.check_gate(d, limits["max_cyclomatic_warning"], limits["max_cyclomatic_failure"]).first()
        print(f"errors: {row['errors']}, warnings: {row['warnings']}")
        return row["exit_code"]
    if a.command == "query":
        edges = readers.coupling_matrix(spark, os.path.join(a.path, "graphs/coupling-matrix.json")).where("value > 0 AND src <> dst")
        for r in api.coupling_of(edges, spark.createDataFrame([], "src string, dst string"), a.module).orderBy(F.col("value").desc(), "module").collect():
            print(f"{r['direction']} {r['module']} {r['value']:.3f}")
        return 0
    modules = readers.modules(spark, os.path.join(a.path, "metrics/modules.json"))
    flat = modules.select("module", "function_count", "total_cyclomatic", "total_cognitive", "lines_of_code", F.coalesce("martin.distance_from_main_sequence", F.lit(0.5)).alias("distance"), "martin")
    if a.command == "report":
        print(projectors.markdown_table(flat.drop("martin"), flat.drop("martin").columns, "module", "Modules").first()[0])
        return 0
    edges = readers.coupling_matrix(spark, os.path.join(a.path, "graphs/coupling-matrix.json")).where("src <> dst")
    if a.format == "json":
        s = projectors.scene(edges, flat, a.least)
        print(s.select(F.to_json(F.struct(*s.columns))).first()[0])
    elif a.format == "html":
        from .operators.slices import view_modules

        shown = view_modules(flat).drop("martin").orderBy("module").limit(sinks.MOST_ROWS + 1).collect()
        if len(shown) > sinks.MOST_ROWS:
            raise ValueError("too many modules for one page; write them partitioned")
        print(projectors.html("Modules", [r.asDict() for r in shown]))
    else:
        make = {"mermaid": projectors.mermaid, "c4": lambda e, m, x: projectors.c4(e, m, "context", x), "dot": projectors.dot}[a.format]
        print(make(edges, flat, a.least).first()[0])
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = _session()
    if a.group == "topology":
        return _topology(spark, a)
    if a.group == "fitness":
        config = a.config if os.path.isabs(a.config) else os.path.join(a.path, a.config)
        report = api.validate_rules(spark, a.path, config)
        if a.report:
            sinks.write_rule_report(report, a.report)
        for r in report["results"].orderBy("rule_id").collect():
            print(f"{r['status']:5} {r['rule_id']} violations {r['n_violations']} excepted {r['exceptions_used']}")
        return rules.exit_code(report["results"])
    if a.group == "todos":
        items = api.scan_markers(spark, a.path, a.config)
        if a.output:
            sinks.write_markers(items, markers.marker_summary(items), a.output)
        print(json.dumps(markers.marker_totals(items).first().asDict()))
        return 0
    layout = packages.Layout(standard_prefix=a.standard_prefix, experiment_prefix=a.experiment_prefix)
    if a.command == "validate":
        found = api.validate_packages(spark, a.path, layout)
        for r in found.orderBy("severity", "path", "code").collect():
            print(f"{r['severity']} {r['code']} {r['path'] or ''}: {r['message']}")
        return packages.diagnostic_counts(found).first()["exit_code"]
    tree = readers.package_tree(spark, a.path)
    meta = packages.metadata(tree, packages.discover(tree, layout))
    if a.command == "registry":
        sinks.write_registry(packages.registry(meta), a.path)
    for r in packages.counts_by_type(meta).orderBy("package_type").collect():
        print(f"{r['package_type']} {r['packages']}: {', '.join(r['names'])}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
