import itertools
import json
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataloom import api, cli
from strataloom.functions import expressions as X
from strataloom.operators import coupling, diff, graph, markers, metrics, packages, projectors, rules, slices
from strataloom.operators.extract import default_registry, extract_sources, parse_files, register_configured
from strataloom.plans import code_queries
from strataloom.sources import readers, sinks
from strataloom.streaming import changed_files, retained, stream_counts, stream_files

from .conftest import rows

SNIPPETS = [
    ("pkg/a.py", "import os\nfrom abc import ABC\nfrom .util import x, y\n\nclass Base(ABC):\n    pass\n\ndef top(n):\n    # note\n    if n > 1 and n < 5:\n        for i in range(n):\n            print(i)\n    else:\n        return x(n)\n    return [v for v in y if v]\n"),
    ("pkg/__init__.py", "from pkg.a import *\n"),
    ("src/lib.rs", "use crate::model::{Item, Kind};\n\n// TODO(#4): more\npub fn run(n: u32) -> u32 {\n    if n > 3 && n < 9 {\n        helper(n)?\n    } else {\n        match n { 1 => 2, _ => 3 }\n    }\n}\n\nfn helper(n: u32) -> u32 { n }\n"),
    ("web/index.ts", "import { a, b } from './lib';\nexport function go(x: number) {\n  for (const i of [1, 2]) {\n    if (i > x || x < 0) { a(i); }\n  }\n  return x ? b(x) : 0;\n}\nconst pick = (v: string) => v;\n"),
]

def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


# -- expressions


@pytest.mark.parametrize(
    ("language", "path", "module"),
    [
        ("rust", "crates/my-cli/src/main.rs", "crates::my_cli"), ("rust", "src/lib.rs", "crate"), ("rust", "lib.rs", "crate"), ("rust", "crates/a/src/x/mod.rs", "crates::a::x"), ("rust", "crates/a-b/src/x/y.rs", "crates::a-b::x::y"),
        ("python", "pkg/sub/__init__.py", "pkg.sub"), ("python", "pkg/__main__.py", "pkg"), ("python", "pkg/a.b.py", "pkg.a.b"), ("typescript", "web/app/index.ts", "web/app"), ("tsx", "web/app/[[...slug]]/page.tsx", "web/app/[[...slug]]/page"),
    ],
)
def test_module_paths(spark, language, path, module):
    assert one(spark, X.module_path("p", language), p=path) == module


def test_slices_layers_and_names(spark):
    assert one(spark, X.slice_id("m"), m="a.b.c") == "a.b" and one(spark, X.slice_id("m"), m="crates::x::y") == "crates::x" and one(spark, X.slice_id("m"), m="app/[[...s]]/p") == "app/[[...s]]" and one(spark, X.slice_id("m"), m="solo") == "solo"
    assert one(spark, X.slice_view("m"), m="crates::x::y") == "x" and one(spark, X.slice_view("m", {"exp": 3}), m="exp::v1::name::z") == "name"
    layers = {"src/http/Client.py": "handlers", "src/UserService.py": "services", "x/entity.rs": "models", "x/storage.rs": "data", "x/helper.rs": "utils", "x/lexer.rs": "adapters", "examples/q.rs": "examples", "test_q": "tests", "src/q": "core", "q": "other"}
    assert {k: one(spark, X.layer_of("p"), p=k) for k in layers} == layers
    assert one(spark, X.language_of("i"), i="rust:a::b") == "rust" and one(spark, X.short_name("i"), i="a::b::c") == "c" and one(spark, X.directory_of("i"), i="a::b") == "a/b/"
    context, layer = X.context_and_layer("m", "src.app")
    for m, want in {"x.src.app.orders.domain.aggregate_order.y": ("orders", "aggregates"), "src.app.users.ports": ("users", "ports"), "src.apple.users": (None, None)}.items():
        assert (one(spark, context, m=m), one(spark, layer, m=m)) == want
    assert one(spark, X.contains_path("m", "src/app"), m="a.src.app.b") and not one(spark, X.contains_path("m", "src/app"), m="a.src.apple.b")
    assert one(spark, X.crate_module_path("p", "k"), p="crates/k/src/a/mod.rs") == "k::a" and one(spark, X.crate_module_path("p", "k"), p="src/lib.rs") == "k"


def test_halstead_and_martin(spark):
    h = one(spark, X.halstead("a", "b", "c", "d"), a=10, b=20, c=50, d=100)
    assert (h["vocabulary"], h["length"]) == (30, 150) and math.isclose(h["volume"], 150 * math.log2(30)) and h["difficulty"] == 25 and math.isclose(h["effort"], 25 * h["volume"])
    assert tuple(one(spark, X.halstead("a", "b", "c", "d"), a=0, b=0, c=0, d=0)) == (0, 0, 0, 0, 0, 0, 0)
    m = one(spark, X.martin("a", "b", "c", "d"), a=5, b=5, c=10, d=5)
    assert m["instability"] == 0.5 and m["abstractness"] == 0.5 and m["distance_from_main_sequence"] == 0
    assert one(spark, X.martin("a", "b", "c", "d"), a=0, b=0, c=0, d=0)["instability"] == 0.5 and one(spark, X.martin("a", "b", "c", "d", 0.0), a=9, b=0, c=1, d=0)["distance_from_main_sequence"] == 1


def test_health_edges(spark):
    h = lambda f, cc, cog, loc, k, v="module": one(spark, X.health("f", "cc", "cog", "loc", "k", v), f=f, cc=cc, cog=cog, loc=loc, k=k)
    assert h(10, 50, 0, 500, 20) == 1.0 and math.isclose(h(0, 0, 0, 0, 0), (1 + 1 + 1 + 0.6 + 0.5) / 5)
    assert math.isclose(h(10, 50, 0, 500, 21), (4 + 1 - 11 / 30) / 5) and math.isclose(h(51, 0, 0, 0, 5), (4 + 1 - 21 / 70) / 5) and math.isclose(h(1, 40, 90, 500, 100), (0 + 0 + 0 + 0.2 + 0.5) / 5)
    assert 0 <= h(40, 10, 10, 10, 3, "city") <= 1
    assert [one(spark, X.health_label("x"), x=x) for x in (0.8, 0.79, 0.5, 0.36, 0.2, 0.1)] == ["Excellent", "Good", "OK", "Warning", "Poor", "Critical"]
    assert [one(spark, X.risk_band("x"), x=x) for x in (10, 11, 20, 21, 50, 51)] == ["low", "moderate", "moderate", "high", "high", "very_high"]


def test_imports(spark):
    assert [one(spark, X.is_external("p"), p=p) for p in ("./x", "crate::a", "self::a", "super::b", "serde", "os.path")] == [False, False, False, False, True, True]
    assert [one(spark, X.import_kind("w", "n"), w=w, n=n) for w, n in ((True, 5), (False, 2), (False, 1), (False, 0))] == ["wildcard", "multi", "single", "module"]
    assert math.isclose(one(spark, X.import_score("k", "n"), k="multi", n=3), 2.1) and one(spark, X.import_score("k", "n"), k="multi", n=9) == 3.0 and one(spark, X.import_score("k", "n"), k="module", n=0) == 0.5


def test_globs_versions_and_texts(spark):
    g = lambda p, s: one(spark, X.matches_any_glob("s", [p]), s=s)
    assert g("*.rs", "a/b.rs") and g("**/tests/**", "x/tests/y") and g("**/t*", "t1") and not g("a?c", "abbc") and g("[!a]b", "cb") and not g("[", "[") and not g("a**b", "ab")
    assert one(spark, X.matches_loose_glob("s", "build/**"), s="x/rebuild.rs") and not one(spark, X.matches_loose_glob("s", "*.md"), s="a.rs")
    assert [one(spark, X.bump_version("v", p), v="1.2") for p in ("major", "minor", "patch")] == ["2.0.0", "1.3.0", "1.2.1"] and one(spark, X.valid_version("v"), v="1.2") and not one(spark, X.valid_version("v", "3"), v="1.2") and one(spark, X.parse_version("v"), v="1.x.3") is None
    assert [one(spark, X.package_id_kind("i"), i=i) for i in ("STD-V1-0001", "EXP-V1-0001", "STD-V1-0001.AB01", "STD-V1-1")] == ["standard", "experiment", "substandard", None]
    assert one(spark, X.signed("x"), x=2.25) in ("+2.2", "+2.3") and one(spark, X.percent_int("x"), x=0.299) == 29 and one(spark, X.diagram_id("s"), s="a::b-c.d/e") == "a_b_c_d_e"
    n = lambda doc, path: spark.sql(f"SELECT try_parse_json('{doc}') AS d").select(X.number_at(F.col("d"), path)).first()[0]
    assert n('{"a":{"b":4}}', "a.b") == 4 and n('{"a":{"b":"4"}}', "a.b") is None and n('{"a":1.5}', "a") == 1.5 and n('{"a":true}', "a") is None and n('{"x":1}', "a") is None


def test_line_counts(spark):
    c = one(spark, X.line_counts("t"), t='/* a\n b */\nx = 1\n\n# c\n"""d"""\ny\n')
    assert tuple(c) == (7, 2, 4, 1)
    assert tuple(one(spark, X.line_counts("t"), t="")) == (0, 0, 0, 0)


# -- metrics, coupling, slices


def test_module_and_file_metrics(spark):
    f = spark.createDataFrame([("m", "f1", "py", 3, 1, 10, 1, 20.0), ("m", "f1", "py", 5, 2, 20, 0, 40.0), ("m", "f2", "rs", None, None, None, None, None), ("n", "f3", "rs", 1, 0, 2, 0, 1.0)], "module string, file string, language string, cyclomatic_complexity bigint, cognitive_complexity bigint, lines_of_code bigint, comment_lines bigint, volume double")
    m = {r["module"]: r for r in metrics.module_metrics(f).collect()}
    assert (m["m"]["function_count"], m["m"]["file_count"], m["m"]["total_cyclomatic"], m["m"]["lines_of_code"], m["m"]["languages"]) == (3, 2, 8, 30, ["py", "rs"]) and math.isclose(m["m"]["avg_cyclomatic"], 8 / 3)
    fm = {r["file"]: r for r in metrics.file_metrics(f).collect()}
    assert fm["f1"]["max_cyclomatic"] == 5 and math.isclose(fm["f1"]["maintainability_index"], (171 - 5.2 * math.log(30) - 0.23 * 4 - 16.2 * math.log(15)) * 100 / 171)
    assert tuple(metrics.snapshot_totals(f.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)
    assert one(spark, metrics.coupling_density("n", "e"), n=4, e=3) == 0.5 and one(spark, metrics.coupling_density("n", "e"), n=1, e=0) == 0
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "a")], "commit bigint, file string")
    assert rows(metrics.change_coupling(c)) == [("a", "b", 2, 1.0)]


def test_change_coupling_counts_large_commits(spark):
    commits = {1: [f"f{i:03}" for i in range(250)], 2: ["f000", "f001", "g"], 3: ["g", "h"], 4: ["f001"], 5: ["f249", "g"]}
    c = spark.createDataFrame([(k, f) for k, files in commits.items() for f in files] + [(1, "f000"), (None, "g"), (None, "h"), (3, None)], "commit bigint, file string")
    n = Counter(f for files in commits.values() for f in files)
    pairs = Counter(p for files in commits.values() for p in itertools.combinations(sorted(files), 2))
    want = {(a, b): (k, k / min(n[a], n[b])) for (a, b), k in pairs.items()}
    assert want[("f002", "f100")] == (1, 1.0) and want[("f249", "g")] == (1, 0.5)
    for d in (metrics.change_coupling(c), metrics.change_coupling(c, 7), metrics.change_coupling(c, 1000)):
        got = d.collect()
        assert len(got) == len(want) and {(r["file_a"], r["file_b"]): (r["together"], r["coupling"]) for r in got} == want


def test_resolving_imports_calls_and_types(spark):
    mods = spark.createDataFrame([("crate::model",), ("crate::api",), ("util",)], "module string")
    imports = spark.createDataFrame([("crate::api", "crate::model::Item", False), ("crate::model", "crate::model", False), ("util", "serde", True), ("crate::api", "super::util", False)], "from_module string, import_path string, is_external boolean")
    got = {(r["src"], r["dst"], r["import_path"]) for r in coupling.resolve_imports(imports, mods).collect()}
    assert got == {("crate::api", "crate::model", "crate::model::Item"), ("crate::model", "crate::api", "crate::model"), ("crate::api", "util", "super::util")}
    spec = {(r["src"], r["dst"]) for r in coupling.resolve_imports(imports.where("from_module <> 'crate::model'"), mods.withColumn("module", F.regexp_replace("module", "crate::", "")).withColumn("module", F.col("module")), "spec").collect()}
    assert spec == {("crate::api", "model"), ("crate::api", "util")}
    calls = spark.createDataFrame([("crate::api", "model"), ("crate::api", "model"), ("util", "util::x"), ("util", "crate::model::f"), ("util", "zzz")], "caller string, callee string")
    assert rows(coupling.resolve_calls(calls, mods)) == [("crate::api", "crate::model", 2), ("util", "crate::model", 1)]
    fn = spark.createDataFrame([("util", "rust:util::make_Item"), ("crate::model", "rust:crate::model::Item"), ("crate::api", "x")], "module string, qualified_name string")
    types = spark.createDataFrame([("Item", "crate::model", False), ("Item", "z", True)], "name string, module string, is_abstract boolean")
    assert rows(coupling.resolve_types(fn, types)) == [("util", "crate::model", 1)]
    assert rows(metrics.type_counts(types)) == [("crate::model", 1, 0), ("z", 1, 1)]


def test_import_counts_equal_resolved_imports(spark):
    mods = spark.createDataFrame([(m,) for m in ("crate::model", "crate::api", "util", "größe::model", "a/model", "", "x::", None, "util")], "module string")
    cells = [("crate::api", "crate::model::Item", False), ("crate::api", "crate::model::Item", False), ("crate::model", "crate::model", False), ("util", "serde", True), ("crate::api", "super::util", False), ("z", "größe", False), ("z", "model", False), ("z", "nothing", False), ("z", "", False), ("", "a/model", False), (None, "util", False), ("z", None, False)]
    imports = spark.createDataFrame(cells, "from_module string, import_path string, is_external boolean")
    want = rows(coupling.resolve_imports(imports, mods).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("imports")))
    assert ("crate::api", "crate::model", 2) in want and ("z", "größe::model", 3) in want and ("z", "", 4) in want
    for limit in (16 << 20, 250):  # one block; some blocks, after pieces that are shuffled
        assert rows(coupling.import_counts(imports, mods, limit)) == want
    assert coupling.import_counts(imports, mods.limit(0)).count() == coupling.import_counts(imports.limit(0), mods).count() == 0


def test_import_coupling_loose_does_not_shuffle_its_pairs(spark, tmp_path):
    n = 300  # each path may mean each module
    spark.createDataFrame([(f"rust:repo{i}::shared::f", f"rust:lib{i}::shared::g") for i in range(n)], "from_id string, to_id string").write.parquet(f"{tmp_path}/call_graph_edges.parquet")
    spark.createDataFrame([(f"repo{i}::shared",) for i in range(n)], "id string").write.parquet(f"{tmp_path}/code_modules.parquet")

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    got = code_queries.QUERIES["x04_import_coupling_loose"](spark, str(tmp_path)).groupBy("imports").count().collect()
    assert [tuple(r) for r in got] == [(1, n * (n - 1))]
    assert sum(v for k, v in written().items() if k not in before) < n * n / 4


def test_composite_and_percentile(spark):
    e = lambda *r: spark.createDataFrame(list(r), "src string, dst string, value double")
    parts = {"import": e(("a", "b", 2.0), ("b", "c", 1.0), ("a", "a", 9.0), ("a", "gone", 9.0)), "call": e(("a", "b", 4.0), ("c", "a", 0.5)), "type": e(("b", "c", 1.0))}
    mods = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    c = coupling.composite(parts, modules=mods)
    got = {(r["src"], r["dst"]): round(r["composite"], 6) for r in c.collect()}
    assert got == {("a", "b"): 0.75, ("b", "c"): 0.45, ("c", "a"): round(0.35 * 0.125, 6)}
    p = {(r["src"], r["dst"]): r["value"] for r in coupling.percentile_normalise(c, "composite").collect()}
    assert p == {("a", "b"): 1.0, ("b", "c"): 0.5, ("c", "a"): 0.0}
    ties = spark.createDataFrame([(i, float(i // 3)) for i in range(12)], "i int, w double")
    assert sorted(round(r["value"], 6) for r in coupling.percentile_normalise(ties, "w").collect()) == sorted(round((i // 3 * 3) / 11, 6) for i in range(12))
    assert coupling.percentile_normalise(ties.limit(1), "w").first()["value"] == 1.0 and coupling.percentile_normalise(ties.limit(0), "w").count() == 0
    assert rows(coupling.afferent_efferent(e(("a", "b", 1.0), ("a", "b", 2.0), ("c", "b", 1.0)))) == [("a", 0, 1), ("b", 2, 0), ("c", 0, 1)]


def test_matrix(spark):
    mods = spark.createDataFrame([("a",), ("b",)], "module string")
    e = spark.createDataFrame([("a", "b", 1.4), ("x", "a", 0.5)], "src string, dst string, value double")
    cells = coupling.matrix(mods, e)
    assert rows(cells) == [("a", "a", 1.0), ("a", "b", 1.0), ("b", "b", 1.0)]
    assert {r["rule"] for r in coupling.matrix_violations(cells, mods, symmetric=True).collect()} == {"symmetry"}
    assert coupling.matrix_violations(coupling.matrix(mods, e, False), mods, symmetric=True).count() == 0
    bad = spark.createDataFrame([("a", "a", 0.9), ("a", "q", 2.0)], "src string, dst string, value double")
    assert {r["rule"] for r in coupling.matrix_violations(bad, mods).collect()} == {"range", "diagonal", "axis"}
    dense = spark.createDataFrame([(["a", "b"], [[1.0, 0.2], [0.3, 1.0]])], "modules array<string>, matrix array<array<double>>")
    assert rows(coupling.from_dense(dense)) == [("a", "a", 1.0), ("a", "b", 0.2), ("b", "a", 0.3), ("b", "b", 1.0)]


def test_slice_independence(spark):
    e = spark.createDataFrame([("p.x.1", "p.x.2"), ("p.x.1", "p.y.1"), ("p.y.1", "p.x.1"), ("p.x.1", "p.x.2")], "src string, dst string")
    m = spark.createDataFrame([("p.x.1",), ("p.x.2",), ("p.y.1",), ("q.z",)], "module string")
    got = {r["slice"]: r for r in slices.slice_independence(*slices.module_slices(e, m)).collect()}
    assert (got["p.x"]["internal"], got["p.x"]["cross"], got["p.x"]["independence"], got["p.x"]["modules"]) == (1, 1, 0.5, 2)
    assert (got["p.y"]["independence"], got["p.y"]["inbound_slices"]) == (0.0, 1) and (got["q.z"]["independence"], got["q.z"]["outbound_slices"]) == (1.0, 0)
    boxes = slices.treemap([("a", 6.0), ("b", 3.0), ("c", 1.0)], 10, 5)
    assert [b[0] for b in boxes] == ["a", "b", "c"] and math.isclose(sum(b[3] * b[4] for b in boxes), 50)


# -- rules, diff, markers, packages


def _rule(**x):
    return {"rule_id": "r", "rule_name": "R", "source": "m.json", "field": "v", "max": 10.0, "min": None, "scope": "function", "severity": None, "exclude": []} | x


@pytest.mark.parametrize(
    ("doc", "scope", "want"),
    [
        ({"a": {"v": 1}, "b": {"v": 2}}, "function", {"a": 1.0, "b": 2.0}), ([{"path": "p", "v": 3}], "function", {"p": 3.0}), ({"functions": [{"id": "i", "path": "p", "v": 4}], "other": [1]}, "function", {"i": 4.0}), ({"schema": "x", "things": [{"name": "n", "v": 5}]}, "function", {"n": 5.0}),
        ({"m": {"v": "7"}, "k": {"w": 1}}, "module", {}), ([{"id": 5, "path": "p", "v": 1}, {"v": 2}], "file", {}),
    ],
)
def test_entities_of_any_shape(spark, doc, scope, want):
    d = spark.createDataFrame([("m.json", json.dumps(doc))], "source string, j string").select("source", F.try_parse_json("j").alias("doc"))
    got = rules.field_values(rules.entities(d, scope), [_rule(scope=scope)])
    assert {r["entity"]: r["actual"] for r in got.collect()} == want


def test_rule_results(spark):
    values = spark.createDataFrame([("r", "ok", 5.0), ("r", "bad", 12.0), ("r", "excused", 15.0), ("r", "over", 30.0), ("low", "few", 1.0), ("w", "x", 99.0)], "rule_id string, entity string, actual double")
    rl = rules.rules_table(spark, [_rule(), _rule(rule_id="low", max=None, min=2.0), _rule(rule_id="w", severity="warning"), _rule(rule_id="gone", source="none.json"), _rule(rule_id="fine", max=1000.0)])
    ex = rules.exceptions_table(spark, [{"rule_id": "r", "entity": e, "value": v, "issue": "#1"} for e, v in (("excused", None), ("over", 20.0), ("ok", None), ("lost", None))] + [{"rule_id": "gone", "entity": "x", "issue": "#2"}])
    rep = rules.evaluate(values, rl, ex, spark.createDataFrame([("m.json",)], "source string"))
    assert {r["entity"]: (r["direction"], r["excepted"]) for r in rep["violations"].collect()} == {"bad": ("max", False), "excused": ("max", True), "over": ("max", False), "few": ("min", False), "x": ("max", False)}
    assert {r["rule_id"]: r["status"] for r in rep["results"].collect()} == {"r": "fail", "low": "fail", "w": "warn", "gone": "skip", "fine": "pass"}
    assert rows(rep["stale"]) == [("r", "lost", "entity_not_found"), ("r", "ok", "now_passing")]
    assert tuple(rep["summary"].first()) == (5, 1, 2, 1, 5, 1, 2) and rules.exit_code(rep["results"]) == 1
    assert {r["entity"]: r["value"] for r in rules.ratchet(ex, rep["violations"]).collect()} == {"excused": 15.0, "over": 20.0}
    assert rules.check_rules([{"id": "a", "source": "s", "field": "f"}]) == ["a: neither max nor min"]


def test_diff_and_gate(spark):
    totals = lambda avg, n: spark.createDataFrame([(n, int(avg * n), 0, 0, 0, avg, 0.0)], "total_functions bigint, total_cyclomatic bigint, total_cognitive bigint, lines_of_code bigint, max_cyclomatic bigint, avg_cyclomatic double, avg_cognitive double")
    for base, target, status, code in ((2.0, 3.0, "success", 0), (2.0, 4.5, "warning", 2), (2.0, 8.0, "error", 1), (15.0, 15.5, "error", 0), (16.0, 15.5, "success", 0)):
        d = diff.snapshot_diff(totals(base, 10), totals(target, 12))
        r = d.first()
        assert (r["status"], r["functions_added"], r["functions_removed"], len(r["violations"])) == (status, 2, 0, int(target - base > 2))
        assert diff.check_gate(d).first()["exit_code"] == code
    assert "error" in sinks.diff_comment(d) or "success" in sinks.diff_comment(d)
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "id string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("w", 3)], "id string, v int")
    assert rows(diff.entity_diff(a, b, ["id"], ["v"])) == [("w", "added", None, 3), ("y", "modified", None, 2), ("z", "removed", 3, None)]
    assert rows(diff.new_hotspots(a.withColumnRenamed("v", "value"), b.withColumnRenamed("v", "value"), 1)) == [("w", None, 3, "NEW_COMPLEX"), ("y", None, 2, "NEW_COMPLEX")]
    assert diff.metric_deltas(totals(0.0, 0), totals(2.0, 5), ["total_functions"]).first()["percent_change"] is None


def test_markers(spark):
    text = "// TODO(#12): fix\n  # FIXME: not in rust\n    /// FIXME: tidy  \nlet x = 1; // TODO: trailing\n/* TODO(9): odd */\n// TODO no colon\n* TODO: star\n// TODO(#99999999999): big\n"
    f = spark.createDataFrame([("a.rs", 10, text), ("b.py", 10, "# TODO: py\n"), ("c.zzz", 10, "-- FIXME(#3): sql\r\n"), ("d.rs", 99 << 20, text)], "file string, size bigint, content string")
    lines = markers.lines_of(markers.scan_files(f))
    items = markers.marker_items(lines, repo="o/r")
    got = {(r["file"], r["line"]): (r["tag"], r["column"], r["description"], r["issue"]["number"] if r["issue"] else None) for r in items.collect()}
    assert got == {("a.rs", 1): ("TODO", 3, "fix", 12), ("a.rs", 3): ("FIXME", 8, "tidy", None), ("a.rs", 8): ("TODO", 3, "big", None), ("b.py", 1): ("TODO", 2, "py", None), ("c.zzz", 1): ("FIXME", 1, "sql", 3)}
    assert tuple(markers.marker_totals(items).first()) == (5, 3, 2, 3)
    s = {(r["level"], r["key"]): (r["total"], r["tracked"], r["untracked"]) for r in markers.marker_summary(items).collect()}
    assert s[("all", "")] == (5, 2, 3) and s[("tag", "TODO")] == (3, 1, 2) and s[("issue", "null")] == (3, 0, 3) and s[("file", "a.rs")] == (3, 1, 2)
    assert markers.untracked(items, ["FIXME"]).count() == 1 and markers.untracked(items, ["FIXME"], "off").count() == 0 and rows(markers.malformed(lines))[0][1] == 5
    assert markers.with_context(items, lines).where("file = 'a.rs' AND line = 1").first()["context"][0].startswith("// TODO")


def _tree(spark, files):
    return spark.createDataFrame([(p, False, c) for p, c in files.items()], "path string, is_dir boolean, content string")


def test_packages(spark):
    meta = lambda kind, id, more="": f'schema = "x"\n[{kind}]\nid = "{id}"\nname = "N"\nslug = "n"\nversion = "0.1.0"\n{more}\n[ownership]\nmaintainers = ["m"]\n'
    base = "standards/v1/A"
    good = {f"{base}/{f}": "" for f in ("Cargo.toml", "src/lib.rs", "docs/01_spec.md", "examples/e.md", "tests/t.rs", "agents/skills/s.md")}
    tree = _tree(spark, good | {f"{base}/standard.toml": meta("standard", "STD-V1-0001"), f"{base}/substandards/S/substandard.toml": meta("substandard", "STD-V1-0001.AB01", 'parent_id = "STD-V1-0009"'), "standards/v1/B/standard.toml": "broken = [", "standards/v1/.h/standard.toml": meta("standard", "STD-V1-0002")})
    found = packages.discover(tree)
    assert rows(found.select("path", "package_type")) == [("standards/v1/A", "standard"), ("standards/v1/A/substandards/S", "substandard"), ("standards/v1/B", "standard")]
    got = {(r["code"], r["path"]) for r in packages.repository_diagnostics(tree).collect()}
    assert {("MISSING_EXPERIMENTAL_DIR", "standards-experimental/v1"), ("INVALID_METADATA", "standards/v1/B"), ("PARENT_NOT_FOUND", "standards/v1/A/substandards/S"), ("INVALID_PARENT_REF", "standards/v1/A/substandards/S"), ("MISSING_REQUIRED_DIR", "standards/v1/B/docs"), ("MISSING_CARGO_TOML", "standards/v1/B/Cargo.toml"), ("EMPTY_TESTS_DIR", "standards/v1/B/tests"), ("PACKAGE_VALIDATION_FAILED", "standards/v1/B")} <= got
    assert not {c for c, p in got if p and p.startswith("standards/v1/A/") and "substandards" not in p}
    meta_rows = packages.metadata(tree, found)
    assert packages.next_id(meta_rows, "STD-V1").first()["id"] == "STD-V1-0002" and packages.find_package(meta_rows, "STD-V1-0001").count() == 1 and [r["id"] for r in packages.registry(meta_rows).collect()] == ["STD-V1-0001", "STD-V1-0001.AB01"]
    assert packages.diagnostic_counts(packages.repository_diagnostics(tree)).first()["exit_code"] == 1


# -- graph, projectors, extraction, whole analyses


def test_module_hotspots(spark):
    edges = lambda *r: spark.createDataFrame(list(r), "src string, dst string, value double")
    mods = lambda *r: spark.createDataFrame(list(r), "module string, instability double, distance double")
    e0, e1 = edges(("a", "b", 0.25), ("b", "c", 0.5), ("c", "d", 0.5), ("d", "e", 0.5)), edges(("a", "b", 0.75), ("b", "c", 0.25), ("c", "d", 0.5625), ("e", "f", 0.5))
    m0, m1 = mods(("a", 0.5, 0.25), ("b", 0.5, 0.75), ("c", 0.5, 0.75), ("gone", 0.5, 0.75)), mods(("a", 0.5, 0.75), ("b", 0.5, 0.875), ("c", 0.5, 0.25), ("new", 0.0, 1.0))
    got = rows(diff.module_hotspots(e0, e1, m0, m1, 0.125))
    want = [("a -> b", 0.25, 0.75, "COUPLING_INCREASE"), ("e -> f", 0.0, 0.5, "COUPLING_INCREASE"), ("a", 0.25, 0.75, "ZONE_OF_PAIN"), ("new", None, 1.0, "ZONE_OF_PAIN")]
    assert got == sorted(want, key=str)
    assert diff.module_hotspots(e1, e1, m1, m1).count() == 0


def test_long_cycles_are_found_whole(spark):
    ring = [(f"m{i:03}", f"m{(i + 1) % 50:03}") for i in range(50)]
    tail = [("m000", "t00"), *[(f"t{i:02}", f"t{i + 1:02}") for i in range(3)], ("t03", "x"), ("x", "y"), ("y", "x")]
    e = spark.createDataFrame(ring + tail, "src string, dst string")
    assert {r[0] for r in graph.cycle_members(e, max_rounds=30).collect()} == {a for a, _ in ring} | {"x", "y"}
    with pytest.raises(RuntimeError):
        graph.cycle_members(e, max_rounds=2)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("g", "h"), ("h", "g"), ("e", "g")], "src string, dst string")
    assert [r[0] for r in rows(graph.cycle_members(e))] == ["a", "b", "c", "f", "g", "h"]
    assert graph.cycle_members(e.where("src IN ('c', 'd')")).count() == 0 and graph.cycle_members(e.limit(0)).count() == 0
    assert ("a", "d", 3) in rows(graph.reachable_pairs(e, 3)) and ("a", "e", 4) not in rows(graph.reachable_pairs(e, 3))
    assert {r["module"]: r["hops"] for r in graph.focus(e, "d", 1).collect()} == {"d": 0, "c": 1, "e": 1}
    got = rows(graph.edge_rules(e, forbidden=[("a", "*")], allowed=[("c", "a")], required=[("x", "y"), ("a", "b")]))
    assert got == [("forbidden", "a", "b"), ("not_allowed", "c", "d"), ("required", "x", "y")]
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    v = e.where("src IN ('a', 'b')").withColumn("value", F.lit(0.5))
    at = graph.layout(m, v, 50)
    assert all(abs(at.agg(F.sum(c)).first()[0]) < 1e-6 for c in "xyz") and rows(at) == rows(graph.layout(m, v, 50))


def test_projectors(spark):
    e = spark.createDataFrame([("a::x", "b", 0.75), ("b", "a::x", 0.2), ("a::x", "a::x", 1.0)], "src string, dst string, value double")
    m = spark.createDataFrame([("a::x", 3, 0.7), ("b", 1, 0.1)], "module string, function_count bigint, distance double")
    text = projectors.mermaid(e, m).first()["text"]
    assert text.startswith("flowchart TD") and '    a_x["a::x"]:::danger' in text and "    a_x -->|75%| b" in text and "b -->" not in text
    assert "a_x -->|95%| b" in projectors.mermaid(e, m, fold="sum").first()["text"]
    assert 'Rel(a, b, "uses")' in projectors.c4(e, m).first()["text"] and '"a::x" -> "b"' in projectors.dot(e, m).first()["text"]
    s = projectors.scene(e, m).first()
    assert [n["id"] for n in s["nodes"]] == ["a::x", "b"] and len(s["edges"]) == 1
    p = projectors.DiagramProjector()
    assert p.validate_config({"least": 3}) and p.render(e, m, "mermaid", {}).count() == 1
    assert "</script><" not in projectors.html("t", [{"a": "</script><b>"}]).split("DATA = ")[1].split(";</script>")[0]


def test_extraction(spark):
    t = extract_sources(spark.createDataFrame(SNIPPETS, "path string, content string"))
    f = {r["id"]: r for r in t["functions"].collect()}
    assert set(f) == {"python:pkg.a::top", "rust:crate::run", "rust:crate::helper", "typescript:web::go", "typescript:web::pick"}
    assert (f["python:pkg.a::top"]["cyclomatic_complexity"], f["python:pkg.a::top"]["cognitive_complexity"], f["python:pkg.a::top"]["comment_lines"]) == (6, 11, 1)
    assert (f["rust:crate::run"]["cyclomatic_complexity"], f["rust:crate::run"]["visibility"], f["rust:crate::helper"]["cyclomatic_complexity"]) == (6, "public", 1)
    assert f["typescript:web::go"]["cyclomatic_complexity"] == 5
    imports = {(r["from_module"], r["import_path"], r["kind"], r["is_external"]) for r in t["imports"].collect()}
    assert {("pkg.a", "os", "module", True), ("pkg.a", ".util", "multi", False), ("pkg", "pkg.a", "wildcard", True), ("crate", "crate::model", "multi", False), ("web", "./lib", "multi", False)} <= imports
    assert ("Base", "pkg.a", True) in rows(t["types"]) and ("crate", "helper") in {(r["caller"], r["callee"]) for r in t["calls"].collect()}
    broken = spark.createDataFrame([("a.py", "def ("), ("b.py", None), ("c.rs", "fn x( {"), ("d.txt", "x")], "path string, content string")
    assert [r["path"] for r in parse_files(broken).where("error IS NOT NULL").collect()] == ["a.py"]
    r = default_registry()
    register_configured(r, {"kotlinish": {"extensions": ["kt"], "like": "rust"}})
    assert r.get_for_path("x.kt") == "kotlinish" and r.supports_extension(".tsx") and "python" in r.languages()


def test_whole_analysis_and_commands(spark, tmp_path, capsys):
    for p, c in SNIPPETS:
        file = tmp_path / "src" / p
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(c)
    (tmp_path / "src/tests").mkdir()
    (tmp_path / "src/tests/x.py").write_text("def no(): pass\n")
    (tmp_path / "src/m.py").write_text("# TODO(#3): later\ndef f():\n    return 1\n")
    root, out = str(tmp_path / "src"), str(tmp_path / "out")
    assert cli.main(["topology", "analyze", root, "--output", out]) == 0 and cli.main(["topology", "validate", out]) == 0 and cli.main(["topology", "validate", root]) == 1
    back = readers.functions(spark, os.path.join(out, "metrics/functions.json"))
    assert back.count() == 6 and readers.snapshot_metrics(spark, out).first()["total_functions"] == 6 and readers.snapshot_metrics(spark, str(tmp_path / "none")).first()["total_functions"] == 0
    assert {r["src"] for r in readers.coupling_matrix(spark, os.path.join(out, "graphs/coupling-matrix.json")).collect()} == {"m", "crate", "pkg.a", "web"}
    short = tmp_path / "short.json"
    short.write_text(json.dumps({"functions": [{"id": "rust:a::f", "name": "f", "line": 3, "metrics": {"cyclomatic": 4, "cognitive": 2, "loc": 9}}]}))
    r = readers.functions(spark, str(short)).first()
    assert (r["cyclomatic_complexity"], r["lines_of_code"], r["start_line"], r["language"]) == (4, 9, 3, "rust")
    assert cli.main(["topology", "diff", out, out, "--format", "json"]) == 0 and cli.main(["topology", "check", out, out]) == 0 and cli.main(["topology", "comment", out, out]) == 0
    for f in ("mermaid", "c4", "dot", "json", "html"):
        assert cli.main(["topology", "viz", out, "--format", f]) == 0
    assert cli.main(["topology", "report", out]) == 0 and cli.main(["topology", "query", out, "web"]) == 0
    capsys.readouterr()
    assert cli.main(["todos", "scan", root, "--output", str(tmp_path / "todo")]) == 0 and json.loads(capsys.readouterr().out) == {"items": 2, "files": 2, "tracked": 2, "untracked": 0}
    (tmp_path / "fitness.toml").write_text('[config]\ntopology_dir = "out"\n[[rules.threshold]]\nid = "cc"\nname = "CC"\nsource = "metrics/functions.json"\nfield = "metrics.cyclomatic_complexity"\nmax = 4\nscope = "function"\n')
    (tmp_path / "fitness-exceptions.toml").write_text('[cc."python:pkg.a::top"]\nvalue = 6\nissue = "#1"\n[cc."rust:crate::run"]\nissue = "#2"\n')
    assert cli.main(["fitness", "validate", str(tmp_path), "--report", str(tmp_path / "rep.json")]) == 1
    rep = json.loads((tmp_path / "rep.json").read_text())
    assert rep["results"][0]["status"] == "fail" and rep["results"][0]["exceptions_used"] == 2 and rep["results"][0]["n_violations"] == 3
    a = api.Analysis.of_path(spark, root, profile="spec")
    assert a.report().first()["text"].startswith("# Modules") and a.slices.count() == 4 and a.view.where("health BETWEEN 0 AND 1").count() == 4
    assert cli.main(["packages", "validate", str(tmp_path)]) == 1


def test_html_refuses_more_modules_than_it_shows(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "src/b").mkdir(parents=True)
    for f in ("a.py", "b/c.py"):
        (tmp_path / "src" / f).write_text("def f(x):\n    return x\n")
    out = str(tmp_path / "out")
    assert cli.main(["topology", "analyze", str(tmp_path / "src"), "--output", out]) == 0
    n = readers.modules(spark, os.path.join(out, "metrics/modules.json")).count()
    monkeypatch.setattr(sinks, "MOST_ROWS", n)
    assert n > 1 and cli.main(["topology", "viz", out, "--format", "html"]) == 0
    monkeypatch.setattr(sinks, "MOST_ROWS", n - 1)
    with pytest.raises(ValueError, match="too many modules"):
        cli.main(["topology", "viz", out, "--format", "html"])


def test_configurations(tmp_path):
    t = tmp_path / "c.toml"
    t.write_text("max_cyclomatic_warning = 1.5\nmax_cyclomatic_failure = 3.0  # limit\n")
    assert readers.check_thresholds(str(t)) == {"max_cyclomatic_warning": 1.5, "max_cyclomatic_failure": 5.0} and readers.check_thresholds(str(t), "spec")["max_cyclomatic_failure"] == 3.0 and readers.check_thresholds(None)["max_cyclomatic_warning"] == 2.0
    e = tmp_path / "e.toml"
    e.write_text('[r."x"]\nvalue = 3\n')
    with pytest.raises(ValueError):
        readers.exceptions_config(str(e))
    assert readers.exceptions_config(str(tmp_path / "none")) == [] and readers.marker_config(str(t))["max_file_size"] == 10
    assert readers.check_slice_config({"version": 3}) == ["version must be 1 or 2", "root is required", "contexts must not be empty"] and readers.check_slice_config({"version": 2, "root": "r", "contexts": [1]}) == ["version 2 needs an architecture"]
    (tmp_path / "Cargo.toml").write_text('[workspace]\nmembers = ["a", "b/*"]\n[package]\nname = "x"\n')
    (tmp_path / "a").mkdir()
    assert readers.workspace_members(str(tmp_path)) == ["a/src", "src"] and readers.repository_root(str(tmp_path / "a")) == str(tmp_path)


def test_streams_and_retention(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2031-01-01 10:00:00' AS ts, 2.0D AS value UNION ALL SELECT timestamp'2031-01-01 11:00:00', 3.0D UNION ALL SELECT timestamp'2031-02-01 00:00:00', 1.0D").write.parquet(src)
    stream_counts(spark, src, "ts timestamp, value double", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("events", "total")) == [(2, 5.0)]
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.py").write_text("def f(): pass\n")
    seen = []
    stream_files(spark, str(tmp_path / "code"), lambda df, i: seen.extend(df.select("content").collect()), str(tmp_path / "cp2")).awaitTermination(60)
    assert [r[0] for r in seen] == ["def f(): pass\n"]
    s = spark.createDataFrame([("r", 1), ("r", 2), ("r", 2), ("r", 3), ("q", 1)], "repo string, taken_at int")
    assert rows(retained(s, 2, scope="repo")) == [("q", 1), ("r", 2), ("r", 2), ("r", 3)] and retained(s, 0).count() == 0 and retained(s, -1).count() == 5
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    assert [r["path"] for r in changed_files(files, files.where("path = 'a'").select("path", F.sha2("content", 256).alias("hash"))).collect()] == ["b"]
