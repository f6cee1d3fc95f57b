import json
import os
import random
from collections import Counter, defaultdict

import pytest

from strataloom import runtime
from strataloom.operators import schema_drift
from strataloom.operators.references import Reference, orphan_counts, orphan_rows
from strataloom.operators.skew import heavy_keys, outsize_keys, salted_aggregate
from strataloom.operators.snapshots import current_rows, snapshot_changes
from strataloom.plans import problem_queries
from strataloom.runtime import checked_join, estimated_bytes

from .conftest import rows

REFS = [Reference("child", "pid", "parent"), Reference("child", "other", "parent")]


def _tables(spark, children, parents):
    return {
        "child": spark.createDataFrame(children, "rec bigint, repo string, snap bigint, pid string, other string, parent string, key string, is_parent string"),
        "parent": spark.createDataFrame(parents, "id string, repo string, snap bigint, _t string"),
    }


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_orphans_by_broadcast_and_by_salt(spark, limit):
    children = [(1, "r", 1, "a", None, "x", "x", "x"), (2, "r", 1, "b", "a", "x", "x", "x"), (3, "r", 2, "a", "z", "x", "x", "x"), (3, "r", 2, "a", "z", "x", "x", "x"), (4, None, 1, "a", None, "x", "x", "x"), (5, "q", None, "a", "", "x", "x", "x")]
    t = _tables(spark, children, [("a", "r", 1, "t"), ("a", "r", 1, "t"), (None, "r", 1, "t"), ("a", None, 1, "t")])
    got = rows(orphan_rows(t, REFS, ["repo", "snap"], ["snap", "rec"], limit))
    want = [("child", "pid", 1, 2), ("child", "pid", 2, 3), ("child", "pid", 2, 3), ("child", "other", 2, 3), ("child", "other", 2, 3), ("child", "pid", None, 5), ("child", "other", None, 5)]
    assert got == sorted(want, key=str)
    counts = {(r["field_name"], r["snap"]): (r["orphan_rows"], r["orphan_keys"]) for r in orphan_counts(t, REFS, ["repo", "snap"], ["snap"]).collect()}
    assert counts == {("pid", 1): (1, 1), ("pid", 2): (2, 1), ("other", 2): (2, 1), ("pid", None): (1, 1), ("other", None): (1, 1)}


def test_orphans_of_empty_tables(spark):
    t = _tables(spark, [], [("a", "r", 1, "t")])
    assert orphan_rows(t, REFS, ["repo", "snap"], ["rec"]).count() == 0
    t = _tables(spark, [(1, "r", 1, "a", None, "", "", "")], [])
    assert rows(orphan_rows(t, REFS, ["repo", "snap"], ["rec"])) == [("child", "pid", 1)]


def test_salted_aggregate_equals_plain_grouping(spark):
    r = random.Random(1)
    data = [(i, "hot" if r.random() < 0.4 else r.choice(["a", "b", None]), r.choice([None, r.randint(-5, 5)]), "s", {"m": 1}) for i in range(3000)]
    df = spark.createDataFrame(data, "id bigint, k string, v bigint, _salt string, _v_n map<string,int>")
    got = {x["k"]: (x["n"], x["s"], x["hi"], x["lo"]) for x in salted_aggregate(df, "k", {"n": ("count", "1"), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}).collect()}
    want = {}
    for k in {d[1] for d in data}:
        own = [d[2] for d in data if d[1] == k]
        num = [v for v in own if v is not None]
        want[k] = (len(own), sum(num), max(num), min(num))
    assert got == want
    assert "hot" in heavy_keys(df, "k", 0.1)


def test_outsize_keys_count_nulls_in_the_total(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 3 + [(None,)] * 93, "k string")
    assert rows(outsize_keys(df, "k", 4)) == [("a", 4)]
    assert outsize_keys(df.limit(0), "k", 4).count() == 0
    assert outsize_keys(df.where("k IS NULL"), "k", 4).count() == 0


def test_module_metrics_hold_both_tables_and_every_metric(spark, tmp_path):
    whole = [f"metrics.{m}" for m in ("cyclomatic_complexity", "cognitive_complexity", "lines_of_code", "logical_lines", "comment_lines", "parameter_count")] + [f"metrics.halstead.{m}" for m in ("vocabulary", "length")]
    real = [f"metrics.halstead.{m}" for m in ("volume", "difficulty", "effort", "time_to_implement", "estimated_bugs")]
    halstead = "halstead struct<vocabulary bigint, length bigint, volume double, difficulty double, effort double, time_to_implement double, estimated_bugs double>"
    schema = f"record_id bigint, module string, metrics struct<cyclomatic_complexity bigint, cognitive_complexity bigint, {halstead}, lines_of_code bigint, logical_lines bigint, comment_lines bigint, parameter_count bigint>"
    data = [(1, "m", (1, 2, (7, 8, 9.5, 10.5, 11.5, 12.5, 13.5), 3, 4, 5, 6)), (2, "m", (10, 20, None, 30, 40, 50, 60)), (3, None, (1, 1, None, 1, 1, 1, 1))]
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/code_functions.parquet")
    spark.createDataFrame([(1, "m"), (2, "only"), (3, "only"), (4, None)], "record_id bigint, module string").write.parquet(f"{tmp_path}/call_graph_nodes.parquet")
    out = problem_queries.p2_module_metrics(spark, str(tmp_path))
    got = {(r["table_name"], r["module"]): r.asDict() for r in out.collect()}
    name = lambda f, c: f"{f}_{c.removeprefix('metrics.').replace('.', '_')}"
    assert set(out.columns) == {"table_name", "module", "n_rows"} | {name(f, c) for c in whole + real for f in ("sum", "max")}
    assert {k: v["n_rows"] for k, v in got.items()} == {("code_functions", "m"): 2, ("code_functions", None): 1, ("call_graph_nodes", "m"): 1, ("call_graph_nodes", "only"): 2, ("call_graph_nodes", None): 1}
    m = got[("code_functions", "m")]
    assert [m[name("sum", c)] for c in whole + real] == [11, 22, 33, 44, 55, 66, 7, 8, 9.5, 10.5, 11.5, 12.5, 13.5]
    assert [m[name("max", c)] for c in whole + real] == [10, 20, 30, 40, 50, 60, 7, 8, 9.5, 10.5, 11.5, 12.5, 13.5]
    assert all(v is None for c, v in got[("call_graph_nodes", "only")].items() if c.startswith(("sum_", "max_")))


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_snapshot_changes(spark, limit):
    data = [
        ("r", 1, "a", 1, 1), ("r", 1, "b", 2, 1), ("r", 1, "n", None, 1), ("r", 1, "m", None, 1), ("r", 1, "x", 9, 1), ("r", 1, None, 9, 1),
        ("r", 3, "a", 1, 1), ("r", 3, "b", 5, 1), ("r", 3, "b", 2, 2), ("r", 3, "n", None, 1), ("r", 3, "m", 0, 1), ("r", 3, "c", 1, 1), ("r", 3, "c", 1, 1),
        ("q", 1, "a", 1, 1),
    ]
    df = spark.createDataFrame([(*d, "now", "before") for d in data], "repo string, snap bigint, id string, v bigint, seq bigint, _prev string, change string")
    got = rows(snapshot_changes(df, "repo", "snap", "id", ["v"], "seq", limit_bytes=limit))
    assert got == [("r", 3, "c", "added"), ("r", 3, "m", "changed"), ("r", 3, "x", "removed")]
    assert snapshot_changes(df.limit(0), "repo", "snap", "id", ["v"], "seq").count() == 0


def test_current_rows_take_the_highest_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 2, 4), ("b", None, 1)], "id string, seq bigint, v bigint")
    assert rows(current_rows(df, ["id"], "seq", ["v"])) == [("a", 4), ("b", 1)]


def _plain(v):
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return int(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def _fields_of(payload):
    """path -> (type, canonical JSON text) of a record, without Spark."""
    try:
        top = json.loads(payload)
    except (TypeError, ValueError):
        return {}
    found, todo = {}, [("", top)] if isinstance(top, dict) else []
    while todo:
        at, o = todo.pop()
        for k, v in o.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                todo.append((path, v))
            elif v is not None:
                kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array"
                found[path] = (kind, json.dumps(_plain(v), sort_keys=True))
    return found


def _brute_changes(raw):
    files = defaultdict(list)
    for repo, artifact, file_no, payload in raw:
        files[(repo, artifact, file_no)].append(payload)
    order = schema_drift.TYPES
    info = {}
    for k, payloads in files.items():
        kinds, values = defaultdict(Counter), defaultdict(lambda: defaultdict(set))
        for p in payloads:
            have = _fields_of(p)
            for path, (kind, v) in have.items():
                if path != "id":
                    kinds[path][kind] += 1
                    if "id" in have:
                        values[path][have["id"][1]].add(v)
        info[k] = kinds, values
    best = lambda c: max(order, key=lambda t: (c[t], -order.index(t)))
    out, series = set(), defaultdict(list)
    for repo, artifact, n in files:
        series[(repo, artifact)].append(n)
    for s, numbers in series.items():
        for a, b in zip(sorted(numbers), sorted(numbers)[1:]):
            (ka, va), (kb, vb) = info[(*s, a)], info[(*s, b)]
            gone, come, moved = set(ka) - set(kb), set(kb) - set(ka), set()
            for g in gone:
                for c in come:
                    ids = set(va[g]) & set(vb[c])
                    if 2 * sum(bool(va[g][i] & vb[c][i]) for i in ids) > len(ids):
                        moved.add((g, c))
            out |= {(*s, b, "renamed", g, c) for g, c in moved}
            out |= {(*s, b, "removed", g, "") for g in gone - {g for g, _ in moved}}
            out |= {(*s, b, "added", c, "") for c in come - {c for _, c in moved}}
            out |= {(*s, b, "type_changed", x, "") for x in set(ka) & set(kb) if best(ka[x]) != best(kb[x])}
    return out


def test_schema_changes_equal_brute_force(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/raw_artifacts.parquet")
    got = [tuple(r) for r in schema_drift.schema_changes(raw).collect()]
    want = _brute_changes([tuple(r) for r in raw.select("repo", "artifact", "file_no", "payload").collect()])
    assert len(got) == len(set(got)) and set(got) == want and {g[3] for g in got} == {"renamed", "removed", "added", "type_changed"}


RAW = "record_id bigint, repo string, artifact string, file_no bigint, payload string, fields string, gone string"


def _raw(spark, files):
    data = [(i, "r", "functions", n, p, "x", "y") for i, (n, p) in enumerate(files)]
    return spark.createDataFrame(data, RAW)


def test_drift_with_odd_records(spark):
    files = [
        (1, json.dumps({"id": "a", "x": 1, "y": {"z": "q"}, "e": {}, "n": None})), (1, json.dumps({"id": "b", "x": 2.0})), (1, None), (1, "{broken"), (1, "[1]"), (1, json.dumps({"x": 7})),
        (3, json.dumps({"w": 1.0, "id": "a", "y": {"z": ["q"]}})), (3, json.dumps({"id": "b", "w": 2})), (3, json.dumps({"id": "b", "w": 2})), (3, json.dumps({"id": "b", "t": True})), (4, ""),
    ]
    got = rows(schema_drift.schema_changes(_raw(spark, files)))
    assert got == sorted([("r", "functions", 3, "renamed", "x", "w"), ("r", "functions", 3, "type_changed", "y.z", ""), ("r", "functions", 3, "added", "t", ""), ("r", "functions", 4, "removed", "w", ""), ("r", "functions", 4, "removed", "y.z", ""), ("r", "functions", 4, "removed", "t", "")], key=str)
    assert schema_drift.schema_changes(_raw(spark, [])).count() == 0


def test_unified_table_follows_chained_renames(spark):
    files = []
    for n, field in enumerate(["metrics.halstead.volume", "metrics.vol", "v", "v"], 1):
        for i in range(4):
            doc: dict = {"id": f"f{i}"}
            at = doc
            *path, last = field.split(".")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = f"{i}.5" if n == 4 else [i + 0.5] if (n, i) == (3, 1) else i + 0.5
            files.append((n, json.dumps(doc | {"extra": i})))
    out = schema_drift.unified(_raw(spark, files), "functions", {"id": "string", "metrics.halstead.volume": "double", "loc": "bigint"}, {"loc": 0})
    got = {(r["file_no"], r["id"]): r for r in out.collect()}
    assert len(got) == 16
    assert all(r["metrics_halstead_volume"] == int(k[1][1]) + 0.5 and r["loc"] == 0 and r["rest"] == {"extra": k[1][1]} for k, r in got.items())
    assert "rename v -> metrics.halstead.volume" in got[(3, "f0")]["applied"] and "default loc" in got[(1, "f0")]["applied"]
    assert "cast metrics.halstead.volume to double" in got[(4, "f2")]["applied"] and got[(4, "f0")]["version"] == 4


def test_unified_table_keeps_both_values_when_an_old_name_returns(spark):
    docs = [(1, {"a": 1}), (2, {"b": 1}), (3, {"a": 900, "b": 0}), (4, {"b": 2, "q.a": 5, "q": {"a": 6}})]
    files = [(n, json.dumps({"id": f"f{i}"} | {k: (v + i if isinstance(v, int) else v) for k, v in d.items()})) for n, d in docs for i in range(3)]
    out = schema_drift.unified(_raw(spark, files), "functions", {"id": "string", "b": "bigint"})
    got = {(r["file_no"], r["id"]): r for r in out.collect()}
    for i in range(3):
        one, two, three = (got[(n, f"f{i}")] for n in (1, 2, 3))
        assert (one["b"], one["applied"], two["b"]) == (1 + i, ["rename a -> b"], 1 + i)
        assert (three["b"], three["rest"], three["applied"]) == (i, {"a": str(900 + i)}, [])
        assert got[(4, f"f{i}")]["rest"] == {"q.a": "6"}


def test_unified_table_reports_two_fields_for_one_target(spark):
    routes = {"x": "t", "y": "t", "t": "t"}
    schema = "repo string, artifact string, file_no bigint, version bigint, fingerprint string, routes map<string,string>"
    original = schema_drift.migration_routes
    schema_drift.migration_routes = lambda schemas, changes, target: spark.createDataFrame([("r", "functions", 1, 1, "f", routes)], schema)
    try:
        raw = _raw(spark, [(1, json.dumps({"x": 1, "y": 2, "t": 3})), (1, json.dumps({"x": 1, "y": 2}))])
        got = [(r["t"], r["rest"], r["applied"]) for r in schema_drift.unified(raw, "functions", {"t": "bigint"}).orderBy("record_id").collect()]
    finally:
        schema_drift.migration_routes = original
    moves = ["rename x -> t", "rename y -> t"]
    assert got == [(3, {"x": "1", "y": "2"}, [*moves, "conflict x -> t", "conflict y -> t"]), (1, {"y": "2"}, [*moves, "conflict y -> t"])]


def test_fields_of_deep_and_bracketed_records(spark):
    deep: object = 7
    for _ in range(20):
        deep = {"k": deep}
    texts = [json.dumps({"a": deep}), json.dumps({"s": "{{{{{{{{{{{{{{{{{", "t": [{"u": {}}] * 9}), "{}", "", None]
    df = spark.createDataFrame([("r", "a", 1, t) for t in texts], "repo string, artifact string, file_no bigint, payload string")
    depth = schema_drift.nesting_depth(df)
    got = [[tuple(f) for f in r["_fields"]] for r in schema_drift.with_fields(df, depth).collect()]
    assert depth == 21 and got[0] == [("a" + ".k" * 20, "7")] and [f[0] for f in got[1]] == ["s", "t"] and got[2:] == [[], [], []]


def test_unified_table_keeps_what_does_not_fit(spark):
    big = 2**53 + 1
    docs = [
        {"n": "n/a", "d": "-", "a": "rust"}, {"n": True, "d": [1, 2], "a": 7}, {"n": 2.5, "d": big, "a": ["x"]}, {"n": "3.5", "d": "1.5", "a": ["x", "y"]},
        {"n": 4.0, "d": 2**53, "a": None}, {"n": "5", "d": 3, "a": []}, {"n": [6], "d": False, "a": ["z"]}, {"n": big, "d": [0.5], "a": [1]}, {"n": 10**30, "d": 10**30 + 1}, {},
    ]
    target = {"n": "bigint", "d": "double", "a": "array<string>"}
    raw = _raw(spark, [(1, json.dumps({"id": str(i), "s": i} | doc)) for i, doc in enumerate(docs)])
    got = {r["record_id"]: r for r in schema_drift.unified(raw, "functions", target, {"d": -1.0}).collect()}
    want = [
        (None, -1.0, None, {"n": '"n/a"', "d": '"-"', "a": '"rust"'}, ["cast failed n to bigint", "cast failed d to double", "default d", "cast failed a to array<string>"]),
        (None, -1.0, None, {"n": "true", "d": "[1, 2]", "a": "7"}, ["cast failed n to bigint", "cast failed d to double", "default d", "cast failed a to array<string>"]),
        (3, float(big), ["x"], {"n": "2.5", "d": str(big)}, ["rounded n to bigint", "rounded d to double"]),
        (4, 1.5, ["x", "y"], {"n": '"3.5"'}, ["rounded n to bigint", "cast d to double"]),
        (4, 2.0**53, None, {}, []),
        (5, 3.0, [], {}, ["cast n to bigint"]),
        (6, -1.0, ["z"], {"d": "false"}, ["cast n to bigint", "cast failed d to double", "default d"]),
        (big, 0.5, ["1"], {}, ["cast d to double"]),
        (None, 1e30, None, {"n": str(10**30), "d": str(10**30 + 1)}, ["cast failed n to bigint", "rounded d to double"]),
        (None, -1.0, None, {}, ["default d"]),
    ]
    for i, (n, d, a, rest, applied) in enumerate(want):
        r = got[i]
        kept = {k: json.dumps(json.loads(v)) for k, v in r["rest"].items() if k not in ("s", "id")}
        assert (r["n"], r["d"], r["a"], kept, r["applied"]) == (n, d, a, rest, applied), i


def test_written_tables_can_be_removed_and_need_a_shared_folder(spark, monkeypatch):
    df = spark.range(3)
    one, two = runtime.materialize(df, "one"), runtime.materialize(df, "two")
    paths = [t._written_at for t in (one, two)]
    there = lambda p: os.path.exists(p.removeprefix("file:"))
    assert all(map(there, paths))
    runtime.discard(one, df)
    assert not there(paths[0]) and there(paths[1])
    runtime.release(spark)
    assert not there(paths[1])

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(Far)


def test_checked_join_gives_the_same_either_way(spark):
    big = spark.createDataFrame([(i, "h" if i % 2 else str(i % 5)) for i in range(200)], "i bigint, k string")
    small = spark.createDataFrame([("h", 1), ("2", 2)], "k string, v bigint")
    for how in ("inner", "left", "left_semi", "left_anti"):
        right = small if how in ("inner", "left") else small.select("k")
        assert rows(checked_join(big, right, ["k"], how, ["i"], 0)) == rows(checked_join(big, right, ["k"], how, ["i"]))
    assert estimated_bytes(small) > 0 and estimated_bytes(small.limit(0)) == 0
