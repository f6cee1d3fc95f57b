"""Schemas that drift between files of JSON records.

A field is the dotted path of a value that is not an object. Every file gets a schema fingerprint;
the step from one file to the next is an explicit list of changes (renamed, removed, added,
type_changed), where a rename is proved by the values: in more than half of the record ids that
hold both fields, the two JSON values are equal. Chained steps route every field of every file to
a field of the target schema; renames, casts and defaults that a record needed are listed with it.

Records are taken apart in the JVM as variants. Only per-file counts by field are shuffled at first;
values are read again just for the fields that vanish or appear in a step, where renames are found
by an equal join on step, record id and value. No step gathers a file or a record id in one task.

Defined cases: payloads that are null, not JSON or not an object hold no field; a null value is an
absent value; empty objects hold no field; of equal keys in an object the last counts, of equal
paths the first in the order of keys; numbers are equal by value (1 and 1.0); of equally frequent
types the first of number, string, boolean, array is taken; records without id take no part in
rename proofs; repeated ids count once, by any of their values; empty tables give no rows; rows
without file_no belong to no step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checked_join, materialize

TYPES = ("number", "string", "boolean", "array")
FILE = ["repo", "artifact", "file_no"]
_FILE_SCHEMA = "repo string, artifact string, file_no bigint"
_FIELDS = "array<struct<path:string,value:string>>"
#: Levels of objects up to which a count of braces is taken as the depth without looking closer.
PLAIN_DEPTH = 12


def _nesting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greatest number of open brackets of each text, outside of strings."""
    for b in batches:
        out = []
        for text in b["payload"]:
            most = now = 0
            quoted = skip = False
            for c in text:
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c == "{":
                    now += 1
                    most = max(most, now)
                elif c == "}":
                    now -= 1
            out.append(most)
        yield pd.DataFrame({"depth": out})


def nesting_depth(raw: DataFrame) -> int:
    """A bound of the levels of objects in payload: the braces outside of strings and arrays where they are few, else counted by text."""
    count = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit("{"), F.lit("")))
    bare = F.regexp_replace("payload", r'"(?:[^"\\]|\\.)*+"', "")
    for _ in range(2):
        bare = F.regexp_replace(bare, r"\[[^\[\]]*+\]", "")
    few = F.when(count(F.col("payload")) <= 3, count(F.col("payload"))).otherwise(count(bare))
    most = raw.agg(F.max(few)).first()[0] or 0
    if most > PLAIN_DEPTH:
        most = raw.where(few > PLAIN_DEPTH).select("payload").mapInPandas(_nesting, "depth int").agg(F.max("depth")).first()[0] or 0
    return max(int(most), 1)


def record_fields(payload: Column | str, depth: int) -> Column:
    """array<struct<path, value>> of the non-null fields of a JSON record, value as JSON text; depth: levels of objects."""

    def level(members: Column, above: Column | None, left: int) -> Column:
        def one(e: Column) -> Column:
            path = e["key"] if above is None else F.concat(above, F.lit("."), e["key"])
            text = F.to_json(e["value"])
            leaf = F.filter(F.array(F.struct(path.alias("path"), text.alias("value"))), lambda f: f["value"] != "null")
            if left <= 1:
                return leaf
            inner = F.try_variant_get(e["value"], "$", "map<string,variant>")
            return F.when(inner.isNotNull(), level(inner, path, left - 1)).otherwise(leaf)

        return F.flatten(F.transform(F.map_entries(members), one))

    doc = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    return F.coalesce(F.filter(level(doc, None, depth), lambda f: ~f["value"].startswith("{")), F.array().cast(_FIELDS))


def with_fields(df: DataFrame, depth: int, name: str = "_fields") -> DataFrame:
    """df with the fields of its payload instead of the payload; each path stands once."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rest = [c for c in df.columns if c != "payload"]
    paths = F.transform(name, lambda f: f["path"])
    once = F.when(F.size(F.array_distinct(paths)) == F.size(name), F.col(name)).otherwise(F.filter(name, lambda f, i: F.array_position(paths, f["path"]) == i + 1))
    # a generator of one row keeps the optimizer from copying the expression to each place that uses it
    return df.select(*rest, F.explode(F.array(record_fields("payload", depth))).alias(name)).select(*rest, F.explode(F.array(once)).alias(name))


def kind_of(value: Column) -> Column:
    """number, string, boolean or array, by the JSON text."""
    first = F.substring(value, 1, 1)
    return F.when(first == '"', "string").when(first == "[", "array").when(first.isin("t", "f"), "boolean").when(first.isNotNull(), "number")


def comparable(value: Column) -> Column:
    """The JSON text, numbers of equal value written alike."""
    real = value.try_cast("double")
    plain = F.when((real == F.rint(real)) & (F.abs(real) < 1e15), real.cast("bigint").cast("string")).otherwise(real.cast("string"))
    return F.when((kind_of(value) == "number") & value.rlike("[.eE]"), plain).otherwise(value)


def file_schemas(raw: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo, artifact, file_no, prev_no, fields map<path, type>, fingerprint) per file."""
    own = raw.select(*FILE, "payload")
    each = with_fields(own, depth or nesting_depth(own)).select(*FILE, F.explode_outer("_fields").alias("f"))
    named = each.select(*FILE, F.when(F.col("f.path") != "id", F.col("f.path")).alias("field_path"), kind_of(F.col("f.value")).alias("kind"))
    by_type = named.groupBy(*FILE, "field_path").agg(*[F.count_if(F.col("kind") == t).alias(t) for t in TYPES])
    best = F.greatest(*TYPES)
    kind: Column = F.lit(None).cast("string")
    for t in reversed(TYPES):
        kind = F.when(F.col(t) == best, t).otherwise(kind)
    typed = by_type.select(*FILE, "field_path", kind.alias("kind"))
    pair = F.when(F.col("field_path").isNotNull(), F.struct("field_path", "kind"))
    files = typed.groupBy(*FILE).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("fields"))
    w = Window.partitionBy("repo", "artifact").orderBy("file_no")
    return files.select(*FILE, F.lag("file_no").over(w).alias("prev_no"), F.lag("fields").over(w).alias("before"), "fields", F.sha2(F.to_json("fields"), 256).alias("fingerprint"))


def _candidates(schemas: DataFrame) -> DataFrame:
    """A row per step: the fields that vanish, appear, or stay with another type."""
    old, new = F.map_keys("before"), F.map_keys("fields")
    return schemas.where("prev_no IS NOT NULL").select(
        *FILE, "prev_no", F.array_except(old, new).alias("gone"), F.array_except(new, old).alias("come"),
        F.filter(F.array_intersect(old, new), lambda p: F.element_at("before", p) != F.element_at("fields", p)).alias("retyped"))


def renames(raw: DataFrame, steps: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo, artifact, file_no, field_path, new_path) that the values prove.

    Pairs of fields are found by an equal join on step, record id and value, so only fields that
    share a value somewhere are counted further; how many ids hold both then comes from the distinct
    paths of each id, which are bounded by the schema.
    """
    step = ["repo", "artifact", "step_no"]
    open_steps = steps.where((F.size("gone") > 0) & (F.size("come") > 0))
    side = lambda no, later, wanted: F.struct(F.col(no).alias("file_no"), F.lit(later).alias("later"), F.col(wanted).alias("wanted"))
    sides = open_steps.select("repo", "artifact", F.col("file_no").alias("step_no"), F.explode(F.array(side("prev_no", False, "gone"), side("file_no", True, "come"))).alias("s")).select(*step, "s.*")
    own = raw.select(*FILE, "payload")
    rows = with_fields(checked_join(own, sides, FILE, "inner", ["payload"]), depth or nesting_depth(own))
    rec_id = F.try_element_at(F.filter("_fields", lambda f: f["path"] == "id"), F.lit(1))["value"]
    picked = rows.select(*step, "later", rec_id.alias("rec_id"), F.explode(F.filter("_fields", lambda f: F.array_contains("wanted", f["path"]))).alias("f")).where("rec_id IS NOT NULL")
    plain = picked.select(*step, "later", comparable(F.col("rec_id")).alias("rec_id"), F.col("f.path").alias("path"), comparable(F.col("f.value")).alias("v"))
    values = materialize(plain.select(*step, "later", "rec_id", "path", F.xxhash64("v").alias("h"), F.hash("v").alias("h2")).distinct(), "drift-values")
    half = lambda later, name: values.where(F.col("later") == later).select(*step, "rec_id", F.col("path").alias(name), "h", "h2")
    equal = half(False, "field_path").join(half(True, "new_path"), [*step, "rec_id", "h", "h2"]).select(*step, "rec_id", "field_path", "new_path").distinct()
    shared = materialize(equal.groupBy(*step, "field_path", "new_path").agg(F.count(F.lit(1)).alias("equal")), "drift-pairs")
    by_step = shared.groupBy(*step).agg(F.collect_list(F.struct("field_path", "new_path")).alias("pairs"))
    paths = values.groupBy(*step, "rec_id").agg(F.collect_set(F.when(~F.col("later"), F.col("path"))).alias("olds"), F.collect_set(F.when(F.col("later"), F.col("path"))).alias("news")).where((F.size("olds") > 0) & (F.size("news") > 0))
    held = checked_join(paths, by_step, step, "inner", ["rec_id"]).select(*step, F.explode(F.filter("pairs", lambda p: F.array_contains("olds", p["field_path"]) & F.array_contains("news", p["new_path"]))).alias("p"))
    both = held.groupBy(*step, F.col("p.field_path").alias("field_path"), F.col("p.new_path").alias("new_path")).agg(F.count(F.lit(1)).alias("both"))
    return shared.join(both, [*step, "field_path", "new_path"]).where("2 * equal > both").select("repo", "artifact", F.col("step_no").alias("file_no"), "field_path", "new_path")


def schema_changes(raw: DataFrame, schemas: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(repo, artifact, file_no, change, field_path, new_path): the steps of every series of files.

    raw has repo, artifact, file_no and payload. schemas: its file_schemas, if they are known.
    """
    depth = depth or nesting_depth(raw)
    steps = materialize(_candidates(file_schemas(raw, depth) if schemas is None else schemas), "drift-steps")
    moved = renames(raw, steps, depth).groupBy(*FILE).agg(F.collect_set(F.struct("field_path", "new_path")).alias("moved"))
    joined = steps.join(moved, FILE, "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<struct<field_path:string,new_path:string>>")))
    row = lambda change, path, new: F.struct(F.lit(change).alias("change"), path.alias("field_path"), new.alias("new_path"))
    left = F.array_except("gone", F.col("moved.field_path"))
    right = F.array_except("come", F.col("moved.new_path"))
    rows = F.concat(
        F.transform("moved", lambda m: row("renamed", m["field_path"], m["new_path"])), F.transform(left, lambda p: row("removed", p, F.lit(""))),
        F.transform(right, lambda p: row("added", p, F.lit(""))), F.transform("retyped", lambda p: row("type_changed", p, F.lit(""))))
    return joined.select(*FILE, F.explode(rows).alias("c")).select(*FILE, "c.*")


def migration_routes(schemas: DataFrame, changes: DataFrame, target: list[str]) -> DataFrame:
    """(repo, artifact, file_no, version, fingerprint, routes map<path, target or own path>) per file.

    Renames are chained over the files of a series; a chain goes to the target field that any of its
    names is, a name that is a target itself to that one. A name that comes back while its successor
    is still there begins a new chain. version counts the distinct schemas of a series. One task gets
    the steps of one series, which has a row per file and change, never a record.
    """
    log = changes.where("change = 'renamed'").groupBy(*FILE).agg(F.collect_list(F.struct("field_path", "new_path")).alias("moved"))
    files = schemas.select(*FILE, "fingerprint", F.map_keys("fields").alias("paths")).join(log, FILE, "left").select(*FILE, "fingerprint", "paths", F.transform("moved", lambda m: m["field_path"]).alias("olds"), F.transform("moved", lambda m: m["new_path"]).alias("news"))

    def chain(series: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, int] = {}
        names: list[set[str]] = []
        seen: dict[str, int] = {}
        rows, version, last = [], 0, None
        ordered = series.sort_values("file_no")
        for paths, olds, news, mark in zip(ordered["paths"], ordered["olds"], ordered["news"], ordered["fingerprint"], strict=True):
            moved = {} if olds is None else dict(zip(news, olds, strict=True))
            now: dict[str, int] = {}
            here = list(paths) if paths is not None else []
            for p in here:  # fields that go on from the file before, under their old or a new name
                if moved.get(p, p) in root:
                    now[p] = root[moved.get(p, p)]
            for p in here:
                if p not in now:
                    back = seen.get(p)
                    if back is None or back in now.values():
                        back = len(names)
                        names.append(set())
                    now[p] = back
                names[now[p]].add(p)
                seen[p] = now[p]
            root = now
            if mark != last:
                version, last = version + 1, mark
            rows.append((version, mark, now))
        goal = [min((t for t in n if t in wanted), default=None) for n in names]
        out = ordered[["repo", "artifact", "file_no"]].reset_index(drop=True)
        out["version"] = [r[0] for r in rows]
        out["fingerprint"] = [r[1] for r in rows]
        out["routes"] = [{p: p if p in wanted else goal[c] or p for p, c in r[2].items()} for r in rows]
        return out

    wanted = set(target)
    return files.groupBy("repo", "artifact").applyInPandas(chain, f"{_FILE_SCHEMA}, version bigint, fingerprint string, routes map<string,string>")


def _cast(value: Column, kind: str) -> tuple[Column, Column, Column]:
    """The value of a JSON text as kind, whether a cast was needed, and whether it changed the number; a one-element array is its element."""
    inner = F.regexp_extract(value, r"^\[([^,\[\]]*)\]$", 1)
    bare = F.when(inner != "", inner).otherwise(value)
    text = F.when(bare.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), bare, F.lit("}")), "$.v")).otherwise(bare)
    if kind.startswith("array"):
        return F.from_json(value, kind), F.lit(False), F.lit(False)
    if kind == "string":
        return text, (bare != value) | ~bare.startswith('"'), F.lit(False)
    was_cast, whole = (bare != value) | bare.startswith('"'), text.try_cast("bigint")
    if kind == "bigint":
        out = F.coalesce(whole, F.round(text.try_cast("double")).try_cast("bigint"))
        return out, was_cast, whole.isNull() & ~text.try_cast("decimal(38,18)").eqNullSafe(out.cast("decimal(38,18)"))
    out = text.try_cast(kind)
    if kind != "double":
        return out, was_cast, F.lit(False)
    return out, was_cast, text.rlike(r"^[+-]?\d{16,}$") & (whole.isNull() | ~out.try_cast("bigint").eqNullSafe(whole))


def unified(raw: DataFrame, artifact: str, target: dict[str, str], defaults: dict[str, object] | None = None, schemas: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """One consistent table of an artifact: record_id, repo, file_no, version, the target fields, rest, applied.

    target: dotted path -> Spark type; the column is the path with _ for dots. A field without a value
    that fits takes its default, else null. Of several fields of a record that go to one target, the
    one of its own name counts, else the least path. rest: JSON texts of the fields routed to no
    target or that lost to another, and, by target path, of values that don't fit the type or were
    rounded. applied: the rename, conflict, cast, cast failed, rounded and default rules this record
    went through.
    """
    mine = raw.where(F.col("artifact") == artifact)
    depth = nesting_depth(mine)
    schemas = materialize(file_schemas(mine, depth), "drift-schemas") if schemas is None else schemas
    changes = schema_changes(mine, schemas, depth) if changes is None else changes
    routes = materialize(migration_routes(schemas, changes, list(target)), "drift-routes")
    rows = checked_join(mine.select("record_id", *FILE, "payload"), routes, FILE, "left", ["record_id"])
    flat = with_fields(rows.select("record_id", *FILE, "version", "routes", "payload"), depth)
    to = lambda f: F.coalesce(F.try_element_at("routes", f["path"]), f["path"])
    routed = F.transform("_fields", lambda f: F.struct(to(f).alias("to"), (to(f) != f["path"]).alias("moved"), f["path"].alias("path"), f["value"].alias("value")))
    flat = flat.withColumn("_all", F.array_sort(routed)).withColumn("_mine", F.filter("_all", lambda x: x["to"].isin(list(target))))
    first = lambda x, i: (i == 0) | (F.try_element_at("_mine", i)["to"] != x["to"])
    entry = lambda key: lambda x: F.struct(x[key].alias("key"), x["value"].alias("value"))
    lost = F.filter("_mine", lambda x, i: (i > 0) & (F.try_element_at("_mine", i)["to"] == x["to"]))
    flat = flat.withColumns({"have": F.map_from_entries(F.transform(F.filter("_mine", first), entry("to"))), "_lost": lost})
    other = F.filter("_all", lambda x: ~x["to"].isin(list(target)))
    moves = F.transform(F.filter("_all", lambda x: x["moved"]), lambda x: F.concat(F.lit("rename "), x["path"], F.lit(" -> "), x["to"]))
    conflicts = F.transform("_lost", lambda x: F.concat(F.lit("conflict "), x["path"], F.lit(" -> "), x["to"]))
    flat = flat.select("record_id", *FILE, "version", "have", F.map_from_entries(F.concat(F.transform(other, entry("path")), F.transform("_lost", entry("path")))).alias("rest"), F.concat(F.array_sort(moves), conflicts).alias("renamed"))
    values, outs, states, columns, rules, odd = {}, {}, {}, [], [F.col("renamed")], []
    for i, (path, kind) in enumerate(target.items()):
        value = F.col(f"_value{i}")
        values[f"_value{i}"] = F.try_element_at("have", F.lit(path))
        outs[f"_out{i}"], was_cast, changed = _cast(value, kind)
        state = F.when(value.isNotNull() & F.col(f"_out{i}").isNull(), "cast failed").when(changed, "rounded").when(was_cast, "cast")
        states[f"_state{i}"] = state
        out, state = F.col(f"_out{i}"), F.col(f"_state{i}")
        rules.append(F.when(state.isNotNull(), F.array(F.concat(state, F.lit(f" {path} to {kind}")))))
        odd.append(F.struct(F.lit(path).alias("key"), F.when(state.isin("cast failed", "rounded"), value).alias("value")))
        if defaults and path in defaults:
            rules.append(F.when(out.isNull(), F.array(F.lit(f"default {path}"))))
            out = F.coalesce(out, F.lit(defaults[path]).cast(kind))
        columns.append(out.alias(path.replace(".", "_")))
    none = F.array().cast("array<string>")
    rest = F.map_concat("rest", F.map_from_entries(F.filter(F.array(*odd), lambda x: x["value"].isNotNull())))
    return flat.withColumns(values).withColumns(outs).withColumns(states).select("record_id", "repo", "file_no", "version", *columns, rest.alias("rest"), F.concat(*[F.coalesce(r, none) for r in rules]).alias("applied"))
