"""Slices: independence, layers, clusters, enriched module rows for views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def slice_independence(edges: DataFrame, slices: DataFrame) -> DataFrame:
    """(slice, modules, internal, cross, independence, outbound_slices, inbound_slices).

    edges: src_slice, dst_slice, one row per distinct module edge. slices: slice, modules.
    independence is internal over all edges that leave the slice's modules, 1.0 without edges.
    """
    sides = edges.select(F.explode(F.array(F.struct(F.col("src_slice").alias("slice"), F.col("dst_slice").alias("other"), F.lit(True).alias("out")), F.struct(F.col("dst_slice").alias("slice"), F.col("src_slice").alias("other"), F.lit(False).alias("out")))).alias("x")).select("x.*")
    own = F.col("slice") == F.col("other")
    agg = sides.groupBy("slice").agg(F.count_if(F.col("out") & own).alias("internal"), F.count_if(F.col("out") & ~own).alias("cross"), F.count_distinct(F.when(F.col("out") & ~own, F.col("other"))).alias("outbound_slices"), F.count_distinct(F.when(~F.col("out") & ~own, F.col("other"))).alias("inbound_slices"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = slices.join(agg, "slice", "left").select("slice", "modules", zero("internal"), zero("cross"), zero("outbound_slices"), zero("inbound_slices"))
    all_out = F.col("internal") + F.col("cross")
    return out.withColumn("independence", F.when(all_out > 0, F.col("internal") / all_out).otherwise(1.0))


def module_slices(edges: DataFrame, modules: DataFrame, rule: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with src_slice and dst_slice, slices with their number of modules), by slice_id of the module ids."""
    by = lambda c: X.slice_id(c) if rule is None else F.transform(F.array(F.col(c)), lambda _: rule)[0]
    pairs = edges.select("src", "dst").distinct().select("src", "dst", by("src").alias("src_slice"), by("dst").alias("dst_slice"))
    return pairs, modules.select("module").distinct().groupBy(by("module").alias("slice")).agg(F.count(F.lit(1)).alias("modules"))


def view_modules(modules: DataFrame) -> DataFrame:
    """Module rows with slice, layer, health, label and colour.

    modules: module, function_count, total_cyclomatic, total_cognitive, lines_of_code, and martin
    (a struct; instability and distance default to 0.5, counts to 0).
    """
    ca, ce = F.coalesce("martin.ca", F.lit(0)), F.coalesce("martin.ce", F.lit(0))
    score = X.health("function_count", "total_cyclomatic", "total_cognitive", "lines_of_code", ca + ce)
    out = modules.withColumns({"slice": X.slice_view("module"), "layer": X.layer_of("module"), "health": score, "instability": F.coalesce("martin.instability", F.lit(0.5)), "distance": F.coalesce("martin.distance_from_main_sequence", F.lit(0.5))})
    return out.withColumns({"health_label": X.health_label("health"), "health_colour": X.health_colour("health"), "distance_colour": X.distance_colour("distance"), "size": X.node_size("function_count")})


def view_index(view: DataFrame) -> DataFrame:
    """One row: modules, slices, avg_health."""
    return view.agg(F.count(F.lit(1)).alias("modules"), F.count_distinct("slice").alias("slices"), F.avg("health").alias("avg_health"))


def slice_layer_matrix(view: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """Per slice a count_ and health_ column for each layer; long form (slice, layer, modules, avg_health) if layers is None."""
    if layers is None:
        return view.groupBy("slice", "layer").agg(F.count(F.lit(1)).alias("modules"), F.avg("health").alias("avg_health"))
    return view.groupBy("slice").agg(*[x for name in layers for x in (F.count_if(F.col("layer") == name).alias(f"count_{name}"), F.avg(F.when(F.col("layer") == name, F.col("health"))).alias(f"health_{name}"))])


def feature_groups(view: DataFrame) -> DataFrame:
    """(slice, layer, feature, modules, avg_health)."""
    feature, short = X.feature_name("module", "layer")
    return view.withColumns({"feature": feature, "short": short}).groupBy("slice", "layer", "feature").agg(F.count(F.lit(1)).alias("modules"), F.avg("health").alias("avg_health"))


def cluster_edges(edges: DataFrame, fold: str = "sum") -> DataFrame:
    """(a, b, strength) between different slices, a < b. fold: sum or max of both directions, or upper (src < dst only)."""
    cross = edges.where("src_slice <> dst_slice")
    if fold == "upper":
        cross = cross.where("src < dst")
    best = F.max("value") if fold == "max" else F.sum("value")
    return cross.groupBy(F.least("src_slice", "dst_slice").alias("a"), F.greatest("src_slice", "dst_slice").alias("b")).agg(best.alias("strength"))


def clusters(view: DataFrame, edges: DataFrame) -> DataFrame:
    """(slice, modules, avg_health, coupling): coupling sums the edges to other slices."""
    folded = cluster_edges(edges)
    ends = folded.select(F.explode(F.array("a", "b")).alias("slice"), "strength").groupBy("slice").agg(F.sum("strength").alias("coupling"))
    return view.groupBy("slice").agg(F.count(F.lit(1)).alias("modules"), F.avg("health").alias("avg_health")).join(ends, "slice", "left").withColumn("coupling", F.coalesce("coupling", F.lit(0.0)))


def coupling_degree(edges: DataFrame) -> DataFrame:
    """(module, degree): the strengths of all edges at a module, strongest first when sorted by degree."""
    return edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("module"), "value").groupBy("module").agg(F.sum("value").alias("degree"))


def districts(modules: DataFrame) -> DataFrame:
    """(package, modules, lines_of_code): top packages by size."""
    return modules.groupBy(X.top_package("module").alias("package")).agg(F.count(F.lit(1)).alias("modules"), F.sum("lines_of_code").alias("lines_of_code")).orderBy(F.col("lines_of_code").desc(), "package")


def treemap(sizes: list[tuple[str, float]], width: float, height: float) -> list[tuple[str, float, float, float, float]]:
    """(name, x, y, w, h) by halving the total across the longer side; for a bounded list on the driver."""
    out: list[tuple[str, float, float, float, float]] = []
    todo = [(sorted(sizes, key=lambda s: (-s[1], s[0])), 0.0, 0.0, width, height)]
    while todo:
        items, x, y, w, h = todo.pop()
        if len(items) == 1:
            out.append((items[0][0], x, y, w, h))
        if len(items) < 2:
            continue
        total, part, k = sum(max(s, 1e-9) for _, s in items), 0.0, 0
        while k < len(items) - 1 and (k == 0 or part + max(items[k][1], 1e-9) <= total / 2):
            part += max(items[k][1], 1e-9)
            k += 1
        share = part / total
        if w >= h:
            todo += [(items[:k], x, y, w * share, h), (items[k:], x + w * share, y, w * (1 - share), h)]
        else:
            todo += [(items[:k], x, y, w, h * share), (items[k:], x, y + h * share, w, h * (1 - share))]
    return sorted(out)


def systems(edges: DataFrame, modules: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(systems with their modules, distinct unordered pairs of systems with an edge of at least least); a system is the first segment."""
    first = lambda c: F.element_at(F.split(c, r"::|[/.]"), 1)
    nodes = modules.groupBy(first("module").alias("system")).agg(F.count(F.lit(1)).alias("modules"))
    pairs = edges.where(F.col("value") >= least).select(first("src").alias("s"), first("dst").alias("d")).where("s <> d")
    return nodes, pairs.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct()
