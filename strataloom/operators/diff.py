"""Differences between two snapshots of metrics, their status, and gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

# ---- fixed values ----
ERROR_DELTA, WARNING_DELTA, ERROR_LEVEL = 5.0, 2.0, 15.0
# ---- end of fixed values ----


def percent_change(base: Column | str, target: Column | str) -> Column:
    b, t = (F.col(c) if isinstance(c, str) else c for c in (base, target))
    return F.when(b > 0, (t - b) / b * 100)


def metric_deltas(base: DataFrame, target: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, base, target, delta, percent_change) of two one-row tables of totals."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*")
    both = long(base, "base").join(long(target, "target"), "metric", "full_outer")
    b, t = F.coalesce("base", F.lit(0.0)), F.coalesce("target", F.lit(0.0))
    return both.select("metric", b.alias("base"), t.alias("target"), (t - b).alias("delta"), percent_change(b, t).alias("percent_change"))


def status_of(base: Column | str, target: Column | str, warning: float = WARNING_DELTA, error: float = ERROR_DELTA, level: float = ERROR_LEVEL) -> Column:
    """error, warning or success by the change of an average complexity."""
    b, t = (F.col(c) if isinstance(c, str) else c for c in (base, target))
    d = t - b
    return F.when((d > error) | ((t > level) & (d > 0)), "error").when(d > warning, "warning").otherwise("success")


def snapshot_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """One row: status, summary counts, metrics, hotspots and violations of two one-row totals (snapshot_totals)."""
    prefix = lambda df, p: df.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    j = prefix(base, "b").join(prefix(target, "t"), "_one")
    n = F.col("t_total_functions") - F.col("b_total_functions")
    delta = F.col("t_avg_cyclomatic") - F.col("b_avg_cyclomatic")
    severe = delta > ERROR_DELTA
    hotspot = F.struct(F.lit("average").alias("id"), F.lit("COMPLEXITY_INCREASE").alias("type"), F.format_string("average complexity changed by %+.1f", delta).alias("reason"), F.when(severe, 3).otherwise(2).alias("severity"))
    violation = F.struct(F.lit("avg_cyclomatic_delta").alias("threshold"), delta.alias("value"), F.when(severe, F.lit(ERROR_DELTA)).otherwise(F.lit(WARNING_DELTA)).alias("limit"), F.when(severe, "ERROR").otherwise("WARNING").alias("severity"))
    metrics = F.map_from_entries(F.array(*[F.struct(F.lit(m).alias("key"), F.struct(F.col(f"b_{m}").cast("double").alias("base"), F.col(f"t_{m}").cast("double").alias("target"), (F.col(f"t_{m}") - F.col(f"b_{m}")).cast("double").alias("delta"), percent_change(f"b_{m}", f"t_{m}").alias("percent_change"))) for m in ("total_cyclomatic", "avg_cyclomatic", "total_cognitive", "avg_cognitive", "total_functions")]))
    only = lambda s: F.when(delta > WARNING_DELTA, F.array(s)).otherwise(F.filter(F.array(s), lambda _: F.lit(False)))
    return j.select(status_of("b_avg_cyclomatic", "t_avg_cyclomatic").alias("status"), F.greatest(n, F.lit(0)).alias("functions_added"), F.greatest(-n, F.lit(0)).alias("functions_removed"), F.lit(0).alias("functions_modified"), metrics.alias("metrics"), only(hotspot).alias("hotspots"), only(violation).alias("violations"))


def entity_diff(base: DataFrame, target: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """(keys.., change, base_.., target_..): added, removed or modified; one shuffle by key, nulls equal nulls."""
    tag = lambda df, side: df.select(*keys, F.lit(side).alias("_side"), F.struct(*compare).alias("_v"))
    one = tag(base, 0).unionByName(tag(target, 1)).groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_b"), F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_t"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_t").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_t")), "modified")
    return one.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", *[F.col(f"_b.{c}").alias(f"base_{c}") for c in compare], *[F.col(f"_t.{c}").alias(f"target_{c}") for c in compare])


def coupling_changes(base: DataFrame, target: DataFrame, least: float = 0.0) -> DataFrame:
    """(src, dst, base, target, delta) of edges whose value changed by more than least; missing edges are 0."""
    tag = lambda df, a, b: df.select("src", "dst", (F.col("value") * a).alias("_b"), (F.col("value") * b).alias("_t"))
    out = tag(base, 1, 0).unionByName(tag(target, 0, 1)).groupBy("src", "dst").agg(F.sum("_b").alias("base"), F.sum("_t").alias("target"))
    return out.withColumn("delta", F.col("target") - F.col("base")).where(F.abs("delta") > least)


def zone_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """(module, base_zone, target_zone) where the stability band differs. Both: module, instability, distance."""
    band = lambda df: df.select("module", X.stability_band("instability", "distance").alias("zone"))
    return entity_diff(band(base), band(target), ["module"], ["zone"]).select("module", "base_zone", "target_zone")


def new_hotspots(base: DataFrame, target: DataFrame, limit: float) -> DataFrame:
    """(id, base_value, target_value, type): entities above the limit now, not before. Both: id, value."""
    j = target.where(F.col("value") > limit).join(base.select("id", F.col("value").alias("base_value")), "id", "left")
    return j.where(F.coalesce("base_value", F.lit(0)) <= limit).select("id", "base_value", F.col("value").alias("target_value"), F.when(F.col("base_value").isNull(), "NEW_COMPLEX").otherwise("COMPLEXITY_INCREASE").alias("type"))


def module_hotspots(base_edges: DataFrame, target_edges: DataFrame, base_modules: DataFrame, target_modules: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, base_value, target_value, type) in the shape of new_hotspots: COUPLING_INCREASE with id "src -> dst" for
    edges (src, dst, value) whose value rose by more than least, and ZONE_OF_PAIN with the distances for modules
    (module, instability, distance) that came into that zone or are new in it."""
    rose = coupling_changes(base_edges, target_edges, least).where("delta > 0").select(F.concat("src", F.lit(" -> "), "dst").alias("id"), F.col("base").cast("double").alias("base_value"), F.col("target").cast("double").alias("target_value"), F.lit("COUPLING_INCREASE").alias("type"))
    distance = lambda df, name: df.select("module", F.col("distance").cast("double").alias(name))
    pain = zone_changes(base_modules, target_modules).where("target_zone = 'zone_of_pain'").join(distance(base_modules, "base_value"), "module", "left").join(distance(target_modules, "target_value"), "module", "left")
    return rose.unionByName(pain.select(F.col("module").alias("id"), "base_value", "target_value", F.lit("ZONE_OF_PAIN").alias("type")))


def change_class(delta: Column | str, degraded: float = 0.0, severe: float = 5.0) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.when(d < 0, "improved").when(d <= degraded, "unchanged").when(d <= severe, "degraded").otherwise("severe")


def check_gate(diff: DataFrame, warning: float = WARNING_DELTA, error: float = ERROR_DELTA, fail_on_warning: bool = False) -> DataFrame:
    """(errors, warnings, distinct_findings, exit_code) of snapshot_diff rows.

    The change itself and each listed violation count, so one regression counts twice; distinct_findings
    counts it once. exit_code: 1 with errors, 2 with warnings only, 0 else.
    """
    d = F.try_element_at("metrics", F.lit("avg_cyclomatic"))["delta"]
    listed = lambda s: F.size(F.filter("violations", lambda v: v["severity"] == s))
    e = F.when(d > error, 1).otherwise(0) + listed("ERROR")
    w = F.when((d > warning) & (d <= error), 1).otherwise(0) + listed("WARNING")
    code = F.when(e > 0, 1).when(w > 0, F.lit(1 if fail_on_warning else 2)).otherwise(0)
    return diff.select(e.alias("errors"), w.alias("warnings"), F.greatest(F.when(d > warning, 1).otherwise(0), F.size("violations")).alias("distinct_findings"), code.alias("exit_code"))


def ignore_paths(df: DataFrame, column: str, prefixes: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """df without rows whose path begins with a prefix or matches a glob."""
    out = df
    for p in prefixes:
        out = out.where(~F.startswith(F.col(column), F.lit(p)))
    return out.where(~X.matches_any_glob(column, list(globs))) if globs else out


def missing_artifacts(listing: DataFrame, expected: list[str]) -> DataFrame:
    """(path) of the expected files that listing (path) does not hold."""
    return listing.sparkSession.createDataFrame([(e,) for e in expected], "path string").join(listing.select("path").distinct(), "path", "left_anti")
