"""Threshold rules over any JSON artifact or table, with excepted entities and stale exceptions.

Rules and exceptions are small tables that are joined to the entity values; one lazy plan gives
violations, rule results and stale exceptions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..runtime import checked_join

RULES = "rule_id string, rule_name string, source string, field string, max double, min double, scope string, severity string, exclude array<string>"
EXCEPTIONS = "rule_id string, entity string, value double, targets array<string>, issue string"
#: scope -> key that holds the entities
WRAPPERS = {"function": "functions", "module": "modules", "file": "files", "slice": "slices"}


def check_rules(rules: list[dict]) -> list[str]:
    """What is wrong with each rule: an id, a source, a field and at least one bound are needed."""
    out = []
    for r in rules:
        name = r.get("id") or r.get("rule_id") or "?"
        out += [f"{name}: no {k}" for k in ("source", "field") if not r.get(k)]
        if r.get("max") is None and r.get("min") is None:
            out.append(f"{name}: neither max nor min")
    return out


def entities(artifacts: DataFrame, scope: str, limit: int | None = None) -> DataFrame:
    """(source, entity, value variant) of JSON documents (source, doc variant).

    An object's array under the key of the scope holds the entities, else its only array; an object
    without either is a map of entities; a top array holds entities. Array items are named by the
    first of id, path, name, entity that is there, and dropped if that is no string.
    """
    kind = F.schema_of_variant("doc")
    top = artifacts.withColumn("_kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("other"))
    from_array = top.where("_kind = 'array'").select("source", F.col("doc").alias("_items"))
    keyed = top.where("_kind = 'object'").select("source", "doc").lateralJoin(artifacts.sparkSession.tvf.variant_explode(F.col("doc").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value")))
    is_array = F.schema_of_variant("_value").startswith("ARRAY")
    wrapper = WRAPPERS.get(scope)
    choice = keyed.groupBy("source").agg(F.count_if(is_array).alias("_arrays"), F.bool_or(is_array & (F.col("_key") == F.lit(wrapper))).alias("_wrapped"))
    marked = keyed.join(choice, "source")
    wrapped = F.coalesce("_wrapped", F.lit(False))
    items = marked.where(is_array & ((wrapped & (F.col("_key") == F.lit(wrapper))) | (~wrapped & (F.col("_arrays") == 1)))).select("source", F.col("_value").alias("_items"))
    flat = marked.where(~wrapped & (F.col("_arrays") != 1)).select("source", F.col("_key").alias("entity"), F.col("_value").alias("value"))
    listed = from_array.unionByName(items)
    exploded = listed.lateralJoin(artifacts.sparkSession.tvf.variant_explode(F.col("_items").outer()).select(F.col("value").alias("value")))
    names = [F.try_variant_get("value", f"$.{k}", "variant") for k in ("id", "path", "name", "entity")]
    first = F.coalesce(*names)
    name = F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string"))
    return flat.unionByName(exploded.select("source", name.alias("entity"), "value").where("entity IS NOT NULL"))


def field_values(values: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, entity, actual): the numeric field of each rule, for the entities of its source and scope.

    values: source, entity, value variant. Excluded entities and those without a number are left out.
    """
    parts = []
    for r in rules:
        own = values.where(F.col("source") == r["source"])
        if r.get("exclude"):
            own = own.where(~X.matches_any_glob("entity", list(r["exclude"])))
        parts.append(own.select(F.lit(r["rule_id"]).alias("rule_id"), "entity", X.number_at(F.col("value"), r["field"]).alias("actual")).where("actual IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def field_values_from_columns(metrics: DataFrame, rules: list[dict], source: str, entity: str) -> DataFrame:
    """As field_values, of a table with a column per field: one scan and one unpivot for all rules of the source."""
    own = [r for r in rules if r["source"] == source]
    cells = []
    for r in own:
        keep = ~X.matches_any_glob(entity, list(r["exclude"])) if r.get("exclude") else F.lit(True)
        cells.append(F.when(keep & F.col(r["field"]).isNotNull(), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.col(entity).cast("string").alias("entity"), F.col(r["field"]).cast("double").alias("actual"))))
    return metrics.select(F.explode(F.array(*cells)).alias("x")).where("x IS NOT NULL").select("x.*")


def evaluate(values: DataFrame, rules: DataFrame, exceptions: DataFrame, sources: DataFrame | None = None, default_severity: str = "error") -> dict[str, DataFrame]:
    """violations, results, stale and summary.

    values: rule_id, entity, actual. sources: source of the artifacts that exist; rules of others are
    skipped, without stale exceptions. A value is violated above max or below min; if both, min is
    reported. An exception without a value always holds, else up to its value on the violated side.
    """
    present = rules if sources is None else rules.join(sources.select("source").distinct(), "source", "left_semi")
    bounds = present.select("rule_id", "field", "max", "min")
    judged = checked_join(values, bounds, ["rule_id"], "inner", ["entity"])
    side = F.when(F.col("actual") < F.col("min"), "min").when(F.col("actual") > F.col("max"), "max")
    excused = exceptions.select("rule_id", "entity", F.col("value").alias("budget"), F.lit(True).alias("named"))
    judged = checked_join(judged.withColumn("direction", side), excused, ["rule_id", "entity"], "left", ["actual"])
    named = F.coalesce("named", F.lit(False))
    within = F.when(F.col("budget").isNull(), True).when(F.col("direction") == "max", F.col("actual") <= F.col("budget")).otherwise(F.col("actual") >= F.col("budget"))
    violations = judged.where("direction IS NOT NULL").select("rule_id", "entity", "field", "actual", F.when(F.col("direction") == "max", F.col("max")).otherwise(F.col("min")).alias("threshold"), "direction", (named & within).alias("excepted"))
    counts = violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_violations"), F.count_if("excepted").alias("exceptions_used"), F.bool_or(~F.col("excepted")).alias("open"))
    skipped = F.lit(False) if sources is None else F.col("present").isNull()
    base = rules if sources is None else rules.join(sources.select("source").distinct().withColumn("present", F.lit(True)), "source", "left")
    severity = F.coalesce("severity", F.lit(default_severity))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    results = base.withColumn("skipped", skipped).join(counts, "rule_id", "left").select("rule_id", "rule_name", F.when(F.col("skipped"), "skip").when(~F.coalesce("open", F.lit(False)), "pass").when(severity == "error", "fail").otherwise("warn").alias("status"), zero("n_violations"), zero("exceptions_used"))
    passing = judged.where(F.col("direction").isNull() & named).select("rule_id", "entity").distinct()
    matched = judged.where(named).select("rule_id", "entity").distinct()
    evaluated = exceptions.select("rule_id", "entity").distinct().join(present.select("rule_id").distinct(), "rule_id", "left_semi")
    lost = evaluated.join(matched, ["rule_id", "entity"], "left_anti")
    stale = passing.withColumn("reason", F.lit("now_passing")).unionByName(lost.withColumn("reason", F.lit("entity_not_found")))
    return {"violations": violations, "results": results, "stale": stale, "summary": summary(results, stale)}


def summary(results: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: total, passed, failed, warned, violations, exceptions_used, stale_exceptions; skipped rules count in total only."""
    a = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warn").alias("warned"), F.coalesce(F.sum("n_violations"), F.lit(0)).alias("violations"), F.coalesce(F.sum("exceptions_used"), F.lit(0)).alias("exceptions_used"))
    return a.withColumn("_one", F.lit(1)).join(stale.agg(F.count(F.lit(1)).alias("stale_exceptions")).withColumn("_one", F.lit(1)), "_one").drop("_one")


def ratchet(exceptions: DataFrame, violations: DataFrame) -> DataFrame:
    """Exceptions whose budgets may only tighten: the actual value if nearer to the bound; those without violation go."""
    v = violations.select("rule_id", "entity", "actual", "direction")
    tight: Column = F.when(F.col("value").isNull(), F.col("actual")).when(F.col("direction") == "max", F.least("value", "actual")).otherwise(F.greatest("value", "actual"))
    return exceptions.join(v, ["rule_id", "entity"]).select("rule_id", "entity", tight.alias("value"), "targets", "issue")


def exit_code(results: DataFrame) -> int:
    return int(results.where("status = 'fail'").limit(1).count())


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in RULES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rules], RULES)


def exceptions_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in EXCEPTIONS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EXCEPTIONS)
