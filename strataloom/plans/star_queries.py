"""Queries of the metric operators over the star schema, with equivalent SQL.

Roles: a nation is a module, a region a slice, a customer a file, an order a function, a line item an
import of the supplier's nation by the customer's nation, a part a type, an order year a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import coupling, diff, graph, markers, metrics, projectors, rules, slices
from ..runtime import checked_join, materialize, read

# ---- building blocks -------------------------------------------------------------------------------


def _functions(spark: SparkSession, where: str) -> DataFrame:
    """An order as a function: complexity from its lines, file its customer, module the customer's nation."""
    lines = read(spark, where, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("cog"), F.sum("l_quantity").cast("bigint").alias("loc"))
    orders, customer, nation = (read(spark, where, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("file"), F.col("n_name").alias("module"), F.col("n_regionkey").alias("region"), F.lit("sql").alias("language"), F.year("o_orderdate").alias("year"), (1 + F.coalesce("n", F.lit(0))).alias("cyclomatic_complexity"), F.coalesce("cog", F.lit(0)).alias("cognitive_complexity"), F.coalesce("loc", F.lit(0)).alias("lines_of_code"))
    )


_FN = """fn AS (SELECT o_orderkey AS id, c_name AS file, n_name AS module, n_regionkey AS region, year(o_orderdate) AS year,
  1 + coalesce(n, 0) AS cc, coalesce(cog, 0) AS cog, coalesce(loc, 0) AS loc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS cog, CAST(trunc(sum(l_quantity)) AS BIGINT) AS loc FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""


def _trade(spark: SparkSession, where: str) -> DataFrame:
    """(src, dst, weight, parts, quantity) by nation key, one row per pair of different nations."""
    lines = read(spark, where, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    orders = read(spark, where, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = read(spark, where, "customer").select("c_custkey", "c_nationkey"), read(spark, where, "supplier").select("s_suppkey", "s_nationkey")
    # both ends are brought down to a nation before the lines are shuffled, once, by order
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("src"))
    sellers = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return checked_join(lines, sellers, ["l_suppkey"], "inner", ["l_orderkey"]).join(buyers, "l_orderkey").where("src <> dst").select("src", "dst", "l_partkey", "l_quantity")


def _named(edges: DataFrame, spark: SparkSession, where: str) -> DataFrame:
    """src and dst as nation names, with their regions."""
    nation = read(spark, where, "nation")
    side = lambda c: nation.select(F.col("n_nationkey").alias(c), F.col("n_name").alias(f"_{c}"), F.col("n_regionkey").alias(f"{c}_region"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").drop("src", "dst").withColumnsRenamed({"_src": "src", "_dst": "dst"})


def _weights(spark: SparkSession, where: str) -> DataFrame:
    return _named(coupling.dependency_edges(_trade(spark, where)), spark, where)


def _strong(spark: SparkSession, where: str) -> DataFrame:
    return coupling.percentile_normalise(_weights(spark, where), "weight").where("value >= 0.75")


_TRADE = """tr AS (SELECT a.n_name AS src, b.n_name AS dst, a.n_regionkey AS src_region, b.n_regionkey AS dst_region, l_partkey, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE c_nationkey <> s_nationkey),
ed AS (SELECT src, dst, src_region, dst_region, count(*) AS weight FROM tr GROUP BY ALL),
pr AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE percent_rank() OVER (ORDER BY weight) END AS value FROM ed),
st AS (SELECT * FROM pr WHERE value >= 0.75)"""


def _r(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# ---- queries ---------------------------------------------------------------------------------------


def q01(spark, where):
    return _functions(spark, where).select("id", "file", "module", "cyclomatic_complexity", "cognitive_complexity", "lines_of_code", X.risk_band("cyclomatic_complexity").alias("risk"), X.risk_band("cognitive_complexity", "cognitive").alias("cognitive_risk"))


def q02(spark, where):
    return metrics.module_metrics(_functions(spark, where), sets=True).select("module", "function_count", "file_count", "total_cyclomatic", "total_cognitive", "lines_of_code", _r("avg_cyclomatic"), _r("avg_cognitive"))


_TOKENS = r"[A-Za-z_]+|[0-9]+"
_PUNCT = r"[^A-Za-z0-9_\s]"


def q03(spark, where):
    docs = read(spark, where, "documents").where("text IS NOT NULL")
    words, marks = F.expr(rf"regexp_extract_all(text, r'({_TOKENS})', 1)"), F.expr(r"regexp_extract_all(text, r'([!-/:-@\[-^{-~])', 1)")
    h = docs.select("doc_id", words.alias("w"), marks.alias("p")).select("doc_id", F.size(F.array_distinct("p")).alias("n1"), F.size(F.array_distinct("w")).alias("n2"), F.size("p").alias("t1"), F.size("w").alias("t2"))
    s = h.select("doc_id", X.halstead("n1", "n2", "t1", "t2").alias("h"))
    return s.select("doc_id", "h.vocabulary", "h.length", _r("h.volume", "volume"), _r("h.difficulty", "difficulty"), F.round("h.effort", 2).alias("effort"), _r("h.time_to_implement", "time_to_implement"), _r("h.estimated_bugs", "estimated_bugs"))


def q04(spark, where):
    docs = read(spark, where, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_lines"), F.count_if(F.trim("line") == "").alias("blank_lines"), F.count_if(F.col("line").rlike(r"^\s*(#|//)")).alias("comment_lines"))


def q04b(spark, where):
    docs = read(spark, where, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", X.line_counts("text").alias("c")).select("doc_id", "c.*")


def q05(spark, where):
    return _weights(spark, where).select("src", "dst", "weight")


def q06(spark, where):
    return coupling.percentile_normalise(_weights(spark, where), "weight").select("src", "dst", "weight", _r("value"))


def _composite(spark, where):
    t = _trade(spark, where)
    agg = materialize(_named(t.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("p"), F.sum("l_quantity").alias("q")), spark, where), "trade")
    parts = {"import": agg.select("src", "dst", F.col("n").alias("value")), "call": agg.select("src", "dst", F.col("p").alias("value")), "type": agg.select("src", "dst", F.col("q").alias("value"))}
    return coupling.composite(parts)


def q07(spark, where):
    c = _composite(spark, where).withColumn("composite", F.round("composite", 6))
    return coupling.percentile_normalise(c, "composite").select("src", "dst", _r("import", "import_part"), _r("call", "call_part"), _r("type", "type_part"), "composite", _r("value"))


def _martin(spark, where):
    nation = read(spark, where, "nation").select(F.col("n_name").alias("module"))
    return coupling.martin_metrics(nation, _strong(spark, where))


def q08(spark, where):
    m = _martin(spark, where).select("module", "martin.*")
    return m.select("module", "ca", "ce", _r("instability"), _r("abstractness"), _r("distance_from_main_sequence", "distance"), X.stability_band("instability", "distance_from_main_sequence").alias("band"))


def q09(spark, where):
    e = _strong(spark, where).select("src", "dst", F.col("src_region").alias("src_slice"), F.col("dst_region").alias("dst_slice")).distinct()
    nation = read(spark, where, "nation")
    s = nation.groupBy(F.col("n_regionkey").alias("slice")).agg(F.count(F.lit(1)).alias("modules"))
    return slices.slice_independence(e, s).withColumn("independence", F.round("independence", 6))


def _health(spark, where):
    m = metrics.module_metrics(_functions(spark, where), sets=False)
    both = m.join(_martin(spark, where), "module", "right")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.withColumn("health", X.health(zero("function_count"), zero("total_cyclomatic"), zero("total_cognitive"), zero("lines_of_code"), F.col("martin.ca") + F.col("martin.ce")))


def q10(spark, where):
    return _health(spark, where).withColumn("health", F.round("health", 6)).select("module", "health", X.health_label("health").alias("label"), X.health_colour("health").alias("colour"))


def q11(spark, where):
    docs = read(spark, where, "code_files").select("record_id", "path")
    return docs.select("record_id", X.layer_of("path").alias("layer"))


def q12(spark, where):
    per = read(spark, where, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("symbols"), F.bool_or(F.col("l_returnflag") == "R").alias("wild"))
    k = per.withColumn("kind", X.import_kind("wild", "symbols"))
    return k.select("l_orderkey", "symbols", "kind", _r(X.import_score("kind", "symbols"), "score"))


def q13(spark, where):
    part = read(spark, where, "part").select(F.col("p_name").alias("from_module"), F.col("p_type").alias("import_path"), F.lit(False).alias("is_external"))
    mods = read(spark, where, "part").select(F.col("p_brand").alias("module")).unionByName(read(spark, where, "region").select(F.col("r_name").alias("module"))).unionByName(read(spark, where, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("module")))
    hits = coupling.resolve_imports(part, mods.distinct())
    return hits.groupBy(F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("import_path").alias("paths"))


RULES = [
    {"rule_id": "max-cc", "rule_name": "Complexity", "source": "functions", "field": "cyclomatic_complexity", "max": 7.0, "min": None, "scope": "function", "severity": "error", "exclude": []},
    {"rule_id": "min-loc", "rule_name": "Size", "source": "functions", "field": "lines_of_code", "max": 300.0, "min": 3.0, "scope": "function", "severity": "warning", "exclude": ["1*"]},
    {"rule_id": "avg-cc", "rule_name": "Average", "source": "modules", "field": "avg_cyclomatic", "max": 5.05, "min": None, "scope": "module", "severity": None, "exclude": ["NATION_1*"]},
    {"rule_id": "gone", "rule_name": "Gone", "source": "absent", "field": "x", "max": 1.0, "min": None, "scope": "module", "severity": None, "exclude": []},
]
EXCEPTIONS = [
    {"rule_id": "max-cc", "entity": "1", "value": None, "issue": "#1"}, {"rule_id": "max-cc", "entity": "2", "value": 1.0, "issue": "#2"}, {"rule_id": "max-cc", "entity": "3", "value": None, "issue": "#3"}, {"rule_id": "max-cc", "entity": "5", "value": 100.0, "issue": "#4"},
    {"rule_id": "max-cc", "entity": "nowhere", "value": None, "issue": "#5"}, {"rule_id": "min-loc", "entity": "7", "value": None, "issue": "#6"}, {"rule_id": "avg-cc", "entity": "nation-none", "value": None, "issue": "#7"}, {"rule_id": "gone", "entity": "x", "value": None, "issue": "#8"},
]


def _evaluated(spark, where):
    fns = _functions(spark, where)
    mods = metrics.module_metrics(fns, sets=False).withColumn("avg_cyclomatic", F.round("avg_cyclomatic", 6))
    values = rules.field_values_from_columns(fns, RULES, "functions", "id").unionByName(rules.field_values_from_columns(mods, RULES, "modules", "module"))
    return rules.evaluate(values, rules.rules_table(spark, RULES), rules.exceptions_table(spark, EXCEPTIONS), spark.createDataFrame([("functions",), ("modules",)], "source string"))


def q14(spark, where):
    return _evaluated(spark, where)["violations"]


def q14b(spark, where):
    return _evaluated(spark, where)["results"]


def q14c(spark, where):
    return _evaluated(spark, where)["summary"]


def q15(spark, where):
    return _evaluated(spark, where)["stale"]


def q16(spark, where):
    t = metrics.snapshot_totals(_functions(spark, where), ("year",))
    one = lambda y: t.where(F.col("year") == y).drop("year")
    d = diff.metric_deltas(one(1995), one(1996), ["total_functions", "total_cyclomatic", "total_cognitive", "avg_cyclomatic", "avg_cognitive"])
    return d.select("metric", _r("base"), _r("target"), _r("delta"), _r("percent_change"))


def q16b(spark, where):
    t = metrics.snapshot_totals(_functions(spark, where), ("module", "year")).select("module", "year", "avg_cyclomatic")
    p = t.groupBy("module").agg(F.max(F.when(F.col("year") == 1995, F.col("avg_cyclomatic"))).alias("b"), F.max(F.when(F.col("year") == 1996, F.col("avg_cyclomatic"))).alias("t"))
    return p.select("module", _r(diff.percent_change("b", "t"), "percent_change"), diff.status_of("b", "t", 0.01, 0.05).alias("status"))


def q17(spark, where):
    t = metrics.snapshot_totals(_functions(spark, where), ("file", "year")).select("file", "year", "total_functions")
    side = lambda y: t.where(F.col("year") == y)
    return diff.entity_diff(side(1995), side(1996), ["file"], ["total_functions"])


def q18(spark, where):
    return metrics.top_per_group(_functions(spark, where).select("module", "id", "cyclomatic_complexity"), ["module"], "cyclomatic_complexity", ["id"], 5)


def q18b(spark, where):
    return metrics.hotspots(_functions(spark, where).select("id", "module", "cyclomatic_complexity", "lines_of_code"), 5, 10)


def q19(spark, where):
    e = read(spark, where, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return e.select("event_id", X.number_at(F.col("doc"), "k").alias("k")).where("k IS NOT NULL")


def _marker_lines(spark, where):
    e = read(spark, where, "events")
    body = F.concat(F.lit("// "), F.upper("event_type"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("(#"), F.col("user_id").cast("string"), F.lit(")"))).otherwise(""), F.lit(": "), "props")
    return e.select(F.concat(F.lit("src/"), "event_type", F.lit(".rs")).alias("file"), F.lit(".rs").alias("ext"), F.col("event_id").alias("line"), body.alias("text"))


_MARKS = ("ERROR", "CLICK", "VIEW")


def q20(spark, where):
    i = markers.marker_items(_marker_lines(spark, where), _MARKS)
    return i.select("id", "tag", "file", "line", "column", "description", F.col("issue.number").alias("issue"))


def q21(spark, where):
    return markers.marker_summary(markers.marker_items(_marker_lines(spark, where), _MARKS))


def q22(spark, where):
    nation = read(spark, where, "nation").select(F.col("n_name").alias("module"))
    cells = coupling.matrix(nation, coupling.percentile_normalise(_weights(spark, where), "weight"))
    v = coupling.matrix_violations(cells, nation, symmetric=True)
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"), _r(F.sum(F.abs("value")), "size"))


def q22b(spark, where):
    nation = read(spark, where, "nation").select(F.col("n_name").alias("module"))
    return coupling.matrix(nation, coupling.percentile_normalise(_weights(spark, where), "weight"), directional=False).select("src", "dst", _r("value"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def q23(spark, where):
    c, nation = read(spark, where, "customer"), read(spark, where, "nation")
    view = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("slice"), F.col("c_mktsegment").alias("layer"), F.col("c_acctbal").alias("health"))
    m = slices.slice_layer_matrix(view, _SEGMENTS)
    return m.select("slice", *[F.col(f"count_{s}") for s in _SEGMENTS], *[_r(f"health_{s}") for s in _SEGMENTS])


def q24(spark, where):
    e = coupling.percentile_normalise(_weights(spark, where), "weight").withColumnsRenamed({"src_region": "src_slice", "dst_region": "dst_slice"})
    return slices.cluster_edges(e).select("a", "b", _r("strength"))


def q24b(spark, where):
    e = _weights(spark, where).withColumn("value", F.col("weight"))
    return slices.coupling_degree(e)


def q25(spark, where):
    return graph.neighbours(_weights(spark, where), "NATION_7")


def q25b(spark, where):
    e = _weights(spark, where).withColumn("value", F.col("weight"))
    return coupling.strongest_partner(e)


def q26(spark, where):
    e = read(spark, where, "events").select(F.col("user_id").alias("file_path"), F.col("event_type").alias("start_line"), F.struct("ts", "event_id").alias("seq"), "event_id")
    return metrics.dedupe_functions(e).select(F.col("file_path").alias("user_id"), F.col("start_line").alias("event_type"), "event_id")


def q27(spark, where):
    p = read(spark, where, "part")
    return p.where(~X.matches_any_glob("p_type", ["*BRASS", "S[MT]*", "ECONOMY?*TIN"])).select("p_partkey", "p_type")


def q28(spark, where):
    from ..streaming import daily_trend

    return daily_trend(read(spark, where, "events"))


def q29(spark, where):
    return graph.reachable_pairs(_strong(spark, where), 3)


def q29b(spark, where):
    return graph.cycle_members(_strong(spark, where).select("src", "dst"))


def q30(spark, where):
    nation = read(spark, where, "nation").select(F.col("n_name").alias("module"))
    return graph.layout(nation, coupling.percentile_normalise(_weights(spark, where), "weight"))


def q32(spark, where):
    return projectors.mermaid(_strong(spark, where).select("src", "dst", "value"), _martin(spark, where).select("module", F.col("martin.distance_from_main_sequence").alias("distance")))


# queries over the code tables


def c01(spark, where):
    f = read(spark, where, "code_functions").where("module IS NOT NULL").select("module", "file", "language", *[F.col(f"metrics.{m}") for m in ("cyclomatic_complexity", "cognitive_complexity", "lines_of_code")])
    return metrics.module_metrics(f).select("module", "function_count", "file_count", "total_cyclomatic", "total_cognitive", "lines_of_code", _r("avg_cyclomatic"), _r("avg_cognitive"), F.array_join("languages", ",").alias("languages"))


def c02(spark, where):
    n, e = read(spark, where, "call_graph_nodes"), read(spark, where, "call_graph_edges")
    home = n.where("id IS NOT NULL AND module IS NOT NULL").groupBy("repo", "snapshot_no", "id").agg(F.min("module").alias("module"))
    side = lambda c, m: home.select("repo", "snapshot_no", F.col("id").alias(c), F.col("module").alias(m))
    j = e.join(side("from_id", "src"), ["repo", "snapshot_no", "from_id"]).join(side("to_id", "dst"), ["repo", "snapshot_no", "to_id"])
    return j.where("src <> dst").groupBy("repo", "snapshot_no", "src", "dst").agg(F.count(F.lit(1)).alias("edges"), F.sum("call_count").alias("calls"))


def c03(spark, where):
    return read(spark, where, "call_graph_edges").groupBy("repo", "snapshot_no", "from_id", "to_id").agg(F.sum("call_count").alias("calls"), F.count(F.lit(1)).alias("edges"))


def c04(spark, where):
    f = read(spark, where, "code_functions").select("file", *[F.col(f"metrics.{m}") for m in ("cyclomatic_complexity", "cognitive_complexity", "lines_of_code", "comment_lines")], F.col("metrics.halstead.volume"))
    return metrics.file_metrics(f).select("file", "function_count", "total_cyclomatic", _r("avg_cyclomatic"), "max_cyclomatic", "total_cognitive", "max_cognitive", "lines_of_code", "comment_lines")


def c05(spark, where):
    return read(spark, where, "code_functions").select("record_id", X.slice_id("module").alias("slice"), X.slice_view("module", {"platform_sdk": 2}).alias("view_slice"), X.language_of("id").alias("prefix"), X.short_name("module").alias("short"))


def c06(spark, where):
    f = read(spark, where, "code_functions").where("start_line <= end_line").select(F.concat_ws("|", "repo", F.col("snapshot_no").cast("string"), "file").alias("file"), "start_line", "end_line", F.col("record_id").alias("id"))
    points = f.select("file", F.col("start_line").alias("line")).distinct()
    return metrics.enclosing_functions(points, f)


def c07(spark, where):
    m = read(spark, where, "code_modules")
    return m.select("record_id", X.stability_band("metrics.martin.instability", "metrics.martin.distance_from_main_sequence").alias("band"), X.health_label(X.health("metrics.function_count", "metrics.total_cyclomatic", "metrics.total_cognitive", "metrics.lines_of_code", F.col("metrics.martin.ca") + F.col("metrics.martin.ce"))).alias("label"))


def c08(spark, where):
    e = coupling.percentile_normalise(_weights(spark, where), "weight")
    return coupling.strongest_pairs(e).select("src", "dst", _r("value"))


def c09(spark, where):
    s = read(spark, where, "snapshots")
    h = s.select("repo", "snapshot_no", "seq", F.explode("hotspots").alias("h")).select("repo", "snapshot_no", "seq", "h.*").where("cyclomatic IS NOT NULL")
    return metrics.top_per_group(h, ["repo", "snapshot_no", "seq"], "cyclomatic", ["id"], 3).select("repo", "snapshot_no", "seq", "id", "cyclomatic", "rank").distinct()


QUERIES = {
    "c06_enclosing_functions": c06, "c07_module_bands": c07, "c08_strongest_pairs": c08, "c09_snapshot_hotspots": c09,
    "q01_function_metrics": q01, "q02_module_metrics": q02, "q03_halstead_documents": q03, "q04_line_counts": q04, "q04_line_state_fold": q04b, "q05_dependency_edges": q05, "q06_coupling_percentile": q06, "q07_composite_coupling": q07, "q08_martin": q08, "q09_slice_independence": q09, "q10_health": q10,
    "q11_layer_detect": q11, "q12_import_kind_score": q12, "q13_theta_resolve": q13, "q14_threshold_rules": q14, "q14_rule_results": q14b, "q14_rule_summary": q14c, "q15_exceptions_stale": q15, "q16_snapshot_diff": q16, "q16_diff_status": q16b, "q17_entity_diff": q17, "q18_hotspots_topk": q18, "q18_hotspots": q18b, "q19_json_field": q19, "q20_marker_scan": q20,
    "q21_marker_summary": q21, "q22_matrix_validate": q22, "q22_matrix_mirror": q22b, "q23_slice_layer_pivot": q23, "q24_cluster_edges": q24, "q24_coupling_degree": q24b, "q25_neighbours": q25, "q25_strongest_partner": q25b, "q26_dedupe_first": q26, "q27_glob_exclude": q27, "q28_daily_snapshots": q28, "q29_reachable": q29, "q29_cycles": q29b, "q30_layout": q30,
    "q32_mermaid": q32, "c01_code_module_metrics": c01, "c02_module_calls": c02, "c03_call_counts": c03, "c04_file_metrics": c04, "c05_slices": c05,
}


# ---- SQL -------------------------------------------------------------------------------------------

_LAYER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(w)}') THEN '{n}'" for n, w in X.LAYERS) + " WHEN contains(lower(path), 'examples') THEN 'examples' WHEN regexp_matches(lower(path), 'tests|test_') THEN 'tests' WHEN contains(lower(path), 'src') AND NOT contains(lower(path), 'adapter') THEN 'core' WHEN path IS NULL THEN 'other' ELSE 'other' END"
_MARTIN_SQL = """ca AS (SELECT dst AS module, count(DISTINCT src) AS ca FROM st GROUP BY 1), ce AS (SELECT src AS module, count(DISTINCT dst) AS ce FROM st GROUP BY 1),
ma AS (SELECT n_name AS module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0.5 END AS i
  FROM nation LEFT JOIN ca ON ca.module = n_name LEFT JOIN ce ON ce.module = n_name)"""
_SCORE_SQL = """hs AS (SELECT ma.module, coalesce(f, 0) AS f, coalesce(cc, 0) AS cc, coalesce(cog, 0) AS cog, coalesce(loc, 0) AS loc, ca + ce AS k, greatest(coalesce(f, 0), 1) AS n
  FROM ma LEFT JOIN (SELECT module, count(*) AS f, sum(cc) AS cc, sum(cog) AS cog, sum(loc) AS loc FROM fn GROUP BY 1) m ON m.module = ma.module),
he AS (SELECT module, round((CASE WHEN cc / n > 5 THEN greatest(0, 1 - (cc / n - 5) / 15) ELSE 1 END + greatest(0, 1 - cog / n / 30) + CASE WHEN loc / n > 50 THEN greatest(0, 1 - (loc / n - 50) / 100) ELSE 1 END
  + CASE WHEN k = 0 THEN 0.6 WHEN k > 20 THEN greatest(0.2, 1 - (k - 10) / 30) ELSE 1 END + CASE WHEN f < 2 THEN 0.5 WHEN f > 50 THEN greatest(0.3, 1 - (f - 30) / 70) ELSE 1 END) / 5.0, 6) AS health FROM hs)"""
_VIOLATION_SQL = f"""{_FN},
md AS (SELECT module, round(sum(cc) / count(*), 6) AS avg_cc FROM fn GROUP BY 1),
va AS (SELECT 'max-cc' AS rule_id, CAST(id AS VARCHAR) AS entity, 'cyclomatic_complexity' AS field, CAST(cc AS DOUBLE) AS actual, 7.0::DOUBLE AS mx, NULL::DOUBLE AS mn FROM fn
  UNION ALL SELECT 'min-loc', CAST(id AS VARCHAR), 'lines_of_code', CAST(loc AS DOUBLE), 300.0, 3.0 FROM fn WHERE CAST(id AS VARCHAR) NOT LIKE '1%'
  UNION ALL SELECT 'avg-cc', module, 'avg_cyclomatic', avg_cc, 5.05, NULL FROM md WHERE NOT starts_with(module, 'NATION_1')),
ex(rule_id, entity, budget) AS (VALUES ('max-cc', '1', NULL::DOUBLE), ('max-cc', '2', 1.0), ('max-cc', '3', NULL), ('max-cc', '5', 100.0), ('max-cc', 'nowhere', NULL), ('min-loc', '7', NULL), ('avg-cc', 'nation-none', NULL), ('gone', 'x', NULL)),
ju AS (SELECT va.*, CASE WHEN actual < mn THEN 'min' WHEN actual > mx THEN 'max' END AS direction, ex.entity IS NOT NULL AS named, budget FROM va LEFT JOIN ex ON va.rule_id = ex.rule_id AND va.entity = ex.entity),
vi AS (SELECT rule_id, entity, field, actual, CASE direction WHEN 'max' THEN mx ELSE mn END AS threshold, direction,
  named AND (budget IS NULL OR CASE direction WHEN 'max' THEN actual <= budget ELSE actual >= budget END) AS excepted FROM ju WHERE direction IS NOT NULL),
ru(rule_id, rule_name, severity, present) AS (VALUES ('max-cc', 'Complexity', 'error', true), ('min-loc', 'Size', 'warning', true), ('avg-cc', 'Average', 'error', true), ('gone', 'Gone', 'error', false)),
re AS (SELECT rule_id, rule_name, CASE WHEN NOT present THEN 'skip' WHEN count(*) FILTER (WHERE NOT excepted) = 0 THEN 'pass' WHEN severity = 'error' THEN 'fail' ELSE 'warn' END AS status, count(entity) AS n_violations, count(*) FILTER (WHERE excepted) AS exceptions_used
  FROM ru LEFT JOIN vi USING (rule_id) GROUP BY rule_id, rule_name, severity, present),
sa AS (SELECT rule_id, entity, 'now_passing' AS reason FROM ju WHERE named AND direction IS NULL
  UNION ALL SELECT rule_id, entity, 'entity_not_found' FROM ex WHERE rule_id <> 'gone' AND NOT EXISTS (SELECT 1 FROM ju WHERE ju.named AND ju.rule_id = ex.rule_id AND ju.entity = ex.entity))"""
_MARK_SQL = """ml AS (SELECT 'src/' || event_type || '.rs' AS file, event_id AS line, '// ' || upper(event_type) || CASE WHEN event_id % 3 = 0 THEN '(#' || user_id || ')' ELSE '' END || ': ' || props AS text FROM events),
mi AS (SELECT file, line, text, regexp_extract(substr(text, 3), '(ERROR|CLICK|VIEW)(\\(#(\\d+)\\))?:\\s*(.+)', 1) AS tag, try_cast(nullif(regexp_extract(substr(text, 3), '(ERROR|CLICK|VIEW)(\\(#(\\d+)\\))?:\\s*(.+)', 3), '') AS BIGINT) AS issue, trim(regexp_extract(substr(text, 3), '(ERROR|CLICK|VIEW)(\\(#(\\d+)\\))?:\\s*(.+)', 4)) AS description
  FROM ml WHERE regexp_matches(substr(text, 3), '(ERROR|CLICK|VIEW)(\\(#(\\d+)\\))?:\\s*(.+)'))"""
_ROUND = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)

SQL = {
    "q01_function_metrics": f"WITH {_FN} SELECT id, file, module, cc AS cyclomatic_complexity, cog AS cognitive_complexity, loc AS lines_of_code, CASE WHEN cc >= 51 THEN 'very_high' WHEN cc >= 21 THEN 'high' WHEN cc >= 11 THEN 'moderate' ELSE 'low' END AS risk, CASE WHEN cog >= 26 THEN 'very_high' WHEN cog >= 16 THEN 'high' WHEN cog >= 6 THEN 'moderate' ELSE 'low' END AS cognitive_risk FROM fn",
    "q02_module_metrics": f"WITH {_FN} SELECT module, count(*) AS function_count, count(DISTINCT file) AS file_count, CAST(sum(cc) AS BIGINT) AS total_cyclomatic, CAST(sum(cog) AS BIGINT) AS total_cognitive, CAST(sum(loc) AS BIGINT) AS lines_of_code, round(avg(cc), 6) AS avg_cyclomatic, round(avg(cog), 6) AS avg_cognitive FROM fn GROUP BY module",
    "q03_halstead_documents": """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_]+|[0-9]+') AS w, regexp_extract_all(text, '[!-/:-@\\[-^{-~]') AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(list_distinct(p)) AS n1, len(list_distinct(w)) AS n2, len(p) AS t1, len(w) AS t2 FROM t),
v AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2(greatest(n1 + n2, 1)) ELSE 0.0 END AS v, CASE WHEN n2 > 0 THEN n1 / 2.0 * (t2 / n2) ELSE 0.0 END AS d FROM c)
SELECT doc_id, CAST(n1 + n2 AS BIGINT) AS vocabulary, CAST(t1 + t2 AS BIGINT) AS length, round(v, 6) AS volume, round(d, 6) AS difficulty, round(d * v, 2) AS effort, round(d * v / 18, 6) AS time_to_implement, round(v / 3000, 6) AS estimated_bugs FROM v""",
    "q04_line_counts": "SELECT doc_id, count(*) AS total_lines, count(*) FILTER (WHERE trim(l, ' ') = '') AS blank_lines, count(*) FILTER (WHERE regexp_matches(l, '^\\s*(#|//)')) AS comment_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) GROUP BY doc_id",
    "q04_line_state_fold": """WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE list_transform(string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) END AS ls FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, len(ls) AS total, list_reduce(list_transform(ls, lambda x: {'c': 0, 'b': 0, 'g': 0, 'i': false, 't': x}), lambda a, x: {
  'c': a.c + CASE WHEN a.i OR starts_with(x.t, '/*') OR starts_with(x.t, '\"\"\"') OR starts_with(x.t, '//') OR starts_with(x.t, '#') THEN 1 ELSE 0 END,
  'b': a.b + CASE WHEN NOT a.i AND x.t = '' THEN 1 ELSE 0 END,
  'g': a.g + CASE WHEN NOT (a.i OR starts_with(x.t, '/*') OR starts_with(x.t, '\"\"\"') OR starts_with(x.t, '//') OR starts_with(x.t, '#')) AND x.t <> '' THEN 1 ELSE 0 END,
  'i': CASE WHEN a.i THEN NOT (ends_with(x.t, '*/') OR ends_with(x.t, '\"\"\"')) ELSE (starts_with(x.t, '/*') OR starts_with(x.t, '\"\"\"')) AND NOT (ends_with(x.t, '*/') OR ends_with(x.t, '\"\"\"')) END,
  't': x.t}, {'c': 0, 'b': 0, 'g': 0, 'i': false, 't': ''}) AS r FROM l)
SELECT doc_id, total, r.g AS logical, r.c AS comment, r.b AS blank FROM s""",
    "q32_mermaid": f"""WITH {_TRADE}, {_MARTIN_SQL}, n AS (SELECT '0' || module AS o, '    ' || module || '["' || module || '"]' || CASE WHEN abs(i - 1) > 0.6 THEN ':::danger' WHEN abs(i - 1) > 0.3 THEN ':::warning' ELSE '' END AS l FROM ma UNION ALL SELECT '1' || src || ' ' || dst, '    ' || src || ' -->|' || CAST(floor(value * 100) AS BIGINT) || '%| ' || dst FROM st WHERE src < dst)
SELECT 'flowchart TD' || chr(10) || '    classDef danger fill:#f66' || chr(10) || '    classDef warning fill:#fc6' || chr(10) || string_agg(l, chr(10) ORDER BY o) AS text FROM n""",
    "q05_dependency_edges": f"WITH {_TRADE} SELECT src, dst, weight FROM ed",
    "q06_coupling_percentile": f"WITH {_TRADE} SELECT src, dst, weight, round(value, 6) AS value FROM pr",
    "q07_composite_coupling": f"""WITH {_TRADE}, a AS (SELECT src, dst, count(*) AS n, count(DISTINCT l_partkey) AS p, sum(l_quantity) AS q FROM tr GROUP BY ALL),
s AS (SELECT src, dst, n / greatest(max(n) OVER (), 1) AS i, p / greatest(max(p) OVER (), 1) AS c, q / greatest(max(q) OVER (), 1) AS t FROM a), k AS (SELECT *, round(0.4 * i + 0.35 * c + 0.25 * t, 6) AS composite FROM s)
SELECT src, dst, round(i, 6) AS import_part, round(c, 6) AS call_part, round(t, 6) AS type_part, composite, round(CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE percent_rank() OVER (ORDER BY composite) END, 6) AS value FROM k WHERE composite > 0""",
    "q08_martin": f"WITH {_TRADE}, {_MARTIN_SQL} SELECT module, ca, ce, round(i, 6) AS instability, 0.0 AS abstractness, round(abs(i - 1), 6) AS distance, CASE WHEN abs(i - 1) > 0.5 THEN 'zone_of_pain' WHEN i < 0.3 THEN 'stable' WHEN i > 0.7 THEN 'unstable' ELSE 'balanced' END AS band FROM ma",
    "q09_slice_independence": f"""WITH {_TRADE}, s AS (SELECT n_regionkey AS slice, count(*) AS modules FROM nation GROUP BY 1),
o AS (SELECT src_region AS slice, count(*) FILTER (WHERE src_region = dst_region) AS internal, count(*) FILTER (WHERE src_region <> dst_region) AS "cross", count(DISTINCT CASE WHEN src_region <> dst_region THEN dst_region END) AS outbound_slices FROM st GROUP BY 1),
i AS (SELECT dst_region AS slice, count(DISTINCT CASE WHEN src_region <> dst_region THEN src_region END) AS inbound_slices FROM st GROUP BY 1)
SELECT s.slice, modules, coalesce(internal, 0) AS internal, coalesce("cross", 0) AS "cross", coalesce(outbound_slices, 0) AS outbound_slices, coalesce(inbound_slices, 0) AS inbound_slices, round(CASE WHEN coalesce(internal, 0) + coalesce("cross", 0) > 0 THEN internal / (internal + "cross") ELSE 1.0 END, 6) AS independence FROM s LEFT JOIN o ON s.slice = o.slice LEFT JOIN i ON s.slice = i.slice""",
    "q10_health": f"WITH {_FN}, {_TRADE}, {_MARTIN_SQL}, {_SCORE_SQL} SELECT module, health, CASE WHEN health >= 0.8 THEN 'Excellent' WHEN health >= 0.65 THEN 'Good' WHEN health >= 0.5 THEN 'OK' WHEN health >= 0.35 THEN 'Warning' WHEN health >= 0.2 THEN 'Poor' ELSE 'Critical' END AS label, CASE WHEN health >= 0.8 THEN '#00ff88' WHEN health >= 0.65 THEN '#44dd77' WHEN health >= 0.5 THEN '#88cc55' WHEN health >= 0.35 THEN '#ddaa33' WHEN health >= 0.2 THEN '#ff7744' ELSE '#ff3333' END AS colour FROM he",
    "q11_layer_detect": f"SELECT record_id, {_LAYER_SQL} AS layer FROM code_files",
    "q12_import_kind_score": """WITH a AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS symbols, bool_or(l_returnflag = 'R') AS wild FROM lineitem GROUP BY 1), k AS (SELECT *, CASE WHEN wild THEN 'wildcard' WHEN symbols > 1 THEN 'multi' WHEN symbols = 1 THEN 'single' ELSE 'module' END AS kind FROM a)
SELECT l_orderkey, symbols, kind, round(least(CASE kind WHEN 'wildcard' THEN 0.3 WHEN 'multi' THEN 0.7 WHEN 'single' THEN 1.0 ELSE 0.5 END * greatest(symbols, 1), 3.0), 6) AS score FROM k""",
    "q13_theta_resolve": """WITH m AS (SELECT p_brand AS module FROM part UNION SELECT r_name FROM region UNION SELECT split_part(p_type, ' ', 1) FROM part)
SELECT module, count(*) AS imports, count(DISTINCT p_type) AS paths FROM part JOIN m ON p_name <> module AND (contains(p_type, split_part(module, '::', -1)) OR contains(module, p_type) OR len(list_filter(string_split(p_type, '::'), lambda s: s <> '' AND contains(module, s))) > 0) GROUP BY module""",
    "q14_threshold_rules": f"WITH {_VIOLATION_SQL} SELECT * FROM vi",
    "q14_rule_results": f"WITH {_VIOLATION_SQL} SELECT * FROM re",
    "q14_rule_summary": f"WITH {_VIOLATION_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'warn') AS warned, CAST(sum(n_violations) AS BIGINT) AS violations, CAST(sum(exceptions_used) AS BIGINT) AS exceptions_used, (SELECT count(*) FROM sa) AS stale_exceptions FROM re",
    "q15_exceptions_stale": f"WITH {_VIOLATION_SQL} SELECT * FROM sa",
    "q16_snapshot_diff": f"""WITH {_FN}, t AS (SELECT year, count(*)::DOUBLE AS total_functions, sum(cc)::DOUBLE AS total_cyclomatic, sum(cog)::DOUBLE AS total_cognitive, avg(cc) AS avg_cyclomatic, avg(cog) AS avg_cognitive FROM fn WHERE year IN (1995, 1996) GROUP BY 1),
u AS (UNPIVOT t ON total_functions, total_cyclomatic, total_cognitive, avg_cyclomatic, avg_cognitive INTO NAME metric VALUE v),
p AS (SELECT metric, coalesce(max(v) FILTER (WHERE year = 1995), 0) AS base, coalesce(max(v) FILTER (WHERE year = 1996), 0) AS target FROM u GROUP BY 1)
SELECT metric, round(base, 6) AS base, round(target, 6) AS target, round(target - base, 6) AS delta, CASE WHEN base > 0 THEN round((target - base) / base * 100, 6) END AS percent_change FROM p""",
    "q16_diff_status": f"""WITH {_FN}, p AS (SELECT module, avg(cc) FILTER (WHERE year = 1995) AS b, avg(cc) FILTER (WHERE year = 1996) AS t FROM fn GROUP BY 1)
SELECT module, CASE WHEN b > 0 THEN round((t - b) / b * 100, 6) END AS percent_change, CASE WHEN t - b > 0.05 OR (t > 15 AND t > b) THEN 'error' WHEN t - b > 0.01 THEN 'warning' ELSE 'success' END AS status FROM p""",
    "q17_entity_diff": f"""WITH {_FN}, t AS (SELECT file, count(*) FILTER (WHERE year = 1995) AS b, count(*) FILTER (WHERE year = 1996) AS a FROM fn WHERE year IN (1995, 1996) GROUP BY 1)
SELECT file, CASE WHEN b = 0 THEN 'added' WHEN a = 0 THEN 'removed' ELSE 'modified' END AS change, nullif(b, 0) AS base_total_functions, nullif(a, 0) AS target_total_functions FROM t WHERE a <> b""",
    "q18_hotspots_topk": f"WITH {_FN} SELECT module, id, cc AS cyclomatic_complexity, row_number() OVER (PARTITION BY module ORDER BY cc DESC, id) AS rank FROM fn QUALIFY rank <= 5",
    "q18_hotspots": f"WITH {_FN} SELECT id, module, cc AS cyclomatic_complexity, loc AS lines_of_code FROM fn WHERE cc > 5 ORDER BY cc DESC, id LIMIT 10",
    "q19_json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')",
    "q20_marker_scan": f"WITH {_MARK_SQL} SELECT sha256(file || ':' || line || ':' || text) AS id, tag, file, line, 3 AS \"column\", description, issue FROM mi",
    "q21_marker_summary": f"""WITH {_MARK_SQL}, k AS (SELECT tag, file, coalesce(CAST(issue AS VARCHAR), 'null') AS issue, issue IS NOT NULL AS tracked FROM mi)
SELECT CASE grouping(tag, file, issue) WHEN 7 THEN 'all' WHEN 3 THEN 'tag' WHEN 5 THEN 'file' ELSE 'issue' END AS level, coalesce(tag, file, issue, '') AS key, count(*) AS total, count(*) FILTER (WHERE tracked) AS tracked, count(*) FILTER (WHERE NOT tracked) AS untracked FROM k GROUP BY GROUPING SETS ((), (tag), (file), (issue))""",
    "q22_matrix_validate": f"""WITH {_TRADE}, c AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, coalesce(max(value) FILTER (WHERE src < dst), 0) - coalesce(max(value) FILTER (WHERE src > dst), 0) AS d FROM pr GROUP BY 1, 2)
SELECT 'symmetry' AS rule, count(*) AS violations, round(sum(abs(d)), 6) AS size FROM c WHERE abs(d) > 1e-10 HAVING count(*) > 0""",
    "q22_matrix_mirror": f"WITH {_TRADE}, m AS (SELECT src, dst, value FROM pr UNION ALL SELECT dst, src, value FROM pr) SELECT src, dst, round(max(value), 6) AS value FROM m GROUP BY 1, 2 UNION ALL SELECT n_name, n_name, 1.0 FROM nation",
    "q23_slice_layer_pivot": "SELECT n_regionkey AS slice, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS \"count_{s}\", round(avg(c_acctbal) FILTER (WHERE c_mktsegment = '{s}'), 6) AS \"health_{s}\"" for s in _SEGMENTS) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "q24_cluster_edges": f"WITH {_TRADE} SELECT least(src_region, dst_region) AS a, greatest(src_region, dst_region) AS b, round(sum(value), 6) AS strength FROM pr WHERE src_region <> dst_region GROUP BY 1, 2",
    "q24_coupling_degree": f"WITH {_TRADE} SELECT module, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT src AS module, weight FROM ed UNION ALL SELECT dst, weight FROM ed) GROUP BY 1",
    "q25_neighbours": f"WITH {_TRADE} SELECT CASE WHEN src = 'NATION_7' THEN 'dependency' ELSE 'dependent' END AS direction, CASE WHEN src = 'NATION_7' THEN dst ELSE src END AS module, weight FROM ed WHERE src = 'NATION_7' OR dst = 'NATION_7'",
    "q25_strongest_partner": f"WITH {_TRADE} SELECT src, dst, weight AS value FROM ed QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1",
    "q26_dedupe_first": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "q27_glob_exclude": "SELECT p_partkey, p_type FROM part WHERE NOT (p_type LIKE '%BRASS' OR regexp_full_match(p_type, 'S[MT].*') OR regexp_full_match(p_type, 'ECONOMY..*TIN'))",
    "q28_daily_snapshots": """WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, events, total, events - lag(events) OVER (ORDER BY day) AS change, row_number() OVER (ORDER BY day DESC) AS age FROM d QUALIFY age <= 30""",
    "q29_reachable": f"""WITH RECURSIVE {_TRADE}, r(src, dst, hops) AS (SELECT src, dst, 1 FROM st UNION SELECT r.src, s.dst, r.hops + 1 FROM r JOIN st s ON r.dst = s.src WHERE r.hops < 3) SELECT src, dst, min(hops) AS hops FROM r GROUP BY 1, 2""",
    "q29_cycles": f"""WITH RECURSIVE {_TRADE}, r(src, dst) AS (SELECT src, dst FROM st UNION SELECT r.src, s.dst FROM r JOIN st s ON r.dst = s.src) SELECT DISTINCT src AS module FROM r WHERE src = dst""",
    "c01_code_module_metrics": "SELECT module, count(*) AS function_count, count(DISTINCT file) AS file_count, CAST(coalesce(sum(metrics.cyclomatic_complexity), 0) AS BIGINT) AS total_cyclomatic, CAST(coalesce(sum(metrics.cognitive_complexity), 0) AS BIGINT) AS total_cognitive, CAST(coalesce(sum(metrics.lines_of_code), 0) AS BIGINT) AS lines_of_code, round(coalesce(sum(metrics.cyclomatic_complexity), 0) / count(*), 6) AS avg_cyclomatic, round(coalesce(sum(metrics.cognitive_complexity), 0) / count(*), 6) AS avg_cognitive, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') AS languages FROM code_functions WHERE module IS NOT NULL GROUP BY module",
    "c02_module_calls": """WITH h AS (SELECT repo, snapshot_no, id, min(module) AS module FROM call_graph_nodes WHERE id IS NOT NULL AND module IS NOT NULL GROUP BY ALL)
SELECT e.repo, e.snapshot_no, a.module AS src, b.module AS dst, count(*) AS edges, CAST(sum(call_count) AS BIGINT) AS calls FROM call_graph_edges e JOIN h a ON a.repo = e.repo AND a.snapshot_no = e.snapshot_no AND a.id = from_id JOIN h b ON b.repo = e.repo AND b.snapshot_no = e.snapshot_no AND b.id = to_id WHERE a.module <> b.module GROUP BY ALL""",
    "c03_call_counts": "SELECT repo, snapshot_no, from_id, to_id, CAST(sum(call_count) AS BIGINT) AS calls, count(*) AS edges FROM call_graph_edges GROUP BY ALL",
    "c04_file_metrics": "SELECT file, count(*) AS function_count, CAST(coalesce(sum(metrics.cyclomatic_complexity), 0) AS BIGINT) AS total_cyclomatic, round(avg(metrics.cyclomatic_complexity), 6) AS avg_cyclomatic, max(metrics.cyclomatic_complexity) AS max_cyclomatic, CAST(coalesce(sum(metrics.cognitive_complexity), 0) AS BIGINT) AS total_cognitive, max(metrics.cognitive_complexity) AS max_cognitive, CAST(coalesce(sum(metrics.lines_of_code), 0) AS BIGINT) AS lines_of_code, CAST(coalesce(sum(metrics.comment_lines), 0) AS BIGINT) AS comment_lines FROM code_functions GROUP BY file",
    "c06_enclosing_functions": """WITH f AS (SELECT repo || '|' || snapshot_no || '|' || file AS file, start_line, end_line, record_id AS id FROM code_functions WHERE start_line <= end_line), p AS (SELECT DISTINCT file, start_line AS line FROM f)
SELECT p.file, p.line, max_by(id, row(start_line, -end_line, id)) AS id FROM p JOIN f ON p.file = f.file AND start_line <= line AND line <= end_line GROUP BY 1, 2""",
    "c07_module_bands": """WITH m AS (SELECT record_id, metrics.martin.instability AS i, metrics.martin.distance_from_main_sequence AS d, metrics.function_count AS f, metrics.total_cyclomatic AS cc, metrics.total_cognitive AS cog, metrics.lines_of_code AS loc, metrics.martin.ca + metrics.martin.ce AS k, greatest(metrics.function_count, 1) AS n FROM code_modules),
h AS (SELECT *, (CASE WHEN cc / n > 5 THEN greatest(0, 1 - (cc / n - 5) / 15) ELSE 1 END + greatest(0, 1 - cog / n / 30) + CASE WHEN loc / n > 50 THEN greatest(0, 1 - (loc / n - 50) / 100) ELSE 1 END + CASE WHEN k = 0 THEN 0.6 WHEN k > 20 THEN greatest(0.2, 1 - (k - 10) / 30) ELSE 1 END + CASE WHEN f < 2 THEN 0.5 WHEN f > 50 THEN greatest(0.3, 1 - (f - 30) / 70) ELSE 1 END) / 5.0 AS s FROM m)
SELECT record_id, CASE WHEN d > 0.5 THEN 'zone_of_pain' WHEN i < 0.3 THEN 'stable' WHEN i > 0.7 THEN 'unstable' ELSE 'balanced' END AS band, CASE WHEN s >= 0.8 THEN 'Excellent' WHEN s >= 0.65 THEN 'Good' WHEN s >= 0.5 THEN 'OK' WHEN s >= 0.35 THEN 'Warning' WHEN s >= 0.2 THEN 'Poor' ELSE 'Critical' END AS label FROM h""",
    "c08_strongest_pairs": f"WITH {_TRADE} SELECT src, dst, round(value, 6) AS value FROM pr WHERE value >= 0.5 AND src < dst ORDER BY value DESC, src, dst LIMIT 5",
    "c09_snapshot_hotspots": "SELECT DISTINCT repo, snapshot_no, seq, id, cyclomatic, rank FROM (SELECT repo, snapshot_no, seq, h.id AS id, h.cyclomatic AS cyclomatic, row_number() OVER (PARTITION BY repo, snapshot_no, seq ORDER BY h.cyclomatic DESC, h.id) AS rank FROM (SELECT repo, snapshot_no, seq, unnest(hotspots) AS h FROM snapshots) WHERE h.cyclomatic IS NOT NULL) WHERE rank <= 3",
    "c05_slices": """SELECT record_id, CASE WHEN contains(module, '/') THEN array_to_string(string_split(module, '/')[1:2], '/') WHEN contains(module, '::') THEN array_to_string(string_split(module, '::')[1:2], '::') ELSE array_to_string(string_split(module, '.')[1:2], '.') END AS slice,
  CASE WHEN contains(module, '::') THEN CASE WHEN split_part(module, '::', 1) = 'platform_sdk' AND len(string_split(module, '::')) >= 2 THEN split_part(module, '::', 2) ELSE array_to_string(string_split(module, '::')[1:2], '::') END WHEN contains(module, '/') THEN array_to_string(string_split(module, '/')[1:2], '/') ELSE array_to_string(string_split(module, '.')[1:2], '.') END AS view_slice, split_part(id, ':', 1) AS prefix, string_split(module, '::')[-1] AS short FROM code_functions""",
}
