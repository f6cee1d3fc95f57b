"""Queries of the operators that the star schema does not reach, over the code tables, each with equivalent SQL.

Syntax nodes are made of line items, source files of function rows, imports, calls and types of the
call graph; what an operator should give then follows from the tables and is written in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import coupling, diff, graph, markers, metrics, packages, rules, slices
from ..operators.extract import extract_sources
from ..runtime import materialize, read, table_path
from ..sources import readers, sinks
from ..streaming import changed_files, retained
from .star_queries import _LAYER_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _r(c, name: str | None = None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# ---- syntax nodes ----------------------------------------------------------------------------------

_LANGUAGES = ["rust", "python", "typescript"]
_KINDS = [*dict.fromkeys(k for table in (metrics.DECISION, metrics.NESTING, metrics.IGNORED) for kinds in table.values() for k in kinds), "+", "==", "&&", "return", "()", ".await", "identifier", "integer", "string", "path", "block"]


def _nodes(spark, where) -> DataFrame:
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    kind = pick(_KINDS, F.col("l_partkey") * 7 + F.col("l_linenumber"))
    text = F.when(F.col("l_linenumber") == 1, "_ => x").otherwise(F.concat(kind, (F.col("l_suppkey") % 5).cast("string")))
    return read(spark, where, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file"), (F.col("l_suppkey") % 2).cast("string").alias("function_key"), pick(_LANGUAGES, F.col("l_partkey")).alias("language"), kind.alias("kind"), text.alias("text"),
        (F.col("l_linenumber") % 4).cast("int").alias("nest_level"), (F.col("l_returnflag") == "R").alias("ignored"), (F.col("l_linestatus") == "O").alias("logical"))


_NODES = f"""kd AS (SELECT *, [{_list(_KINDS)}][(l_partkey * 7 + l_linenumber) % {len(_KINDS)} + 1] AS kind FROM lineitem),
nd AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, CAST(l_suppkey % 2 AS VARCHAR) AS function_key, [{_list(_LANGUAGES)}][l_partkey % 3 + 1] AS language, kind, CASE WHEN l_linenumber = 1 THEN '_ => x' ELSE kind || (l_suppkey % 5) END AS text,
  l_linenumber % 4 AS nest, l_returnflag = 'R' AS ignored, CAST(l_linestatus = 'O' AS INT) AS logical FROM kd)"""
_DECISION_SQL = " OR ".join(f"(language = '{x}' AND kind IN ({_list(metrics.DECISION[x])}))" for x in _LANGUAGES)
_LOGICAL_SQL = f"kind IN ({_list(metrics.LOGICAL_KINDS)})"


@query("x01_complexity", f"""WITH {_NODES}
SELECT file, function_key, CAST(1 + sum(CASE WHEN ({_DECISION_SQL}) AND {_LOGICAL_SQL} THEN logical WHEN {_DECISION_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS cyclomatic_complexity,
  CAST(sum(CASE WHEN ({_DECISION_SQL}) AND {_LOGICAL_SQL} THEN logical WHEN {_DECISION_SQL} THEN 1 + nest ELSE 0 END) AS BIGINT) AS cognitive_complexity FROM nd WHERE NOT ignored GROUP BY ALL""")
def complexity(spark, where):
    return metrics.complexity(_nodes(spark, where))


_R = metrics.RICH_RUST


@query("x01_complexity_rich", f"""WITH {_NODES}
SELECT file, function_key, CAST(1 + sum(CASE WHEN kind = 'match_arm' AND NOT starts_with(text, '_ =>') THEN 1 WHEN kind IN ({_list(_R["nested"] + _R["flat_cyclomatic"])}) THEN 1 WHEN {_LOGICAL_SQL} THEN logical ELSE 0 END) AS BIGINT) AS cyclomatic_complexity,
  CAST(sum(CASE WHEN kind IN ({_list(_R["nested"] + _R["cognitive_once"])}) THEN 1 + nest WHEN kind IN ({_list(_R["cognitive_flat"])}) THEN 1 WHEN {_LOGICAL_SQL} THEN logical ELSE 0 END) AS BIGINT) AS cognitive_complexity FROM nd GROUP BY ALL""")
def complexity_rich(spark, where):
    return metrics.complexity(_nodes(spark, where), "rich")


def _halstead_sql(operators: list[str], operands: list[str]) -> str:
    return f"""WITH {_NODES}, o AS (SELECT file, function_key, text, CASE WHEN kind IN ({_list(operators)}) THEN 1 WHEN kind IN ({_list(operands)}) AND text <> '' AND strlen(text) < 100 THEN 2 END AS o FROM nd),
c AS (SELECT file, function_key, count(DISTINCT text) FILTER (WHERE o = 1) AS n1, count(DISTINCT text) FILTER (WHERE o = 2) AS n2, count(*) FILTER (WHERE o = 1) AS t1, count(*) FILTER (WHERE o = 2) AS t2 FROM o WHERE o IS NOT NULL GROUP BY ALL),
v AS (SELECT *, (t1 + t2) * log2(n1 + n2) AS v, CASE WHEN n2 > 0 THEN n1 / 2.0 * (t2 / n2) ELSE 0.0 END AS d FROM c)
SELECT file, function_key, n1 + n2 AS vocabulary, t1 + t2 AS length, round(v, 6) AS volume, round(d, 6) AS difficulty, round(d * v, 4) AS effort, round(v / 3000, 6) AS estimated_bugs FROM v"""


def _halstead(spark, where, variant):
    return metrics.halstead_metrics(_nodes(spark, where), variant).select("file", "function_key", "halstead.vocabulary", "halstead.length", _r("halstead.volume", "volume"), _r("halstead.difficulty", "difficulty"), F.round("halstead.effort", 4).alias("effort"), _r("halstead.estimated_bugs", "estimated_bugs"))


@query("x02_halstead", _halstead_sql(metrics.OPERATORS, metrics.OPERANDS))
def halstead(spark, where):
    return _halstead(spark, where, "tree")


@query("x02_halstead_rich", _halstead_sql(metrics.RICH_OPERATORS, metrics.RICH_OPERANDS))
def halstead_rich(spark, where):
    return _halstead(spark, where, "rich")


# ---- extraction ------------------------------------------------------------------------------------


def _sources(spark, where) -> DataFrame:
    """A source file for each function row: k branches with two conditions, calls, an import of two symbols, a type."""
    f = read(spark, where, "code_functions").where(F.col("language").isin("rust", "python", "typescript"))
    n, k = F.col("record_id").cast("string"), (F.col("record_id") % 4).cast("int")
    text = lambda head, one, tail: F.concat(*head, F.repeat(F.lit(one), k), F.lit(tail))
    python = text([F.lit("from pkg.util import alpha, beta\n\nclass Kind"), n, F.lit(":\n    pass\n\ndef fn_"), n, F.lit("(a, b):\n")], "    if a > 1 and b > 2:\n        alpha(a)\n", "    return a\n")
    rust = text([F.lit("use crate::util::{alpha, beta};\n\npub struct Kind"), n, F.lit(";\n\npub fn fn_"), n, F.lit("(a: u32, b: u32) -> u32 {\n")], "    if a > 1 && b > 2 { alpha(a); }\n", "    a\n}\n")
    script = text([F.lit("import { alpha, beta } from './util';\n\nexport class Kind"), n, F.lit(" {}\n\nexport function fn_"), n, F.lit("(a: number, b: number) {\n")], "  if (a > 1 && b > 2) { alpha(a); }\n", "  return a;\n}\n")
    by = lambda r, p, t: F.when(F.col("language") == "rust", r).when(F.col("language") == "python", p).otherwise(t)
    return f.select(F.concat(F.lit("src/m"), n, by(F.lit(".rs"), F.lit(".py"), F.lit(".ts"))).alias("path"), by(rust, python, script).alias("content"))


_EXTRACT = """s AS (SELECT record_id AS n, record_id % 4 AS k, language, CASE language WHEN 'rust' THEN 'm' || record_id WHEN 'python' THEN 'src.m' || record_id ELSE 'src/m' || record_id END AS module, 'src/m' || record_id || CASE language WHEN 'rust' THEN '.rs' WHEN 'python' THEN '.py' ELSE '.ts' END AS file
  FROM code_functions WHERE language IN ('rust', 'python', 'typescript'))"""


# the parameter count is 0 for every function, as SURVEY T15 has it; in Python and TypeScript the function itself is a level of nesting
@query("x03_extract_functions", f"""WITH {_EXTRACT} SELECT language || ':' || module || '::fn_' || n AS id, 'fn_' || n AS name, file, module, language, CASE language WHEN 'python' THEN 6 ELSE 5 END AS start_line, 0 AS parameter_count,
  1 + 2 * k AS cyclomatic_complexity, CASE language WHEN 'rust' THEN 2 * k ELSE 3 * k END AS cognitive_complexity, CASE language WHEN 'python' THEN 2 * k + 2 ELSE k + 3 END AS lines_of_code, 0 AS comment_lines FROM s""")
def extract_functions(spark, where):
    f = extract_sources(_sources(spark, where))["functions"]
    return f.select("id", "name", "file", "module", "language", "start_line", "parameter_count", "cyclomatic_complexity", "cognitive_complexity", "lines_of_code", "comment_lines")


@query("x03_extract_imports", f"""WITH {_EXTRACT} SELECT module AS from_module, language, CASE language WHEN 'rust' THEN 'crate::util' WHEN 'python' THEN 'pkg.util' ELSE './util' END AS import_path, 2 AS n_symbols, 'multi' AS kind, language = 'python' AS is_external FROM s""")
def extract_imports(spark, where):
    return extract_sources(_sources(spark, where))["imports"].select("from_module", "language", "import_path", "n_symbols", "kind", "is_external")


@query("x03_extract_calls", f"WITH {_EXTRACT} SELECT module AS caller, 'alpha' AS callee, k AS calls FROM s WHERE k > 0")
def extract_calls(spark, where):
    return extract_sources(_sources(spark, where))["calls"].groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))


@query("x03_extract_types", f"WITH {_EXTRACT} SELECT module, 'Kind' || n AS name, false AS is_abstract FROM s")
def extract_types(spark, where):
    return extract_sources(_sources(spark, where))["types"].select("module", "name", "is_abstract")


# ---- coupling by import, call and type -------------------------------------------------------------


def _ends(spark, where) -> DataFrame:
    """(src, dst, callee, symbol) of the call graph's edges, by the text of the ids."""
    module = lambda c: F.regexp_extract(c, r"^[a-z]+:(.*)::[^:]*$", 1)
    e = read(spark, where, "call_graph_edges").where("from_id IS NOT NULL AND to_id IS NOT NULL")
    out = e.select(module("from_id").alias("src"), module("to_id").alias("dst"), F.regexp_replace("to_id", "^[a-z]+:", "").alias("callee"), F.regexp_extract("to_id", r"([^:]*)$", 1).alias("symbol"))
    return out.where("src <> '' AND dst <> ''")


def _modules(spark, where) -> DataFrame:
    return read(spark, where, "code_modules").where("id IS NOT NULL").select(F.col("id").alias("module")).distinct()


def _imports(spark, where) -> DataFrame:
    return _ends(spark, where).select(F.col("src").alias("from_module"), F.col("dst").alias("import_path"), F.lit(False).alias("is_external"), F.array("symbol").alias("symbols"), F.lit(1).alias("n_symbols"), F.lit("single").alias("kind"))


_ENDS = """en AS (SELECT * FROM (SELECT regexp_extract(from_id, '^[a-z]+:(.*)::[^:]*$', 1) AS src, regexp_extract(to_id, '^[a-z]+:(.*)::[^:]*$', 1) AS dst, regexp_replace(to_id, '^[a-z]+:', '') AS callee, regexp_extract(to_id, '([^:]*)$', 1) AS symbol
  FROM call_graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL) WHERE src <> '' AND dst <> ''),
mo AS (SELECT DISTINCT id AS module, string_split(id, '::')[-1] AS name FROM code_modules WHERE id IS NOT NULL)"""
_RESOLVED = f"""WITH {_ENDS}, fl AS (SELECT module, array_to_string(string_split_regex(module, '::|[/.]'), '/') AS p FROM mo), pa AS (SELECT DISTINCT dst, array_to_string(string_split_regex(dst, '::|[/.]'), '/') AS p FROM en),
hi AS (SELECT pa.dst AS path, arg_max(module, row(len(string_split(fl.p, '/')), module)) AS module FROM pa JOIN fl ON pa.p = fl.p OR starts_with(pa.p, fl.p || '/') GROUP BY 1),
re AS (SELECT en.src, hi.module AS dst, symbol FROM en JOIN hi ON en.dst = hi.path WHERE en.src <> hi.module)"""


@query("x04_import_coupling", _RESOLVED + " SELECT src, dst, count(*) AS weight, round(1.0 * count(*), 6) AS score, count(DISTINCT symbol) AS symbols, count(*) AS nested FROM re GROUP BY ALL")
def import_coupling(spark, where):
    found = materialize(coupling.resolve_imports(_imports(spark, where), _modules(spark, where), "spec"), "resolved")
    edges = coupling.dependency_edges(found, nested=True).select("src", "dst", "weight", F.size("imports").alias("nested"))
    score, symbols = coupling.import_coupling(found).withColumnRenamed("value", "score"), coupling.symbol_coupling(found).withColumnRenamed("value", "symbols")
    return edges.join(score, ["src", "dst"]).join(symbols, ["src", "dst"]).select("src", "dst", "weight", _r("score"), "symbols", "nested")


@query("x04_import_coupling_loose", f"""WITH {_ENDS}, pa AS (SELECT DISTINCT dst AS path FROM en),
hi AS (SELECT DISTINCT path, module FROM pa JOIN mo ON contains(path, name) OR contains(module, path) OR len(list_filter(string_split(path, '::'), lambda s: s <> '' AND contains(module, s))) > 0)
SELECT src, hi.module AS dst, count(*) AS imports FROM en JOIN hi ON en.dst = hi.path WHERE src <> hi.module GROUP BY ALL""")
def import_coupling_loose(spark, where):
    return coupling.import_counts(_imports(spark, where), _modules(spark, where))


_CALLS = f"""WITH {_ENDS}, ca AS (SELECT DISTINCT callee, CASE WHEN contains(callee, '::') THEN split_part(callee, '::', 1) END AS first FROM en),
hi AS (SELECT DISTINCT callee, module FROM ca JOIN mo ON callee = module OR callee = name OR first = name OR starts_with(callee, module) OR starts_with(callee, name || '::'))
SELECT src, hi.module AS dst, count(*) AS calls FROM en JOIN hi USING (callee) WHERE src <> hi.module GROUP BY ALL"""


def _calls(spark, where):
    return _ends(spark, where).select(F.col("src").alias("caller"), "callee")


@query("x05_call_coupling", _CALLS)
def call_coupling(spark, where):
    return coupling.resolve_calls(_calls(spark, where), _modules(spark, where))


@query("x05_call_coupling_large", _CALLS)
def call_coupling_large(spark, where):
    """As x05_call_coupling, by the joins for module lists that are not broadcast."""
    return coupling.resolve_calls(_calls(spark, where), _modules(spark, where), limit_bytes=0)


_TYPES = """WITH ty AS (SELECT name, min(id) AS dst FROM code_modules WHERE name IS NOT NULL AND id IS NOT NULL GROUP BY 1), fu AS (SELECT module, id FROM code_functions WHERE module IS NOT NULL AND id IS NOT NULL)
SELECT module AS src, dst, count(*) AS types FROM fu JOIN ty ON contains(fu.id, ty.name) AND fu.module <> ty.dst GROUP BY ALL"""


def _typed(spark, where, limit):
    functions = read(spark, where, "code_functions").where("module IS NOT NULL AND id IS NOT NULL").select("module", F.col("id").alias("qualified_name"))
    types = read(spark, where, "code_modules").where("name IS NOT NULL AND id IS NOT NULL").select("name", F.col("id").alias("module"))
    return coupling.resolve_types(functions, types, limit)


@query("x06_type_coupling", _TYPES)
def type_coupling(spark, where):
    return _typed(spark, where, 16 << 20)


@query("x06_type_coupling_large", _TYPES)
def type_coupling_large(spark, where):
    """As x06_type_coupling, by the pieces of each text that are as long as a name."""
    return _typed(spark, where, 0)


@query("x07_prefix_coupling", f"WITH {_ENDS} SELECT src, module AS dst, round(least(0.1 * count(*), 1.0), 6) AS value FROM en JOIN mo ON starts_with(dst, module) AND src <> module GROUP BY ALL")
def prefix_coupling(spark, where):
    return coupling.prefix_import_coupling(_imports(spark, where), _modules(spark, where)).select("src", "dst", _r("value"))


@query("x07_package_fan", f"""WITH {_ENDS}, c AS (SELECT array_to_string(string_split(src, '::')[1:2], '::') AS s, array_to_string(string_split(dst, '::')[1:2], '::') AS d FROM en)
SELECT package, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(ce) AS BIGINT) AS ce FROM (SELECT s AS package, 0 AS ca, 1 AS ce FROM c WHERE s <> d UNION ALL SELECT d, 1, 0 FROM c WHERE s <> d) GROUP BY 1""")
def package_fan(spark, where):
    return coupling.package_fan(_ends(spark, where))


@query("x08_martin_types", f"""WITH {_ENDS}, t AS (SELECT module, name, bool_or(metrics.parameter_count = 0) AS a FROM code_functions WHERE module IS NOT NULL GROUP BY ALL), tc AS (SELECT module, count(*) AS n, count(*) FILTER (WHERE a) AS b FROM t GROUP BY 1),
p AS (SELECT DISTINCT src, dst FROM en), ce AS (SELECT src AS module, count(*) AS ce FROM p GROUP BY 1), ca AS (SELECT dst AS module, count(*) AS ca FROM p GROUP BY 1),
m AS (SELECT mo.module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM mo LEFT JOIN ca USING (module) LEFT JOIN ce USING (module) LEFT JOIN tc USING (module)),
i AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0.5 END AS i, CASE WHEN n > 0 THEN b / n ELSE 0.0 END AS a FROM m)
SELECT module, ca, ce, round(i, 6) AS instability, round(a, 6) AS abstractness, round(abs(a + i - 1), 6) AS distance FROM i""")
def martin_types(spark, where):
    types = read(spark, where, "code_functions").where("module IS NOT NULL").select("module", "name", (F.col("metrics.parameter_count") == 0).alias("is_abstract"))
    m = coupling.martin_metrics(_modules(spark, where), _ends(spark, where), metrics.type_counts(types))
    return m.select("module", "martin.ca", "martin.ce", _r("martin.instability", "instability"), _r("martin.abstractness", "abstractness"), _r("martin.distance_from_main_sequence", "distance"))


@query("x09_change_coupling", """WITH d AS (SELECT DISTINCT repo || '|' || snapshot_no AS c, file FROM code_functions WHERE file IS NOT NULL AND repo IS NOT NULL AND snapshot_no IS NOT NULL), n AS (SELECT file, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS together FROM d a JOIN d b ON a.c = b.c AND a.file < b.file GROUP BY 1, 2)
SELECT file_a, file_b, together, round(together / least(x.n, y.n), 6) AS coupling FROM p JOIN n x ON x.file = file_a JOIN n y ON y.file = file_b""")
def change_coupling(spark, where):
    """Delivered snapshots stand for commits; every pair of files is a result of the operator."""
    f = read(spark, where, "code_functions").where("repo IS NOT NULL AND snapshot_no IS NOT NULL").select(F.concat_ws("|", "repo", F.col("snapshot_no").cast("string")).alias("commit"), "file")
    return metrics.change_coupling(f).select("file_a", "file_b", "together", _r("coupling"))


@query("x09_crate_modules", """WITH f AS (SELECT module, count(*) AS n, sum(metrics.lines_of_code) AS l FROM code_functions WHERE module IS NOT NULL GROUP BY 1), g AS (SELECT module, sum(metrics.lines_of_code) AS l FROM code_files WHERE module IS NOT NULL GROUP BY 1)
SELECT coalesce(f.module, g.module) AS module, coalesce(n, 0) AS function_count, CAST(greatest(coalesce(f.l, 0), coalesce(g.l, 0)) AS BIGINT) AS lines_of_code FROM f FULL JOIN g ON f.module = g.module""")
def crate_modules(spark, where):
    loc = F.col("metrics.lines_of_code")
    return metrics.crate_modules(read(spark, where, "code_functions").where("module IS NOT NULL").select("module", loc.alias("lines_of_code")), read(spark, where, "code_files").where("module IS NOT NULL").select("module", loc.alias("lines")))


# ---- slices and views ------------------------------------------------------------------------------


def _view(spark, where) -> DataFrame:
    """The greatest metrics of each module over its deliveries, as a view row."""
    big = lambda c, n: F.coalesce(F.max(f"metrics.{c}"), F.lit(0)).alias(n)
    m = read(spark, where, "code_modules").where("id IS NOT NULL").groupBy(F.col("id").alias("module")).agg(*[big(c, c) for c in ("function_count", "total_cyclomatic", "total_cognitive", "lines_of_code")], *[F.max(f"metrics.martin.{c}").alias(c) for c in ("ca", "ce", "instability", "distance_from_main_sequence")])
    return slices.view_modules(m.select("module", "function_count", "total_cyclomatic", "total_cognitive", "lines_of_code", F.struct("ca", "ce", "instability", "distance_from_main_sequence").alias("martin")))


_two = lambda c, sep: f"array_to_string(string_split({c}, '{sep}')[1:2], '{sep}')"
_SLICE_VIEW_SQL = f"CASE WHEN contains(module, '::') THEN CASE WHEN split_part(module, '::', 1) = 'crates' AND len(string_split(module, '::')) >= 2 THEN split_part(module, '::', 2) ELSE {_two('module', '::')} END WHEN contains(module, '/') THEN {_two('module', '/')} ELSE {_two('module', '.')} END"
_slice_id = lambda c: f"CASE WHEN contains({c}, '/') THEN {_two(c, '/')} WHEN contains({c}, '::') THEN {_two(c, '::')} ELSE {_two(c, '.')} END"
_BAND = lambda values: "CASE " + " ".join(f"WHEN health >= {b} THEN '{v}'" for b, v in values[:-1]) + f" ELSE '{values[-1][1]}' END"
_VIEW = f"""mm AS (SELECT id AS module, coalesce(max(metrics.function_count), 0) AS f, coalesce(max(metrics.total_cyclomatic), 0) AS cc, coalesce(max(metrics.total_cognitive), 0) AS cog, coalesce(max(metrics.lines_of_code), 0) AS loc, coalesce(max(metrics.martin.ca), 0) + coalesce(max(metrics.martin.ce), 0) AS k,
  coalesce(max(metrics.martin.instability), 0.5) AS instability, coalesce(max(metrics.martin.distance_from_main_sequence), 0.5) AS distance FROM code_modules WHERE id IS NOT NULL GROUP BY 1),
vw AS (SELECT *, greatest(f, 1) AS n, {_SLICE_VIEW_SQL} AS slice, {_LAYER_SQL.replace("path", "module")} AS layer, round((CASE WHEN cc / n > 5 THEN greatest(0, 1 - (cc / n - 5) / 15) ELSE 1 END + greatest(0, 1 - cog / n / 30) + CASE WHEN loc / n > 50 THEN greatest(0, 1 - (loc / n - 50) / 100) ELSE 1 END
  + CASE WHEN k = 0 THEN 0.6 WHEN k > 20 THEN greatest(0.2, 1 - (k - 10) / 30) ELSE 1 END + CASE WHEN f < 2 THEN 0.5 WHEN f > 50 THEN greatest(0.3, 1 - (f - 30) / 70) ELSE 1 END) / 5.0, 12) AS health FROM mm)"""


def _hex(value: str) -> str:
    return f"lpad(lower(to_hex(CAST({value} AS BIGINT))), 2, '0')"


@query("x10_view_modules", f"""WITH {_VIEW} SELECT module, slice, layer, round(health, 6) AS health, round(instability, 6) AS instability, round(distance, 6) AS distance, {_BAND([(b, n) for b, n, _ in X.HEALTH_BANDS])} AS health_label, {_BAND([(b, c) for b, _, c in X.HEALTH_BANDS])} AS health_colour,
  '#' || {_hex("round(least(1.0, 2 * greatest(0, least(1, distance))) * 255)")} || {_hex("round(least(1.0, 2 * (1 - greatest(0, least(1, distance)))) * 255)")} || '40' AS distance_colour, round(least(f / 5.0 + 0.5, 2.5), 6) AS size FROM vw""")
def view_modules(spark, where):
    return _view(spark, where).select("module", "slice", "layer", _r("health"), _r("instability"), _r("distance"), "health_label", "health_colour", "distance_colour", _r("size"))


@query("x10_view_index", f"WITH {_VIEW} SELECT count(*) AS modules, count(DISTINCT slice) AS slices, round(avg(health), 6) AS avg_health FROM vw")
def view_index(spark, where):
    return slices.view_index(_view(spark, where)).select("modules", "slices", _r("avg_health"))


@query("x10_slice_layers", f"WITH {_VIEW} SELECT slice, layer, count(*) AS modules, round(avg(health), 6) AS avg_health FROM vw GROUP BY ALL")
def slice_layers(spark, where):
    return slices.slice_layer_matrix(_view(spark, where)).select("slice", "layer", "modules", _r("avg_health"))


_CLUSTER = f"WITH {_ENDS}, {_VIEW}, p AS (SELECT src, dst, count(*) AS value FROM en GROUP BY ALL), s AS (SELECT *, {_slice_id('src')} AS a, {_slice_id('dst')} AS b FROM p)"


@query("x10_clusters", _CLUSTER + """, c AS (SELECT least(a, b) AS x, greatest(a, b) AS y, sum(value) AS v FROM s WHERE a <> b GROUP BY ALL), e AS (SELECT x AS slice, v FROM c UNION ALL SELECT y, v FROM c), g AS (SELECT slice, sum(v) AS coupling FROM e GROUP BY 1)
SELECT slice, count(*) AS modules, round(avg(health), 6) AS avg_health, round(coalesce(any_value(coupling), 0), 6) AS coupling FROM vw LEFT JOIN g USING (slice) GROUP BY slice""")
def clusters(spark, where):
    edges = _ends(spark, where).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("value")).withColumns({"src_slice": X.slice_id("src"), "dst_slice": X.slice_id("dst")})
    return slices.clusters(_view(spark, where), edges).select("slice", "modules", _r("avg_health"), _r(F.col("coupling").cast("double"), "coupling"))


@query("x10_slice_independence", f"""WITH {_ENDS}, p AS (SELECT DISTINCT src, dst FROM en), q AS (SELECT {_slice_id('src')} AS a, {_slice_id('dst')} AS b FROM p), sl AS (SELECT {_slice_id('module')} AS slice, count(*) AS modules FROM mo GROUP BY 1),
o AS (SELECT a AS slice, count(*) FILTER (WHERE a = b) AS internal, count(*) FILTER (WHERE a <> b) AS "cross", count(DISTINCT CASE WHEN a <> b THEN b END) AS outbound_slices FROM q GROUP BY 1), i AS (SELECT b AS slice, count(DISTINCT CASE WHEN a <> b THEN a END) AS inbound_slices FROM q GROUP BY 1)
SELECT sl.slice, modules, coalesce(internal, 0) AS internal, coalesce("cross", 0) AS "cross", coalesce(outbound_slices, 0) AS outbound_slices, coalesce(inbound_slices, 0) AS inbound_slices, round(CASE WHEN coalesce(internal, 0) + coalesce("cross", 0) > 0 THEN internal / (internal + "cross") ELSE 1.0 END, 6) AS independence FROM sl LEFT JOIN o USING (slice) LEFT JOIN i USING (slice)""")
def slice_independence(spark, where):
    edges, found = slices.module_slices(_ends(spark, where), _modules(spark, where))
    return slices.slice_independence(edges, found).withColumn("independence", F.round("independence", 6))


@query("x11_districts", "SELECT array_to_string(string_split(id, '.')[1:2], '.') AS package, count(*) AS modules, CAST(sum(metrics.lines_of_code) AS BIGINT) AS lines_of_code FROM code_modules WHERE id IS NOT NULL GROUP BY 1")
def districts(spark, where):
    return slices.districts(read(spark, where, "code_modules").where("id IS NOT NULL").select(F.col("id").alias("module"), "metrics.lines_of_code"))


@query("x11_systems", f"""WITH {_ENDS}, s AS (SELECT DISTINCT string_split_regex(src, '::|[/.]')[1] AS a, string_split_regex(dst, '::|[/.]')[1] AS b FROM en)
SELECT 'system' AS kind, string_split_regex(module, '::|[/.]')[1] AS a, '' AS b, count(*) AS modules FROM mo GROUP BY ALL UNION ALL SELECT DISTINCT 'edge', least(a, b), greatest(a, b), 0 FROM s WHERE a <> b""")
def systems(spark, where):
    nodes, pairs = slices.systems(_ends(spark, where).withColumn("value", F.lit(1.0)), _modules(spark, where))
    return nodes.select(F.lit("system").alias("kind"), F.col("system").alias("a"), F.lit("").alias("b"), "modules").unionByName(pairs.select(F.lit("edge").alias("kind"), "a", "b", F.lit(0).cast("bigint").alias("modules")))


@query("x11_top_modules", f"WITH {_VIEW} (SELECT 'functions' AS by_what, module, f AS value FROM vw ORDER BY f DESC, module LIMIT 10) UNION ALL (SELECT 'complexity', module, cc FROM vw ORDER BY cc DESC, module LIMIT 10)")
def top_modules(spark, where):
    v = _view(spark, where)
    one = lambda name, c: metrics.top_modules(v, c).select(F.lit(name).alias("by_what"), "module", F.col(c).alias("value"))
    return one("functions", "function_count").unionByName(one("complexity", "total_cyclomatic"))


# ---- column expressions ----------------------------------------------------------------------------


@query("x12_paths", r"""WITH f AS (SELECT record_id, path, language, regexp_replace(path, '([^/])\.[^./]*$', '\1') AS stem FROM code_files WHERE path IS NOT NULL),
g AS (SELECT *, string_split(stem, '/') AS s, CASE WHEN path LIKE '%.%' THEN string_split(stem, '/')[-1] END AS last, string_split(stem, '/')[1:-2] AS rest FROM f)
SELECT record_id, stem, CASE language WHEN 'python' THEN regexp_replace(replace(stem, '/', '.'), '(\.__init__|\.__main__)$', '') WHEN 'typescript' THEN regexp_replace(stem, '/index$', '') WHEN 'tsx' THEN regexp_replace(stem, '/index$', '')
  WHEN 'rust' THEN array_to_string(list_filter(CASE WHEN s[-1] = 'mod' THEN rest ELSE s END, lambda x: x <> 'src'), '::') END AS module_path,
  regexp_replace(path, '^src/', '') AS below_src, replace(replace(replace(replace(path, '::', '_'), '-', '_'), '.', '_'), '/', '_') AS diagram_id, CASE WHEN contains(lower(path), 'worker') THEN 'jobs' WHEN contains(lower(path), 'audit') THEN 'safety' WHEN contains(lower(path), 'table') THEN 'data' ELSE 'other' END AS context,
  contains('/' || array_to_string(string_split_regex(path, '::|[/.]'), '/') || '/', '/worker/store/') AS in_store, contains(path, 'src') AND contains(path, 'worker') AS loose FROM g WHERE NOT (language = 'rust' AND s[-1] IN ('lib', 'main'))""")
def paths(spark, where):
    f = read(spark, where, "code_files").where("path IS NOT NULL").withColumn("stem", X.without_extension("path"))
    f = f.where(~((F.coalesce("language", F.lit("")) == "rust") & F.element_at(F.split("stem", "/"), -1).isin("lib", "main")))
    return f.select(
        "record_id", "stem", X.module_path_by_language("path", "language").alias("module_path"), X.relative_path("path", "src").alias("below_src"), X.diagram_id("path").alias("diagram_id"), X.infer_context("path", {"worker": "jobs", "audit": "safety", "table": "data"}).alias("context"),
        X.contains_path("path", "worker/store").alias("in_store"), X.matches_loose_glob("path", "src/**/worker").alias("loose"))


@query("x12_modules", r"""WITH m AS (SELECT record_id, id AS module, string_split_regex(id, '::|[/.]') AS p FROM code_modules WHERE id IS NOT NULL), c AS (SELECT *, list_position(p, 'worker') AS k FROM m)
SELECT record_id, replace(module, '::', '/') || '/' AS directory, p[k + 1] AS context, p[k + 2] AS layer, coalesce(p[k + 1] IN ('store', 'queue'), false) AS listed, coalesce(list_position(['domain', 'aggregates', 'commands', 'queries', 'events', 'ports', 'application', 'infrastructure', 'slices'], p[-1]), 10) AS layer_order,
  array_to_string(string_split(module, '.')[1:2], '.') AS package, p[greatest(len(p) - 1, 1)] AS feature, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS short FROM c""")
def modules(spark, where):
    m = read(spark, where, "code_modules").where("id IS NOT NULL").select("record_id", F.col("id").alias("module"))
    context, layer = X.context_and_layer("module", "worker")
    feature, short = X.feature_name("module", F.lit("no such layer"))
    last = F.element_at(F.split("module", r"::|[/.]"), -1)
    return m.select("record_id", X.directory_of("module").alias("directory"), context.alias("context"), layer.alias("layer"), X.in_contexts("module", "worker", ["store", "queue"]).alias("listed"), X.layer_order(last).alias("layer_order"), X.top_package("module").alias("package"), feature.alias("feature"), short.alias("short"))


@query("x13_scores", """WITH m AS (SELECT record_id, coalesce(metrics.function_count, 0) AS f, coalesce(metrics.total_cyclomatic, 0) AS cc, coalesce(metrics.total_cognitive, 0) AS cog, coalesce(metrics.lines_of_code, 0) AS loc, coalesce(metrics.martin.ca, 0) + coalesce(metrics.martin.ce, 0) AS k, coalesce(metrics.martin.distance_from_main_sequence, 0) AS d, greatest(f, 1) AS n FROM code_modules)
SELECT record_id, round(CASE WHEN cc / n > 5 THEN greatest(0, 1 - (cc / n - 5) / 15) ELSE 1 END, 6) AS city_complexity, round(greatest(0, 1 - cog / n / 30), 6) AS city_cognitive, round(CASE WHEN loc / n > 50 THEN greatest(0, 1 - (loc / n - 50) / 100) ELSE 1 END, 6) AS city_size,
  round(greatest(0, least(1, 1 - abs(k - 10) / 30)), 6) AS city_coupling, round(CASE WHEN f < 2 THEN 0.5 ELSE greatest(0, 1 - (greatest(f, 30) - 30) / 70) END, 6) AS city_functions, round(2 * d, 6) AS edge_width, round(greatest(4.0, least(28.0, sqrt(loc) * 0.35)), 6) AS radius, round(greatest(0.5, log10(cc + 1) * 4), 6) AS height,
  CASE WHEN d > 0.6 THEN 'danger' WHEN d > 0.3 THEN 'warning' END AS style, round(ln(loc + 1), 6) AS log_lines, CAST(floor(d * 100) AS BIGINT) AS percent FROM m""")
def scores(spark, where):
    zero = lambda c, n: F.coalesce(F.col(f"metrics.{c}"), F.lit(0)).alias(n)
    m = read(spark, where, "code_modules").select("record_id", zero("function_count", "f"), zero("total_cyclomatic", "cc"), zero("total_cognitive", "cog"), zero("lines_of_code", "loc"), (F.coalesce("metrics.martin.ca", F.lit(0)) + F.coalesce("metrics.martin.ce", F.lit(0))).alias("k"), zero("martin.distance_from_main_sequence", "d"))
    a, b, c, d, e = X.health_parts("f", "cc", "cog", "loc", "k", "city")
    return m.select(
        "record_id", _r(a, "city_complexity"), _r(b, "city_cognitive"), _r(c, "city_size"), _r(d, "city_coupling"), _r(e, "city_functions"), _r(X.edge_width("d"), "edge_width"), _r(X.node_radius("loc"), "radius"), _r(X.building_height("cc"), "height"),
        X.style_class("d").alias("style"), _r(X.log_scaled("loc"), "log_lines"), X.percent_int("d").alias("percent"))


_VERSION = "CAST(snapshot_no AS VARCHAR) || '.' || (record_id % 7) || CASE WHEN record_id % 3 = 0 THEN '' WHEN record_id % 3 = 1 THEN '.' || (record_id % 11) ELSE '.x' END"


@query("x14_texts", rf"""WITH m AS (SELECT record_id, name, repo, {_VERSION} AS v, metrics.avg_cyclomatic AS a, CASE record_id % 4 WHEN 0 THEN 'STD-V1-' || lpad(CAST(record_id % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'EXP-V1-0001' WHEN 2 THEN 'STD-V1-0001.AB01' ELSE name END AS pid FROM code_modules WHERE name IS NOT NULL),
n AS (SELECT *, regexp_full_match(v, '\d+(\.\d+){{1,2}}') AS ok, string_split(v, '.') AS p FROM m)
SELECT record_id, ok AS valid, try_cast(CASE WHEN len(p) = 3 AND ok THEN p[2] END AS BIGINT) AS minor, CASE WHEN ok THEN p[1] || '.' || (CAST(p[2] AS BIGINT) + 1) || '.0' END AS bumped, CASE WHEN regexp_full_match(pid, 'STD-V1-\d{{4}}') THEN 'standard' WHEN regexp_full_match(pid, 'EXP-V1-\d{{4}}') THEN 'experiment' WHEN regexp_full_match(pid, 'STD-V1-\d{{4}}\.[A-Z]{{2}}\d{{2}}') THEN 'substandard' END AS kind,
  'https://example.org/' || repo || '/issues/' || record_id AS url, replace('a </script> ' || name, '</script', '<\/script') AS escaped, strftime(make_timestamp((record_id % 40000) * 86400000000), '%Y-%m-%d') AS day FROM n""")
def texts(spark, where):
    m = read(spark, where, "code_modules").where("name IS NOT NULL")
    n = F.col("record_id")
    v = F.concat(F.col("snapshot_no").cast("string"), F.lit("."), (n % 7).cast("string"), F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("."), (n % 11).cast("string"))).otherwise(".x"))
    pid = F.when(n % 4 == 0, F.concat(F.lit("STD-V1-"), F.lpad((n % 10000).cast("string"), 4, "0"))).when(n % 4 == 1, "EXP-V1-0001").when(n % 4 == 2, "STD-V1-0001.AB01").otherwise(F.col("name"))
    m = m.select("record_id", "name", "repo", v.alias("v"), pid.alias("pid"))
    return m.select(
        "record_id", X.valid_version("v").alias("valid"), X.parse_version("v")["minor"].alias("minor"), X.bump_version("v", "minor").alias("bumped"), X.package_id_kind("pid").alias("kind"), X.issue_url("https://example.org", "repo", "record_id").alias("url"),
        X.escape_script(F.concat(F.lit("a </script> "), "name")).alias("escaped"), X.civil_date((n % 40000) * 86400).alias("day"))


# ---- markers ---------------------------------------------------------------------------------------

_EXTENSIONS = [".rs", ".ts", ".py", ".go", ".c", ".java", ".rb", ".sh", ".txt"]
_TODO = ["// TODO: see ", "# TODO(#7): see ", "/* FIXME(#12): see ", "-- TODO see ", "plain TODO: "]


def _marker_lines(spark, where) -> DataFrame:
    d = read(spark, where, "documents").where("text IS NOT NULL")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    content = F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(". "), F.concat(F.lit(".\n"), pick(_TODO, F.col("doc_id"))))
    return markers.lines_of(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), pick(_EXTENSIONS, F.col("doc_id"))).alias("file"), content.alias("content")))


_COMMENT_SQL = "CASE " + " ".join(f"WHEN ext IN ({_list(exts)}) THEN regexp_matches(text, '^\\s*({'|'.join(m.replace('*', '[*]') for m in marks)})')" for exts, marks in markers.COMMENTS.values()) + " ELSE regexp_matches(text, '^\\s*(//|#|--|/[*])') END"
_MARKER_SQL = f"""d0 AS (SELECT 'd' || doc_id || [{_list(_EXTENSIONS)}][doc_id % {len(_EXTENSIONS)} + 1] AS file, [{_list(_EXTENSIONS)}][doc_id % {len(_EXTENSIONS)} + 1] AS ext, replace(replace(text, chr(13), ''), '. ', '.' || chr(10) || [{_list(_TODO)}][doc_id % {len(_TODO)} + 1]) AS content FROM documents WHERE text <> ''),
l0 AS (SELECT file, ext, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM d0), l1 AS (SELECT file, ext, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM l0), l2 AS (SELECT *, {_COMMENT_SQL} AS comment FROM l1),
l3 AS (SELECT *, substr(text, length(regexp_extract(text, '^\\s*(//!|///|//|#|/[*]|[*])?', 0)) + 1) AS content FROM l2),
l4 AS (SELECT file, line, text, content, regexp_extract(content, '(TODO|FIXME)(\\(#(\\d+)\\))?:\\s*(.+)', 1) AS tag, try_cast(nullif(regexp_extract(content, '(TODO|FIXME)(\\(#(\\d+)\\))?:\\s*(.+)', 3), '') AS BIGINT) AS issue FROM l3 WHERE comment AND regexp_matches(content, '(TODO|FIXME)(\\(#(\\d+)\\))?:\\s*(.+)'))"""


@query("x15_marker_items", f"WITH {_MARKER_SQL} SELECT file, line, tag, issue, CASE WHEN issue IS NOT NULL THEN 'https://example.org/team/app/issues/' || issue END AS url, tag = 'FIXME' AS needs_issue FROM l4")
def marker_items(spark, where):
    i = markers.marker_items(_marker_lines(spark, where), base_url="https://example.org", repo="team/app")
    return i.select("file", "line", "tag", F.col("issue.number").alias("issue"), "issue.url", markers.needs_issue("tag", ["FIXME"]).alias("needs_issue"))


@query("x15_marker_findings", f"""WITH {_MARKER_SQL} SELECT 'untracked' AS finding, file, line FROM l4 WHERE tag = 'TODO' AND issue IS NULL
UNION ALL SELECT 'malformed', file, line FROM l2 WHERE comment AND regexp_matches(text, '\\b(TODO|FIXME)\\b') AND NOT regexp_matches(text, '(TODO|FIXME)(\\(#\\d+\\))?:\\s*.+')""")
def marker_findings(spark, where):
    lines = _marker_lines(spark, where)
    one = lambda name, df: df.select(F.lit(name).alias("finding"), F.col(df.columns[0]).alias("file"), "line")
    bad = markers.untracked(markers.marker_items(lines), ["TODO"], "error").select("path", "line")
    return one("untracked", bad).unionByName(one("malformed", markers.malformed(lines).select("file", "line")))


@query("x15_marker_totals", f"WITH {_MARKER_SQL} SELECT count(*) AS items, count(DISTINCT file) AS files, count(issue) AS tracked, count(*) - count(issue) AS untracked FROM l4")
def marker_totals(spark, where):
    return markers.marker_totals(markers.marker_items(_marker_lines(spark, where)))


# ---- differences, gates, rules ---------------------------------------------------------------------


def _snap(spark, where, n: int) -> DataFrame:
    m = read(spark, where, "code_modules").where((F.col("snapshot_no") == n) & F.col("id").isNotNull())
    return m.groupBy(F.concat_ws("|", "repo", "id").alias("module")).agg(F.max(F.coalesce("metrics.martin.instability", F.lit(0.5))).alias("instability"), F.max(F.coalesce("metrics.martin.distance_from_main_sequence", F.lit(0.5))).alias("distance"), F.max("metrics.total_cyclomatic").alias("value"))


_SNAP = """sn AS (SELECT snapshot_no, repo || '|' || id AS module, max(coalesce(metrics.martin.instability, 0.5)) AS i, max(coalesce(metrics.martin.distance_from_main_sequence, 0.5)) AS d, max(metrics.total_cyclomatic) AS v FROM code_modules WHERE id IS NOT NULL GROUP BY ALL),
zo AS (SELECT *, CASE WHEN d > 0.5 THEN 'zone_of_pain' WHEN i < 0.3 THEN 'stable' WHEN i > 0.7 THEN 'unstable' ELSE 'balanced' END AS zone FROM sn), b AS (SELECT * FROM zo WHERE snapshot_no = 1), t AS (SELECT * FROM zo WHERE snapshot_no = 2)"""


@query("x16_zone_changes", f"WITH {_SNAP} SELECT coalesce(b.module, t.module) AS module, b.zone AS base_zone, t.zone AS target_zone FROM b FULL JOIN t ON b.module = t.module WHERE b.zone IS DISTINCT FROM t.zone")
def zone_changes(spark, where):
    return diff.zone_changes(_snap(spark, where, 1), _snap(spark, where, 2))


@query("x16_new_hotspots", f"""WITH {_SNAP} SELECT t.module AS id, b.v AS base_value, t.v AS target_value, CASE WHEN b.module IS NULL OR b.v IS NULL THEN 'NEW_COMPLEX' ELSE 'COMPLEXITY_INCREASE' END AS type FROM t LEFT JOIN b ON b.module = t.module WHERE t.v > 20 AND coalesce(b.v, 0) <= 20""")
def new_hotspots(spark, where):
    side = lambda n: _snap(spark, where, n).select(F.col("module").alias("id"), "value")
    return diff.new_hotspots(side(1), side(2), 20)


def _edges_of(spark, where, n: int) -> DataFrame:
    e = read(spark, where, "call_graph_edges").where((F.col("snapshot_no") == n) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    return e.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.sum("call_count").alias("value"))


_EDGE_SNAP = "ed AS (SELECT snapshot_no, from_id AS src, to_id AS dst, sum(call_count) AS v FROM call_graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND snapshot_no IN (1, 2) GROUP BY ALL), cc AS (SELECT src, dst, coalesce(sum(v) FILTER (WHERE snapshot_no = 1), 0) AS base, coalesce(sum(v) FILTER (WHERE snapshot_no = 2), 0) AS target FROM ed GROUP BY ALL)"


@query("x16_coupling_changes", f"WITH {_EDGE_SNAP} SELECT src, dst, CAST(base AS BIGINT) AS base, CAST(target AS BIGINT) AS target, CAST(target - base AS BIGINT) AS delta, CASE WHEN target < base THEN 'improved' WHEN target - base <= 0 THEN 'unchanged' WHEN target - base <= 5 THEN 'degraded' ELSE 'severe' END AS class FROM cc WHERE abs(target - base) > 1")
def coupling_changes(spark, where):
    return diff.coupling_changes(_edges_of(spark, where, 1), _edges_of(spark, where, 2), 1).withColumn("class", diff.change_class("delta"))


@query("x16_module_hotspots", f"""WITH {_SNAP}, {_EDGE_SNAP} SELECT src || ' -> ' || dst AS id, CAST(base AS DOUBLE) AS base_value, CAST(target AS DOUBLE) AS target_value, 'COUPLING_INCREASE' AS type FROM cc WHERE target - base > 1
UNION ALL SELECT t.module, round(b.d, 6), round(t.d, 6), 'ZONE_OF_PAIN' FROM t LEFT JOIN b ON b.module = t.module WHERE t.zone = 'zone_of_pain' AND b.zone IS DISTINCT FROM t.zone""")
def module_hotspots(spark, where):
    h = diff.module_hotspots(_edges_of(spark, where, 1), _edges_of(spark, where, 2), _snap(spark, where, 1), _snap(spark, where, 2), 1)
    return h.select("id", _r("base_value"), _r("target_value"), "type")


def _totals(spark, where) -> tuple[DataFrame, DataFrame]:
    f = read(spark, where, "code_functions").select("snapshot_no", F.col("metrics.cyclomatic_complexity"), F.col("metrics.cognitive_complexity"), F.col("metrics.lines_of_code"))
    side = lambda n: metrics.snapshot_totals(f.where(F.col("snapshot_no") == n))
    return side(1), side(2)


_TOTAL_SQL = "to1 AS (SELECT snapshot_no AS s, count(*) AS n, coalesce(sum(metrics.cyclomatic_complexity), 0) AS cc, coalesce(sum(metrics.cognitive_complexity), 0) AS cog FROM code_functions GROUP BY 1), tt AS (SELECT max(n) FILTER (WHERE s = 1) AS bn, max(n) FILTER (WHERE s = 2) AS tn, max(cc / n) FILTER (WHERE s = 1) AS b, max(cc / n) FILTER (WHERE s = 2) AS t FROM to1)"


@query("x17_snapshot_diff", f"""WITH {_TOTAL_SQL}, d AS (SELECT *, t - b AS d FROM tt) SELECT CASE WHEN d > 5 OR (t > 15 AND d > 0) THEN 'error' WHEN d > 2 THEN 'warning' ELSE 'success' END AS status, greatest(tn - bn, 0) AS functions_added, greatest(bn - tn, 0) AS functions_removed,
  round(d, 6) AS delta, round(CASE WHEN b > 0 THEN d / b * 100 END, 6) AS percent_change, CASE WHEN d > 2 THEN 1 ELSE 0 END AS hotspots, CASE WHEN d > 2 THEN 1 ELSE 0 END AS violations FROM d""")
def snapshot_diff(spark, where):
    d = diff.snapshot_diff(*_totals(spark, where))
    avg = F.col("metrics")["avg_cyclomatic"]
    return d.select("status", "functions_added", "functions_removed", _r(avg["delta"], "delta"), _r(avg["percent_change"], "percent_change"), F.size("hotspots").alias("hotspots"), F.size("violations").alias("violations"))


@query("x17_check_gate", f"""WITH {_TOTAL_SQL}, d AS (SELECT t - b AS d, x.w, x.e FROM tt, (VALUES (2.0, 5.0), (-100.0, 5.0), (-100.0, -50.0)) x(w, e)) SELECT w AS warning, e AS error, CASE WHEN d > e THEN 1 ELSE 0 END + CASE WHEN d > 5 THEN 1 ELSE 0 END AS errors, CASE WHEN d > w AND d <= e THEN 1 ELSE 0 END + CASE WHEN d > 2 AND d <= 5 THEN 1 ELSE 0 END AS warnings,
  CASE WHEN d > e OR d > 5 THEN 1 WHEN d > w OR d > 2 THEN 2 ELSE 0 END AS exit_code FROM d""")
def check_gate(spark, where):
    d = materialize(diff.snapshot_diff(*_totals(spark, where)), "diff")
    out = None
    for w, e in ((2.0, 5.0), (-100.0, 5.0), (-100.0, -50.0)):
        one = diff.check_gate(d, w, e).select(F.lit(w).alias("warning"), F.lit(e).alias("error"), "errors", "warnings", "exit_code")
        out = one if out is None else out.unionByName(one)
    return out


_JSON_RULES = [
    {"rule_id": "cc", "rule_name": "Complexity", "source": "a", "field": "metrics.cyclomatic_complexity", "max": 12.0, "min": None, "scope": "function", "severity": "error", "exclude": ["*render*"]},
    {"rule_id": "loc", "rule_name": "Lines", "source": "a", "field": "metrics.lines_of_code", "max": 60.0, "min": 2.0, "scope": "function", "severity": "warning", "exclude": []},
]
_JSON_SQL = """ra AS (SELECT json_extract_string(payload, '$.id') AS entity, json_extract(payload, '$.metrics.cyclomatic_complexity') AS cc, json_extract(payload, '$.metrics.lines_of_code') AS loc FROM raw_artifacts WHERE artifact = 'functions' AND json_valid(payload)),
fv AS (SELECT 'cc' AS rule_id, entity, CASE WHEN json_type(cc) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(cc AS DOUBLE) END AS actual FROM ra WHERE NOT contains(entity, 'render') UNION ALL SELECT 'loc', entity, CASE WHEN json_type(loc) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(loc AS DOUBLE) END FROM ra)"""


def _json_values(spark, where) -> DataFrame:
    raw = read(spark, where, "raw_artifacts").where("artifact = 'functions'")
    docs = raw.select(F.col("record_id").cast("string").alias("source"), F.try_parse_json(F.concat(F.lit('{"functions": ['), "payload", F.lit("]}"))).alias("doc")).where("doc IS NOT NULL")
    return rules.field_values(rules.entities(docs, "function").withColumn("source", F.lit("a")), _JSON_RULES)


@query("x18_rule_values", f"WITH {_JSON_SQL} SELECT rule_id, entity, actual FROM fv WHERE entity IS NOT NULL AND actual IS NOT NULL")
def rule_values(spark, where):
    return _json_values(spark, where)


@query("x18_ratchet", f"""WITH {_JSON_SQL}, v AS (SELECT rule_id, entity, max(actual) AS actual FROM fv WHERE entity IS NOT NULL AND rule_id = 'cc' AND actual > 12 GROUP BY ALL), e AS (SELECT rule_id, entity, CASE WHEN hash_bucket = 0 THEN NULL WHEN hash_bucket = 1 THEN actual + 5 ELSE actual - 1 END AS value, actual FROM (SELECT *, length(entity) % 3 AS hash_bucket FROM v))
SELECT rule_id, entity, CASE WHEN value IS NULL THEN actual ELSE least(value, actual) END AS value FROM e""")
def ratchet(spark, where):
    v = _json_values(spark, where).where("rule_id = 'cc' AND actual > 12").groupBy("rule_id", "entity").agg(F.max("actual").alias("actual")).withColumn("direction", F.lit("max"))
    bucket = F.length("entity") % 3
    e = v.select("rule_id", "entity", F.when(bucket == 0, F.lit(None)).when(bucket == 1, F.col("actual") + 5).otherwise(F.col("actual") - 1).alias("value"), F.lit(None).cast("array<string>").alias("targets"), F.lit("#1").alias("issue"))
    return rules.ratchet(e, v).select("rule_id", "entity", "value")


# ---- graphs ----------------------------------------------------------------------------------------


@query("x19_edge_rules", f"""WITH {_ENDS}, p AS (SELECT DISTINCT src, dst FROM en) SELECT 'forbidden' AS rule, src, dst FROM p WHERE src LIKE '%worker%' AND dst LIKE 'shared_kernel%'
UNION ALL SELECT 'not_allowed', src, dst FROM p WHERE src LIKE 'platform_sdk%' AND NOT dst LIKE 'platform_sdk%' UNION ALL SELECT 'required', 'no such*', '*' WHERE NOT EXISTS (SELECT 1 FROM p WHERE src LIKE 'no such%')""")
def edge_rules(spark, where):
    return graph.edge_rules(_ends(spark, where), [("*worker*", "shared_kernel*")], [("platform_sdk*", "platform_sdk*")], [("no such*", "*")])


@query("x19_filter_graph", f"""WITH {_ENDS}, {_VIEW}, k AS (SELECT module FROM vw WHERE loc >= 100 AND NOT starts_with(module, 'shared_kernel')), p AS (SELECT DISTINCT src, dst FROM en)
SELECT src, dst FROM p WHERE src IN (SELECT module FROM k) AND dst IN (SELECT module FROM k)""")
def filter_graph(spark, where):
    return graph.filter_graph(_view(spark, where).select("module", "lines_of_code"), _ends(spark, where).select("src", "dst").distinct(), ["shared_kernel"])[1]


@query("x19_focus", f"""WITH RECURSIVE {_ENDS}, p AS (SELECT DISTINCT src, dst FROM en UNION SELECT DISTINCT dst, src FROM en), r(module, hops) AS (SELECT 'shared_kernel::generated::bindings', 0 UNION SELECT p.dst, r.hops + 1 FROM r JOIN p ON p.src = r.module WHERE r.hops < 2) SELECT module, min(hops) AS hops FROM r GROUP BY 1""")
def focus(spark, where):
    return graph.focus(_ends(spark, where), "shared_kernel::generated::bindings", 2)


@query("x19_uncovered", f"WITH {_ENDS} SELECT module FROM mo WHERE module NOT IN (SELECT src FROM en UNION SELECT dst FROM en)")
def uncovered(spark, where):
    return coupling.uncovered_modules(_modules(spark, where), _ends(spark, where))


def _systems(spark, where) -> tuple[DataFrame, DataFrame]:
    """The systems (first segments) of all ends of the call graph as modules, and the edges between them."""
    first = lambda c: F.element_at(F.split(c, r"::|[/.]"), 1)
    e = _ends(spark, where).select(first("src").alias("src"), first("dst").alias("dst"))
    return e.select(F.explode(F.array("src", "dst")).alias("module")).distinct(), e.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("value"))


@query("x20_layout_checks", f"WITH {_ENDS} SELECT DISTINCT string_split_regex(m, '::|[/.]')[1] AS module, true AS placed, true AS apart FROM (SELECT src AS m FROM en UNION ALL SELECT dst FROM en)")
def layout_checks(spark, where):
    """The layout of all systems: every one has a place, and no other has the same."""
    nodes, edges = _systems(spark, where)
    at = graph.layout(nodes, edges.withColumn("value", F.lit(0.5)), iterations=50)
    shared = at.withColumn("_s", F.struct(F.round("x", 9), F.round("y", 9), F.round("z", 9))).groupBy("_s").agg(F.collect_list("module").alias("_m"), F.first("x").alias("x"))
    return shared.select(F.explode("_m").alias("module"), (F.col("x").isNotNull() & ~F.isnan("x")).alias("placed"), (F.size("_m") == 1).alias("apart"))


# ---- packages --------------------------------------------------------------------------------------


def _tree(spark, where) -> DataFrame:
    """A package of each module row: whole if its number is even, with a bad id or version for some numbers."""
    n = F.col("record_id")
    text = n.cast("string")
    home = F.concat(F.lit("standards/v1/p"), text)
    meta = F.concat(F.lit('[standard]\nid = "'), F.when(n % 5 == 0, "bad").otherwise(F.concat(F.lit("STD-V1-"), F.lpad((n % 10000).cast("string"), 4, "0"))), F.lit('"\nname = "p'), text, F.lit('"\nslug = "p"\nversion = "'), F.when(n % 7 == 0, "one").otherwise("1.0"), F.lit('"\n[ownership]\nmaintainers = ["a"]\n'))
    whole = ["docs/01_spec.md", "src/lib.rs", "tests/t.rs", "examples/e.txt", "agents/skills/s.md"]
    files = F.filter(F.array(F.struct(F.concat(home, F.lit("/standard.toml")).alias("path"), meta.alias("content")), F.struct(F.concat(home, F.lit("/Cargo.toml")).alias("path"), F.lit("").alias("content")), *[F.struct(F.when(n % 2 == 0, F.concat(home, F.lit("/" + f))).alias("path"), F.lit("").alias("content")) for f in whole]), lambda f: f["path"].isNotNull())
    return read(spark, where, "code_modules").select(F.explode(files).alias("f")).select("f.path", F.lit(False).alias("is_dir"), "f.content")


_PACKAGES = "pk AS (SELECT record_id AS n, record_id % 2 = 1 AS bare, record_id % 5 = 0 AS bad, record_id % 7 = 0 AS odd FROM code_modules)"


@query("x21_package_diagnostics", f"""WITH {_PACKAGES}, d AS (SELECT n, 'error' AS severity, unnest(['MISSING_REQUIRED_DIR', 'MISSING_REQUIRED_DIR', 'MISSING_REQUIRED_DIR', 'MISSING_REQUIRED_DIR', 'MISSING_REQUIRED_DIR', 'MISSING_LIB_RS', 'MISSING_SPEC_DOC', 'EMPTY_TESTS_DIR']) AS code FROM pk WHERE bare
  UNION ALL SELECT n, 'error', 'INVALID_STANDARD_ID' FROM pk WHERE bad UNION ALL SELECT n, 'warning', 'INVALID_VERSION' FROM pk WHERE odd)
SELECT severity, code, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT 'error', 'PACKAGE_VALIDATION_FAILED', count(DISTINCT n) FROM d WHERE severity = 'error' UNION ALL SELECT 'warning', 'MISSING_EXPERIMENTAL_DIR', 1 UNION ALL SELECT 'info', 'DISCOVERY_COMPLETE', 1""")
def package_diagnostics(spark, where):
    return packages.repository_diagnostics(_tree(spark, where)).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query("x21_package_exit", f"WITH {_PACKAGES} SELECT count(*) FILTER (WHERE bare) * 8 + count(*) FILTER (WHERE bad) + count(*) FILTER (WHERE bare OR bad) AS errors, count(*) FILTER (WHERE odd) + 1 AS warnings, 1 AS infos, 1 AS exit_code FROM pk")
def package_exit(spark, where):
    return packages.diagnostic_counts(packages.repository_diagnostics(_tree(spark, where)))


@query("x21_registry", f"""WITH {_PACKAGES}, r AS (SELECT CASE WHEN bad THEN 'bad' ELSE 'STD-V1-' || lpad(CAST(n % 10000 AS VARCHAR), 4, '0') END AS id, 'p' || n AS name, CASE WHEN odd THEN 'one' ELSE '1.0' END AS version, 'standards/v1/p' || n AS path, n FROM pk),
k AS (SELECT 'STD-V1-' || lpad(CAST(coalesce(max(n % 10000) FILTER (WHERE id <> 'bad'), 0) + 1 AS VARCHAR), 4, '0') AS next FROM r)
SELECT 'package' AS kind, id, name, version, path FROM r UNION ALL SELECT 'next', next, NULL, NULL, NULL FROM k UNION ALL SELECT 'count', 'standard', CAST(count(*) AS VARCHAR), NULL, NULL FROM r UNION ALL SELECT 'found', id, name, NULL, NULL FROM r WHERE id = 'STD-V1-0001'""")
def registry(spark, where):
    tree = _tree(spark, where)
    meta = materialize(packages.metadata(tree, packages.discover(tree)), "metadata")
    none = F.lit(None).cast("string")
    rows = packages.registry(meta).select(F.lit("package").alias("kind"), "id", "name", "version", "path")
    following = packages.next_id(meta, "STD-V1").select(F.lit("next"), "id", none, none, none)
    count = packages.counts_by_type(meta).select(F.lit("count"), "package_type", F.col("packages").cast("string"), none, none)
    found = packages.find_package(meta, "STD-V1-0001").select(F.lit("found"), "id", "name", none, none)
    return rows.union(following).union(count).union(found)


# ---- artifacts written and read --------------------------------------------------------------------


def _folder(spark, label: str) -> str:
    return table_path(spark, label).removeprefix("file://").removeprefix("file:")


@query("x22_functions_artifact", """SELECT id, name, file, module, language, start_line, end_line, metrics.cyclomatic_complexity AS cyclomatic_complexity, metrics.cognitive_complexity AS cognitive_complexity, metrics.lines_of_code AS lines_of_code, round(metrics.halstead.volume, 6) AS volume FROM code_functions""")
def functions_artifact(spark, where):
    """Function records as compressed JSON, a document per line, and back."""
    f = read(spark, where, "code_functions")
    shaped = f.select("id", "name", "file", "module", "language", F.struct("start_line", "end_line").alias("location"), "metrics")
    path = table_path(spark, "functions")
    sinks.write_partitioned(shaped.select(F.lit("1.0.0").alias("schema_version"), F.array(F.struct("*")).alias("functions")), path)
    got = spark.read.schema(readers.FUNCTIONS).json(path).select(F.explode("functions").alias("f")).select("f.*")
    # the language column is text that the record may lack, as the reader has it
    return got.select("id", "name", "file", "module", "language", "location.start_line", "location.end_line", "metrics.cyclomatic_complexity", "metrics.cognitive_complexity", "metrics.lines_of_code", _r("metrics.halstead.volume", "volume"))


@query("x22_modules_artifact", f"WITH {_VIEW} SELECT module, string_split(module, '::')[-1] AS name, replace(module, '::', '/') || '/' AS path, f AS function_count, cc AS total_cyclomatic, loc AS lines_of_code, CAST(k AS BIGINT) AS ca, round(instability, 6) AS instability FROM vw")
def modules_artifact(spark, where):
    """modules.json of the summary per module, written as one document and read back."""
    v = _view(spark, where)
    m = v.select("module", F.array(F.lit("x")).alias("languages"), F.lit(1).cast("bigint").alias("file_count"), "function_count", "total_cyclomatic", F.lit(0.0).alias("avg_cyclomatic"), "total_cognitive", F.lit(0.0).alias("avg_cognitive"), "lines_of_code",
        F.struct((F.coalesce("martin.ca", F.lit(0)) + F.coalesce("martin.ce", F.lit(0))).alias("ca"), F.lit(0).cast("bigint").alias("ce"), F.col("instability").alias("instability"), F.lit(0.0).alias("abstractness"), F.col("distance").alias("distance_from_main_sequence")).alias("martin"))
    path = _folder(spark, "modules") + "/modules.json"
    sinks.write_modules(m, path)
    return readers.modules(spark, path).select("module", "name", "path", "function_count", "total_cyclomatic", "lines_of_code", "martin.ca", _r("martin.instability", "instability"))


@query("x22_matrix_artifact", """WITH e AS (SELECT split_part(from_id, ':', 1) AS src, split_part(to_id, ':', 1) AS dst FROM call_graph_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL), a AS (SELECT src AS m FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM e),
p AS (SELECT src, dst, count(*) / (SELECT n FROM n) AS v FROM e WHERE src <> dst GROUP BY ALL)
SELECT x.m AS src, y.m AS dst, round(CASE WHEN x.m = y.m THEN 1.0 ELSE coalesce(p.v, 0.0) END, 9) AS value FROM a x CROSS JOIN a y LEFT JOIN p ON p.src = x.m AND p.dst = y.m""")
def matrix_artifact(spark, where):
    """The dense matrix of calls between languages, as shares of all, written and read back as cells."""
    e = read(spark, where, "call_graph_edges").where("from_id IS NOT NULL AND to_id IS NOT NULL").select(X.language_of("from_id").alias("src"), X.language_of("to_id").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    e = materialize(e, "languages")
    total = e.agg(F.sum("n")).first()[0] or 1
    cells = e.where("src <> dst").select("src", "dst", (F.col("n") / F.lit(total)).alias("value")).withColumn("import", F.col("value"))
    path = _folder(spark, "matrix") + "/coupling-matrix.json"
    sinks.write_matrix(e.select(F.explode(F.array("src", "dst")).alias("module")), cells, path, {"import": 1.0})
    return readers.coupling_matrix(spark, path).withColumn("value", F.round("value", 9))


@query("x22_retained", """WITH r AS (SELECT DISTINCT repo, taken_at FROM snapshots), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY repo ORDER BY taken_at DESC) <= 2)
SELECT s.repo, s.snapshot_no, s.seq FROM snapshots s JOIN k ON s.repo = k.repo AND s.taken_at = k.taken_at""")
def retained_snapshots(spark, where):
    return retained(read(spark, where, "snapshots"), 2, scope="repo").select("repo", "snapshot_no", "seq")


@query("x22_changed_files", """WITH f AS (SELECT repo || '/' || path AS path, snapshot_no, md5(string_agg(CAST(metrics.lines_of_code AS VARCHAR), ',' ORDER BY record_id)) AS h FROM code_files WHERE path IS NOT NULL GROUP BY ALL)
SELECT path FROM f WHERE snapshot_no = 2 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.snapshot_no = 1 AND g.path = f.path AND g.h = f.h)""")
def changed(spark, where):
    """Files of the second snapshot whose content differs from that of the first."""
    f = read(spark, where, "code_files").where("path IS NOT NULL").groupBy(F.concat_ws("/", "repo", "path").alias("path"), "snapshot_no")
    rows = f.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", F.col("metrics.lines_of_code").cast("string").alias("c")))), lambda x: x["c"]), ",").alias("content"))
    side = lambda n: rows.where(F.col("snapshot_no") == n).select("path", "content")
    return changed_files(side(2), side(1).select("path", F.sha2("content", 256).alias("hash"))).select("path")
