"""Function, module, file and snapshot metrics from syntax nodes or extracted functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..runtime import checked_join

# ---- fixed values: node kinds by language ----
DECISION = {
    "rust": ["if_expression", "else_clause", "match_arm", "while_expression", "loop_expression", "for_expression", "binary_expression"],
    "python": ["if_statement", "elif_clause", "else_clause", "for_statement", "while_statement", "except_clause", "list_comprehension", "conditional_expression", "boolean_operator", "assert_statement"],
    "typescript": ["if_statement", "else_clause", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_case", "catch_clause", "ternary_expression", "binary_expression"],
}
NESTING = {
    "rust": ["if_expression", "match_expression", "while_expression", "loop_expression", "for_expression", "closure_expression", "async_block"],
    "python": ["if_statement", "for_statement", "while_statement", "try_statement", "with_statement", "function_definition", "class_definition", "lambda"],
    "typescript": ["if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_statement", "try_statement", "arrow_function", "function", "function_declaration", "function_expression", "method_definition"],
}
IGNORED = {"rust": ["try_expression"], "python": ["finally_clause", "raise_statement"], "typescript": ["optional_chain"]}
DECISION["tsx"], NESTING["tsx"], IGNORED["tsx"] = DECISION["typescript"], NESTING["typescript"], IGNORED["typescript"]
LOGICAL_KINDS = ["binary_expression", "boolean_operator"]
OPERATORS = (
    "+ - * / % ** == != < > <= >= && || ! and or not = += -= *= /= & | ^ ~ << >> . :: -> ?. ? : => .. ... "
    "if else while for loop match return break continue let const var def fn async await try catch except finally raise throw yield import from use"
).split()
OPERANDS = "identifier field_identifier property_identifier type_identifier integer integer_literal float float_literal string string_literal raw_string_literal char_literal boolean true false none null nil".split()
#: a second table for syntax trees of the richer Rust backend: kinds that add to cyclomatic and cognitive complexity
RICH_RUST = {"flat_cyclomatic": ["try_expression"], "arm": ["match_arm"], "nested": ["if_expression", "while_expression", "loop_expression", "for_expression"], "cognitive_once": ["match_expression"], "cognitive_flat": ["closure_expression", "async_block"]}
#: operators and operands of the richer Rust backend
RICH_OPERATORS = [*OPERATORS, "()", "[]", ".await"]
RICH_OPERANDS = ["identifier", "path", "field_identifier", "integer_literal", "float_literal", "string_literal", "char_literal", "boolean", "true", "false"]
MAX_OPERAND_BYTES = 100
# ---- end of fixed values ----


def _kind_in(table: dict[str, list[str]], language: Column) -> Column:
    out = F.lit(False)
    for lang, kinds in table.items():
        out = F.when(language == lang, F.col("kind").isin(kinds)).otherwise(out)
    return out


def complexity(ast_nodes: DataFrame, variant: str = "tree") -> DataFrame:
    """(file, function_key, cyclomatic_complexity, cognitive_complexity) by one aggregation over syntax nodes.

    ast_nodes: file, language, function_key, kind, text, nest_level, ignored, logical. variant "rich"
    counts match arms but wildcards, ? operators, and closures.
    """
    live = ast_nodes.where(~F.col("ignored"))
    logical_kind = F.col("kind").isin(LOGICAL_KINDS)
    if variant == "rich":
        r = RICH_RUST
        live = ast_nodes
        wild = F.col("text").rlike(r"^\s*_\s*=>")
        nested = F.col("kind").isin(r["nested"])
        cc = F.when(F.col("kind").isin(r["arm"]) & ~wild, 1).when(nested | F.col("kind").isin(r["flat_cyclomatic"]), 1).when(logical_kind & F.col("logical"), 1).otherwise(0)
        cog = F.when(nested | F.col("kind").isin(r["cognitive_once"]), 1 + F.col("nest_level")).when(F.col("kind").isin(r["cognitive_flat"]), 1).when(logical_kind & F.col("logical"), 1).otherwise(0)
    else:
        decision = _kind_in(DECISION, F.col("language"))
        cc = F.when(decision & logical_kind, F.col("logical").cast("int")).when(decision, 1).otherwise(0)
        cog = F.when(decision & logical_kind, F.col("logical").cast("int")).when(decision, 1 + F.col("nest_level")).otherwise(0)
    return live.groupBy("file", "function_key").agg((1 + F.sum(cc)).cast("bigint").alias("cyclomatic_complexity"), F.sum(cog).cast("bigint").alias("cognitive_complexity"))


def halstead_metrics(ast_nodes: DataFrame, variant: str = "tree") -> DataFrame:
    """(file, function_key, halstead struct): distinct and total operators and operands by node text; variant "rich" also counts calls, indexing and paths."""
    operator = F.col("kind").isin(RICH_OPERATORS if variant == "rich" else OPERATORS)
    operand = F.col("kind").isin(RICH_OPERANDS if variant == "rich" else OPERANDS) & (F.length("text") > 0) & (F.octet_length("text") < MAX_OPERAND_BYTES)
    per_text = ast_nodes.withColumn("_o", F.when(operator, 1).when(operand, 2)).where("_o IS NOT NULL").groupBy("file", "function_key", "_o", "text").agg(F.count(F.lit(1)).alias("n"))
    one = lambda k, c: F.coalesce(F.sum(F.when(F.col("_o") == k, c)), F.lit(0))
    counted = per_text.groupBy("file", "function_key").agg(one(1, 1).alias("n1"), one(2, 1).alias("n2"), one(1, F.col("n")).alias("t1"), one(2, F.col("n")).alias("t2"))
    return counted.select("file", "function_key", X.halstead("n1", "n2", "t1", "t2").alias("halstead"))


def dedupe_functions(functions: DataFrame) -> DataFrame:
    """The first of the rows that stand at one (file_path, start_line)."""
    w = Window.partitionBy("file_path", "start_line").orderBy("seq")
    return functions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def module_metrics(functions: DataFrame, keys: tuple[str, ...] = ("module",), sets: bool = True) -> DataFrame:
    """Totals and averages per module: function_count, file_count, languages, total_ and avg_ complexities, lines_of_code.

    functions: the keys, file, language, cyclomatic_complexity, cognitive_complexity, lines_of_code.
    """
    extra = [F.count_distinct("file").alias("file_count"), F.array_sort(F.collect_set("language")).alias("languages")] if sets else []
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("function_count"), *extra, total("cyclomatic_complexity").alias("total_cyclomatic"), total("cognitive_complexity").alias("total_cognitive"), total("lines_of_code").alias("lines_of_code"))
    return out.withColumns({"avg_cyclomatic": F.col("total_cyclomatic") / F.col("function_count"), "avg_cognitive": F.col("total_cognitive") / F.col("function_count")})


def file_metrics(functions: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Sums, averages and maxima per file, with the maintainability index from the mean volume, complexity and size."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = functions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("function_count"), total("cyclomatic_complexity").alias("total_cyclomatic"), F.avg("cyclomatic_complexity").alias("avg_cyclomatic"), F.max("cyclomatic_complexity").alias("max_cyclomatic"), total("cognitive_complexity").alias("total_cognitive"),
        F.avg("cognitive_complexity").alias("avg_cognitive"), F.max("cognitive_complexity").alias("max_cognitive"), total("lines_of_code").alias("lines_of_code"), total("comment_lines").alias("comment_lines"), F.avg("volume").alias("_v"), F.avg("lines_of_code").alias("_l"))
    return out.withColumn("maintainability_index", X.maintainability_index(F.coalesce("_v", F.lit(1.0)), F.coalesce("avg_cyclomatic", F.lit(1.0)), F.coalesce("_l", F.lit(1.0)))).drop("_v", "_l")


def type_counts(types: DataFrame) -> DataFrame:
    """(module, n_types, n_abstract); a type is abstract if any row of its name and module says so."""
    one = types.groupBy("module", "name").agg(F.bool_or("is_abstract").alias("a"))
    return one.groupBy("module").agg(F.count(F.lit(1)).alias("n_types"), F.count_if("a").alias("n_abstract"))


def snapshot_totals(functions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """total_functions, total_ and avg_ complexities, lines_of_code; zeros over nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_functions"), total("cyclomatic_complexity").alias("total_cyclomatic"), total("cognitive_complexity").alias("total_cognitive"), total("lines_of_code").alias("lines_of_code"), F.coalesce(F.max("cyclomatic_complexity"), F.lit(0)).alias("max_cyclomatic"))
    n = F.greatest(F.col("total_functions"), F.lit(1))
    return out.withColumns({"avg_cyclomatic": F.col("total_cyclomatic") / n, "avg_cognitive": F.col("total_cognitive") / n})


def coupling_density(n_modules: Column | str, n_edges: Column | str) -> Column:
    """Edges over all unordered pairs; 0 below two modules."""
    n, e = (F.col(c) if isinstance(c, str) else c for c in (n_modules, n_edges))
    pairs = n * (n - 1) / 2.0
    return F.when(n > 1, e / pairs).otherwise(0.0)


def hotspots(functions: DataFrame, least: int = 5, n: int = 10, by: str = "cyclomatic_complexity", ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The n functions above the least complexity; Spark keeps n rows per task before it merges."""
    return functions.where(F.col(by) > least).orderBy(F.col(by).desc(), *ties).limit(n)


def top_per_group(df: DataFrame, group: list[str], by: str, ties: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(by).desc(), *[F.col(t) for t in ties])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def change_coupling(commit_files: DataFrame, most_files: int = 100) -> DataFrame:
    """(file_a, file_b, together, coupling): commits in common over the lesser number of commits of the two.

    commit_files: commit, file; rows with a null in either count for nothing. The files of a commit are
    cut into blocks of about most_files, and each two blocks are paired in a row of their own, so that
    a commit of any size is counted whole without a task that holds all its pairs.
    """
    distinct = commit_files.select("commit", "file").where("commit IS NOT NULL AND file IS NOT NULL").distinct()
    each = distinct.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    sizes = distinct.groupBy("commit").agg(F.ceil(F.count(F.lit(1)) / most_files).alias("blocks"))
    blocks = checked_join(distinct, sizes, ["commit"], spread_by=["file"]).withColumn("block", F.pmod(F.xxhash64("file"), "blocks")).groupBy("commit", "blocks", "block").agg(F.collect_list("file").alias("files"))
    sides = blocks.select("commit", "block", "files", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")).select("commit", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "files")
    side = lambda c: F.first(F.when(F.col("block") == F.col(c), F.col("files")), ignorenulls=True)
    meet = sides.groupBy("commit", "lo", "hi").agg(side("lo").alias("left"), side("hi").alias("right"))
    pairs = meet.select("lo", "hi", F.explode("left").alias("x"), "right").select("lo", "hi", "x", F.explode("right").alias("y")).where("lo < hi OR x < y").select(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b"))
    together = pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("together"))
    a, b = each.select(F.col("file").alias("file_a"), F.col("n").alias("na")), each.select(F.col("file").alias("file_b"), F.col("n").alias("nb"))
    return together.join(a, "file_a").join(b, "file_b").select("file_a", "file_b", "together", (F.col("together") / F.least("na", "nb")).alias("coupling"))


def enclosing_functions(points: DataFrame, functions: DataFrame, bucket_lines: int = 64) -> DataFrame:
    """points (file, line, ..) with the id of the innermost function (file, start_line, end_line, id) around each line.

    A range join made equal: a function stands in every bucket of lines that it touches, so points only
    meet functions of their file and bucket. Innermost is the latest start, then the earliest end.
    """
    lines = F.sequence(F.floor(F.col("start_line") / bucket_lines), F.floor(F.col("end_line") / bucket_lines))
    spans = functions.where("start_line <= end_line").select("file", "start_line", "end_line", "id", F.explode(lines).alias("_b"))
    keyed = points.withColumn("_b", F.floor(F.col("line") / bucket_lines))
    inside = keyed.join(spans, ["file", "_b"], "left").where("start_line IS NULL OR (start_line <= line AND line <= end_line)")
    best = inside.groupBy(*points.columns).agg(F.max_by("id", F.struct("start_line", -F.col("end_line"), "id")).alias("id"))
    return points.distinct().join(best.where("id IS NOT NULL"), points.columns, "left")


def top_modules(modules: DataFrame, by: str = "function_count", n: int = 10) -> DataFrame:
    """The n modules with the highest value of a column."""
    return modules.orderBy(F.col(by).desc(), "module").limit(n)


def crate_modules(functions: DataFrame, file_lines: DataFrame) -> DataFrame:
    """(module, function_count, lines_of_code): lines are the greater of the functions' and the files' sum, as a file holds more than functions.

    functions: module, lines_of_code. file_lines: module, lines.
    """
    f = functions.groupBy("module").agg(F.count(F.lit(1)).alias("function_count"), F.sum("lines_of_code").alias("_f"))
    files = file_lines.groupBy("module").agg(F.sum("lines").alias("_l"))
    return f.join(files, "module", "full_outer").select("module", F.coalesce("function_count", F.lit(0)).alias("function_count"), F.greatest(F.coalesce("_f", F.lit(0)), F.coalesce("_l", F.lit(0))).alias("lines_of_code"))
