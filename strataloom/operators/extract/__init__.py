"""Extraction of functions, imports, calls, types and syntax nodes from source files.

Each file is parsed once, by one Python pass whose result is a row of arrays; the tables are native
explodes of that row. Files that don't parse give no rows but an error text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import expressions as X
from .. import metrics
from . import lexer, python_ast

# ---- fixed values: language -> extensions ----
LANGUAGES = {"rust": ["rs"], "python": ["py", "pyi"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"]}
# ---- end of fixed values ----

PARSED = (
    "functions array<struct<name:string,start_line:bigint,end_line:bigint,parameter_count:bigint,is_method:boolean,visibility:string,seq:bigint>>,"
    "imports array<struct<import_path:string,symbols:array<string>,is_wildcard:boolean>>, calls array<struct<callee:string,line:bigint>>,"
    "types array<struct<name:string,is_abstract:boolean>>,"
    "nodes array<struct<seq:bigint,kind:string,text:string,line:bigint,nest_level:int,ignored:boolean,logical:boolean>>, error string"
)


class Registry:
    """Languages by extension, with the parser of each."""

    def __init__(self):
        self.parsers: dict[str, object] = {}
        self.extensions: dict[str, str] = {}

    def register(self, language: str, extensions: list[str], parser) -> None:
        self.parsers[language] = parser
        self.extensions.update({e: language for e in extensions})

    def get(self, language: str):
        return self.parsers.get(language)

    def get_for_path(self, path: str) -> str | None:
        return self.extensions.get(path.rsplit(".", 1)[-1]) if "." in path else None

    def languages(self) -> list[str]:
        return sorted(self.parsers)

    def supports_extension(self, extension: str) -> bool:
        return extension.lstrip(".") in self.extensions


def default_registry() -> Registry:
    r = Registry()
    r.register("python", LANGUAGES["python"], python_ast.parse)
    r.register("rust", LANGUAGES["rust"], lexer.parse_rust)
    r.register("typescript", LANGUAGES["typescript"], lexer.parse_typescript)
    r.register("tsx", LANGUAGES["tsx"], lexer.parse_typescript)
    return r


def register_configured(registry: Registry, config: dict[str, dict]) -> None:
    """Adds languages by configuration: name -> {extensions, like}, where like is a known language whose parser is used."""
    for name, entry in config.items():
        parser = registry.get(entry["like"])
        if parser is None:
            raise ValueError(f"{name}: no language {entry['like']}")
        registry.register(name, list(entry["extensions"]), parser)


def with_language(files: DataFrame, registry: Registry, only: str | None = None) -> DataFrame:
    """files (path, ..) of known languages with the column language; the filter stands before any parsing."""
    out = F.lit(None).cast("string")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    for e, language in registry.extensions.items():
        out = F.when(ext == e, language).otherwise(out)
    tagged = files.withColumn("language", out).where("language IS NOT NULL")
    return tagged.where(F.col("language") == only) if only else tagged


def parse_files(files: DataFrame, registry: Registry | None = None, only: str | None = None) -> DataFrame:
    """path, language, module, content and the arrays of PARSED per file (path, content)."""
    registry = registry or default_registry()
    parsers = dict(registry.parsers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for language, content in zip(b["language"], b["content"], strict=True):
                try:
                    rows.append(parsers[language](content or "") | {"error": None})
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"functions": [], "imports": [], "calls": [], "types": [], "nodes": [], "error": str(e)})
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["functions", "imports", "calls", "types", "nodes", "error"])], axis=1)

    tagged = with_language(files.select("path", "content"), registry, only).withColumn("module", X.module_path_by_language("path", "language"))
    return tagged.mapInPandas(run, f"path string, content string, language string, module string, {PARSED}")


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """functions, imports, calls, types, ast_nodes and errors; functions carry their metrics."""
    each = lambda c, *more: parsed.select("path", "language", "module", *more, F.explode(c).alias("x"))
    f = each("functions", "content").select(F.col("path").alias("file_path"), "language", "module", "content", "x.*")
    keyed = F.concat_ws(":", F.col("start_line").cast("string"), F.col("seq").cast("string"))
    f = metrics.dedupe_functions(f.withColumn("function_key", keyed))
    nodes = each("nodes").select(F.col("path").alias("file"), "language", F.col("x.seq").cast("string").alias("_s"), "x.*")
    own = parsed.select("path", "language", F.explode("functions").alias("f"), "nodes").select(F.col("path").alias("file"), "language", F.concat_ws(":", F.col("f.start_line").cast("string"), F.col("f.seq").cast("string")).alias("function_key"), F.explode(F.filter("nodes", lambda n: n["seq"] == F.col("f.seq"))).alias("n")).select("file", "language", "function_key", "n.*")
    lines = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line").cast("int"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    counts = X.line_counts(lines)
    cc, h = metrics.complexity(own), metrics.halstead_metrics(own)
    joined = f.join(cc.withColumnRenamed("file", "file_path"), ["file_path", "function_key"], "left").join(h.withColumnRenamed("file", "file_path"), ["file_path", "function_key"], "left")
    qualified = F.concat("language", F.lit(":"), "module", F.lit("::"), "name")
    functions = joined.select(
        qualified.alias("id"), "name", F.col("file_path").alias("file"), "module", "language", "start_line", "end_line", "is_method", "visibility", F.coalesce("cyclomatic_complexity", F.lit(1)).alias("cyclomatic_complexity"), F.coalesce("cognitive_complexity", F.lit(0)).alias("cognitive_complexity"), "halstead",
        counts["total"].alias("lines_of_code"), counts["logical"].alias("logical_lines"), counts["comment"].alias("comment_lines"), "parameter_count")
    imports = each("imports").select(F.col("module").alias("from_module"), "language", "x.*")
    n = F.size("symbols")
    imports = imports.withColumns({"n_symbols": n, "kind": X.import_kind("is_wildcard", n), "is_external": X.is_external("import_path")})
    calls = each("calls").select(F.col("module").alias("caller"), "x.callee", F.col("path").alias("file_path"), "x.line")
    types = each("types").select("x.name", "module", "x.is_abstract")
    return {"functions": functions, "imports": imports, "calls": calls, "types": types, "ast_nodes": nodes.drop("_s"), "errors": parsed.where("error IS NOT NULL").select("path", "error")}


def extract_sources(files: DataFrame, only: str | None = None) -> dict[str, DataFrame]:
    return tables(parse_files(files, only=only))
