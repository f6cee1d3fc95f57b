"""Projectors: graphs and metrics as diagrams, scenes and view tables.

A projector takes edge and module DataFrames and gives text rows; texts are joined by Spark and
meant for graphs that a person looks at.
"""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import graph, slices

FORMATS = ("mermaid", "c4", "markdown", "json", "dot", "html")


class Projector(Protocol):
    """What a renderer offers."""

    name: str

    def supported_formats(self) -> list[str]: ...

    def config_schema(self) -> dict: ...

    def validate_config(self, config: dict) -> list[str]: ...

    def render(self, edges: DataFrame, modules: DataFrame, format: str, config: dict) -> DataFrame: ...


def _text(rows: DataFrame, order: str, line: str, header: str) -> DataFrame:
    """One row text: the header and the lines in order."""
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda s: s["l"]), "\n").alias("body"))
    return body.select(F.concat(F.lit(header + "\n"), F.coalesce("body", F.lit(""))).alias("text"))


def folded(edges: DataFrame, fold: str = "upper") -> DataFrame:
    """(src, dst, value) with src < dst: upper keeps one direction, sum and max merge both."""
    if fold == "upper":
        return edges.where("src < dst").select("src", "dst", "value")
    merge = F.sum if fold == "sum" else F.max
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(merge("value").alias("value"))


def mermaid(edges: DataFrame, modules: DataFrame, least: float = 0.0, fold: str = "upper", direction: str = "TD") -> DataFrame:
    """One row text, a flowchart: nodes with a style class by distance, edges with their strength in percent."""
    name = lambda c: X.diagram_id(c)
    style = X.style_class("distance")
    nodes = modules.select(F.concat(F.lit("0"), "module").alias("o"), F.concat(F.lit("    "), name("module"), F.lit('["'), F.col("module"), F.lit('"]'), F.when(style.isNotNull(), F.concat(F.lit(":::"), style)).otherwise("")).alias("l"))
    lines = folded(edges, fold).where(F.col("value") >= least).select(F.concat(F.lit("1"), "src", F.lit(" "), "dst").alias("o"), F.concat(F.lit("    "), name("src"), F.lit(" -->|"), X.percent_int("value").cast("string"), F.lit("%| "), name("dst")).alias("l"))
    return _text(nodes.unionByName(lines), "o", "l", f"flowchart {direction}\n    classDef danger fill:#f66\n    classDef warning fill:#fc6")


def c4(edges: DataFrame, modules: DataFrame, level: str = "context", least: float = 0.3) -> DataFrame:
    """One row text: systems and their relations, or with level container the modules of each system."""
    nodes, pairs = slices.systems(edges, modules, least)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    if level == "container":
        first = F.element_at(F.split("module", r"::|[/.]"), 1)
        rows = modules.select(F.concat(F.lit("0"), first, F.lit(" "), "module").alias("o"), F.concat(F.lit("    Container("), X.diagram_id("module"), F.lit(", "), quoted("module"), F.lit(', "module")')).alias("l"))
        rel = edges.where((F.col("value") >= least) & (F.col("src") != F.col("dst"))).select(F.concat(F.lit("1"), "src", F.lit(" "), "dst").alias("o"), F.concat(F.lit("    Rel("), X.diagram_id("src"), F.lit(", "), X.diagram_id("dst"), F.lit(', "uses")')).alias("l"))
        return _text(rows.unionByName(rel), "o", "l", "C4Container")
    rows = nodes.select(F.concat(F.lit("0"), "system").alias("o"), F.concat(F.lit("    System("), X.diagram_id("system"), F.lit(", "), quoted("system"), F.lit(', "'), F.col("modules").cast("string"), F.lit(' modules")')).alias("l"))
    rel = pairs.select(F.concat(F.lit("1"), "a", F.lit(" "), "b").alias("o"), F.concat(F.lit("    Rel("), X.diagram_id("a"), F.lit(", "), X.diagram_id("b"), F.lit(', "uses")')).alias("l"))
    return _text(rows.unionByName(rel), "o", "l", "C4Context")


def dot(edges: DataFrame, modules: DataFrame, least: float = 0.0) -> DataFrame:
    """One row text, a digraph."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = modules.select(F.concat(F.lit("0"), "module").alias("o"), F.concat(F.lit("  "), quoted("module"), F.lit(";")).alias("l"))
    lines = edges.where((F.col("value") >= least) & (F.col("src") != F.col("dst"))).select(F.concat(F.lit("1"), "src", F.lit(" "), "dst").alias("o"), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.format_string(' [penwidth=%.2f, color="%s"];', X.edge_width("value").cast("double"), X.edge_colour("value"))).alias("l"))
    out = _text(nodes.unionByName(lines), "o", "l", "digraph modules {")
    return out.select(F.concat("text", F.lit("\n}")).alias("text"))


def markdown_table(df: DataFrame, columns: list[str], order: str, title: str) -> DataFrame:
    """One row text: a table of the columns in the order of a column."""
    cell = lambda c: F.coalesce(F.format_string("%.2f", F.col(c)) if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(order).cast("string").alias("o"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("l"))
    return _text(rows, "o", "l", f"# {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}")


def scene(edges: DataFrame, modules: DataFrame, least: float = 0.0, fold: str = "upper", seed: int = 42) -> DataFrame:
    """One row: nodes, edges, camera and metadata of a 3D scene. modules: module, function_count, distance. seed is kept as metadata only."""
    at = graph.layout(modules, edges)
    points = at.join(modules, "module").select(F.struct(F.col("module").alias("id"), F.array("x", "y", "z").alias("position"), X.node_size("function_count").alias("size"), X.distance_colour("distance").alias("colour")).alias("n"))
    lines = folded(edges, fold).where(F.col("value") >= least).select(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "value", X.edge_width("value").alias("width"), X.edge_colour("value").alias("colour")).alias("e"))
    one = points.agg(F.array_sort(F.collect_list("n")).alias("nodes")).withColumn("_one", F.lit(1)).join(lines.agg(F.array_sort(F.collect_list("e")).alias("edges")).withColumn("_one", F.lit(1)), "_one")
    return one.select("nodes", "edges", F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(20.0)).alias("position"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("target")).alias("camera"), F.struct(F.lit(seed).alias("seed")).alias("metadata"))


def html(title: str, data: list[dict]) -> str:
    """A page that holds the data of a bounded view table for scripts, and shows it as a table."""
    safe = json.dumps(data, default=str).replace("</", "<\\/").replace("<!--", "<\\!--")
    keys = list(data[0]) if data else []
    head = "".join(f"<th>{k}</th>" for k in keys)
    body = "".join("<tr>" + "".join(f"<td>{str(r[k]).replace('&', '&amp;').replace('<', '&lt;')}</td>" for k in keys) + "</tr>" for r in data)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><table><tr>{head}</tr>{body}</table><script>const DATA = {safe};</script></body></html>"


class DiagramProjector:
    """The text projectors behind one interface."""

    name = "diagram"

    def supported_formats(self) -> list[str]:
        return ["mermaid", "c4", "dot"]

    def config_schema(self) -> dict:
        return {"type": "object", "properties": {"least": {"type": "number", "minimum": 0, "maximum": 1}, "fold": {"enum": ["upper", "sum", "max"]}}}

    def validate_config(self, config: dict) -> list[str]:
        out = [] if 0 <= config.get("least", 0) <= 1 else ["least must be within 0 and 1"]
        return out + ([] if config.get("fold", "upper") in ("upper", "sum", "max") else ["fold must be upper, sum or max"])

    def render(self, edges: DataFrame, modules: DataFrame, format: str, config: dict) -> DataFrame:
        if format not in self.supported_formats() or self.validate_config(config):
            raise ValueError(f"format or config not supported: {format} {config}")
        if format == "mermaid":
            return mermaid(edges, modules, config.get("least", 0.0), config.get("fold", "upper"))
        return c4(edges, modules, config.get("level", "context"), config.get("least", 0.3)) if format == "c4" else dot(edges, modules, config.get("least", 0.0))


def column_text(c: Column | str) -> Column:
    return X.escape_script(c)
