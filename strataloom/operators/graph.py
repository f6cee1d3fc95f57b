"""Graph operators over edge lists: neighbours, reachability, cycles, dependency rules, layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..runtime import checked_join, discard, materialize

#: Modules a layout may have: one task holds all pairs.
MOST_NODES = 5000


def neighbours(edges: DataFrame, module: str) -> DataFrame:
    """(direction, module, weight): what module depends on, and what depends on it; the filter reaches the scan of edges."""
    out = edges.where(F.col("src") == module).select(F.lit("dependency").alias("direction"), F.col("dst").alias("module"), "weight")
    return out.unionByName(edges.where((F.col("dst") == module) & (F.col("src") != module)).select(F.lit("dependent").alias("direction"), F.col("src").alias("module"), "weight"))


def reachable_pairs(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hops): least number of steps between modules, up to hops; each step is one join with the edges, written to the shared folder."""
    base = materialize(edges.select("src", "dst").distinct(), "edges")
    found = materialize(base.withColumn("hops", F.lit(1)), "reach")
    front = found
    for h in range(2, hops + 1):
        step = front.select("src", F.col("dst").alias("via")).join(base.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        front = materialize(step.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(h)), "reach-step")
        if front.isEmpty():
            break
        found = materialize(found.unionByName(front), "reach")
    return found


def focus(edges: DataFrame, module: str, hops: int) -> DataFrame:
    """(module, hops) within so many steps of module, in either direction; only the front is joined."""
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    seen = both.sparkSession.createDataFrame([(module, 0)], "module string, hops int")
    front = seen
    for h in range(1, hops + 1):
        step = front.select(F.col("module").alias("src")).join(both, "src").select(F.col("dst").alias("module")).distinct()
        front = materialize(step.join(seen, "module", "left_anti").withColumn("hops", F.lit(h)), "focus")
        seen = seen.unionByName(front)
    return seen


def cycle_members(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(module) of modules on a cycle.

    Modules without an incoming or outgoing edge are trimmed while that removes a tenth of the edges,
    which leaves cycles and the paths between them. On the rest, a module is on a cycle if its label
    returns: the greatest labels are sent forwards and backwards until they settle; edges between
    different labels are cut, and the two steps repeat until nothing is cut. What has an edge within
    its label then is on one. An error is raised if max_rounds do not suffice.
    """
    whole = rest = materialize(edges.select("src", "dst").distinct(), "cycle")
    loops = rest.where("src = dst").select(F.col("src").alias("module"))
    size = rest.count()
    for _ in range(max_rounds):
        while size:
            trimmed = materialize(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cycle")
            n, before = trimmed.count(), size
            if rest is not whole:
                discard(rest)
            rest, size = trimmed, n
            if 10 * (before - n) < before:
                break
        if size == 0:
            break
        forward, backward = _spread(rest, "src", "dst", max_rounds), _spread(rest, "dst", "src", max_rounds)
        label = materialize(forward.withColumnRenamed("label", "f").join(backward.withColumnRenamed("label", "b"), "module"), "labels")
        side = lambda c: label.select(F.col("module").alias(c), F.struct("f", "b").alias(f"_{c}"))
        kept = materialize(rest.join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst").select("src", "dst"), "cycle")
        n = kept.count()
        if n == size:
            break
        rest, size = kept, n
    else:
        raise RuntimeError(f"cycles not found in {max_rounds} rounds")
    return rest.select(F.explode(F.array("src", "dst")).alias("module")).unionByName(loops).distinct()


def _spread(edges: DataFrame, source: str, target: str, max_rounds: int) -> DataFrame:
    """(module, label): the greatest module that reaches it along the edges, itself included.

    Greatest is by hash, then name. Each round sends labels over one edge and takes the label of the
    label as well, since that reaches the module too; so the rounds grow with the logarithm of a path.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("module")).distinct()
    label = materialize(nodes.withColumn("label", F.struct(F.xxhash64("module").alias("hash"), F.col("module").alias("name"))), "labels")
    for _ in range(max_rounds):
        sent = edges.select(F.col(source).alias("_s"), F.col(target).alias("module")).join(label.select(F.col("module").alias("_s"), "label"), "_s").select("module", "label")
        moved = label.where("label.name <> module")
        jumped = checked_join(moved.select("module", F.col("label.name").alias("_s")), moved.select(F.col("module").alias("_s"), "label"), ["_s"], spread_by=["module"]).select("module", "label")
        new = materialize(label.unionByName(sent).unionByName(jumped).groupBy("module").agg(F.max("label").alias("label")), "labels")
        changed = new.join(label.withColumnRenamed("label", "_old"), "module").where("label <> _old").limit(1).count()
        discard(label)
        label = new
        if not changed:
            return label
    raise RuntimeError(f"labels not settled in {max_rounds} rounds")


def edge_rules(edges: DataFrame, forbidden: list[tuple[str, str]] = (), allowed: list[tuple[str, str]] = (), required: list[tuple[str, str]] = ()) -> DataFrame:
    """(rule, src, dst): edges that match a forbidden pair of globs, or no allowed pair though one names their source, and required pairs that no edge matches."""
    hit = lambda pairs: [X.matches_any_glob("src", [a]) & X.matches_any_glob("dst", [b]) for a, b in pairs]
    base = edges.select("src", "dst").distinct()
    bad = F.lit(False)
    for c in hit(forbidden):
        bad = bad | c
    out = base.where(bad).select(F.lit("forbidden").alias("rule"), "src", "dst")
    if allowed:
        named, ok = F.lit(False), F.lit(False)
        for (a, _), c in zip(allowed, hit(allowed), strict=True):
            named, ok = named | X.matches_any_glob("src", [a]), ok | c
        out = out.unionByName(base.where(named & ~ok).select(F.lit("not_allowed").alias("rule"), "src", "dst"))
    if required:
        there = base.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"r{i}") for i, c in enumerate(hit(required))])
        rows = F.array(*[F.struct(F.col(f"r{i}").alias("there"), F.lit(a).alias("src"), F.lit(b).alias("dst")) for i, (a, b) in enumerate(required)])
        out = out.unionByName(there.select(F.explode(rows).alias("x")).where("NOT x.there").select(F.lit("required").alias("rule"), "x.src", "x.dst"))
    return out


def filter_graph(nodes: DataFrame, edges: DataFrame, drop_prefixes: list[str] = (), least_lines: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (module, lines_of_code) of some size without the prefixes, and the edges between them."""
    kept = nodes.where(F.col("lines_of_code") >= least_lines)
    for p in drop_prefixes:
        kept = kept.where(~F.startswith(F.col("module"), F.lit(p)))
    ids = kept.select("module")
    return kept, edges.join(ids.withColumnRenamed("module", "src"), "src", "left_semi").join(ids.withColumnRenamed("module", "dst"), "dst", "left_semi").select(*edges.columns)


def layout_positions(n: int, src: np.ndarray, dst: np.ndarray, value: np.ndarray, iterations: int = 300, repulsion: float = 1.0, attraction: float = 0.1, least: float = 0.0) -> np.ndarray:
    """Positions (n, 3) by force steps from a helix; no chance is involved."""
    i = np.arange(n)
    angle = 2 * np.pi * i / max(n, 1)
    at = np.stack([5 * np.cos(angle), 5 * np.sin(angle), 0.5 * i - 0.25 * n], 1)
    pull = value > least
    src, dst, value = src[pull], dst[pull], value[pull]
    for _ in range(iterations):
        gap = at[:, None, :] - at[None, :, :]
        square = (gap**2).sum(2)
        size = np.sqrt(square)
        with np.errstate(divide="ignore", invalid="ignore"):
            push = np.where(size > 0, repulsion / (square + 0.01) / size, 0.0)
        force = (gap * push[:, :, None]).sum(1)
        line = at[dst] - at[src]
        far = np.maximum(np.sqrt((line**2).sum(1)), 0.1)
        np.add.at(force, src, line / far[:, None] * (attraction * value * far)[:, None])
        at = at + 0.85 * np.clip(0.01 * force, -0.5, 0.5)
    return at - at.mean(0) if n else at


def layout(modules: DataFrame, edges: DataFrame, iterations: int = 300, repulsion: float = 1.0, attraction: float = 0.1, least: float = 0.0) -> DataFrame:
    """(module, x, y, z) of the whole graph, in one task; graphs of more than MOST_NODES modules are refused."""
    names = modules.select("module").distinct()
    if names.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError("too many modules for a layout; cut the graph to a focus or to slices first")
    rows = names.select(F.lit(0).alias("g"), "module", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("value")).unionByName(edges.where("src <> dst").select(F.lit(0).alias("g"), F.col("src").alias("module"), "dst", F.col("value").cast("double").alias("value")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(pdf.loc[pdf["dst"].isna(), "module"])
        index = {m: k for k, m in enumerate(nodes)}
        e = pdf[pdf["dst"].notna() & pdf["module"].isin(index) & pdf["dst"].isin(index)].sort_values(["module", "dst"])
        at = layout_positions(len(nodes), e["module"].map(index).to_numpy(np.int64), e["dst"].map(index).to_numpy(np.int64), e["value"].to_numpy(float), iterations, repulsion, attraction, least)
        return pd.DataFrame({"module": nodes, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    return rows.groupBy("g").applyInPandas(run, "module string, x double, y double, z double")
