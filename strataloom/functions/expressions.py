"""Column expressions of the metric model: paths, imports, slices, layers, health, bands, Halstead, Martin.

All stay in the JVM. Nulls propagate unless said otherwise.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
#: keyword lists of the layers, in order of precedence
LAYERS = [
    ("handlers", ["handler", "controller", "api", "routes", "endpoint", "view", "main", "cli", "bin", "cmd"]),
    ("services", ["service", "usecase", "application", "interactor", "core", "engine", "processor", "worker"]),
    ("models", ["model", "entity", "domain", "schema", "types", "struct", "metadata", "config"]),
    ("data", ["repository", "repo", "data", "store", "db", "persistence", "storage", "discovery"]),
    ("utils", ["util", "helper", "common", "shared", "lib", "support", "tools", "ext"]),
    ("adapters", ["adapter", "grammars", "queries", "parser", "lexer", "projector", "renderer", "visitor"]),
]
#: lower bound of the health score -> label, colour
HEALTH_BANDS = [(0.80, "Excellent", "#00ff88"), (0.65, "Good", "#44dd77"), (0.50, "OK", "#88cc55"), (0.35, "Warning", "#ddaa33"), (0.20, "Poor", "#ff7744"), (float("-inf"), "Critical", "#ff3333")]
IMPORT_WEIGHTS = {"wildcard": 0.3, "module": 0.5, "multi": 0.7, "single": 1.0}
IMPORT_SCORE_CAP = 3.0
LANGUAGE_SEPARATORS = {"rust": "::", "python": ".", "typescript": "/", "tsx": "/"}
VSA_LAYER_ORDER = ["domain", "aggregates", "commands", "queries", "events", "ports", "application", "infrastructure", "slices"]
# ---- end of fixed values ----


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pieces(c: Column, sep: str) -> Column:
    return F.split(c, re.escape(sep))


# -- module paths and names


def without_extension(path: Column | str) -> Column:
    """path without its last extension; a leading dot of the file name is none."""
    return F.regexp_replace(_c(path), r"(?<=[^/])\.[^./]*$", "")


def module_path(path: Column | str, language: str) -> Column:
    """Module id of a file path relative to the analysis root, by the rules of its language."""
    stem = without_extension(F.translate(_c(path), "\\", "/"))
    if language == "python":
        return F.regexp_replace(F.translate(stem, "/", "."), r"(\.__init__|\.__main__)$", "")
    if language in ("typescript", "tsx"):
        return F.regexp_replace(stem, r"/index$", "")
    segments = F.split(stem, "/")
    last, rest = F.element_at(segments, -1), F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    bare = F.when(F.element_at(F.concat(F.array(F.lit("")), rest), -1) == "src", F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    root = F.when(F.size(rest) == 0, "crate").when((F.size(rest) == 1) & (F.element_at(rest, 1) == "src"), "crate").otherwise(F.translate(F.array_join(bare, "::"), "-", "_"))
    plain = F.when(last == "mod", rest).otherwise(segments)
    return F.when(last.isin("lib", "main"), root).otherwise(F.array_join(F.filter(plain, lambda s: s != "src"), "::"))


def crate_module_path(path: Column | str, crate: str) -> Column:
    """crate::a::b of a path below the crate's src; lib, main and mod name the directory."""
    inner = F.regexp_replace(without_extension(path), r"^(.*/)?src/", "")
    bare = F.regexp_replace(inner, r"(^|/)(lib|main|mod)$", "")
    return F.concat_ws("::", F.lit(crate), F.nullif(F.replace(bare, F.lit("/"), F.lit("::")), F.lit("")))


def in_contexts(module: Column | str, root: str, contexts: list[str]) -> Column:
    """Whether the context of a module is one of those listed."""
    return F.coalesce(context_and_layer(module, root)[0].isin(list(contexts)), F.lit(False))


def module_path_by_language(path: Column | str, language: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for name in LANGUAGE_SEPARATORS:
        out = F.when(_c(language) == name, module_path(path, name)).otherwise(out)
    return out


def short_name(module: Column | str, sep: str = "::") -> Column:
    return F.element_at(_pieces(_c(module), sep), -1)


def directory_of(module: Column | str) -> Column:
    """a::b -> a/b/"""
    return F.concat(F.replace(_c(module), F.lit("::"), F.lit("/")), F.lit("/"))


def language_of(function_id: Column | str) -> Column:
    return F.split_part(_c(function_id), F.lit(":"), F.lit(1))


def relative_path(path: Column | str, root: str) -> Column:
    return F.regexp_replace(_c(path), "^" + re.escape(root.rstrip("/")) + "/", "")


# -- imports


def is_external(import_path: Column | str) -> Column:
    return ~_c(import_path).rlike(r"^(\.|crate|self|super)")


def import_kind(is_wildcard: Column | str, n_symbols: Column | str) -> Column:
    n = _c(n_symbols)
    return F.when(_c(is_wildcard), "wildcard").when(n > 1, "multi").when(n == 1, "single").otherwise("module")


def import_weight(kind: Column | str) -> Column:
    out = F.lit(None).cast("double")
    for k, w in IMPORT_WEIGHTS.items():
        out = F.when(_c(kind) == k, w).otherwise(out)
    return out


def import_score(kind: Column | str, n_symbols: Column | str) -> Column:
    return F.least(import_weight(kind) * F.greatest(_c(n_symbols), F.lit(1)), F.lit(IMPORT_SCORE_CAP))


# -- slices, layers


def slice_id(module: Column | str) -> Column:
    """The first two segments; the separator is / before :: before . ."""
    m = _c(module)
    two = lambda sep: F.array_join(F.slice(_pieces(m, sep), 1, 2), sep)
    return F.when(F.contains(m, F.lit("/")), two("/")).when(F.contains(m, F.lit("::")), two("::")).otherwise(two("."))


def slice_view(module: Column | str, package_roots: dict[str, int] | None = None) -> Column:
    """Slice for views: below a package root the segment of the given number names the slice."""
    m = _c(module)
    parts = _pieces(m, "::")
    special = F.lit(None).cast("string")
    for root, k in (package_roots or {"crates": 2}).items():
        special = F.when((F.element_at(parts, 1) == root) & (F.size(parts) >= k), F.try_element_at(parts, F.lit(k))).otherwise(special)
    two = lambda sep: F.array_join(F.slice(_pieces(m, sep), 1, 2), sep)
    return F.when(F.contains(m, F.lit("::")), F.coalesce(special, two("::"))).when(F.contains(m, F.lit("/")), two("/")).otherwise(two("."))


def layer_of(path: Column | str) -> Column:
    """First layer whose keyword stands anywhere in the lower-cased path."""
    low = F.lower(_c(path))
    out = F.when(F.contains(low, F.lit("examples")), "examples").when(low.rlike("tests|test_"), "tests").when(F.contains(low, F.lit("src")) & ~F.contains(low, F.lit("adapter")), "core").otherwise("other")
    for name, words in reversed(LAYERS):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def contains_path(path: Column | str, root: str) -> Column:
    """Whether the segments of root stand in path as neighbours."""
    inner = F.concat(F.lit("/"), F.array_join(F.split(_c(path), r"::|[/.]"), "/"), F.lit("/"))
    return F.contains(inner, F.lit("/" + "/".join(re.split(r"::|[/.]", root.strip("/."))) + "/"))


def context_and_layer(module: Column | str, root: str) -> tuple[Column, Column]:
    """The segment after root, and the next one; domain drills down one more, aggregate_x is aggregates."""
    wanted = [s for s in re.split(r"::|[/.]", root) if s]
    parts = F.split(_c(module), r"::|[/.]")
    n = len(wanted)
    at = F.element_at(F.concat(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1))), lambda i: F.when(F.slice(parts, i, n) == F.array(*map(F.lit, wanted)), i)), lambda i: i.isNotNull()), F.array(F.lit(None).cast("int"))), 1)
    context, one, two = (F.try_element_at(parts, at + n + k) for k in range(3))
    drilled = F.when((one == "domain") & two.isNotNull(), F.when(two.startswith("aggregate_"), "aggregates").otherwise(two)).otherwise(one)
    return F.when(at.isNotNull(), context), F.when(at.isNotNull(), F.when(one.startswith("aggregate_"), "aggregates").otherwise(drilled))


def feature_name(module: Column | str, layer: Column | str) -> tuple[Column, Column]:
    """(feature, short name): the segments after the layer, else the last two."""
    parts = F.split(_c(module), r"::|[/.]")
    at = F.array_position(parts, _c(layer))
    after = F.when(at > 0, F.slice(parts, at.cast("int") + 1, F.size(parts))).otherwise(F.slice(parts, -F.least(F.lit(2), F.size(parts)), 2))
    return F.try_element_at(after, F.lit(1)), F.array_join(after, ".")


def layer_order(layer: Column | str) -> Column:
    known = F.array(*map(F.lit, VSA_LAYER_ORDER))
    at = F.array_position(known, _c(layer))
    return F.when(at > 0, at).otherwise(F.lit(len(VSA_LAYER_ORDER) + 1))


# -- scores


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(c)))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def health_parts(functions: Column | str, cyclomatic: Column | str, cognitive: Column | str, lines: Column | str, coupling: Column | str, variant: str = "module") -> list[Column]:
    """Complexity, cognitive load, function size, coupling and module size, each in 0 to 1.

    variant "city" scores coupling and module size without jumps.
    """
    f, k = _c(functions), _c(coupling)
    n = F.greatest(f, F.lit(1)).cast("double")
    cc, cog, loc = _c(cyclomatic) / n, _c(cognitive) / n, _c(lines) / n
    zero = F.lit(0.0)
    falling = lambda x, start, span, least=0.0: F.greatest(F.lit(least), 1 - (x - start) / span)
    if variant == "city":
        couple, size = clamp(1 - F.abs(k - 10) / 30.0), F.when(f < 2, 0.5).otherwise(falling(F.greatest(f, F.lit(30)), 30, 70.0))
    else:
        couple = F.when(k == 0, 0.6).when(k > 20, falling(k, 10, 30.0, 0.2)).otherwise(1.0)
        size = F.when(f < 2, 0.5).when(f > 50, falling(f, 30, 70.0, 0.3)).otherwise(1.0)
    return [F.when(cc > 5, falling(cc, 5, 15.0)).otherwise(1.0), F.greatest(zero, 1 - cog / 30.0), F.when(loc > 50, falling(loc, 50, 100.0)).otherwise(1.0), couple, size]


def health(functions: Column | str, cyclomatic: Column | str, cognitive: Column | str, lines: Column | str, coupling: Column | str, variant: str = "module") -> Column:
    parts = health_parts(functions, cyclomatic, cognitive, lines, coupling, variant)
    return sum(parts[1:], parts[0]) / F.lit(float(len(parts)))


def _ladder(c: Column, steps: list[tuple[float, object]]) -> Column:
    """The value of the first step whose bound c reaches."""
    out = F.lit(steps[-1][1])
    for bound, value in reversed(steps[:-1]):
        out = F.when(c >= bound, F.lit(value)).otherwise(out)
    return out


def health_label(score: Column | str) -> Column:
    return _ladder(_c(score), [(b, label) for b, label, _ in HEALTH_BANDS])


def health_colour(score: Column | str) -> Column:
    return _ladder(_c(score), [(b, colour) for b, _, colour in HEALTH_BANDS])


def risk_band(value: Column | str, kind: str = "cyclomatic") -> Column:
    """low, moderate, high, very_high."""
    a, b, c = (11, 21, 51) if kind == "cyclomatic" else (6, 16, 26)
    return _ladder(_c(value), [(c, "very_high"), (b, "high"), (a, "moderate"), (float("-inf"), "low")])


def stability_band(instability: Column | str, distance: Column | str) -> Column:
    return F.when(_c(distance) > 0.5, "zone_of_pain").when(_c(instability) < 0.3, "stable").when(_c(instability) > 0.7, "unstable").otherwise("balanced")


def distance_colour(distance: Column | str) -> Column:
    """Green on the main sequence, over yellow, to red."""
    d = clamp(distance)
    red, green = F.least(F.lit(1.0), 2 * d), F.least(F.lit(1.0), 2 * (1 - d))
    return F.format_string("#%02x%02x40", F.round(red * 255).cast("int"), F.round(green * 255).cast("int"))


def edge_width(strength: Column | str) -> Column:
    return _c(strength) * 2


def edge_colour(strength: Column | str) -> Column:
    grey = F.floor(clamp(strength) * 255).cast("int")
    return F.format_string("#%02x%02x%02x", grey, grey, grey)


def node_size(functions: Column | str, scale: float = 1.0) -> Column:
    return F.least(_c(functions) / 5.0 + 0.5, F.lit(2.5)) * scale


def node_radius(lines: Column | str) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(28.0), F.sqrt(_c(lines)) * 0.35))


def building_height(cyclomatic: Column | str) -> Column:
    return F.greatest(F.lit(0.5), F.log10(_c(cyclomatic) + 1) * 4)


def top_package(module: Column | str) -> Column:
    return F.array_join(F.slice(F.split(_c(module), r"\."), 1, 2), ".")


def style_class(distance: Column | str) -> Column:
    return F.when(_c(distance) > 0.6, "danger").when(_c(distance) > 0.3, "warning")


def diagram_id(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"::|[-./]", "_")


def infer_context(name: Column | str, contexts: dict[str, str]) -> Column:
    """The context of the longest keyword that stands in the name."""
    out = F.lit("other")
    for word in sorted(contexts, key=lambda w: (len(w), w)):
        out = F.when(F.contains(F.lower(_c(name)), F.lit(word)), contexts[word]).otherwise(out)
    return out


# -- metrics


def halstead(n1: Column | str, n2: Column | str, total1: Column | str, total2: Column | str) -> Column:
    """struct(vocabulary, length, volume, difficulty, effort, time_to_implement, estimated_bugs) of distinct and total operators and operands."""
    n1, n2, t1, t2 = map(_c, (n1, n2, total1, total2))
    vocabulary, length = n1 + n2, t1 + t2
    volume = F.when(vocabulary > 0, length * F.log2(F.greatest(vocabulary, F.lit(1)).cast("double"))).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2.0 * (t2 / F.greatest(n2, F.lit(1)).cast("double"))).otherwise(0.0)
    effort = difficulty * volume
    return F.struct(vocabulary.cast("bigint").alias("vocabulary"), length.cast("bigint").alias("length"), volume.alias("volume"), difficulty.alias("difficulty"), effort.alias("effort"), (effort / 18.0).alias("time_to_implement"), (volume / 3000.0).alias("estimated_bugs"))


def martin(ca: Column | str, ce: Column | str, n_types: Column | str, n_abstract: Column | str, isolated_instability: float = 0.5) -> Column:
    """struct(ca, ce, instability, abstractness, distance_from_main_sequence)."""
    ca, ce, t, a = map(_c, (ca, ce, n_types, n_abstract))
    instability = ratio(ce.cast("double"), (ca + ce).cast("double"), isolated_instability)
    abstractness = ratio(a.cast("double"), t.cast("double"))
    return F.struct(ca.cast("bigint").alias("ca"), ce.cast("bigint").alias("ce"), instability.alias("instability"), abstractness.alias("abstractness"), F.abs(abstractness + instability - 1).alias("distance_from_main_sequence"))


def maintainability_index(volume: Column | str, cyclomatic: Column | str, lines: Column | str) -> Column:
    """The published three-factor index on a scale of 0 to 100."""
    v, loc = F.greatest(_c(volume), F.lit(1.0)), F.greatest(_c(lines), F.lit(1)).cast("double")
    return clamp((171 - 5.2 * F.ln(v) - 0.23 * _c(cyclomatic) - 16.2 * F.ln(loc)) * 100 / 171, 0.0, 100.0)


def line_counts(text: Column | str) -> Column:
    """struct(total, logical, comment, blank) of a source text.

    A block opens on a line beginning with /* or three quotes unless the line also ends a block, and
    closes on a line ending in */ or three quotes; lines beginning with // or # are comments.
    """
    lines = F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\r?\n$", ""), r"\r?\n")
    lines = F.when(F.length(_c(text)) > 0, lines).otherwise(F.array().cast("array<string>"))
    zero = F.struct(F.lit(0).alias("logical"), F.lit(0).alias("comment"), F.lit(0).alias("blank"), F.lit(False).alias("inside"))

    def step(s: Column, line: Column) -> Column:
        t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        opens = t.rlike(r'^(/\*|""")')
        closes = t.rlike(r'(\*/|""")$')
        begins = ~s["inside"] & opens & ~closes
        comment = s["inside"] | opens | t.rlike(r"^(//|#)")
        inside = (s["inside"] | begins) & ~(closes & s["inside"])
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct((s["logical"] + one(~comment & (t != ""))).alias("logical"), (s["comment"] + one(comment)).alias("comment"), (s["blank"] + one(~comment & (t == ""))).alias("blank"), inside.alias("inside"))

    counts = F.aggregate(lines, zero, step)
    return F.struct(F.size(lines).alias("total"), counts["logical"].alias("logical"), counts["comment"].alias("comment"), counts["blank"].alias("blank"))


# -- texts, globs, versions


def glob_to_regex(pattern: str) -> str | None:
    """An anchored regular expression; * crosses /, ** must be a whole segment; None if the glob is invalid."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            j = i
            while j < len(pattern) and pattern[j] == "*":
                j += 1
            if j - i > 2 or (j - i == 2 and not ((i == 0 or pattern[i - 1] == "/") and (j == len(pattern) or pattern[j] == "/"))):
                return None
            if j - i == 2 and j < len(pattern):
                out, i = out + "(?:.*/)?", j + 1
                continue
            out, i = out + ".*", j
            continue
        if c == "?":
            out += "."
        elif c == "[":
            negated = pattern[i + 1 : i + 2] == "!"
            end = pattern.find("]", i + 2 + negated)
            if end < 0:
                return None
            body = pattern[i + 1 + negated : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out, i = out + "[" + ("^" if negated else "") + body + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_any_glob(c: Column | str, patterns: list[str]) -> Column:
    known = [r for r in map(glob_to_regex, patterns) if r]
    return reduce(lambda a, b: a | b, [_c(c).rlike(r) for r in known], F.lit(False))


def matches_loose_glob(path: Column | str, pattern: str) -> Column:
    """a**b: both parts stand in the path; else the pattern without outer stars does."""
    if pattern.count("**") == 1:
        parts = [p.strip("/") for p in pattern.split("**")]
        return reduce(lambda a, b: a & b, [F.contains(_c(path), F.lit(p)) for p in parts if p], F.lit(True))
    return F.contains(_c(path), F.lit(pattern.strip("*")))


def signed(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", _c(c).cast("double"))


def percent_int(c: Column | str) -> Column:
    return F.floor(_c(c) * 100).cast("bigint")


def log_scaled(c: Column | str) -> Column:
    """ln(v + 1)."""
    return F.log1p(_c(c).cast("double"))


def civil_date(epoch_seconds: Column | str) -> Column:
    """yyyy-mm-dd of seconds since 1970, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_c(epoch_seconds) / 86400).cast("int")), "yyyy-MM-dd")


def escape_script(c: Column | str) -> Column:
    """Text safe inside a script element."""
    return F.regexp_replace(F.regexp_replace(_c(c), "(?i)</(script)", r"<\\/$1"), "<!--", r"<\\!--")


def valid_version(c: Column | str, parts: str = "2-3") -> Column:
    """parts: 2-3 as validation has it, or 3 as parsing has it; every part is a number."""
    return _c(c).rlike(r"^\d+(\.\d+){1,2}$" if parts == "2-3" else r"^\d+\.\d+\.\d+$")


def parse_version(c: Column | str) -> Column:
    """struct(major, minor, patch); null unless three numbers."""
    p = F.split(_c(c), r"\.")
    number = lambda i: F.try_element_at(p, F.lit(i)).try_cast("bigint").alias(("major", "minor", "patch")[i - 1])
    return F.when(valid_version(c, "3"), F.struct(number(1), number(2), number(3)))


def bump_version(c: Column | str, part: str) -> Column:
    """Two parts are read as three with patch 0."""
    p = F.split(_c(c), r"\.")
    number = [F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("bigint"), F.lit(0)) for i in (1, 2, 3)]
    at = ("major", "minor", "patch").index(part)
    new = [n if i < at else n + 1 if i == at else F.lit(0) for i, n in enumerate(number)]
    return F.when(valid_version(c), F.concat_ws(".", *[n.cast("string") for n in new]))


def package_id_kind(c: Column | str, standard: str = "STD-V1", experiment: str = "EXP-V1") -> Column:
    """standard, experiment or substandard by the form PREFIX-0000 or PREFIX-0000.AA00; null if none."""
    s, e = re.escape(standard), re.escape(experiment)
    return F.when(_c(c).rlike(rf"^{s}-\d{{4}}$"), "standard").when(_c(c).rlike(rf"^{e}-\d{{4}}$"), "experiment").when(_c(c).rlike(rf"^{s}-\d{{4}}\.[A-Z]{{2}}\d{{2}}$"), "substandard")


def title_of_slug(c: Column | str) -> Column:
    return F.initcap(F.translate(_c(c), "-_", "  "))


def issue_url(base: str, repo: Column | str, number: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), _c(repo), F.lit("/issues/"), _c(number).cast("string"))


def number_at(doc: Column, path: str) -> Column:
    """A JSON number of a variant at a dotted path, as double; anything else, numeric strings too, is null."""
    v = F.try_variant_get(doc, "$." + path if path else "$", "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"), F.try_variant_get(v, "$", "double"))
