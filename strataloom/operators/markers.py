"""Work markers (TODO, FIXME) in comment lines of source texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

# ---- fixed values ----
TAGS = ("TODO", "FIXME")
#: language -> extensions, beginnings of comment lines
COMMENTS = {
    "rust": ([".rs"], ["//", "/*"]), "typescript": ([".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"], ["//", "/*"]), "python": ([".py", ".pyi"], ["#"]), "go": ([".go"], ["//", "/*"]),
    "c_cpp": ([".c", ".cpp", ".cc", ".cxx", ".h", ".hpp"], ["//", "/*"]), "java": ([".java"], ["//", "/*"]), "ruby": ([".rb"], ["#"]), "shell": ([".sh", ".bash", ".zsh"], ["#"]),
}
GENERIC_COMMENTS = ["//", "#", "--", "/*"]
MAX_FILE_MB = 10
MAX_ISSUE = 2**32 - 1
# ---- end of fixed values ----


def extension(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def may_be_comment(line: Column | str, ext: Column | str) -> Column:
    """Whether the line begins like a comment in the language of the extension."""
    begins = lambda marks: F.rlike(F.col(line) if isinstance(line, str) else line, F.lit(r"^\s*(" + "|".join(map(re.escape, marks)) + ")"))
    out = begins(GENERIC_COMMENTS)
    for exts, marks in COMMENTS.values():
        out = F.when((F.col(ext) if isinstance(ext, str) else ext).isin(exts), begins(marks)).otherwise(out)
    return out


def scan_files(files: DataFrame, extensions: list[str] = (), exclude: list[str] = (), max_mb: int = MAX_FILE_MB) -> DataFrame:
    """files (file, size, ..) that are to be scanned: size in whole MB up to max_mb, extension, loose globs."""
    out = files.where(F.floor(F.col("size") / (1024 * 1024)) <= max_mb)
    if extensions:
        out = out.where(extension("file").isin(list(extensions)))
    for pattern in exclude:
        out = out.where(~X.matches_loose_glob("file", pattern))
    return out


def lines_of(files: DataFrame) -> DataFrame:
    """(file, ext, line, text) of files (file, content); lines count from 1, a last line end opens no line."""
    body = F.regexp_replace("content", r"\r?\n$", "")
    lines = F.when(F.length("content") > 0, F.split(body, r"\r?\n"))
    return files.select("file", extension("file").alias("ext"), F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


def marker_items(lines: DataFrame, tags: tuple[str, ...] = TAGS, base_url: str = "https://github.com", repo: str | None = None) -> DataFrame:
    """(id, tag, file, line, column, text, description, issue struct) of the comment lines with a marker, the first of a line."""
    prefix = F.regexp_extract("text", r"^\s*(//!|///|//|#|/\*|\*)?", 0)
    content = F.substring("text", F.length(prefix) + 1, F.length("text"))
    pattern = rf"({'|'.join(map(re.escape, tags))})(\(#(\d+)\))?:\s*(.+)"
    part = lambda k: F.regexp_extract(content, pattern, k)
    number = F.nullif(part(3), F.lit("")).try_cast("bigint")
    issue = F.when(number <= MAX_ISSUE, F.struct(F.lit("github").alias("type"), number.alias("number"), F.lit(repo).cast("string").alias("repo"), (X.issue_url(base_url, F.lit(repo), number) if repo else F.lit(None).cast("string")).alias("url")))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return (
        lines.where(may_be_comment("text", "ext") & content.rlike(pattern))
        .select("file", "line", part(1).alias("tag"), (F.octet_length(prefix) + 1).alias("column"), text.alias("text"), F.regexp_replace(part(4), r"^\s+|\s+$", "").alias("description"), issue.alias("issue"))
        .withColumn("id", F.sha2(F.concat_ws(":", "file", F.col("line").cast("string"), "text"), 256))
    )


def marker_summary(items: DataFrame) -> DataFrame:
    """(level, key, total, tracked, untracked): over all, by tag, by file, by issue ("null" if none), in one pass."""
    keyed = items.select("tag", "file", F.coalesce(F.col("issue.number").cast("string"), F.lit("null")).alias("issue"), F.col("issue").isNotNull().alias("tracked"))
    sets = keyed.groupingSets([[], ["tag"], ["file"], ["issue"]], "tag", "file", "issue").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), F.count_if("tracked").alias("tracked"), F.count_if(~F.col("tracked")).alias("untracked"))
    level = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "tag").when(F.col("_g") == 5, "file").otherwise("issue")
    return sets.select(level.alias("level"), F.coalesce("tag", "file", "issue", F.lit("")).alias("key"), "total", "tracked", "untracked")


def marker_totals(items: DataFrame) -> DataFrame:
    """One row: items, files, tracked, untracked."""
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("file").alias("files"), F.count_if(F.col("issue").isNotNull()).alias("tracked"), F.count_if(F.col("issue").isNull()).alias("untracked"))


def needs_issue(tag: Column | str, policy: list[str]) -> Column:
    return F.array_contains(F.array(*map(F.lit, policy)), F.col(tag) if isinstance(tag, str) else tag) if policy else F.lit(False)


def untracked(items: DataFrame, policy: list[str], level: str = "warn") -> DataFrame:
    """Diagnostics for items that need an issue and have none; level off, warn or error."""
    at = enforcement(level)
    if at == "off":
        return diagnostics(items.where(F.lit(False)), "info")
    return diagnostics(items.where(needs_issue("tag", policy) & F.col("issue").isNull()), "error" if at == "error" else "warning")


def diagnostics(items: DataFrame, severity: str) -> DataFrame:
    return items.select(F.lit(severity).alias("severity"), F.lit("UNTRACKED_MARKER").alias("code"), F.concat("tag", F.lit(": "), "description").alias("message"), F.col("file").alias("path"), "line", "column")


def enforcement(level: str) -> str:
    found = level.strip().lower()
    if found not in ("off", "warn", "error"):
        raise ValueError(f"no enforcement level: {level}")
    return found


def malformed(lines: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(file, line, text): comment lines with a tag that the marker pattern doesn't match."""
    tag = "|".join(map(re.escape, tags))
    return lines.where(may_be_comment("text", "ext") & F.col("text").rlike(rf"\b({tag})\b") & ~F.col("text").rlike(rf"({tag})(\(#\d+\))?:\s*.+")).select("file", "line", "text")


def with_context(items: DataFrame, lines: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """items with the array context of the lines around them."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(-before, after)
    around = lines.withColumn("context", F.collect_list("text").over(w)).select("file", "line", "context")
    return items.join(around, ["file", "line"], "left")


def validate_issues(items: DataFrame, known: DataFrame) -> DataFrame:
    """items with issue_state and issue_title of a table of known issues (number, state, title)."""
    k = known.select(F.col("number").alias("_n"), F.col("state").alias("issue_state"), F.col("title").alias("issue_title"))
    return items.join(k, F.col("issue.number") == F.col("_n"), "left").drop("_n")
