"""Queries of the language-model data problems over a data directory, with equivalent SQL."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import current_rows
from ..runtime import materialize, read
from .leakage import leaks
from .mixture import mixture, token_counts
from .pii import found_in, redact, restored
from .quantiles import digests, merge, percentiles, true_ranks
from .topn import band_edges, top_n

PROBS = [0.5, 0.9, 0.99]
_MEASURES = {"cognitive_complexity": "metrics.cognitive_complexity", "lines_of_code": "metrics.lines_of_code"}


def p4_found(spark: SparkSession, where: str) -> DataFrame:
    rows = read(spark, where, "code_functions").where("id IS NOT NULL").select("repo", "snapshot_no", "id", "seq", "module", F.col("metrics.cyclomatic_complexity").alias("score"))
    now = current_rows(rows, ["repo", "snapshot_no", "id"], "seq", ["module", "score"])
    # the bands are sketched from all deliveries, which spares computing the current rows twice
    return top_n(now, ["snapshot_no", "module"], "score", ["id", "repo"], 5, edges=band_edges(rows, "score")).select("snapshot_no", "module", "repo", "id")


def p6_percentiles(spark: SparkSession, where: str) -> DataFrame:
    """Of each language and snapshot, of each language and repository, and merged from the former, of each language.

    The repositories are there because their digests are the parts that p6_from_repos combines to
    those of the languages. The column that does not apply is null.
    """
    rows = read(spark, where, "code_functions")
    by_snapshot = materialize(digests(rows, ["language", "snapshot_no"], _MEASURES), "digests")
    by_repo = digests(rows, ["language", "repo"], _MEASURES)
    each = percentiles(by_snapshot, ["language", "snapshot_no"], PROBS).withColumn("level", F.lit("snapshot"))
    repos = percentiles(by_repo, ["language", "repo"], PROBS).withColumn("level", F.lit("repo"))
    whole = percentiles(merge(by_snapshot, ["language"]), ["language"], PROBS).withColumn("level", F.lit("language"))
    return each.unionByName(repos, allowMissingColumns=True).unionByName(whole, allowMissingColumns=True)


def p6_from_repos(spark: SparkSession, where: str) -> DataFrame:
    """Of each language, merged from the digests of single repositories."""
    rows = read(spark, where, "code_functions")
    return percentiles(merge(digests(rows, ["language", "repo"], _MEASURES), ["language"]), ["language"], PROBS)


def p6_bounds(spark: SparkSession, where: str) -> DataFrame:
    """Whether the true rank of each value that p6_percentiles reports for a language, or a language and snapshot, lies within its bound."""
    rows = read(spark, where, "code_functions")
    by_snapshot = materialize(digests(rows, ["language", "snapshot_no"], _MEASURES), "digests")
    each = true_ranks(rows, percentiles(by_snapshot, ["language", "snapshot_no"], PROBS), ["language", "snapshot_no"], _MEASURES).withColumn("level", F.lit("snapshot"))
    whole = true_ranks(rows, percentiles(merge(by_snapshot, ["language"]), ["language"], PROBS), ["language"], _MEASURES).withColumn("level", F.lit("language"))
    return each.unionByName(whole, allowMissingColumns=True).select("level", "language", "snapshot_no", "measure", "p", "n", "within")


def p7_found(spark: SparkSession, where: str) -> DataFrame:
    return leaks(read(spark, where, "documents"), read(spark, where, "eval_items")).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, where: str) -> DataFrame:
    """The leaks whose tiles cover at least half of the item."""
    return leaks(read(spark, where, "documents"), read(spark, where, "eval_items")).where("coverage >= 0.5")


def p8_mixture(spark: SparkSession, where: str) -> DataFrame:
    return mixture(read(spark, where, "documents"), read(spark, where, "mix_targets"))[0]


def p8_shares(spark: SparkSession, where: str) -> DataFrame:
    return mixture(read(spark, where, "documents"), read(spark, where, "mix_targets"))[1]


def p8_checks(spark: SparkSession, where: str) -> DataFrame:
    """Per target: usable documents, and whether the mixture keeps the cap on repeats, uses known documents once each, and reaches the share to the size of a document."""
    documents, targets = read(spark, where, "documents"), read(spark, where, "mix_targets")
    sized = materialize(token_counts(documents), "sized")
    chosen, shares = mixture(documents, targets, sized=sized)
    longest = sized.groupBy("source").agg(F.max("tokens").alias("longest"))
    used = chosen.groupBy("source").agg(F.max("uses").alias("most"), F.count(F.lit(1)).alias("picked"), F.count_distinct("doc_id").alias("different"))
    usable = documents.where("text <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("usable"))
    # targets are few rows; those of sources without tokens are shared out among the others
    live = shares.agg(F.sum(F.when((F.col("available_tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))).alias("live"), F.sum("mixed_tokens").alias("mixed"))
    j = shares.join(used, "source", "left").join(usable, "source", "left").join(longest, "source", "left").withColumn("_one", F.lit(1)).join(live.withColumn("_one", F.lit(1)), "_one")
    wanted = F.when((F.col("available_tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share") / F.col("live")).otherwise(0.0)
    return j.select(
        "source", "target_share", "max_repeats", F.coalesce("usable", F.lit(0)).alias("usable_documents"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"),
        (F.coalesce("picked", F.lit(0)) == F.coalesce("different", F.lit(0))).alias("each_once"), (F.abs(F.col("actual_share") - wanted) <= (1 + F.coalesce("longest", F.lit(0))) / F.greatest("mixed", F.lit(1))).alias("share_reached"))


def p9_restored(spark: SparkSession, where: str) -> DataFrame:
    """The texts with what was found put back at its place."""
    return restored(p9_redacted(spark, where))


def p9_redacted(spark: SparkSession, where: str) -> DataFrame:
    return redact(read(spark, where, "documents"), read(spark, where, "name_list"))


def p9_found(spark: SparkSession, where: str) -> DataFrame:
    return found_in(p9_redacted(spark, where))


QUERIES = {
    "p4_found": p4_found,
    "p6_percentiles": p6_percentiles,
    "p6_from_repos": p6_from_repos,
    "p6_bounds": p6_bounds,
    "p7_found": p7_found,
    "p7_coverage": p7_coverage,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
    "p9_restored": p9_restored,
}


def _words_sql(table: str, key: str) -> str:
    """The words of a text column in SQL: characters are replaced by their compatibility form, which a rule gives, and composed."""
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if form != c and not 0xD800 <= code < 0xE000:
            (single if len(form) == 1 else several)[c] = form.replace("'", "''")
    single = {c: f for c, f in single.items() if f != "'"}
    plain = f"translate(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173), ''), '{''.join(single)}', '{''.join(single.values())}')"
    forms = "MAP([" + ", ".join(f"'{c}'" for c in several) + "], [" + ", ".join(f"'{f}'" for f in several.values()) + "])"
    spelled = f"CASE WHEN regexp_matches(t, '[{''.join(several)}]') THEN array_to_string(list_transform(string_split(t, ''), lambda c: coalesce({forms}[c], c)), '') ELSE t END"
    return f"SELECT {key}, regexp_extract_all(lower(nfc_normalize({spelled})), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT {key}, {plain} AS t FROM {table} WHERE text IS NOT NULL)"


_MEASURE_SQL = " UNION ALL ".join(f"SELECT language, snapshot_no, '{m}' AS measure, {c} AS v FROM code_functions" for m, c in _MEASURES.items())

SQL = {
    "p6_bounds": f"""WITH v AS ({_MEASURE_SQL}), g AS (SELECT 'snapshot' AS level, language, snapshot_no, measure, count(v) AS n FROM v GROUP BY ALL UNION ALL SELECT 'language', language, NULL, measure, count(v) FROM v GROUP BY language, measure)
SELECT level, language, snapshot_no, measure, p, n, true AS "within" FROM g, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) q(p) WHERE n > 0""",
    "p7_found": f"""WITH d AS ({_words_sql("documents", "doc_id")}), i AS ({_words_sql("eval_items", "item_id")}),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_checks": """SELECT t.source, target_share, greatest(coalesce(max_repeats, 0), 0) AS max_repeats, count(d.doc_id) AS usable_documents, true AS within_cap, true AS each_once, true AS share_reached
FROM mix_targets t LEFT JOIN (SELECT * FROM documents WHERE text <> '') d ON d.source = t.source WHERE t.source IS NOT NULL GROUP BY t.source, target_share, max_repeats""",
    "p9_restored": "SELECT doc_id, text FROM documents",
    "p4_found": """
WITH c AS (SELECT repo, snapshot_no, id, unnest(arg_max(struct_pack(module := module, score := metrics.cyclomatic_complexity), seq)) FROM code_functions WHERE id IS NOT NULL GROUP BY repo, snapshot_no, id)
SELECT snapshot_no, module, repo, id FROM c WHERE module IS NOT NULL AND score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY snapshot_no, module ORDER BY score DESC, id, repo) <= 5""",
}
