"""Reports as aggregates: four ways to run, savings per sheet and in total, warnings.

The four columns are default and aggressive, each with and without the gate that withholds larger
results. Only two runs are made; the gated ones follow from them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import key_of
from ..plans.options import Options
from .consolidate import dedup, previews
from .detect import analyze

MODES = ("default", "default_gated", "aggressive", "aggressive_gated")


def gated(saved: Column, applied: Column) -> tuple[Column, Column]:
    """What the gate makes of a run's saved bytes and number of applied changes."""
    held = saved < 0
    return F.when(held, 0).otherwise(saved), F.when(held, 0).otherwise(applied)


def savings_matrix(runs: DataFrame) -> DataFrame:
    """runs (sheet_id, mode default or aggressive, before, saved, n_applied) to one row per sheet
    and way: sheet_id, way, before, saved, n_applied, unavailable."""
    saved, applied = gated(F.col("saved"), F.col("n_applied"))
    plain = runs.select("sheet_id", F.col("mode").alias("way"), "before", "saved", "n_applied")
    held = runs.select("sheet_id", F.concat("mode", F.lit("_gated")).alias("way"), "before", saved.alias("saved"), applied.alias("n_applied"))
    return plain.unionByName(held).withColumn("unavailable", F.col("n_applied") == 0)


def with_totals(matrix: DataFrame) -> DataFrame:
    """The matrix and, for each way, a row with sheet_id null: a rollup of one level."""
    total = matrix.rollup("way", "sheet_id").agg(F.sum("before").alias("before"), F.sum("saved").alias("saved"), F.bool_and("unavailable").alias("unavailable"), F.grouping("way").alias("g"))
    return total.where("g = 0").drop("g")


def best_ways(matrix: DataFrame) -> DataFrame:
    """For each sheet the ways that save most, of those that do anything; none if the best grows."""
    able = F.filter(F.array_sort(F.collect_list(F.struct("way", "saved", "unavailable"))), lambda w: ~w["unavailable"])
    g = matrix.groupBy("sheet_id").agg(able.alias("able"))
    best = F.array_max(F.transform("able", lambda w: w["saved"]))
    return g.withColumn("best", best).select("sheet_id", F.when(F.col("best") >= 0, F.transform(F.filter("able", lambda w: w["saved"] == F.col("best")), lambda w: w["way"])).otherwise(F.array().cast("array<string>")).alias("best_ways"))


def outcome_totals(results: DataFrame) -> DataFrame:
    """One row over all sheets (before, saved, n_applied, n_skipped, withheld_growth null or not):
    how many shrink and grow, and by how much."""
    shrinks, grows = F.col("saved") > 0, F.col("saved") < 0
    return results.agg(
        F.sum("before").alias("before"), F.count_if(shrinks).alias("n_shrink"), F.coalesce(F.sum(F.when(shrinks, F.col("saved"))), F.lit(0)).alias("shrunk"),
        F.count_if(grows).alias("n_grow"), F.coalesce(F.sum(F.when(grows, -F.col("saved"))), F.lit(0)).alias("grown"),
        F.sum("n_applied").alias("n_applied"), F.sum("n_skipped").alias("n_skipped"), F.count("withheld_growth").alias("n_withheld"), F.coalesce(F.sum("withheld_growth"), F.lit(0)).alias("withheld_growth"),
    )


def may_merge(skipped: DataFrame, aggressive_skipped: DataFrame) -> DataFrame:
    """skipped (sheet_id, scope, key, ...) with may_merge: the aggressive run does not skip it,
    under this spelling of the key or its own."""
    base = F.regexp_replace("key", " !important$", "")
    at = F.instr(base, ": ")
    respelt = F.when(at > 0, key_of(F.substring(base, F.lit(1), at - 1), F.substring(base, at + 2, F.length(base)), F.col("key").endswith(" !important"), aggressive=True)).otherwise(F.col("key"))
    other = aggressive_skipped.select("sheet_id", "scope", F.col("key").alias("other")).distinct()
    hits = skipped.withColumn("respelt", respelt)
    match = (hits["sheet_id"] == other["sheet_id"]) & (hits["scope"] == other["scope"]) & ((F.col("other") == F.col("key")) | (F.col("other") == F.col("respelt")))
    still = hits.join(other, match, "left_semi").select("sheet_id", "scope", "key").distinct().withColumn("still", F.lit(True))
    return skipped.join(still, ["sheet_id", "scope", "key"], "left").withColumn("may_merge", F.col("still").isNull()).drop("still")


def preview(sheets: DataFrame, options: Options = Options()) -> DataFrame:
    """What the aggressive run adds to the default one: sheet_id, extra, extra_saved, differs."""
    return previews(sheets, options)


def report(sheets: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per sheet: findings by mode and (before, saved, unavailable) of the four ways. Sheets
    without findings are not consolidated."""
    both = {"default": replace(options, aggressive=False, savings_only=False), "aggressive": replace(options, aggressive=True, savings_only=False)}
    counts, runs = None, None
    for mode, o in both.items():
        n = analyze(sheets, o).groupBy("sheet_id").agg(F.count(F.lit(1)).alias(f"n_{mode}"))
        counts = n if counts is None else counts.join(n, "sheet_id", "full_outer")
    dirty = sheets.join(counts.select("sheet_id"), "sheet_id", "left_semi")
    for mode, o in both.items():
        r = dedup(dirty, o, with_css=False).where("error IS NULL").select("sheet_id", F.lit(mode).alias("mode"), "bytes.before", "bytes.saved", F.size("applied").alias("n_applied"))
        runs = r if runs is None else runs.unionByName(r)
    wide = savings_matrix(runs).groupBy("sheet_id").pivot("way", list(MODES)).agg(F.first(F.struct("before", "saved", "unavailable")))
    size = F.octet_length("css").cast("long")
    clean = F.struct(size.alias("before"), F.lit(0).cast("long").alias("saved"), F.lit(True).alias("unavailable"))
    whole = sheets.select("sheet_id", "css").join(counts, "sheet_id", "left").join(wide, "sheet_id", "left")
    return whole.select("sheet_id", *(F.coalesce(F.col(f"n_{m}"), F.lit(0)).alias(f"n_{m}") for m in both), *(F.coalesce(F.col(m), clean).alias(m) for m in MODES))


def warnings(findings_: DataFrame) -> DataFrame:
    """A message per finding, for use inside a pipeline: sheet_id, finding_seq, message."""
    mark = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    last = F.element_at("occurrences", -1)
    rest = F.array_join(F.transform(F.slice("occurrences", F.lit(1), F.greatest(F.size("occurrences") - 1, F.lit(0))), lambda o: mark(o["selector"])), ", ")
    text = (
        F.when(F.col("kind") == "repeated", F.concat(F.lit("Selector "), mark(F.col("key")), F.lit(" written "), F.size("occurrences").cast("string"), F.lit(" times in its scope ("), F.col("scope"), F.lit(")")))
        .when(F.col("kind") == "redundant", F.concat(F.lit("Redundant declaration "), mark(F.col("key")), F.lit(" repeated in "), mark(last["selector"])))
        .otherwise(F.concat(F.lit("Duplicate declaration "), mark(F.col("key")), F.lit(" also in "), rest))
    )
    return findings_.select("sheet_id", "finding_seq", text.alias("message"))


def result_warnings(results: DataFrame) -> DataFrame:
    """Messages of a rewriting run: what was withheld, and what was left unmerged."""
    held = results.where("withheld IS NOT NULL").select("sheet_id", F.lit(-1).alias("n"), F.format_string("Consolidation withheld: %d merge%s would make the style sheet %d bytes bigger", "withheld.count", F.when(F.col("withheld.count") == 1, "").otherwise("s"), F.abs("withheld.saved")).alias("message"))
    left = results.select("sheet_id", F.posexplode("skipped").alias("n", "s")).select("sheet_id", "n", F.format_string("Duplicate `%s` left unmerged (%s): %s", "s.key", "s.scope", "s.reason").alias("message"))
    return held.unionByName(left)
