"""The library's calls: analyze and dedup for tables of sheets, for trees, and for single texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.tree import Node
from ..operators import consolidate as _consolidate
from ..operators import detect as _detect
from ..operators import report as _report
from ..operators.rewrite import Result, consolidate, consolidate_text
from ..sources.sheets import from_texts
from .options import Options

__all__ = ["Options", "analyze", "analyze_css", "analyze_nodes", "dedup", "dedup_css", "dedup_stage", "dedup_tree", "report"]


def analyze(sheets: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of every sheet (sheet_id, css)."""
    return _detect.analyze(sheets, options)


def analyze_nodes(nodes: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of sheets that are parsed already, with keys of the same mode."""
    return _detect.findings(nodes, options)


def dedup(sheets: DataFrame, options: Options = Options()) -> DataFrame:
    """Consolidated sheets: css_out, applied, skipped, bytes, withheld, source_map_stale, error."""
    return _consolidate.dedup(sheets, options)


def report(sheets: DataFrame, options: Options = Options()) -> DataFrame:
    return _report.report(sheets, options)


def analyze_css(spark: SparkSession, css: str, options: Options = Options()) -> list[dict]:
    rows = analyze(from_texts(spark, [css]), options).orderBy("finding_seq").collect()
    return [r.asDict(recursive=True) for r in rows]


def dedup_css(css: str, options: Options = Options()) -> Result:
    """One text, without Spark."""
    return consolidate_text(css, options)


def dedup_tree(root: Node, options: Options = Options()) -> Result:
    return consolidate(root, options)


def dedup_stage(options: Options = Options(), fix: bool = False) -> Callable[[DataFrame], DataFrame]:
    """For ``sheets.transform(dedup_stage())``: adds warnings, an array of messages per sheet; with
    fix, css is rewritten too. Like a build plugin, it says nothing about source maps."""
    from pyspark.sql import functions as F

    def stage(sheets: DataFrame) -> DataFrame:
        if not fix:
            told = _report.warnings(analyze(sheets, options)).withColumnRenamed("finding_seq", "n")
        else:
            results = dedup(sheets, options)
            told = _report.result_warnings(results)
        texts = told.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("n", "message")))["message"].alias("warnings"))
        out = sheets
        if fix:
            out = sheets.join(results.select("sheet_id", "css_out"), "sheet_id", "left").withColumn("css", F.coalesce("css_out", "css")).select(sheets.columns)
        return out.join(texts, "sheet_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))

    return stage


def both_modes(options: Options) -> tuple[Options, Options]:
    return replace(options, aggressive=False), replace(options, aggressive=True)
