"""Where sheets come from, and where rewritten ones go.

A sheets table is (sheet_id, path, css, error). Files are read by Spark as binary, so that a file
that is not UTF-8 is an error of its own row. Ids number paths in order, in a window over paths
alone.
"""

from __future__ import annotations

import os
import re
import shutil
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STDIN = "-"
# Folders that are not searched, and sources of preprocessors.
SKIPPED_FOLDERS = {"node_modules"}
PREPROCESSORS = (".scss", ".sass", ".less", ".styl")
SHEETS = "sheet_id long, path string, css string, error string"


def portable(path: str, root: str | None = None) -> str:
    """The path from the working folder, with forward slashes."""
    return os.path.relpath(path, root or os.getcwd()).replace(os.sep, "/")


@dataclass
class Targets:
    files: list[str]
    discovered: int
    unsupported: list[str]


def css_files(folder: str) -> list[str]:
    """Style sheets under a folder, in order; no dot entries, no package folders."""
    found = []
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if entry.name.startswith(".") or entry.name in SKIPPED_FOLDERS:
            continue
        if entry.is_dir():
            found += css_files(entry.path)
        elif entry.name.lower().endswith(".css"):
            found.append(entry.path)
    return sorted(found)


def expand_targets(targets: list[str], ignored: tuple[str, ...] = ()) -> Targets:
    """Named files and searched folders, each path once, without ignored ones. Preprocessor
    sources that are named are declined."""
    found: dict[str, bool] = {}
    for target in targets:
        if target == STDIN:
            found[STDIN] = True
            continue
        path = os.path.abspath(target)
        if os.path.isdir(path):
            found.update(dict.fromkeys(css_files(path), True))
        else:
            os.stat(path)
            found.setdefault(path, not path.lower().endswith(PREPROCESSORS))
    kept = [p for p in found if p == STDIN or not any(re.search(i, portable(p)) for i in ignored)]
    return Targets([p for p in kept if found[p]], sum(found.values()), [p for p in kept if not found[p]])


def path_ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """The same exclusion for a path column."""
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        css, errors = [], []
        for content in batch.column("content").to_pylist():
            try:
                css.append(content.decode("utf-8"))
                errors.append(None)
            except UnicodeDecodeError as e:
                css.append(None)
                errors.append(str(e))
        yield pa.record_batch([batch.column("path"), pa.array(css, pa.string()), pa.array(errors, pa.string())], names=["path", "css", "error"])


def numbered(sheets: DataFrame) -> DataFrame:
    """sheet_id by the order of paths. Only paths are sorted; ids are joined back."""
    from pyspark.sql import Window

    parts = sheets.select("path").distinct().repartitionByRange("path").withColumn("part", F.spark_partition_id()).cache()
    base = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1
    ids = parts.withColumn("own", own).join(F.broadcast(base.select("part", "base")), "part").select("path", (F.col("base") + F.col("own")).cast("long").alias("sheet_id"))
    return sheets.join(ids, "path").select("sheet_id", "path", "css", "error")


def read_folder(spark: SparkSession, folder: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """All style sheets under a folder of any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][sS]").load(folder)
    skipped = f"/(?:{'|'.join(map(re.escape, SKIPPED_FOLDERS))}|\\.[^/]*)/"
    kept = files.where(~F.col("path").rlike(skipped) & ~path_ignored(F.col("path"), ignored))
    return numbered(kept.select("path", "content").mapInArrow(_decode, "path string, css string, error string"))


def read_files(spark: SparkSession, paths: list[str], stdin: str | None = None) -> DataFrame:
    """Named files in the given order, read by tasks (on a cluster the paths must be shared); STDIN
    is read here. What cannot be read is an error of its row."""
    given = (sys.stdin.read() if stdin is None else stdin) if STDIN in paths else None
    rows = [(k, p, given if p == STDIN else None, None) for k, p in enumerate(paths)]
    named = spark.createDataFrame(rows, SHEETS).repartitionByRange(max(1, min(len(paths), spark.sparkContext.defaultParallelism)), "sheet_id")
    folder = os.getcwd()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != STDIN:
                    try:
                        with open(os.path.join(folder, row["path"]), encoding="utf-8", newline="") as f:
                            row["css"] = f.read()
                    except (OSError, UnicodeDecodeError) as e:
                        row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return named.mapInArrow(read, SHEETS)


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(k, f"text-{k}", t, None) for k, t in enumerate(texts)], SHEETS)


_STYLE = r"(?is)<style\b[^>]*>(.*?)</style\s*>"


def style_tags(pages: DataFrame, page_id: str = "page_id", content: str = "html") -> DataFrame:
    """One sheet per style element of pages: page_id, tag_no, css. Only built-in functions."""
    tags = F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(_STYLE), F.lit(1))
    return pages.select(F.col(page_id).alias("page_id"), F.posexplode(tags).alias("tag_no", "css"))


def write_sheets(results: DataFrame, folder: str) -> None:
    """Rewritten sheets (path, css_out) as a table in a new place: inputs are never overwritten by
    tasks, which may run twice."""
    results.select("path", "css_out").write.parquet(folder)


def replace_file(path: str, text: str) -> None:
    """Replace a local file whole: whoever reads it sees the old text or the new one."""
    temporary = f"{path}.new"
    with open(temporary, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    if os.path.exists(path):
        shutil.copymode(path, temporary)
    os.replace(temporary, path)


def rewrite_in_place(results: DataFrame) -> int:
    """Overwrite local files whose consolidation applied something. Opt-in, from the driver only,
    one row at a time."""
    written = 0
    for row in results.where("size(applied) > 0").select("path", "css_out").toLocalIterator():
        replace_file(row["path"], row["css_out"])
        written += 1
    return written
