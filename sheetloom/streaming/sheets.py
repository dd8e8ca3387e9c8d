"""Style sheets as a stream of files: each micro-batch runs the batch plan.

Sheets do not depend on each other, so there is no state and no watermark; a file that changes and
appears again is a new row. Results go to the sink under the batch's number, so a batch that is
replayed after a failure overwrites what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.consolidate import dedup
from ..plans.options import Options


def sheet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder, whole, as (path, css)."""
    return spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.[cC][sS][sS]").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("css"))


def consolidate_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options(), once: bool = True) -> StreamingQuery:
    """Consolidate every sheet that arrives in folder and write results to out/batch=N."""

    def batch(df: DataFrame, number: int) -> None:
        keyed = df.withColumn("sheet_id", F.xxhash64("path"))
        found = dedup(keyed, options).join(keyed.select("sheet_id", "path"), "sheet_id")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = sheet_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
