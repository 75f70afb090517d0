"""New files to converted books as they arrive: the batch plan, run on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans import convert as C
from ..sources import books as R

_FILES = "path string, modificationTime timestamp, length long, content binary"


def convert_stream(spark: SparkSession, source: str, target: str, fmt: str, checkpoint: str, options: Options | None = None, stages: list[tuple[str, C.Stage]] | None = None, files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Converts files that appear in ``source`` into rows of a Parquet table at ``target``
    (book_id, stem, data, error, in a folder for each batch, so that a batch that is run again
    after a failure replaces what it wrote). A batch is parsed once, into ``checkpoint``."""

    def batch(rows: DataFrame, number: int) -> None:
        files = rows.select(F.xxhash64("path").alias("book_id"), "path", F.col("content").alias("data"))
        parsed = f"{checkpoint}/parsed/batch={number}"
        R.read_books(files).write.mode("overwrite").parquet(parsed)
        raw = rows.sparkSession.read.parquet(parsed)
        C.convert(R.tables(raw), fmt, options, stages).write.mode("overwrite").parquet(f"{target}/batch={number}")

    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(source)
    out = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream")
    return (out.trigger(availableNow=True) if once else out).start()
