"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that a Python kernel holds as tokens at one time.
CHUNK_CHARS = 1 << 20

#: Bytes of a batch that goes between the JVM and Python. Both sides hold a few of them, and
#: texts can be long.
BATCH_BYTES = "4m"

_own_root: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session by bytes; rows alone do not bound texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_root(spark: SparkSession) -> str:
    """The folder of this application that all executors share: below ``spark.checkpoint.dir``, or
    in a session without that setting on one machine a temporary folder. A cluster has to name
    one: executors would each write to their own discs. ``clean`` removes it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/quire-{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _own_root[0][7:], ignore_errors=True)
    return _own_root[0]


def clean(spark: SparkSession) -> None:
    """Remove what this application wrote between steps. Tables that were returned before read it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the plan is cut
    there and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to ``most``, or one larger row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    schema: str,
    make: Callable[[], Callable[[list], list]],
) -> DataFrame:
    """``keep`` columns of ``df`` and, from each text, the columns of ``schema``.

    ``make()`` runs once in a task and gives a function from a list of texts (None for
    null) to a list of tuples. No shuffle; texts go through in chunks of bounded size.
    """
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    src = df.select(*keep, text)
    added = StructType.fromDDL(schema)
    out = StructType([src.schema[c] for c in keep] + added.fields)
    names = added.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fn = fn or make()
            column = batch.column(len(keep))
            sizes = [x or 0 for x in pa.compute.binary_length(column).to_pylist()]
            for a, b in chunks(sizes):
                rows = fn(column.slice(a, b - a).to_pylist())
                cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                for k, name in enumerate(names):
                    cols.append(pa.array([r[k] for r in rows], arrow.field(len(keep) + k).type))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    return src.mapInArrow(run, out)
