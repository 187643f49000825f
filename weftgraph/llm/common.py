"""What the training-data operators share: table access, Arrow maps and checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

#: Rows of a text column that one Arrow slice hands to a kernel; long texts make shorter slices.
SLICE_ROWS = 2048
SLICE_BYTES = 16 << 20
#: The same where words of a slice are held as Python objects beside a cache of words.
FLAG_ROWS, FLAG_BYTES = 512, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset directory, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, kernel: Callable[[dict[str, list]], dict[str, list] | None], schema: str | StructType, setup: Callable | None = None) -> DataFrame:
    """Apply `kernel` to slices of rows, given as a dict of Python lists, and return a dict of lists.

    Slices are bounded in rows and bytes, so a batch of very long texts is
    never held in Python objects as a whole. `setup()` runs once a task and its
    result is passed to the kernel as a second argument.
    """
    arrow = to_arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for part in slices(batch):
                rows = {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
                out = kernel(rows, state) if setup else kernel(rows)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        state = batch = part = rows = out = None
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside the executor's heap and other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def flagged(text: Column, kernel: Callable[[list, object], list], setup: Callable) -> Column:
    """A boolean column from slices of a text column alone: what else the rows hold never leaves the JVM."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = setup()
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            found = [kernel(piece.column(0).to_pylist(), state) for piece in slices(batch, FLAG_ROWS, FLAG_BYTES)]
            yield pa.array([x for piece in found for x in piece], pa.bool_())
        state = part = batch = found = piece = None
        released()

    return F.arrow_udf(run, BooleanType())(text)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most `rows` rows and about `size` bytes."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(rows, int(n * size / max(batch.nbytes, 1))))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def to_arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert
    from pyspark.sql.types import _parse_datatype_string

    return convert(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir, a folder that driver and executors share; without one, a local[...] master alone gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weftgraph-"))


def persisted(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, and lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(column, divisor: int):
    """crc32 of an id's decimal text, modulo `divisor`."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def held_out(column, divisor: int, value: int = 0):
    """Whether an id's remainder is `value`; a null id is never learned from, and so counts as held out."""
    return F.coalesce(remainder(column, divisor) == value, F.lit(True))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
