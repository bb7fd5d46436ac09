"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # only the GNU library has it
    _TRIM = None


def n_parts(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    One of our own is made only where the session names none and driver and executors are one process, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return str(context.getCheckpointDir()).rstrip("/")


FILE_BYTES = 32 << 20


def n_files(like: DataFrame) -> int:
    """Files for what comes of ``like``: one for 32 MB that its scan reads, one a core at least.

    A new file costs an executor a helper process on some stores, and many small
    ones are slow to read again.  For plans without joins or sorts only: a task
    that runs many partitions one after another keeps the memory of every sort.  A table of unknown size counts as huge, which
    leaves the partitions as they are.
    """
    size = plan_bytes(like)
    return max(like.sparkSession.sparkContext.defaultParallelism, 1_000_000 if size is None else -(-size // FILE_BYTES))


PART_BYTES, BLOCK_BYTES = 10 << 20, 5 << 20


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that the plan scans, whichever columns it takes; None where one of them is of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(x >= 1 << 60 for x in sizes) else sum(sizes)


def layout(docs: DataFrame) -> tuple[int, int]:
    """Numbers of document blocks and of parts of a key space, by the bytes of the input.

    A block is one unit of a worker's memory and a part another; both grow in
    number with the table, not in size, and do not follow the session's shuffle
    partitions, or blocks and parts would exchange ever smaller messages.  There are
    two blocks and one part for each core at least; a table of unknown size has as many
    as the shuffle partitions ask for.
    """
    spark, size = docs.sparkSession, plan_bytes(docs)
    least = spark.sparkContext.defaultParallelism if size is not None else max(spark.sparkContext.defaultParallelism, n_parts(spark))
    return max(2 * least, -(-(size or 0) // BLOCK_BYTES)), max(least, -(-(size or 0) // PART_BYTES))


def block_of(id_col: Column, text: Column, blocks: int) -> Column:
    """Block of a row by its id; rows without an id are dealt by their text."""
    return F.pmod(F.when(id_col.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(id_col)), F.lit(blocks))


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each, those from 255 as eight more at the end, deflated."""
    big = counts >= 255
    return zlib.compress(np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<u8").tobytes(), 1)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    """The ``n`` counts that ``pack_counts`` packed."""
    raw = zlib.decompress(data)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def checkpointed(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage through the shared folder, in at most ``files`` files if given."""
    shared_folder(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint()


def aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns of these names, which an operator will add, moved aside to ``<name>_input``."""
    taken = {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_input"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow(schema: str) -> pa.Schema:
    """Arrow schema of a short DDL string such as ``"doc_id long, score double"``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(","))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i]+lengths[i]-1`` of every i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - shift, lengths)


def deal(keys: np.ndarray, n: int, records: np.ndarray, salt: int = 0) -> Iterable[tuple[int, bytes]]:
    """Split packed records into ``n`` parts by the high bits of a 64-bit key."""
    part = part_of(keys, n)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n + 1))
    records = records[order]
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), records[bounds[p] : bounds[p + 1]].tobytes()


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def unpack(batches: Iterable[pa.RecordBatch], column: str, dtype: np.dtype) -> np.ndarray:
    """All packed records of a partition."""
    got = [x for b in batches for x in b.column(column).to_pylist() if x]
    return np.frombuffer(b"".join(got), dtype) if got else np.zeros(0, dtype)


def trim() -> None:
    """Give freed memory back to the machine.

    A worker serves many tasks; what the last block left free in the allocators
    would else stay with it beside the next one's arrays.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_arrow(df: DataFrame, fn, ddl: str) -> DataFrame:  # noqa: ANN001
    """``mapInArrow`` with this package at hand on the executors, freed memory returned around each task."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        trim()
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, ddl)
