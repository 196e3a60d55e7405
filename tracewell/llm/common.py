"""Column expressions and small helpers that several operators of the subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import note, shared_dir, stage

#: a word is a run of anything but the six ASCII white space characters
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: the number of a row in the table that numbered() writes; a name that no table of documents has
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW, written once with all columns: a second read of ``docs`` may be split otherwise and number its rows anew."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def fold(doc_id: str, modulus: int) -> Column:
    """The stable fold of a document: crc32 of its id as text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def give_back() -> None:
    """Return freed memory to the system: after large arrays the allocators would keep it while the process lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold about ``chars`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                pa.default_memory_pool().release_unused()  # a worker lives on beside others
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
            pa.default_memory_pool().release_unused()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


#: monotonically_increasing_id keeps the number of the partition in the bits from this one on
_PART = 33


def kept_in_place(rows: DataFrame, chosen: DataFrame, column: str = ROW) -> DataFrame:
    """The rows of ``rows`` whose ``column`` (numbers as numbered() gives them, read back from a table) is in ``chosen``; none moves."""
    return rows.mapInArrow(keeper(chosen, column), rows.schema)


def keeper(chosen: DataFrame, column: str = ROW) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The filter of kept_in_place() for use inside a task: batches to batches.

    The chosen numbers are sorted into files in the shared folder, one run per partition in which they were given. A task reads
    the runs of the partitions that its rows come from, and nothing else is sent: the manifest has a line per partition.
    """
    spark = chosen.sparkSession
    folder = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex[:12]}"
    where, path = open_folder(folder)
    where.create_dir(path, recursive=True)
    note(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
        if not len(numbers):
            return
        numbers.sort()
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"  # only files that the manifest names are read
        where, path = open_folder(folder)
        with where.open_output_stream(f"{path}/{name}") as out:
            out.write(numbers.astype("<i8"))
        part, first, n = np.unique(numbers >> _PART, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([name] * len(part)), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int64))], ["part", "file", "first", "n"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.select(F.col(column).cast("long").alias("x")).repartition(tasks, F.shiftright("x", _PART)).mapInArrow(write, "part long, file string, first long, n long")
    manifest = spark.sparkContext.broadcast({r["part"]: (r["file"], r["first"], r["n"]) for r in dealt.collect()})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = open_folder(folder)
        last, held = None, np.empty(0, np.int64)
        for batch in batches:
            x = batch.column(column).to_numpy()
            good = np.zeros(len(x), bool)
            for part in np.unique(x >> _PART).tolist():
                if part != last:
                    file, first, n = manifest.value.get(part, (None, 0, 0))
                    last, held = part, np.empty(0, np.int64)
                    if n:
                        with where.open_input_file(f"{path}/{file}") as f:
                            f.seek(8 * first)
                            held = np.frombuffer(f.read(8 * n), "<i8")
                if len(held):
                    at = np.searchsorted(held, x).clip(max=len(held) - 1)
                    good |= held[at] == x
            yield batch if good.all() else batch.filter(pa.array(good))

    return keep
