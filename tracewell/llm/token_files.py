"""Token ids as flat binary files: unsigned integers end to end, with 64-bit document offsets beside them.

Documents are range-partitioned by doc_id and sorted, so file after file holds them in ascending order. A partition writes
three files into a shared folder: ``.bin`` (ids; 16 bits where the vocabulary fits, else 32), ``.idx`` (n + 1 offsets into
the file, unsigned 64 bits) and ``.ids`` (doc_ids, signed 64 bits), little-endian. Names carry the task attempt, and only
files listed in the manifest count: a lost executor's half-written files are never read. What a document's ids start at in
the whole corpus is the partition's base, a prefix sum over the manifest, plus its offset. Reading maps the files to memory
where the folder is a local or mounted one.

Defined results: a null text is the empty text (only the end id); rows that repeat a doc_id are documents of their own, side
by side; a null doc_id is sorted first and stored as the smallest 64-bit integer. Texts of any length are encoded whole,
and a slice of work holds one text at least. An empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm import bpe
from tracewell.llm.common import sliced
from tracewell.session import shared_dir, stage

NULL_ID = -(1 << 63)
SLICE_CHARS = 6_000_000
READ_TOKENS = 4_000_000


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents end to end, each closed with ``end_id``; and their numbers."""
    closed = counts + 1
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    mask = np.ones(len(out), bool)
    mask[np.cumsum(closed) - 1] = False
    out[mask] = ids
    return out, closed


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text) below ``folder``; returns the manifest, one row per file."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where, path = _open(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), bpe.encoder(vocabulary)
        width = 2 if max(encoder.size - 1, end_id) < 1 << 16 else 4
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        where, path = _open(folder)
        outs, n_docs, n_tokens = [], 0, 0
        for batch in sliced(batches, "text", SLICE_CHARS):
            if not batch.num_rows:
                continue
            if not outs:
                outs = [where.open_output_stream(f"{path}/{name}.{kind}") for kind in ("bin", "idx", "ids")]
                outs[1].write(np.zeros(1, "<u8").tobytes())
            ids, counts = with_end(*encoder.encode(batch.column("text")), end_id)
            outs[0].write(ids.astype(f"<u{width}"))
            outs[1].write((n_tokens + np.cumsum(counts)).astype("<u8"))
            outs[2].write(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8"))
            n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + len(ids)
        for out in outs:
            out.close()
        if outs:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [f"{folder}/{name}"], "width": [width], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    files = stage(ordered.mapInArrow(run, "part long, file string, width long, n_docs long, n_tokens long"), "token-files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, batch_tokens: int = READ_TOKENS) -> DataFrame:
    """Documents from the files: doc_id, start in the corpus, n_tokens, and the crc32 of the ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            where, path = _open(row["file"])
            mapped = isinstance(where, fs.LocalFileSystem)
            bin_, idx, own = ((pa.memory_map if mapped else where.open_input_file)(f"{path}.{kind}") for kind in ("bin", "idx", "ids"))
            offsets = np.frombuffer(idx.read_buffer(), "<u8").astype(np.int64)
            names = np.frombuffer(own.read_buffer(), "<i8")
            at = 0
            while at < len(names):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + batch_tokens, "right")) - 1)
                bin_.seek(int(offsets[at]) * row["width"])
                ids = np.frombuffer(bin_.read_buffer(int(offsets[to] - offsets[at]) * row["width"]), f"<u{row['width']}").astype("<u4")
                cuts = offsets[at:to + 1] - offsets[at]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                who = pa.array(names[at:to], pa.int64(), mask=names[at:to] == NULL_ID)
                yield pa.RecordBatch.from_arrays([who, pa.array(row["base"] + offsets[at:to]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                at = to

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
