"""Best-fit packing of token documents into sequences of fixed capacity, by linear grouping.

Documents longer than the capacity are cut, the rest stay whole. Pieces of one length are interchangeable, so everything that
decides where they go works on the histogram of lengths, at most ``capacity`` rows whatever the corpus holds:

1. large lengths are split, longest first, into groups of equal cardinality and rounded up to the longest of their group;
2. the fewest sequences for the rounded groups are sought over configurations (which groups share a sequence, how often
   each): a linear program by column generation, rounded down;
3. the places of a configuration are filled with the actual pieces of the group, longest first, which are never longer;
4. all that is left, small pieces and what rounding left over, goes longest first to the sequence it fits best.

The plan is a list of runs (length, rank from, count -> sequence from, offset); its size depends on the capacity only. A piece
finds its place by its length and its rank among the pieces of that length, and ranks are taken inside (length, bucket)
groups and shifted by the counts of the buckets before, so no length is one group.

Defined results: a null text is the empty text (only the end id). Rows that repeat a doc_id are documents of their own.
Texts of any length are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm import bpe
from tracewell.llm.common import give_back, sliced
from tracewell.llm.token_files import with_end
from tracewell.session import stage

BUCKETS = 64
SLICE_CHARS = 3_000_000
#: pieces a worker remembers, a bound on memory only
REMEMBERED = 500_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece. The first piece of a longer document takes what whole pieces leave over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # the worker may have served other stages before
        encoder = bpe.encoder(vocabulary, REMEMBERED)
        for batch in sliced(batches, "text", SLICE_CHARS):
            ids, counts = with_end(*encoder.encode(batch.column("text")), end_id)
            ids = ids.astype("<u4")
            n = -(-counts // capacity)
            first = counts - (n - 1) * capacity
            row = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(ids[a:a + z]) for a, z in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


@dataclass
class Plan:
    """Runs of pieces of one length: rank r goes to sequence seq + (r - rank) // each, at offset + (r - rank) % each * length."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank, count, seq, offset, each
    free: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # room left -> (first sequence, sequences)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def room(self, left: int, seq: int, n: int) -> None:
        if n and left:
            self.free.setdefault(left, []).append((seq, n))

    def put(self, length: int, rank: int, count: int, seq: int, n: int, left: int) -> int:
        """Fill the run of n sequences from seq, each with room ``left``; returns how many pieces it took."""
        each = left // length
        took = min(count, each * n)
        self.runs.append((length, rank, took, seq, self.capacity - left, each))
        whole, rest = divmod(took, each)
        self.room(left - each * length, seq, whole)
        if rest:
            self.room(left - rest * length, seq + whole, 1)
        self.room(left, seq + whole + bool(rest), n - whole - bool(rest))
        return took

    def best_fit(self, length: int, rank: int, count: int) -> None:
        for left in sorted(x for x in self.free if x >= length):
            open_, self.free[left] = self.free[left], []
            while open_ and count:
                seq, n = open_.pop()
                took = self.put(length, rank, count, seq, n, left)
                rank, count = rank + took, count - took
            self.free[left].extend(open_)
            if not count:
                return
        if count:
            n = -(-count // (self.capacity // length))
            self.put(length, rank, count, self.open(n), n, self.capacity)


def groups_of(counts: dict[int, int], k: int) -> list[list[tuple[int, int, int]]]:
    """Up to k groups of equal cardinality, longest first: lists of (length, first rank, count)."""
    each = max(1, -(-sum(counts.values()) // k))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if not room:
                out.append([])
                room = each
            took = min(left, room)
            out[-1].append((length, rank, took))
            rank, left, room = rank + took, left - took, room - took
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used: column generation for the fewest sequences, rounded down.

    ``rounds`` bounds the search on the driver; the patterns in use when it ends are a valid cover all the same.
    """
    k = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)  # one column per group
    for _ in range(rounds):
        inverse = np.linalg.inv(patterns)
        use = inverse @ counts
        worth = np.ones(k) @ inverse
        # the best pattern at these prices: unbounded knapsack over the capacity
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            value = best[c - sizes[fits]] + worth[fits]
            i = int(value.argmax())
            if value[i] > best[c - 1] + 1e-12:
                best[c], last[c] = value[i], fits[i]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if best[c] == best[c - 1]:
                c -= 1
            else:
                new[last[c]] += 1
                c -= int(sizes[last[c]])
        move = inverse @ new
        ratio = np.where(move > 1e-9, np.maximum(use, 0) / np.where(move > 1e-9, move, 1), np.inf)
        patterns[:, int(ratio.argmin())] = new
    use = np.floor(np.maximum(np.linalg.solve(patterns, counts), 0) + 1e-6).astype(int)
    return [(patterns[:, j].astype(int), int(use[j])) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int, k: int = 64, large: float = 1 / 6) -> Plan:
    """Where the pieces of each length go; lengths from 1 to ``capacity``."""
    p = Plan(capacity)
    big = {n: c for n, c in histogram.items() if large * capacity <= n < capacity}
    rest: dict[int, list[tuple[int, int]]] = {n: [(0, c)] for n, c in histogram.items() if n not in big}
    groups = groups_of(big, k)
    if groups:
        sizes = np.array([g[0][0] for g in groups])
        queues = [list(g) for g in groups]
        for pattern, times in configurations(sizes, np.array([sum(c for _, _, c in g) for g in groups], float), capacity):
            have = [sum(c for _, _, c in q) for q in queues]
            times = min([times, *(have[g] // pattern[g] for g in np.flatnonzero(pattern))])
            if times <= 0:
                continue
            seq = p.open(times)
            filled = [(0, times, capacity)]  # runs of sequences with the same lengths so far: first, how many, room left
            for g in (g for g in np.flatnonzero(pattern) for _ in range(pattern[g])):
                queue, after = queues[g], []
                for first, n, left in filled:
                    while n:
                        length, rank, c = queue[0]
                        took = min(n, c)
                        p.runs.append((length, rank, took, seq + first, capacity - left, 1))
                        after.append((first, took, left - length))
                        first, n = first + took, n - took
                        queue[0] = (length, rank + took, c - took)
                        if c == took:
                            queue.pop(0)
                filled = after
            for first, n, left in filled:
                p.room(left, seq + first, n)
        for queue in queues:
            for length, rank, c in queue:
                rest.setdefault(length, []).append((rank, c))
    for length in sorted(rest, reverse=True):
        for rank, c in rest[length]:
            p.best_fit(length, rank, c)
    return p


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048, k: int = 64) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with sequence_id and offset; every sequence is filled from 0 without gaps."""
    pieces = stage(cut(docs, vocabulary or bpe.default_path(), end_id, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS))), "pieces")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    runs = np.array(plan(histogram, capacity, k).runs, np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    table = docs.sparkSession.sparkContext.broadcast(runs)

    shift = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(shift), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (pieces.withColumn("inside", inside).join(before, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("before")).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        firsts = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
        span = int(runs[:, 1].max()) + 1 if len(runs) else 1
        keys = runs[:, 0] * span + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            assert (at >= firsts[length]).all()
            _, first, _, seq, offset, each = runs[at].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq + nth // each), pa.array(offset + nth % each * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECE}, sequence_id long, offset long")
