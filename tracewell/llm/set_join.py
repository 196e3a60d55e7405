"""N-gram Jaccard self-join by chosen paths: which texts share at least 4 of 5 of their five-word shingles.

1. A text becomes the set of 64-bit hashes of its five-word shingles (lower case A-Z). Texts with the same set are one class of
   copies and go on as one representative.
2. Chosen paths: in each of several runs, a set starts in one common bucket and goes on to a bucket for each of its tokens that the
   bucket's hash chooses, 1 / (similarity * size) of them. Two similar sets share about one chosen token or more. Buckets of
   up to ``small`` sets are compared at once, larger ones are split again, down to LEVELS. What no split takes apart (most sets of the
   bucket alike, by a byte of their sketches) or is still large at the last level is compared in tiles: pairs of parts of the
   bucket, each pair of parts a group of its own. The number of runs follows from the recall wanted (:func:`runs_for`).
3. Comparing within a bucket uses sketches (64 min-hashes of 8 bits) against a lower bar, and hands on only a spanning forest of
   what may be similar. Its components, found by rounds of joins, are candidates for step 4, so a pair that every run missed is
   still compared if anything connects it.
4. Within each component (in tiles again if it is large) the whole shingle sets are compared, all pairs, in blocks of matrix
   products. A task hands on the number of links of each set and a spanning forest of the links, never the pairs.

The work on a group of m different near copies grows with m squared, the rows that leave tasks and are shuffled with m (times the
number of tiles). No bucket is cut or sampled.

Defined results: texts of one to four words have one shingle of all their words; texts without words (null and empty included) are
copies of one another. Rows that repeat a doc_id are texts of their own. The class of a text is named by its smallest doc_id;
a null doc_id names a class only if there is no other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import automaton as A
from tracewell.llm.common import ROW, keeper, kept_in_place, numbered, sliced
from tracewell.operators.graph import connected_components
from tracewell.session import stage

WORDS = 5
#: similar: 4 shared of 5 together
NUMERATOR, DENOMINATOR = 4, 5
LEVELS = 3
SKETCH = 64
SKETCH_BAR = 0.6
SLICE_CHARS = 2_000_000
TILE_SETS, TILE_TOKENS = 1024, 400_000

_R = np.random.default_rng(20240)
_ODD = (_R.integers(0, 1 << 62, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _R.integers(0, 1 << 62, SKETCH, dtype=np.uint64)
_SEEDS = _R.integers(0, 1 << 62, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float) -> int:
    """Runs so that two sets at the bar share a bucket of the last level with probability ``recall``.

    With one shared chosen token expected per bucket, a level keeps a pair together with q -> 1 - exp(-q), from q = 1.
    """
    q = 1.0
    for _ in range(LEVELS):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts end to end, offsets of the texts)."""
    cut = A.words_of(texts)
    offsets = np.asarray(cut.offsets).astype(np.int64)
    offsets -= offsets[0]
    words = cut.flatten().dictionary_encode()
    hashes = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    h = hashes[words.indices.to_numpy()]
    n = np.diff(offsets)
    none = (n == 1) & pc.equal(cut.flatten().take(pa.array(offsets[:-1])), "").to_numpy(zero_copy_only=False)
    rolled = np.zeros(len(h), np.uint64)
    for i in range(WORDS):
        rolled[:len(h) - i] = rolled[:len(h) - i] * _P + h[i:]
    out, sizes = [], np.zeros(len(n), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if none[i]:
            continue
        if b - a >= WORDS:
            own = np.unique(mix(rolled[a:b - WORDS + 1]))
        else:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    x = x * _P + w
            own = mix(np.array([x], np.uint64))
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def sketches(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SKETCH bytes a set; sets without tokens have zeros."""
    out = np.zeros((len(offsets) - 1, SKETCH), np.uint8)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for i in range(SKETCH):
            least = np.minimum.reduceat((tokens * _ODD[i] + _ADD[i]) >> np.uint64(24), offsets[full])
            out[full, i] = (mix(least) & np.uint64(255)).astype(np.uint8)
    return out


def paths(tokens: np.ndarray, offsets: np.ndarray, runs: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: (set, key of the bucket it comes from, key of the chosen bucket), over all runs."""
    size = np.diff(offsets)
    share = 2.0 ** 64 * DENOMINATOR / (NUMERATOR * np.maximum(size, 1))
    bar = np.where(share >= 2.0 ** 64, np.uint64((1 << 64) - 1), np.minimum(share, 1.8e19).astype(np.uint64))
    levels: list[list] = [[] for _ in range(LEVELS)]
    for run in range(runs):
        where, node = np.flatnonzero(size), np.full(np.count_nonzero(size), _SEEDS[run], np.uint64)
        for level in range(LEVELS):
            n = size[where]
            total = int(n.sum())
            if not total:
                break
            at = np.repeat(offsets[:-1][where] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            owner = np.repeat(np.arange(len(where)), n)
            hashed = mix(tokens[at] ^ node[owner])
            chosen = np.flatnonzero(hashed <= bar[where][owner])
            child = mix(hashed[chosen] + _P)
            parent = owner[chosen]
            levels[level].append((where[parent], node[parent], child))
            where, node = where[parent], child
    none = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    return [tuple(np.concatenate(x) for x in zip(*own)) if own else none for own in levels]


def lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order].view(np.int64)))


def sketched(docs: DataFrame, runs: int) -> DataFrame:
    """docs (uid, doc_id, text) -> uid, doc_id, same (hash of the set), size, sketch, and the chosen paths of every level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            tokens, offsets = shingles(batch.column("text"))
            n = batch.num_rows
            same = [hashlib.blake2b(tokens[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            cols = {"uid": batch.column("uid"), "doc_id": batch.column("doc_id"), "same": pa.array(same, pa.binary()), "size": pa.array(np.diff(offsets)), "sketch": pa.array([x.tobytes() for x in sketches(tokens, offsets)], pa.binary())}
            for i, (owner, parent, child) in enumerate(paths(tokens, offsets, runs), 1):
                cols[f"from{i}"], cols[f"to{i}"] = lists(owner, parent, n), lists(owner, child, n)
            yield pa.RecordBatch.from_pydict(cols)

    levels = ", ".join(f"from{i} array<long>, to{i} array<long>" for i in range(1, LEVELS + 1))
    return docs.select("uid", "doc_id", "text").mapInArrow(run, f"uid long, doc_id long, same binary, size long, sketch binary, {levels}")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal keys, as one batch each; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        bounds = [0, *cuts.tolist(), batch.num_rows] if not (len(cuts) and cuts[0] == 0) else [*cuts.tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if held and (i or change[0]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    todo, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            node = stack.pop()
            near = np.flatnonzero(linked[node] & todo)
            todo[near] = False
            out += [(node, x) for x in near.tolist()]
            stack += near.tolist()
    return out


def across(batch: pa.RecordBatch) -> np.ndarray | None:
    """Which pairs a group of a tile pair is to compare: None for all, else those of different parts."""
    part = batch.column("part").to_numpy()
    return None if (part == part[0]).all() and batch.column("i")[0].as_py() == batch.column("j")[0].as_py() else part[:, None] != part[None]


def maybe_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of what the sketches of a bucket call similar."""
    left, right = [], []
    for g in groups(batches, ["key", "i", "j"]):
        if g.num_rows < 2:
            continue
        sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        size, rid = g.column("size").to_numpy(), g.column("rid").to_numpy()
        like = np.zeros((len(rid), len(rid)), bool)
        for a in range(0, len(rid), 64):
            like[a:a + 64] = (sketch[a:a + 64, None] == sketch[None]).sum(2, dtype=np.int16) >= SKETCH_BAR * SKETCH
        like &= DENOMINATOR * np.minimum(size[:, None], size) >= NUMERATOR * np.maximum(size[:, None], size)
        only = across(g)
        for a, b in forest(like if only is None else like & only):
            if rid[a] != rid[b]:
                left.append(rid[a])
                right.append(rid[b])
        if len(left) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})
            left, right = [], []
    yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def shared_counts(flat: np.ndarray, owner: np.ndarray, m: int, block: int = 4096) -> np.ndarray:
    """Sizes of all intersections of m sets given as (token, set) pairs."""
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times[token] > 1  # a token of one set is in no intersection
    renumbered = np.cumsum(times > 1) - 1
    token, owner = renumbered[token[often]], owner[often]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((m, m), np.float32)
    n = int(token[-1]) + 1 if len(token) else 0
    for a in range(0, n, block):
        lo, hi = np.searchsorted(token, [a, a + block])
        x = np.zeros((m, min(block, n - a)), np.float32)
        x[owner[lo:hi], token[lo:hi] - a] = 1
        out += x @ x.T
    return out


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each component (or pair of its parts): links per set, counting copies, and a spanning forest of the links."""
    rows: list[tuple] = []
    for g in groups(batches, ["key", "i", "j"]):
        m = g.num_rows
        if m < 2:
            continue
        rid, copies = g.column("rid").to_numpy(), g.column("copies").to_numpy()
        tokens = g.column("tokens")
        ends = np.asarray(tokens.offsets)
        size = np.diff(ends)
        shared = shared_counts(np.asarray(tokens.flatten()), np.repeat(np.arange(m), size), m)
        linked = (NUMERATOR + DENOMINATOR) * shared.astype(np.int64) >= NUMERATOR * (size[:, None] + size[None])
        only = across(g)
        if only is not None:
            linked &= only
        np.fill_diagonal(linked, False)
        n = linked @ copies
        rows += [(int(rid[i]), None, int(n[i])) for i in np.flatnonzero(n)]
        rows += [(int(rid[a]), int(rid[b]), None) for a, b in forest(linked)]
        if len(rows) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "n"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "n"])


def tiled(rows: DataFrame, parts) -> DataFrame:
    """Adds part, i and j: every row goes to all pairs (i <= j) of ``parts`` parts of its group that hold its own."""
    rows = rows.withColumn("parts", F.greatest(parts.cast("long"), F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<long>")))
            .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other"))


def in_groups(rows: DataFrame, task, schema: str) -> DataFrame:
    keys = ["key", "i", "j"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(task, schema)


def candidates(reps: DataFrame, small: int) -> DataFrame:
    """(a, b): pairs of representatives whose components step 4 compares."""
    reps = reps.withColumn("byte", F.substring("sketch", 1, 1))  # equal for two sets as often as they are similar
    compared, heavy = [], None
    for level in range(1, LEVELS + 1):
        if level == 1:
            rows = reps.select("rid", "byte", F.explode("to1").alias("key"))
        else:
            rows = (reps.select("rid", "byte", F.explode(F.arrays_zip(f"from{level}", f"to{level}")).alias("x")).select("rid", "byte", F.col(f"x.from{level}").alias("parent"), F.col(f"x.to{level}").alias("key"))
                    .join(heavy.select(F.col("key").alias("parent")), "parent").select("rid", "byte", "key"))
        n = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        rows = stage(rows.join(n, "key"), f"join-level{level}")
        compared.append(rows.where(F.col("n") <= small) if level < LEVELS else rows)
        if level < LEVELS:
            # sets that are mostly alike share what they are split by, so splitting would only multiply them: compare them here
            large = rows.where(F.col("n") > small)
            share = large.groupBy("key", "byte").agg(F.count("*").alias("c")).groupBy("key").agg((2 * F.max("c") >= F.sum("c")).alias("alike"))
            share = stage(share, f"join-large{level}")
            compared.append(large.join(share.where("alike").select("key"), "key"))
            heavy = share.where("not alike").select("key")
            if heavy.isEmpty():
                break
    rows = compared[0].select("key", "rid", "n")
    for more in compared[1:]:
        rows = rows.union(more.select("key", "rid", "n"))
    rows = tiled(rows, F.when(F.col("n") > small, F.ceil(F.col("n") / TILE_SETS)).otherwise(F.lit(1)))
    rows = rows.join(reps.select("rid", "size", "sketch").hint("merge"), "rid").select("key", "i", "j", "part", "rid", "size", "sketch")
    return in_groups(rows, maybe_similar, "a long, b long")


def shingled(rows: DataFrame, kept) -> DataFrame:
    """rows (uid, text) -> rid, tokens of those that ``kept`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(kept(batches), "text", SLICE_CHARS):
            tokens, offsets = shingles(batch.column("text"))
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), sets], ["rid", "tokens"])

    return rows.select("uid", "text").mapInArrow(run, "rid long, tokens array<long>")


def join(docs: DataFrame, recall: float = 0.995, small: int = 256) -> DataFrame:
    """uid, doc_id, class_id and n_links of every row of ``docs`` (doc_id, text, and ROW, which becomes uid), as numbered() gives them.

    n_links: rows, other than itself, whose text is similar to this one's, copies included.
    """
    rows = docs.select(F.col(ROW).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_ = stage(sketched(rows, runs_for(recall)), "join-sketches")
    same = stage(all_.groupBy("same").agg(F.min("uid").alias("rid"), F.count("*").alias("copies"), F.min("doc_id").alias("first")), "join-copies")
    # one of each set of copies, where it lies; joins below are merges at every size: what they move grows with the input
    reps = kept_in_place(all_.where("size > 0"), same.select(F.col("rid").alias("uid")), "uid").withColumnRenamed("uid", "rid")
    found = connected_components(candidates(reps, small), "a", "b")
    member = (found.withColumnRenamed("node", "rid").join(reps.select("rid", "size"), "rid")
              .join(same.select("rid", "copies"), "rid").withColumnRenamed("root", "key"))
    member = stage(member, "join-members")
    parts = member.groupBy("key").agg(F.count("*").alias("sets"), F.sum("size").alias("tokens_in"))
    parts = parts.select("key", F.ceil(F.greatest(F.col("sets") / TILE_SETS, F.col("tokens_in") / TILE_TOKENS)).alias("want"))
    sets = shingled(rows, keeper(member.select(F.col("rid").alias("uid")), "uid"))
    todo = tiled(member.select("key", "rid", "copies").join(parts, "key"), F.col("want")).join(sets.hint("merge"), "rid").select("key", "i", "j", "part", "rid", "copies", "tokens")
    links = stage(in_groups(todo, similar, "a long, b long, n long"), "join-links")
    classes = connected_components(links.where("b is not null").select("a", "b"), "a", "b")
    n = links.where("n is not null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    by_set = (same.join(classes.withColumnRenamed("node", "rid"), "rid", "left").join(n, "rid", "left")
              .select("same", "first", F.coalesce("root", "rid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    by_set = stage(by_set, "join-sets")
    name = by_set.groupBy("root").agg(F.min("first").alias("class_id"))
    return all_.select("uid", "doc_id", "same").join(by_set.join(name, "root").select("same", "root", "class_id", "n_links"), "same").select("uid", "doc_id", "root", "class_id", "n_links")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id, the first if it is repeated. All columns are kept."""
    rows = numbered(docs)
    found = join(rows, **how)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("x")).select(F.col("x.uid").alias(ROW))
    return kept_in_place(rows, first).drop(ROW)
