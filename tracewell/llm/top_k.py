"""Exact top-k inner products from KD-trees, one per shard.

A top tree, read off a bounded sample, cuts the space into cells by median splits; a cell with more rows than a shard may hold is
dealt to shards by a hash of the ids, so copies never make a large one. A shard's tree splits at the median of the widest dimension
and keeps the tight bounding box of every node, inner ones too. What a query can score at most inside a box is the sum over
dimensions of the larger of its products with the box's two ends. A query walks a tree best first: of the nodes it has met it opens
the one of the highest bound, an inner node by bounding its two children, a leaf by scoring its rows, and it stops where that bound
falls below its k-th best score. It first searches a shard of the cell it lies in; the k-th score found there goes with it, only
to shards of cells whose box may beat it, and prunes there from the start. Queries go to shards in blocks, and only the k best of
each (query, shard) leave a task.

``sample_values`` bounds the numbers in the sample of the top tree, ``most_cells`` its leaves and with them the boxes that all tasks
hold; both shape the work and never the result.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id; a shorter
vector counts as filled up with zeros. A row with the id of the query is its own row and never a candidate; a repeated id is
searched for once (its smallest vector) and is a candidate as often as it is there. Ties go to the smaller id. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.session import stage

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
LEAF = 128
SAMPLE_VALUES = 1_000_000
MOST_CELLS = 1024
LOWEST = np.iinfo(np.int64).min


def at_most(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest score that each query can reach in the box beside it."""
    return np.maximum(queries * low, queries * high).sum(1)


class Tree:
    """Median splits down to LEAF rows. Node i has the box ``low[i]`` to ``high[i]``; ``child[i]`` is the first of its two children,
    which stand side by side, or 0 for a leaf, whose rows are ``leaves[i]``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        low, high, child, todo, node = [], [], [], [np.arange(len(ids))], 0
        while node < len(todo):  # breadth first
            own, todo[node] = todo[node], None
            x = rows[own]
            low.append(x.min(0)), high.append(x.max(0))
            if len(own) <= LEAF:
                own = own[np.argsort(ids[own], kind="stable")]
                self.leaves[node] = ids[own], rows[own]
                child.append(0)
            else:
                wide = int((high[-1] - low[-1]).argmax())
                half = np.argpartition(x[:, wide], len(own) // 2)  # equal values part by place, so copies never stop a split
                child.append(len(todo))
                todo += [own[half[:len(own) // 2]], own[half[len(own) // 2:]]]
            node += 1
        self.low, self.high, self.child = np.stack(low), np.stack(high), np.array(child)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of up to k best rows per query, none below ``bound``.

        Each query has its own queue of nodes, a row of ``queue`` with their bounds; all queries take their next step together."""
        n = len(queries)
        best, who = np.full((n, k), LOWEST), np.full((n, k), np.iinfo(np.int64).max)
        gone = -np.inf if queries.dtype.kind == "f" else LOWEST
        queue = np.full((n, len(self.child)), gone, queries.dtype)
        queue[:, 0] = at_most(queries, self.low[:1], self.high[:1])
        open_ = np.arange(n)
        while True:
            node = queue[open_].argmax(1)
            top = queue[open_, node]
            still = (top > gone) & (top >= np.maximum(best[open_, -1], bound[open_]))  # an equal score may have a smaller id
            open_, node = open_[still], node[still]
            if not len(open_):
                break
            queue[open_, node] = gone
            inner = self.child[node] > 0
            q = open_[inner]
            for side in (0, 1):
                c = self.child[node[inner]] + side
                queue[q, c] = at_most(queries[q], self.low[c], self.high[c])
            for one in np.unique(node[~inner]):
                q = open_[node == one]
                ids, rows = self.leaves[int(one)]
                score = (queries[q] @ rows.T).astype(np.int64)
                score[query_ids[q][:, None] == ids[None]] = LOWEST
                first = np.argsort(-np.maximum(score, LOWEST + 1), axis=1, kind="stable")[:, :k]
                merged = np.concatenate((best[q], np.take_along_axis(score, first, 1)), 1)
                names = np.concatenate((who[q], ids[first]), 1)
                pick = np.lexsort((names, -np.maximum(merged, LOWEST + 1)), axis=1)[:, :k]
                best[q], who[q] = np.take_along_axis(merged, pick, 1), np.take_along_axis(names, pick, 1)
        row, place = np.nonzero((best > LOWEST) & (best >= bound[:, None]))
        return row, who[row, place], best[row, place]


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def searched(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not data.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        rows, wanted = data["v"].combine_chunks(), queries["qv"].combine_chunks()
        width = max(int(np.diff(np.asarray(v.offsets)).max()) for v in (rows, wanted))
        rows, wanted = matrix(rows, width), matrix(wanted, width)
        limit = float(np.abs(rows).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * width
        ids, query_ids = data["vec_id"].to_numpy(), queries["qid"].to_numpy()
        bound = queries["bound"].to_numpy()
        exact = limit < 2.0 ** 52  # then sums of products are exact in doubles too, whose matrix products are fast
        tree = Tree(ids, rows.astype(np.float64) if exact else rows)
        row, who, score = tree.search(query_ids, wanted.astype(np.float64) if exact else wanted, k, bound)
        return pa.table({"query_id": query_ids[row], "vec_id": who, "score": score.astype(np.int64)})

    return run


def integers(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


class Cells:
    """The top tree: median splits of a sample into ``wanted`` cells. Inner nodes only; a child below 0 is the cell ``-1 - child``."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.wide, self.cut, self.child, self.cells = [], [], [], 0
        self._grow(sample, wanted)

    def _grow(self, x: np.ndarray, wanted: int) -> int:
        spread = x.max(0) - x.min(0) if len(x) else np.zeros(1)
        if wanted < 2 or not spread.max(initial=0):
            self.cells += 1
            return -self.cells
        d = int(spread.argmax())
        values = np.sort(x[:, d])
        cut = min(values[len(x) * (wanted // 2) // wanted], values[values < values[-1]][-1])  # both sides keep a row
        node = len(self.wide)
        self.wide.append(d), self.cut.append(cut), self.child.append([0, 0])
        low = x[:, d] <= cut
        self.child[node] = [self._grow(x[low], wanted // 2), self._grow(x[~low], wanted - wanted // 2)]
        return node

    def of(self, rows: np.ndarray) -> np.ndarray:
        if not self.wide:
            return np.zeros(len(rows), np.int64)
        wide, cut, child = np.array(self.wide), np.array(self.cut), np.array(self.child)
        node, todo = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo):
            own = node[todo]
            node[todo] = child[own, (rows[todo, wide[own]] > cut[own]).astype(np.int64)]
            todo = todo[node[todo] >= 0]
        return -1 - node


def dealt(rows: DataFrame, cells: Cells, width: int) -> DataFrame:
    """``rows`` with the cell that each vector lies in."""
    shipped = rows.sparkSession.sparkContext.broadcast(cells)  # at most ``most_cells`` splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.of(matrix(batch.column("v"), width)))], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, is_query boolean, cell long")


def boxes(rows: DataFrame, cells: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of rows, low and high ends) of each cell; tasks hand on one row per cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        low, high = np.full((cells, width), np.iinfo(np.int64).max), np.full((cells, width), LOWEST)
        for batch in batches:
            x, cell = matrix(batch.column("v"), width), batch.column("cell").to_numpy()
            n += np.bincount(cell, minlength=cells)
            np.minimum.at(low, cell, x), np.maximum.at(high, cell, x)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(list(low[seen]), pa.list_(pa.int64())), pa.array(list(high[seen]), pa.list_(pa.int64()))], ["cell", "n", "low", "high"])

    parts = rows.select("cell", "v").mapInArrow(run, "cell long, n long, low array<long>, high array<long>")
    ends = parts.select("cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("d", "x"))
    ends = ends.groupBy("cell", "d").agg(F.sum("n").alias("n"), F.min("x.low").alias("low"), F.max("x.high").alias("high")).toArrow()  # most_cells * width rows
    n, low, high = np.zeros(cells, np.int64), np.zeros((cells, width), np.int64), np.zeros((cells, width), np.int64)
    cell, d = ends["cell"].to_numpy(), ends["d"].to_numpy()
    n[cell], low[cell, d], high[cell, d] = ends["n"].to_numpy(), ends["low"].to_numpy(), ends["high"].to_numpy()
    return n, low, high


def bounded(queries: DataFrame, shards: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> DataFrame:
    """qid, qv, bound and the shards that each query still has to visit: those of cells whose box may hold a row as good as ``bound``."""
    first = np.concatenate(([0], np.cumsum(shards)))
    shipped = queries.sparkSession.sparkContext.broadcast((shards, first, low.astype(np.float64), high.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, first, low, high = shipped.value
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                q, home, bound = matrix(batch.column("qv"), width).astype(np.float64), batch.column("home").to_numpy(), batch.column("bound").to_numpy()
                most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)  # doubles may round a large bound down
                row, cell = np.nonzero((most + slack >= bound[:, None]) & (shards > 0))
                again = np.repeat(np.arange(len(row)), shards[cell])
                shard = first[cell][again] + np.arange(len(again)) - np.repeat(np.cumsum(shards[cell]) - shards[cell], shards[cell])
                row = row[again]
                keep = shard != home[row]
                row, shard = row[keep], shard[keep]
                for i in range(0, len(row), 8192):
                    at = pa.array(row[i:i + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[i:i + 8192]), *(batch.column(c).take(at) for c in ("qid", "qv", "bound"))], ["qshard", "qid", "qv", "bound"])

    return queries.mapInArrow(run, "qshard long, qid long, qv array<long>, bound long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
          sample_values: int = SAMPLE_VALUES, most_cells: int = MOST_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` (vec_id, embedding) for each row that ``is_query`` marks."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = stage(vectors.where(F.col("embedding").isNotNull() & ~bad & F.col("vec_id").isNotNull())
                 .select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")), "top-k-vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    lowest = F.lit(int(LOWEST))
    if n > shard_rows and width:
        few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, sample_values // width)).select("v").toArrow()["v"].combine_chunks()
        cells = Cells(matrix(few, width), min(-(-n // shard_rows), most_cells))
        rows = dealt(rows, cells, width)
        size, low, high = boxes(rows, cells.cells, width)
    else:
        rows, size, low, high = rows.withColumn("cell", F.lit(0).cast("long")), np.array([n]), np.zeros((1, width), np.int64), np.zeros((1, width), np.int64)
    shards = -(-size // shard_rows)
    ends = np.concatenate(([0], np.cumsum(shards)))
    first, many = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (ends[:-1], np.maximum(shards, 1)))
    cell = F.col("cell").cast("int")
    rows = rows.withColumn("shard", (F.get(first, cell) + F.pmod(F.xxhash64("vec_id"), F.get(many, cell).cast("long"))).cast("long"))
    data = rows.select("shard", "vec_id", "v")
    queries = rows.where("is_query").groupBy(F.col("vec_id").alias("qid")).agg(F.min(F.struct("v", "shard")).alias("own")).select("qid", F.col("own.v").alias("qv"), F.col("own.shard").alias("home"))

    def meet(data: DataFrame, queries: DataFrame, keys: list[str], query_keys: list[str]) -> DataFrame:
        return data.groupBy(*keys).cogroup(queries.groupBy(*query_keys)).applyInArrow(searched(k), "query_id long, vec_id long, score long")

    def met_in_blocks(queries: DataFrame) -> DataFrame:
        """A shard is sent once per ``query_block`` queries that come to it, and not at all where none does."""
        asked = queries.groupBy(F.col("qshard").alias("shard")).agg(F.ceil(F.count("*") / F.lit(query_block)).alias("blocks"))
        copies = data.join(asked, "shard").select("shard", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        dealt = queries.join(asked.withColumnRenamed("shard", "qshard"), "qshard").withColumn("qblock", F.pmod(F.xxhash64("qid", F.lit(1)), F.col("blocks")))
        return meet(copies, dealt, ["shard", "block"], ["qshard", "qblock"])

    near = stage(met_in_blocks(queries.select(F.col("home").alias("qshard"), "qid", "qv", lowest.alias("bound"))), "top-k-near")
    if ends[-1] > 1:
        kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("kth"))
        asking = queries.join(kth, F.col("query_id") == F.col("qid"), "left").select("qid", "qv", "home", F.coalesce("kth", lowest).alias("bound"))
        near = near.union(met_in_blocks(stage(bounded(asking, shards, low, high, width), "top-k-going")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
