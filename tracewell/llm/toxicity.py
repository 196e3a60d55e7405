"""Toxicity by two class-conditional Kneser-Ney models whose likelihoods are compared.

Labelled texts of each class give byte n-gram counts. The longest n-grams count as they occur, shorter ones by the number of different
bytes seen to their left, and each length has the discount that its n-grams seen once and twice ask for. Contexts of two bytes and
more belong to the class; below them both classes share one table of continuation counts, and what discounting takes from a
class's own counts goes down to it, so an expression too rare to have counts of its own is judged alike by both models.

A document's evidence is a ratio of two likelihoods, per word: that of a text with one passage of ``passage`` words from the toxic
model at a place unknown, all else ordinary, against that of a text ordinary throughout. That is the mean over all passages of
their likelihood ratios, so a long clean text, which has more passages, is not judged toxic by their number, and the words
around a slur do not dilute it as in the ratio of whole texts; a text of one passage has that ratio itself. Where the
evidence passes the threshold is read off labelled rows that the counts have not seen.

The models are fitted on a bounded sample, ``per_class`` labelled documents of each class, the first in the order of a hash
of the id, and all counts come from all of it; the ``states`` contexts of most weight become states of the automaton, rarer ones
are predicted from their suffix. Every whole text is scored. Only doc_id and text of a document and toxic of its label are ever read.

Defined results: a null or empty text is a text of one empty word; without labels of both classes all scores are 0.
Labels repeated for a document count as toxic if any is; null labels do not count. Rows that repeat a doc_id are scored row by
row, a null doc_id is never held out. Ties in the hash order of the sample go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import automaton as A
from tracewell.llm.common import fold, give_back, sliced

SHARED = 2  # n-grams up to this length are counted over both classes
STATES = 40_000
SLICE_CHARS = 2_000_000
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1


@dataclass
class Model:
    automaton: A.Automaton | None
    evidence: np.ndarray | None
    passage: int
    threshold: float = 0.0
    slope: float = 1.0

    def strength(self, texts: pa.Array) -> np.ndarray:
        """Log10 likelihood ratio per word of each text: one toxic passage somewhere against none."""
        if self.automaton is None:
            return np.full(len(texts), -np.inf)
        raw, end = A.stream(A.words_of(texts))
        if not len(end):
            return np.empty(0)
        total = np.cumsum(self.evidence[self.automaton.lanes(raw)], dtype=np.float64)
        close = np.flatnonzero((raw == 0x20) | (raw == A.END))  # the end mark counts as a word
        run = np.concatenate(([0.0], total[close]))
        stop = np.searchsorted(close, end)
        start = np.concatenate(([0], stop[:-1]))
        words = stop - start
        word = np.arange(len(close))
        last = np.minimum(word + self.passage, np.repeat(stop, words))
        ratio = (run[last] - run[word]) * np.log(10)
        ratio[(last - word < self.passage) & (word > np.repeat(start, words))] = -np.inf  # the tail of a passage is none of its own
        top = np.maximum.reduceat(ratio, start)
        passages = np.maximum(words - self.passage + 1, 1)
        mean = top + np.log(np.add.reduceat(np.exp(ratio - np.repeat(top, words)), start) / passages)
        return mean / np.log(10) / np.minimum(words, self.passage)

    def score(self, texts: pa.Array) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.slope * (self.strength(texts) - self.threshold)))


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, toxic, part (fold) of the labelled documents that the models may learn from."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.withColumn("part", fold("doc_id", FOLDS)).where(F.col("part") != HELD_OUT)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [own.where(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    chosen = parts[0].union(parts[1])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, passage: int = 2, states: int = STATES) -> Model:
    chosen = sample(docs, labels, per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            toxic = batch.column("toxic").to_numpy()
            for c in (0, 1):
                rows = pa.array(toxic == c)
                keys, n = A.counted(A.grams(A.stream(A.words_of(batch.column("text").filter(rows)))[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c)), pa.array(keys), pa.array(n)], ["toxic", "gram", "n"])

    seen = chosen.where(F.col("part") != CALIBRATE).select("text", "toxic").mapInArrow(count, "toxic long, gram long, n long")
    counts = seen.groupBy("toxic", "gram").agg(F.sum("n").alias("n")).toArrow()  # n-grams of the bounded sample
    toxic, gram, n = (counts[c].to_numpy() for c in ("toxic", "gram", "n"))
    del counts
    grams = {int(c): A.marginals(gram[toxic == c], n[toxic == c]) for c in np.unique(toxic)}
    del toxic, gram, n
    give_back()
    if len(grams) < 2:
        return Model(None, None, passage)
    symbols = np.union1d(grams[0][1][0], grams[1][1][0]).astype(np.uint8)
    # the contexts that weigh most, classes alike; a context never weighs more than its prefix or its suffix
    weighed = []
    for c in (0, 1):
        all_ = grams[c][1][1].sum()
        for k, (gram, n) in grams[c].items():
            weighed.append((((k - 1) << A._BITS) | (gram >> 8), n / all_))
    context, weight = A.counted(np.concatenate([w[0] for w in weighed]), np.concatenate([w[1] for w in weighed]))
    best = context[np.lexsort((context, -np.round(weight, 12)))[:states]]
    del weighed, context, weight
    give_back()
    a = A.Automaton(A.closed(np.sort(best)), symbols)
    shared = {k: c for k, c in A.continuations(grams[0], grams[1]).items() if k <= SHARED}

    def log_p(c: int) -> np.ndarray:
        own = A.continuations(grams[c]) | shared
        return A.discounted(a, own, A.discounts(own))

    evidence = log_p(1)
    evidence -= log_p(0)
    model = Model(a, evidence.reshape(-1), passage)
    del grams, shared, evidence
    give_back()
    return calibrated(model, chosen.where(F.col("part") == CALIBRATE).select("doc_id", "text", "toxic"))


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The threshold with the fewest errors on unseen labelled rows, in the middle of the gap it lies in."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(shipped.value.strength(batch.column("text"))), batch.column("toxic").cast(pa.int64())], ["s", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(measure, "s double, toxic long").toArrow().to_pandas().sort_values(["s", "toxic"])
    s, y = seen["s"].to_numpy(), seen["toxic"].to_numpy()
    if 0 < y.sum() < len(y):
        # errors if all from i on count as toxic, of which the middle of the best run of places is taken
        errors = np.concatenate(([0], np.cumsum(y))) + (len(y) - y.sum()) - np.concatenate(([0], np.cumsum(1 - y)))
        i = int(np.argmin(errors))
        low, high = s[max(i - 1, 0)], s[min(i, len(s) - 1)]
        model.threshold = float((low + high) / 2)
        model.slope = float(8 / max(np.median(s[y == 1]) - np.median(s[y == 0]), 1e-3))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted; all columns are kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            score = shipped.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000, passage: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return scored(rows, fit(docs, labels, per_class, passage)).drop("text")
