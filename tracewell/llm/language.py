"""Language identification by mixture inference.

Every learned language has a smoothed byte trigram model. A text is cut into units of a few words, each unit has a likelihood
under every language, and expectation-maximisation finds the proportions of the languages in the text. Which languages are in
it at all is a choice between sets: the languages in the order of their proportion, the set grown by the next one as long
as the likelihood rises by more than the penalty (half the logarithm of the number of units, times ``penalty``). The prediction
is the language with the largest share in the chosen set.

The models learn from a bounded sample, ``per_language`` documents of each language, the first in the order of a hash of the id;
every whole text is predicted.

Defined results: a null text or one without any letter is ``und`` with score 0, as is every text if no language could be
learned. Languages with equal shares: the first by code point. Rows that repeat a doc_id are predicted row by row; rows with a null
doc_id are never held out. Documents of the hash that closes a sample all belong to it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm import automaton as A
from tracewell.llm.common import fold, sliced

FOLDS, HELD_OUT = 4, 2
UNIT = 4  # words
SLICE_CHARS = 4_000_000
UNDETERMINED = "und"
CLASSES = 128
SALTS = 64


def byte_classes() -> np.ndarray:
    """Blank and end, a-z, digits, other ASCII, 64 continuation bytes, and the lead bytes of two-byte characters apart."""
    b = np.arange(256)
    out = np.full(256, 28)
    out[[0x20, A.END]] = 0
    out[97:123] = np.arange(1, 27)
    out[48:58] = 27
    out[128:192] = 29 + np.arange(64)
    out[192:] = np.minimum(93 + b[192:] - 192, CLASSES - 1)
    return out


_CLASS = byte_classes().astype(np.int32)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """One code per byte: its class and those of the two bytes before it."""
    c = _CLASS[np.concatenate((np.array([A.END, A.END], np.uint8), raw))]
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


@dataclass
class Model:
    languages: list[str]
    row: np.ndarray  # of each trigram code; row 0 is a trigram no language has shown
    logs: np.ndarray  # rows x languages
    penalty: float
    rounds: int

    def unit_logs(self, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (units x languages) and the first unit of each text."""
        close = np.flatnonzero((raw == 0x20) | (raw == A.END))
        stop = np.searchsorted(close, end)  # words before each text's end
        start = np.concatenate(([0], stop[:-1]))
        nth = np.arange(len(close)) - np.repeat(start, stop - start)
        head = np.flatnonzero(nth % UNIT == 0)
        at = np.concatenate(([0], close[:-1] + 1))[head]
        rows = self.row[trigrams(raw)]
        per_unit = np.stack([np.add.reduceat(self.logs[:, i][rows], at) for i in range(len(self.languages))], 1)
        return per_unit, np.searchsorted(head, start)

    def mixture(self, like: np.ndarray, first: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts x languages) within ``allowed`` and the log-likelihood; ``like`` is scaled to at most 1 per unit."""
        share = allowed / allowed.sum(1, keepdims=True)
        size = np.diff(np.append(first, len(like)))[:, None]
        for _ in range(self.rounds):
            part = like * share[owner]
            part /= part.sum(1, keepdims=True)
            share = np.add.reduceat(part, first, axis=0) / size
        total = np.log(np.maximum((like * share[owner]).sum(1), 1e-300))
        return share, np.add.reduceat(total, first)

    def proportions(self, texts: pa.Array) -> np.ndarray:
        """Shares of the languages in each text, 0 outside the chosen set."""
        raw, end = A.stream(A.words_of(texts))
        logs, first = self.unit_logs(raw, end)
        # one float per unit and language; the floor keeps a unit that only one language can explain from ruling alone
        like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -30.0))
        n, k = len(first), len(self.languages)
        owner = np.repeat(np.arange(n), np.diff(np.append(first, len(like))))
        full, _ = self.mixture(like, first, owner, np.ones((n, k)))
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(k)[None], 1)
        single = np.add.reduceat(np.log(like), first, axis=0)
        best = np.zeros((n, k))
        lead = order[:, 0]
        best[np.arange(n), lead] = 1
        worth = single[np.arange(n), lead]
        price = self.penalty * 0.5 * np.log(np.diff(np.append(first, len(like))) + 1.0)
        for size in range(2, k + 1):
            share, ll = self.mixture(like, first, owner, (rank < size).astype(float))
            gains = ll - (size - 1) * price > worth
            if not gains.any():
                break
            best[gains], worth[gains] = share[gains], (ll - (size - 1) * price)[gains]
        return best

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        if letters.any() and self.languages:
            share = self.proportions(texts.filter(pa.array(letters)))
            lead = share.argmax(1)
            names[letters] = np.array(self.languages, object)[lead]
            score[letters] = share[np.arange(len(lead)), lead]
        return names.tolist(), np.clip(score, 0, 1)


def fit(docs: DataFrame, per_language: int = 2000, penalty: float = 4.0, rounds: int = 15) -> Model:
    """Learn from ``docs`` (doc_id, text, lang)."""
    rows = docs.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), "lang", F.xxhash64("doc_id").alias("h"))
    # first within salted parts of a language, of which SALTS * per_language rows at most meet again
    nth = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("h"))
    last = rows.select("lang", "h").withColumn("salt", F.pmod("h", F.lit(SALTS))).withColumn("nth", nth("lang", "salt")).where(F.col("nth") <= per_language)
    last = last.withColumn("nth", nth("lang")).where(F.col("nth") <= per_language).groupBy("lang").agg(F.max("h").alias("last"))
    languages = sorted(r["lang"] for r in last.collect())  # one row per language
    chosen = rows.join(F.broadcast(last), "lang").where("h <= last").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            code = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])
            for i in np.unique(code):
                seen = trigrams(A.stream(A.words_of(batch.column("text").filter(pa.array(code == i))))[0])
                keys, n = A.counted(seen)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i)), pa.array(keys, pa.int64()), pa.array(n)], ["language", "code", "n"])

    got = chosen.mapInArrow(count, "language long, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES ** 3 a language
    language, code, n = (got[c].to_numpy() for c in ("language", "code", "n"))
    seen = np.unique(code)
    row = np.zeros(CLASSES ** 3, np.int32)
    row[seen] = np.arange(1, len(seen) + 1)
    logs = np.full((len(seen) + 1, max(len(languages), 1)), np.log(1 / CLASSES), np.float32)
    b, c = seen // CLASSES % CLASSES, seen % CLASSES
    for i in range(len(languages)):
        three = np.zeros(CLASSES ** 3)
        three[code[language == i]] = n[language == i]
        three = three.reshape(CLASSES, CLASSES, CLASSES)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * CLASSES)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        flat, history = three.reshape(-1)[seen], three.sum(2).reshape(-1)[seen // CLASSES]
        logs[1:, i] = np.log((flat + 20 * p2[b, c]) / (history + 20))
    return Model(languages, row, logs, penalty, rounds)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with lang_pred and score, without the text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            names, score = shipped.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return identify(rows, fit(rows.where(~F.col("held_out")), per_language))
