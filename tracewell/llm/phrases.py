"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces and words. Each distinct word of a slice is hashed once; prefix polynomials over the
word hashes (numpy, modulo 2^64, odd bases) give the fingerprint of every run of words by one subtraction, with the language mixed
in. A second polynomial of another base is the check value.

1. For one word, then two, three and four: tasks add up equal fingerprints and hand on (fingerprint, occurrences, least and
   largest check value, pointer), a shuffle adds them up, those below ``least`` go. A run of k words is only counted if both runs of
   k - 1 words in it may be frequent: a bit map of FILTER_BITS bits at most, built on executors, says so to tasks. The map's size is
   fixed, so beyond it more runs are counted, never fewer.
2. The pointer is the least content hash of the documents that hold the run, so pointers gather in few documents. These are fetched,
   hashed again, and each frequent fingerprint becomes text there, after its check value has agreed.
3. Fingerprints whose least and largest check values differ are collisions: their runs are counted again by their text.

Scores, cuts and containment are then joins on the frequent phrases, in decimals.

Defined results: null and empty texts have no words; a null language is ``und``; rows that repeat count each; texts of any length
are read whole. Languages are any strings. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import sliced
from tracewell.llm.set_join import mix
from tracewell.session import drop_stage, stage

LONGEST = 4
LEAST = 30
REPORT = 2000
SLICE_CHARS = 2_000_000
HELD = 1_500_000
FILTER_BITS = 27
BLOCK = 16

#: what ends a piece becomes a line break, what ends a word a blank, capitals become small
_TABLE = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHECK = np.uint64(0xD1342543DE82EF95)
_NONE = np.empty(0, np.uint64)


def cut(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased texts end to end, where their words begin and end in them, and the row of every word."""
    texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    raw = b"\n".join([*texts, b""]).translate(_TABLE)
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & (data != 10)
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # begin, end, begin, end ...
    return raw, edge, np.searchsorted(np.cumsum(sizes), edge[::2], side="right")


class Words:
    """The words of a slice of texts: word hashes, the bytes of each distinct word, and where runs may not go on."""

    def __init__(self, batch: pa.RecordBatch):
        raw, edge, self.row = cut(batch)
        data = np.frombuffer(raw, np.uint8)
        begins = edge[::2]
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(edge) - 1, 0), [None, pa.py_buffer(edge), pa.py_buffer(raw)])
        named = both.take(pa.array(np.arange(0, len(edge) - 1, 2))).dictionary_encode()
        self.names, self.code = named.dictionary.to_numpy(zero_copy_only=False), named.indices.to_numpy()
        self.piece = np.searchsorted(np.flatnonzero(data == 10), begins)
        tongue = pd.util.hash_array(np.array([x or "" for x in batch.column("lang").to_pylist()], object), categorize=False)
        self.tongue = mix(tongue + _BASE)[self.row] if len(self.row) else _NONE
        if len(self.code):
            hashes = mix(pd.util.hash_array(self.names, categorize=False))  # of bytes as of the text that they encode
            self.sums = [self.prefix(hashes[self.code], base) for base in (_BASE, _CHECK)]
        self.own = batch.column("own").to_numpy()

    @staticmethod
    def prefix(values: np.ndarray, base: np.uint64):
        """Prefix sums of values[i] * base^i, and the powers of the inverse of ``base``."""
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(values), base, np.uint64))), dtype=np.uint64)[:-1]
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(values), inverse, np.uint64))), dtype=np.uint64)[:-1]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64))), back

    def runs(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, fingerprint, check value) of all runs of ``k`` words inside pieces."""
        n = len(self.code) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), _NONE, _NONE
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1:])
        out = []
        for total, back in self.sums:
            out.append(mix((total[at + k] - total[at]) * back[at] + self.tongue[at] * np.uint64(2 * k + 1)))
        return at, out[0] >> np.uint64(64 - bits), out[1]

    def text(self, at: int, k: int) -> str:
        return b" ".join(self.names[self.code[at:at + k]]).decode()


def places(fingerprints: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(fingerprints + _CHECK)
    mask = np.uint64((1 << log_bits) - 1)
    return x & mask, (x >> np.uint64(32)) & mask


def admitted(fingerprints: np.ndarray, bitmap: np.ndarray, log_bits: int) -> np.ndarray:
    out = np.ones(len(fingerprints), bool)
    for p in places(fingerprints, log_bits):
        out &= (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def bit_map(rows: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bit map that admits every value of ``column``: sixteen bits a value, 2^FILTER_BITS at most, put together on executors."""
    log_bits = int(min(FILTER_BITS, max(BLOCK, int(np.ceil(np.log2(rows.count() * 16 + 1))))))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), log_bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(p >> BLOCK), pa.array((p & ((1 << BLOCK) - 1)).astype(np.int32))], ["block", "bit"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column("bits"):
                own = np.zeros(1 << BLOCK, bool)
                own[held.values.to_numpy()] = True
                out.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "bytes"])

    blocks = rows.select(column).mapInArrow(bits, "block long, bit int").groupBy("block").agg(F.collect_set("bit").alias("bits")).mapInArrow(packed, "block long, bytes binary")
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for block, data in blocks.collect():  # 2^FILTER_BITS bits at most, whatever the input
        out[block << (BLOCK - 3):(block + 1) << (BLOCK - 3)] = np.frombuffer(data, np.uint8)
    return out, log_bits


def summed(fp, n, low, high, own):
    """Equal fingerprints together: (fingerprint, occurrences, least and largest check value, least pointer)."""
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.empty(0, np.int64)
    if not len(first):
        return fp, n, low, high, own
    return (fp[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.minimum.reduceat(own[order], first))


def counted(docs: DataFrame, k: int, before: tuple[np.ndarray, int] | None, bits: int) -> DataFrame:
    """fp, n, low, high, own of the runs of ``k`` words whose parts ``before`` admits."""
    shipped = docs.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = shipped.value
        held: list[tuple] = []

        def handed_on():
            rows = summed(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(rows[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 100_000].view(np.int64)) for x in rows], ["fp", "n", "low", "high", "own"])

        for batch in sliced(batches, "text", SLICE_CHARS):
            words = Words(batch)
            at, fp, check = words.runs(k, bits)
            if may is not None and len(at):
                part_at, part, _ = words.runs(k - 1, bits)
                good = np.zeros(len(words.code) + 1, bool)
                good[part_at[admitted(part, *may)]] = True
                some = good[at] & good[at + 1]
                at, fp, check = at[some], fp[some], check[some]
            if len(at):
                check = check.view(np.int64)
                held.append(summed(fp, np.ones(len(at), np.int64), check, check, words.own[words.row[at]]))
            if sum(len(x[0]) for x in held) > HELD:
                held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield from handed_on()
                    held = []
        if held:
            yield from handed_on()

    rows = docs.mapInArrow(run, "fp long, n long, low long, high long, own long")
    return rows.groupBy("fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("own").alias("own"))


def found(docs: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """lang, k, phrase and n of the frequent fingerprints without a collision, from the documents that their pointers name."""
    wanted = frequent.where("low = high").select("own", F.struct("k", "fp", F.col("low").alias("check"), "n").alias("x"))
    bitmap = bit_map(wanted, "own")
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(admitted(batch.column("own").to_numpy().view(np.uint64), *shipped.value)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            words, out = Words(batch), []
            asked = batch.column("asked")
            row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
            k_, fp_, check_, n_ = (asked.flatten().field(name).to_numpy() for name in ("k", "fp", "check", "n"))
            for k in np.unique(k_).tolist():
                mine = np.flatnonzero(k_ == k)
                at, fp, check = words.runs(k, bits)
                some = np.isin(fp.view(np.int64), fp_[mine])
                at, fp, check = at[some], fp[some].view(np.int64), check[some].view(np.int64)
                have = pd.DataFrame({"row": words.row[at], "fp": fp, "check": check, "at": at}).drop_duplicates(["row", "fp", "check"])
                hit = pd.DataFrame({"row": row[mine], "fp": fp_[mine], "check": check_[mine], "n": n_[mine]}).merge(have, on=["row", "fp", "check"])
                out += [(int(r), k, words.text(a, k), int(n)) for r, a, n in zip(hit["row"], hit["at"], hit["n"])]
            r, k, phrase, n = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(r, pa.int64())), pa.array(k, pa.int32()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], ["lang", "k", "phrase", "n"])

    texts = docs.mapInArrow(near, docs.schema).groupBy("own", F.md5(F.col("text").cast("binary")).alias("_same"), "lang").agg(F.first("text").alias("text"))
    asked = wanted.groupBy("own").agg(F.collect_list("x").alias("asked"))  # as many as the document has words, times LONGEST, at most
    rows = texts.join(asked, "own").select("own", "lang", "text", "asked")
    return rows.mapInArrow(named, "lang string, k int, phrase string, n long").distinct()


def recounted(docs: DataFrame, collided: DataFrame, bits: int) -> DataFrame:
    """lang, k, phrase and n of the runs whose fingerprint collides with that of others, counted by their text."""
    maps = {k: bit_map(collided.where(F.col("k") == k), "fp") for k in range(1, LONGEST + 1)}
    shipped = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            words = Words(batch)
            for k, own in shipped.value.items():
                at, fp, _ = words.runs(k, bits)
                some = np.flatnonzero(admitted(fp, *own))
                n = len(some)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(words.row[at[some]])), pa.array(np.full(n, k, np.int32)), pa.array(fp[some].view(np.int64)),
                                                  pa.array([words.text(a, k) for a in at[some].tolist()], pa.string())], ["lang", "k", "fp", "phrase"])

    rows = docs.mapInArrow(run, "lang string, k int, fp long, phrase string").groupBy("lang", "k", "fp", "phrase").agg(F.count("*").alias("n"))
    return rows.join(collided.select("k", "fp"), ["k", "fp"], "left_semi").select("lang", "k", "phrase", "n")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n of all runs of 1 to ``longest`` words with n >= ``least``; lang, words of every language).

    ``bits``: of the fingerprints; fewer only make collisions, which are resolved.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(lang.alias("lang"), text.alias("text")).withColumn("own", F.xxhash64("lang", "text"))
    levels, before = [], None
    for k in range(1, longest + 1):
        level = stage(counted(docs, k, before, bits).where(F.col("n") >= least).withColumn("k", F.lit(k)), f"phrases-{k}")
        levels.append(level)
        if k < longest:
            before = bit_map(level, "fp")
    frequent = reduce(DataFrame.union, levels)
    out = found(docs, frequent, bits)
    collided = frequent.where("low <> high")
    if not collided.isEmpty():
        out = out.union(recounted(docs, collided, bits).where(F.col("n") >= least))
    out = stage(out, "phrases-found")
    for level in levels:
        drop_stage(level)
    return out, totals(docs)


def totals(docs: DataFrame) -> DataFrame:
    """lang, words: the number of all words of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            n = np.bincount(cut(batch)[2], minlength=batch.num_rows)
            t = pa.table({"lang": batch.column("lang"), "words": pa.array(n, pa.int64())}).group_by("lang").aggregate([("words", "sum")])
            yield from t.rename_columns(["lang", "words"]).to_batches()

    return docs.select("lang", "text", "own").mapInArrow(run, "lang string, words long").groupBy("lang").agg(F.sum("words").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, report: int = REPORT, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``report`` phrases of ``docs`` (text, lang)."""
    frequent, words = frequent_phrases(docs, least, longest, bits)
    held = F.split("phrase", " ")
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    candidates = frequent.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), held.alias("w"))
    known = frequent.select("lang", F.col("phrase").alias("p"), "n")
    cuts = candidates.select("lang", "k", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("p").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("p").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    # the words of shorter runs inside each candidate
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = candidates.where("k > 2").select("lang", "k", "w", "a", F.explode(sizes).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    longer = inner.select("lang", part(F.col("first"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    dropped = F.expr("100 * cast(longer as decimal(20,0)) >= 80 * cast(a as decimal(20,0))")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(dropped, F.lit(False)))
    order = W.partitionBy("lang").orderBy(F.col("x.score").desc(), F.col("a").desc(), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= report)
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
