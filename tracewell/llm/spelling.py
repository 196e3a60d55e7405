"""Spelling variants: which words of a vocabulary differ by one letter, and which frequent word each of them stands for.

A word's letters are a multiset, a binary vector with one dimension for the k-th copy of each letter. One inserted, deleted or
replaced letter changes at most two dimensions, so PartEnum signatures for Hamming distance 2 find every pair: the dimensions
are dealt into PARTS parts by a hash, and a word has a signature for each choice of PARTS - 2 of them, the hash of what it holds
there. At least one signature of two near words is equal. Beside it stands an end of the word: the edit leaves the first or the
last ``min_length // 2`` letters alone, so every signature is given twice, once with each end, which divides its group by the
number of ends. Words with equal (signature, end) meet in an equi-join, lengths and the edit distance are checked there, and
only verified pairs leave it. Hot groups are split by AQE's skew handling; no group is collected.

Roots follow the forms by pointer doubling: counts grow at least ``ratio`` times a step, so few rounds suffice.

Defined results: null and empty texts have no words; a null doc_id is the empty string in the hash that plants deletions; rows
that repeat count each. Ties of n go to the word that is smaller by code point. Words of any length take part. A table without
words gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.set_join import mix
from tracewell.session import drop_stage, stage

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = 5
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: a letter is left out of one run in so many
PLANTED = 199


def vocabulary(docs: DataFrame, planted: int | None = PLANTED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of ``docs`` (doc_id, text), one letter of every ``planted``-th run (by a hash) left out."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    word = F.col("run")
    if planted:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        cut = (h % F.char_length("run")).cast("int")
        word = F.when(h % planted == 0, F.concat(F.expr("left(run, cut)"), F.expr("substring(run, cut + 2)"))).otherwise(word)
        rows = rows.withColumn("cut", cut)
    words = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def signatures(words: list[str], parts: int = PARTS) -> np.ndarray:
    """One row per word: its C(parts, 2) signatures, 64-bit hashes."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, owner))
    letters = letters[order]
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(letters))
    copy = place - np.maximum.accumulate(np.where(new, place, 0))
    with np.errstate(over="ignore"):
        dimension = mix((letters << np.uint64(32)) + copy.astype(np.uint64) + np.uint64(1))
        held = np.zeros((len(words), parts), np.uint64)
        np.add.at(held, (owner, (mix(dimension) % np.uint64(parts)).astype(np.int64)), dimension)
        whole = held.sum(1, dtype=np.uint64)
        out = [mix(whole - held[:, i] - held[:, j] + np.uint64(1 + i * parts + j)) for i, j in itertools.combinations(range(parts), 2)]
    return np.stack(out, 1)


def signed(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, n, signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = signatures(batch.column("word").to_pylist(), parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), lists], ["word", "n", "signatures"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, signatures array<long>")


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH, parts: int = PARTS) -> DataFrame:
    """word, n, other, other_n: both directions of every pair of ``words`` (word, n; distinct) that one edit tells apart."""
    end = min_length // 2
    ends = F.array(F.concat(F.lit("<"), F.left("word", F.lit(end))), F.concat(F.lit(">"), F.right("word", F.lit(end))))
    rows = signed(words, parts).select("word", "n", F.explode("signatures").alias("signature"), ends.alias("ends"))
    rows = rows.select("word", "n", "signature", F.explode("ends").alias("end")).select("word", "n", F.xxhash64("signature", "end").alias("key"), F.char_length("word").alias("length"))
    a, b = rows.alias("a"), rows.alias("b")
    near = (F.abs(F.col("a.length") - F.col("b.length")) <= 1) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    # merged at any size: each side holds 2 x C(parts, 2) rows a word, which size estimates do not see behind the explodes
    pairs = (a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & near)
             .select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct())
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that the forms (word, form) lead to."""
    step = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_stage(step)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        step = new


def variants(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct, of ``min_length`` letters at least)."""
    words = stage(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, min_length, parts)
    best = F.min(F.when(F.col("other_n") >= ratio * F.col("n"), F.struct((-F.col("other_n")).alias("minus"), "other")))
    near = stage(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.minus")).alias("form_n")), "spelling-near")
    last = roots(near.where("form is not null"))
    return (words.join(near, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
