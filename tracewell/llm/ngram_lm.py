"""Language-model scores from a weighted backoff automaton, beside an add-one word model as the base.

The model predicts a text byte by byte: words in lower case (A-Z), each closed by a blank, then the end. Byte n-grams up to
``automaton.ORDER`` are counted over all training documents and smoothed by absolute discounting; counted contexts are the
states, and what discounting takes from them goes along failure arcs to the next shorter context. One pass from left to
right carries the state and adds up log-probabilities. As words hold no white space, the bytes and the token sequence (words,
then one end) determine each other, so the score is the log10 probability of the tokens.

A task needs its automaton whole, so it holds the ``states`` most frequent contexts, a bound on memory only: the bytes of a text
whose context is longer than the state they are read in meet the counts of the contexts between by a join, so every counted
context is used and scores do not depend on ``states``. Counting, ranking and the base cover all of the corpus and stay
distributed: word counts of any size are met by a shuffle, only the ``frequent`` commonest words travel as a table.

Defined results: null and empty texts have one token, the end. Texts of any length are read whole. Rows that repeat a doc_id
are documents of their own; a null doc_id belongs to training. Words and contexts with equal counts are kept or left out of
tables together. Without training
documents every count is 0 and the model is uniform over bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import automaton as A
from tracewell.llm.common import fold, sliced
from tracewell.session import stage

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
STATES = 80_000
FREQUENT = 200_000
SLICE_CHARS, SCORE_CHARS = 6_000_000, 2_000_000
#: distinct words or n-grams a task holds before it hands its counts on; they are added up again later
HELD = 1_000_000
END_WORD = "\n"
#: above the length of an n-gram (3 bits): the length of the state that its last byte was read in
_DEPTH = A._BITS + 3


def counts(docs: DataFrame) -> DataFrame:
    """(word, gram, n) over all rows of ``docs`` (text): either a word (END_WORD for the end of a text) or a byte n-gram with its
    longest context, and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        words, keys, n = none, np.empty(0, np.int64), np.empty(0, np.int64)

        def handed_on():
            for b in words.combine_chunks().to_batches(200_000):
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.nulls(b.num_rows, pa.int64()), b.column("n")], ["word", "gram", "n"])
            for i in range(0, len(keys), 200_000):
                part = keys[i:i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(part), pa.array(n[i:i + 200_000])], ["word", "gram", "n"])

        for batch in sliced(batches, "text", SLICE_CHARS):
            cut = A.words_of(batch.column("text"))
            new = cut.flatten().value_counts()
            ends = pa.table({"word": pa.array([END_WORD]), "n": pa.array([batch.num_rows])})
            words = pa.concat_tables([words, ends, pa.table({"word": new.field(0), "n": new.field(1)})]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            new_keys, new_n = A.counted(A.grams(A.stream(cut)[0]))
            keys, n = A.counted(np.concatenate((keys, new_keys)), np.concatenate((n, new_n)))
            if max(len(words), len(keys)) > HELD:
                yield from handed_on()
                words, keys, n = none, keys[:0], n[:0]
        yield from handed_on()

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, gram long, n long")
    return seen.where("word is null or word <> ''").groupBy("word", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    automaton: A.Automaton
    weights: np.ndarray
    frequent: pa.Array
    frequent_log: np.ndarray  # log10(c + 1) of the frequent words
    ends: int
    tokens: int
    kinds: int
    arcs: DataFrame  # k, gram, n, context of all n-grams; stays on the driver's side

    def __getstate__(self):
        return self.__dict__ | {"arcs": None}


def most(rows: DataFrame, count: str, at_most: int) -> DataFrame:
    """The rows with the largest counts, cut where a step of the logarithm of the count would bring more than ``at_most``.

    A histogram of a few hundred steps decides, so no task and no driver sorts rows; rows with equal counts stay or go together.
    """
    step = F.floor(F.log2(count) * 16)
    sizes = sorted(((r["step"], r["n"]) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, total = 1 << 40, 0
    for s, n in sizes:
        total += n
        if total > at_most:
            break
        lowest = s
    return rows.where(step >= lowest)


def fit(counted: DataFrame, states: int = STATES, frequent: int = FREQUENT) -> Model:
    """The automaton and the commonest words from the staged counts of the training documents."""
    words = counted.where("word is not null")
    tokens, kinds, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END_WORD, F.col("n"))), F.lit(0))).first()
    top = most(words.where(F.col("word") != END_WORD).select("word", "n"), "n", frequent).toArrow()
    # every n-gram counts for all its suffixes
    length = F.shiftright("gram", A._BITS).cast("int")
    arcs = (counted.where("gram is not null").select(F.explode(F.sequence(F.lit(1), length)).alias("k"), "gram", "n")
            .select("k", F.expr("gram & (shiftleft(cast(1 as bigint), 8 * k) - 1)").alias("gram"), "n")
            .groupBy("k", "gram").agg(F.sum("n").alias("n")))
    arcs = stage(arcs.withColumn("context", F.expr(f"shiftleft(cast(k - 1 as bigint), {A._BITS}) | shiftright(gram, 8)")), "lm-arcs")
    best = most(arcs.groupBy("context").agg(F.sum("n").alias("total")), "total", states).select("context")  # ``states`` rows at most
    # the two states that every automaton has come with their arcs
    best = best.union(best.sparkSession.range(1).select(F.explode(F.array(F.lit(0).cast("long"), F.lit((1 << A._BITS) | A.END).cast("long"))))).distinct()
    kept = arcs.join(F.broadcast(best), "context").select("k", "gram", "n").toArrow()  # at most 256 arcs a state
    k, gram, m = (kept[c].to_numpy() for c in ("k", "gram", "n"))
    own = {int(i): (gram[k == i], m[k == i]) for i in np.unique(k)}
    contexts = np.unique(((k.astype(np.int64) - 1) << A._BITS) | (gram >> 8)) if len(k) else np.empty(0, np.int64)
    a = A.Automaton(A.closed(contexts), np.unique(gram & 255).astype(np.uint8))
    weights = A.discounted(a, own, DISCOUNT).reshape(-1) if own else np.full(a.next.size, np.log10(1 / 256), np.float32)
    return Model(a, weights, pc.cast(top["word"], pa.string()).combine_chunks(), np.log10(top["n"].to_numpy() + 1.0), int(ends), int(tokens), int(kinds), arcs)


def corrections(asked: DataFrame, arcs: DataFrame) -> DataFrame:
    """gram, more: what the log10 p of a byte changes by the contexts longer than the state it was read in.

    asked: distinct gram (with the length of that state from bit _DEPTH on) and own, the log10 p in that state.
    """
    contexts = (arcs.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"),
                                            F.map_from_entries(F.collect_list(F.struct((F.col("gram") % 256).cast("int"), "n"))).alias("after")))
    body = F.expr(f"gram & {(1 << A._BITS) - 1}")
    depth = F.shiftright("gram", _DEPTH).cast("int")
    length = (F.shiftright("gram", A._BITS) % 8).cast("int")
    levels = asked.select("gram", "own", body.alias("body"), F.explode(F.sequence(depth + 1, length - 1)).alias("j"))
    levels = levels.withColumn("context", F.expr(f"shiftleft(cast(j as bigint), {A._BITS}) | ((body >> 8) & (shiftleft(cast(1 as bigint), 8 * j) - 1))"))
    n = F.element_at("after", (F.col("body") % 256).cast("int"))
    met = levels.join(contexts, "context").select(
        "gram", "own", "j", F.coalesce((n - DISCOUNT) / F.col("total"), F.lit(0.0)).alias("share"), (F.col("kinds") * DISCOUNT / F.col("total")).alias("left"))
    steps = met.groupBy("gram").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct("j", "share", "left"))).alias("steps"))
    p = F.aggregate("steps", F.pow(F.lit(10.0), F.col("own")), lambda p, s: s["share"] + s["left"] * p)
    return steps.select("gram", (F.log10(p) - F.col("own")).alias("more"))


def score(docs: DataFrame, counted: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "gram", "own", "rows"]
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word string, gram long, own double, rows array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shipped.value
        depth = (m.automaton.contexts >> A._BITS).astype(np.int8)
        uid = base = TaskContext.get().partitionId() << 33
        held = []

        def handed_on():
            """A row for each n-gram: the rows after ``base`` that ask for it, as often as they do."""
            gram, own, row = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(gram, kind="stable")
            gram = gram[order]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            gram, own, row, stop = gram[first], own[order[first]].astype(np.float64), row[order], np.append(first, len(row))
            for i in range(0, len(gram), 100_000):
                n = len(gram[i:i + 100_000])
                at = stop[i:i + n + 1]
                own_rows = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(row[at[0]:at[-1]]))
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base)), none, none.cast(pa.bool_()), none, none, none.cast(pa.float64()), none.cast(pa.float64()), none.cast(pa.string()),
                                                  pa.array(gram[i:i + n]), pa.array(own[i:i + n]), own_rows], names)

        for batch in sliced(batches, "text", SCORE_CHARS):
            cut = A.words_of(batch.column("text"))
            raw, end = A.stream(cut)
            rows = batch.num_rows
            places = m.automaton.lanes(raw)
            logs = np.concatenate(([0.0], np.cumsum(m.weights[places], dtype=np.float64)))[np.concatenate(([0], end))]
            # bytes with a longer context than their state
            gram, state = A.grams(raw), depth[places // np.int32(m.automaton.width)]
            beyond = np.flatnonzero(state < (gram >> A._BITS) - 1)
            if len(beyond):
                row = (uid - base + np.searchsorted(end, beyond, side="right")).astype(np.int32)
                held.append((gram[beyond] | (state[beyond].astype(np.int64) << _DEPTH), m.weights[places[beyond]], row))
            del raw, places, gram, state, beyond
            offsets = np.asarray(cut.offsets).astype(np.int64)
            offsets -= offsets[0]
            code = cut.flatten().dictionary_encode()
            named, code = code.dictionary, code.indices.to_numpy()
            place = pc.index_in(named, value_set=m.frequent)
            common = place.is_valid().to_numpy(zero_copy_only=False)
            log_of = np.zeros(len(named))
            log_of[common] = m.frequent_log[place.drop_null().to_numpy()]
            real = pc.not_equal(named, "").to_numpy(zero_copy_only=False)  # a text without words holds the empty one

            def per(x):
                x = np.concatenate((x[:0], [0], np.cumsum(x[code])))
                return x[offsets[1:]] - x[offsets[:-1]]

            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + np.arange(rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(per(real.astype(np.int64)) + 1), pa.array(per(common.astype(np.int64)) + (m.ends > 0)),
                 pa.array(per(log_of) + np.log10(m.ends + 1)), pa.array(np.diff(logs)), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.list_(pa.int32()))], names)
            # words outside the table meet their counts by a join
            rare = ~(common | ~real)[code]
            pair, times = A.counted(np.repeat(np.arange(rows), np.diff(offsets))[rare] * len(named) + code[rare])
            if len(pair):
                none = pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(uid + pair // len(named)), none, none.cast(pa.bool_()), pa.array(times), none, none.cast(pa.float64()), none.cast(pa.float64()), named.take(pa.array(pair % len(named))), none, none.cast(pa.float64()), pa.nulls(len(pair), pa.list_(pa.int32()))], names)
            uid += rows
            if sum(len(x[0]) for x in held) > HELD:
                yield from handed_on()
                held, base = [], uid
        if held:
            yield from handed_on()

    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out").mapInArrow(run, schema), "lm-scores")
    rare = (rows.where("word is not null").select("uid", "word", F.col("n_tokens").alias("times"))
            .join(counted.where("word is not null").select("word", "n"), "word")
            .groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more")))
    asked = rows.where("gram is not null").select("uid", "gram", "own", "rows")
    more = corrections(asked.groupBy("gram").agg(F.first("own").alias("own")), model.arcs)
    # rows that were read together are added up together, so little more than one sum a row moves
    beyond = (asked.drop("own").join(more, "gram").select("uid", "rows", "more").repartition("uid")
              .select("uid", "more", F.explode("rows").alias("row")).groupBy((F.col("uid") + F.col("row")).alias("uid")).agg(F.sum("more").alias("further")))
    norm = float(np.log10(model.tokens + model.kinds + 1.0))
    return (rows.where("word is null and gram is null").drop("word").join(rare, "uid", "left").join(beyond, "uid", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
                    (F.col("score") + F.coalesce("further", F.lit(0.0))).alias("score")))


def language_model(docs: DataFrame, states: int = STATES, frequent: int = FREQUENT) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) under models of those outside the held-out fold."""
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    counted = stage(counts(rows.where(~F.col("held_out"))), "lm-counts")
    return score(rows, counted, fit(counted, states, frequent))
