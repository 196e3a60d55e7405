"""SentencePiece ids of whole texts through a table of distinct chunks, and texts from ids.

No piece of the vocabulary holds the white space marker behind any other character (checked when a model is opened), so no
merge crosses the start of a marked word: a run of markers with what follows up to the next run. The ids of a text are the ids
of its marked words, one after the other.

1. Tasks cut texts into marked words and count them; a shuffle adds the counts of each distinct word up.
2. The ``resident`` most frequent words, chosen by a histogram of log counts, are segmented once each, on executors; the table
   of word and ids is broadcast, its size is bounded by that parameter and by ``LONGEST`` bytes a word.
3. Tasks look the words of a slice of texts up in the table, once per distinct word of the slice, and gather the ids by
   position. A word outside the table is segmented where it stands, once per slice, so texts never move.

Decoding gathers what each id stands for and joins it. Texts whose bytes are no valid UTF-8, or that hold the unknown id, go
to the library.

Defined results: null is the empty text, which has no ids but the end id; U+2581 in a text is a blank, as for the library.
Texts of any length are encoded whole, a slice of work holds at least one. Rows that repeat are encoded each; other columns are
kept. A null list of ids decodes to the empty text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tracewell.llm.common import sliced
from tracewell.llm.ngram_lm import most
from tracewell.session import stage

RESIDENT = 500_000
LONGEST = 256
HELD = 600_000
SLICE_CHARS = 3_000_000
SLICE_IDS = 1_500_000
MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Model:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = proto.ModelProto.FromString(f.read())
        rule, kind = spec.normalizer_spec, spec.pieces[0]
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not (rule.remove_extra_whitespaces or rule.precompiled_charsmap or spec.denormalizer_spec.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix)
        if not plain or any(p.type == kind.USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in spec.pieces):
            raise ValueError("marked words of this model do not stand alone")
        rule.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.end_id, self.unknown = self.whole.eos_id(), self.whole.unk_id()
        stands_for = []
        for i, p in enumerate(spec.pieces):
            if p.type == kind.BYTE:
                stands_for.append(bytes([int(p.piece[3:5], 16)]))
            else:
                stands_for.append(b"" if p.type == kind.CONTROL else p.piece.replace(MARK, " ").encode())
        self.stands_for = pa.array(stands_for, pa.large_binary())
        self.controls = np.array([p.type == kind.CONTROL for p in spec.pieces])

    def ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of each marked word as binary: little-endian unsigned 32-bit integers."""
        out = []
        for i in range(0, len(words), 20_000):
            for ids in self.bare.encode(words.slice(i, 20_000).cast(pa.large_string()).to_pylist(), num_threads=1):
                out.append(np.array(ids, "<u4").tobytes())
        return pa.array(out, pa.large_binary())


def marked_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(marked words of all texts, with blanks for markers; number of words before each text and after the last)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
    bounds = offsets - lo
    blank = data == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(begins)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
    return words.dictionary_encode(), np.searchsorted(at, bounds)


def counted(docs: DataFrame) -> DataFrame:
    """word, n: how often each distinct marked word of at most LONGEST bytes occurs in ``docs`` (text)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for batch in sliced(batches, "text", SLICE_CHARS):
            words, _ = marked_words(batch.column("text"))
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            new = pa.table({"word": words.dictionary, "n": pa.array(n, pa.int64())})
            new = new.filter(pc.less_equal(pc.binary_length(new["word"]), LONGEST)).cast(schema)
            held = pa.concat_tables([held, new]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            if len(held) > HELD:
                yield from held.to_batches(100_000)
                held = schema.empty_table()
        yield from held.to_batches(100_000)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def table_of_words(docs: DataFrame, path: str, resident: int = RESIDENT) -> DataFrame:
    """word, ids (binary): the ``resident`` most frequent marked words, each segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, model(path).ids_of(words).cast(pa.binary())], ["word", "ids"])

    words = stage(counted(docs), "piece-counts")
    return stage(most(words, "n", resident).select("word").mapInArrow(run, "word binary, ids binary"), "piece-words")


def encoded(docs: DataFrame, path: str | None = None, resident: int = RESIDENT, ids: str = "ids", end: bool = True) -> DataFrame:
    """``docs`` (text and other columns) with the ids of each text in the new column ``ids``, the end id last if ``end``."""
    path = path or default_path()
    rows = docs.withColumn("text", F.col("text").cast("string"))
    known = table_of_words(docs, path, resident).toArrow()  # at most ``resident`` words of LONGEST bytes
    known = known.combine_chunks()
    shipped = docs.sparkSession.sparkContext.broadcast((known["word"].cast(pa.large_binary()).combine_chunks(), known["ids"].cast(pa.large_binary()).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (table_words, table_ids) = model(path), shipped.value
        for batch in sliced(batches, "text", SLICE_CHARS):
            words, offsets = marked_words(batch.column("text"))
            distinct = words.dictionary
            place = pc.index_in(distinct, value_set=table_words)
            missing = place.is_null()
            here = own.ids_of(distinct.filter(missing))
            lost = missing.to_numpy(zero_copy_only=False)
            at = np.zeros(len(distinct), np.int64)
            at[~lost] = place.drop_null().to_numpy()
            at[lost] = len(table_ids) + np.arange(lost.sum())
            # ids of the distinct words of the slice, then of every word by its position
            of_word = pa.chunked_array([table_ids, here]).take(pa.array(at)).combine_chunks()
            flat = of_word.take(pa.array(words.indices)) if len(words) else of_word
            flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
            ends = np.frombuffer(flat.buffers()[1], np.int64)[:len(flat) + 1] // 4 if len(flat) else np.zeros(1, np.int64)
            values = np.frombuffer(flat.buffers()[2], "<u4", count=int(ends[-1])) if ends[-1] else np.empty(0, np.uint32)
            cuts = ends[offsets]
            if end:
                more = np.arange(batch.num_rows + 1)
                closed = np.full(len(values) + batch.num_rows, own.end_id, np.int32)
                keep = np.ones(len(closed), bool)
                keep[cuts[1:] + more[:-1]] = False
                closed[keep] = values
                values, cuts = closed, cuts + more
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids])

    return rows.mapInArrow(run, rows.drop(ids).schema.add(ids, ArrayType(IntegerType())))


def by_size(batches: Iterator[pa.RecordBatch], column: str, most_ids: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the lists of a slice hold about ``most_ids`` values; one longer list is a slice of its own."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_pylist()):
            if held and held + n > most_ids:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(own: Model, lists: pa.ListArray) -> pa.Array:
    """The text of every list of ids."""
    lists = pc.if_else(lists.is_null(), pa.scalar([], lists.type), lists) if lists.null_count else lists
    values, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
    cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    bytes_ = own.stands_for.take(pa.array(values))
    bytes_ = bytes_.combine_chunks() if isinstance(bytes_, pa.ChunkedArray) else bytes_
    ends = np.frombuffer(bytes_.buffers()[1], np.int64)[:len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = memoryview(bytes_.buffers()[2] or b"")
    # the marker that every text is given in front goes again: that of the first id that is no control
    plain = np.flatnonzero(~own.controls[values])
    first = plain[np.searchsorted(plain, cuts[:-1]).clip(max=max(len(plain) - 1, 0))] if len(plain) else cuts[:-1]
    strange = np.concatenate(([0], np.cumsum(values == own.unknown)))
    strange = strange[cuts[1:]] > strange[cuts[:-1]]
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        raw = data[ends[a]:ends[b]]
        if len(raw) and raw[0] == 32 and a <= first[i] < b:
            raw = raw[1:]
        try:
            if strange[i]:
                raise ValueError
            out.append(str(raw, "utf-8"))
        except ValueError:
            out.append(own.whole.decode(values[a:b].tolist()))
    return pa.array(out, pa.string())


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``rows`` with the text of the list in ``ids`` in the new column ``text``."""
    path = path or default_path()
    keep = [c for c in rows.columns if c != text and (keep_ids or c != ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, ids, SLICE_IDS):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts_of(model(path), batch.column(ids))], [*keep, text])

    return rows.mapInArrow(run, rows.select(*keep).schema.add(text, "string"))


def digests(docs: DataFrame, path: str | None = None, resident: int = RESIDENT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    rows = encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, resident).drop("text")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded(rows, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
