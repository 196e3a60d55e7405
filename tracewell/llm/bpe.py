"""Byte-level BPE ids of many texts at once, with the tokenizers library and a given vocabulary file.

A single blank between two characters that are not white space always starts a new pre-token, so the ids of a text are the
ids of its pieces cut there, one after the other. Pieces repeat far more often than texts do; each worker encodes a piece
once and gathers ids by piece. Texts with any other blank, or with the string of an added token (which the library gives
its own id), take the plain way, whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]"
#: a blank at an end or beside other white space, or the mark that cuts pieces
ODD = rf"^ | $|{_SPACE} | {_SPACE}|\x00"
#: pieces a worker remembers; a bound on memory only, a forgotten piece is encoded again
REMEMBERED = 1_500_000
JOINED = 2000
TOGETHER = 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, remembered)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ragged rows values[start : start + length], end to end."""
    total = int(lengths.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    shift = (starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))).astype(kind)
    places = np.repeat(shift, lengths)
    places += np.arange(total, dtype=kind)
    return values[places]


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = "|".join([ODD, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.opens = np.zeros(self.size, bool)  # ids of tokens that begin with the blank
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.values, self.starts, self.lengths = pa.array([], pa.large_string()), np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = []
        for i in range(0, len(texts), TOGETHER):  # an encoding holds far more than its ids
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[i:i + TOGETHER], add_special_tokens=False)]
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), np.array([len(x) for x in ids], np.int64)

    def learn(self, pieces: pa.Array) -> None:
        """Encode pieces that begin with a blank: many in one text, told apart by the tokens that open with it."""
        texts = pieces.to_pylist()
        ids, _ = self.plain(["".join(texts[i:i + JOINED]) for i in range(0, len(texts), JOINED)])
        starts = np.flatnonzero(self.opens[ids])
        assert len(starts) == len(texts)
        lengths = np.diff(np.append(starts, len(ids))).astype(np.int32)
        if len(self.known) > self.remembered:
            self.forget()
        self.starts = np.concatenate((self.starts, (starts + len(self.values)).astype(np.int32)))
        self.values, self.lengths = np.concatenate((self.values, ids)), np.concatenate((self.lengths, lengths))
        self.known = pa.concat_arrays([self.known, pieces])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each); null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        counts = np.zeros(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        parts = {}
        if odd.any():
            ids, n = self.plain(texts.filter(pa.array(odd)).to_pylist())
            counts[odd] = n
            parts[True] = ids
        if not odd.all():
            even = texts.filter(pa.array(~odd))
            cut = pc.split_pattern(pc.replace_substring(even, " ", "\x00 "), "\x00")
            pieces = cut.flatten().cast(pa.large_string()).dictionary_encode()
            del even
            at = np.asarray(cut.offsets)
            u = pieces.dictionary
            inner = pc.starts_with(u, " ").to_numpy(zero_copy_only=False)  # the others are first pieces
            start, length = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
            if inner.any():
                want = u.filter(pa.array(inner))
                place = pc.index_in(want, value_set=self.known)
                if place.null_count:
                    if len(self.known) + place.null_count > self.remembered:
                        self.forget()
                        self.learn(want)
                    else:
                        self.learn(want.filter(place.is_null()))
                    place = pc.index_in(want, value_set=self.known)
                place = place.to_numpy()
                start[inner], length[inner] = self.starts[place], self.lengths[place]
            ids, n = self.plain(u.filter(pa.array(~inner)).to_pylist())
            start[~inner] = len(self.values) + np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else 0
            length[~inner] = n
            code = pieces.indices.to_numpy()
            lengths = length[code]
            parts[False] = gather(np.concatenate((self.values, ids)), start[code], lengths)
            run = np.concatenate(([0], np.cumsum(lengths)))
            counts[~odd] = run[at[1:]] - run[at[:-1]]
        if len(parts) < 2:
            return next(iter(parts.values()), np.empty(0, np.uint32)), counts
        # weave both kinds back into the order of the texts
        base = np.where(odd, 0, len(parts[True]))
        begin = np.zeros(len(texts), np.int64)
        for kind in (True, False):
            begin[odd == kind] = np.cumsum(counts[odd == kind]) - counts[odd == kind]
        return gather(np.concatenate((parts[True], parts[False])), base + begin, counts), counts
