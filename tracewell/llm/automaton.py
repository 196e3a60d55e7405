"""Byte n-gram automata: counted contexts become states, unseen continuations follow failure arcs to shorter contexts.

A text is a stream of bytes: its words in lower case (A-Z), each closed by a blank, then the end mark ``\\n``, which no word
can hold. Contexts are up to ORDER - 1 bytes and start anew after the end mark. States are closed under taking a prefix or a
suffix, so the state after a byte is fixed by the last ORDER - 1 bytes alone; long streams are therefore read in lanes side by
side, each warmed up on the bytes before it, with the same result as one pass from left to right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ORDER = 6
END = 0x0A
LANE = 512
_BITS = 8 * ORDER


def words_of(texts: pa.Array) -> pa.ListArray:
    """Words in lower case (A-Z); a text without words holds the empty word alone."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))))


def stream(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with blanks and end marks, end of each text)."""
    joined = pc.binary_join(words, " ")
    joined = pc.if_else(pc.equal(joined, ""), "\n", pc.binary_join_element_wise(joined, " \n", ""))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64 if pa.types.is_large_string(joined.type) else np.int32)[joined.offset:joined.offset + len(joined) + 1].astype(np.int64)
    data = joined.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def grams(raw: np.ndarray) -> np.ndarray:
    """One key per byte: the byte and its context (up to ORDER - 1 bytes, back to the last end mark), with the length on top."""
    padded = np.concatenate((np.array([END], np.uint8), raw))
    place = np.arange(len(padded), dtype=np.int32)
    last_end = np.maximum.accumulate(np.where(padded == END, place, 0))[:-1]
    order = np.minimum(place[1:] - last_end, ORDER - 1) + 1
    key = np.zeros(len(raw), np.int64)
    wide = np.concatenate((np.zeros(ORDER - 2, np.uint8), padded))
    for i in range(ORDER):
        key = (key << 8) | wide[i:i + len(raw)]
    mask = (np.int64(1) << (8 * np.arange(ORDER + 1, dtype=np.int64))) - 1
    return (key & mask[order]) | (order.astype(np.int64) << _BITS)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their numbers (or summed weights)."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    at = np.argsort(keys, kind="stable")
    keys, weights = keys[at], weights[at]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def closed(contexts: np.ndarray) -> np.ndarray:
    """The contexts whose prefixes and suffixes are all there."""
    while True:
        length, body = contexts >> _BITS, contexts & ((np.int64(1) << _BITS) - 1)
        shorter = np.maximum(length - 1, 0)
        prefix = (shorter << _BITS) | (body >> 8)
        suffix = (shorter << _BITS) | (body & ((np.int64(1) << (8 * shorter)) - 1))
        fine = (length == 0) | (np.isin(prefix, contexts) & np.isin(suffix, contexts)) | (length == 1)
        if fine.all():
            return contexts
        contexts = contexts[fine]


class Automaton:
    """States and one or more probability tables over them.

    ``contexts``: keys (length << 48 | bytes) of the states, closed under prefix and suffix, the empty one included.
    ``models``: per model, arrays (context key, byte, discounted share) and per state the share left to the failure arc.
    """

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray):
        self.contexts = np.unique(np.append(contexts, [0, (1 << _BITS) | END]))  # by length, then bytes
        size = len(self.contexts)
        self.classes = np.full(256, len(symbols), np.uint8)  # all bytes that no arc names behave alike
        self.classes[symbols] = np.arange(len(symbols))
        self.width = len(symbols) + 1
        length = self.contexts >> _BITS
        body = self.contexts & ((np.int64(1) << _BITS) - 1)
        self.level = [np.flatnonzero(length == k) for k in range(ORDER)]
        self.fail = np.zeros(size, np.int64)
        self.next = np.zeros((size, self.width), np.int32)
        for k, own in enumerate(self.level):
            if k:
                self.fail[own] = self.state_of(((k - 1) << _BITS) | (body[own] & ((1 << 8 * (k - 1)) - 1)))
                self.next[own] = self.next[self.fail[own]]
            if k + 1 < ORDER:
                child = self.level[k + 1]
                parent = self.state_of((k << _BITS) | (body[child] >> 8))
                self.next[parent, self.classes[body[child] & 255]] = child
        end = self.state_of(np.array([(1 << _BITS) | END]))[0]
        if self.classes[END] < len(symbols):
            self.next[:, self.classes[END]] = end
        self.start = int(end)

    def state_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.contexts, keys)
        assert (self.contexts[np.minimum(at, len(self.contexts) - 1)] == keys).all(), "states are not closed"
        return at

    def table(self, context: np.ndarray, byte: np.ndarray, share: np.ndarray, left: np.ndarray, floor: np.ndarray | float) -> np.ndarray:
        """log10 p for every state and class: share + left * p(shorter context); below the empty context lies ``floor``."""
        p = np.zeros((len(self.contexts), self.width), np.float64)
        state, cls = self.state_of(context), self.classes[byte]
        order = np.argsort(state, kind="stable")
        state, cls, share = state[order], cls[order], share[order]
        for k, own in enumerate(self.level):
            if not len(own):
                continue
            p[own] = left[own, None] * (p[self.fail[own]] if k else floor)
            a, b = np.searchsorted(state, [own[0], own[-1] + 1])
            p[state[a:b], cls[a:b]] += share[a:b]
        return np.log10(p).astype(np.float32)

    def lanes(self, raw: np.ndarray) -> np.ndarray:
        """Place in a table (state * width + class) for every byte of a stream of whole texts."""
        n = len(raw)
        lanes = -(-n // LANE)
        cls = np.full(lanes * LANE, self.classes[END], np.uint8)
        cls[:n] = self.classes[raw]
        grid = np.ascontiguousarray(cls.reshape(lanes, LANE).T)
        warm = np.full((ORDER - 1, lanes), self.classes[END], np.uint8)
        warm[:, 1:] = grid[LANE - ORDER + 1:, :-1]
        flat = self.next.reshape(-1)
        state = np.full(lanes, self.start, np.int32)
        for row in warm:
            state = flat[state * np.int32(self.width) + row]
        places = np.empty((LANE, lanes), np.int32)
        for j in range(LANE):
            at = state * np.int32(self.width) + grid[j]
            places[j] = at
            state = flat[at]
        return np.ascontiguousarray(places.T).reshape(-1)[:n]


def marginals(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of byte n-grams of every length, from those counted with their longest context."""
    length, body = keys >> _BITS, keys & ((np.int64(1) << _BITS) - 1)
    out = {ORDER: (body[length == ORDER], counts[length == ORDER])}
    for k in range(ORDER - 1, 0, -1):
        longer, n = out[k + 1]
        out[k] = counted(np.concatenate((longer & ((1 << 8 * k) - 1), body[length == k])), np.concatenate((n, counts[length == k])))
    return out


def discounted(a: Automaton, by_length: dict[int, tuple[np.ndarray, np.ndarray]], discount: float | dict[int, float]) -> np.ndarray:
    """The table of absolute discounting over the states of ``a``: what is taken from seen bytes goes to the failure arc."""
    by = discount if isinstance(discount, dict) else dict.fromkeys(by_length, discount)
    context, byte, share, left = [], [], [], np.ones(len(a.contexts))
    for k, (gram, n) in by_length.items():
        c = ((k - 1) << _BITS) | (gram >> 8)
        known = np.isin(c, a.contexts)
        gram, n, c = gram[known], n[known], c[known]
        state = a.state_of(c)
        total, kinds = np.bincount(state, n, len(a.contexts)), np.bincount(state, minlength=len(a.contexts))
        seen = kinds > 0
        left[seen] = by[k] * kinds[seen] / total[seen]
        context.append(c), byte.append(gram & 255), share.append((n - by[k]) / total[state])
    return a.table(np.concatenate(context), np.concatenate(byte), np.concatenate(share), left, 1 / 256)


def continuations(*by_length: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Kneser-Ney counts of n-grams below the highest order: the number of different bytes seen to their left, over all given counts.

    An n-gram that begins with the end mark has nothing to its left and keeps its own count."""
    out = {ORDER: counted(np.concatenate([c[ORDER][0] for c in by_length]), np.concatenate([c[ORDER][1] for c in by_length]))}
    for k in range(1, ORDER):
        longer = np.unique(np.concatenate([c[k + 1][0] for c in by_length]))
        bare = [(g, n) for g, n in (c[k] for c in by_length)]
        own, n = counted(np.concatenate([g for g, _ in bare]), np.concatenate([n for _, n in bare]))
        first = (own >> 8 * (k - 1) == END) & (k > 1)
        out[k] = counted(np.concatenate((longer & ((1 << 8 * k) - 1), own[first])), np.concatenate((np.ones(len(longer), np.int64), n[first])))
    return out


def discounts(by_length: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, float]:
    """What Kneser-Ney takes from each count of a length: n1 / (n1 + 2 n2), from the n-grams counted once and twice."""
    out = {}
    for k, (_, n) in by_length.items():
        once, twice = int((n == 1).sum()), int((n == 2).sum())
        out[k] = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
    return out
