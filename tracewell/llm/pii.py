"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF that adds what the patterns miss.

The patterns are rigid: a match that fails its check is dropped with all that it swallowed, and a phone number needs its plus sign.
The network tags characters (begin / inside of email, ip, card, phone; outside). It is trained in numpy on labelled spans: the
patterns' own in a bounded sample of documents, and copies of them with changed separators. Texts are read in windows that overlap by
half; a character takes the tag of the window in which it is most central, and the tags of the whole text are then decoded into
spans. A span of any kind holds a digit or an at sign, so windows with neither are outside altogether. A span of the network is kept if
it overlaps no pattern's span and passes its kind's check on digits (length, Luhn, parts up to 255).

Defined results: a null text is the empty text. Texts of any length are read whole, and every pattern needs time in proportion
to the text. Rows that repeat a doc_id are read row by row. Of overlapping spans of the network the first stays. Without any
labelled span to learn from the network adds nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import give_back, sliced

# fixed values: the kinds in order and what their base matches look like
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

WINDOW, STEP = 64, 32
TAGS = 2 * len(KINDS) + 1  # outside, then begin and inside of each kind
SYMBOLS = 100  # 95 printable characters, then line break, other letter, other digit, other space, anything else
SLICE_CHARS = 2_000_000
BATCH = 1024


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plausible(kind: str, span: str) -> bool:
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        return "@" in span and "." in span
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign: the run of name characters before it, back to the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if plausible(kind, m[0])]
    return out


_ASCII = np.full(128, 99, np.uint8)
_ASCII[32:127] = np.arange(95)
_ASCII[[10, 13]] = 95
_ASCII[[9, 11, 12]] = 98


def symbols(text: str) -> np.ndarray:
    """The network's input, one symbol per code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(code, 127)]
    for i in np.flatnonzero(code > 127):
        c = text[i]
        out[i] = 96 if c.isalpha() else 97 if c.isdigit() else 98 if c.isspace() else 99
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    hits = {m.start() // STEP for m in TRIGGER.finditer(text)}
    return sorted({max(h - i, 0) * STEP for h in hits for i in (0, 1)})


@dataclass
class Network:
    """Embedding, a forward and a backward LSTM, a linear layer to tag scores, and CRF transitions."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    hidden: int = 16

    @staticmethod
    def new(seed: int = 7, embedded: int = 12, hidden: int = 16) -> Network:
        r = np.random.default_rng(seed)
        p = {"e": r.normal(0, 0.3, (SYMBOLS, embedded)), "o": r.normal(0, 0.2, (2 * hidden, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        # both directions side by side: forward first
        p["w"] = r.normal(0, (embedded + hidden) ** -0.5, (2, embedded + hidden, 4 * hidden))
        p["b"] = np.zeros((2, 1, 4 * hidden))
        p["b"][:, :, hidden:2 * hidden] = 1  # remember at first
        return Network({k: v.astype(np.float32) for k, v in p.items()}, hidden)

    def read(self, e: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States over embedded windows (time x batch x embedded): forward and backward, time x 2 x batch x hidden."""
        n, wide, w = self.hidden, e.shape[2], self.p["w"]
        given = np.matmul(np.stack((e, e[::-1]), 1), w[:, :wide]) + self.p["b"]
        h = np.zeros((2, e.shape[1], n), e.dtype)
        c = np.zeros_like(h)
        out = np.empty((len(e), *h.shape), e.dtype)
        for t in range(len(e)):
            z = given[t] + np.matmul(h, w[:, wide:])
            gate = 1 / (1 + np.exp(-z[..., :3 * n]))
            i, f, o = gate[..., :n], gate[..., n:2 * n], gate[..., 2 * n:]
            g = np.tanh(z[..., 3 * n:])
            old_c, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            out[t] = h = o * tc
            if tape is not None:
                tape.append((i, f, o, g, old_c, old_h, tc))
        return out

    @staticmethod
    def joined(states: np.ndarray) -> np.ndarray:
        return np.concatenate((states[:, 0], states[::-1, 1]), 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.joined(self.read(self.p["e"][x.T])) @ self.p["o"] + self.p["ob"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (batch x time)."""
        score, trans = self.scores(x), self.p["t"]
        best = score[0] + self.p["s"]
        back = np.empty((len(score), len(x), TAGS), np.int8)
        for t in range(1, len(score)):
            via = best[:, :, None] + trans
            back[t] = via.argmax(1)
            best = via.max(1) + score[t]
        tags = np.empty((len(x), len(score)), np.int8)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(x))
        for t in range(len(score) - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        return tags

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences and its gradient."""
        p, size, grad, tape = self.p, len(x), {}, []
        e = p["e"][x.T]
        both = self.joined(self.read(e, tape))
        score = both @ p["o"] + p["ob"]
        steps, rows, way = len(score), np.arange(size), np.exp(p["t"])
        # the CRF's forward and backward sums, scaled to 1 at each step
        top = score.max(2, keepdims=True)
        now = np.exp(score - top)
        alpha, beta, scale = np.empty_like(now), np.ones_like(now), np.empty((steps, size, 1), now.dtype)
        for t in range(steps):
            alpha[t] = now[t] * (alpha[t - 1] @ way if t else np.exp(p["s"]))
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (now[t + 1] * beta[t + 1]) @ way.T / scale[t + 1]
        log_z = (np.log(scale) + top).sum((0, 2))
        y = y.T
        gold = np.take_along_axis(score, y[:, :, None], 2).sum((0, 2)) + p["s"][y[0]] + p["t"][y[:-1], y[1:]].sum(0)
        # expected minus observed
        d_score = alpha * beta
        d_score[np.arange(steps)[:, None], rows, y] -= 1
        grad["t"] = np.einsum("tbi,tbj->ij", alpha[:-1], now[1:] * beta[1:] / scale[1:], optimize=True) * way
        np.add.at(grad["t"], (y[:-1], y[1:]), -1)
        grad["s"] = d_score[0].sum(0)
        grad["ob"] = d_score.sum((0, 1))
        grad["o"] = both.reshape(-1, both.shape[2]).T @ d_score.reshape(-1, TAGS)
        d_both = d_score @ p["o"].T
        n, wide, w = self.hidden, e.shape[2], p["w"]
        d_out = np.stack((d_both[:, :, :n], d_both[::-1, :, n:]), 1)
        d_z = np.empty((steps, 2, size, 4 * n), e.dtype)
        d_h, d_c, back = np.zeros((2, size, n), e.dtype), np.zeros((2, size, n), e.dtype), np.swapaxes(w[:, wide:], 1, 2)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, old_c, _, tc = tape[t]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z[t] = np.concatenate((d_c * g * i * (1 - i), d_c * old_c * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)), 2)
            d_h, d_c = np.matmul(d_z[t], back), d_c * f
        given = np.concatenate((np.stack((e, e[::-1]), 1), np.stack([x[5] for x in tape])), 3)
        grad["w"] = np.stack([given[:, k].reshape(-1, given.shape[3]).T @ d_z[:, k].reshape(-1, 4 * n) for k in (0, 1)])
        grad["b"] = d_z.sum((0, 2))[:, None]
        d_e = np.matmul(d_z, np.swapaxes(w[:, :wide], 1, 2))
        d_e = d_e[:, 0] + d_e[::-1, 1]
        grad["e"] = np.zeros_like(p["e"])
        np.add.at(grad["e"], x.T, d_e)
        return float((log_z - gold).mean()), {k: v / size for k, v in grad.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random batches with a falling rate; returns the mean loss of the last tenth."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            loss, grad = self.gradient(x[pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - (step - 1) / steps) * min(1.0, 5 / max(norm, 1e-9))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
        return float(np.mean(losses[-max(1, steps // 10):]))


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 * k + 2
        out[a:a + 1] = 2 * k + 1
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one kind; a begin tag inside a run starts another."""
    kind = (tags.astype(int) + 1) // 2
    first = (kind > 0) & ((np.concatenate(([0], kind[:-1])) != kind) | (tags % 2 == 1))
    out = []
    for a in np.flatnonzero(first):
        b = a + 1
        while b < len(tags) and kind[b] == kind[a] and not first[b]:
            b += 1
        out.append((KINDS[kind[a] - 1], int(a), int(b)))
    return out


def padded(text: str, start: int) -> np.ndarray:
    x = symbols(text[start:start + WINDOW])
    return np.concatenate((x, np.full(WINDOW - len(x), 95, np.uint8)))


def found(network: Network | None, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    bases = [base_spans(t) for t in texts]
    if network is None:
        return [(b, []) for b in bases]
    places = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    votes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for at in range(0, len(places), BATCH):
        part = places[at:at + BATCH]
        tags = network.decode(np.stack([padded(texts[i], s) for i, s in part]))
        for (i, s), row in zip(part, tags):
            votes.setdefault(i, []).append((s, row))
    out = []
    for i, text in enumerate(texts):
        added = []
        if i in votes:
            # one tag per character: that of the window in which it stands farthest from an edge; unread windows are outside
            seen = dict(votes[i])
            lo, hi = max(0, min(seen)), min(len(text), max(seen) + WINDOW)
            tags = np.zeros(hi - lo, np.int8)
            depth = np.full(hi - lo, -1)
            central = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
            for s, row in sorted(seen.items()):
                a, b = s - lo, min(s + WINDOW, len(text)) - lo
                better = central[:b - a] > depth[a:b]
                tags[a:b][better] = row[:b - a][better]
                depth[a:b][better] = central[:b - a][better]
            taken = sorted((a, b) for _, a, b in bases[i])
            for kind, a, b in spans_of(tags):
                a, b = a + lo, b + lo
                if all(b <= x or a >= y for x, y in taken) and TRIGGER.search(text, a, b) and plausible(kind, text[a:b]):
                    added.append((kind, a, b))
        out.append((bases[i], added))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def varied(text: str, span: tuple[str, int, int], r: np.random.Generator) -> tuple[str, tuple[str, int, int]] | None:
    """The text with a span's separators changed, as people write them: what the patterns do not know."""
    kind, a, b = span
    own = text[a:b]
    if kind == "phone":
        new = own.lstrip("+") if r.random() < 0.5 else re.sub(r"[ ().-]+", lambda _: "-" if r.random() < 0.5 else "/", own.lstrip("+"))
    elif kind == "card":
        digits = re.sub(r"[^0-9]", "", own)
        new = str(r.choice([".", "/", "_"])).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    else:
        return None
    return text[:a] + new + text[b:], (kind, a, a + len(new))


def fit(docs: DataFrame, sample_docs: int = 3000, per_kind: int = 500, steps: int = 500) -> Network | None:
    """Train on windows of the first ``sample_docs`` documents, in the order of a hash of the id, that hold a digit or an at sign:
    at most ``per_kind`` windows per kind, and as many without any span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, x, y = [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                r = np.random.default_rng(len(text))
                tags = tags_of(len(text), spans)
                for s in windows(text):
                    inside = [k for k, a, b in spans if s <= a and b <= s + WINDOW]
                    if inside or not tags[s:s + WINDOW].any():
                        kinds.append(inside[0] if inside else "none")
                        x.append(padded(text, s).tobytes())
                        y.append(np.pad(tags[s:s + WINDOW], (0, max(0, WINDOW - len(text[s:s + WINDOW])))).tobytes())
                for span in spans:
                    other = varied(text, span, r)
                    if other:
                        changed, (kind, a, b) = other
                        s = max(0, (a + b - WINDOW) // 2)
                        around = [q for q in spans if q[2] <= span[1]] + [(kind, a, b)]
                        moved = len(changed) - len(text)
                        around += [(k, p + moved, q + moved) for k, p, q in spans if p >= span[2]]
                        t = tags_of(len(changed), around)[s:s + WINDOW]
                        kinds.append(f"{kind} varied")
                        x.append(padded(changed, s).tobytes())
                        y.append(np.pad(t, (0, WINDOW - len(t))).tobytes())
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary())})

    able = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    # only ids are ranked in one place; the texts of these ``sample_docs`` ids at most are picked where they lie
    ids = able.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    rows = able.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "kind string, x binary, y binary")
    nth = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("x"), "x", "y"))
    got = rows.withColumn("nth", nth).where(F.col("nth") <= per_kind).orderBy("kind", "nth").toArrow()
    if not got.num_rows or set(got["kind"].to_pylist()) <= {"none"}:
        return None
    x, y = (np.frombuffer(b"".join(got[c].to_pylist()), np.uint8).reshape(-1, WINDOW) for c in ("x", "y"))
    network = Network.new()
    network.train(x, y.astype(np.int64), steps)
    give_back()
    return network


def spans(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with base and added (lists of kind:start:end); all columns are kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(network)
    keep = docs.select(*[c for c in docs.columns if c not in ("base", "added")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            got = found(shipped.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([listed(b) for b, _ in got], pa.string()), pa.array([listed(a) for _, a in got], pa.string())], [*batch.schema.names, "base", "added"])

    return keep.mapInArrow(run, f"{fields}, base string, added string")


def personal_data(docs: DataFrame, **sample) -> DataFrame:
    """The digest of the spans of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = spans(rows, fit(rows, **sample)).drop("text")
    n = lambda c, k: F.regexp_count(c, F.lit(f"{k}:")).cast("long")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    both = F.filter(F.concat(F.split("base", ","), F.split("added", ",")), lambda s: s != "")
    ordered = F.array_sort(F.transform(both, lambda s: F.struct(rank[F.split(s, ":")[0]].alias("k"), F.split(s, ":")[1].cast("long").alias("a"), s.alias("s"))))
    return marked.select("doc_id", *[n("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                         F.array_join(F.transform(ordered, lambda x: x["s"]), ",").alias("spans"), F.size(F.filter(F.split("added", ","), lambda s: s != "")).cast("long").alias("n_added"))


def masked(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets."""
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def clean(text: str, base: list, added: list) -> str:
        out, done = [], 0
        for kind, a, b in sorted([*base, *added], key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"<{kind.upper()}>"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_CHARS):
            texts = batch.column("text").to_pylist()
            got = found(shipped.value, [t or "" for t in texts])
            new = [t if t is None or not (b or a) else clean(t, b, a) for t, (b, a) in zip(texts, got)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
