"""SentencePiece, spelling variants and collocations against the library and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tracewell.llm import phrases, pieces, queries, spelling
from tracewell.llm.common import table


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def got(df):
    return df.toArrow().to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 SentencePiece

ODD = ["", " ", "  ", "a", " a", "a ", "  two  blanks  and\ttab\n\n line ", "▁", "▁▁x ▁ y▁", "a▁b", "\x00 nul \x00", "☃𝒳 é́    x", "<s> </s> <unk> <0x41>", "x" * 20_000, " " * 3_000, ("long words " * 5_000), "été ÉTÉ 中文字 日本 🙂🙂"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.mark.parametrize("resident", [5, 10**6])
def test_ids_are_those_of_the_library(spark, folder, rows, library, resident):
    docs = table(spark, folder, "documents").select("doc_id", "text", "n", "key")
    own = spark.createDataFrame([(5000 + i, x, "own", "own") for i, x in enumerate(ODD)], docs.schema)
    out = got(pieces.encoded(docs.union(own).repartition(3), resident=resident))
    texts = Counter((r["doc_id"], r["text"]) for r in rows) + Counter((5000 + i, x) for i, x in enumerate(ODD))
    assert Counter((r["doc_id"], r["text"]) for r in out) == texts
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "") + [2], r["doc_id"]
        assert r["n"] == r["key"] == "own"


def test_decoding_is_that_of_the_library(spark, library):
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 32_000, int(n)).tolist() for n in rng.integers(0, 40, 400)]
    lists += [rng.integers(3, 259, int(n)).tolist() for n in rng.integers(0, 9, 200)] + [[], [2], [1, 28705, 28705], [28705, 2], [259, 259], [1, 2, 259, 13], [0], [0, 28705, 0], [13, 28705]]
    lists += [library.encode(x) + [2] for x in ODD]
    out = got(pieces.decoded(spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "i long, ids array<int>")))
    assert len(out) == len(lists) + 1
    for r in out:
        assert r["decoded"] == ("" if r["ids"] is None else library.decode(r["ids"])), r["ids"]


def test_sentence_pieces_query(spark, folder, rows, library):
    out = got(queries.QUERIES["op11_sentence_pieces"](spark, folder))
    want = Counter()
    for r in rows:
        ids = library.encode(r["text"] or "") + [2]
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want


# 12 spelling variants

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute_variants(words, ratio):
    out = {}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    for w, n in words.items():
        others = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_size[size] if near(w, x)]
        form = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = [len(others), form if form is not None and words[form] >= ratio * n else None]
    rows = set()
    for w, (n_near, form) in out.items():
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        rows.add((w, form, root, words[w], n_near, words.get(form)))
    return rows


def test_signatures_of_words_are_not_broadcast(spark):
    """Twenty rows a word stood behind explodes that size estimates do not see: a small vocabulary filled the driver."""
    words = spark.createDataFrame([("letters", 50), ("leters", 5), ("letter", 7), ("another", 9)], "word string, n long")
    pairs = spelling.near_pairs(words)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r["word"], r["other"]) for r in pairs.collect()} == {("letters", "leters"), ("leters", "letters"), ("letters", "letter"), ("letter", "letters")}


def test_spelling_variants_query(spark, folder, rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    out = got(queries.QUERIES["op12_spelling_variants"](spark, folder))
    want = brute_variants(words, 5)
    assert sum(r[1] is not None for r in want) > 20
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out) == sorted(want, key=lambda r: r[0])


def test_chains_ties_and_all_single_edits(spark):
    words = {"abcdef": 1, "abcdefg": 6, "abcdegg": 40, "abcdeggh": 400, "abcdeg": 40, "aaaaaaaaaa": 5, "aaaaaaaaaaa": 5, "abcdfe": 3, "ébcdef": 2, "x" * 3000: 7, "x" * 2999 + "y": 70, "x" * 2999: 8}
    base = "wonderful"
    for i in range(len(base) + 1):
        words[base[:i] + "é" + base[i:]] = 10 + i
        words[base[:i] + base[i + 1:]] = 1
        words[base[:i] + "q" + base[i + 1:]] = 2
    words[base] = 1000
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for parts in (3, 5, 8):
        out = got(spelling.variants(frame, parts=parts))
        assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out} == brute_variants(words, 5)


# 13 collocations

def brute_collocations(rows, least, report):
    f, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\n-\r]", lowered(r["text"])):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        dead = set()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * own[p[i:i + k]]:
                        dead.add(p[i:i + k])
        rows = []
        for p, a in cand.items():
            if p not in dead:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:report], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def test_words_of_a_slice_stay_bytes():
    texts = ["New York, É É\x0bof x", None, "", " \t.", "new york"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(["a", "b", None, "a", "a"]), pa.array(range(5))], ["text", "lang", "own"])
    words = phrases.Words(batch)
    assert words.row.tolist() == phrases.cut(batch)[2].tolist() == [0, 0, 0, 0, 0, 0, 4, 4]
    assert all(isinstance(x, bytes) for x in words.names) and len(words.names) == 5
    at, fingerprints, _ = words.runs(2, 64)
    assert [words.text(i, 2) for i in at.tolist()] == ["new york", "É É", "of x", "new york"]
    assert fingerprints[0] == fingerprints[3] and len(set(fingerprints.tolist())) == 3


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("bits", [64, 12])
def test_collocations_with_and_without_collisions(spark, folder, rows, bits):
    docs = table(spark, folder, "documents")
    out = got(phrases.collocations(docs, least=30 if bits == 64 else 12, report=50, bits=bits))
    want = brute_collocations(rows, 30 if bits == 64 else 12, 50)
    assert len(want) > 40
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out) == want


def test_collocations_query_on_pieces_blanks_and_copies(spark, tmp_path):
    texts = ["New York  city\tof dreams, new York. new\x0byork city; É É É a b c d", "a b c d e a b c d", "", None, "\t \n", "x." * 200, "one\x0ctwo one two\rone two! one two? one two: THREE three", "word"]
    rows = [{"text": x, "lang": lang} for x in texts for lang in ("en", None, "", "und") for _ in range(9)]
    frame = spark.createDataFrame([(i, r["text"], r["lang"], "own") for i, r in enumerate(rows)], "doc_id long, text string, lang string, n string")
    frame.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = got(queries.QUERIES["op13_collocations"](spark, str(tmp_path)))
    want = brute_collocations(rows, 30, 2000)
    assert want and sorted(tuple(r[c] for c in COLUMNS) for r in out) == want
