"""The training-data operators against brute force, exact round trips, SQL and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import automaton as A
from tracewell.llm import bpe, language, mixing, ngram_lm, packing, pii, queries, set_join, token_files, top_k, toxicity
from tracewell.llm.common import ROW, numbered, table
from tracewell.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id, m):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def got(df):
    return df.toArrow().to_pylist()


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


# 1 language model

def test_language_model_base_and_backoff(spark, folder, rows):
    out = got(queries.QUERIES["op1_language_model"](spark, folder))
    assert len(out) == len(rows)
    tokens = [WORD.findall(lowered(r["text"])) + ["\n"] for r in rows]
    train = [t for t, r in zip(tokens, rows) if fold(r["doc_id"], 7) != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t, r in zip(tokens, rows))
    for r, (k, size, known, base) in zip(sorted(out, key=lambda r: (*key(r), r["n_tokens"])), want):
        assert (key(r), r["n_tokens"], r["n_known"], r["train_tokens"]) == (k, size, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (fold(r["doc_id"], 7) == 2)


def test_backoff_equals_a_recursion_over_counts(spark, folder, rows):
    some = (F.col("doc_id") < 40) | (F.col("doc_id") > 1003)
    out = got(ngram_lm.language_model(table(spark, folder, "documents").where(some), states=10**6, frequent=50))
    rows = [r for r in rows if r["doc_id"] is not None and (r["doc_id"] < 40 or r["doc_id"] > 1003)]
    tokens = [WORD.findall(lowered(r["text"])) + ["\n"] for r in rows]
    train = [t for t, r in zip(tokens, rows) if fold(r["doc_id"], 7) != 2]
    c = Counter(w for t in train for w in t)
    for r in out:  # most words meet their counts by the join
        t = tokens[[x["doc_id"] for x in rows].index(r["doc_id"])]
        assert r["n_known"] == sum(c[w] > 0 for w in t)
    grams, follow = Counter(), defaultdict(set)
    for t in train:
        s = ("\n" + "".join(w + " " for w in t[:-1]) + "\n").encode()
        for i in range(1, len(s)):
            for k in range(A.ORDER):
                context = s[max(0, i - k):i] if k else b""
                if k > i or b"\n" in context[1:]:
                    break
                grams[context, s[i]] += 1
                follow[context].add(s[i])
    total = Counter()
    for (context, _), m in grams.items():
        total[context] += m

    def p(context, b):
        lower = p(context[1:], b) if context else 1 / 256
        if context not in total:
            return lower
        d = ngram_lm.DISCOUNT
        return max(grams[context, b] - d, 0) / total[context] + d * len(follow[context]) / total[context] * lower

    by_id = {r["doc_id"]: r["score"] for r in out}
    for r, t in list(zip(rows, tokens))[::5]:
        s = ("\n" + "".join(w + " " for w in t[:-1]) + "\n").encode()
        ll = 0.0
        for i in range(1, len(s)):
            context = s[max(0, i - A.ORDER + 1):i]
            ll += math.log10(p(context, s[i]))
        assert by_id[r["doc_id"]] == pytest.approx(ll, rel=1e-5)


@pytest.mark.parametrize("states", [0, 300])
def test_contexts_outside_the_automaton_count(spark, folder, states):
    docs = table(spark, folder, "documents").where((F.col("doc_id") < 60) | (F.col("doc_id") > 1000))
    whole, cut = (sorted(got(ngram_lm.language_model(docs, states=n)), key=lambda r: (key(r), r["score"])) for n in (10**6, states))
    for a, b in zip(whole, cut, strict=True):
        assert b == a | {"score": b["score"]} and b["score"] == pytest.approx(a["score"], rel=1e-5)


def test_lanes_equal_one_pass():
    texts = pa.array(["the cat sat", "a much longer text " * 200, "", None, "é ü ñ"])
    raw, _ = A.stream(A.words_of(texts))
    by_length = A.marginals(*A.counted(A.grams(raw)))
    contexts = np.unique(np.concatenate([((k - 1) << A._BITS) | (g >> 8) for k, (g, _) in by_length.items()]))
    a = A.Automaton(A.closed(contexts), np.unique(raw))
    state, want = a.start, []
    for b in raw:
        at = state * a.width + int(a.classes[b])
        want.append(at)
        state = int(a.next.reshape(-1)[at])
    assert a.lanes(raw).tolist() == want
    weights = 10.0 ** a.table(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.ones(len(a.contexts)), 0.25).astype(float)
    assert np.allclose(weights, 0.25)


def test_closed_keeps_prefixes_and_suffixes():
    b = lambda s: (len(s) << A._BITS) | int.from_bytes(s, "big")
    assert A.closed(np.array(sorted([b(b""), b(b"a"), b(b"ab"), b(b"b"), b(b"xyz")]))).tolist() == sorted([b(b""), b(b"a"), b(b"ab"), b(b"b")])


# 2 toxicity

def test_kneser_ney_equals_recursion():
    """Every probability along two texts, against counts of left neighbours and the recursion written out."""
    learnt = [b"the cat sat on the mat \n", b"the cats sit \n", b"a hat \n", b"the cat sat \n"]
    raw, _ = A.stream(A.words_of(pa.array([t[:-2].decode() for t in learnt])))
    assert raw.tobytes() == b"".join(learnt)
    by_length = A.continuations(A.marginals(*A.counted(A.grams(raw))))
    taken = A.discounts(by_length)
    contexts = np.unique(np.concatenate([((k - 1) << A._BITS) | (g >> 8) for k, (g, _) in by_length.items()]))
    a = A.Automaton(A.closed(contexts), np.unique(raw))
    table_ = A.discounted(a, by_length, taken).reshape(-1)
    seen = [b"\n" + t for t in learnt]
    occurs = {k: Counter(t[i:i + k] for t in seen for i in range(len(t) - k + 1) if i or k > 1) for k in range(1, A.ORDER + 1)}
    counts = {A.ORDER: occurs[A.ORDER]}
    for k in range(1, A.ORDER):
        left = Counter(g[1:] for g in occurs[k + 1])
        counts[k] = Counter({g: occurs[k][g] if k > 1 and g[:1] == b"\n" else left[g] for g in occurs[k]})
    for k, c in counts.items():
        n = Counter(c.values())
        assert taken[k] == pytest.approx(min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9) if n[1] else 0.5)

    def p(byte: bytes, context: bytes) -> float:
        k = len(context) + 1
        own = {g: n for g, n in counts[k].items() if g[:-1] == context}
        shorter = p(byte, context[1:]) if context else 1 / 256
        if not own:
            return shorter
        n, total = own.get(context + byte, 0), sum(own.values())
        return max(n - taken[k], 0) / total + taken[k] * len(own) / total * shorter

    for text in (b"the cat sat on a hat \n", b"cats at the mat \n"):
        got_ = table_[a.lanes(np.frombuffer(text, np.uint8))]
        whole = b"\n" + text
        want = [math.log10(p(whole[i:i + 1], whole[max(0, i - A.ORDER + 1):i])) for i in range(1, len(whole))]
        assert got_.tolist() == pytest.approx(want, abs=1e-5)


def test_strength_is_the_ratio_of_one_toxic_passage(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(20).collect()] + ["one", "", None, "one two"]
    for text, got_ in zip(texts, model.strength(pa.array(texts)).tolist(), strict=True):
        raw, _ = A.stream(A.words_of(pa.array([text])))
        each = model.evidence[model.automaton.lanes(raw)].astype(float)
        words, at = [], 0
        for i, b in enumerate(raw.tolist()):
            if b in (0x20, A.END):
                words.append(each[at:i + 1].sum())
                at = i + 1
        size = min(model.passage, len(words))
        ratios = [10 ** sum(words[i:i + size]) for i in range(len(words) - size + 1)]
        assert got_ == pytest.approx(math.log10(sum(ratios) / len(ratios)) / size, abs=1e-3)


def test_toxicity_held_out(spark):
    out = {r["doc_id"]: r for r in got(queries.QUERIES["op2_toxicity"](spark, SF))}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    held = [(out[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if fold(r["doc_id"], 5) == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    found = sum(a and b for a, b in held)
    assert found >= 0.6 * sum(b for _, b in held) and found >= 0.75 * sum(a for a, _ in held)  # 6 of 70 are toxic
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in out.values())


def test_toxicity_awkward_rows(spark, folder, rows):
    out = got(queries.QUERIES["op2_toxicity"](spark, folder))
    assert sorted(map(key, out)) == sorted(map(key, rows)) and all(0 <= r["score"] <= 1 for r in out)
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    assert {r["score"] for r in got(toxicity.toxicity(docs, labels.where("toxic = 0")))} == {0.0}  # one class only
    kept = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert set(docs.columns) <= set(kept.columns)


# 3 personal data

CASES = ["a.b@c.d.e x@y @z.w a@b@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004", "4111 1111 1111 1111 and 4111-1111-1111-1112 7", "+1 (314) 555-4198 +12 +1(((((9 +1-2 +123456789", "é@a.b ünï+1.2%-_@x-y.z", "", "a" * 3000 + "@" + "b" * 3000 + ".c", "1" * 5000, "+1" + " 2" * 4000, "@" * 2000, "a@b." * 500]


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            double = [int(d) * 2 - 9 * (int(d) > 4) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(p or 0) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_patterns(rows):
    for text in CASES + [r["text"] or "" for r in rows]:
        assert pii.base_spans(text) == brute_spans(text)


def test_personal_data_digest(spark, folder, rows):
    out = got(queries.QUERIES["op3_personal_data"](spark, folder))
    want = sorted((key(r), hashlib.sha256(",".join("%s:%d:%d" % s for s in brute_spans(r["text"] or "")).encode()).hexdigest()) for r in rows)
    assert sorted((key(r), r["base_sha256"]) for r in out) == want
    for r in out:
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"] == len([s for s in r["spans"].split(",") if s])


def test_network_gradient_and_training():
    texts = [f"write to u{i}@mail{i % 7}.example.com or call +1 (314) 555-{1000 + i} soon" for i in range(60)]
    x = np.stack([pii.padded(t, 0) for t in texts])
    y = np.stack([np.pad(pii.tags_of(len(t), pii.base_spans(t)), (0, pii.WINDOW))[:pii.WINDOW] for t in texts]).astype(np.int64)
    n = pii.Network.new()
    wide = pii.Network({k: v.astype(np.float64) for k, v in n.p.items()}, n.hidden)
    _, grad = wide.gradient(x[:3], y[:3])
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, ends = wide.p[name][at], []
        for step in (1e-5, -1e-5):
            wide.p[name][at] = was + step
            ends.append(wide.gradient(x[:3], y[:3])[0])
        wide.p[name][at] = was
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3)
    first = n.gradient(x, y)[0]
    assert n.train(x, y, 200) < first / 4


def test_windows_are_reconciled_over_the_whole_text():
    class Always:  # tags the digits of each window, however it is cut
        def decode(self, x):
            return np.where((x >= 16) & (x < 26), 8, 0).astype(np.int8)

    text = "word " * 25 + "4111.1111.1111.1111 " + "word " * 30
    text = text.replace(".", "")  # sixteen digits across the edge of a window
    base, added = pii.found(Always(), ["", text.replace("4111111111111111", "5 4111111111111111".replace(" ", "x"))])[1]
    assert base == [("card", text.index("4111") + 2, text.index("4111") + 18)] and added == []


def test_masking(spark, folder):
    docs = table(spark, folder, "documents")
    out = {r["doc_id"]: r["text"] for r in got(pii.masked(docs, None))}
    assert out[None] == "call <PHONE> or <EMAIL> now please do" and out[1000] is None and out[1001] == ""


# 4 language

def test_language_held_out(spark):
    out = got(queries.QUERIES["op4_language"](spark, SF))
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    held = [r for r in out if r["held_out"]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_awkward_rows(spark, folder, rows):
    out = got(queries.QUERIES["op4_language"](spark, folder))
    by = {r["doc_id"]: r for r in out}
    assert sorted(map(key, out)) == sorted(map(key, rows))
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002, 1007)) and by[1003]["lang_pred"] != "und"


def test_mixture_finds_both_languages(spark):
    docs = table(spark, SF, "documents")
    model = language.fit(docs)
    t = {x: next(r["text"] for r in got(docs.where(F.col("lang") == x).limit(40)) if len(r["text"]) > 1500) for x in ("de", "es")}
    share = model.proportions(pa.array([t["de"][:1500] + " " + t["es"][:500], t["de"][:1500]]))
    named = dict(zip(model.languages, share[0]))
    assert named["de"] > named["es"] > 0.1 and dict(zip(model.languages, share[1]))["de"] > 0.99


# 5 set join

def brute_classes(rows):
    sets = []
    for r in rows:
        w = lowered(r["text"]).split() if r["text"] else []
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * shared >= 4 * (len(sets[i]) + len(sets[j])) > 0:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            names[find(i)] = min(names.get(find(i), r["doc_id"]), r["doc_id"])
    return [(key(r), names.get(find(i)), links[i]) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def near(tmp_path_factory):
    """Groups of near copies around a shared passage, larger than the buckets that are compared at once."""
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(vocabulary, 12))
    out = []
    for g in range(6):
        base = list(r.choice(vocabulary, 60))
        for c in range((40, 8, 5, 3, 2, 1)[g]):
            words = list(base)
            for _ in range(c % 4):
                words[int(r.integers(60))] = str(r.choice(vocabulary))
            out.append({"doc_id": len(out), "text": f"{passage} {' '.join(words)}"})
    out += [{"doc_id": len(out) + i, "text": x} for i, x in enumerate([None, "", "A b", "a  B", "c d"])]
    d = tmp_path_factory.mktemp("near")
    pq.write_table(pa.Table.from_pylist(out), d / "documents.parquet")
    return str(d), out


@pytest.mark.parametrize("small,tile", [(256, 1024), (4, 16)])
def test_set_join_equals_brute_force(spark, near, monkeypatch, small, tile):
    monkeypatch.setattr(set_join, "TILE_SETS", tile)
    d, rows = near
    out = got(set_join.join(numbered(spark.read.parquet(f"{d}/documents.parquet")), small=small))
    assert sorted((key(r), r["class_id"], r["n_links"]) for r in out) == sorted(brute_classes(rows))


def test_set_join_awkward_rows(spark, folder, rows):
    out = got(queries.QUERIES["op5_set_join"](spark, folder))
    assert sorted((key(r), r["class_id"] is None, r["class_id"] or 0, r["n_links"]) for r in out) == sorted((k, c is None, c or 0, n) for k, c, n in brute_classes(rows))


def test_one_of_each_class_stays(spark, folder, rows):
    docs = table(spark, folder, "documents")
    kept = set_join.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {(c, k if c is None else None) for k, c, _ in brute_classes(rows)}
    out = [r["doc_id"] for r in got(kept)]
    assert len(out) == len(classes) == len(set(out)) and {r["uid"] for r in got(kept.select("uid"))} == {"own"}


@pytest.mark.parametrize("module, name, step", [(set_join, "join", set_join.one_of_each), (mixing, "mix", lambda docs: mixing.mixed(numbered(docs)))])
def test_rows_keep_their_numbers_when_files_are_split_anew(spark, folder, monkeypatch, module, name, step):
    docs, first = table(spark, folder, "documents"), getattr(module, name)
    want = sorted(map(str, got(step(docs))))

    def then_split(docs, **how):
        out = first(docs, **how)
        out = stage(out, "test-join") if module is set_join else mixing.Mix(out.sizes, out.sources, stage(out.slices, "test-slices"))
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        return out

    monkeypatch.setattr(module, name, then_split)
    try:
        assert sorted(map(str, got(step(table(spark, folder, "documents"))))) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_runs_follow_from_recall():
    assert set_join.runs_for(0.99) < set_join.runs_for(0.999) and set_join.runs_for(0.995) == 12


# 6 top k

@pytest.mark.parametrize("shard_rows,query_block", [(10_000, 4096), (60, 3)])
def test_top_k_equals_brute_force(spark, tmp_path, shard_rows, query_block):
    r = np.random.default_rng(3)
    v = r.normal(0, 0.2, (400, 8)).astype(np.float32)
    v[100:180] = v[100]
    rows = [{"vec_id": i, "embedding": [float(x) for x in x_], "label": 1, "score": "own", "bound": 0} for i, x_ in enumerate(v)]
    rows[7]["embedding"], rows[8]["embedding"][2], rows[9]["embedding"][0], rows[20]["embedding"][0] = None, None, float("nan"), float("inf")
    rows += [{**rows[30], "vec_id": 30}, {**rows[31], "vec_id": None}]
    pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("score", pa.string()), ("bound", pa.int64())])), tmp_path / "e.parquet")
    out = got(top_k.top_k(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("vec_id") % 10 == 0, shard_rows=shard_rows, query_block=query_block))
    fine = [(x["vec_id"], np.floor(256 * np.array(x["embedding"], np.float32).astype(float)).astype(int)) for x in rows if x["vec_id"] is not None and x["vec_id"] not in (7, 8, 9, 20)]
    want = []
    for q, a in {q: a for q, a in fine if q % 10 == 0}.items():
        best = sorted((-int(a @ b), i) for i, b in fine if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in out) == sorted(want)


def test_tree_has_inner_boxes_and_leaves_most_of_itself_alone():
    r = np.random.default_rng(8)
    centres = r.normal(0, 500, (20, 6))
    rows = np.floor(centres[np.arange(4000) % 20] + r.normal(0, 20, (4000, 6)))
    ids = r.permutation(4000).astype(np.int64)
    tree = top_k.Tree(ids, rows)
    assert sum(len(i) for i, _ in tree.leaves.values()) == 4000 and len(tree.child) == 2 * len(tree.leaves) - 1
    for i, c in enumerate(tree.child.tolist()):
        for side in (c, c + 1) if c else ():
            assert (tree.low[side] >= tree.low[i]).all() and (tree.high[side] <= tree.high[i]).all()

    class Watched(dict):
        def __getitem__(self, node):
            seen.append(node)
            return super().__getitem__(node)

    seen, leaves = [], len(tree.leaves)
    tree.leaves = Watched(tree.leaves)
    for q in range(0, 4000, 400):
        seen.clear()
        _, who, score = tree.search(ids[q:q + 1], rows[q:q + 1], 5, np.array([top_k.LOWEST]))
        want = sorted((-int(rows[q] @ rows[i]), int(ids[i])) for i in range(4000) if i != q)[:5]
        assert list(zip((-score).tolist(), who.tolist())) == want and len(seen) < leaves / 3


def test_cells_part_the_space_and_prune_shards(spark, tmp_path):
    r = np.random.default_rng(4)
    v = r.normal(0, 1, (12, 4))[np.arange(3000) % 12] + r.normal(0, 0.05, (3000, 4))
    v[:1200] = v[0]  # a third of all rows are copies: one cell, several shards
    cells = top_k.Cells(np.floor(256 * v[::3]), 16)
    own = cells.of(np.floor(256 * v))
    assert own.min() >= 0 and own.max() < cells.cells <= 16 and len(set(own[:1200])) == 1
    pq.write_table(pa.table({"vec_id": np.arange(3000), "embedding": pa.array(v.tolist())}), tmp_path / "e.parquet")
    out = got(top_k.top_k(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("vec_id") % 50 == 0, shard_rows=150, sample_values=2000))
    x = np.floor(256 * v).astype(np.int64)
    want = [(q, n, i, -s) for q in range(0, 3000, 50) for n, (s, i) in enumerate(sorted((-int(d), i) for i, d in enumerate(x @ x[q]) if i != q)[:5], 1)]
    assert sorted((y["query_id"], y["rank"], y["vec_id"], y["score"]) for y in out) == sorted(want)


# 7 token files and 9 packing

@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    return [e.ids for e in t.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts():
    e = bpe.encoder(bpe.default_path())
    texts = ["a b", " a b", "a  b", "a\n b", "it's we'll 12 3.4", "é ü  x", "x 　y", "", None, "a b ", "tab\tand line\nends", "<|endoftext|> is text", "\x00 a", "Ġ a Ġb"]
    ids, n = e.encode(pa.array(texts))
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_added_tokens_get_the_ids_of_the_library():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y z", "a <|endoftext |> b", "plain text here", "a b <|endoftext|"]
    ids, n = bpe.Encoder(bpe.default_path()).encode(pa.array(texts))
    want = [x.ids for x in Tokenizer.from_file(bpe.default_path()).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files_round_trip(spark, folder, rows, encoded):
    docs = table(spark, folder, "documents")
    manifest = token_files.write(docs, bpe.default_path(), 2, partitions=5)
    out = got(token_files.read(manifest, batch_tokens=5000))
    want, start = [], 0
    for (k, crc, n) in sorted((key(r) if r["doc_id"] is not None else (False, -1), zlib.crc32(np.array(x + [2], "<u4")), len(x) + 1) for r, x in zip(rows, encoded)):
        want.append((k, n, crc))
    out = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert ids == sorted(ids)
    assert sorted(((False, i), r["n_tokens"], r["ids_crc32"]) for i, r in zip(ids, out)) == sorted(want)


def test_packing_fills_sequences_without_gaps(spark, folder, rows, encoded):
    out = got(queries.QUERIES["op9_pack_sequences"](spark, folder))
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for r, x in zip(rows, encoded):
        ids = np.array(x + [0], "<u4")
        pieces = max(1, -(-len(ids) // 2048))
        cuts = [0, *(len(ids) - 2048 * np.arange(pieces - 1, -1, -1)).tolist()]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[r["doc_id"], p, a, b - a, zlib.crc32(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert len(by) <= 1.05 * sum(r["length"] for r in out) / 2048 + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 101, 400) if seed else np.array([100] * 5 + [60] * 7 + [40] * 7 + [1] * 3)
    histogram = Counter(sizes.tolist())
    p = packing.plan(dict(histogram), 100)
    filled, seen = defaultdict(list), Counter()
    for length, rank, count, seq, offset, each in p.runs:
        for i in range(count):
            seen[length, rank + i] += 1
            filled[seq + i // each].append((offset + i % each * length, length))
    assert set(seen.values()) == {1} and Counter(k[0] for k in seen.elements()) == histogram
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(filled) == p.sequences <= math.ceil(sizes.sum() / 100) * 1.06 + 1


# 8 mixing and 10 quality, against SQL

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    have = queries.QUERIES[name](spark, SF).toArrow().to_pandas()[list(want.columns)]
    by = list(want.columns[:2])
    a, b = (x.sort_values(by).reset_index(drop=True) for x in (have, want))
    for c in want.columns:
        assert np.allclose(a[c], b[c]) if a[c].dtype.kind == "f" else (a[c] == b[c]).all()


def test_mix_comes_near_its_targets(spark, folder, rows):
    out = got(mixing.taken(mixing.mix(table(spark, folder, "documents"))))
    assert sorted(map(key, out)) == sorted(map(key, rows))
    by, due = Counter(), {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
        due[r["source"]] = (r["target"], r["source_size"])
    assert sum(t for t, _ in due.values()) == pytest.approx(1.5 * sum(s for _, s in due.values()))
    for s, (target, _) in due.items():
        assert abs(by[s] - target) <= 4 * 64
    docs = numbered(table(spark, folder, "documents"))
    again = mixing.mixed(docs)
    assert sum(len(WORD.findall(r["text"])) for r in got(again)) == sum(by.values()) and again.columns == [c for c in docs.columns if c != ROW]


def test_mix_takes_rows_without_an_id(spark, tmp_path):
    n = 900
    rows = pa.table({"doc_id": pa.array([None if i % 3 == 1 and i % 2 else i for i in range(n)], pa.int64()), "text": [f"row{i} " + "word " * (40 + i % 50) for i in range(n)], "source": ["odd" if i % 2 else "even" for i in range(n)]})
    (tmp_path / "d").mkdir()
    for i in range(3):
        pq.write_table(rows.slice(i * 300, 300), tmp_path / "d" / f"{i}.parquet")
    docs = spark.read.parquet(str(tmp_path / "d"))
    m = mixing.mix(docs)
    out = got(mixing.taken(m))
    assert len(out) == n and sum(r["doc_id"] is None for r in out) == n // 6
    for source in ("odd", "even"):
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 256
    con = duckdb.connect()
    con.register("documents", rows)
    want = {r[0]: r[4] for r in con.execute(mixing.SQL).fetchall() if r[0] is not None}
    assert {r["doc_id"]: r["taken"] for r in out if r["doc_id"] is not None} == want
    # they share no bucket: every block of the stream is whole, and the documents of the mix hold the words taken
    whole = got(mixing.blocks(m.sizes, m.sources, 64).groupBy("sid", "block").agg(F.sum("words").alias("n")))
    assert sum(r["n"] for r in whole) == sum(r["size"] for r in out) and sum(r["n"] != 64 for r in whole) <= 2
    mixed = got(mixing.mixed(numbered(docs)))
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(r["taken"] for r in out)
    assert len({r["text"].split()[0] for r in mixed if r["doc_id"] is None}) == len({r["uid"] for r in out if r["doc_id"] is None and r["taken"]})


def test_quality_awkward_rows(spark, folder, rows):
    out = got(queries.QUERIES["op10_quality_rules"](spark, folder))
    assert sorted(map(key, out)) == sorted(map(key, rows))
    by = {r["doc_id"]: r for r in out}
    for r in rows:
        w = WORD.findall(r["text"] or "")
        c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(5)}
        o = by[r["doc_id"]]
        assert (o["n_words"], o["word_chars"], o["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert o["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (o["base_failed"] and o["kept"])


# the pipeline

def test_pipeline_stage_by_stage(spark, folder):
    docs = table(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, before, folder), "test-stage")
        a = got(after)
        if name != names[-1]:
            assert after.columns == before.columns
        if name == "toxicity":
            rejected = got(toxicity.scored(before, toxicity.fit(before, table(spark, folder, "labels"))).where("predicted = 1"))
            assert len(a) + len(rejected) == before.count()
        elif name == "ngram_jaccard_join":
            classes = {(c, k if c is None else None) for k, c, _ in brute_classes(got(before))}
            assert len(a) == len(classes)
        elif name == "pii":
            assert not any(brute_spans(r["text"] or "") for r in a) and len(a) == before.count()
        elif name == "mix_sources":
            assert max(Counter(r["doc_id"] for r in a).values()) <= 2
        before = after
    assert sum(r["length"] for r in a) > 0 and max(r["offset"] + r["length"] for r in a) <= 2048
