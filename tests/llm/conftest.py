"""A small corpus with the awkward rows: nulls, empty and long texts, repeated rows, ties, columns with clashing names."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

CLASHING = ("score", "uid", "n", "key", "part", "h", "size", "base", "added", "k", "rate", "copies", "_t", "toxic")


def corpus(extra: bool = True) -> pa.Table:
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = t.to_pylist()
    long_text = " ".join(r["text"] for r in rows[:60]) * 2
    some = rows[5]["text"]
    awkward = [(1000, None, "en", "src1"), (1001, "", None, "src1"), (1002, " \n\t ", "de", None), (1003, long_text, "en", None), (1004, some, "en", "src2"), (1004, some, "en", "src2"), (1005, "one two three", "en", "src2"),
               (1006, "one two three", None, "src3"), (None, "call +1 (314) 555-4198 or a.b@c.example now please do", "en", "src3"), (1007, "12345 %% @@ 1.2.3.4", "fr", "only"), (1008, "x" * 50_000, "en", "only")]
    rows += [{"doc_id": i, "text": x, "lang": lang, "source": s, "n_chars": None if x is None else len(x)} for i, x, lang, s in awkward]
    out = pa.Table.from_pylist(rows, schema=t.schema)
    for name in CLASHING if extra else ():
        out = out.append_column(name, pa.array(["own"] * out.num_rows))
    return out


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """A data folder with the awkward documents, in several files."""
    d = tmp_path_factory.mktemp("corpus")
    t = corpus()
    (d / "documents.parquet").mkdir()
    for i in range(3):
        pq.write_table(t.slice(i * 75, 75), d / "documents.parquet" / f"{i}.parquet")
    labels = pq.read_table("/root/testdata/sf0.001/labels.parquet").to_pylist()
    labels += [{"doc_id": None, "quality": 1, "toxic": 1}, {"doc_id": 1000, "quality": None, "toxic": None}, {"doc_id": 1004, "quality": 1, "toxic": 0}, {"doc_id": 1004, "quality": 1, "toxic": 0}]
    pq.write_table(pa.Table.from_pylist(labels, schema=pq.read_table("/root/testdata/sf0.001/labels.parquet").schema), d / "labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def rows(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    """The same tables without rows."""
    d = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").slice(0, 0), d / f"{name}.parquet")
    return str(d)
