"""Fill-in-middle against plain Python, and an exact round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spokeframe.llm import fim
from tests.llm.conftest import SCHEMA, rows


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def lined(spark, odd_docs):
    texts = ["a\nb\nc", "\n", "\n\n\n", "a\n", "\na", "x\r\ny\r\n", "é\n🙂\n漢字\n", "a<P>b", "<S>", "x<M>\ny", "<P", "<\nP>\n<S\n>", "line\n" * 3000, "no break " * 100_000, "nul\0nul\nx", "'\"; drop\n--\n"] * 3
    return odd_docs.unionByName(spark.createDataFrame(rows([None] * 20 + texts), SCHEMA).filter("doc_id >= 20"))


@pytest.mark.parametrize("args", [(), (11, 40, 30)])
def test_forms(spark, lined, args):
    given = [(r.doc_id, r.text) for r in lined.collect()]
    got = [tuple(r) for r in fim.fill_in_middle(lined, *args).collect()]
    want = [plain(*r, *args) for r in given]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hashed = sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, given)), key=str)
    assert sorted(map(tuple, fim.digests(lined, *args).collect()), key=str) == hashed


def test_texts_come_back(spark, lined, no_docs):
    back = fim.restore(fim.fill_in_middle(lined))
    assert sorted(map(str, back.collect())) == sorted(map(str, lined.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert fim.digests(no_docs).count() == 0 and fim.restore(fim.fill_in_middle(no_docs)).count() == 0


def test_batches_are_cut_by_rows_and_bytes(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 100})
    monkeypatch.setattr(fim, "PART_BYTES", 10_000)
    sizes = [p.num_rows for p in fim._pieces(batch)]
    assert sum(sizes) == 100 and max(sizes) <= 10
    assert [p.num_rows for p in fim._pieces(batch.slice(0, 0))] == []
