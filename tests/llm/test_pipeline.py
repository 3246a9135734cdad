"""The pipeline against plain Python, stage by stage."""

import hashlib
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spokeframe.llm import langid, mixing
from spokeframe.llm.common import materialise
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        n_before = docs.count()
        docs = materialise(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        seen[name] = len(rows)
        if name != "BPE":
            assert docs.columns == columns
            assert all(r == before[r.doc_id] for r in rows)
        kept = {r.doc_id for r in rows}
        if name == "language ID":
            judge = langid.Judge(langid.fit(spark.read.parquet(f"{SF}/documents.parquet").filter(~langid.held_out(F.col("doc_id")))))
            assert kept == {i for i, r in before.items() if judge.judge(r.text)[2] >= langid.MARGIN}
            assert len(kept) > 0.97 * n_before
        elif name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text), i)
            assert kept == set(first.values()) and len(rows) == len(kept)
        elif name == "near dedup":
            want = brute([(i, before[i].text) for i in sorted(before)], corpus_pipeline.NEAR)
            assert kept == {i for i, (_, _, stays) in want.items() if stays} and len(rows) == len(kept)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix_documents(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            got = [r.doc_id for r in rows]
            assert {i: got.count(i) for i in before} == copies
            mixed = rows
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in mixed:
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == sorted(want)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in again) == sorted((r.doc_id, r.ids_sha256) for r in rows)


def test_stages_on_empty_and_odd_tables(spark, odd_docs, no_docs):
    """Each stage alone: an empty table stays empty; repeated rows, null ids and texts, and columns of any names pass or go by the stage's rule."""
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, no_docs, SF)
        assert none.count() == 0 and (name == "BPE" or none.columns == no_docs.columns), name
        rows = stage(spark, odd_docs, SF).collect()
        if name == "BPE":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
            assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
        else:
            assert set(rows) <= set(odd_docs.collect()), name


def test_run_on_an_empty_and_an_odd_table(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("none", no_docs), ("odd", odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(found) == 0) == (name == "none")
