"""Language ID: held-out accuracy, and what has no language."""

import zlib

import regex
import zstandard
from pyspark.sql import functions as F

from spokeframe.llm import langid
from spokeframe.llm.queries import op5_language_id
from tests.llm.conftest import SCHEMA


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = op5_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.98 * len(held)
    assert sum(r.rejected for r in got) < 0.005 * len(got)


def test_choice_and_sample_by_brute_force(spark):
    """Every prediction over a whole table again: the sample by sorting all rows, the choice by compressing each block with each dictionary."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    all_ = docs.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("place")).collect()
    texts, size = 20, 9_000
    want = {}
    for r in sorted((r for r in all_ if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None), key=lambda r: r.place):
        want.setdefault(r.lang, []).append(regex.sub(r"[^\p{L}]+", " ", r.text).lower().encode())
    for lang, found in want.items():
        data = b""
        for t in found[:texts]:
            if t.strip() and (not data or len(data) + len(t) <= size):
                data = (t + data)[-size:]
        want[lang] = data
    fitted = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))), texts, size)
    assert fitted == want and len(want) == 4
    got = {r.doc_id: r for r in langid.identify(docs, fitted).collect()}
    assert len(got) == len(all_)
    for r in all_:
        if not r.text or not regex.search(r"\p{L}", r.text):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].rejected
            continue
        data = regex.sub(r"[^\p{L}]+", " ", r.text).lower().encode()
        while len(data) < langid.SHORT:
            data += regex.sub(r"[^\p{L}]+", " ", r.text).lower().encode()
        sizes = []
        for lang in sorted(want):
            known = zstandard.ZstdCompressionDict(want[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(data[at : at + langid.BLOCK])) for at in range(0, len(data), langid.BLOCK)))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        assert got[r.doc_id].lang_pred == sorted(want)[order[0]], r.doc_id
        assert got[r.doc_id].rejected == (margin < langid.MARGIN) and abs(got[r.doc_id].score - min(1, 0.5 + 5 * margin)) < 1e-12


def test_odd_rows(spark, odd_docs, no_docs):
    assert langid.predict(no_docs).count() == 0
    got = {(r.doc_id): r for r in langid.predict(odd_docs).collect()}
    assert len(got) >= 13 and got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0
    assert got[3].lang_pred == "en" and got[3].score == 1.0
    unlabelled = odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).replace("", None, "lang")
    assert {r.lang_pred for r in langid.predict(unlabelled).collect()} == {"und"}


def test_labels_of_judged_rows_do_not_matter(spark):
    texts = ["the cat and the dog in the house", "der hund und die katze in dem haus"] * 40
    docs = [(i, t, ("en", "de")[i % 2], "s", 1, "", 0, "") for i, t in enumerate(texts)]
    a = langid.predict(spark.createDataFrame(docs, SCHEMA)).collect()
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g, s, *rest) for i, t, g, s, *rest in docs]
    b = langid.predict(spark.createDataFrame(wrong, SCHEMA)).collect()
    assert sorted(a) == sorted(b) and all(r.lang_pred == ("en", "de")[r.doc_id % 2] for r in a)


def test_kept_rows_have_their_columns(spark, odd_docs):
    kept = langid.keep_rows(odd_docs)
    assert kept.schema == odd_docs.schema
    assert {r.doc_id for r in kept.collect()} >= {3, 4, 5}
