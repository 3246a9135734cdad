"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its labelled texts. A text is cut into blocks, each
block is compressed with each dictionary, and the language whose dictionary makes the text smallest wins. A narrow
margin to the second rejects the text.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; equal sizes go to the
first language by name; with one learned language every text with letters gets it with score 1; with none, all
are `und`; a very long text is judged whole, block by block; rows are independent, so repeats and null doc_ids need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

#: Bound of the fit: labelled texts drawn for a language, and bytes of its dictionary.
SAMPLE_TEXTS, DICTIONARY_BYTES = 400, 112_640
#: Bytes of text that are compressed at a time, so that dictionaries and not earlier text explain them.
BLOCK = 1024
LEVEL = 5
#: Parts of a language in which texts are ranked first.
SALTS = 64
#: Shorter texts are repeated up to so many bytes: zstandard stores a few dozen bytes as they are, whatever the dictionary.
SHORT = 400
#: Smallest share by which the best must be below the second.
MARGIN = 0.004
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: str) -> bytes:
    """What is compressed: letters in lower case, all else as one space."""
    return OTHER.sub(" ", text).lower().encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from the `texts` labelled texts of each with the smallest hashes of doc_id, then of the text.

    Languages are counted first, and rows that cannot be among the smallest hashes are left out before the
    ranking. Rows are ranked in SALTS parts of a language and then over these, so one that many rows tie in, as without ids, fills no task. The
    driver gets `texts` texts a language, each up to `size` characters, the most that a dictionary can hold; a language is a row and
    a dictionary, so labels should be the few hundred languages there are, not free text.
    """
    rows = labelled.filter("lang is not null and text is not null").select("lang", F.substring("text", 1, size).alias("text"), F.xxhash64("text").alias("own"), F.xxhash64(F.col("doc_id")).alias("draw"), F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)).alias("place"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 4 * texts / n) * (1 << 30)))])
    few = rows.filter(F.col("place") < F.element_at(limits, F.col("lang")))
    order = ["place", "draw", "own"]
    some = few.withColumn("salt", F.pmod("own", F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= texts)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= texts)
    out: dict[str, bytes] = {}
    for r in best.select("lang", "rank", "text").orderBy("lang", "rank").toLocalIterator():
        own, data = out.get(r["lang"], b""), letters(r["text"])
        if data.strip() and (not own or len(own) + len(data) <= size):  # texts that don't fit whole are left out
            out[r["lang"]] = (data + own)[-size:]
    return dict(sorted(out.items()))


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0
        data = letters(text)
        data *= -(-SHORT // len(data))
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = [sum([len(c.compress(b)) for b in blocks]) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        margin = 1.0 if second is None else (second - sizes[best]) / second
        return self.langs[best], min(1.0, 0.5 + 5 * margin) if second else 1.0, margin


def _judged(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    judge = Judge(dictionaries)
    for batch in parts(batches):
        found = list(map(judge.judge, batch["text"].to_pylist()))
        lang, score, margin = ([x[i] for x in found] for i in range(3))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "margin"])


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row. Only the text is judged."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    judged = given.mapInArrow(lambda it: _judged(it, dictionaries), "doc_id long, held_out boolean, lang_pred string, score double, margin double")
    return judged.select("doc_id", "held_out", "lang_pred", "score", (F.col("margin") < MARGIN).alias("rejected"))


def predict(docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out and judges all."""
    return identify(docs, fit(docs.filter(~held_out(F.col("doc_id")))))


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows whose language is told, with the columns of docs."""
    dictionaries = fit(docs.filter(~held_out(F.col("doc_id"))))
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        at = names.index("text")
        for batch in parts(batches):
            mask = [judge.judge(t)[2] >= MARGIN for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
