"""BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spokeframe.llm import bpe
from spokeframe.llm.queries import op2_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_whole_table(spark):
    library = Tokenizer.from_file(PATH)
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_bpe(spark, sf).collect()}
    assert got == {i: expected(library, t) for i, t in texts.items()}


def test_odd_rows(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    assert bpe.encode_documents(no_docs, PATH).count() == 0
    want = sorted(expected(library, r.text) for r in odd_docs.collect())
    got = bpe.encode_documents(odd_docs, PATH).collect()
    assert sorted((r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in got) == want


def test_odd_characters():
    library, vocabulary = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    encoder = bpe.Encoder(vocabulary, bpe.Transducer.build({}))
    rnd = random.Random(1)
    pool = "aàéßΣσςİıﬁ½²١५漢字か\u0301\u200b\u00a0\u2028\x0b\x1c\x85🙂'’-_ \n\tst'sLL9" + "<|endoftext|>"
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(30))) + rnd.choice(["", "<|endoftext|>", "<|startoftext|>x"])
        ids = next(encoder.encode([text]))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert bpe.decode(vocabulary, ids) == library.decode(want, skip_special_tokens=False)


def test_transducer(tmp_path):
    rnd = random.Random(2)
    words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 9))): [rnd.randrange(99) for _ in range(rnd.randrange(1, 4))] for _ in range(2000)}
    built = bpe.Transducer.build(words)
    built.save(tmp_path / "x.npy")
    mapped = bpe.Transducer.open(tmp_path / "x.npy")
    order = sorted(words)
    assert mapped.places(order).tolist() == list(range(len(order)))
    assert all(mapped.ids[mapped.starts[i] : mapped.starts[i + 1]].tolist() == words[w] for i, w in enumerate(order))
    absent = [w + b"z" for w in order[:50]] + [b"", b"zz", b"a" * 100]
    assert (mapped.places(absent) == -1).all()
    # Minimal: no two states have the same end and the same edges.
    states = {}
    for key, to, add in zip(built.key.tolist(), built.to.tolist(), built.add.tolist()):
        states.setdefault(key >> 8, []).append((key & 255, to, add))
    seen = [(int(built.final[s]), tuple(states.get(s, ()))) for s in range(len(built.final))]
    assert len(set(seen)) == len(seen) < sum(len(w) for w in words)


def test_words_of_one_count_fill_the_lexicon(spark):
    """A class of words too large for the lexicon is taken up to its size, the first in order."""
    docs = spark.createDataFrame([(1, "zz zz " + " ".join(f"{a}{b}" for a in "qwx" for b in "abcd")), (2, "zz yy yy")], "doc_id long, text string")
    for size, want in ((5, {"zz", "yy", "qa", "qb", "qc"}), (2, {"zz", "yy"}), (1, {"zz"}), (99, None), (14, None)):
        name = bpe.build_lexicon(docs, PATH, size)
        lexicon = bpe.Transducer.open(bpe.SparkFiles.get(name))
        words = ["zz", "yy", *(f"{a}{b}" for a in "qwx" for b in "abcd")]
        assert {w for w, at in zip(words, lexicon.places([w.encode() for w in words])) if at >= 0} == (want or set(words))


def test_decoding_from_ids(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["some text, 12 and más", "", "🙂 " * 1000, None]
    ids = [None if t is None else library.encode(t, add_special_tokens=False).ids for t in texts] + [[49406, 320, 49407, 9_999_999]]
    rows = [(i, None if x is None else bytearray(bpe.pack(x)), "old") for i, x in enumerate(ids)]
    coded = spark.createDataFrame(rows, "k long, ids binary, decoded string")
    got = bpe.decode_documents(coded, PATH)
    assert got.columns == coded.columns and bpe.decode_documents(coded.limit(0), PATH).count() == 0
    assert [r.decoded for r in got.orderBy("k").collect()] == [None if x is None else library.decode(x, skip_special_tokens=False) for x in ids]
