"""BPE encoding and decoding with a word lexicon in a minimal acyclic transducer.

All words of the corpus are counted, and the LEXICON most frequent ones are encoded once, on the driver, and
compiled into an automaton with shared suffixes whose edges add up to a word's place; the place leads to the
word's ids. Spark ships the automaton as one file to each executor, whose workers map it into memory. A batch's
distinct words are looked up in it together; words that it lacks are merged exactly, pair by pair in order of rank.

Defined cases: null text encodes as the empty one: no ids, decoded ''; special tokens' own strings in a text are
special tokens, as in the library; rows are independent, so ties, repeats and null doc_ids need no rule; very long texts are encoded whole, a part of the words at a time; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise, parts, shared_dir

#: Words compiled into the lexicon, and the longest of them in bytes.
LEXICON, LONGEST = 65_536, 48
#: Distinct words whose ids a worker keeps between batches.
KEPT_WORDS = 120_000
END = "</w>"
NEVER = 1 << 62
# The vocabulary file's own word pattern after lower-casing.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters on whose classes all Unicode versions agree, in lower case too; texts with others are cut by the library's own pre-tokenizer.
SURE = "\x00-\u017F\u2010-\u2027\u20AC"
UNSURE = re.compile(f"[^{SURE}]")
ASCII_WORD = re.compile(CONTRACTIONS + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def _word_pattern() -> re.Pattern[str]:
    """The word pattern for texts of sure characters, with its classes spelt out."""
    sure = "".join(c for c in map(chr, range(0x2030)) if not UNSURE.match(c)) + "\u20ac"
    letters, digits, spaces = ("".join(map(re.escape, regex.findall(cls, sure))) for cls in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")


WORD = _word_pattern()


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """Merges and tokens of a tokenizer file whose words end in </w>."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ids = model["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}
        self.pairs: dict[int, int] = {}  # two ids in one number to the merge's rank and new id in one number
        for rank, (a, b) in enumerate(model["model"]["merges"]):
            self.pairs.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        chars = byte_chars()
        self.inner, self.last = [ids[c] for c in chars], [ids[c + END] for c in chars]
        self.path, self.library, self.bytes = path, None, {ord(c): b for b, c in enumerate(chars)}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def words(self, text: str) -> list[str]:
        """What the text is cut into: words as normalised, and special tokens."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        if UNSURE.search(text):
            if self.library is None:
                self.library = Tokenizer.from_file(self.path)
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.bytes.__getitem__, map(ord, piece))).decode("utf-8", "surrogatepass") for piece, _ in pieces]
        # The library lower-cases each character by itself, so a final sigma stays as elsewhere.
        return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def merge(self, word: str) -> list[int]:
        """The word's ids by merging: of all adjacent pairs that have a rank, the lowest first, and of equals the leftmost."""
        if word in self.specials:
            return [self.specials[word]]
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if len(ids) > 64:
            return self._merge_long(ids)
        pair = self.pairs.get
        ranks = [pair(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            ids[i] = low & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pair(ids[i - 1] << 20 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = pair(ids[i] << 20 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, for words of any length."""
        right, left = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        pair = self.pairs.get
        heap = [(found, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := pair(a << 20 | b, NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] < 0 or pair(ids[i] << 20 | ids[j]) != low:
                continue
            ids[i], ids[j] = low & 0xFFFFF, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (found := pair(ids[a] << 20 | ids[right[a]], NEVER)) != NEVER:
                    heapq.heappush(heap, (found, a))
        return [i for i in ids if i >= 0]


class Transducer:
    """Words to ids: a minimal acyclic automaton over bytes, in flat int32 arrays that can be mapped into memory.

    An edge is found by state * 256 + byte; the numbers on a word's edges add up to its place among
    the sorted words, and `starts` says where the ids of that place begin.
    """

    def __init__(self, flat: np.ndarray) -> None:
        edges, states, words = (int(x) for x in flat[:3])
        parts = np.split(flat[3:], np.cumsum([edges, edges, edges, states, words + 1]))
        self.flat, self.key, self.to, self.add, self.final, self.starts, self.ids = flat, *parts

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Adds the words in order and, behind each, merges the states that will not change with equal ones."""
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # open states along the last word: final, closed edges; the edge to the next is the last word's byte

        def close(depth: int, last: bytes) -> None:
            while len(path) - 1 > depth:
                final, edges = path.pop()
                state = (final, tuple(edges))
                if (at := known.get(state)) is None:
                    at = known[state] = len(states)
                    states.append(state)
                path[-1][1].append((last[len(path) - 1], at))

        order, last = sorted(words), b""
        for word in order:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same, last)
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        close(0, last)
        root = (path[0][0], tuple(path[0][1]))
        states.append(root)
        size = [0] * len(states)
        rows = []
        top = len(states) - 1  # the root gets number 0
        for at, (final, edges) in enumerate(states):
            add = int(final)
            for byte, to in edges:
                rows.append(((top - at) * 256 + byte, top - to, add))
                add += size[to]
            size[at] = add
        rows.sort()
        table = np.array(rows, np.int32).reshape(-1, 3).T
        finals = np.array([final for final, _ in reversed(states)], np.int32)
        ids = [words[w] for w in order]
        starts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.concatenate([np.array([len(rows), len(states), len(order)], np.int32), *table, finals, starts, np.array([i for x in ids for i in x], np.int32)])
        return cls(flat)

    def save(self, path: str) -> None:
        np.save(path, self.flat)

    @classmethod
    def open(cls, path: str) -> Transducer:
        return cls(np.load(path, mmap_mode="r"))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, or -1. All words take their next byte at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        out = np.full(len(words), -1, np.int64)
        live, state, place = np.flatnonzero((size > 0) & (size <= LONGEST)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for at in range(LONGEST + 1):
            ended = size[live] == at
            full = live[ended]
            full = full[self.final[state[full]] > 0]
            out[full] = place[full]
            live = live[~ended]
            if not len(live) or not len(self.key):
                break
            key = state[live] * 256 + data[start[live] + at]
            edge = np.searchsorted(self.key, key)
            edge[edge == len(self.key)] = 0
            good = self.key[edge] == key
            live, edge = live[good], edge[good]
            state[live] = self.to[edge]
            place[live] += self.add[edge]
        return out


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """A worker's vocabulary, lexicon, and the ids of words it has met."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer) -> None:
        self.vocabulary, self.lexicon, self.ids = vocabulary, lexicon, {}

    def learn(self, words: Iterable[str]) -> None:
        if len(self.ids) > KEPT_WORDS:
            self.ids = {}
        new = [w for w in words if w not in self.ids]
        lex, vocabulary = self.lexicon, self.vocabulary
        for word, at in zip(new, lex.places([w.encode("utf-8", "surrogatepass") for w in new]).tolist()):
            self.ids[word] = pack(lex.ids[lex.starts[at] : lex.starts[at + 1]].tolist() if at >= 0 else vocabulary.merge(word))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text, the ids as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), 500):
            cut = [self.vocabulary.words(t) if t else [] for t in texts[at : at + 500]]
            self.learn(set().union(*cut))
            ids = self.ids.__getitem__
            for words in cut:
                yield b"".join(map(ids, words))


def decode(vocabulary: Vocabulary, packed: bytes | None) -> str | None:
    """The tokens' strings with spaces between them, as the vocabulary file names no decoder. Ids that the vocabulary lacks are left out, as the library does."""
    if packed is None:
        return None
    ids = np.frombuffer(packed, "<u4").tolist()
    try:
        return " ".join(map(vocabulary.tokens.__getitem__, ids))
    except KeyError:
        return " ".join(vocabulary.tokens[i] for i in ids if i in vocabulary.tokens)


_loaded: dict[tuple[str, str], Encoder] = {}
_shipped: set[tuple[str, str]] = set()
_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _encoder(path: str, name: str) -> Encoder:
    if (path, name) not in _loaded:
        _loaded.clear()  # an earlier lexicon's words would only take memory
        _loaded[path, name] = Encoder(vocabulary_at(path), Transducer.open(SparkFiles.get(name)))
    return _loaded[path, name]


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary, found = vocabulary_at(path), Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for batch in parts(batches):
        for text in batch["text"].to_pylist():
            if text:
                found.update(vocabulary.words(text))
        if len(found) > KEPT_WORDS:
            yield out()
            found.clear()
    if found:
        yield out()


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n over the whole table."""
    parts = docs.select("text").mapInArrow(lambda it: _counted(it, path), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compiles the most frequent words and ships the file to the executors; gives its name there."""
    counts = materialise(word_counts(docs, path).filter(F.octet_length("word") <= LONGEST), "counts")
    # How many words there are of each count, a table as long as there are different counts, tells the least count of the `size` most frequent.
    words, least, room = 0, None, size
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).limit(size).collect():
        least, room = row["n"], size - words
        words += row["count"]
        if words >= size:
            break
    # Of the words with the least count, the first in order fill the lexicon up.
    most = counts.filter(F.col("n") > least).select("word").unionByName(counts.filter(F.col("n") == least).select("word").orderBy("word").limit(room)) if room and least is not None else None
    top = [r["word"] for r in most.collect()] if most is not None else []
    vocabulary = vocabulary_at(path)
    lexicon = Transducer.build({w.encode("utf-8", "surrogatepass"): vocabulary.merge(w) for w in top})
    name = f"lexicon-{hashlib.sha256(path.encode() + lexicon.flat.tobytes()).hexdigest()[:16]}.npy"
    context = docs.sparkSession.sparkContext
    if (context.applicationId, name) not in _shipped:
        folder = f"{shared_dir(docs.sparkSession)}/lexicon"
        store, at = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        with store.open_output_stream(f"{at}/{name}") as out:
            np.save(out, lexicon.flat)
        context.addFile(f"{folder}/{name}")
        _shipped.add((context.applicationId, name))
    return name


def _encoded(batches: Iterator[pa.RecordBatch], path: str, name: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, name)
    for part in parts(batches):
        ids = list(encoder.encode(part["text"].to_pylist()))
        shown = [decode(encoder.vocabulary, x) for x in ids]
        yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(shown, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, and what these ids decode to."""
    name = build_lexicon(docs, path)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(lambda it: _encoded(it, path, name), "doc_id long, n_tokens long, ids binary, decoded string")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """coded: ids as little-endian unsigned 32-bit integers, and any other columns. Adds decoded, or puts it in place of one of that name; null ids give null."""

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        vocabulary = vocabulary_at(path)
        return pa.array([decode(vocabulary, x) for x in ids.to_pylist()], pa.string())

    return coded.withColumn("decoded", decoded("ids"))
