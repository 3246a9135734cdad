"""Token counts of sections, by spans of tokens.

A document is encoded once, whole. Its tokens' spans are joined with its sections' spans as intervals, by binary
search in the sorted boundaries. A token inside one section is that section's. A token that crosses a boundary is
the section's that holds most of its bytes, and of equals the earlier one's; so a document's counts add up to its tokens.

Sections are lines; the white space from a line's break to the next line's first word belongs to the former. Defined cases: a null or empty text is one empty section with no tokens; a text of nothing but line breaks is
one section; rows are independent, so repeats and null doc_ids need no rule; a very long text is encoded whole in one task; an empty table gives an empty result; only
doc_id and text are read. Where a pair of bytes inside one character is split between tokens, each byte counts for itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: What ends a section.
SECTION = re.compile(rb"\n\s*")

_encodings: dict[tuple[str, str], tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding in a file of ranks, and the bytes of each of its tokens."""
    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(t) for t in ranks]
        _encodings[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path, pattern]


def sections(data: bytes) -> np.ndarray:
    """Where each section begins, and last the end of the text."""
    cuts = [m.end() for m in SECTION.finditer(data) if m.end() < len(data)]
    return np.array([0, *cuts, len(data)], np.int64)


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ends: of the tokens in order; bounds: of the sections. Of each section the tokens that are its own, and how many of them cross a boundary.

    A token's first and last byte each fall into one section. Where they differ, the section with most of the
    token's bytes is sought among those in between.
    """
    starts = np.r_[0, ends[:-1]]
    owner = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = np.flatnonzero(last > owner)
    for at in crossing.tolist():
        a, b = owner[at], last[at]
        held = np.minimum(bounds[a + 1 : b + 2], ends[at]) - np.maximum(bounds[a : b + 1], starts[at])
        owner[at] = a + int(held.argmax())
    n = len(bounds) - 1
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def _counted(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "section", "first_byte", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"]
    encode, sizes = encoding(path, pattern)
    for part in parts(batches):
        cells: list[list] = [[] for _ in names]
        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
            text = text or ""
            bounds = sections(text.encode("utf-8", "surrogatepass"))
            ends = np.cumsum(sizes[encode.encode_ordinary(text)]) if text else np.zeros(0, np.int64)
            n = len(bounds) - 1
            tokens, crossing = attribute(ends, bounds) if len(ends) else (np.zeros(n, np.int64),) * 2
            for cell, x in zip(cells, ([doc_id] * n, range(n), bounds[:-1].tolist(), np.diff(bounds).tolist(), tokens.tolist(), crossing.tolist(), [len(ends)] * n)):
                cell.extend(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names)


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, section, first_byte, n_bytes, n_tokens, n_crossing, doc_tokens: a row for every section of every document."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(lambda it: _counted(it, path, pattern), "doc_id long, section long, first_byte long, n_bytes long, n_tokens long, n_crossing long, doc_tokens long")
