"""Baseline JPEG columns: lossless storage of bytes as coefficients, and features read back from the stored form.

`encode_images` writes grayscale baseline JPEG: each 64 bytes of a payload become one 8x8 block whose quantised
coefficients, in zigzag order, are the bytes less 128, so decoding gives them back exactly. With a DC
quantiser of 8 a block's mean luminance is its first byte. Every block is a restart interval. `decode_images`
parses the markers of any baseline file, Huffman-decodes all restart intervals of a batch, or of a range of a long file, in
step (numpy works on one symbol of each interval at a time), and returns coefficients; `thumbnail` reads the
luminance of each block from its DC coefficient.

Defined cases for the columns: a null text is an empty one; the empty payload is padded to one block; equal texts
have equal values; rows are independent, so repeats and null doc_ids need no rule; an image near a square keeps both
sides under 65,536 pixels for texts up to 4 GB; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: Payload bytes that are encoded, and media bytes that are decoded, at a time.
SLICE = 500_000
#: Rows of blocks in 65,535 pixels.
TALLEST = 8191
END_OF_BLOCK, SIXTEEN_ZEROS = 0x00, 0xF0
#: Symbols by code length, by rule: values without zeros before them are frequent, all others are not.
DC_CODES = {4: list(range(12))}
AC_CODES = {4: [*range(1, 9), END_OF_BLOCK], 8: [SIXTEEN_ZEROS, 9, 10], 11: [run * 16 + bits for run in range(1, 16) for bits in range(1, 11)]}


def canonical(codes: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length): codes of one length count on, and double where the length grows."""
    out, code = {}, 0
    for length in range(1, 17):
        for symbol in codes.get(length, []):
            out[symbol] = (code, length)
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, codes: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(codes.get(n, [])) for n in range(1, 17)) + bytes(s for n in sorted(codes) for s in codes[n])


_TABLES = _segment(0xDB, bytes([0, 8] + [1] * 63)), _segment(0xC4, _huffman(0x00, DC_CODES)) + _segment(0xC4, _huffman(0x10, AC_CODES)) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
_DC, _AC = canonical(DC_CODES), canonical(AC_CODES)
_DC_CODE, _DC_LEN = (np.array([_DC[s][i] for s in range(12)], np.uint64) for i in (0, 1))
_AC_CODE, _AC_LEN = (np.array([_AC.get(s, (0, 0))[i] for s in range(256)], np.uint64) for i in (0, 1))
_BITS = np.array([abs(v).bit_length() for v in range(-128, 128)], np.uint64)


def shape(blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks for an image with `blocks` of them: near a square."""
    columns = max(math.isqrt(blocks - 1) + 1, -(-blocks // TALLEST))
    return columns, -(-blocks // columns)


def _scan(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values: (blocks, 64) coefficients from -128 to 127. Bytes of the blocks' intervals on end, without markers, and each one's number of bytes."""
    some = values != 0
    some[:, 0] = True
    at = np.flatnonzero(some)
    k, block = at & 63, at >> 6
    v = values.reshape(-1)[at].astype(np.int64)
    bits = _BITS[v + 128]
    low = np.where(v < 0, v + (1 << bits.astype(np.int64)) - 1, v).astype(np.uint64)
    run = np.diff(at, prepend=0) - 1
    zeros = np.where(k == 0, 0, run >> 4).astype(np.uint64)
    symbol = np.where(k == 0, 0, (run & 15) << 4) + bits.astype(np.int64)
    code = np.where(k == 0, _DC_CODE[bits], _AC_CODE[symbol])
    length = np.where(k == 0, _DC_LEN[bits], _AC_LEN[symbol])
    word, size = (code << bits) | low, length + bits
    if zeros.any():
        for n in (1, 2, 3):
            more = zeros >= n
            word[more] |= np.uint64(_AC[SIXTEEN_ZEROS][0]) << size[more]
            size[more] += np.uint64(_AC[SIXTEEN_ZEROS][1])
    last = np.flatnonzero(np.r_[block[1:] != block[:-1], True])
    short = last[k[last] < 63]
    word[short] = (word[short] << np.uint64(_AC[END_OF_BLOCK][1])) | np.uint64(_AC[END_OF_BLOCK][0])
    size[short] += np.uint64(_AC[END_OF_BLOCK][1])
    total = np.add.reduceat(size, np.r_[0, last[:-1] + 1])
    pad = (-total.astype(np.int64)) % 8
    word[last] = (word[last] << pad.astype(np.uint64)) | ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1))
    size[last] += pad.astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    place, shift = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
    high = word << (np.uint64(64) - size)
    out = np.zeros(int(end[-1] >> np.uint64(6)) + 2, np.uint64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    out[place[first]] = np.bitwise_or.reduceat(high >> shift, first)
    over = np.flatnonzero(shift + size > 64)
    out[place[over] + 1] |= high[over] << (np.uint64(64) - shift[over])
    return np.frombuffer(out.astype(">u8").tobytes(), np.uint8)[: int(end[-1]) // 8], ((total.astype(np.int64) + pad) // 8)


def _marked(data: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """data: whole blocks; number: each one's place in its image. The blocks' intervals with a restart marker after each, and where each begins and ends."""
    scan, sizes = _scan((data.astype(np.int16) - 128).reshape(-1, 64))
    width = 1 + (scan == 255)
    last = np.cumsum(sizes) - 1
    width[last] += 2
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[place] = scan
    mark = place[last] + 1 + (scan[last] == 255)
    out[mark], out[mark + 1] = 0xFF, 0xD0 + (number & 7)
    return out.tobytes(), place[last + 1 - sizes], mark


def _file(payload: int, columns: int, rows: int, *scan: bytes) -> bytes:
    frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * columns, 1, 1, 0x11, 0))
    return b"".join([b"\xff\xd8", _segment(0xFE, b"payload bytes: %d" % payload), _TABLES[0], frame, _TABLES[1], *scan, b"\xff\xd9"])


def encode_images(payloads: list[bytes]) -> list[bytes]:
    """One file each; a payload's length is a positive multiple of 64."""
    shapes = [shape(len(p) // 64) for p in payloads]
    full = np.array([c * r for c, r in shapes])
    data = np.frombuffer(b"".join(p + b"\x80" * (64 * n - len(p)) for p, n in zip(payloads, full.tolist())), np.uint8)
    first = np.cumsum(full) - full
    whole, starts, ends = _marked(data, np.arange(int(full.sum())) - np.repeat(first, full))
    return [_file(len(p), *of, whole[a:b]) for of, p, a, b in zip(shapes, payloads, starts[first].tolist(), ends[first + full - 1].tolist())]


def encode_image(payload: bytes) -> bytes:
    """The file that `encode_images` makes of this payload, SLICE bytes of it at a time."""
    columns, rows = shape(len(payload) // 64)
    pieces, total, step = [], columns * rows, SLICE // 64
    for at in range(0, total, step):
        n = min(step, total - at)
        data = payload[at * 64 : (at + n) * 64]
        pieces.append(_marked(np.frombuffer(data + b"\x80" * (64 * n - len(data)), np.uint8), np.arange(at, at + n))[0])
    pieces[-1] = pieces[-1][:-2]
    return _file(len(payload), columns, rows, *pieces)


@dataclass
class Header:
    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantiser
    quantisers: dict[int, list[int]]
    tables: dict[int, bytes]  # class * 16 + id: counts and symbols
    scan: list[tuple[int, int, int]]  # component's place, DC table, AC table
    interval: int
    comment: bytes
    start: int


def parse(data: bytes) -> Header:
    """Markers up to the scan. Raises ValueError for what is not a baseline file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    h = Header(0, 0, [], {}, {}, [], 0, b"", 0)
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("a segment is cut short")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                h.quantisers[body[0] & 15] = [int.from_bytes(body[1 + i * wide : 1 + (i + 1) * wide], "big") for i in range(64)]
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                h.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            h.height, h.width = struct.unpack(">HH", body[1:5])
            h.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            h.interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            h.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in h.components]
            h.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(h.scan) != len(h.components):
                raise ValueError("all components must be in one scan")
            h.start = at
            return h


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    out, code, symbols = np.zeros(1 << 16, np.int32), 0, list(table[16:])
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbols.pop(0)
            code += 1
        code <<= 1
    return out


_lookups: dict[bytes, np.ndarray] = {}


def _units(h: Header) -> tuple[list[int], int, int]:
    """Places in the scan of the blocks of a unit, and how many units there are across and down."""
    if len(h.scan) == 1:
        return [0], -(-h.width // 8), -(-h.height // 8)
    across, down = max(c[1] for c in h.components), max(c[2] for c in h.components)
    order = [i for i, (c, _, _) in enumerate(h.scan) for _ in range(h.components[c][1] * h.components[c][2])]
    return order, -(-h.width // (8 * across)), -(-h.height // (8 * down))


def _decode_alike(files: list[bytes], headers: list[Header]) -> list[np.ndarray]:
    """Files with the same tables and scan layout: of each, its blocks' coefficients (blocks, 64) in the order of the scan."""
    h = headers[0]
    order = _units(h)[0]
    units = [_units(x)[1] * _units(x)[2] for x in headers]
    tables = [h.tables[k] for _, dc, ac in h.scan for k in (dc, 16 + ac)]
    for t in tables:
        if t not in _lookups:
            _lookups[t] = _lookup(t)
    lut = np.concatenate([_lookups[t] for t in tables])
    data = np.frombuffer(b"".join(f[x.start :] for f, x in zip(files, headers)), np.uint8)
    starts = np.cumsum([0] + [len(f) - x.start for f, x in zip(files, headers)])
    after = np.flatnonzero(data[:-1] == 255) + 1
    kind = data[after]
    keep = np.ones(len(data), bool)
    keep[after[kind == 0]] = False
    marks = after[(kind >= 0xD0) & (kind <= 0xD9)]
    keep[marks] = keep[marks - 1] = False
    restarts = marks[data[marks] < 0xD8] + 1
    offset = np.cumsum(keep) - keep
    begin = np.sort(np.concatenate([starts[:-1], restarts]))
    image = np.searchsorted(starts, begin, "right") - 1
    per = np.array([x.interval or n for x, n in zip(headers, units)])
    nth = np.arange(len(begin)) - np.searchsorted(begin, starts[:-1])[image]
    n_units = np.array(units)
    count = np.minimum(per[image], n_units[image] - nth * per[image])
    if (count <= 0).any() or (np.bincount(image, count, len(files)) != n_units).any():
        raise ValueError("restart intervals do not cover the image")
    clean = np.concatenate([data[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
    windows = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    per_unit = len(order)
    base = np.cumsum(n_units) - n_units
    first = (base[image] + nth * per[image]) * per_unit
    out = np.zeros(int(n_units.sum()) * per_unit * 64, np.int16)
    bit = offset[begin].astype(np.int64) * 8
    limit = (len(clean) - 8) * 8
    k, done, blocks = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), count * per_unit
    before = np.zeros((len(begin), len(h.scan)), np.int64)
    comp_of = np.array(order)
    live = np.arange(len(begin))
    while len(live):
        dc = k == 0
        comp = comp_of[done % per_unit] if per_unit > 1 else 0
        peek = (windows[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        found = lut[(comp * 2 + ~dc) * 65536 + peek]
        if (found == 0).any():
            raise ValueError("bits that are no code")
        bit = bit + (found >> 8)
        symbol = found & 255
        size, run = symbol & 15, symbol >> 4
        raw = (windows[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        value = (raw >> (16 - size).astype(np.uint32)).astype(np.int64)
        value = np.where((size > 0) & (value < (1 << size) >> 1), value - (1 << size) + 1, value)
        bit = bit + size
        if (bit > limit).any():
            raise ValueError("the scan is cut short")
        if dc.any():
            c = comp if per_unit > 1 else np.zeros(len(live), np.int64)
            before[live[dc], c[dc]] += value[dc]
            value[dc] = before[live[dc], c[dc]]
        k = np.where(dc, 0, k + run)
        write = dc | (size > 0)
        if (k[write] > 63).any():
            raise ValueError("too many coefficients")
        out[((first[live] + done) * 64 + k)[write]] = value[write]
        # Zero size: the block ends, or sixteen zeros went by, of which `run` are counted above.
        ends = ~dc & (size == 0) & (run < 15)
        k = np.where(ends, 64, k + 1)
        over = k > 63
        done, k = done + over, np.where(over, 0, k)
        more = done < blocks[live]
        if not more.all():
            live, bit, k, done = live[more], bit[more], k[more], done[more]
    cuts = np.cumsum(n_units * per_unit)[:-1]
    return np.split(out.reshape(-1, 64), cuts)


def decode_images(files: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Of each file its header and its blocks' coefficients in the order of the scan."""
    headers = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(headers):
        groups.setdefault((tuple(sorted(h.tables.items())), tuple(h.scan), tuple(h.components)), []).append(i)
    out: list = [None] * len(files)
    for some in groups.values():
        for i, blocks in zip(some, _decode_alike([files[i] for i in some], [headers[i] for i in some])):
            out[i] = (headers[i], blocks)
    return out


def decode_ranges(data: bytes) -> tuple[Header, Iterator[np.ndarray]]:
    """A file's header and its blocks' coefficients in the order of the scan, some SLICE bytes of its restart intervals at a time; without intervals, all at once."""
    header = parse(data)
    order, across, down = _units(header)
    if not header.interval or len(data) <= SLICE:
        return header, iter([_decode_alike([data], [header])[0]])
    wide, tall = (max(c[k] for c in header.components) if len(header.scan) > 1 else 1 for k in (1, 2))

    def ranges() -> Iterator[np.ndarray]:
        view, at, left = np.frombuffer(data, np.uint8), header.start, across * down
        while left > 0:
            cut = look = at
            intervals = 0
            while (look - at < SLICE or not intervals) and intervals * header.interval < left:
                window = view[look : look + SLICE + 2]
                after = np.flatnonzero(window[:-1] == 255) + 1
                marks = after[(window[after] >= 0xD0) & (window[after] <= 0xD9)] + look
                if len(marks):
                    cut, intervals = int(marks[-1]) + 1, intervals + len(marks)
                    look = cut
                elif look + len(window) < len(view):
                    look += len(window) - 1
                else:
                    raise ValueError("the scan is cut short")
            units = min(left, intervals * header.interval)
            part = replace(header, width=8 * wide * units, height=8 * tall, start=0)
            # The marker that ends the range opens no interval of it.
            yield _decode_alike([data[at : cut - 2] + b"\xff\xd9"], [part])[0]
            at, left = cut, left - units

    return header, ranges()


def thumbnail_of(header: Header, dc: np.ndarray) -> np.ndarray:
    """dc: the DC coefficients of all blocks in the order of the scan. Mean luminance of each 8x8 block of the first component: (rows, columns), 0 to 255."""
    order, across, down = _units(header)
    c, quantiser = header.scan[0][0], header.components[header.scan[0][0]][3]
    wide, tall = (header.components[c][1], header.components[c][2]) if len(header.scan) > 1 else (1, 1)
    own = dc.reshape(down, across, len(order))[:, :, : wide * tall].reshape(down, across, tall, wide)
    dc = own.transpose(0, 2, 1, 3).reshape(down * tall, across * wide)
    dc = dc[: -(-header.height // 8), : -(-header.width // 8)]
    return np.clip(np.rint(dc.astype(np.float64) * header.quantisers[quantiser][0] / 8 + 128), 0, 255).astype(np.uint8)


def thumbnail(header: Header, blocks: np.ndarray) -> np.ndarray:
    return thumbnail_of(header, blocks[:, 0])


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each cell of 8 x 9 is darker than the next of its row. A cell is the mean of its area, so all pixels count; of fewer pixels, cells share them."""
    (rows, columns), sums = image.shape, image.astype(np.int64)
    tops, lefts = (np.arange(8) * rows) // 8, (np.arange(9) * columns) // 9
    sums = np.add.reduceat(np.add.reduceat(sums, tops, axis=0), lefts, axis=1)
    count = np.maximum(1, np.diff(tops, append=rows))[:, None] * np.maximum(1, np.diff(lefts, append=columns))[None, :]
    darker = sums[:, :-1] * count[:, 1:] < sums[:, 1:] * count[:, :-1]
    return int.from_bytes(np.packbits(darker).tobytes(), "big")


def _payload(blocks: np.ndarray) -> bytes:
    return (blocks.reshape(-1) + 128).astype(np.uint8).tobytes()


def payload_size(header: Header) -> int:
    return int(header.comment.rsplit(b" ", 1)[1])


def payload_of(header: Header, blocks: np.ndarray) -> bytes:
    return _payload(blocks)[: payload_size(header)]


def features(data: bytes, header: Header, ranges: Iterable[np.ndarray]) -> tuple:
    """What is read back from a file whose blocks come range by range: payload bytes, their SHA-256, the CRC of the last 64, media bytes, their SHA-256, feature, width, height, thumbnail hash."""
    sha, left, tail, dc = hashlib.sha256(), payload_size(header), b"", []
    for blocks in ranges:
        payload = _payload(blocks)[:left]
        sha.update(payload)
        left -= len(payload)
        tail = (tail + payload[-64:])[-64:]
        dc.append(blocks[:, 0].copy())
    look = f"{difference_hash(thumbnail_of(header, np.concatenate(dc))):016x}"
    return payload_size(header), sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), f"{header.width}x{header.height}:{look}", header.width, header.height, look


def _slices(items: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of items of SLICE bytes together; a longer one is by itself."""
    start = total = 0
    for i, x in enumerate(items):
        if i > start and total + len(x) > SLICE:
            yield start, i
            start, total = i, 0
        total += len(x)
    if items:
        yield start, len(items)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 500):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
        for a, b in _slices(raw):
            padded = [x + bytes(64 - len(x) if not x else -len(x) % 64) for x in raw[a:b]]
            media = encode_images(padded) if b - a > 1 or len(padded[0]) <= SLICE else [encode_image(padded[0])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(map(len, raw[a:b]), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a JPEG file."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumbnail_hash"]
    for batch in parts(batches, 500):
        media = batch["media"].to_pylist()
        for a, b in _slices(media):
            if b - a > 1 or len(media[a]) <= SLICE:
                found = [features(data, header, [blocks]) for data, (header, blocks) in zip(media[a:b], decode_images(media[a:b]))]
            else:
                found = [features(media[a], *decode_ranges(media[a]))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["n_bytes"].slice(a, b - a), *map(pa.array, zip(*found))], names)


def read_media(stored: DataFrame) -> DataFrame:
    """Features of each stored file, from its own bytes."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, thumbnail_hash string")
