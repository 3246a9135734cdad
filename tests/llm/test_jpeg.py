"""JPEG: round trips, a bit-by-bit decoder, and broken files."""

import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from spokeframe.llm import jpeg


def slow_decode(data):
    """One bit at a time, as the standard's flow charts go."""
    h = jpeg.parse(data)
    books = {}
    for key, table in h.tables.items():
        code, symbols, book = 0, list(table[16:]), {}
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                book[length, code] = symbols.pop(0)
                code += 1
            code <<= 1
        books[key] = book
    order, across, down = jpeg._units(h)
    body, parts, at = data[h.start : -2], [bytearray()], 0
    while at < len(body):
        if body[at] == 255 and 0xD0 <= body[at + 1] <= 0xD7:
            parts.append(bytearray())
            at += 2
        else:
            parts[-1].append(body[at])
            at += 2 if body[at] == 255 else 1
    out, units = [], across * down
    for n, part in enumerate(parts):
        bits = iter("".join(f"{b:08b}" for b in part))

        def symbol(book):
            code, length = 0, 0
            while (length, code) not in book:
                code, length = code * 2 + int(next(bits)), length + 1
            return book[length, code]

        def value(size):
            v = int("".join(next(bits) for _ in range(size)) or "0", 2)
            return v if not size or v >= 1 << (size - 1) else v - (1 << size) + 1

        before = [0] * len(h.scan)
        for _ in range(min(h.interval or units, units - n * (h.interval or units))):
            for c in order:
                block, k = [0] * 64, 1
                before[c] += value(symbol(books[h.scan[c][1]]))
                block[0] = before[c]
                while k < 64:
                    s = symbol(books[16 + h.scan[c][2]])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = value(s & 15)
                    k += 1
                out.append(block)
    return np.array(out)


def color_image(interval):
    """2 x 1 sampled colour image of 5 units with AC runs, written by hand."""
    rnd = random.Random(4)
    bits, data, blocks = "", b"", []

    def put(book, symbol, v, size):
        nonlocal bits
        code, length = book[symbol]
        bits += f"{code:0{length}b}" + (f"{v if v >= 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    def flush(mark):
        nonlocal bits, data
        bits += "1" * (-len(bits) % 8)
        data += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00") + mark
        bits = ""

    before = [0, 0, 0]
    for unit in range(5):
        for c in (0, 0, 1, 2):
            block = [rnd.randrange(-300, 300)] + [rnd.choice([0] * 30 + [1, -2, 90]) for _ in range(63)]
            blocks.append(block)
            diff = block[0] - before[c]
            before[c] = block[0]
            put(jpeg._DC, abs(diff).bit_length(), diff, abs(diff).bit_length())
            run = 0
            for k in range(1, 64):
                if block[k]:
                    while run > 15:
                        put(jpeg._AC, 0xF0, 0, 0)
                        run -= 16
                    size = abs(block[k]).bit_length()
                    put(jpeg._AC, run * 16 + size, block[k], size)
                    run = 0
                else:
                    run += 1
            if run:
                put(jpeg._AC, 0, 0, 0)
        if interval and (unit + 1) % interval == 0 and unit < 4:
            flush(bytes([255, 0xD0 + (unit // interval) % 8]))
            before = [0, 0, 0]
    flush(b"")
    seg = jpeg._segment
    frame = seg(0xC0, bytes([8, 0, 8, 0, 80, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head = seg(0xDB, bytes([0, 2] + [1] * 63)) + frame + seg(0xC4, jpeg._huffman(0, jpeg.DC_CODES)) + seg(0xC4, jpeg._huffman(16, jpeg.AC_CODES))
    if interval:
        head += seg(0xDD, bytes([0, interval]))
    return b"\xff\xd8" + head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("interval", [0, 1, 2])
def test_colour(interval):
    data, blocks = color_image(interval)
    (header, got), = jpeg.decode_images([data])
    assert (got == blocks).all() and (slow_decode(data) == blocks).all()
    luma = blocks.reshape(5, 4, 64)[:, :2, 0].reshape(1, 10)
    assert (jpeg.thumbnail(header, got) == np.clip(np.rint(luma * 2 / 8 + 128), 0, 255)).all()


def test_round_trip_and_slow_decoder():
    rnd = np.random.default_rng(1)
    payloads = [bytes(64), b"\x80" * 64, b"\x80" * 640, rnd.integers(0, 256, 64 * 70, dtype=np.uint8).tobytes(), rnd.choice([128] * 30 + [0, 255, 7], 64 * 50).astype(np.uint8).tobytes(), b"plain text here " * 40]
    files = jpeg.encode_images(payloads)
    for p, f, (header, blocks) in zip(payloads, files, jpeg.decode_images(files)):
        assert jpeg.payload_of(header, blocks) == p
        assert jpeg.encode_images([p]) == [f]
        assert (slow_decode(f) == blocks).all()
        thumb = jpeg.thumbnail(header, blocks).reshape(-1)[: len(p) // 64]
        assert thumb.tolist() == list(p[::64])


def test_broken_files():
    good = jpeg.encode_images([b"some text that is stored in this image " * 8 + b"." * 8])[0]
    start = jpeg.parse(good).start
    for bad in (b"", good[2:], good[:30], good[: start + 20] + b"\xff\xd9", good.replace(b"\xff\xd1", b""), good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.decode_images([bad])


def test_columns(spark, odd_docs, no_docs):
    assert jpeg.read_media(jpeg.store_texts(no_docs)).count() == 0
    want = []
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(64 if not raw else -len(raw) % 64)
        want.append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    stored = jpeg.store_texts(odd_docs)
    got = jpeg.read_media(stored).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert sorted(hashlib.sha256(r.media).hexdigest() for r in stored.collect()) == sorted(r.media_sha256 for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


@pytest.mark.parametrize("size", [40, 200, 3000])
def test_ranges_give_what_the_whole_gives(monkeypatch, size):
    rnd = np.random.default_rng(2)
    payloads = [rnd.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 9, 33)] + [b"plain text here " * 400, b"\x7f" * 64 * 30]
    whole = jpeg.encode_images(payloads)
    colour = [color_image(k)[0] for k in (0, 1, 2)]
    decoded = [jpeg.decode_images([f])[0] for f in whole + colour]
    monkeypatch.setattr(jpeg, "SLICE", size)
    if size >= 64:
        assert [jpeg.encode_image(p) for p in payloads] == whole
    for f, (header, blocks) in zip(whole + colour, decoded):
        header_, ranges = jpeg.decode_ranges(f)
        assert header_ == header and (np.concatenate(list(ranges)) == blocks).all()
    for f, (header, blocks), p in zip(whole, decoded, payloads):
        found = jpeg.features(f, *jpeg.decode_ranges(f))
        assert found == jpeg.features(f, header, [blocks]) and found[:2] == (len(p), hashlib.sha256(p).hexdigest())
        with pytest.raises(ValueError):
            list(jpeg.decode_ranges(f[: max(jpeg.parse(f).start, len(f) - 9)])[1])


def test_thumbnail_hash_reads_every_pixel():
    rnd = np.random.default_rng(3)
    image = rnd.integers(100, 140, (40, 45)).astype(np.uint8)
    cells = np.array([[image[y * 5 : y * 5 + 5, x * 5 : x * 5 + 5].mean() for x in range(9)] for y in range(8)])
    want = int("".join("1" if cells[y, x] < cells[y, x + 1] else "0" for y in range(8) for x in range(8)), 2)
    assert jpeg.difference_hash(image) == want
    image[:, 6:10] = 255
    assert jpeg.difference_hash(image) != want
    assert jpeg.difference_hash(np.array([[7]], np.uint8)) == 0 and jpeg.difference_hash(np.array([[1, 2]], np.uint8)) == int("00001000" * 8, 2)


def test_a_text_of_50_mb_takes_little_memory():
    code = """
import hashlib, resource
from spokeframe.llm import jpeg
payload = b"some words of a very long text, again and again.".ljust(64) * 800_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
file = jpeg.encode_image(payload)
found = jpeg.features(file, *jpeg.decode_ranges(file))
assert found[:2] == (len(payload), hashlib.sha256(payload).hexdigest())
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True)
    assert int(out.stdout) < 800, out.stdout
