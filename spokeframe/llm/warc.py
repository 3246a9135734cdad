"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

`write_archives` writes pages as records into files under a shared folder; `read_archives` reads such files from any
store that Spark reads. A file begins with a skippable frame that holds its dictionary, itself a zstandard frame
or bare; each record is one frame, decoded by itself with that dictionary. Headers, lengths and digests are checked:
a file that breaks a rule raises ValueError with its name and the place.

Of records with equal payloads of LEAST bytes at least, the one with the largest page_id is the response, and the others
are revisits that refer to it; smaller ones are all responses. Defined cases: null html is an empty payload; a
null page_id stays null, and a group of none but nulls has no revisits; rows that repeat the largest page_id are all
responses; a null url becomes URN_NONE; control characters in a url are percent-encoded in the record; very long html is one record, held whole
in one task; an empty table makes no archive and an empty result; other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Payloads of fewer bytes are stored again each time.
LEAST = 1000
#: Bytes of records after which a file is closed; readers hold a file at a time.
FILE_BYTES = 16_000_000
#: Records that a file's dictionary is trained on, and its largest size.
TRAINED_ON, DICTIONARY_BYTES = 200, 16_384
LEVEL = 3
#: Bytes of a file that a frame is first sought in, doubled until it ends: what is left over is copied, so it must not be the whole file.
STEP = 4096
# Fixed values of the format: magic numbers of a frame and of the dictionary's skippable frame, and header names.
FRAME, SKIPPABLE = b"\x28\xb5\x2f\xfd", 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN_NONE = "urn:none"
DATE = "2024-01-01T00:00:00Z"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the response of page `refers_to`, whose block ends after the HTTP header."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or URN_NONE
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if refers_to is not None:
        lines += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", PROFILE), ("Refers-To-Page", str(refers_to))]
    if page_id is not None:
        lines.append(("Page", str(page_id)))
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass")
    return head + b"\r\n" + block + b"\r\n\r\n"


def make_archive(records: list[bytes]) -> bytes:
    some = records[:TRAINED_ON]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in some]).as_bytes()
    except zstandard.ZstdError:  # too few or too small records to train on
        dictionary = b"".join(r[:1024] for r in some[:8]) + VERSION
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(stored)) + stored + b"".join(map(pack.compress, records))


def load_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, if there is one, and where records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    raw = data[8 : 8 + size]
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut short")
    if raw[:4] == FRAME:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind), 8 + size


def frames(data: bytes) -> Iterator[bytes]:
    """What each frame holds, one at a time."""
    dictionary, at = load_dictionary(data)
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        kind = struct.unpack_from("<I", data, at)[0] if len(data) >= at + 8 else 0
        if 0x184D2A50 <= kind <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if data[at : at + 4] != FRAME:
            raise ValueError(f"no frame at byte {at}")
        frame, held, end, step = unpack.decompressobj(), [], at, STEP
        try:
            while not frame.eof and end < len(data):
                held.append(frame.decompress(view[end : end + step]))
                end, step = min(len(data), end + step), 2 * step
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at byte {at}: {e}") from None
        if not frame.eof:
            raise ValueError(f"the frame at byte {at} is cut short")
        at = end - len(frame.unused_data)
        yield b"".join(held)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block. Checks version, needed headers, length and what ends the record."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("the header has no end")
    version, *lines = data[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", version):
        raise ValueError(f"unknown version {version[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise ValueError(f"broken header line {line[:40]!r}")
        headers[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
    if missing := [n for n in NEEDED if n not in headers]:
        raise ValueError(f"missing headers {missing}")
    if headers["warc-type"] not in TYPES:
        raise ValueError(f"unknown type {headers['warc-type']}")
    if not headers["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    block, rest = data[end + 4 : end + 4 + size], data[end + 4 + size :]
    if len(block) != size or rest != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, but the record holds {len(data) - end - 8}")
    if (digest := headers.get("warc-block-digest")) and digest != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block does not have its digest")
    return headers, block


def parse_page(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes]:
    """page_id, url, payload's length and digest, type, refers_to, and the payload that the record itself holds."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^Content-Length: (\d+)\r?$", http)
    if not gap or not length:
        raise ValueError("no HTTP header with a length")
    digest = base64.b32decode(headers.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    kind, size = headers["warc-type"], int(length[1])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not have its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE):
        raise ValueError("a revisit must have no payload and refer to a record")
    page, refers = headers.get("page"), headers.get("refers-to-page")
    url = headers.get("warc-target-uri")
    return int(page) if page else None, None if url == URN_NONE else url, size, digest, kind, int(refers) if refers else None, payload


def _assigned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to. The payload's own table of repeats has only digests that come again."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    repeats = rows.filter(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeats = materialise(repeats, "repeats")
    joined = rows.join(repeats, ["digest", "size"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("of") != F.coalesce("page_id", F.lit(-(1 << 62))), F.col("of")).alias("refers_to"))


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    part, records, size, number = TaskContext.get().partitionId(), [], 0, 0

    def close() -> pa.RecordBatch:
        """Files appear under their names whole, and a task that runs again writes the same ones."""
        nonlocal records, size, number
        name = f"part-{part:06d}-{number:04d}.warc.zst"
        data = make_archive(records)
        hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            f.write(data)
        store.move(hidden, f"{path}/{name}")
        done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], ["name", "records", "bytes"])
        records, size, number = [], 0, number + 1
        return done

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            for page in batch.slice(at, 100).to_pylist():
                records.append(make_record(page["page_id"], page["url"], page["html"].encode("utf-8", "surrogatepass"), page["digest"], page["refers_to"]))
                size += len(records[-1])
                if size >= FILE_BYTES:
                    yield close()
    if records:
        yield close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each page to files in the folder, a URI that all executors reach; gives name, records, bytes of each file."""
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    rows = _assigned(pages).sortWithinPartitions("page_id", "digest", "url")
    return materialise(rows.mapInArrow(lambda it: _write(it, folder), "name string, records long, bytes long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            rows, n = [], 0
            try:
                for n, frame in enumerate(frames(data)):
                    rows.append(parse_page(*parse_record(frame)))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
            except ValueError as e:
                raise ValueError(f"{path}, record {n}: {e}") from None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def check_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """Raises ValueError where a file of the manifest is not in the folder or has another length, or the folder holds one that the manifest lacks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder) if not manifest.isEmpty() else None
    if files is None:
        return
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    wrong = manifest.select("name", "bytes").join(there, F.col("name") == F.col("file"), "full").filter("name is null or file is null or length <> bytes").limit(5).collect()
    if wrong:
        raise ValueError(f"archives do not agree with their manifest: {[r['name'] or r['file'] for r in wrong]}")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (empty for revisits) of every record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = shared_dir(spark) + "/warc"
    check_archives(spark, folder, write_archives(pages, folder))
    return read_archives(spark, folder).drop("payload", "url")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages
), r AS (
  SELECT page_id, size, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= {LEAST} AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= {LEAST} AND last <> page_id THEN last END AS refers_to
FROM r
"""
