"""Shards by jump consistent hashing, as DataFrame expressions.

A document's shard depends on its doc_id and the number of shards alone, so no table of the
ring is kept; with one shard more, a document either stays or goes to the new shard.

Defined cases: a null doc_id hashes as key 0; a null text has size 1 and the CRC of no bytes;
equal doc_ids share a shard; repeated rows get slots of their own; a very long text is its size and CRC from the first step on; an empty table gives an empty result; other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, times

# Multiplier of the generator in the published jump hash, and its modulus.
MULTIPLIER = 2862933555777941757
MODULUS = 1 << 64

#: Hexadecimal digits of a chunk, a group that the rows of one shard are numbered in; the table of their sizes has CHUNKS rows a shard.
CHUNK_DIGITS = 3
CHUNKS = 16**CHUNK_DIGITS


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, that the published algorithm gives an unsigned 64-bit key.

    The generator steps modulo 2**64 in decimal(38), which holds every product exactly. A step
    always moves to a later candidate, so as many steps as there are shards suffice.
    """
    wide = "decimal(38,0)"
    start = F.struct(
        F.pmod(key.cast(wide), F.lit(str(MODULUS)).cast(wide)).cast("decimal(20,0)").alias("state"),
        F.lit(-1).cast("long").alias("held"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(acc: Column, _: Column) -> Column:
        grown = acc["state"].cast("decimal(20,0)") * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")
        state = F.pmod(grown.cast(wide) + F.lit(1).cast(wide), F.lit(str(MODULUS)).cast(wide)).cast("decimal(20,0)")
        top = F.floor(state / F.lit(str(1 << 33)).cast("decimal(10,0)")).cast("double") + 1.0
        there = F.floor((acc["next"].cast("double") + 1.0) * (float(1 << 31) / top)).cast("long")
        return F.when(
            acc["next"] < shards,
            F.struct(state.alias("state"), acc["next"].alias("held"), there.alias("next")),
        ).otherwise(acc)

    steps = F.array(*[F.lit(i) for i in range(shards)])
    return F.aggregate(steps, start, step, lambda acc: acc["held"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots are gapless in each shard: rows go by chunk, id (null first), CRC and size. Alike rows are one row with their
    number until the end, and chunks follow id and text, so neither a common id nor a common text fills one;
    the chunks' sizes, shards * CHUNKS rows at most, give each chunk its first slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = light.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.coalesce("doc_id", F.lit(0))
    chunk = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.col("text_crc32").cast("string")).cast("binary")), 1, CHUNK_DIGITS)
    rows = materialise(alike.withColumns({"shard": jump_hash(key, shards), "grown_shard": jump_hash(key, shards + 1), "chunk": chunk}), "rows")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("shard", "chunk").agg(F.sum("n").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return times(numbered.join(firsts, ["shard", "chunk"]), "n").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("own") + F.col("copy")).cast("long").alias("slot"),
        "grown_shard",
    )


def _oracle(shards: int = 8) -> str:
    """The published loop, a step a table, on 128-bit integers; CRC-32 byte by byte with its table from the rule."""
    crc_table = "list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda c, u: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)))"
    steps = []
    for n in (shards, shards + 1):
        of = f"(SELECT key, CAST(CASE WHEN key < 0 THEN CAST(key AS HUGEINT) + {MODULUS} ELSE key END AS HUGEINT) AS state, CAST(-1 AS BIGINT) AS held, CAST(0 AS BIGINT) AS next FROM keys)"
        for _ in range(n):
            grown = f"((state * {MULTIPLIER} + 1) % {MODULUS})"
            of = f"(SELECT key, {grown} AS state, CASE WHEN next < {n} THEN next ELSE held END AS held, CASE WHEN next < {n} THEN CAST(floor((next + 1) * (2147483648e0 / (CAST({grown} // 8589934592 AS DOUBLE) + 1e0))) AS BIGINT) ELSE next END AS next FROM {of})"
        steps.append(f"jump{n} AS (SELECT key, CAST(held AS INTEGER) AS shard FROM {of})")
    return f"""
WITH crc AS (SELECT {crc_table} AS t), texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS (SELECT text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), CAST(4294967295 AS BIGINT)) AS crc FROM texts, crc),
d AS (SELECT doc_id, CAST(octet_length(encode(crcs.text)) + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, CAST(coalesce(doc_id, 0) AS BIGINT) AS key FROM documents JOIN crcs ON crcs.text = coalesce(documents.text, '')),
keys AS (SELECT DISTINCT key FROM d), {", ".join(steps)}
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard, CAST(row_number() OVER (PARTITION BY a.shard ORDER BY substr(md5(d.key || ':' || text_crc32), 1, {CHUNK_DIGITS}), doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, b.shard AS grown_shard
FROM d JOIN jump{shards} a ON a.key = d.key JOIN jump{shards + 1} b ON b.key = d.key"""


ORACLE_SQL = _oracle()
