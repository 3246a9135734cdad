"""Exact duplicates by deterministic block naming, as DataFrame expressions.

Every text is cut into blocks of BLOCK characters. Equal blocks get one integer, their place among the
sorted distinct blocks; then adjacent pairs of integers are named the same way, again and again, until each
document has one. Documents of equally many blocks with the same last name have the same text: names
stand for contents and not for hashes, so they never collide. Blocks are sorted by a hash first; where all distinct blocks of a hash
are one, the hash tells rows of that block as surely as its characters do, and only it is joined. Blocks that share a hash are told apart by their characters.

Texts are compared after each run of white space became one space. Defined cases: null text counts as
empty, and all empty texts are equal; rows with a null doc_id take part, and one stays only where its
group has no doc_id at all; rows that repeat a doc_id and text are told apart by nothing, so all of them
or none are kept by `find_copies`, and `keep_rows` leaves one of them; a very long text is as many blocks as it needs; an empty table gives an empty result;
other columns are not read by `find_copies` and kept by `keep_rows`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Characters of a block.
BLOCK = 2048
#: Hashed groups in which distinct blocks are sorted and numbered; the table of their sizes has as many rows.
BUCKETS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Adds `name`, an integer from 0, to distinct rows: their order by hashed bucket and then by content.

    Each bucket is sorted by itself, so no task sorts all rows, and the same contents get the same names in
    whichever way Spark has partitioned them.
    """
    bucketed = distinct.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"))
    sizes = bucketed.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(*by)) - 1
    return bucketed.withColumn("own", own).join(F.broadcast(firsts), "bucket").select(*by, (F.col("first") + F.col("own")).alias("name"))


def block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def named_blocks(rows: DataFrame) -> DataFrame:
    """rows: doc, text. doc, n_blocks, pos, name of every block of every text."""
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    rows = rows.select("doc", F.when(F.length("text") > 0, cut).otherwise(F.array(F.lit(""))).alias("blocks"))
    blocks = rows.select("doc", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block")).withColumn("hash", block_hash(F.col("block")))
    light = materialise(blocks.select("doc", "n_blocks", "pos", "hash"), "blocks")
    hashes = materialise(blocks.select("hash", "block").distinct().groupBy("hash").agg(F.count("*").alias("n")), "hashes")
    level = light.join(named(hashes.select("hash"), ["hash"]), "hash")
    shared = hashes.filter("n > 1").select("hash")
    if not shared.isEmpty():
        alike = materialise(blocks.join(shared, "hash", "left_semi"), "alike")
        names = named(alike.select("hash", "block").distinct(), ["hash", "block"]).withColumn("name", F.col("name") + hashes.count())
        level = level.join(shared, "hash", "left_anti").unionByName(alike.join(names, ["hash", "block"]).drop("block"))
    return level.select("doc", "n_blocks", "pos", "name")


def identities(rows: DataFrame) -> DataFrame:
    """rows: doc, a key of the row, and text. Gives doc, n_blocks, name; (n_blocks, name) is the same for equal texts and for no others."""
    level = materialise(named_blocks(rows), "level")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done, width = level.filter("n_blocks = 1").select("doc", "n_blocks", "name"), 1
    while width < most:
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = level.filter(F.col("n_blocks") > width).groupBy("doc", "n_blocks", half).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = named(pairs.select("left", "right").distinct(), ["left", "right"])
        level = materialise(pairs.join(names, ["left", "right"]).select("doc", "n_blocks", "pos", "name"), "level")
        width *= 2
        done = done.unionByName(level.filter(F.col("n_blocks") <= width).select("doc", "n_blocks", "name"))
    return done


def find_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    rows = materialise(keyed.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text", F.sha2("text", 256).alias("text_sha256")), "rows")
    found = identities(rows.select("doc", "text"))
    members = materialise(rows.drop("text").join(found, "doc").drop("doc"), "members")
    groups = members.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = members.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs without later copies, with its columns. Of rows that agree in doc_id and text one is left."""
    row = fresh("row", docs.columns)
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = identities(rows.select(F.col(row).alias("doc"), normalised(F.col("text")).alias("text")))
    ids = rows.select(F.col(row).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    members = materialise(found.join(ids, "doc"), "members")
    stays = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("stays")
    groups = members.groupBy("n_blocks", "name").agg(stays, F.count("*").alias("n")).filter("n > 1")
    gone = members.join(groups, ["n_blocks", "name"]).filter("doc <> stays.doc").select(F.col("doc").alias(row))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH normalised AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
), marked AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, sha256(text) AS text_sha256 FROM normalised
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM marked
"""
