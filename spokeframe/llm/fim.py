"""Fill-in-middle: documents with a middle of whole lines moved to the end.

Each Arrow batch is registered as a table of a DuckDB inside its task, and SQL cuts, orders and hashes the texts; no
row is a Python object. The hash of a document's id decides where it is cut and which form it gets, so reruns agree and
rows are independent.

Defined cases: a null text is empty, an empty one or one with a marker in it stays plain; a null doc_id is hashed as no digits;
equal ids are cut by the same numbers; repeated rows need no rule; a text without a line break is one line, a break at the end
begins no further one; very long texts are cut whole, a part of PART rows or of PART_BYTES of Arrow data at a time; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows and bytes of Arrow data that DuckDB gets at a time, and what it may hold.
PART, PART_BYTES, MEMORY = 2000, 4 << 20, "1GB"


def _cut_sql(seed: int, rate: int, spm: int) -> str:
    """doc_id, n, form, prefix_chars, middle_chars, output of the rows of `batch`."""
    word = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
lines AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM texts),
counted AS (SELECT *, CAST(len(units) AS BIGINT) AS n FROM lines),
cuts AS (SELECT *, {word(0)} % (n + 1) AS i, {word(1)} % (n + 1) AS j,
 CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {word(2)} % 100 >= {rate} THEN 'plain' WHEN {word(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM counted),
pieces AS (SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, least(i, j)), '') AS p, array_to_string(list_slice(units, least(i, j) + 1, greatest(i, j)), '') AS m, array_to_string(list_slice(units, greatest(i, j) + 1, n), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output
FROM pieces"""


def _restore_sql(columns: str) -> str:
    """`columns` and the text of the rows of `batch`, from output and form alone. No text in a form has a marker of its own."""
    second, swap = f"CASE form WHEN 'psm' THEN instr(output, '{SUFFIX}') ELSE instr(output, '{PREFIX}') END", f"instr(output, '{MIDDLE}')"
    first, other, last = f"substr(output, {len(PREFIX) + 1}, b - {len(PREFIX) + 1})", f"substr(output, b + {len(SUFFIX)}, c - b - {len(SUFFIX)})", f"substr(output, c + {len(MIDDLE)})"
    return f"""
WITH found AS (SELECT *, {second} AS b, {swap} AS c FROM batch)
SELECT {columns}, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {first} || {last} || {other} ELSE {other} || {last} || {first} END AS text FROM found"""


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of PART rows at most and about PART_BYTES."""
    rows = max(1, min(PART, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _run(batches: Iterator[pa.RecordBatch], *steps: str) -> Iterator[pa.RecordBatch]:
    """Each batch through the statements, each of which reads the one before as `batch`."""
    with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as db:
        for part in (p for b in batches for p in _pieces(b)):
            table = pa.Table.from_batches([part])
            for sql in steps:
                db.register("batch", table)
                table = db.sql(sql).to_arrow_table()
            db.unregister("batch")
            yield from table.to_batches()


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: `rate` % of the documents in a form, `spm` % of those suffix first."""
    sql = _cut_sql(seed, rate, spm)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(lambda it: _run(it, sql), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """doc_id, text of rows with output and form, as fill_in_middle gives them."""
    return rows.select("doc_id", "form", "output").mapInArrow(lambda it: _run(it, _restore_sql("doc_id")), "doc_id long, text string")


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """What fill_in_middle gives, with hashes in place of the output and of the text rebuilt from it; one pass through Arrow."""
    kept = "doc_id, n, form, prefix_chars, middle_chars"
    hashed = f"SELECT {kept}, output_sha256, sha256(text) AS restored_sha256 FROM batch"
    steps = [_cut_sql(seed, rate, spm), _restore_sql(f"{kept}, sha256(output) AS output_sha256"), hashed]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(lambda it: _run(it, *steps), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: Lines as what string_split leaves, cuts by code points instead of lists of lines.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS sizes, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS BIGINT) AS n FROM t),
c AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS swapped FROM l),
e AS (SELECT doc_id, text, n, swapped, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN swapped THEN 'spm' ELSE 'psm' END AS form,
 least(length(text), CAST(coalesce(list_sum(sizes[1:least(a, b)]), 0) AS BIGINT)) AS p, least(length(text), CAST(coalesce(list_sum(sizes[1:greatest(a, b)]), 0) AS BIGINT)) AS q FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', substr(text, 1, p), '<S>', substr(text, q + 1), '<M>', substr(text, p + 1, q - p)) ELSE concat('<S>', substr(text, q + 1), '<P>', substr(text, 1, p), '<M>', substr(text, p + 1, q - p)) END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM e"""
