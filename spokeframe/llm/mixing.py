"""Mixes sources to target weights by Pareto order sampling.

Sources in order of their code points, null last, weigh WEIGHTS in turn and share all words. A
target ends at CAP times its source's words; what is over is shared again by weight.

Inside a source, the copies wanted of a document grow with its length class, the number of binary digits of its
size, as in per-source upsampling of long documents for long contexts: a text of 1,000 words is wanted 10 / 7
times as often as one of 100. `copies = least(CAP, level * class)`, with the level at which the source's words come to its target.
The whole part of the copies is taken for certain. What is left of it is the document's odds of inclusion: documents are ranked
by their random odds over these and taken in that order while the source's remaining words last;
of stopping before or after the document that crosses the end, the one that comes nearer is chosen.

Defined cases: null text has no words and is taken 0 times for want of words to give (its certain
copies count 0 words); a null doc_id draws as the empty string does; documents that draw equal numbers go by id, size and a hash of the text
(of all columns in `mix_rows`); rows that agree in these too are alike, and as many of them as fit are taken;
very long texts are never cut, so a source may miss its target by half of one; an empty table gives an empty result; a source without words has target 0. Other columns are kept by `mix_rows` and not
read by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_hash, running, times

# The contract's weights in turn, its cap, and what separates words.
WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"

#: Ranges of the ranks that a source's words are first counted in; only the rows of the range where a source's words run out are sorted.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """The document's random number in (0, 1): the same in every run."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row a source.

    Sources reach their cap in the order of size / weight. With the first k of these capped, the others
    get `level` words for each unit of weight; the right k is the first whose next source stays under its cap. Places and sums
    are counted on over ranges of the order, as there may be as many sources as sites.
    """
    by_name = [F.col("source").asc_nulls_last()]
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = running(sizes, by_name).withColumn("weight", F.element_at(cycle, (F.col("place") % len(WEIGHTS) + 1).cast("int"))).drop("place")
    order = [(F.col("source_size") / F.col("weight")).asc(), *by_name]
    filled = materialise(running(ranked, order, {"source_size": "capped", "weight": "used"}), "filled")
    total, weights = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) - CAP * F.col("capped")).cast("double") / (F.lit(weights) - F.col("used")).cast("double")
    free = filled.withColumn("level", level).filter(F.col("level") * F.col("weight") <= (CAP * F.col("source_size")).cast("double"))
    found = free.agg(F.min_by("level", "place")).first()[0]
    target = F.least((CAP * F.col("source_size")).cast("double"), F.lit(found or 0.0) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def length_class(size: Column) -> Column:
    return F.length(F.bin(size))


def wanted_copies(classes: DataFrame) -> DataFrame:
    """classes: source, class, words. Adds source_size, target, and what each class is wanted: certain copies and the share of one more.

    The longest classes reach CAP copies first, so the level is found as that of sources is, among the classes of a source.
    """
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "of")
    rows = classes.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    longest = Window.partitionBy("source").orderBy(F.desc("class"))
    longer, rest = longest.rowsBetween(Window.unboundedPreceding, -1), longest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("words").over(longer), F.lit(0))
    units = F.sum(F.col("words") * F.col("class")).over(rest)
    level = (F.col("target") - (CAP * capped).cast("double")) / F.nullif(units, F.lit(0)).cast("double")
    rows = rows.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("class") <= float(CAP), F.col("level")))
    first = F.first("level", ignorenulls=True).over(longest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    copies = F.when(F.col("target") > 0, F.least(F.lit(float(CAP)), F.coalesce(first * F.col("class"), F.lit(float(CAP))))).otherwise(F.lit(0.0))
    rows = rows.withColumn("wanted", copies).withColumn("certain", F.floor("wanted"))
    return rows.select("source", "class", "words", "source_size", "target", "certain", (F.col("wanted") - F.col("certain")).alias("share"))


def _keyed(docs: DataFrame, tie: Column, *more: Column) -> DataFrame:
    size = word_count(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), length_class(size).alias("class"), draw(F.col("doc_id")).alias("u"), tie.alias("tie"), *more)


def _place() -> Column:
    """What documents of a source are ranked by; a null doc_id comes before all others."""
    return F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"), "size", "tie")


def _rated(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the plan, a written table with a row a source and class, so Spark picks the join by its size. Adds rank, from 0 to 1, and its range."""
    named = plan.select(F.col("source").alias("of"), F.col("class").alias("of_class"), "source_size", "target", "certain", "share")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class"))).drop("of", "of_class")
    odds = (F.col("u") / (1.0 - F.col("u"))) / (F.col("share") / (1.0 - F.col("share")))
    rows = rows.withColumn("rank", F.when(F.col("share") > 0, odds)).withColumn("rank", F.col("rank") / (1.0 + F.col("rank")))
    return rows.withColumn("range", F.floor(F.col("rank") * RANGES).cast("int"))


def plan_mix(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each source and class: what is wanted. Of each source: the place in the Pareto order where its words run out (end), and how many rows of that place are taken."""
    plan = materialise(wanted_copies(light.groupBy("source", "class").agg(F.sum("size").alias("words"))), "plan")
    certain = F.sum(F.col("certain") * F.col("words"))
    goal = plan.groupBy("source").agg(F.first("target").alias("target"), certain.alias("sure")).select(F.col("source").alias("of"), (F.col("target") - F.col("sure").cast("double")).alias("rest"))

    # Words are counted range by range, until the range in which a source's words run out.
    rated = _rated(light, plan).filter("share > 0")
    ranges = rated.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(goal, F.col("source").eqNullSafe(F.col("of")))
    cut = ranges.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    cut = materialise(cut.select("of", "rest", F.col("range").alias("cut_range"), F.col("before").alias("cut_before")), "cut")

    # Inside it, alike rows are one with their number, and the words go on from those of the ranges before.
    inside = rated.join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("cut_range")))
    inside = inside.groupBy("of", "rest", "cut_range", "cut_before", "size", _place().alias("end")).agg(F.count("*").alias("alike"))
    by_rank = Window.partitionBy("of").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("sofar", F.col("cut_before") + F.coalesce(F.sum(F.col("size") * F.col("alike")).over(by_rank), F.lit(0)))
    crossing = inside.filter((F.col("sofar") <= F.col("rest")) & (F.col("sofar") + F.col("size") * F.col("alike") > F.col("rest")))
    crossing = crossing.withColumn("whole", F.floor((F.col("rest") - F.col("sofar")) / F.col("size"))).withColumn("sofar", F.col("sofar") + F.col("whole") * F.col("size"))
    nearer = (F.col("sofar") + F.col("size") - F.col("rest")) < (F.col("rest") - F.col("sofar"))
    return plan, materialise(crossing.select("of", "cut_range", "end", "alike", (F.col("whole") + nearer.cast("long")).alias("takes")), "ends")


def _with_copies(rows: DataFrame, plan: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds copies; of rows alike at a source's end, which have `at_end`, the certain ones alone."""
    rows = _rated(rows, plan).join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    place = _place()
    one_more = (
        F.when(F.col("share") <= 0, F.lit(False))
        .when(F.col("cut_range").isNull(), F.lit(True))
        .when(F.col("range") != F.col("cut_range"), F.col("range") < F.col("cut_range"))
        .otherwise((place < F.col("end")) | ((place == F.col("end")) & (F.col("alike") == F.col("takes"))))
    )
    at_end = F.coalesce((place == F.col("end")) & (F.col("alike") > F.col("takes")) & (F.col("takes") > 0), F.lit(False))
    return rows.withColumn("copies", (F.col("certain") + one_more.cast("long")).cast("long")).withColumn("at_end", at_end)


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies for every row."""
    keyed = _keyed(docs, F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    light = materialise(keyed, "light")
    plan, ends = plan_mix(light)
    out = _with_copies(light, plan, ends)
    if not ends.filter("alike > takes and takes > 0").isEmpty():
        alike = running(out.filter("at_end"), [F.col("row").asc()], by=["source"])
        alike = alike.withColumn("copies", F.col("copies") + (F.col("place") < F.col("takes")).cast("long")).drop("place")
        out = out.filter("not at_end").unionByName(alike)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with the columns of docs."""
    names = docs.columns
    plan, ends = plan_mix(materialise(_keyed(docs, row_hash(docs)), "light"))
    packed = _keyed(docs, row_hash(docs), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    taken = _with_copies(packed, plan, ends)
    mixed = times(taken.filter("copies > 0"), "copies").select("row")
    if not ends.filter("alike > takes and takes > 0").isEmpty():
        # Rows alike at an end agree in all columns, so one of them stands for those that come once more.
        alike = taken.filter("at_end").groupBy("source").agg(F.first("row").alias("row"), F.first("takes").alias("takes"))
        mixed = mixed.unionByName(times(alike, "takes").select("row"))
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in names])


# md5 digits and divisors match draw() above.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u,
         length(bin(CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT))) AS class
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3] AS weight FROM sums
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER earlier, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT arg_min(level, CAST(source_size AS DOUBLE) / weight) AS level FROM levels WHERE level * weight <= CAST(3 * source_size AS DOUBLE)
), goals AS (
  SELECT w.source, w.source_size, least(CAST(3 * w.source_size AS DOUBLE), coalesce(c.level, 0.0) * w.weight) AS target FROM weighed w, chosen c
), classes AS (
  SELECT s.source, s.class, CAST(sum(s.size) AS BIGINT) AS words, any_value(g.source_size) AS source_size, any_value(g.target) AS target
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source GROUP BY s.source, s.class
), class_levels AS (
  SELECT *, (target - CAST(3 * coalesce(sum(words) OVER (longest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(nullif(sum(words * class) OVER (longest ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS level
  FROM classes WINDOW longest AS (PARTITION BY source ORDER BY class DESC)
), class_chosen AS (
  SELECT source, arg_max(level, class) AS level FROM class_levels WHERE level * class <= 3e0 GROUP BY source
), wanted AS (
  SELECT c.*, CASE WHEN c.target > 0 THEN least(3e0, coalesce(h.level * c.class, 3e0)) ELSE 0e0 END AS wanted FROM classes c LEFT JOIN class_chosen h ON c.source IS NOT DISTINCT FROM h.source
), parts AS (
  SELECT *, CAST(floor(wanted) AS BIGINT) AS certain, wanted - floor(wanted) AS share,
         target - CAST(sum(CAST(floor(wanted) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM wanted
), rated AS (
  SELECT s.doc_id, s.size, s.source, p.source_size, p.target, p.certain, p.share, p.rest,
         CASE WHEN p.share > 0 THEN (s.u / (1e0 - s.u)) / (p.share / (1e0 - p.share)) END AS odds
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source AND s.class = p.class
), ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1e0 + odds) NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM rated
), counted AS (
  SELECT *, CASE WHEN share <= 0 THEN 0 WHEN sofar + size <= rest THEN 1 WHEN sofar <= rest AND sofar + size - rest < rest - sofar THEN 1 ELSE 0 END AS more FROM ranked
)
SELECT doc_id, size, source_size, target, CAST((certain + more) * size AS BIGINT) AS taken, source, CAST(certain + more AS BIGINT) AS copies FROM counted
"""
