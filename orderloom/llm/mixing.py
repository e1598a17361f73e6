"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Within a source each document is expected r = target / size
times; expected copies are prefix-summed over the source's documents in order of size, one random offset
is added, and a document is emitted once per integer boundary that its interval crosses. The order by size
keeps the words taken within about one document of the target.

Prefix sums are made in three levels, (source, size class), hashed part of a class, and row. There are as many parts
as the square root of the number of documents, so that the parts of a class and the rows of a part, which windows sort,
both grow with that root only. Windows and their shuffles carry ids and sizes, never texts: `mix` numbers the rows once,
in a written table, and fetches each row of the mix from it by that number. DataFrame operations only.

Defined results: a null text has size 0 and is emitted like its neighbours; a text of any length is one number here;
a null source is one source, last in order; repeated rows are separate documents; other columns, whatever their names,
are kept as they are; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_nulls, staged, table, word_count

#: Weights of the sources in order, repeating; the mix's words per word of input; the most of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix-1"


def _hash(c: Column) -> Column:
    """32 bits of md5, which any SQL engine has."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, capped, the excess dealt again.

    A source is full when its cap over its weight is under the level at which the others share what is left, so
    filling goes in order of cap / weight. One row per source is ordered here, never one per document."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("total", SHARE * F.sum("source_size").over(everything))
    w = w.withColumn("ratio", F.col("source_size") / F.col("weight"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("used", MOST * F.coalesce(F.sum("source_size").over(filled), F.lit(0)))
    w = w.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    w = w.withColumn("level", (F.col("total") - F.col("used")) / F.col("rest"))
    open_ = F.col("level") < MOST * F.col("ratio")
    w = w.withColumn("open_level", F.max(F.when(open_, F.col("level"))).over(everything))
    share = F.coalesce(F.col("open_level") * F.col("weight"), F.lit(float("inf")))
    return w.select("source", "source_size", F.least(share, (MOST * F.col("source_size")).cast("double")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tie: Column | None = None, row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row, and row, its number in row_col.

    tie orders rows that are equal in source, size and id; without it, a hash of their texts."""
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            (F.xxhash64(text_col) if tie is None else tie).alias("tie"),
            *([] if row_col is None else [F.col(row_col).alias("row")]),
        ),
        "sizes",
    )
    bits = F.bin("size")
    rows = rows.withColumn("size_class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)))
    parts = max(1, math.ceil(math.sqrt(rows.count())))
    part = (_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts).alias("part")
    keys = ["source", "size_class", "part"]
    counts = staged(rows.withColumn("part", part).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "counts")
    before = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_class = counts.groupBy("source", "size_class").agg(F.sum("n").alias("class_n"), F.sum("words").alias("class_words"))
    by_class = by_class.withColumn("class_from", before("class_n", "source", "size_class"))
    sizes = by_class.groupBy("source").agg(F.sum("class_words").alias("source_size"))
    source = F.coalesce(F.col("source").cast("string"), F.lit("\x01null"))
    rate = targets(sizes).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rate = rate.withColumn("offset", _hash(F.concat(F.lit(SEED), source)) / F.lit(4294967296.0))
    by_class = join_nulls(by_class, rate, ["source"])
    start = counts.withColumn("part_from", before("n", "source", "size_class", "part")).drop("n", "words")
    start = join_nulls(start, by_class, ["source", "size_class"]).withColumn("start", F.col("class_from") + F.col("part_from"))
    at = Window.partitionBy(*keys).orderBy("size", F.col("doc_id").asc_nulls_last(), "tie")
    numbered = rows.withColumn("part", part).withColumn("rn", F.row_number().over(at))
    placed = join_nulls(numbered, start.select(*keys, "start", "source_size", "target", "rate", "offset"), keys).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("start") + F.col("rn")).alias("place"), "rate", "offset", *([] if row_col is None else ["row"])
    )
    upto = lambda place: F.floor(place * F.col("rate") + F.col("offset"))
    return placed.withColumn("copies", upto(F.col("place")) - upto(F.col("place") - 1)).drop("place", "rate", "offset")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, MOST times at most."""
    numbered = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    slim = numbered.select(F.col(f"row.{id_col}").alias("id"), F.col(f"row.{text_col}").alias("text"), F.col(f"row.{source_col}").alias("source"), F.xxhash64(*(F.col(f"row.`{c}`") for c in hashed)).alias("tie"), "number")
    taken = copies(slim, "id", "text", "source", F.col("tie"), "number").where("copies > 0").select(F.col("row").alias("number"), "copies")
    return numbered.join(taken, "number").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, hash(text) AS tie, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
n AS (SELECT greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS parts FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
f AS (SELECT *, source_size::DOUBLE / weight AS ratio,
             2 * coalesce(sum(source_size) OVER p, 0)::BIGINT AS used, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS rest
      FROM w WINDOW p AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - used::DOUBLE) / rest::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, least(coalesce(max(CASE WHEN level < 2 * ratio THEN level END) OVER () * weight, 'infinity'::DOUBLE), 2.0::DOUBLE * source_size) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
             CAST('0x' || substr(md5('mix-1' || coalesce(source, chr(1) || 'null')), 1, 8) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM t),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 3),
             CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS UBIGINT) % (SELECT parts FROM n), size, doc_id NULLS LAST, tie) AS place FROM d)
SELECT p.doc_id, p.size, r.source_size, r.target,
       CAST((floor(p.place * r.rate + r.u) - floor((p.place - 1) * r.rate + r.u)) AS BIGINT) * p.size AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
"""
