"""Exact deduplication against immutable snapshots.

A snapshot is a written table of exact buckets, one row per distinct text, and one static binary-fuse
filter per shard of digests. An incoming batch is first grouped by digest on its own; its distinct
digests are then screened shard by shard, and only positives join the exact buckets, where the bytes
of the normalised texts are compared. Texts are equal when identical after deleting ASCII white space.

Defined results: a null text counts as empty; texts of any length are hashed whole; a null id sorts after all others; of
each group one row stays, so of rows that are equal in id and length, too, one at will; other columns, whatever their
names, are not read; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse_filter
from .common import WHITE, broadcast_if, staged, table, text_or_empty

#: Distinct digests that one shard's filter holds at most, about; the number of shards follows the input.
SHARD_KEYS = 1 << 15
#: Rows of (digest, two ids) that may be broadcast to fetch texts for the byte check: under 16 MB.
BROADCAST_ROWS = 200_000


def normalised(text_col: str = "text") -> Column:
    return F.translate(text_or_empty(text_col), WHITE, "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, digest) of every row, with one pass over the texts."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text_or_empty(text_col)).alias("n_chars"),
        F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"),
    )


def classes(prints: DataFrame) -> DataFrame:
    """One row per digest; `best` is the longest original, then the smallest id, and the one row of it that stays."""
    best = F.min(F.struct((-F.col("n_chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return prints.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))


def _shard(count: int) -> Column:
    return (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % count).cast("int")


def _key() -> Column:
    """60 bits of the digest beside those of the shard."""
    return F.conv(F.substring(F.hex("digest"), 9, 15), 16, 10).cast("long")


@dataclass
class Snapshot:
    """An immutable set of known texts: its documents, exact buckets and filters."""

    docs: DataFrame
    buckets: DataFrame
    filters: DataFrame
    shards: int


def build_snapshot(docs: DataFrame, prints: DataFrame, shards: int) -> Snapshot:
    """Write the buckets, and a filter for each shard of their digests."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "filter": [fuse_filter.build(pdf["key"].to_numpy(dtype=np.uint64))]})

    buckets = staged(classes(prints), "buckets")
    keyed = buckets.select(_shard(shards).alias("shard"), _key().alias("key"))
    filters = staged(keyed.groupBy("shard").applyInPandas(build, "shard int, filter binary"), "filters")
    return Snapshot(docs, buckets, filters, shards)


def screen(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """The batch's classes that may be in the snapshot, by its filters; shard by shard, so no filter is broadcast."""

    def probe(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"digest": pd.Series(dtype=object)})
        hit = fuse_filter.probe(right["filter"].iloc[0], left["key"].to_numpy(dtype=np.uint64))
        return left.loc[hit, ["digest"]]

    incoming = batch.select("digest", _shard(snapshot.shards).alias("shard"), _key().alias("key"))
    return incoming.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInPandas(probe, "digest binary")


def _texts(docs: DataFrame, wanted: DataFrame, rows: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """The normalised text of each wanted (digest, best), once. Rows meet by id and length; rows without an id by digest, too."""
    no_id = lambda c, digest: F.when(F.col(c).isNull(), digest)
    ids = wanted.select("digest", F.col("best.doc_id").alias("wanted_id"), (-F.col("best.neg_chars")).alias("wanted_chars"), no_id("best.doc_id", F.col("digest")).alias("wanted_digest"))
    ids = broadcast_if(ids, rows, BROADCAST_ROWS)
    own = docs.select(F.col(id_col).alias("own_id"), F.length(text_or_empty(text_col)).alias("own_chars"), F.col(text_col).alias("own_text"))
    own = own.withColumn("own_digest", no_id("own_id", F.unhex(F.sha2(normalised("own_text"), 256))))
    meet = own.own_id.eqNullSafe(ids.wanted_id) & (own.own_chars == ids.wanted_chars) & own.own_digest.eqNullSafe(ids.wanted_digest)
    found = own.join(ids, meet).select("digest", normalised("own_text").alias(name))
    return found.where(F.unhex(F.sha2(name, 256)) == F.col("digest")).dropDuplicates(["digest"])


def match(snapshot: Snapshot, batch_docs: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batch classes whose bytes are those of a snapshot's bucket: (digest, best, n) with both sides' rows counted."""
    positive = screen(snapshot, batch).join(batch.withColumnsRenamed({"best": "new_best", "n": "new_n"}), "digest")
    pairs = staged(positive.join(snapshot.buckets, "digest"), "positives")
    rows = pairs.count()
    new = _texts(batch_docs, pairs.select("digest", F.col("new_best").alias("best")), rows, id_col, text_col, "new_text")
    old = _texts(snapshot.docs, pairs.select("digest", "best"), rows, id_col, text_col, "old_text")
    same = new.join(old, "digest").where(F.col("new_text") == F.col("old_text")).select("digest")
    return pairs.join(same, "digest").select("digest", F.least("best", "new_best").alias("best"), (F.col("n") + F.col("new_n")).alias("n"))


def dedup(snapshot_docs: DataFrame, batch_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document of both: doc_id, keep_id, group_size, kept, text_sha256."""
    tagged = [fingerprints(d, id_col, text_col).withColumn("side", F.lit(side)) for side, d in enumerate((snapshot_docs, batch_docs))]
    prints = staged(tagged[0].unionByName(tagged[1]).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    shards = max(1, -(-prints.count() // SHARD_KEYS))
    snapshot = build_snapshot(snapshot_docs, prints.where("side = 0"), shards)
    batch = staged(classes(prints.where("side = 1")), "batch")
    matched = staged(match(snapshot, batch_docs, batch, id_col, text_col), "matched")
    alone = lambda known, side: known.join(matched, "digest", "left_anti").select("digest", "best", "n", F.lit(side).alias("side"))
    both = matched.select("digest", "best", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    groups = alone(snapshot.buckets, 0).unionByName(alone(batch, 1)).unionByName(both)
    return prints.join(groups, ["digest", "side"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: those of even hash are the snapshot, the others the incoming batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return dedup(docs.where(even), docs.where(~even))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY norm) AS n
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n AS group_size, kept, sha256(norm) AS text_sha256 FROM r
"""
