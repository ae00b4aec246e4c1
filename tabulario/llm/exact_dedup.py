"""Exact duplicates by two passes over hashes with a Bloom filter between them.

The first pass reads the texts once and leaves an id, a hash and a digest per
row. A filter built from the hashes tells which rows may have an equal; only
these are shuffled, all others go straight through. Rows are then grouped by the
SHA-256 digest of the text, so a false find of the filter changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.bloom import MOST_BITS, split_repeated
from tabulario.llm.skew import join_groups
from tabulario.llm.workspace import Workspace


def _digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
        F.xxhash64(text).alias("_h"), F.unhex(F.sha2(text, 256)).alias("_sha"),
    )


def duplicate_groups(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest doc_id
    is kept (null ids come last); of rows that repeat even the id one is kept.
    No documents give no rows.
    """
    work = Workspace(docs.sparkSession)
    rows = work.keep(_digests(docs), "digests")
    n = rows.count()
    again, single = split_repeated(rows, rows, "_h", n, most_bits)
    again = again.drop("_h")
    groups = work.keep(
        again.groupBy("_sha").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size")), "groups",
    )
    joined = join_groups(again, groups, "_sha", "group_size", n).select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "_sha",
    )
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    return joined.unionByName(alone).withColumn("text_sha256", F.lower(F.hex("_sha"))).drop("_sha")


def drop_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of `docs` without those that have an equal text with a larger doc_id.

    All columns stay, whatever their names. A null text counts as empty, a null id
    comes last. Of rows that repeat even the id one stays, with the other
    columns of some one of them. No documents give no rows.
    """
    work = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"), F.struct(*docs.columns).alias("_doc"))
    hashes = work.keep(rows.select("_h"), "hashes")
    n = hashes.count()
    again, single = split_repeated(rows, hashes, "_h", n, most_bits)
    again = again.withColumn("_sha", F.unhex(F.sha2("_text", 256))).drop("_h", "_text")
    groups = work.keep(again.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")), "groups")
    # Only rows with the id to keep are left when digests are made unique: one text of a group, as a rule.
    stay = join_groups(again, groups, "_sha", "_n", n).where(F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha"])
    return stay.select("_doc.*").unionByName(single.select("_doc.*"))
