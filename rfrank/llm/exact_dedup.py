"""Exact deduplication by progressive refinement.

Rows are grouped by the length of their normalised text, then by a hash of its prefix, then by a hash
of the whole. The full hash is taken only of texts whose (length, prefix) group has company.

Plan: one scan counts (length, prefix hash) pairs, pre-aggregated on the map side. The surviving pairs
are folded into at most ``sieve_buckets`` bucket numbers, so the table that is broadcast to the second
scan has a fixed bound whatever the corpus holds; a bucket collision costs one needless hash and never
changes a result. A second scan hashes and writes the survivors, a third returns the rest as it is. Groups are then counts and minima, which
combine before the shuffle; rows meet their group's figures in a join that adaptive execution can
split, so a group holding a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, without_white


def exact_dedup(
    docs: DataFrame,
    carry: Sequence[Column | str] = ("*",),
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    sieve_buckets: int = 1 << 20,
) -> DataFrame:
    """Group rows whose texts are equal after white space is deleted.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``full_hash`` (SHA-256
    of the normalised text, null where refinement ended before it was needed), ``keep_id``,
    ``group_size`` and ``kept``.

    Of equal texts the row with the most code points stays, then the smallest id, null ids last; of
    rows that agree in all of these exactly one stays. A null text counts as empty; empty texts equal
    each other. An empty table gives an empty result. Other columns ride along inside ``row``, whatever
    their names.
    """
    text = text_of(text_col)
    scan = docs.select(
        F.struct(*carry).alias("row"),
        F.col(id_col).alias("id"),
        F.length(text).cast("long").alias("n_chars"),
        without_white(text).alias("norm"),
    ).withColumns(
        {
            "n_norm": F.length("norm").cast("long"),
            "prefix": F.xxhash64(F.substring("norm", 1, prefix_chars)),
        }
    )
    pairs = materialize(scan.groupBy("n_norm", "prefix").agg(F.count(F.lit(1)).alias("n")), "exact-pairs")

    # Level 1: lengths with company. Level 2: of those, prefixes with company.
    lengths = pairs.groupBy("n_norm").agg(F.sum("n").alias("rows")).filter("rows > 1").select("n_norm")
    prefixes = pairs.filter("n > 1").join(lengths, "n_norm", "left_semi")
    # What is left is told by a sieve of at most ``sieve_buckets`` rows, in which a collision costs time only;
    # where the sieve would be a quarter full, by the prefixes themselves.
    if prefixes.count() <= sieve_buckets // 4:
        bucket = F.pmod(F.xxhash64("n_norm", "prefix"), F.lit(sieve_buckets)).cast("int")
        sieve = prefixes.select(bucket.alias("bucket")).distinct().withColumn("hit", F.lit(True))
        sieved = scan.withColumn("bucket", bucket).join(F.broadcast(sieve), "bucket", "left")
    else:
        sieved = scan.join(prefixes.select("n_norm", "prefix", F.lit(True).alias("hit")), ["n_norm", "prefix"], "left")

    # Level 3: the full hash of what is left; its rows are numbered once, by the write. The rest is done.
    alone = sieved.filter("hit is null").select(
        "row",
        F.lit(None).cast("string").alias("full_hash"),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    shared = materialize(
        sieved.filter("hit").select("row", "id", "n_chars", "n_norm", F.sha2("norm", 256).alias("full_hash"), F.monotonically_increasing_id().alias("uid")),
        "exact-shared",
    )
    # Written, so that the join reads both sides afresh and a large group's rows can be split over tasks.
    groups = materialize(
        shared.groupBy("n_norm", "full_hash").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "uid")).alias("best"),
        ),
        "exact-groups",
    )
    grouped = shared.join(groups, ["n_norm", "full_hash"]).select(
        "row", "full_hash", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept")
    )
    return alone.unionByName(grouped)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact groups over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = F.sha2(without_white(text_of()), 256).alias("text_sha256")
    return exact_dedup(docs, carry=["doc_id", digest]).select(
        "row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256"
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, length(t) AS n,
         count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS r
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM g
"""
