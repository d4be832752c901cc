"""Mixing sources to target weights.

Every document gets a hash-random key, each source is range-sorted by it, token counts get distributed
prefix sums, and each source is cut at its exact budget, in as many epochs as that takes.

The range sort is by (source, key), so one source that holds a third of the rows spreads over many
partitions. Prefix sums take two levels: a running sum inside each range partition, plus the sums of
the partitions before it. Only keys and counts are sorted: what comes of it is one cut for each source, its
boundary key, which a second scan of the documents applies where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions, text_of, word_count


def prefix_sums(table: DataFrame, by: Sequence[Column], sums: Sequence[str], name: str) -> DataFrame:
    """Adds ``before_x``, the sum of x over all rows before in the order ``by``, for each x of ``sums``.

    Rows are range-sorted; what the window without a key sees is one row for each range partition.
    """
    ranged = materialize(table.repartitionByRange(shuffle_partitions(table.sparkSession), *by).withColumn("part", F.spark_partition_id()), name)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(*[F.sum(x).alias(x) for x in sums])
    offsets = parts.select("part", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"offset_{x}") for x in sums])
    found = ranged.withColumns({f"before_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums}).join(offsets, "part")
    return found.withColumns({f"before_{x}": F.col(f"before_{x}") + F.col(f"offset_{x}") for x in sums}).drop("part", *[f"offset_{x}" for x in sums])


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets for a table (no_source, source, source_size): one row per source, and there may be very many.

    Sources by code point, null last, take the weights in turn and share the total of all sizes. A
    target stops at ``cap`` times its source's size; the excess is shared anew by weight until none is
    above. The fixed point is a water level: with sources in order of cap/weight, (total - caps of the
    sources before) / (weights from here on) rises while sources are capped and falls after, so its
    maximum is the level.
    """
    one = sizes.withColumn("one", F.lit(1).cast("long"))
    named = prefix_sums(one, [F.col("no_source"), F.col("source")], ["one"], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int")).cast("long")
    weighed = materialize(named.select("no_source", "source", "source_size", (F.col("source_size") * cap).alias("cap"), weight.alias("weight")), "mix-weights")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    filling = prefix_sums(weighed, [F.col("cap") / F.col("weight"), F.col("no_source"), F.col("source")], ["cap", "weight"], "mix-filling")
    left = F.lit(whole["size"]).cast("long") - F.col("before_cap")
    ahead = F.lit(whole["weight"]).cast("long") - F.col("before_weight")
    level = filling.agg(F.max(left.cast("double") / ahead.cast("double"))).first()[0]
    return (
        weighed.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight")))
        .withColumn("budget", F.least(F.col("cap"), F.floor(F.col("target") + 0.5)))
        .select("no_source", "source", "source_size", "target", "budget")
    )


def mix_sources(
    docs: DataFrame,
    carry: Sequence[Column | str] = ("*",),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    seed: int = 42,
) -> DataFrame:
    """How many words of each row the mix takes.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``size`` (words),
    ``source_size``, ``target`` and ``taken`` (words, repeats counted: whole epochs plus the part of
    the last epoch that the cut leaves). A source's taken words add up to its target, rounded.

    A null text has size 0, a null source is a source of its own, null ids sort after the others, and
    repeated rows each count. An empty table gives an empty result. The order inside a source depends
    on id and ``seed`` only, so reruns agree; of rows that agree in source, id and size any may be the first.
    """
    name = F.coalesce(F.col(source_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    base = docs.select(
        F.struct(*carry).alias("row"), F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"), name.alias("source"), key.alias("key"), text_of(text_col).alias("text")
    )
    sized = base.withColumn("size", word_count(F.col("text")))
    of, order = ["no_source", "source"], [F.col("key"), F.col("id").asc_nulls_last(), F.col("size")]
    sizes = materialize(sized.select("id", *of, "key", "size"), "mix-sizes")  # written, so that the range sort's sampling counts no words
    ranged = materialize(sizes.repartitionByRange(shuffle_partitions(docs.sparkSession), *of, *order).withColumn("part", F.spark_partition_id()), "mix-ranged")
    targets = source_targets(sizes.groupBy(*of).agg(F.sum("size").alias("source_size")), weights, cap)

    parts = [*of, "part"]
    earlier = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*parts)
        .agg(F.sum("size").alias("part_size"))
        .select(*parts, F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))
        .join(targets, of)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    # Of each source the row in which the last epoch ends; equal rows lie in one partition and are told by number.
    inside = Window.partitionBy(*parts).orderBy(*order)
    start = F.col("offset") + F.col("before")
    cuts = (
        ranged.withColumns(
            {"before": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "tied_before": F.row_number().over(inside) - F.rank().over(inside)}
        )
        .join(offsets.select(*parts, "offset", "left"), parts)
        .filter((start <= F.col("left")) & (F.col("left") < start + F.col("size")))
        .select(*of, F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"), "tied_before", (F.col("left") - start).alias("part_taken"))
    )
    known = offsets.select(*of, "source_size", "target", "epochs").distinct()
    cuts = materialize(known.join(cuts, of, "left"), "mix-cuts")
    discard(sizes, ranged)

    size, epochs = F.col("size"), F.col("epochs")
    out = ["row", "size", "source_size", "target"]
    same_id = F.col("id").eqNullSafe(F.col("cut_id"))
    at_cut = F.coalesce((F.col("key") == F.col("cut_key")) & same_id, F.lit(False))
    sooner = F.coalesce(
        (F.col("key") < F.col("cut_key"))
        | ((F.col("key") == F.col("cut_key")) & (F.col("id").isNotNull() & (F.col("cut_id").isNull() | (F.col("id") < F.col("cut_id"))) | same_id & (size < F.col("cut_size")))),
        F.lit(False),
    )
    tied = at_cut & (size == F.col("cut_size"))
    placed = sized.join(cuts, of)
    sure = placed.filter(~tied).withColumn("taken", (epochs + F.when(sooner, 1).otherwise(0)) * size)
    # Only rows with the id at the cut are counted again.
    equal = base.join(cuts, of).filter(at_cut).withColumn("size", word_count(F.col("text"))).filter(size == F.col("cut_size"))
    equal = equal.withColumn("no", F.row_number().over(Window.partitionBy(*of).orderBy(F.xxhash64("text"))))
    more = F.when(F.col("no") <= F.col("tied_before"), size).when(F.col("no") == F.col("tied_before") + 1, F.col("part_taken")).otherwise(0)
    equal = equal.withColumn("taken", epochs * size + more)
    return sure.select(*out, F.col("taken").cast("long").alias("taken")).unionByName(equal.select(*out, F.col("taken").cast("long").alias("taken")))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '42', doc_id::VARCHAR)) AS key
  FROM documents
), s AS (
  SELECT no_source, source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap
  FROM d GROUP BY no_source, source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), t AS (
  SELECT no_source, source, source_size, cap, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l
), b AS (
  SELECT *, least(cap, floor(target + 0.5)::BIGINT) AS budget FROM t
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY no_source, source ORDER BY key, doc_id NULLS LAST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(budget - epochs * source_size - before, size)))::BIGINT AS taken
FROM p JOIN e USING (no_source, source)
"""
