"""Transmitters and measurements: the nearest measurement in frequency, semi- and anti-joins, recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rf

FIELDS = ("snr_db", "score", "power_db", "obw_fraction")
#: A list of measurements given as values travels in the plan; more go in as a DataFrame.
MAX_LITERAL = 2000


def match_values(towers: DataFrame, measurements: Sequence[dict], freq: str = "freq", band: str = "band") -> DataFrame:
    """Adds ``m``, the nearest of a short list of measurements within the band's tolerance; no shuffle.

    Ties go to the earlier measurement; the measurement's own band is not looked at.
    """
    if len(measurements) > MAX_LITERAL:
        raise ValueError("pass more than a few measurements as a DataFrame")
    kind = "array<struct<ordinal:bigint,freq_mhz:double,snr_db:double,score:double,power_db:double,obw_fraction:double>>"
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("ordinal"),
            F.lit(float(m["freq_mhz"])).alias("freq_mhz"),
            *[F.lit(m.get(f)).cast("double").alias(f) for f in FIELDS],
        )
        for i, m in enumerate(measurements)
    ]
    all_of = F.array(*rows).cast(kind)
    near = F.filter(all_of, lambda m: F.abs(m["freq_mhz"] - F.col(freq)) <= rf.tolerance_mhz(F.col(band)))
    best = F.array_min(F.transform(near, lambda m: F.struct(F.abs(m["freq_mhz"] - F.col(freq)).alias("diff"), m["ordinal"].alias("ordinal"), m.alias("m"))))
    return towers.withColumn("m", best["m"])


LIST = "array<struct<ordinal:bigint,freq_mhz:double,snr_db:double,score:double,power_db:double,obw_fraction:double>>"


def as_lists(measurements: DataFrame, key: str = "receiver_id") -> DataFrame:
    """(key, measurements): each request's own measurements (key, ordinal, freq_mhz, ...) as a list, as requests carry them.

    A request of more than ``MAX_LITERAL`` measurements fails the query: it belongs into a table that all requests share.
    """
    listed = measurements.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("ordinal", "freq_mhz", *FIELDS)).alias("l"))
    too_many = F.raise_error(F.lit(f"a request sends more than {MAX_LITERAL} measurements"))
    return listed.select(key, F.when(F.col("n") > MAX_LITERAL, too_many).otherwise(F.array_sort("l").cast(LIST)).alias("measurements"))


def match_listed(towers: DataFrame, listed: str = "measurements", freq: str = "freq", band: str = "band") -> DataFrame:
    """Adds ``m``, the nearest within the band's tolerance of the measurements that the row itself carries; no shuffle.

    Ties go to the smaller ordinal. A null or empty list matches nothing.
    """

    def away(m: Column) -> Column:
        return F.struct(F.abs(m["freq_mhz"] - F.col(freq)).alias("diff"), m["ordinal"].alias("ordinal"), m.alias("m"))

    near = F.filter(listed, lambda m: F.abs(m["freq_mhz"] - F.col(freq)) <= rf.tolerance_mhz(F.col(band)))
    return towers.withColumn("m", F.array_min(F.transform(near, away))["m"])


def _bin(mhz: Column, width: Column) -> Column:
    return F.floor(mhz / (width * 1.001))


def _pairs(towers: DataFrame, measurements: DataFrame, freq: str, band: str, same_band: bool) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides keyed by (tolerance, bin), and what a pair must satisfy: an equi-join in place of a range join.

    Measurements go into their own bin and both neighbours, once for each tolerance in use. Bins are a little
    wider than the tolerance, so that rounding never parts a pair by two.
    """
    widths = F.array(*[F.lit(t) for t in sorted({*rf.TOLERANCE_MHZ.values(), rf.OTHER_TOLERANCE_MHZ})])
    binned = measurements.withColumn("width", F.explode(widths)).withColumn("own", _bin(F.col("freq_mhz"), F.col("width")))
    binned = binned.withColumn("bin", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    keyed = towers.withColumn("width", rf.tolerance_mhz(F.col(band))).withColumn("bin", _bin(F.col(freq), F.col("width")))
    close = F.abs(F.col("m.freq_mhz") - F.col(f"t.{freq}")) <= F.col("t.width")
    on = (F.col("t.width") == F.col("m.width")) & (F.col("t.bin") == F.col("m.bin")) & close
    if same_band:
        on = on & (F.col(f"t.{band}") == F.col("m.band"))
    return keyed.alias("t"), binned.alias("m"), on


def nearest(tuned: DataFrame, measurements: DataFrame, freq: str = "freq", band: str = "band") -> DataFrame:
    """(freq, band, m) for different (freq, band): the nearest measurement within the band's tolerance, where there is one.

    Ties go to the smaller measurement ordinal. Measurements of one frequency are reduced to the first of
    them beforehand, and pairs to the best before the shuffle, so neither a busy frequency nor a busy bin
    multiplies rows beyond the frequencies in it.
    """
    first = measurements.groupBy("freq_mhz").agg(F.min(F.struct("ordinal", *FIELDS)).alias("f")).select("freq_mhz", "f.*")
    t, m, on = _pairs(tuned.select(freq, band), first, freq, band, False)
    found = F.struct("m.ordinal", "m.freq_mhz", *[f"m.{f}" for f in FIELDS]).alias("m")
    return (
        t.join(m, on)
        .groupBy(F.col(f"t.{freq}").alias(freq), F.col(f"t.{band}").alias(band))
        .agg(F.min(F.struct(F.abs(F.col("m.freq_mhz") - F.col(f"t.{freq}")).alias("diff"), found)).alias("best"))
        .select(freq, band, "best.m")
    )


def nearest_listed(tuned: DataFrame, requests: DataFrame, key: str = "receiver_id") -> DataFrame:
    """(key, freq, band, m): for each request and different (freq, band) the nearest of its own ``measurements``, where there is one.

    Ties go to the smaller ordinal. Lists are laid out and meet the frequencies by bins.
    """
    sent = requests.select(key, F.inline("measurements")).select(key, "freq_mhz", F.struct("ordinal", "freq_mhz", *FIELDS).alias("sent"))
    first = sent.groupBy(key, "freq_mhz").agg(F.min("sent").alias("sent"))
    t, m, on = _pairs(tuned.select("freq", "band"), first, "freq", "band", False)
    away = F.struct(F.abs(F.col("m.freq_mhz") - F.col("t.freq")).alias("diff"), F.col("m.sent").alias("m"))
    return t.join(m, on).groupBy(F.col(f"m.{key}").alias(key), F.col("t.freq").alias("freq"), F.col("t.band").alias("band")).agg(F.min(away).alias("best")).select(key, "freq", "band", "best.m")


def match_nearest(towers: DataFrame, measurements: DataFrame, freq: str = "freq", band: str = "band") -> DataFrame:
    """Adds ``m``, the nearest measurement within the band's tolerance; null if there is none.

    A match depends on frequency and band, so only the different ones of these meet the measurements.
    """
    return towers.join(nearest(towers.select(freq, band).distinct(), measurements, freq, band), [freq, band], "left")


def supported(towers: DataFrame, measurements: DataFrame, freq: str = "frequency_mhz", band: str = "band") -> DataFrame:
    """Towers with a measurement of their own band within its tolerance."""
    t, m, on = _pairs(towers, measurements.select("freq_mhz", "band").distinct(), freq, band, True)
    return t.join(m, on, "left_semi").drop("width", "bin")


def unmatched(towers: DataFrame, measurements: DataFrame, freq: str = "frequency_mhz", band: str = "band") -> DataFrame:
    """Measurements without a tower of their own band within its tolerance."""
    width = rf.tolerance_mhz(F.col("band"))
    m = measurements.withColumn("width", width).withColumn("bin", _bin(F.col("freq_mhz"), width)).alias("m")
    own = towers.select(F.col(freq).alias("f"), F.col(band).alias("b")).distinct().withColumn("w", rf.tolerance_mhz(F.col("b")))
    own = own.withColumn("o", _bin(F.col("f"), F.col("w")))
    own = own.withColumn("o", F.explode(F.array(F.col("o") - 1, F.col("o"), F.col("o") + 1))).alias("t")
    on = (F.col("m.band") == F.col("t.b")) & (F.col("m.bin") == F.col("t.o")) & (F.abs(F.col("m.freq_mhz") - F.col("t.f")) <= F.col("m.width"))
    return m.join(own, on, "left_anti").drop("width", "bin")


def recall(ranked: DataFrame, measurements: DataFrame) -> DataFrame:
    """Matched towers over signals, as one row; 0 without signals, and above 1 if towers share one."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    matched = ranked.select(F.when(F.col("frequency_matched"), one).otherwise(zero).alias("n_matched"), zero.alias("n_signals"))
    both = matched.unionByName(measurements.select(zero.alias("n_matched"), one.alias("n_signals")))
    sums = both.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("n_matched", "n_signals")])
    return sums.withColumn("recall", F.coalesce(F.try_divide(F.col("n_matched").cast("double"), "n_signals"), F.lit(0.0)))
