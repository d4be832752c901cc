"""Spectrum-analyser sweeps: event lines as measurements. Works on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .schema import SWEEP_EVENT

#: The analyser's names of bands.
BANDS = {"fm": "FM", "uhf": "UHF", "vhf_hi": "VHF"}


def measurements(lines: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Measurements of (line, ordinal): channels of step events in known bands, scored above ``min_score``.

    Lines that do not start with ``data: `` or hold no JSON are skipped. FM channels keep snr_db and
    obw_fraction, television channels their power.
    """
    line = F.trim("line")

    def parsed(c: Column) -> Column:
        band = F.lit(None).cast("string")
        for raw, name in BANDS.items():
            band = F.when(c["band"] == raw, F.lit(name)).otherwise(band)
        fm = c["band"] == "fm"
        return F.struct(
            text.number(c["fc_mhz"]).alias("freq_mhz"),
            band.alias("band"),
            F.when(fm, c["snr_db"]).alias("snr_db"),
            F.when(fm, c["obw_fraction"]).alias("obw_fraction"),
            F.coalesce(text.number(c["score"]), F.lit(0.0)).alias("score"),
            F.when(~fm, c["channel_power_db"]).alias("power_db"),
        )

    # Both parsers stand in lists that are exploded: a filter on their results would repeat them below itself.
    event = F.from_json(F.substring(line, F.lit(7), F.length(line)), SWEEP_EVENT)
    return (
        lines.filter(line.startswith("data: "))
        .select("ordinal", F.explode(F.array(event)).alias("event"))
        .filter("event.type = 'step'")
        .select("ordinal", F.posexplode(F.transform("event.channels", parsed)).alias("channel_no", "c"))
        .select("ordinal", "channel_no", "c.*")
        .filter(F.col("band").isNotNull() & F.col("freq_mhz").isNotNull() & (F.col("score") > min_score))
    )


def best_of(found: DataFrame) -> DataFrame:
    """The best-scored measurement of each (freq_mhz, band), the first of equals; combines before the shuffle.

    ``first_ordinal`` is where the key was first seen, which is the order of the result.
    """
    seen = F.struct("ordinal", "channel_no")
    return (
        found.groupBy("freq_mhz", "band")
        .agg(
            F.min(F.struct((-F.col("score")).alias("less"), seen.alias("seen"), "snr_db", "obw_fraction", "power_db")).alias("best"),
            F.min(seen).alias("first_seen"),
        )
        .select(
            "freq_mhz",
            "band",
            "best.snr_db",
            "best.obw_fraction",
            (-F.col("best.less")).alias("score"),
            "best.power_db",
            F.col("first_seen.ordinal").alias("first_ordinal"),
            F.col("first_seen.channel_no").alias("first_channel"),
        )
    )
