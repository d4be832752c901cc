"""Radio expressions: path loss, power, and the tables of channels and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MHz within which a measurement matches a transmitter of a band, and for other bands.
TOLERANCE_MHZ = {"FM": 0.15, "VHF": 4.0, "UHF": 4.0}
OTHER_TOLERANCE_MHZ = 1.0
#: Effective power taken for a transmitter that states none.
DEFAULT_EIRP_DBM = {"FM": 50.0}
OTHER_EIRP_DBM = 60.0
DEFAULT_GAIN_DBI = 10.0
#: Centres of the low television channels; the others follow from a rule.
LOW_CHANNELS = {2: 57, 3: 63, 4: 69, 5: 79, 6: 85}
MINUS_INFINITY = float("-inf")


def path_loss_db(km: Column, mhz: Column) -> Column:
    """Free-space path loss; none for a distance or frequency that is not positive."""
    loss = F.lit(20.0) * F.log10(km * 1000) + F.lit(20.0) * F.log10(mhz * 1e6) - 147.55
    return F.when((km <= 0) | (mhz <= 0), F.lit(0.0)).otherwise(loss)


def received_dbm(eirp_dbm: Column, km: Column, mhz: Column, gain_dbi: float) -> Column:
    return eirp_dbm + gain_dbi - path_loss_db(km, mhz)


def dbm(watts: Column) -> Column:
    return F.when(watts <= 0, F.lit(MINUS_INFINITY)).otherwise(F.lit(10.0) * F.log10(watts) + 30)


def watts(level_dbm: Column) -> Column:
    return F.pow(F.lit(10.0), (level_dbm - 30) / 10)


def device_eirp_dbm(eirp_w: Column, transmit_w: Column, gain_dbi: Column) -> Column:
    """Stated effective power, else transmitter power plus antenna gain, else null."""
    return F.coalesce(
        F.when(eirp_w > 0, dbm(eirp_w)),
        F.when(transmit_w > 0, dbm(transmit_w) + F.coalesce(gain_dbi, F.lit(DEFAULT_GAIN_DBI))),
    )


def default_eirp_dbm(band: Column) -> Column:
    out = F.lit(OTHER_EIRP_DBM)
    for name, value in DEFAULT_EIRP_DBM.items():
        out = F.when(band == name, F.lit(value)).otherwise(out)
    return out


def erp_kw(text: Column) -> Column:
    """Kilowatts from text such as ``180.   kW``."""
    return F.regexp_extract(text, r"([\d.]+)\s*kW", 1).try_cast("double")


def erp_to_eirp_dbm(kw: Column) -> Column:
    """Radiated power of a dipole as isotropic power."""
    return F.when(kw <= 0, F.lit(MINUS_INFINITY)).otherwise(F.lit(10.0) * F.log10(kw * 1000) + 30 + 2.15)


def band_of(mhz: Column, bands: Mapping[str, Sequence[tuple[float, float]]]) -> Column:
    """The first band, in the order given, with a range that holds the frequency, ends included."""
    out = F.lit(None).cast("string")
    for band, ranges in reversed(bands.items()):
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | mhz.between(float(low), float(high))
        out = F.when(inside, F.lit(band)).otherwise(out)
    return out


def distance_class(km: Column, classes: Sequence[tuple[str, float, float]]) -> Column:
    """The first class with low <= km < high, else Far."""
    out = F.lit("Far")
    for label, low, high in reversed(classes):
        out = F.when((km >= float(low)) & (km < float(high)), F.lit(label)).otherwise(out)
    return out


def tolerance_mhz(band: Column) -> Column:
    out = F.lit(OTHER_TOLERANCE_MHZ)
    for name, value in TOLERANCE_MHZ.items():
        out = F.when(band == name, F.lit(value)).otherwise(out)
    return out


def channel_mhz(channel: Column) -> Column:
    """Centre of a television channel; null for a number that is none."""
    out = F.when(channel.between(7, 13), F.lit(177.0) + 6 * (channel - 7)).when(channel.between(14, 36), F.lit(473.0) + 6 * (channel - 14))
    for number, mhz in LOW_CHANNELS.items():
        out = out.when(channel == number, F.lit(float(mhz)))
    return out


def looked_up(key: Column, table: Mapping[str, int], default: int = 99) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out
