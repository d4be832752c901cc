"""From devices to ranked towers, for one receiver or many."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, rf
from ..plans.config import RankingConfig
from ..shared import shared_dir
from .match import match_listed, match_values, nearest, nearest_listed
from .numbering import numbered

#: Up to so many rows of a receiver, its ranking is one window, cut before the shuffle.
WINDOW_ROWS = 10_000


def in_broadcast_band(devices: DataFrame, config: RankingConfig) -> DataFrame:
    """Devices with a frequency in a broadcast band, which is added."""
    return devices.filter("freq is not null and not isnan(freq)").withColumn("band", rf.band_of(F.col("freq"), config.bands)).filter("band is not null")


def located(devices: DataFrame) -> DataFrame:
    """Devices whose geometry parsed."""
    return devices.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def in_radius(devices: DataFrame, receivers: DataFrame, typical_km: float = 80.0) -> DataFrame:
    """Pairs of device and receiver (receiver_id, rx_lat, rx_lon, radius_km) at most the radius apart.

    An equi-join on cells finds the candidates, each pair once; the distance decides. The cells fit
    radii of ``typical_km``; others give the same pairs from more cells or more candidates. Neither side is
    broadcast by hint: Spark does so if its statistics say that receivers are few.
    """
    n = geo.cells_per_degree(typical_km)
    reach = receivers.withColumn("cell", F.explode(F.array_distinct(geo.cells_in_reach(F.col("rx_lat"), F.col("rx_lon"), F.col("radius_km").cast("double"), n))))
    keyed = devices.withColumn("cell", geo.grid_cell(F.col("lat"), F.col("lon"), n))
    distance = geo.haversine_km(F.col("rx_lat"), F.col("rx_lon"), F.col("lat"), F.col("lon"))
    return keyed.join(reach, "cell").drop("cell").withColumn("dist", distance).filter(F.col("dist") <= F.col("radius_km"))


def with_eirp(devices: DataFrame) -> DataFrame:
    """Adds ``eirp`` in dBm: as stated, else as a transmitter of the band has it."""
    eirp = F.coalesce(rf.device_eirp_dbm(F.col("eirp_w"), F.col("transmit_w"), F.col("gain_dbi")), rf.default_eirp_dbm(F.col("band")))
    return devices.withColumn("eirp", eirp)


def audible(pairs: DataFrame, config: RankingConfig) -> DataFrame:
    """Pairs received at the sensitivity or above; adds ``eirp`` and ``power`` in dBm."""
    power = rf.received_dbm(F.col("eirp"), F.col("dist"), F.col("freq"), config.rx_gain_dbi)
    return with_eirp(pairs).withColumn("power", power).filter(F.col("power") >= config.sensitivity_dbm)


def project(pairs: DataFrame, config: RankingConfig, *more: str) -> DataFrame:
    """The columns of a tower, rounded half to even, and those named; needs ``m``, the matched measurement or null."""
    bearing = geo.bearing_deg(F.col("rx_lat"), F.col("rx_lon"), F.col("lat"), F.col("lon"))
    return pairs.withColumn("bearing", bearing).select(
        "receiver_id",
        "max_rows",
        "ord",
        "callsign",
        "name",
        "state",
        F.bround("freq", 3).alias("frequency_mhz"),
        "band",
        F.bround("lat", 6).alias("latitude"),
        F.bround("lon", 6).alias("longitude"),
        F.col("height_m").alias("antenna_height_m"),
        F.bround("dist", 1).alias("distance_km"),
        F.bround("bearing", 1).alias("bearing_deg"),
        geo.cardinal(F.col("bearing")).alias("bearing_cardinal"),
        F.bround("power", 1).alias("received_power_dbm"),
        rf.distance_class(F.col("dist"), config.distance_classes).alias("distance_class"),
        F.bround("eirp", 1).alias("eirp_dbm"),
        "licence_type",
        "licence_subtype",
        F.col("m").isNotNull().alias("frequency_matched"),
        F.col("m").isNotNull().alias("measured"),
        "m.snr_db",
        "m.score",
        "m.power_db",
        "m.obw_fraction",
        *[c for c in ("sent",) if c in pairs.columns],
        *more,
    )


def keep_strongest(towers: DataFrame) -> DataFrame:
    """For each receiver, callsign and rounded frequency the strongest row, the first of equals.

    ``first_ord`` is where the key first appeared. One aggregation that combines before the shuffle, so
    a callsign that holds a third of all rows costs its tasks one row each.
    """
    keys = ["receiver_id", "callsign", "frequency_mhz"]
    rest = [c for c in towers.columns if c not in keys]
    return (
        towers.groupBy(*keys)
        .agg(
            F.min(F.struct((-F.col("received_power_dbm")).alias("less"), F.col("ord").alias("at"), F.struct(*rest).alias("row"))).alias("best"),
            F.min("ord").alias("first_ord"),
        )
        .select(*keys, "best.row.*", "first_ord")
    )


def sort_columns(config: RankingConfig, towers: DataFrame) -> list[Column]:
    """The configured order; ties stay in order of first appearance. Missing values and fields count as 0."""
    out, kinds = [], dict(towers.dtypes)
    for name, ascending in config.sort_order:
        if name == "band_priority":
            key = rf.looked_up(F.col("band"), config.band_priority)
        elif name == "distance_priority":
            key = rf.looked_up(F.col("distance_class"), config.distance_priority)
        elif name in kinds:
            key = F.coalesce(F.col(name), F.lit("" if kinds[name] == "string" else 0).cast(kinds[name]))
        else:
            continue
        out.append(key.asc() if ascending else key.desc())
    return [*out, F.col("first_ord").asc()]


def rank(towers: DataFrame, config: RankingConfig, most_rows: int | None = None) -> DataFrame:
    """The first ``max_rows`` of each receiver, numbered from 1.

    ``most_rows``, where the caller knows that no ``max_rows`` exceeds it, lets Spark rank before the shuffle; a receiver
    that asks for more fails the query. Without it, or if it is large, a receiver's towers are numbered by many tasks.
    """
    order = sort_columns(config, towers)
    if most_rows is None or most_rows > WINDOW_ROWS:
        ranked = numbered(towers, ["receiver_id"], order).filter(F.col("rank") <= F.col("max_rows"))
    else:
        ranked = towers.withColumn("rank", F.row_number().over(Window.partitionBy("receiver_id").orderBy(*order))).filter(F.col("rank") <= most_rows)
        asked = F.when(F.col("max_rows") > most_rows, F.raise_error(F.lit(f"a receiver asks for more rows than most_rows = {most_rows}"))).otherwise(F.col("max_rows"))
        ranked = ranked.filter(F.col("rank") <= asked.cast("int"))
    return ranked.drop("max_rows", "ord", "first_ord")


def with_defaults(receivers: DataFrame, config: RankingConfig) -> DataFrame:
    """Receivers (receiver_id, rx_lat, rx_lon[, radius_km, max_rows]); 0 and missing mean the configured values."""
    for name, value in (("radius_km", float(config.default_radius_km)), ("max_rows", config.default_limit)):
        given = F.col(name) if name in receivers.columns else F.lit(None)
        receivers = receivers.withColumn(name, F.coalesce(F.when(given > 0, given), F.lit(value)))
    return receivers


def candidates(devices: DataFrame, receivers: DataFrame, config: RankingConfig, typical_km: float | None = None) -> DataFrame:
    """All that can be ranked: in band, located, in radius, audible."""
    pairs = in_radius(located(in_broadcast_band(devices, config)), with_defaults(receivers, config), typical_km or config.default_radius_km)
    return audible(pairs, config)


def tuned(devices: DataFrame, config: RankingConfig) -> DataFrame:
    """The different (freq, band) of devices: what a match depends on, whoever receives it."""
    return in_broadcast_band(devices, config).select("freq", "band").distinct()


def rank_towers(
    devices: DataFrame,
    receivers: DataFrame,
    config: RankingConfig,
    measurements: DataFrame | Sequence[dict] | None = None,
    typical_km: float | None = None,
    most_rows: int | None = None,
) -> DataFrame:
    """Rank the towers around each receiver.

    With measurements (a DataFrame, or a short list) only towers that one of them matches are ranked;
    an empty list means none were sent. The strongest row of a key is chosen before unmatched ones go, so
    a key whose strongest row is unmatched goes as a whole. A match depends on frequency and band only, so a
    table of measurements meets the different ones of these, not the pairs of device and receiver.

    ``typical_km`` and ``most_rows`` say what radii and row limits receivers with their own ones have. With ``most_rows`` and
    their own limits, many receivers are ranked in stages (``ranked_in_stages``).
    """
    if in_stages(receivers, most_rows):
        return ranked_in_stages(devices, receivers, config, most_rows, measurements, typical_km)
    found = candidates(devices, receivers, config, typical_km)
    given = measurements is not None and not (isinstance(measurements, Sequence) and not measurements)
    if not given:
        found = match_values(found, [])
    elif isinstance(measurements, Sequence):
        found = match_values(found, measurements)
    else:
        found = found.join(nearest(tuned(devices, config), measurements), ["freq", "band"], "left")
    towers = keep_strongest(project(found, config))
    if given:
        towers = towers.filter("frequency_matched")
    return rank(towers, config, config.default_limit if "max_rows" not in receivers.columns else most_rows)


def rank_requests(devices: DataFrame, requests: DataFrame, config: RankingConfig, typical_km: float | None = None, most_rows: int | None = None) -> DataFrame:
    """Rank the towers around each of many requests that carry their own measurements.

    ``requests`` are receivers with a column ``measurements`` (``match.as_lists``). One that sends some has only the towers
    ranked that one of its own matches; one with a null or empty list has all of them. Lists ride with the receivers into
    the join by cells and end in it: each pair keeps its nearest measurement only.
    """
    if in_stages(requests, most_rows):
        return ranked_in_stages(devices, requests, config, most_rows, None, typical_km)
    sent = F.coalesce(F.size("measurements") > 0, F.lit(False))
    found = match_listed(candidates(devices, requests.withColumn("sent", sent), config, typical_km)).drop("measurements")
    towers = keep_strongest(project(found, config)).filter("frequency_matched or not sent").drop("sent")
    return rank(towers, config, config.default_limit if "max_rows" not in requests.columns else most_rows)


# Many receivers with few rows each -------------------------------------------------------------------

#: Bits of a device's number, below those of a power in tenths of a dB, in one number that a hash aggregation can take the least of.
DEVICE_BITS = 40
#: Tenths of a dB beyond which powers count as equal.
MOST_TENTHS = float(2**22)


def band_stages(config: RankingConfig) -> list[list[str]]:
    """The bands in the order that a ranking has them, those of one priority together.

    One stage with all of them if the order does not begin with bands, or if bands of different stages come so near to
    each other that one rounded frequency may stand for both.
    """
    first, ascending = config.sort_order[0] if config.sort_order else ("", True)
    stages: dict[int, list[str]] = {}
    for band in config.bands:
        stages.setdefault(config.band_priority.get(band, 99), []).append(band)
    ranges = sorted((low, high, config.band_priority.get(band, 99)) for band, own in config.bands.items() for low, high in own)
    apart = all(round(b[0], 3) - round(a[1], 3) > 0.0005 for i, a in enumerate(ranges) for b in ranges[i + 1 :] if a[2] != b[2])
    if first != "band_priority" or not apart or len(stages) < 2:
        return [list(config.bands)]
    return [stages[p] for p in sorted(stages, reverse=not ascending)]


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _tenths(power: Column) -> Column:
    """A power rounded half to even to tenths, in tenths; decimal arithmetic only decides what lies next to a half."""
    scaled = power * 10
    plain = F.abs(F.abs(scaled - F.floor(scaled)) - 0.5) > 1e-6
    found = F.when(F.isnan(power), F.lit(-MOST_TENTHS)).when(plain, F.rint(scaled)).otherwise(F.rint(F.bround(power, 1) * 10))
    return F.least(F.greatest(found, F.lit(-MOST_TENTHS)), F.lit(MOST_TENTHS)).cast("long")


def strongest_of_each(devices: DataFrame, receivers: DataFrame, config: RankingConfig, typical_km: float, same: Sequence[str] = ()) -> DataFrame:
    """(receiver_id, device, first): for each receiver, callsign and rounded frequency the strongest device and the first, by number.

    ``devices``: numbered, with band and ``eirp``; ``receivers``: with radius_km and, if they want certain frequencies only,
    the list ``wanted``. Receivers of one cell and kind of radius meet the devices around the cell, each of them once, so what
    is combined before the shuffle is a receiver's whole. Only numbers and the callsign take part.
    """
    n = geo.cells_per_degree(typical_km)
    home = ["home", "size", *same]
    placed = receivers.withColumn("home", geo.grid_cell(F.col("rx_lat"), F.col("rx_lon"), n)).withColumn("size", F.ceil(F.log2(F.col("radius_km"))).cast("int"))
    reach = placed.select(*home, F.explode(geo.cells_in_reach(F.col("rx_lat"), F.col("rx_lon"), F.col("radius_km"), n)).alias("cell")).distinct()
    own = devices.select("device", "callsign", F.bround("freq", 3).alias("frequency_mhz"), "freq", "lat", "lon", F.cos(F.radians("lat")).alias("cos_lat"), "eirp", *same, geo.grid_cell(F.col("lat"), F.col("lon"), n).alias("cell"))
    around = own.join(reach, ["cell", *same]).drop("cell")
    low, high = geo.latitude_reach(F.col("rx_lat"), F.col("radius_km"))
    low, high = F.when(low > -90, low).otherwise(F.lit(float("-inf"))), F.when(high < 90, high).otherwise(F.lit(float("inf")))
    asking = placed.select("receiver_id", "rx_lat", "rx_lon", F.cos(F.radians("rx_lat")).alias("cos_rx"), "radius_km", *home, low.alias("low"), high.alias("high"), geo.longitude_reach(F.col("rx_lat"), F.col("radius_km")).alias("wide"), *[c for c in ("wanted",) if c in receivers.columns])
    beside = F.abs(F.pmod(F.col("lon") - F.col("rx_lon") + 180, F.lit(360.0)) - 180)
    # A little wider than the circle; the distance decides.
    box = (F.col("lat") >= F.col("low") - 1e-6) & (F.col("lat") <= F.col("high") + 1e-6) & ((F.col("wide") >= 90.0) | (beside <= F.col("wide")))
    pairs = around.join(asking, home).filter(box)
    if "wanted" in receivers.columns:
        pairs = pairs.filter(F.col("wanted").isNull() | F.array_contains("wanted", F.col("frequency_mhz")))
    # Exploded, a distance and a power are computed once for each pair, whatever reads them.
    distance = geo.haversine_km(F.col("rx_lat"), F.col("rx_lon"), F.col("lat"), F.col("lon"), F.col("cos_rx"), F.col("cos_lat"))
    pairs = pairs.withColumn("dist", F.explode(F.array(distance))).filter(F.col("dist") <= F.col("radius_km"))
    power = rf.received_dbm(F.col("eirp"), F.col("dist"), F.col("freq"), config.rx_gain_dbi)
    heard = pairs.withColumn("power", F.explode(F.array(power))).filter(F.col("power") >= config.sensitivity_dbm)
    best = F.min(F.shiftleft(-_tenths(F.col("power")), DEVICE_BITS) + F.col("device")).alias("best")
    found = heard.groupBy("receiver_id", "callsign", "frequency_mhz").agg(best, F.min("device").alias("first"))
    return found.select("receiver_id", F.col("best").bitwiseAND((1 << DEVICE_BITS) - 1).alias("device"), "first")


def in_stages(receivers: DataFrame, most_rows: int | None) -> bool:
    """Whether ``ranked_in_stages`` can rank receivers: they have row limits of their own, known to be small, and each an id of its own."""
    if "max_rows" not in receivers.columns or most_rows is None or most_rows > WINDOW_ROWS:
        return False
    ids = receivers.groupBy("receiver_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.filter("n > 1 or receiver_id is null").isEmpty()


def ranked_in_stages(
    devices: DataFrame,
    receivers: DataFrame,
    config: RankingConfig,
    most_rows: int,
    measurements: DataFrame | Sequence[dict] | None = None,
    typical_km: float | None = None,
    same: Sequence[str] = (),
) -> DataFrame:
    """What ``rank_towers`` and ``rank_requests`` give, for many receivers of at most ``most_rows`` rows each.

    Bands are ranked one after the other, and receivers whose rows one stage fills do not meet the devices of the next.
    Pairs of receiver and device hold numbers only: devices are numbered in their order once, the strongest and the first
    of each key are found by number, and only these become towers. Frequencies that no measurement matches take no part
    where measurements were sent. Each stage's rows are written to the shared folder.

    ``receivers`` may carry ``measurements``, as those of ``rank_requests`` do. ``same``: columns in which receiver and device
    must agree. Every receiver needs an id of its own (``in_stages``).
    """
    listed = "measurements" in receivers.columns
    asked = with_defaults(receivers, config)
    if listed:
        asked = asked.withColumn("sent", F.coalesce(F.size("measurements") > 0, F.lit(False)))
    spark = devices.sparkSession
    # In several files, since a few megabytes of receivers have much to do.
    own = _kept(asked.select("receiver_id", "rx_lat", "rx_lon", F.col("radius_km").cast("double").alias("radius_km"), "max_rows", *same, *["sent"] * listed).repartition(spark.sparkContext.defaultParallelism, "receiver_id"), "receivers")
    if not own.filter(F.col("max_rows") > most_rows).isEmpty():
        raise ValueError(f"a receiver asks for more rows than most_rows = {most_rows}")

    parsed = _kept(with_eirp(located(in_broadcast_band(devices, config))), "parsed")
    numbers = _kept(numbered(parsed, [], [F.col("ord").asc()], "device", "long"), "devices")
    tuned = numbers.select("freq", "band").distinct()
    given = listed or measurements is not None and not (isinstance(measurements, Sequence) and not measurements)
    matches = None
    if listed:
        matches = _kept(nearest_listed(tuned, asked.filter("sent").select("receiver_id", "measurements")), "matches")
    elif given and not isinstance(measurements, Sequence):
        matches = _kept(nearest(tuned, measurements), "matches")
        numbers = numbers.join(matches.select(F.bround("freq", 3).alias("_mhz")).distinct(), F.bround("freq", 3) == F.col("_mhz"), "left_semi")

    left, done = own.withColumn("_before", F.lit(0)), []
    stages = band_stages(config)
    for stage in stages:
        some = numbers.filter(F.col("band").isin(stage))
        asking = left
        if listed:
            wanted = matches.filter(F.col("band").isin(stage)).groupBy("receiver_id").agg(F.collect_set(F.bround("freq", 3)).alias("wanted"))
            asking = left.join(wanted, "receiver_id", "left").filter("wanted is not null or not sent")
        found = strongest_of_each(some, asking, config, typical_km or config.default_radius_km, same)
        # The towers, from the devices' and receivers' own columns.
        pairs = found.join(some.drop(*same), "device").join(left.drop(*same), "receiver_id")
        pairs = pairs.withColumn("dist", geo.haversine_km(F.col("rx_lat"), F.col("rx_lon"), F.col("lat"), F.col("lon")))
        pairs = pairs.withColumn("power", rf.received_dbm(F.col("eirp"), F.col("dist"), F.col("freq"), config.rx_gain_dbi))
        if matches is not None:
            pairs = pairs.join(matches, [*["receiver_id"] * listed, "freq", "band"], "left")
        else:
            pairs = match_values(pairs, measurements or [])
        towers = project(pairs, config, "first", "_before").withColumnRenamed("first", "first_ord")
        if given:
            towers = towers.filter("frequency_matched or not sent" if listed else "frequency_matched")
        by = Window.partitionBy("receiver_id").orderBy(*sort_columns(config, towers))
        ranked = towers.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most_rows)
        ranked = ranked.withColumn("rank", F.col("rank") + F.col("_before")).filter(F.col("rank") <= F.col("max_rows"))
        keys = ["receiver_id", "callsign", "frequency_mhz"]
        rest = [c for c in ranked.columns if c not in (*keys, "max_rows", "ord", "first_ord", "sent", "_before")]
        done.append(_kept(ranked.select(*keys, *rest), "ranked"))
        if stage is stages[-1]:
            break
        filled = done[-1].groupBy("receiver_id").agg(F.count(F.lit(1)).cast("int").alias("_more"))
        left = left.join(filled, "receiver_id", "left").withColumn("_before", F.col("_before") + F.coalesce("_more", F.lit(0))).drop("_more")
        left = _kept(left.filter(F.col("_before") < F.col("max_rows")), "receivers")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
