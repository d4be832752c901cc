"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most one bit in one of three
segments. Each distinct fingerprint is indexed under every segment with every one bit of it wiped, 64
variants in all; equal variants meet in one run of a sorted partition, are verified there, and give the
links from which components are built.

Fingerprints are made distinct first, so copies, however many, count once. Inside a run no pair list is
built: short runs are compared by shifts and a pair is emitted only in the first variant it shares; long
runs emit the edges of a spanning forest of the verified links, which keeps every component. Very long ones
are split first: of five parts of the bits outside the segment, two fingerprints with four differing bits
agree in one, so equal parts make sub-runs that hold every link.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship_package, text_of
from .components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
#: Runs up to the first length are compared by shifts; those beyond the second are split. The links are the same.
SHORT_RUN, LONG_RUN = 48, 4096

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle_words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; 0 if it has no word."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle_words + 1, 1)
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # bounds the memory of very long texts
        some = zip(starts[at : min(at + 8192, n)].tolist(), ends[at : at + 8192], strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in some], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (segment, wiped bit, rest of the segment) and the fingerprint of each."""
    keys = []
    for s, (first, bits) in enumerate(SEGMENTS):
        part = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        for b in range(bits):
            keys.append((part & ~np.uint64(1 << b)).astype(np.int64) | (s << 27) | (b << 22))
    return np.concatenate(keys), np.tile(fps, len(keys))


def _first_shared(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first variant that two fingerprints with XOR ``x`` share."""
    first = np.full(len(x), -1, np.int64)
    for s, (low, bits) in enumerate(SEGMENTS):
        part = (x >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        bit = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1)))
        here = (first < 0) & (np.bitwise_count(part) <= 1)
        first[here] = (s << 5) | bit[here].astype(np.int64)
    return first == keys >> 22


def _forest(fps: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Edges of a spanning forest of the links among ``fps``."""
    a, b, rest = [], [], fps
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            v = frontier.pop()
            near = np.bitwise_count(rest ^ v) <= max_bits
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), v))
                b.append(found)
                frontier.extend(found)
                rest = rest[~near]
    return a, b


def _split(fps: np.ndarray, segment: int, max_bits: int) -> tuple[list, list]:
    """The edges of spanning forests of the sub-runs of a long run."""
    first, bits = SEGMENTS[segment]
    outside = [b for b in range(64) if not first <= b < first + bits]
    a, b = [], []
    for part in np.array_split(np.array(outside, np.uint64), max_bits + 1):
        mask = np.bitwise_or.reduce(np.uint64(1) << part)
        order = np.argsort(fps & mask, kind="stable")
        some = fps[order]
        ends = np.flatnonzero(np.diff(some & mask)) + 1
        for run in np.split(some, ends):
            if len(run) > 1:
                x, y = _forest(run, max_bits)
                a += x
                b += y
    return a, b


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys."""
    a, b = [], []
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate(([0], edges))
    lengths = np.diff(np.concatenate((starts, [len(keys)])))
    for s in np.flatnonzero(lengths > SHORT_RUN):
        run = fps[starts[s] : starts[s] + lengths[s]]
        x, y = _split(run, int(keys[starts[s]] >> 27), max_bits) if len(run) > LONG_RUN else _forest(run, max_bits)
        a += x
        b += y
    keep = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
    keys, fps = keys[keep], fps[keep]
    for shift in range(1, min(SHORT_RUN, len(keys))):
        same = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(same):
            break
        x = fps[same] ^ fps[same + shift]
        ok = np.bitwise_count(x) <= max_bits
        ok[ok] = _first_shared(x[ok], keys[same[ok]])
        a.append(fps[same[ok]])
        b.append(fps[same[ok] + shift])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def near_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) at most ``max_bits`` (up to 4) apart.

    Fingerprints are connected by these links exactly if they are by all such pairs.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("three segments hold at most 4 differing bits")
    ship_package(fps.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                keys, of = _variants(fps[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(of.view(np.int64))], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = [], []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            held_keys.append(keys)
            held.append(fps)
            if keys[0] == keys[-1] and held_keys[0][0] == keys[0]:
                continue  # a run that goes on
            keys, fps = np.concatenate(held_keys), np.concatenate(held)
            cut = np.searchsorted(keys, keys[-1])
            yield out(*_links(keys[:cut], fps[:cut], max_bits))
            held_keys, held = [keys[cut:]], [fps[cut:]]
        if held:
            yield out(*_links(np.concatenate(held_keys), np.concatenate(held), max_bits))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return (
        fps.select("fp")
        .mapInArrow(index, "key int, fp bigint")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(verify, "a bigint, b bigint")
    )


def grouped(printed: DataFrame, fps: DataFrame, roots: DataFrame, sieve_buckets: int) -> DataFrame:
    """The groups of rows (``printed``) whose distinct fingerprints (``fps``) hang on ``roots``."""
    # Written, so that the joins read both sides afresh and a large component can be split over tasks.
    rooted = materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "best", "n", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    groups = materialize(rooted.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("n")), "simhash-groups")
    of_print = materialize(rooted.select("fp", "root").join(groups.filter("n > 1"), "root").select("fp", "best"), "simhash-shared")
    # Rows with company are told from the others by a sieve of at most ``sieve_buckets`` rows; a collision
    # only sends a row to the join that finds nothing there. A sieve that would be a quarter full is not made.
    named = printed.withColumnRenamed("fingerprint", "fp")
    if of_print.count() <= sieve_buckets // 4:
        bucket = F.pmod(F.xxhash64("fp"), F.lit(sieve_buckets)).cast("int").alias("bucket")
        sieve = of_print.select(bucket).distinct().withColumn("hit", F.lit(True))
        sieved = named.withColumn("bucket", bucket).join(F.broadcast(sieve), "bucket", "left")
    else:
        sieved = named.withColumn("hit", F.lit(True))
    alone = sieved.filter("hit is null").select("row", "fp", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    shared = sieved.filter("hit").join(of_print, "fp", "left")
    grouped = shared.select(
        "row",
        "fp",
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        (F.col("best").isNull() | (F.col("uid") == F.col("best.uid"))).alias("kept"),
    )
    return alone.unionByName(grouped).withColumnRenamed("fp", "fingerprint")


def simhash_dedup(
    docs: DataFrame,
    carry: Sequence[Column | str] = ("*",),
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    max_bits: int = 4,
    sieve_buckets: int = 1 << 20,
    similarity: float | None = None,
) -> DataFrame:
    """Near-duplicate groups: documents linked by fingerprints at most ``max_bits`` apart, transitively.

    With ``similarity``, documents whose sets of five-word shingles are at least so much alike are linked too, which
    is checked on the sets themselves. Four bits do not reach 0.8 (see the README), so candidates for that come
    from bands of min-hashes; see ``minhash``.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``fingerprint`` (long),
    ``component_id`` (the smallest id in the group) and ``kept`` (true for one row of each group: that
    with the smallest id, null ids last).

    Texts without a word, null ones too, have fingerprint zero and are linked like any other. Null ids
    never become a component's id unless it has no other. Repeated rows share a group. An empty table
    gives an empty result. Other columns ride along inside ``row``, whatever their names.
    """
    if similarity is not None:
        from .minhash import jaccard_dedup

        return jaccard_dedup(docs, carry, id_col, text_col, similarity=similarity, max_bits=max_bits, sieve_buckets=sieve_buckets)
    whole = list(carry) == ["*"]  # then the text travels inside the row, once

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_col) if whole else batch.column(2)
            found = [fingerprint(t.as_py() or "", shingle_words) for t in texts]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["row", "id", "fingerprint"])

    ship_package(docs.sparkSession)
    source = docs.select(F.struct(*carry).alias("row"), F.col(id_col).alias("id"), *([] if whole else [text_of(text_col).alias("text")]))
    schema = T.StructType([source.schema["row"], source.schema["id"], T.StructField("fingerprint", T.LongType())])
    printed = materialize(
        source.mapInArrow(prints, schema).withColumn("uid", F.monotonically_increasing_id()), "simhash"
    )
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("best")
    fps = materialize(printed.groupBy(F.col("fingerprint").alias("fp")).agg(best, F.count(F.lit(1)).alias("n")), "simhash-distinct")
    return grouped(printed, fps, components(near_links(fps, max_bits)), sieve_buckets)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_dedup(docs, carry=["doc_id"]).select(
        "row.doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
