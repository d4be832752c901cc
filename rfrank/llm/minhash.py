"""Near-duplicates by the Jaccard similarity of word-shingle sets, decided exactly.

Min-hash bands find candidates: two sets of similarity s share one of ``BANDS`` band keys with probability
1 - (1 - s ** ROWS) ** BANDS, 0.9996 at 0.8. Every candidate pair is then checked on the sets themselves.

Equal sets are made one first, so copies count once. Candidates hang together in clusters, most of them
small: the texts of a cluster of at most ``LOCAL_SETS`` sets meet in one task, each once, however many bands
they share, and are solved to a spanning forest of their similar pairs, which keeps every component. Of
larger clusters, short buckets give all their pairs, which a join checks, and a long bucket is solved as a
whole.

Rows are not copied: what is written of a row are its set's hash, its band keys and two hashes of its text
and id, by which its fate is joined back to it where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, ship_package, text_of
from .components import components
from .simhash import _LOWER, fingerprint, near_links

BANDS, ROWS = 20, 5
#: Buckets of more sets than this are solved as a whole.
SHORT_RUN = 16
#: Clusters of at most so many sets, with so many shingles in all, are solved in one task.
LOCAL_SETS, LOCAL_SHINGLES = 1024, 1 << 20
#: Sets that a task remembers, so that copies give their band keys once.
SEEN = 1 << 18

_draw = np.random.Generator(np.random.PCG64(42))
_SALTS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str, shingle_words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; a shorter text is one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(len(words) - shingle_words + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle_words]), 42) for i in range(n)), np.uint64, n))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band of the min-hashes of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):  # bounds the memory of very long texts
        mixed = (found[at : at + 1024, None] ^ _SALTS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _FACTORS[::-1]).min(0))
    import xxhash

    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs at least ``similarity`` alike."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    by_code = np.argsort(codes, kind="stable")
    holders = np.repeat(np.arange(len(sets)), sizes)[by_code]
    first = np.concatenate(([0], np.cumsum(np.bincount(codes))))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    alone, a, b = np.ones(len(sets), bool), [], []
    for root in range(len(sets)):
        if not alone[root]:
            continue
        alone[root] = False
        frontier = [root]
        while frontier and alone.any():
            v = frontier.pop()
            own = codes[starts[v] : starts[v + 1]]
            common = np.bincount(np.concatenate([holders[first[c] : first[c + 1]] for c in own]), minlength=len(sets))
            near = np.flatnonzero(alone & (common / (sizes + sizes[v] - common) >= similarity))
            alone[near] = False
            a.append(np.full(len(near), nodes[v]))
            b.append(nodes[near])
            frontier.extend(near.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def candidates(members: DataFrame) -> DataFrame:
    """From (key, fp): pairs (a, b) of short buckets, key null, and members (a, key) of long ones, b null.

    Members may be repeated.
    """

    def split(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])))
        keys, fps = keys[new], fps[new]
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts = np.concatenate(([0], edges))
        lengths = np.repeat(np.diff(np.concatenate((starts, [len(keys)]))), np.diff(np.concatenate((starts, [len(keys)]))))
        long = lengths > SHORT_RUN
        a, b = [], []
        short_keys, short = keys[~long], fps[~long]
        for shift in range(1, min(SHORT_RUN, len(short))):
            same = np.flatnonzero(short_keys[shift:] == short_keys[:-shift])
            if not len(same):
                break
            a.append(np.minimum(short[same], short[same + shift]))
            b.append(np.maximum(short[same], short[same + shift]))
        none = np.zeros(0, np.int64)
        a, b, n = np.concatenate([none, *a]), np.concatenate([none, *b]), int(long.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a, fps[long]])),
                pa.concat_arrays([pa.array(b), pa.nulls(n, pa.int64())]),
                pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(keys[long])]),
            ],
            ["a", "b", "key"],
        )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = [], []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            held_keys.append(keys)
            held.append(batch.column(1).to_numpy(zero_copy_only=False))
            if keys[0] == keys[-1] and held_keys[0][0] == keys[0]:
                continue  # a run that goes on
            keys, fps = np.concatenate(held_keys), np.concatenate(held)
            cut = np.searchsorted(keys, keys[-1])
            yield split(keys[:cut], fps[:cut])
            held_keys, held = [keys[cut:]], [fps[cut:]]
        if held:
            yield split(np.concatenate(held_keys), np.concatenate(held))

    return members.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(runs, "a bigint, b bigint, key bigint")


def jaccard_dedup(
    docs: DataFrame,
    carry: Sequence[Column | str] = ("*",),
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: float = 0.8,
    max_bits: int | None = None,
    sieve_buckets: int = 1 << 20,
) -> DataFrame:
    """Near-duplicate groups: documents linked by shingle sets at least ``similarity`` alike, transitively.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``fingerprint`` (of the
    set; null where a row is known to be alone without it), ``component_id`` and ``kept``, as ``simhash_dedup``
    does. Texts without a word, null ones too, have the empty set, and are alike only among themselves. With
    ``max_bits``, SimHash fingerprints (of four-word shingles) at most so many bits apart link documents too.
    """
    ship_package(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            prints_, sizes, keys, bits = [], [], [], []
            for t in batch.column(3):
                text = t.as_py()
                found = shingles(text, shingle_words)
                of = xxhash.xxh64_intdigest(found.tobytes(), 7)
                prints_.append(of)
                sizes.append(len(found))
                keys.append(band_keys(found).view(np.int64) if len(found) and of not in seen else [])
                bits.append(0 if max_bits is None else fingerprint(text))
                seen.add(of)
                if len(seen) > SEEN:
                    seen.clear()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.array(prints_, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(bits, np.uint64).view(np.int64))],
                ["k1", "k2", "id", "fingerprint", "size", "bands", "simhash"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle_words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "words"])

    def links_of(fps: pa.ChunkedArray, sets: list[np.ndarray]) -> pa.Table:
        a, b = _forest(fps.to_numpy(), sets, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def cluster(group: pa.Table) -> pa.Table:
        return links_of(group.column("fp"), [shingles(t.as_py(), shingle_words).view(np.int64) for t in group.column("text")])

    def bucket(group: pa.Table) -> pa.Table:
        return links_of(group.column("fp"), [np.asarray(w.values.to_numpy(zero_copy_only=False)) for w in group.column("words").combine_chunks()])

    # Rows that agree in these two are told apart only where one of them stays.
    text, own = text_of(text_col), ["k1", "k2"]
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col)).alias("k2")]
    told = F.pmod(F.xxhash64(*own), F.lit(sieve_buckets)).cast("int").alias("bucket")
    source = docs.select(*keys, F.col(id_col).alias("id"), text.alias("text"))
    long_ = lambda c: T.StructField(c, T.LongType())
    schema = T.StructType([long_("k1"), long_("k2"), source.schema["id"], long_("fingerprint"), long_("size"), T.StructField("bands", T.ArrayType(T.LongType())), long_("simhash")])
    printed = materialize(source.mapInArrow(prints, schema), "minhash")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *own)).alias("best")
    fps = materialize(printed.groupBy(F.col("fingerprint").alias("fp")).agg(best, F.max("size").alias("size"), F.count(F.lit(1)).alias("n")), "minhash-distinct")

    found = materialize(candidates(printed.select(F.explode("bands").alias("key"), F.col("fingerprint").alias("fp"))), "minhash-candidates")
    pairs = materialize(found.filter("b is not null").select("a", "b").distinct(), "minhash-pairs")
    long = found.filter("b is null").select("key", F.col("a").alias("fp"))
    stars = long.join(materialize(long.groupBy("key").agg(F.min("fp").alias("b")), "minhash-stars"), "key").select(F.col("fp").alias("a"), "b")
    of_cluster = materialize(components(pairs.unionByName(stars)).join(fps, F.col("node") == F.col("fp")).select("fp", "root", "size", "best.k1", "best.k2"), "minhash-clusters")
    here = (F.count(F.lit(1)) <= LOCAL_SETS) & (F.sum("size") <= LOCAL_SHINGLES)
    wanted = materialize(of_cluster.join(materialize(of_cluster.groupBy("root").agg(here.alias("here")), "minhash-sizes"), "root"), "minhash-wanted")

    def texts(some: DataFrame) -> DataFrame:
        """The texts of some sets, one each: a sieve drops most others before the join that drops the rest."""
        sieve = some.select(told).distinct()
        near = source.select(*own, "text").withColumn("bucket", told).join(F.broadcast(sieve), "bucket", "left_semi")
        return near.select(*own, "text").dropDuplicates(own).join(some.select("fp", "root", *own), own)

    done = [printed, fps, found, pairs, of_cluster, wanted]
    links = texts(wanted.filter("here")).select("root", "fp", "text").groupBy("root").applyInArrow(cluster, "a bigint, b bigint")
    large = wanted.filter("not here")
    if not large.isEmpty():
        sets = materialize(texts(large).select("fp", "text").mapInArrow(hashed, "fp bigint, words array<bigint>"), "minhash-sets")
        done.append(sets)
        left, right = (sets.select(F.col("fp").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
        common = F.size(F.array_intersect("words_a", "words_b"))
        alike = common / (F.size("words_a") + F.size("words_b") - common) >= similarity
        links = links.unionByName(pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b"))
        links = links.unionByName(long.join(sets, "fp").groupBy("key").applyInArrow(bucket, "a bigint, b bigint"))
    if max_bits is not None:  # each SimHash group as a star around its smallest set
        seen = materialize(printed.select("simhash", F.col("fingerprint").alias("a")).distinct(), "minhash-simhash")
        roots = components(near_links(seen.select(F.col("simhash").alias("fp")).distinct(), max_bits))
        rooted = seen.join(roots, seen["simhash"] == roots["node"], "left").select("a", F.coalesce("root", "simhash").alias("root"))
        rooted = materialize(rooted, "minhash-rooted")
        done += [seen, rooted]
        least = rooted.groupBy("root").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "b")
        links = links.unionByName(rooted.join(materialize(least, "minhash-least"), "root").filter("a != b").select("a", "b"))

    # Groups of more than one row, and of each row in them whose it is; written, so that the joins read both sides afresh.
    roots = components(links)
    joined = materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "best", "n", F.coalesce("root", "fp").alias("root")), "minhash-joined")
    groups = materialize(joined.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("n")).filter("n > 1").select("root", "best"), "minhash-groups")
    shared = materialize(joined.select("fp", "root").join(groups, "root").select("fp", "best"), "minhash-shared")
    fates = printed.select(*own, F.col("fingerprint").alias("fp")).join(shared, "fp").groupBy(*own).agg(F.first("fp").alias("fp"), F.first("best").alias("best"), F.count(F.lit(1)).alias("times"))
    fates = materialize(fates.withColumn("first", (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))), "minhash-fates")
    discard(*done, joined, groups, shared)

    # Rows with company are told from the others by a sieve of at most ``sieve_buckets`` rows; a collision
    # only sends a row to the join that finds nothing there. A sieve that would be a quarter full is not made.
    rows = docs.select(F.struct(*carry).alias("row"), F.col(id_col).alias("id"), *keys)
    if fates.count() <= sieve_buckets // 4:
        sieve = fates.select(told).distinct().withColumn("hit", F.lit(True))
        rows = rows.withColumn("bucket", told).join(F.broadcast(sieve), "bucket", "left")
    else:
        rows = rows.withColumn("hit", F.lit(True))
    alone = rows.filter("hit is null").select("row", F.lit(None).cast("long").alias("fingerprint"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    met = rows.filter("hit").join(fates, own, "left")
    again = F.coalesce(F.col("first") & (F.col("times") > 1), F.lit(False))  # rows of one text and id, one of which stays
    out = ["row", F.col("fp").alias("fingerprint"), F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id")]
    result = alone.unionByName(met.filter(~again).select(*out, F.coalesce("first", F.lit(True)).alias("kept")))
    if not fates.filter(again).isEmpty():
        repeated = materialize(met.filter(again).select("row", *own, "fp", "id", "best", F.monotonically_increasing_id().alias("uid")), "minhash-repeated")
        one = materialize(repeated.groupBy(*own).agg(F.min("uid").alias("least")), "minhash-one")
        result = result.unionByName(repeated.join(one, own).select(*out, (F.col("uid") == F.col("least")).alias("kept")))
    return result
