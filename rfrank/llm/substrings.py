"""Repeated passages: maximal repeats from a sparse enhanced suffix array, and their removal.

A passage of ``length`` bytes that occurs twice holds the same anchor both times: the leftmost smallest
hash of its ``gram``-byte grams. Each anchor thus owns a run of window starts, and windows can be equal
only if their anchors have one gram hash and the same place in the window. So texts are reduced to about
two anchors for every ``length`` bytes, and the search falls apart by gram hash. The anchors of a longer
window are among those of a shorter one, so two lengths share one index.

* Anchors whose gram hash is unique are dropped (a count, combined before the shuffle).
* The bytes that an anchor's windows cover are a segment. Equal segments (128 bits: gram and segment hash)
  become one suffix with its multiplicity; a gram with a single segment needs no tree.
* Segments that share a gram hash but differ are sorted as suffixes from the anchor on. A stack scan over
  the array of common prefixes gives the common-prefix interval tree; in each of its intervals the left
  contexts are compared in the same way, and members whose left extensions part only after the whole has
  reached ``length`` bytes form a maximal repeat, with all of its occurrences.

A gram hash with more than ``most_local`` different segments is not gathered in one task: the left and
right extensions of its suffixes are compared window by window in a shuffle, to the same result. Texts
never meet in one task; a document's spans are joined back to its text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, ship_package, text_of

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 17  # window starts handled at once
_POSITION = np.uint64((1 << 20) - 1)
_powers: dict[int, np.ndarray] = {}
#: The least length of passages that documents share, in bytes, and the most words of one that is no passage.
PASSAGE, PASSAGE_WORDS = 200, 50
#: Rows that go back from a Python worker at once: what is under way is in the memory of both sides.
ROWS = 1000


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of ``base`` modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(b: np.ndarray, gram: int) -> np.ndarray:
    """The hashes of all grams of ``b``."""
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _power(_INVERSE, len(b)), out=sums[1:])
    n = len(b) + 1 - gram
    return _mix((sums[gram:] - sums[:n]) * _power(_BASE, n))


def _least(coded: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each window of ``width`` values, from the running minima of blocks."""
    m = len(coded)
    blocks = np.concatenate((coded, np.full(-m % width, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: m - width + 1], ahead[width - 1 : m])


def _runs(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: Sequence[int], gram: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The anchors of windows whose first byte lies in [starts, ends), a range for each text, by length; see ``anchors``.

    ``ends`` holds a column for each length, so that windows stay inside their text. An anchor is the smallest
    of its window, ties to the left: the position is part of what is compared.
    """
    grams = _grams(b, gram)
    coded = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    narrow = lengths[0] - gram + 1
    least = _least(coded, narrow)
    runs = []
    for k, length in enumerate(lengths):
        wide, some = length - gram + 1, least
        if k:  # a wider window is the union of narrow ones
            n = len(coded) - wide + 1
            shifts = sorted({*range(0, wide - narrow, narrow), wide - narrow})
            some = least[:n] if n > 0 else least[:0]
            for shift in shifts[1:]:
                some = np.minimum(some, least[shift : shift + n])
        stop = np.maximum(ends[:, k], starts)
        sizes = stop - starts
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes[:-1]))), sizes) + np.arange(sizes.sum())
        owner = (some[at] & _POSITION).astype(np.int64)
        cut = np.flatnonzero(np.diff(owner)) + 1 if len(owner) else np.zeros(0, np.int64)
        firsts = np.concatenate((np.zeros(min(len(owner), 1), np.int64), cut))
        lasts = np.concatenate((cut - 1, np.full(min(len(owner), 1), len(owner) - 1)))
        runs.append((owner[firsts], at[firsts], at[lasts]))
    return grams[runs[0][0]], runs


def anchors(raw: bytes, lengths: Sequence[int], gram: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Gram hash and, for each length, (position, first, last owned window start) of every anchor of a text.

    The hashes belong to the anchors of the first length, the smallest; the others' are among these.
    """
    n = len(raw)
    b = np.frombuffer(raw, np.uint8)
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in lengths]
    hashes = [np.zeros(0, np.uint64)]
    for at in range(0, n - lengths[0] + 1, _CHUNK):
        some = b[at : at + _CHUNK + lengths[-1] - 1]
        ends = np.array([[min(_CHUNK, len(some) - length + 1) for length in lengths]])
        fp, runs = _runs(some, np.zeros(1, np.int64), ends, lengths, gram)
        hashes.append(fp)
        for part, run in zip(parts, runs, strict=True):
            part.append(tuple(x + at for x in run))
    none = (np.zeros(0, np.int64),) * 3
    out = []
    for k, some in enumerate(parts):
        p, first, last = map(np.concatenate, zip(none, *some, strict=True))
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else p  # a run may span two chunks
        out.append((p[starts], first[starts], last[np.append(starts[1:], len(p)) - 1 if len(p) else starts]))
        if not k:
            fp = np.concatenate(hashes)[starts]
    return fp, out


def _together(raws: list[bytes], lengths: Sequence[int], gram: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]]:
    """``anchors`` of many texts: (bytes, end of each text there, hashes, runs) for short texts joined and long ones alone."""
    held: list[bytes] = []
    size = 0

    def joined():
        ends = np.cumsum([len(r) for r in held])
        starts = ends - [len(r) for r in held]
        whole = b"".join(held)
        stops = np.stack([ends - length + 1 for length in lengths], 1)
        return whole, ends, *_runs(np.frombuffer(whole, np.uint8), starts, stops, lengths, gram)

    for raw in raws:
        if held and size + len(raw) > _CHUNK:
            yield joined()
            held, size = [], 0
        if len(raw) >= _CHUNK:
            yield raw, np.array([len(raw)]), *anchors(raw, lengths, gram)
        else:
            held.append(raw)
            size += len(raw)
    if held:
        yield joined()


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _sorted(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and the common prefix of each with the next in that order."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return np.array(order), np.array([_common(strings[i], strings[j]) for i, j in zip(order, order[1:], strict=False)], np.int64)


def intervals(prefix: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (depth, first, last) of a sorted array, by one stack scan."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*prefix, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


class Suffixes:
    """The different segments of one gram hash: contexts before the anchor, reversed, and from the anchor on."""

    def __init__(self, lefts: list[bytes], rights: list[bytes], length: int):
        self.lefts, self.rights, self.length = lefts, rights, length
        if len(lefts) == 2:
            self.prefix, self.shared = _common(*rights), _common(*lefts)
            return
        self.order, self.prefix = _sorted(rights)
        by_left, self.shared = _sorted(lefts)
        self.by_left, self.rank = by_left, np.empty(len(lefts), np.int64)
        self.rank[by_left] = np.arange(len(lefts))
        self.place = np.empty(len(lefts), np.int64)
        self.place[self.order] = np.arange(len(lefts))

    def spread(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each interval of the tree: depth, members in order of their left contexts, and what neighbours share there."""
        if len(self.lefts) == 2:
            yield self.prefix, np.arange(2), np.array([self.shared])
            return
        most = max(map(len, self.lefts))
        for depth, first, last in intervals(self.prefix.tolist()):
            if self.length - depth <= most:
                r = np.sort(self.rank[self.order[first : last + 1]])
                yield depth, self.by_left[r], np.minimum.reduceat(self.shared[: r[-1]], r[:-1])

    def repeats(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Maximal repeats of at least ``length`` bytes among different segments: left and right extension, members.

        Both extensions are diverse: the left one by the interval it is in, the right one because its
        members do not all share the byte after it.
        """
        for depth, members, between in self.spread():
            for left, a, b in intervals(between.tolist()):
                if left + depth >= self.length:
                    some = members[a : b + 1]
                    places = np.sort(self.place[some]) if len(self.lefts) > 2 else None
                    if places is None or self.prefix[places[0] : places[-1]].min() == depth:
                        yield left, depth, some

    def offsets(self, whole: Sequence[bool], documents: Sequence[int] | None = None) -> list[list[tuple[int, int]]]:
        """For each segment the window offsets (anchor minus window start; ends exclusive) that occur elsewhere.

        ``whole`` marks segments that occur more than once themselves. With ``documents`` (one for each
        segment; -1 for one that several hold) only occurrences in another document count.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in self.lefts]
        docs = None if documents is None else np.array(documents, np.int64)
        for i, w in enumerate(whole):
            if w:
                low = max(self.length - len(self.rights[i]), 0)
                found[i].append((low, len(self.lefts[i]) + 1))
        for depth, members, between in self.spread() if len(self.lefts) > 2 else ():
            if docs is None:
                left = np.maximum(np.append(between, -1), np.append(-1, between))
            else:
                left = _nearest_other(between, docs[members])
            least = max(self.length - depth, 0)
            for i, most in zip(members[left >= least].tolist(), left[left >= least].tolist(), strict=True):
                low, high = max(least, self.length - len(self.rights[i])), min(most, len(self.lefts[i]))
                if low <= high:
                    found[i].append((low, high + 1))
        if len(self.lefts) == 2 and (docs is None or docs[0] != docs[1] or docs[0] < 0):  # one interval
            depth, left = self.prefix, self.shared
            low = max(self.length - depth, 0)
            if low <= left:
                for f in found:
                    f.append((low, left + 1))
        return [_merge(f) for f in found]


def _nearest_other(between: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The most that each member shares with one of another document, -1 if there is none."""
    parts = (docs[1:] != docs[:-1]) | (docs[1:] < 0)
    big = int(between.max(initial=0)) + 2

    def carried(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Running minima that start anew at each cut; -1 before the first."""
        turn = np.cumsum(cuts)
        return np.where(turn > 0, np.minimum.accumulate(values - big * turn) + big * turn, -1)

    after = carried(between[::-1], parts[::-1])[::-1]
    return np.maximum(np.append(after, -1), np.append(-1, carried(between, parts)))


def shared_offsets(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each of some different segments the window offsets repeated in another."""
    return Suffixes(lefts, rights, length).offsets([False] * len(lefts))


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, ends exclusive, with those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_RANGES = T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))
_ARROW_RANGES = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _placed() -> tuple[Column, Column, Column]:
    """What ``place`` packs: the anchor, the anchor minus its first owned window start, the last minus the first."""
    place = F.col("place")
    return F.shiftright(place, 32), F.shiftright(place, 16).bitwiseAND(F.lit(0xFFFF)), place.bitwiseAND(F.lit(0xFFFF))


def _batch(rows: list[tuple], types: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _keys(id_col: str, text: Column) -> list[Column]:
    """A text and the id of its row; rows that agree in both have the same result."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col)).alias("k2")]


def _ends(place: int, length: int, reach: int | None) -> tuple[int, int, int]:
    """Start, anchor and end of a segment: what the owned windows cover, or, with ``reach``, one byte more to the
    left and so many bytes from the anchor on."""
    p, back, span = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
    return (p - back, p, p - back + span + length) if reach is None else (max(p - back - 1, 0), p, p + reach)


def _hits(keyed: DataFrame, lengths: Sequence[int], gram: int, reach: int | None = None) -> DataFrame:
    """(fp, kind, seg, k1, k2, place) of the anchors whose gram hash occurs more than once; kind: which length.

    ``place`` packs the position (32 bits), and how far back (16) and how long (16) the owned starts run.
    """
    import xxhash

    if not 8 <= gram <= lengths[0] or lengths[-1] >= 1 << 16:
        raise ValueError("gram must be at least 8 and at most the length, the length less than 65536")
    made = [f"{c}{k}" for k in range(len(lengths)) for c in ("seg", "place")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            parts: list[list] = [[] for _ in range(3 + len(made))]
            raws = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2)]
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
            done = 0
            for raw, text_ends, fp, runs in _together(raws, lengths, gram):
                view, base = memoryview(raw), runs[0][0]
                of = np.searchsorted(text_ends, base, side="right")
                begins = np.concatenate(([0], text_ends[:-1]))
                columns = [fp.view(np.int64), *(k[done : done + len(text_ends)][of] for k in keys)]
                done += len(text_ends)
                for (p, first, last), length in zip(runs, lengths, strict=True):
                    seg, place = np.zeros(len(fp), np.int64), np.full(len(fp), -1)
                    here = np.searchsorted(base, p)
                    back, span = p - first, last - first
                    if reach is None:
                        start, end = first, last + length
                    else:  # at a text's start there is no byte more, which tells such a segment from others
                        text_no = np.searchsorted(text_ends, p, side="right")
                        start, end = np.maximum(first - 1, begins[text_no]), np.minimum(p + reach, text_ends[text_no])
                    shape = ((p - start) << 16 | span).tolist()
                    hashed = [digest(view[a:z], s) for a, z, s in zip(start.tolist(), end.tolist(), shape, strict=True)]
                    seg[here] = np.array(hashed, np.uint64).view(np.int64)
                    place[here] = (p - begins[np.searchsorted(text_ends, p, side="right")]) << 32 | back << 16 | span
                    columns += [seg, place]
                for part, column in zip(parts, columns, strict=True):
                    part.append(column)
            if parts[0]:
                whole = [np.concatenate(c) for c in parts]
                arrays = [pa.array(c) for c in whole[:3]]
                for k in range(len(lengths)):
                    seg, place = whole[3 + 2 * k : 5 + 2 * k]
                    none = place < 0
                    arrays += [pa.array(seg, mask=none), pa.array(place, mask=none)]
                yield pa.RecordBatch.from_arrays(arrays, ["fp", "k1", "k2", *made])

    schema = "fp bigint, k1 bigint, k2 bigint, " + ", ".join(f"{c} bigint" for c in made)
    found = materialize(keyed.filter(F.octet_length("text") >= lengths[0]).mapInArrow(find, schema), "repeats-anchors")
    # Written, so that the join reads both sides afresh and a frequent gram's anchors can be split over tasks.
    twice = materialize(found.groupBy("fp").count().filter("count > 1").select("fp"), "repeats-twice")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"seg{k}").alias("seg"), F.col(f"place{k}").alias("place")) for k in range(len(lengths))])
    each = found.join(twice, "fp").select("fp", "k1", "k2", F.explode(kinds).alias("x")).select("fp", "x.kind", "x.seg", "k1", "k2", "x.place").filter("place is not null")
    hits = materialize(each, "repeats-hits")
    discard(found, twice)
    return hits


def _segments(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different segments with their multiplicity, one place, and whether several documents hold them; and
    how many segments each gram hash has."""
    doc = F.xxhash64("k1", "k2")
    segments = materialize(
        hits.groupBy("fp", "kind", "seg")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at"), (F.min(doc) != F.max(doc)).alias("across"))
        .select("fp", "kind", "seg", "n", "at.*", "across"),
        "repeats-segments",
    )
    return segments, materialize(segments.groupBy("fp", "kind").agg(F.count(F.lit(1)).alias("segments")), "repeats-sizes")


_CONTEXT = ("fp", "kind", "seg", "n", "doc", "place", "hot", "before", "after")
_CONTEXT_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
_CONTEXT_SCHEMA = "fp bigint, kind int, seg bigint, n bigint, doc bigint, place bigint, hot boolean, before binary, after binary"


def _contexts(keyed: DataFrame, segments: DataFrame, sizes: DataFrame, lengths: Sequence[int], most_local: int, reach: int | None = None) -> DataFrame:
    """The bytes of the segments of gram hashes that have several."""
    doc = F.when(F.col("across"), F.lit(-1).cast("long")).otherwise(F.xxhash64("k1", "k2").bitwiseAND(F.lit((1 << 62) - 1)))
    wanted = (
        segments.join(sizes.filter("segments > 1"), ["fp", "kind"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("fp", "kind", "seg", "n", doc.alias("doc"), "place", (F.col("segments") > most_local).alias("hot"))).alias("wanted"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            lists = batch.column(1)
            values = lists.flatten()
            fields = iter(zip(*[values.field(c).to_pylist() for c in _CONTEXT[:7]], strict=True))
            for t, many in zip(batch.column(0), lists.value_lengths().to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                for row in islice(fields, many):
                    # Of a frequent gram hash only windows are looked at.
                    start, p, end = _ends(row[5], lengths[row[1]], None if row[6] else reach)
                    rows.append((*row, raw[start:p][::-1], raw[p:end]))
                    if len(rows) >= ROWS:
                        yield _batch(rows, _CONTEXT_TYPES, _CONTEXT)
                        rows = []
            if rows:
                yield _batch(rows, _CONTEXT_TYPES, _CONTEXT)

    return materialize(
        keyed.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("text", "wanted").mapInArrow(cut, _CONTEXT_SCHEMA), "repeats-contexts"
    )


def _solved(contexts: DataFrame, solve, schema: T.StructType, types: Sequence[pa.DataType]) -> DataFrame:
    """``solve`` (fp, kind, rows) -> rows, over runs of one gram hash, one after the other."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        key, out = None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("fp", "kind", "seg", "n", "doc", "place", "before", "after")], strict=True):
                if key != row[:2]:
                    if held:
                        out.extend(solve(*key, list(held.values())))
                    held, key = {}, row[:2]
                held[row[2]] = row[2:]  # once, though repeated rows hold it
            if len(out) > 5000:
                yield _batch(out, types, schema.fieldNames())
                out = []
        if held:
            out.extend(solve(*key, list(held.values())))
        yield _batch(out, types, schema.fieldNames())

    plain = contexts.filter("not hot").select("fp", "kind", "seg", "n", "doc", "place", "before", "after")
    return plain.repartition("fp").sortWithinPartitions("fp", "kind").mapInArrow(runs, schema)


def _windows(contexts: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Every window (offset, 128-bit hash) of the segments of frequent gram hashes."""
    import xxhash

    names = ["fp", "kind", "seg", "n", "doc", "offset", "h1", "h2"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, kind, seg, n, doc, before, after in zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True):
                raw, length = memoryview(before[::-1] + after), lengths[kind]
                some = len(raw) - length + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(some)), np.int64).reshape(-1, 2)
                offset = len(before) - np.arange(some, dtype=np.int32)
                same = [np.full(some, v, t.to_pandas_dtype()) for v, t in zip((fp, kind, seg, n, doc), types, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*same, offset, h[:, 0], h[:, 1]], types, strict=True)], names)

    hot = contexts.filter("hot").dropDuplicates(["fp", "kind", "seg"]).select("fp", "kind", "seg", "n", "doc", "before", "after")
    return materialize(hot.mapInArrow(windows, "fp bigint, kind int, seg bigint, n bigint, doc bigint, offset int, h1 bigint, h2 bigint"), "repeats-windows")


def remove_repeats(
    docs: DataFrame,
    carry: Sequence[Column | str] = ("*",),
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    passage: int | None = None,
    gram: int = 48,
    most_local: int = 16_384,
    sieve_buckets: int = 1 << 20,
) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which starts anywhere else as well.

    Texts are UTF-8 bytes; matches stay inside a document, but other starts may be in the same one, and
    overlap. Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``n_bytes``,
    ``removed`` (array of (low, high), the maximal removed runs, ends exclusive) and ``kept`` (binary,
    what is left, which may cut a character).

    With ``passage``, a smaller length, ``passages`` (array of (low, high, words)) tells what else repeats:
    the maximal runs covered by strings of ``passage`` bytes that another document holds too, with their
    numbers of words. They are not removed.

    A null text counts as empty; texts shorter than ``length`` keep all; of repeated rows each counts, so
    all lose what they share (they are one document to ``passages``); an empty table gives an empty
    result. Ids may be null or repeated. Other columns ride along inside ``row``, whatever their names.
    """
    ship_package(docs.sparkSession)
    if passage is not None and passage >= length:
        raise ValueError("passage must be smaller than length")
    lengths = [length] if passage is None else [passage, length]
    last = len(lengths) - 1  # the kind that is removed
    gram = min(gram, lengths[0])
    text = text_of(text_col)
    keyed = docs.select(*_keys(id_col, text), text.alias("text"))
    hits = _hits(keyed, lengths, gram)
    segments, sizes = _segments(hits)
    contexts = _contexts(keyed, segments, sizes, lengths, most_local)
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("seg", T.LongType()), T.StructField("offsets", _RANGES)])

    def solve(fp: int, kind: int, rows: list[tuple]) -> Iterator[tuple]:
        segs, counts, of, _, lefts, rights = zip(*rows, strict=True)
        whole = [n > 1 for n in counts] if kind == last else [d < 0 for d in of]
        offsets = Suffixes(list(lefts), list(rights), lengths[kind]).offsets(whole, None if kind == last else of)
        for seg, ranges in zip(segs, offsets, strict=True):
            if ranges:
                yield fp, kind, seg, [{"low": a, "high": b} for a, b in ranges]

    local = _solved(contexts, solve, schema, [pa.int64(), pa.int32(), pa.int64(), _ARROW_RANGES])
    windows = _windows(contexts, lengths)
    window = ["fp", "kind", "offset", "h1", "h2"]
    elsewhere = F.when(F.col("kind") == last, F.sum("n") > 1).otherwise((F.min("doc") != F.max("doc")) | (F.min("doc") < 0))
    common = windows.groupBy(*window).agg(elsewhere.alias("repeated")).filter("repeated").drop("repeated")
    counted = (
        windows.join(common, window)
        .groupBy("fp", "kind", "seg")
        .agg(F.transform(F.array_sort(F.collect_set("offset")), lambda o: F.struct(o.alias("low"), (o + 1).alias("high"))).alias("offsets"))
    )
    # A gram hash with one segment is one suffix: all of it repeats, if it occurs twice or in two documents.
    single = segments.join(sizes.filter("segments = 1"), ["fp", "kind"]).filter((F.col("kind") == last) | F.col("across"))
    whole = single.filter("n > 1").select("fp", "kind", "seg", F.lit(None).cast(_RANGES).alias("offsets"))
    repeated = materialize(whole.unionByName(local).unionByName(counted), "repeats-found")

    size = F.when(F.col("kind") == last, length).otherwise(lengths[0])
    p, back, span = _placed()
    here = F.when(F.col("offsets").isNull(), F.array(F.struct((p - back).alias("low"), (p - back + span + size).alias("high")))).otherwise(
        F.transform("offsets", lambda r: F.struct((p - r["high"] + 1).alias("low"), (p - r["low"] + size).alias("high")))
    )
    # A span is one number, in order of kind, then start: 1 bit, 31, and 31 of its size.
    packed = F.shiftleft(F.col("kind").cast("long"), 62) + F.shiftleft(F.col("span.low").cast("long"), 31) + (F.col("span.high") - F.col("span.low"))
    spans = (
        hits.join(repeated, ["fp", "kind", "seg"])
        .select("k1", "k2", "kind", F.explode(here).alias("span"))
        .groupBy("k1", "k2")
        .agg(F.collect_set(packed).alias("spans"))
    )
    spans = materialize(spans, "repeats-spans")
    discard(hits, segments, sizes, contexts, windows, repeated)

    source = docs.select(F.struct(*carry).alias("row"), *_keys(id_col, text), text.alias("text"))
    out = [source.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("removed", _RANGES), T.StructField("kept", T.BinaryType())]
    passages = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("low", "high", "words")]))
    if passage is not None:
        out.append(T.StructField("passages", passages))
    arrow_passages = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("words", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sizes_, removed, kept, told = [], [], [], []
            for t, some in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                both: tuple[list, list] = ([], [])
                for s in some or ():
                    low = s >> 31 & 0x7FFFFFFF
                    both[s >> 62].append((low, low + (s & 0x7FFFFFFF)))
                runs = _merge(both[last])
                at, left = 0, []
                for a, b in runs:
                    left.append(raw[at:a])
                    at = b
                sizes_.append(len(raw))
                removed.append([{"low": a, "high": b} for a, b in runs])
                kept.append(b"".join([*left, raw[at:]]))
                if passage is not None:
                    told.append([{"low": a, "high": b, "words": len(raw[a:b].split())} for a, b in _merge(both[0])])
            columns = [batch.column(0), pa.array(sizes_, pa.int64()), pa.array(removed, _ARROW_RANGES), pa.array(kept, pa.binary())]
            if passage is not None:
                columns.append(pa.array(told, arrow_passages))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out])

    # Rows with spans are told from the others, whose texts stay where they lie, by a sieve of at most ``sieve_buckets``
    # rows; a collision only sends a row to the join that finds nothing there. One that would be a quarter full is not made.
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    if spans.count() <= sieve_buckets // 4:
        bucket = F.pmod(F.xxhash64("k1", "k2"), F.lit(sieve_buckets)).cast("int").alias("bucket")
        sieve = spans.select(bucket).distinct().withColumn("hit", F.lit(True))
        sieved = source.withColumn("bucket", bucket).join(F.broadcast(sieve), "bucket", "left")
        source, whole = sieved.filter("hit"), [sieved.filter("hit is null").select("row", "text", none)]
    else:
        whole = []
    joined = source.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "text", "spans")
    for more in whole:
        joined = joined.unionByName(more)
    return joined.mapInArrow(apply, T.StructType(out))


def repeat_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    gram: int = 48,
    reach: int = 4096,
    most_local: int = 16_384,
) -> DataFrame:
    """The maximal repeats of at least ``length`` bytes, with all of their occurrences.

    Returns one row per occurrence: ``group_id``, ``n_bytes`` (of the repeat), ``n_occurrences``, ``id`` and
    ``start`` (byte). A repeat is maximal if its occurrences do not all go on alike to the left, nor to the
    right; the ends of a text are unlike anything. Each is found once, in the tree of the anchor that owns its
    first window; one that goes on for more than ``reach`` bytes from there is cut.

    A gram hash of more than ``most_local`` different segments gives its repeated windows instead, each a group
    of ``length`` bytes with all of its occurrences; how far these go on is not told then. A null text counts as empty; rows that agree in id and text
    are one document; an empty table gives an empty result. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    text = text_of(text_col)
    keyed = docs.select(*_keys(id_col, text), text.alias("text")).dropDuplicates(["k1", "k2"])
    hits = _hits(keyed, [length], min(gram, length), reach)
    segments, sizes = _segments(hits)
    contexts = _contexts(keyed, segments, sizes, [length], most_local, reach)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("fp", "seg", "no", "left", "size")])

    def solve(fp: int, kind: int, rows: list[tuple]) -> Iterator[tuple]:
        segs, counts, _, places, lefts, rights = zip(*rows, strict=True)
        back = [x >> 16 & 0xFFFF for x in places]
        low = [b - (x & 0xFFFF) for b, x in zip(back, places, strict=True)]
        # A segment that occurs more than once is a repeat if nothing is left of it, else one that starts earlier.
        found = [(len(lefts[i]), len(rights[i]), np.array([i])) for i, n in enumerate(counts) if n > 1]
        found += Suffixes(list(lefts), list(rights), length).repeats()
        for no, (left, depth, members) in enumerate(found):
            if low[members[0]] <= left <= back[members[0]]:
                for i in members.tolist():
                    yield fp, segs[i], no, left, left + depth

    local = _solved(contexts, solve, schema, [pa.int64()] * 5)
    p, back, _ = _placed()
    long = lambda n: F.lit(n).cast("long")
    # One segment only, at the start of its texts; its size comes from the text that is at hand.
    size = keyed.select("k1", "k2", F.octet_length("text").alias("bytes"))
    alone = (
        segments.join(sizes.filter("segments = 1"), ["fp", "kind"])
        .filter((F.col("n") > 1) & (p == back))
        .join(size, ["k1", "k2"])
        .select("fp", "seg", long(0).alias("no"), back.alias("left"), F.least(F.col("bytes"), p + reach).cast("long").alias("size"))
    )
    windows = _windows(contexts, [length])
    common = windows.groupBy("fp", "offset", "h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    single = windows.join(common, ["fp", "offset", "h1", "h2"]).select(
        "fp", "seg", F.xxhash64("offset", "h1", "h2").alias("no"), F.col("offset").cast("long").alias("left"), long(length).alias("size")
    )
    members = alone.unionByName(local).unionByName(single)
    occurrences = hits.join(members, ["fp", "seg"]).select(F.xxhash64("fp", "no").alias("group_id"), "k1", "k2", F.col("size").alias("n_bytes"), (p - F.col("left")).alias("start"))
    occurrences = materialize(occurrences, "repeats-occurrences")
    counts = materialize(occurrences.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_occurrences")), "repeats-counts")
    discard(hits, segments, sizes, contexts, windows)
    ids = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text)).dropDuplicates(["k1", "k2"])
    return occurrences.join(counts, "group_id").join(ids, ["k1", "k2"]).select("group_id", "n_bytes", "n_occurrences", "id", "start")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of the whole of ``documents`` without its repeated 400-byte passages, and what shorter passages documents share.

    After the contract's columns: ``shared_bytes`` in passages of at least 200 bytes that another document
    has too, and ``n_passages``, how many of these have more than 50 words.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + (r["high"] - r["low"]))
    return remove_repeats(docs, carry=["doc_id"], passage=PASSAGE).select(
        "row.doc_id",
        "n_bytes",
        total("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        total("passages").alias("shared_bytes"),
        F.size(F.filter("passages", lambda r: r["words"] > PASSAGE_WORDS)).cast("long").alias("n_passages"),
    )
