"""Packing: bounded-space online best fit into fixed windows.

Each partition keeps a fixed number of open windows. A document goes whole into the window that it
fills best; when none has room, the fullest is topped up with the document's first tokens, emitted
full, and the rest goes on. At the end of a partition its open windows are poured together, so at most
one part-filled window per partition is left; leftovers of ``merge_width`` neighbouring partitions are
merged in one bounded task, and what remains there is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package, text_of

#: Sequence numbers: a partition's own from ``partition << 34``; those of merged leftovers from here.
MERGED = 1 << 62

_CACHE_WORDS = 500_000


#: Byte-level vocabularies write a byte as a character: printable Latin-1 as itself, the rest from U+0100 on.
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordTokenizer:
    """Token ids of a text, word by word.

    The vocabulary's splitting pattern never crosses white space and its normaliser only lower-cases
    and composes inside a word, so a text's ids are its words' ids in a row. Words repeat, so a bounded
    cache of encoded words does most of the work. Latin-1 texts are lower-cased first (there the
    normaliser does just that), which makes more words meet in the cache.
    """

    def __init__(self, path: str, cache_words: int = _CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.cache = Tokenizer.from_file(path), cache_words, {}
        self.model, self.marks = self.tokenizer.model, {m: self._full(m) for m in ",."}

    def _full(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, plain: bool) -> bytes:
        if plain and word.isalpha():  # one piece of the splitting pattern, so the merges apply at once
            return np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))], "<u4").tobytes()
        if word[-1] in ",." and word[:-1].isalpha():
            found = self.cache.get(word[:-1])
            return (self._word(word[:-1], plain) if found is None else found) + self.marks[word[-1]]
        return self._full(word)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            text.encode("latin-1")
            text, plain = text.lower(), True
        except UnicodeEncodeError:
            plain = False
        # Split at ASCII white space only: other kinds stay inside a word, which is encoded whole.
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        cache, out = self.cache, []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                ids = self._word(w, plain) if w else b""
                if len(w) <= 40:
                    if len(cache) >= self.limit:
                        cache.clear()
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process; its cache outlives a task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class OpenWindows:
    """The windows one partition has open. A piece is (id, start, length, document's tokens, ids)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.windows = size, most, []

    def add(self, doc_id, ids: bytes) -> Iterator[list]:
        """Place a document; yields the sequences that this fills."""
        n, at = len(ids) // 4, 0
        while at < n:
            rest = n - at
            fits = [w for w in self.windows if w[0] >= rest]
            if rest >= self.size:
                take, window = self.size, [self.size, []]
            elif fits:
                take, window = rest, min(fits, key=lambda w: w[0])
            elif len(self.windows) < self.most:
                take, window = rest, [self.size, []]
                self.windows.append(window)
            else:
                window = min(self.windows, key=lambda w: w[0])
                take = window[0]
            window[1].append((doc_id, at, take, n, ids[4 * at : 4 * (at + take)]))
            window[0] -= take
            at += take
            if not window[0]:
                self.windows = [w for w in self.windows if w is not window]
                yield window[1]


def pour(pieces: list, size: int) -> tuple[list[list], list]:
    """Pieces laid end to end: the full sequences, and what is left."""
    full, current, room = [], [], size
    for doc_id, at, length, n, ids in pieces:
        done = 0
        while done < length:
            take = min(room, length - done)
            current.append((doc_id, at + done, take, n, ids[4 * done : 4 * (done + take)]))
            done, room = done + take, room - take
            if not room:
                full.append(current)
                current, room = [], size
    return full, current


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    size: int = 4096,
    open_windows: int = 8,
    merge_width: int = 64,
    with_ids: bool = True,
) -> DataFrame:
    """Pack tokenised documents into sequences of at most ``size`` tokens (a power of two).

    Returns one row per piece: ``doc_id`` (of ``id_col``'s type), ``start`` (the document's tokens before
    it), ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence, without
    gaps from 0) and ``ids`` (binary, little-endian unsigned 32-bit; null unless ``with_ids``). A sequence
    is either full or has a power of two of tokens, so none needs padding.

    A null text counts as empty and still has its end id; repeated rows and null ids are packed like any
    other; a document of any length is cut into as many pieces as it takes; an empty table gives no
    pieces. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
        " sequence_id bigint, offset bigint, ids binary, part bigint"
    )

    def rows(sequence: list, number, part, keep: bool) -> list[tuple]:
        import zlib

        out, offset = [], 0
        for doc_id, at, length, n, ids in sequence:
            out.append((doc_id, at, length, zlib.crc32(ids), n, number, offset, ids if keep else None, part))
            offset += length
        return out

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]

    def batch(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, *[pa.int64()] * 6, pa.binary(), pa.int64()]
        columns = zip(*found, strict=True) if found else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, encode = TaskContext.get().partitionId(), 0, _tokenizer(tokenizer_path).encode
        windows, out, end, held = OpenWindows(size, open_windows), [], np.array([end_id], "<u4").tobytes(), 0
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for sequence in windows.add(doc_id, encode(text.as_py()) + end):
                    out += rows(sequence, (part << 34) + count, None, with_ids)
                    count += 1
                    held += size
                if held > 1 << 20 or len(out) > 20_000:
                    yield batch(out, id_type)
                    out, held = [], 0
        full, rest = pour([p for w in windows.windows for p in w[1]], size)
        for sequence in full:
            out += rows(sequence, (part << 34) + count, None, with_ids)
            count += 1
        out += rows(rest, None, part, True)  # the leftover keeps its ids until it is merged
        if out:
            yield batch(out, id_type)

    def merge(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"]))
        full, rest = pour([(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids"]) for r in found], size)
        first, out = MERGED + (found[0]["part"] // merge_width << 30), []
        half = size
        while rest:  # one sequence for each bit that is set in what remains
            half //= 2
            if sum(p[2] for p in rest) >= half:
                head, tail = pour(rest, half)
                full.append(head[0])
                rest = [p for s in head[1:] for p in s] + tail
        for k, sequence in enumerate(full):
            out += rows(sequence, first + k, None, with_ids)
        return pa.Table.from_batches([batch(out, table.schema.field("doc_id").type)])

    placed = materialize(docs.select(F.col(id_col), text_of(text_col)).mapInArrow(place, schema), "packed")
    merged = (
        placed.filter("sequence_id is null")
        .groupBy(F.floor(F.col("part") / merge_width))
        .applyInArrow(merge, schema)
    )
    return placed.filter("sequence_id is not null").unionByName(merged).drop("part")


def op10_pack(spark, sf_dir: str) -> DataFrame:
    """The pieces of the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")
