"""Alignment of two tokenizers' tokens, document by document.

Both vocabularies mark a token that begins with a space, and neither goes on past a space before a word. So after a
text is tokenised as a whole by both, the places where a token of each ends and one with a space's mark
follows cut it into windows, each about a word: two tuples of token ids with the same bytes. Windows repeat,
and how one is aligned depends on its ids only, so alignments are kept by the two tuples.

Tokenising is what costs. Since tokens stop before spaces, a text's ids are those of its stretches from space
to space in a row; stretches repeat as well, so a bounded store of them does most of the work.

Links are counted over the corpus: a document's own pairs are summed where it lies, pairs are summed over
documents, and documents get their pairs' counts back. Frequent pairs, those with more than a 2^18th of all
links and therefore fewer than 2^18, are broadcast; the rest meet in a join whose keys have at most that share.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship_package, text_of

#: Fixed value: the pattern by which a byte-level vocabulary splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<! )(?= \S)")
#: Byte-level vocabularies write a byte as a character: printable Latin-1 as itself, the rest from U+0100 on.
_BYTES = {**{chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}}
_BYTES |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in _BYTES)}

#: Most stretches and windows that a worker keeps of the latest use; it holds up to twice as many.
STRETCHES, WINDOWS = 150_000, 150_000
#: Pairs that are broadcast are fewer than this.
FREQUENT = 1 << 18


class Kept(dict):
    """A store that forgets: when it is full, what was not used since the last time goes."""

    def __init__(self, most: Callable[[], int]):
        self.most, self.older = most, {}

    def __missing__(self, key):
        found = self.older[key]  # KeyError: not known
        self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most():
            self.older = dict(self)
            self.clear()
        self[key] = value


class _Tokens:
    """Length and mark of every token, from its bytes."""

    def __init__(self, of: list[bytes]):
        self.sizes = [len(t) for t in of]
        self.size = np.array(self.sizes, np.int64)
        self.marked = np.array([t[:1] == b" " for t in of])
        if not self.size.all():
            raise ValueError("a vocabulary with tokens of no bytes")
        self.bytes = of


class Aligner:
    """Tokenises and aligns texts by a byte-level vocabulary (A) and one of pieces (B), both read from files."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        split = told["pre_tokenizer"] or {}
        if told["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError("not a plain byte-level vocabulary")
        special = {t["id"] for t in told["added_tokens"]}
        vocabulary = {t: i for t, i in told["model"]["vocab"].items() if i not in special}
        ranks = {bytes(_BYTES[c] for c in t): i for t, i in vocabulary.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        if [vocabulary["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("a vocabulary whose ids are not in the order of its merges")
        self.short = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long = Tokenizer.from_file(a_path)
        self.long.encode_special_tokens = True
        by_id = {i: t for t, i in ranks.items()}
        self.a = _Tokens([by_id.get(i, b"\0") for i in range(max(by_id) + 1)])

        self.pieces = p = sentencepiece.SentencePieceProcessor(model_file=b_path)
        texts = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.b = _Tokens([bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)])
        if any(b" " in t.lstrip(b" ") for t in self.b.bytes):  # of A, the pattern sees to it
            raise ValueError("a vocabulary whose tokens go on past a space")
        #: A token in writing, with what follows it: of A within a group and at its end, of B likewise, and at a window's end.
        self.written = [f"{i}{mark}" for of, marks in ((self.a, ",|"), (self.b, ",;\n")) for mark in marks for i in range(len(of.sizes))]
        self.stretches, self.windows = Kept(lambda: STRETCHES), Kept(lambda: WINDOWS)

    def _tokenise(self, stretches: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Stretches whose tokens have their bytes, in an order of their own, and arrays of both vocabularies' ids that make them up.

        Most are tokenised in one go, end to end: no token goes from one into the next. The rest, and all of them should
        any not have its bytes, one by one; of A by the tokenizer that is sound on words of any length, with the same ids.
        """
        plain = [s for s in stretches if len(s) <= 400 and s[1] != " " and not s[-1].isspace()]
        kept, parts = [], []
        if plain:
            text = "".join(plain)
            a, b = self.short.encode_ordinary(text), self.pieces.encode(text[1:])
            if self._same(text, a, b):
                kept, parts = plain, [(np.array(a, "<u4"), np.array(b, "<u4"))]
        done = set(kept)
        for s in stretches:
            if s not in done:
                a, b = self.long.encode(s, add_special_tokens=False).ids, self.pieces.encode(s[1:])
                if self._same(s, a, b):
                    kept.append(s)
                    parts.append((np.array(a, "<u4"), np.array(b, "<u4")))
        return kept, parts

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join([self.a.bytes[i] for i in a]) == raw and b"".join([self.b.bytes[i] for i in b]) == raw

    def learn(self, stretches: set[str]) -> dict[str, tuple[int, int, str, bytes]]:
        """(tokens of A, of B, groups in writing, linked pairs) of stretches; a stretch whose tokens have other bytes is left out."""
        known, new = {}, []
        for s in stretches:
            try:
                known[s] = self.stretches[s]
            except KeyError:
                new.append(s)
        new, parts = self._tokenise(new)
        if not new:
            return known
        ids_a, ids_b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        a, b = ids_a.tobytes(), ids_b.tobytes()
        # Anchors: shared ends before tokens of both that begin with a space. Every stretch begins with one.
        starts_a, starts_b = (np.cumsum(t.size[i]) - t.size[i] for t, i in ((self.a, ids_a), (self.b, ids_b)))
        anchors = np.intersect1d(starts_a[self.a.marked[ids_a]], starts_b[self.b.marked[ids_b]], assume_unique=True)
        cuts_a, cuts_b = (np.append(np.searchsorted(s, anchors), len(s)) for s in (starts_a, starts_b))
        at, bt = (4 * cuts_a).tolist(), (4 * cuts_b).tolist()
        windows = [(a[i:k], b[j:m]) for i, k, j, m in zip(at, at[1:], bt, bt[1:], strict=False)]
        found = self.aligned(windows)
        # Which windows a stretch has: its ends are anchors, too.
        ends = np.cumsum([0, *[len(s.encode()) for s in new]])
        firsts = np.append(np.searchsorted(anchors, ends[:-1]), len(anchors))
        n_a, n_b = (np.diff(c[firsts]).tolist() for c in (cuts_a, cuts_b))
        for s, na, nb, i, k in zip(new, n_a, n_b, firsts.tolist(), firsts[1:].tolist(), strict=False):
            known[s] = (na, nb, *found[i]) if k - i == 1 else (na, nb, ";".join([f[0] for f in found[i:k]]), b"".join([f[1] for f in found[i:k]]))
            if len(s) <= 64:
                self.stretches.keep(s, known[s])
        return known

    def aligned(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """What ``align`` gives for windows, from what is kept by their ids as far as it is known."""
        found, new = {}, []
        for w in set(windows):
            try:
                found[w] = self.windows[w]
            except KeyError:
                new.append(w)
        if new:
            for w, x in zip(new, self.align(new), strict=True):
                found[w] = x
                if len(w[0]) <= 256:
                    self.windows.keep(w, x)
        return [found[w] for w in windows]

    def align(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """The groups of windows in writing, and their linked pairs (A's id in the upper half of 64 bits), all at once."""
        ids_a, ids_b = (np.frombuffer(b"".join([w[k] for w in windows]), "<u4").astype(np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        shared, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        last = np.cumsum([len(w[1]) // 4 for w in windows]) - 1  # of each window, B's last token
        group_a, group_b = np.searchsorted(at_a, np.arange(len(ids_a))), np.searchsorted(at_b, np.arange(len(ids_b)))
        # Where a token stands in writing: behind the other side's tokens of the groups before, B's behind A's of its own.
        n_a, n_b = len(self.a.sizes), len(self.b.sizes)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        kind_a, kind_b = np.zeros(len(ids_a), np.int64), np.full(len(ids_b), 2 * n_a)
        kind_a[at_a], kind_b[at_b] = n_a, 2 * n_a + n_b
        kind_b[last] = 2 * n_a + 2 * n_b
        codes[np.arange(len(ids_a)) + np.concatenate([[0], at_b + 1])[group_a]] = ids_a + kind_a
        codes[np.arange(len(ids_b)) + (at_a + 1)[group_b]] = ids_b + kind_b
        written = "".join(map(self.written.__getitem__, codes.tolist())).split("\n")
        pairs = (ids_a[at_a] << 32 | ids_b[at_b]).tobytes()
        ends = (8 * (np.searchsorted(at_b, last) + 1)).tolist()
        return [(w, pairs[i:k]) for w, i, k in zip(written, [0, *ends], ends, strict=False)]

    def texts(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """(tokens of A, of B, groups in writing, linked pairs) of each text."""
        split = [[s for s in _CUT.split(" " + t) if s] if t else [] for t in texts]
        known = self.learn({s for of in split for s in of})
        out = []
        for stretches in split:
            of = list(map(known.get, stretches))
            if not of or None in of:
                out.append((0, 0, "", np.empty(0, np.int64)))
                continue
            n_a, n_b, written, pairs = zip(*of, strict=True)
            out.append((sum(n_a), sum(n_b), ";".join(written), np.frombuffer(b"".join(pairs), np.int64)))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process; what it has learnt outlives a task."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _some_at_a_time(texts: list[str], chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, carry: Sequence[Column | str] = ("*",), text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Align the tokens of two vocabularies over every text, with a space put before it.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``n_a`` and ``n_b`` (tokens), ``n_groups``
    (stretches between places where tokens of both end), ``n_links`` (pairs of tokens that end together), ``n_best`` (links
    whose pair is the most frequent one of its B token in the corpus, ties included), ``count_sum`` (over links, how often
    the corpus has their pair), ``groups_sha256``, and ``groups`` in writing (``a1,a2|b1;a3|b2,b3``; null unless
    ``with_groups``).

    A text that is null or empty, or whose tokens of either vocabulary have other bytes than the text, has no
    tokens: zeros and empty strings. Names of special tokens inside a text are plain text. A text of any length is
    tokenised whole; repeated rows are counted each; an empty table gives an empty result. Other columns ride along
    inside ``row``, whatever their names.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.struct(*carry).alias("row"), F.monotonically_increasing_id().alias("uid"), text_of(text_col).alias("text"))
    counted = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
    pair = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    schema = T.StructType([source.schema["row"], T.StructField("uid", T.LongType()), *counted, T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(pair))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for b in batches:
            texts = b.column(2).to_pylist()
            for start, end in _some_at_a_time(texts):
                found = aligner.texts(texts[start:end])
                distinct = [np.unique(f[3], return_counts=True) for f in found]
                ends = np.cumsum([0, *[len(d[0]) for d in distinct]])
                values = [pa.array(np.concatenate([d[k] for d in distinct]), pa.int64()) for k in (0, 1)]
                digests = [hashlib.sha256(f[2].encode()).hexdigest() if f[0] else "" for f in found]
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), *[pa.array(of, pa.int64()) for of in ([f[0] for f in found], [f[1] for f in found], [len(f[3]) for f in found])], pa.array(digests, pa.string()),
                        pa.array([f[2] if with_groups else None for f in found], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, ["pair", "n"])),
                    ],
                    schema.names,
                )

    aligned = materialize(source.mapInArrow(apply, schema), "aligned")
    pairs = aligned.select("uid", F.explode("pairs").alias("p")).select("uid", "p.pair", "p.n")
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "aligned-counts")
    of_b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))  # no more than vocabulary B has tokens
    judged = counts.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    judged = materialize(judged, "aligned-judged")
    total = judged.agg(F.sum("count")).first()[0] or 0
    frequent = F.broadcast(judged.filter(F.col("count") > total // FREQUENT))
    rare = judged.filter(F.col("count") <= total // FREQUENT)

    sums = [F.sum("n").alias("n_links"), F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    linked = pairs.join(frequent, "pair").groupBy("uid").agg(*sums)
    linked = linked.unionByName(pairs.join(frequent, "pair", "left_anti").join(rare, "pair").groupBy("uid").agg(*sums))
    once = ["row", "n_a", "n_b", "n_groups", "groups_sha256", "groups"]
    zeros = [F.lit(0).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    every = aligned.select("uid", *once, *zeros).unionByName(linked, allowMissingColumns=True)
    return every.groupBy("uid").agg(*[F.first(c, ignorenulls=True).alias(c) for c in once], *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")]).drop("uid")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Two public vocabularies aligned over the whole of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"], with_groups=False)
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
