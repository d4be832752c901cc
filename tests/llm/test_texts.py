"""Operators on texts against brute force, over texts chosen to be awkward."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import rows_of
from pyspark.sql import functions as F

from rfrank.llm import queries
from rfrank.llm.exact_dedup import exact_dedup
from rfrank.llm.mixing import mix_sources
from rfrank.llm.packing import WordTokenizer, pack
from rfrank.llm.simhash import fingerprint, simhash_dedup
from rfrank.llm.substrings import Suffixes, intervals, remove_repeats, repeat_groups, shared_offsets

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, size int"


def awkward():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(3)
    words = ["the", "of", "Über", "né", "a", "zz", "日本", "x1", "😀", "THE", "don't", "a,b."]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(25)]
    texts = [None, "", " ", "\t\n", "a", "a ", " a", "one two three", "one two three four", "É", "long " * 30_000, "y" * 5000, *base, *base[:8]]
    texts += [t.replace("the", "tea", 1) for t in base[:6]] + [base[0] + " " + base[1], base[1] + base[0], "z" * 900, "z" * 900]
    rows = [(i, t, "en", f"s{i % 4}", len(t or ""), "r", "k", 5) for i, t in enumerate(texts)]
    rows += [(3, "\t\n", None, None, None, None, None, None), (None, "a", None, None, 1, "r", "k", 5), (None, base[0], "x", None, 1, None, "k", None)]
    rows += [rows[20], rows[20], (None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clean(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)


# Exact dedup


@pytest.mark.parametrize("buckets", [1 << 20, 1])
def test_exact_dedup(docs, buckets):
    found = exact_dedup(docs, sieve_buckets=buckets)
    got = found.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "keep_id", "group_size", F.col("kept").alias("stays")).collect()
    groups = defaultdict(list)
    for r in awkward():
        groups[clean(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    assert len(got) == len(awkward())
    stays = Counter()
    for r in got:
        g = groups[clean(r.text)]
        best = min(g)
        assert r.group_size == len(g)
        assert r.keep_id == (None if best[1] else best[2])
        if r.stays:
            assert (-len(r.text or ""), r.doc_id is None, r.doc_id or 0) == best
            stays[clean(r.text)] += 1
    assert set(stays.values()) == {1} and len(stays) == len(groups)


# SimHash


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def classes(prints):
    """Brute-force components of distinct fingerprints at most 4 bits apart."""
    left, out = list(prints), {}
    while left:
        todo = [left.pop()]
        root = todo[0]
        while todo:
            v = todo.pop()
            out[v] = root
            near = [u for u in left if (u ^ v).bit_count() <= 4]
            left = [u for u in left if u not in near]
            todo += near
    return out


def test_fingerprint(spark):
    for r in awkward():
        if len(r[1] or "") < 20_000:
            assert fingerprint(r[1] or "") == slow_fingerprint(r[1])
    # The same hash as Spark's own function.
    h = spark.createDataFrame([("one two three four",)], "t string").select(F.xxhash64("t")).first()[0]
    assert fingerprint("one two three four") == h % 2**64


@pytest.mark.parametrize("buckets", [1 << 20, 1])
def test_simhash_components(docs, buckets):
    rows = awkward()
    prints = {r[1]: fingerprint(r[1] or "") for r in rows}
    of = classes(set(prints.values()))
    low = defaultdict(list)
    for r in rows:
        low[of[prints[r[1]]]].append((r[0] is None, r[0] or 0))
    kept = Counter()
    got = simhash_dedup(docs, sieve_buckets=buckets).select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "fingerprint", "component_id", F.col("kept").alias("stays")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint % 2**64 == prints[r.text]
        best = min(low[of[prints[r.text]]])
        assert r.component_id == (None if best[0] else best[1])
        kept[of[prints[r.text]]] += r.stays
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("spread", [3, 9])
def test_dense_and_sparse_fingerprints(spark, spread):
    """Large clouds of close fingerprints, which share long runs of variants."""
    from rfrank.llm.components import components
    from rfrank.llm.simhash import near_links

    rng = random.Random(spread)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(250):
            x = centre
            for b in rng.sample(range(64), rng.randrange(spread + 1)):
                x ^= 1 << b
            prints.add(x)
    frame = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fp long")
    roots = {r.node % 2**64: r.root for r in components(near_links(frame)).collect()}
    of = classes(prints)
    want, got = defaultdict(set), defaultdict(set)
    for p in prints:
        want[of[p]].add(p)
        got[roots.get(p, p)].add(p)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("segment", [0, 1, 2])
def test_split_runs_keep_every_component(segment):
    """A very long run, dealt into sub-runs, has the components of all of its pairs."""
    from rfrank.llm.simhash import SEGMENTS, _split

    rng = random.Random(segment)
    first, bits = SEGMENTS[segment]
    mask = ((1 << bits) - 1) << first
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64) & ~mask
        for _ in range(8):
            for b in rng.sample([b for b in range(64) if not mask >> b & 1], rng.randrange(6)):
                x ^= 1 << b
            prints.add(x)
    fps = np.array(sorted(prints), np.uint64)
    edges = [(int(v), int(w)) for a, b in zip(*_split(fps, segment, 4)) for v, w in zip(a, b)]
    assert all((v ^ w).bit_count() <= 4 for v, w in edges)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for v, w in edges:
        root[find(v)] = find(w)
    want = classes(prints)
    together = {(p, q) for p in prints for q in prints if p < q and want[p] == want[q]}
    assert {(p, q) for p in prints for q in prints if p < q and find(p) == find(q)} == together and together


# Mixing


def test_jaccard_groups_against_all_pairs(spark):
    """The stage's links reach similarity 0.8: small groups, and one too large for pairs."""
    import corpus_pipeline

    from rfrank.llm.minhash import jaccard_dedup

    rng = random.Random(11)

    def changed(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        return " ".join(words)

    texts = [None, "", " \t", "one two", "One  two", "one two three"]
    for k in range(60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((20, 150, 400)))]
        texts += [changed(base, round(t * len(base) / 100)) for t in (0, 1, 2, 3)]
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts += [changed(base, 2) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t or ""), "r", "k", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)

    def shingled(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets, root = [shingled(t) for t in texts], list(range(len(texts)))
    between = 0
    for b in range(len(texts)):
        for a in range(b):
            union = len(sets[a] | sets[b])
            alike = len(sets[a] & sets[b]) / union if union else 1
            if alike >= 0.8:
                between += alike < 0.95
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert between > 500
    both, prints = list(root), [fingerprint(t or "") for t in texts]
    for b in range(len(texts)):
        for a in range(b):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((both[a], both[b]))
                both = [x if z == y else z for z in both]
    for buckets in (1 << 20, 2):
        got = jaccard_dedup(docs, sieve_buckets=buckets).select("row.doc_id", "component_id", F.col("kept").alias("stays")).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
        assert sorted(r.doc_id for r in got if r.stays) == sorted(set(root))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in stage.collect()) == sorted(set(both))


def test_mix(docs):
    got = mix_sources(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size", "source_size", "target", "taken").collect()
    assert len(got) == len(awkward())
    sizes = defaultdict(int)
    for r in awkward():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    while True:  # share, stop, share the excess anew
        open_ = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    again = mix_sources(docs.repartition(5)).select("row.doc_id", "taken")
    assert sorted(map(str, again.collect())) == sorted(str(type(x)(doc_id=x.doc_id, taken=x.taken)) for x in mix_sources(docs).select("row.doc_id", "taken").collect())


# Packing


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


HARD = ["Ünï ªº µm ß İ Σας ΣΑΣ don't I'LL a,b ..., x. <|endoftext|> 日本 é  x y\x1cz\x85q  é.,é, É. ٣٤ ½ ÿ Ÿ", "ÀÉÎ ÕÜÞ Straße, été. 12,5 d'été", "", " \n", "a" * 3000, "!!??.. ,,", "x.y.z 'tis 's 't"]


def test_word_tokenizer_equals_the_library(vocabulary):
    t = WordTokenizer(vocabulary, cache_words=50)
    for text in [*HARD, *(r[1] or "" for r in awkward())]:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size, partitions", [(64, 3), (4096, 9), (256, 1)])
def test_packing(docs, vocabulary, size, partitions):
    t = WordTokenizer(vocabulary)
    want = Counter()
    for r in awkward():
        ids = t.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], np.array(ids, "<u4").tobytes()] += 1
    pieces = pack(docs.repartition(partitions), vocabulary, size=size, open_windows=3, merge_width=4).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        sequences[p.sequence_id].append((p.offset, p.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0  # full, or a power of two
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    if all(n == 1 for (i, _), n in want.items()):  # ids that are repeated can't be told apart by pieces
        pytest.fail("the rows should hold repeated ones")
    for (doc_id, raw), n in want.items():
        same = [x for x in want if x[0] == doc_id]
        if len(same) == 1 and n == 1:
            got = sorted(by_doc[doc_id], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in got) == raw
            assert [p.start for p in got] == [sum(q.length for q in got[:i]) for i in range(len(got))]
            assert {p.doc_tokens for p in got} == {len(raw) // 4}
    assert sum(p.length for p in pieces) == sum(n * len(raw) // 4 for (_, raw), n in want.items())


# Repeated passages


def brute_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(r, cover, strict=True) if not c)
        runs = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(r), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(docs, **options):
    removed = F.aggregate("removed", F.lit(0), lambda n, r: n + (r["high"] - r["low"]))
    found = remove_repeats(docs, **options).select("n_bytes", removed.alias("n"), F.size("removed").alias("runs"), F.sha2("kept", 256).alias("sha"))
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("length, gram, most_local", [(20, 8, 16_384), (20, 8, 1), (50, 16, 16_384), (40, 40, 2)])
def test_removal(spark, length, gram, most_local):
    rng = random.Random(length)
    alphabet = ["ab", "ba", "é", "c", "日", " "]
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 160))) for _ in range(30)]
    texts = [None, "", "a" * 300, "ab" * 100, *pool]
    for _ in range(40):  # pasted and edited pieces
        t = "".join(rng.choice(pool)[rng.randrange(5) :][: rng.randrange(200)] for _ in range(rng.randrange(1, 4)))
        texts.append(t[: len(t) // 2] + rng.choice(["", "x", "yy"]) + t[len(t) // 2 :])
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert removal(docs, length=length, gram=gram, most_local=most_local) == brute_removal(texts, length)


def test_removal_of_awkward_texts(docs):
    assert removal(docs) == brute_removal([r[1] for r in awkward()], 400)


def pasted(seed, n=30, most=60):
    """Texts of a small alphabet with pieces of each other."""
    rng = random.Random(seed)
    alphabet = ["ab", "ba", "é", "c", "日", " "]
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most))) for _ in range(n)]
    texts = [None, "", "a" * 70, "ab" * 40, pool[0], pool[0], *pool]
    return texts + ["".join(rng.choice(pool)[rng.randrange(5) :][: rng.randrange(most)] for _ in range(3)) for _ in range(n)]


def brute_groups(raws, length):
    """Every maximal repeat: (bytes, set of (document, start))."""
    most = max(map(len, raws))
    out, by = {}, defaultdict(set)
    for size in range(length, most + 1):
        by = defaultdict(set)
        for d, r in enumerate(raws):
            for i in range(len(r) - size + 1):
                by[r[i : i + size]].add((d, i))
        by = {w: at for w, at in by.items() if len(at) > 1}
        if not by:
            break
        for w, at in by.items():
            before = {raws[d][i - 1] if i else (d, i) for d, i in at}
            after = {raws[d][i + size] if i + size < len(raws[d]) else (d, i) for d, i in at}
            if len(before) > 1 and len(after) > 1:
                out[w] = at
    return out


@pytest.mark.parametrize("length, gram, most_local", [(12, 8, 16_384), (20, 10, 16_384)])
def test_repeat_groups(spark, length, gram, most_local):
    texts = pasted(length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = repeat_groups(docs, length=length, gram=gram, most_local=most_local).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.group_id, r.n_bytes, r.n_occurrences].add((r.id, r.start))
    raws = [(t or "").encode() for t in texts]
    got = {}
    for (_, size, n), at in found.items():
        assert len(at) == n
        (string,) = {raws[d][i : i + size] for d, i in at}
        assert string not in got
        got[string] = at
    assert got == brute_groups(raws, length)


def test_repeat_groups_of_a_frequent_gram(spark):
    """Past ``most_local`` segments windows are counted, each with all of its occurrences."""
    texts = pasted(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raws = [(t or "").encode() for t in texts]
    found = defaultdict(set)
    for r in repeat_groups(docs, length=16, gram=8, most_local=1).collect():
        found[r.group_id, r.n_bytes, r.n_occurrences].add((r.id, r.start))
    assert found
    for (_, size, n), at in found.items():
        (string,) = {raws[d][i : i + size] for d, i in at}
        assert len(at) == n and at == {(d, i) for d, r in enumerate(raws) for i in range(len(r)) if r.startswith(string, i)}


@pytest.mark.parametrize("most_local", [16_384, 1])
def test_passages(spark, most_local):
    """Runs of strings that another document holds too; repeats inside one document do not count."""
    texts = [*pasted(9), "xyz" * 40]
    ids = [i // 2 for i in range(len(texts))]
    keys = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame(keys, "doc_id long, text string").repartition(3)
    found = remove_repeats(docs, carry=["doc_id", "text"], length=40, passage=14, gram=8, most_local=most_local)
    rows = [(r.row.doc_id, r.row.text, [(p.low, p.high, p.words) for p in r.passages]) for r in found.collect()]
    holders = defaultdict(set)
    for key in keys:
        raw = (key[1] or "").encode()
        for i in range(len(raw) - 13):
            holders[raw[i : i + 14]].add(key)
    for doc_id, text, passages in rows:
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - 13):
            if len(holders[raw[i : i + 14]]) > 1:
                cover[i : i + 14] = b"\1" * 14
        want = [(m.start(), m.end(), len(raw[m.start() : m.end()].split())) for m in re.finditer(b"\1+", bytes(cover))]
        assert passages == want, (doc_id, text)


def test_interval_tree():
    tree = Suffixes([b"ab", b"ab", b"ax", b"ab"], [b"1234", b"1234x", b"12zz", b"12zy"], 3)
    assert sorted((left, depth, sorted(m.tolist())) for left, depth, m in tree.repeats()) == [(1, 2, [0, 1, 2, 3]), (1, 3, [2, 3]), (2, 2, [0, 1, 3]), (2, 4, [0, 1])]
    assert sorted(intervals([2, 3, 0, 1])) == sorted([(3, 1, 2), (2, 0, 2), (1, 3, 4), (0, 0, 4)])
    assert list(intervals([])) == []
    # Two members share 3 to the left and 4 to the right of the anchor, the third less.
    assert shared_offsets([b"abc", b"abc", b"abx"], [b"1234x", b"1234y", b"12zz"], 6) == [[(2, 4)], [(2, 4)], []]


# Empty tables


def test_empty_tables(empty, vocabulary):
    assert exact_dedup(empty).count() == 0
    assert simhash_dedup(empty).count() == 0
    assert mix_sources(empty).count() == 0
    assert pack(empty, vocabulary).count() == 0
    assert remove_repeats(empty).count() == 0
