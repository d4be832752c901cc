"""The manifest against a plain account of its trees, at sizes around every border."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rfrank.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, node string, pos long, named string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Each node's siblings as (left, right), level by level, and the last node."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(where):
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            paths[k].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            where[k] = at // 16
        level = [digest(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return paths, level[0]


def manifest(rows):
    """(doc_id, leaf, subroot, root, siblings) of every row, sorted."""
    sources, out = {}, []
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r[0]))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(sources[s]), *climb([x[2] for x in sorted(sources[s])])) for s in names}
    over, root = climb([trees[s][2] for s in names])
    for path, s in zip(over, names, strict=True):
        for (_, _, own, doc_id), below in zip(trees[s][0], trees[s][1], strict=True):
            out.append((doc_id, own, trees[s][2], root, "".join(a + b for a, b in below + path)))
    return sorted(out, key=str)


def made_up():
    """Sources of 1 to 4,100 rows, nulls in every column, repeated rows and ids, a source that is the empty string."""
    rng, rows = random.Random(2), []
    for source, n in ((None, 5), ("", 1), ("a", 16), ("b", 17), ("é", 256), ("Z", 257), ("😀", 4100), ("c", 2)):
        for i in range(n):
            text = rng.choice([None, "", "Some Text", "É😀 x", "y" * 300])
            rows.append((rng.randrange(10**6), source, rng.choice(["en", None]), rng.choice([None, 3]), text))
    rows += [rows[0], rows[0], (None, "a", None, None, None), (None, "a", None, None, "x"), (None, None, None, None, None), (7, "d", "en", 1, "long " * 50_000)]
    rows += [(i, f"s{i}", "en", 1, "one") for i in range(290)]
    return [(*r, "r", "n", 3, "x") for r in rows]


def test_manifest(spark):
    rows = made_up()
    found = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = found.select("row.doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("segments")), merkle.fold(F.col("leaf"), F.col("segments")).alias("folded")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == manifest(rows)
    assert all(r.folded == r.root for r in got)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [256], [257], [1, 1], [3, 16, 17]])
def test_small_tables(spark, sizes):
    rows = [(i, f"s{k}", None, None, str(i)) for k, n in enumerate(sizes) for i in range(n)]
    found = merkle.merkle_manifest(spark.createDataFrame([(*r, "r", "n", 3, "x") for r in rows], SCHEMA))
    got = found.select("row.doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("segments"))).collect()
    assert sorted(map(tuple, got), key=str) == manifest(rows)


def test_no_rows_and_extra_columns(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", "en", 3, "x", "r", "n", 3, "x"), (2, "a", "en", 3, "y", None, None, None, None)]
    carried = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA), carry=["*"]).select("row.*", "pos").collect()
    assert sorted(tuple(r) for r in carried)[0][-1] == 0 and len(carried) == 2


def test_tampering_is_told(spark, sf_dir):
    """Of the query: exactly the rows whose text tampering changes are not verified."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.op13_merkle(spark, sf_dir).collect()
    assert len(found) == len(docs) and len({r.root for r in found}) == 1
    for r in found:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and docs[r.doc_id] is not None and docs[r.doc_id].translate(lower) != docs[r.doc_id]
        assert r.verified is not changed
