"""Near-duplicates by word shingles: clusters of any size, repeated rows, and what is left on disk."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rfrank.llm import minhash
from rfrank.shared import shared_dir


def near_copies(rng, groups):
    """Texts of which each group's are alike to each other but to no other group's."""
    for size in groups:
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        yield " ".join(words)
        for _ in range(size - 1):
            other = list(words)
            other[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            yield " ".join(other)


@pytest.mark.parametrize("sets, shingles", [(1024, 1 << 20), (2, 1 << 20), (25, 1 << 20), (1024, 500)])
def test_clusters_of_any_size(spark, monkeypatch, sets, shingles):
    """A cluster is one group whether it is solved in one task or by pairs and buckets; repeated rows and null ids too."""
    monkeypatch.setattr(minhash, "LOCAL_SETS", sets)
    monkeypatch.setattr(minhash, "LOCAL_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "SEEN", 3)
    groups = [1, 2, 3, 20, 40, 1]
    texts = list(near_copies(random.Random(5), groups))
    of = [g for g, size in enumerate(groups) for _ in range(size)]
    first = {g: of.index(g) for g in of}
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, of, strict=True))]
    rows += [rows[0], rows[1], rows[1], (None, texts[3], of[3]), (None, "all by itself", 6), (None, "all by itself", 6), rows[30]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g int").repartition(3)
    for buckets in (1 << 20, 2):
        got = minhash.jaccard_dedup(docs, sieve_buckets=buckets).select("row.*", "component_id", F.col("kept").alias("stays")).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.g) for r in got) == sorted((i is None, i or 0, g) for i, _, g in rows)
        assert all(r.component_id == first.get(r.g) for r in got)
        assert sorted((r.g, r.doc_id) for r in got if r.stays) == [(g, first.get(g)) for g in range(7)]


def test_rows_are_not_copied(spark, tmp_path):
    """What a run leaves on the shared folder holds no texts."""
    rng = random.Random(8)
    rows = [(i, t, rng.randbytes(2000).hex()) for i, t in enumerate(near_copies(rng, [1] * 250 + [3] * 50))]
    spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(2).write.parquet(str(tmp_path / "docs"))

    def size(path):
        return sum(f.stat().st_size for f in path.rglob("*.parquet"))

    def tables():
        return set(Path(shared_dir(spark).removeprefix("file:")).iterdir())

    before = tables()
    minhash.jaccard_dedup(spark.read.parquet(str(tmp_path / "docs"))).write.parquet(str(tmp_path / "out"))
    assert sum(map(size, tables() - before)) < size(tmp_path / "docs") / 4
