"""Removal of repeats where texts without any are not sent to the join, and few rows go back at once."""

import random

import pytest
from pyspark.sql import functions as F
from test_texts import brute_removal

from rfrank.llm import substrings


@pytest.mark.parametrize("buckets", [1 << 20, 64, 2])
def test_texts_without_repeats_stay_where_they_lie(spark, monkeypatch, buckets):
    monkeypatch.setattr(substrings, "ROWS", 3)
    rng = random.Random(4)
    common = rng.randbytes(40).hex()
    texts = [None, "", "é" * 70] + [rng.randbytes(rng.randrange(60)).hex() + (common if i % 5 == 0 else "") for i in range(40)]
    docs = spark.createDataFrame([(i % 30, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    size = F.aggregate("removed", F.lit(0), lambda n, r: n + (r["high"] - r["low"]))
    found = substrings.remove_repeats(docs, length=50, gram=16, sieve_buckets=buckets).select("n_bytes", size, F.size("removed"), F.sha2("kept", 256))
    assert sorted(tuple(r) for r in found.collect()) == brute_removal(texts, 50)
