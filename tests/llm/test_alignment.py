"""Alignment of two vocabularies against a plain account of it."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rfrank.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, uid long, pairs string"


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    bytes_a = {i: bytes(alignment._BYTES[c] for c in t) for t, i in a.get_vocab().items() if i < 50256}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    out, counts = [], Counter()
    for text in texts:
        raw = (" " + text).encode() if text else b""
        one = a.encode(" " + text, add_special_tokens=False).ids if text else []
        two = b.encode(text) if text else []
        if b"".join(map(bytes_a.get, one)) != raw or b"".join(map(bytes_b, two)) != raw:
            one = two = []
        groups, links, i, j, at, bt = [], [], 0, 0, 0, 0
        ends_b = {}
        for k, x in enumerate(two):
            bt += len(bytes_b(x))
            ends_b[bt] = k + 1
        for k, x in enumerate(one):
            at += len(bytes_a[x])
            if at in ends_b:
                n = ends_b[at]
                groups.append(",".join(map(str, one[i : k + 1])) + "|" + ",".join(map(str, two[j:n])))
                links.append((x, two[n - 1]))
                i, j = k + 1, n
        counts.update(links)
        out.append((len(one), len(two), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(na, nb, ng, len(li), sum(counts[p] == most[p[1]] for p in li), sum(counts[p] for p in li), g) for na, nb, ng, li, g in out]


def awkward():
    rng = random.Random(4)
    marks = [" ", "  ", "\n", " \n ", "\t", "a", "word", "Über", "日本", "😀", "'s", "1234", "\u2581", "\xa0", "\x1c", "\x85", "\x00", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "e\u0301", ".", "...", "don't", "\u2028", "\u200b"]
    texts = [None, "", " ", "  ", "\n", " a", "a ", "a", "\u2581", "x\u2581y", "y" * 3000, "日本語" * 1500, "long words " * 20_000, " " * 2000, "\n" * 500 + "x", "<|endoftext|>", "a <s> b </s>"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return texts + texts[:30]


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_alignment(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    texts = awkward()
    frame = spark.createDataFrame([(i, t, "r", 7, "p") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = alignment.align_tokenizers(frame, A_PATH, B_PATH, carry=["doc_id"])
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = {r["doc_id"]: r for r in found.select("row.doc_id", *names, "groups_sha256").collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain(texts)):
        assert tuple(got[i][n] for n in names) == want, texts[i]
        assert got[i]["groups_sha256"] == (hashlib.sha256(want[-1].encode()).hexdigest() if want[0] else "")
    assert got[8]["n_a"] == got[9]["n_a"] == 0 < got[10]["n_a"] and got[12]["n_groups"] == 40_001  # the last, a space, by itself


def test_alignment_of_whole_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = alignment.align_tokenizers(frame, A_PATH, B_PATH, with_groups=False).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    want = plain([r.text for r in rows])
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.doc_id, *w[:6], None) for r, w in zip(rows, want, strict=True))


def test_nothing_is_kept_beyond_the_bound(monkeypatch):
    """What is kept of stretches and windows changes no result."""
    texts = [t for t in awkward() if t]
    one, two = alignment.Aligner(A_PATH, B_PATH), alignment.Aligner(A_PATH, B_PATH)
    whole = [(*f[:3], f[3].tolist()) for f in one.texts(texts)]
    monkeypatch.setattr(alignment, "WINDOWS", 3)
    monkeypatch.setattr(alignment, "STRETCHES", 3)
    assert [(*f[:3], f[3].tolist()) for t in texts for f in two.texts([t])] == whole
    assert len(two.windows) <= 3


def test_no_documents_and_other_vocabularies(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert alignment.align_tokenizers(frame, A_PATH, B_PATH).count() == 0
    assert alignment.align_tokenizers(spark.createDataFrame([(1, None, "r", 1, "p")], SCHEMA), A_PATH, B_PATH).select(F.sum("count_sum")).first()[0] == 0
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), B_PATH)
