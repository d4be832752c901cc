"""Search, personal data, chat, pages and quality: brute force, round trips and held-out accuracy."""

import html as entities
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfrank.llm import chat, html_text, pii, quality
from rfrank.llm.knn import needed_pairs, scores, top_k

# Search


def brute_top(rows, k):
    valid = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in valid:
        if q % 5:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, pivots, k", [(4096, 64, 10), (7, 5, 3), (16, 1, 10)])
def test_top_k(spark, block, pivots, k):
    rng = random.Random(block)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)]) for i in range(150)]
    rows += [(200 + i, list(rows[3][1])) for i in range(40)]  # ties
    rows += [(300, None), (305, [None] * 6), (310, [float("nan")] * 6), (315, [float("inf")] * 6), (None, [1.0] * 6), (320, []), (325, []), (330, [1.0, 2.0]), (333, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 5 == 0, block=block, pivots=pivots, k=k).collect())
    assert got == brute_top(rows, k)


def test_top_k_copies_only_what_is_needed(spark):
    """Clustered vectors: most cells are pruned, and data goes only to query groups that ask for its cell."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.05).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    celled, pairs = needed_pairs(frame, F.col("vec_id") % 7 == 0, "vec_id", "embedding", 1024, 10, None, 64)
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    searched = pairs.join(cells, "cell").agg(F.sum("size")).first()[0]
    copies = pairs.select("cell", "qblock").distinct().join(cells, "cell").agg(F.sum("size")).first()[0]
    n_queries, n_groups = sum(i % 7 == 0 for i, _ in rows), pairs.select("qblock").distinct().count()
    assert searched < 0.2 * n_queries * len(rows)
    assert n_groups > 5 and copies < 0.4 * n_groups * len(rows)
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 7 == 0, block=64).collect())
    assert len(got) == 10 * n_queries


def test_scores_beyond_doubles():
    a = np.array([[2**31, 3]], np.int64)
    assert scores(a, a).tolist() == [[2**62 + 9]]


def test_no_vectors(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).count() == 0


# Personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 9 <= len(digits) <= 15
            ):
                out.append((m.start(), n, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def pii_texts():
    rng = random.Random(4)
    atoms = ["a@b.c", "x.y+z@d-e.f.g", "@", ".", "..", "1.2.3.4", "256.1.1.1", "001.002.003.0004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "+12", "é", "😀", " ", "_", "%", "-", "9", "12345", "a" * 9, "\n", "4539578763621486"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    return [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1" * 40_000, "a." * 20_000 + "@x.y", "x@" + "a." * 20_000 + "b", "+1" + " 2" * 20_000, *texts]


def test_pii_base(spark):
    texts = pii_texts()
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = pii.find_pii(frame).select("row.doc_id", pii.written(F.col("base")).alias("base"), "spans")
    for r in found.collect():
        assert r.base == brute_base(texts[r.doc_id])
        base = [s for s in r.spans if s.kind not in pii.ADDED]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in base) == r.base  # base spans stay
        for s in r.spans:
            if s.kind in pii.ADDED:
                assert not any(b.start < s.end and s.start < b.end for b in base)


def test_pii_adds_secrets_and_leaves_prose_alone(spark):
    rng = random.Random(5)

    def code(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n)) + "7a"

    rows = []
    for i in range(400):
        secret = [f"password={code(18)}", f'token = "{code(38)}"', f"key: AKIA{code(16).upper()}"][i % 3]
        rows.append((i, f"some words here {secret} and more words" if i % 2 else f"chapter 12 of 2024 has 300000 words and room 101 on page {i}"))
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "row.text", "spans").collect()
    hits = {r.doc_id for r in found if any(s.kind == "secret" for s in r.spans)}
    assert len(hits & set(range(1, 400, 2))) >= 195 and not hits & set(range(0, 400, 2))


def planted_pii(rng, n):
    """Texts with one value of a known kind, or none; as (text, kind, value)."""
    words = "the of and river house walked over light morning then quiet paper green Some When under road people told water bridge".split()
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    first, last = rng.choice(pii.FIRST_NAMES[:30]), rng.choice(["Smith", "Miller", "Keller", "Dupont", "García", "Brown", "Lehmann"])
    made = [
        ("secret", f"password={{}}", rng.choice(["hunter", "p@ssw0rd", "letmein!x", "Tr0ub4dor&3"])),
        ("secret", 'token = "{}"', hexes(40)), ("secret", "api_key=\"{}\"", "sk-abcdEFGH" + hexes(6) + "_mn9"), ("secret", "pin: {}", digits(4)), ("secret", "key: {}", "AKIA" + "IOSFODNNEXAMPLE7"),
        ("id", "ssn: {}", f"{digits(3)}-{digits(2)}-{digits(4)}"), ("id", "IBAN: {}", f"DE89 {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"),
        ("name", "Mr. {}", f"{first} {last}"), ("name", "name: {}", f"{first} {last}"), ("name", "Frau {}", f"{first} {last}"),
        ("address", "address: {}", f"{rng.randrange(1, 900)} {last} Street"), ("address", "wohnt in der {}", f"{last}straße {rng.randrange(1, 99)}"), ("address", "{}, 75001", f"{rng.randrange(1, 99)} rue de {last}"),
        ("birth", "born on {}", f"{rng.randrange(1, 28)}.{rng.randrange(1, 12)}.{rng.randrange(1930, 2010)}"), ("birth", "date of birth: {}", f"19{digits(1)}4-0{rng.randrange(1, 9)}-1{digits(1)}"),
    ]
    plain = ["chapter 12 of 2024 has 300000 words", "on page {n} of volume 3", "The key is important here", "in the years 1990-1995", "version 2.10 of the text", "room 101 was empty", "the 21st of 40 pieces", "a total of 12 500 people", "Then New Things were found", "met on 12.5.2021 again", "St Mary was seen", "the token was lost"]
    out = []
    for i in range(n):
        if i % 2:
            kind, frame, value = made[i // 2 % len(made)]
            out.append((f"{prose(6)} {frame.format(value)} {prose(5)}.", kind, value))
        else:
            out.append((f"{prose(6)} {plain[i // 2 % len(plain)].replace('{n}', str(i))} {prose(5)}.", None, None))
    return out


def test_pii_recall_and_precision(spark):
    """Planted values of every added kind are found as they stand, and prose with numbers and names is left alone."""
    rng = random.Random(11)
    rows = [r for _ in range(60) for r in planted_pii(rng, 30)]
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_pii(frame).select("row.doc_id", "spans").collect()}
    caught, wrong = Counter(), 0
    for i, (text, kind, value) in enumerate(rows):
        here = [text[s.start : s.end] for s in found[i]]
        if kind is None:
            wrong += bool(here)
        else:
            caught[kind, any(value.startswith(h) and len(h) > 3 or h.startswith(value) for h in here)] += 1
    for kind in pii.ADDED:
        assert caught[kind, True] >= 0.85 * (caught[kind, True] + caught[kind, False]), caught
    assert wrong <= 0.05 * len(rows) / 2


def held_out_pii(rng, n):
    """Texts with one value each in words that no list of the module has, or prose that looks like it; as (text, kind, value)."""
    words = "the of and river house walked over light morning then quiet paper green under people told water bridge".split()
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(k))
    person = f"{rng.choice(['Wei', 'Olga', 'Kwame', 'Priya', 'Yusuf', 'Ingrid', 'Tomasz', 'Aroha', 'Nkechi', 'Björn'])} {rng.choice(['Zhang', 'Ivanova', 'Mensah', 'Raman', 'Okafor', 'Lindqvist', 'Nowak', 'Haddad'])}"
    place = rng.choice(["Maple", "Harbour", "Cedar", "Wellington", "Orchard"])
    made = [
        ("name", "please contact {} about it", person), ("name", "My name is {} and", person), ("name", "Dear {}, thanks", person), ("name", "Dr. {} was", person), ("name", "the holder {} has", person), ("name", "approved by {} on", person),
        ("secret", "mi contraseña es {} desde", letters(6) + digits(2)), ("secret", "server key {} rotated", "AKIA" + letters(16).upper()), ("secret", "passwort: {}", letters(5) + "!" + digits(3)), ("secret", "login = '{}'", letters(9) + "#" + digits(1)), ("secret", "auth token {} sent", letters(8) + digits(10)),
        ("birth", "am {} geboren", f"{rng.randrange(1, 28)}.{rng.randrange(1, 12)}.19{digits(2)}"), ("birth", "nacida el {}", f"{rng.randrange(1, 28)}/{rng.randrange(1, 12)}/19{digits(2)}"), ("birth", "DOB {}", f"19{digits(2)}-0{rng.randrange(1, 9)}-1{digits(1)}"),
        ("address", "lives at {}, with", f"{rng.randrange(1, 900)} {place} Lane"), ("address", "habite {} depuis", f"{rng.randrange(1, 99)} rue des {place}"), ("address", "send it to {}.", f"{rng.randrange(1, 900)} {place} Road"),
        ("id", "passport {} issued", f"{digits(3)} {digits(3)} {digits(4)}"), ("id", "konto: {}", f"{digits(4)}-{digits(4)}-{digits(4)}"),
    ]
    plain = ["under the General Public License of", "see Chapter Twelve again", "at Oxford University then", "on 12.5.2021 it rained", "the New World Order", "a key idea was", "room 101 and 102", "the United Nations met", "on Monday Morning we"]
    for i in range(n):
        kind, frame, value = made[i // 2 % len(made)] if i % 2 else (None, plain[i // 2 % len(plain)], None)
        yield f"{prose(6)} {frame.format(value)} {prose(5)}.", kind, value


def test_pii_recall_on_held_out_words(spark):
    rng = random.Random(12)
    rows = [r for _ in range(40) for r in held_out_pii(rng, 38)]
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_pii(frame).select("row.doc_id", "spans").collect()}
    caught, wrong = Counter(), Counter()
    for i, (text, kind, value) in enumerate(rows):
        here = [text[s.start : s.end] for s in found[i]]
        if kind is None:
            wrong[text.split()[6:9][0]] += bool(here)
        else:
            caught[kind, any(value in h or h in value and len(h) > 3 for h in here)] += 1
    print({k: caught[k, True] / (caught[k, True] + caught[k, False]) for k in pii.ADDED}, wrong)
    for kind in pii.ADDED:
        assert caught[kind, True] >= 0.8 * (caught[kind, True] + caught[kind, False]), caught
    assert wrong.total() <= 0.02 * len(rows)


def test_no_license_is_a_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text LIKE '%General Public%'")
    every = pii.find_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert docs.count() > 0
    named = every.select(F.explode("spans").alias("s"), "row.text").filter("s.kind = 'name'").select(F.expr("substring(text, s.start + 1, s.end - s.start)").alias("name"))
    assert named.filter("name LIKE '%General Public%'").count() == 0


def test_patterns_survive_long_chains(spark):
    """Every pattern over long runs of what its loops take: a stack that overflows would end the session."""
    n = 60_000
    chains = ["1 rue" + " de" * n, "1 rue" + " des" * n + " Paix", "1 " + "Ab " * n + "Street", "A" * n + "straße 1", "DE89" + " ABCD" * n, "12" + "-34" * n, "1.1" * n, "1-" * n, "4111 " * n, "+1" + " 2" * n, "+" * n + "1",
              "a." * n + "@b" + ".c" * n, "@" * n, "a@" * n, "password" * n, "password: " * n, "password =" + " " * n + "x", "key" + ":" * n, "Mr. " * n + "Jo Do", "Dr Ab" + " Cd" * n, "Ab-" * n, "Dear " * n, "a1" * n, "A" * n + "1", "AKIA" * n, "1" * n,
              "1/1/" * n, "2001-01-01" * n, "mot de " * n, "é" * n + "@x.y", "né " * n + "1.1.1999", "calle" + " la" * n + " Sol", "\n" * n, "'" * n, "1 " * n]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(chains)], "doc_id long, text string").repartition(4)
    assert pii.find_pii(frame).count() == len(chains)
    assert spark.range(3).count() == 3


def test_pii_plan_is_native_and_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(frame).count() == 0
    one = pii.find_pii(spark.createDataFrame([(1, "key=abc123def456")], "doc_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", one._jdf.queryExecution().executedPlan().toString())


def test_reliabilities():
    m = len(pii.LABELLERS)
    clean, private = sum(pii.CLEAN * 3**k for k in range(m)), sum(pii.PRIVATE * 3**k for k in range(m))
    post, rate, share = pii.fit_reliabilities({clean: 900, private: 100, 0: 5})
    assert post[private] > 0.99 and post[clean] < 0.01 and 0.05 < share < 0.15
    assert all(c < q for c, q in rate)


# Chat

CONVERSATIONS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, 0, "user", "\\1 \\0 \\\\ \\3"), (3, 1, "assistant", "plain"),
    (4, 1, "assistant", "[/INST]"), (4, 0, None, "é😀\n"), (4, None, "system", "first"),
    (5, 0, "a[INST]b", "x"), (5, 0, "a", "y"), (5, 0, "a", "y"),
    (None, 0, "user", "no id"), (6, 0, "assistant", "back\\slash only"), (7, 0, "assistant", "\\0"),
    (8, 0, "user", "[INST"), (8, 1, "assistant", "INST]</s"), (9, 0, "user", "w " * 50_000),
]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame([(*r, "extra") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, formatted string")
    found = chat.format_chat(frame).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    want = defaultdict(list)
    for conv, turn, role, text in CONVERSATIONS:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert len(found) == len(want)
    for r in found:
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for *_, role, text in sorted(want[r.conv_id])]
        assert r.escaped == any(re.search(r"\[/?INST\]|</s>|\\[0-3]", role + " " + text) for *_, role, text in want[r.conv_id])
        assert sum(m.n_chars for m in r.loss_mask) == len(r.formatted)
        at, masked = 0, ""
        for m in r.loss_mask:
            if m.masked:
                part = r.formatted[at : at + m.n_chars]
                for plain, code_ in reversed(chat.ESCAPES):
                    part = part.replace(code_, plain)
                masked += part
            at += m.n_chars
        assert masked == "".join(text for *_, role, text in sorted(want[r.conv_id]) if role == "assistant")


@pytest.mark.parametrize("broken", ["x", "[INST]a", "[INST]a[/INST]b", "[INST]a[/INST]b</s>c", "[INST]a[/INST]b</s></s>", "[INST]a[/INST]b[/INST]</s>", "[INST]a</s>"])
def test_chat_grammar_refuses(spark, broken):
    assert spark.createDataFrame([(broken,)], "t string").select(chat.parse(F.col("t")).alias("x")).first().x is None


def test_no_conversations(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# Pages


def reference_text(page):
    """The article of the test pages' one template, by its markup."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>|<br>", body)
    texts = [" ".join(entities.unescape(re.sub(r"</?b>", "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    train, held = pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")
    found = html_text.extract_text(held, model=html_text.train(train)).select("row.page_id", "row.html", "text").collect()
    assert len(found) > 50 and all(r.text == reference_text(r.html) for r in found)


@pytest.mark.parametrize("wrap", [
    '<div class="has-sidebar">', '<div class="no-sidebar">', '<div class="layout-with-nav">', '<div class="page-header-fixed">', '<div id="content" class="with-comments sidebar-left-open">', '<div class="sidebar">',
    '<article class="hentry category-social-science">', '<article id="how-to-search-the-sky">', '<article class="post comments">',
])
def test_names_of_wrappers_empty_no_page(spark, sf_dir, wrap):
    """All pages within such an element, or with such an article, keep their texts."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    model = html_text.fit(html_text.count_labelled(iter(pages)))
    for h in pages:
        tag = wrap[1:].split()[0]
        changed = h.replace("<article>", wrap) if tag == "article" else re.sub(r"<body[^>]*>|(?<=</head>)(?!<body)", lambda m: m[0] + wrap, h, count=1)
        assert changed != h
        assert model.text(changed) == reference_text(h)


@pytest.mark.parametrize("open_, close, stays", [
    ('<p class="legal-history">', "</p>", True), ('<section id="comments-on-plato"><p>', "</p></section>", True), ('<p class="no-ads">', "</p>", True), ('<div class="search-for-meaning"><p>', "</p></div>", True),
    ('<div class="comments"><p>', "</p></div>", False), ('<div id="related-posts"><p>', "</p></div>", False), ('<div class="newsletter-signup-form"><p>', "</p></div>", False), ('<ul class="social-share-buttons"><li>', "</li></ul>", False),
    ('<div class="comment-list"><p>', "</p></div>", False), ('<div class="cookie-notice"><p>', "</p></div>", False), ('<div class="ad-unit"><p>', "</p></div>", False),
])
def test_names_within_an_article(spark, sf_dir, open_, close, stays):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60).collect()]
    model = html_text.fit(html_text.count_labelled(iter(pages)))
    told = "What is said here is long enough to be a paragraph of its own. It has two sentences."
    for h in pages:
        text = model.text(h.replace("</article>", f"{open_}{told}{close}</article>"))
        assert text == reference_text(h) + ("\n" + told if stays else "")


def without_names(page):
    """The page with no tag or attribute left that tells what a block is for."""
    page = re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r' (class|id|role)="[^"]*"', "", page)


def test_pages_without_telling_names(spark, sf_dir):
    """Decided by messages from the blocks' texts and company; words against those of the article."""
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    model = html_text.fit(html_text.count_labelled(h for i, h in pages if i % 2))
    right = extra = missed = 0
    for i, h in pages:
        if i % 2 == 0:
            got, want = Counter(model.text(without_names(h)).split()), Counter(reference_text(h).split())
            right, extra, missed = right + (got & want).total(), extra + (got - want).total(), missed + (want - got).total()
    assert 2 * right / (2 * right + extra + missed) > 0.99


@pytest.mark.parametrize("page", [
    "<a " * 330_000, "<div>" * 100_000, '<a "' * 200_001 + ">", "<!--" * 200_000, "<p>" * 100_000, "<ul><li>" * 60_000, "<b>" * 100_000 + "</i>" * 100_000,
    "<script>" + "</script " * 100_000, "<head>" * 100_000, '<a class="' * 80_000 + ">", "<button>" * 50_000 + "<p>x" * 50_000, "<table><tr><td>" * 30_000 + "</b>" * 30_000,
])
def test_broken_and_deep_pages_take_linear_time(page):
    model, began = html_text.fit({}), time.process_time()
    model.text(page)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("page, want", [
    ("<button>Menu <article><h1>T</h1><p>A long paragraph of text that is here. Yes.</p></article> <button>Share</button>", "T\nA long paragraph of text that is here. Yes."),
    ("<p>before <svg><title>x</title><path></svg> after it goes on for a while. Yes.</p>", "before after it goes on for a while. Yes."),
    ("<article><p>x <math><mi>a</mi></math> y is a text of some length, is it not. Yes.</p><p>z <object>instead</object></p></article>", "x a y is a text of some length, is it not. Yes.\nz instead"),
    ("<noscript><img>please</noscript><article><p>Text.</p></article>", "Text."),
    ("<svg><path><article><p>Text.</p></article>", "Text."),
    ("<article><p>Text <a href='it", "Text"),
    ("<article><p title=it's>Text, a < b.</p><p title=\"a>b\">More.</p></article>", "Text, a < b.\nMore."),
])
def test_markup_that_is_no_text(page, want):
    assert html_text.fit({}).text(page) == want


PAGES = [
    (
        "<html><body class='has-sidebar'><header><h1>Site</h1><ul><li><a href=/>Home</a></ul></header><div class='cookie-notice'>We use cookies. Accept?</div><div id=content><h1>Title</h1>"
        "<p>First &amp; long paragraph of the text that goes on for a while, and more.<p>Second one is here, which also is fairly long and has a stop.</p><ul><li>item one<li>item two</ul></div>"
        "<aside>Related things</aside><div class=comments><p>Nice article, I liked it a lot. Thanks.</p></div><form>Subscribe <input></form><footer>(c) 2020</footer></body></html>",
        "Title\nFirst & long paragraph of the text that goes on for a while, and more.\nSecond one is here, which also is fairly long and has a stop.\nitem one\nitem two",
    ),
    (
        "<article><h1>T</h1><p>Ok.</p><div class=comments><div><p>Nice article, I liked it a lot and wanted to say thanks for it. Really good.</p></div></div>"
        "<p>Long text in an article that is content and is kept. Yes.</p><aside><p>Read also: foo bar and more. It is long text with stops.</p></aside><table><tr><td>1<td>2</table></article>",
        "T\nOk.\nLong text in an article that is content and is kept. Yes.\n1\n2",
    ),
    ("<p>Just text, not in a container, but long enough to be content of the page.</p><p>More of the text follows here, with stops. And more.</p>", "Just text, not in a container, but long enough to be content of the page.\nMore of the text follows here, with stops. And more."),
    ("<script>if (a<b) document.write('<p>x</p>')</script><style>p{}</style><main><p>a < b and c > d &copy; x&nbsp;&nbsp; y</p></main><!-- <p>no</p> -->", "a < b and c > d © x y"),
    ("", ""),
    (None, ""),
]


def test_other_templates(spark, sf_dir):
    model = html_text.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    frame = spark.createDataFrame([(i, p, "clash") for i, (p, _) in enumerate(PAGES)], "page_id int, html string, text string")
    got = {r.page_id: r.main for r in html_text.extract_text(frame, model=model).select("row.page_id", F.col("text").alias("main")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}


def test_marginals_are_exact():
    """Messages against the sum over all labellings of small trees."""
    import itertools
    import math

    rng = random.Random(6)
    for _ in range(20):
        model = html_text.Model([rng.uniform(-2, 2) for _ in html_text.FEATURES], [rng.uniform(-3, 3) for _ in range(4)])
        nodes = [html_text.Node("#root", -1, ())]
        for i in range(1, 7):
            kind = tuple(sorted(rng.sample(range(len(html_text.FEATURES)), 2)))
            kind = tuple(f for f in kind if f not in html_text._BAD)
            nodes.append(html_text.Node("div", rng.randrange(i), kind))
        total = [[0.0, 0.0] for _ in nodes]
        for labels in itertools.product((0, 1), repeat=len(nodes)):
            w = 1.0
            for n, y in zip(nodes, labels):
                w *= math.exp(model.potential(html_text.features(n)) * y)
                if n.parent >= 0:
                    a, b, c, d = model.edges[not html_text._GOOD.isdisjoint(n.kind)]
                    w *= ((a, b), (c, d))[labels[n.parent]][y]
            for t, y in zip(total, labels):
                t[y] += w
        for got, (no, yes) in zip(model.marginals(nodes), total):
            assert got == pytest.approx(math.log(yes / no), abs=1e-9)


def test_no_pages(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_deep_and_long_pages():
    model = html_text.fit({})
    assert model.text("<div>" * 5000 + "<p>A paragraph that is long enough to be the content of this page, surely. Yes.</p>").startswith("A paragraph")
    assert len(model.text("<main>" + "<p>word word.</p>" * 20_000 + "</main>").split("\n")) == 20_000


# Quality


def test_top_k_with_copies_of_query_rows(spark):
    """The query's own rows, however many, prune nothing; as in the SQL, each row of a query brings its list."""
    from rfrank.llm.knn import _top, top_k

    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 8))
    x[0] *= 0.05  # its own rows are nearer to any pivot of their own than others, and score low
    ids = np.array([*range(2000), *[0] * 11])
    x = np.concatenate([x, np.repeat(x[:1], 11, 0)])
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    v = np.floor(1024 * x).astype(np.int64)
    for query, n, pivots in ((0, 12, 64), (0, 12, 2000), (7, 1, 64)):
        got = top_k(frame, F.col("vec_id") == query, pivots=pivots).orderBy("rank").collect()
        found = v @ v[query]
        want = sorted((-int(s), int(i)) for s, i in zip(found, ids, strict=True) if i != query for _ in range(n))[:10]
        assert [(-r.score, r.vec_id) for r in got] == want
    own = _top([0], np.array([0] * 12 + list(range(1, 40))), np.array([[100] * 12 + list(range(39))]), 10)
    assert own["score"].tolist() == list(range(38, 28, -1))


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, gold = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.classify_quality(docs, carry=["doc_id"]).select("row.doc_id", "accepted").join(gold, "doc_id").toPandas()
    right = found[found.accepted == (found.quality == 1)]
    clean = found[found.quality == 1]
    assert len(right) / len(found) > 0.98 and clean.accepted.mean() > 0.995


def test_quality_edges(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "three words only", None), (3, "word " * 50_000, "x"), (None, "A normal sentence with a few ordinary words in it.", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, votes string")
    found = quality.classify_quality(frame)
    assert found.select("row.*").columns == frame.columns and found.count() == len(rows)
    assert {r.doc_id: r.ok for r in found.select("row.doc_id", F.col("accepted").alias("ok")).filter("doc_id is not null").collect()}[3] is False
    assert all(r.ok for r in found.select(F.col("row.text").alias("t"), F.col("accepted").alias("ok")).collect() if len(r.t or "") < 1000)
    assert quality.classify_quality(frame.limit(0)).count() == 0


def test_quality_scores_short_texts(spark):
    """Texts of one to four words are told apart whatever the share of junk; the empty text has one decision."""
    rng = np.random.default_rng(4)
    clean = [" ".join("".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) + rng.choice(["", "", "", "."]) for _ in range(30)) for _ in range(150)]
    junk = ["".join(rng.choice(["#", "*", "~", "^", "ab", "$", " "], 120)) for _ in range(150)]
    short = ["That*** atly.###", "##$$ **~~", "walked home", "The river.", "Hello!", "USA", "Price: $5", "わたしたちは川まで歩いて帰りました。" * 20, "", None]
    for n_clean, n_junk in ((150, 15), (15, 150)):
        texts = [*short, *clean[:n_clean], *junk[:n_junk]]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r.doc_id: r.accepted for r in quality.classify_quality(frame).select("row.doc_id", "accepted").collect()}
        assert [found[i] for i in range(len(short))] == [False, False] + [True] * 8


def plain_votes(text):
    """The labellers' votes, written out one by one."""
    white = " \t\n\x0b\x0c\r"
    words = [w for w in re.split(f"[{white}]+", text) if w]
    raw = text.encode()
    if not words:
        return [0] * 8
    ordinary = set(b"+-()@:;'\"/?=_0123456789.,!|") | set(white.encode())
    kind = ["a" if 97 <= b < 123 or b > 127 else "A" if 65 <= b < 91 else chr(b) if b in ordinary else "#" for b in raw]
    count = Counter(kind)
    odd = sum(any(k in "!|#" for k in kind_of) for kind_of in ([k for k, b in zip(kind, raw)][i:j] for i, j in word_bytes(raw)))
    solid, letters, n = sum(b not in white.encode() for b in raw), sum(65 <= b < 91 or 97 <= b < 123 for b in raw), len(words)
    windows = [words[i : i + 64] for i in range(0, n, 64)]
    if len(windows) > 1 and len(windows[-1]) < 32:
        windows.pop()
    few = sum(1 - len(set(w)) / len(w) for w in windows) / len(windows)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    short, solid = n < 5, max(solid, 1)
    if short:
        n, solid, letters = max(5, solid / 8), max(solid, 25), max(letters, 25)
    noise = count["!"] + count["|"] + count["#"]
    found = [count["#"] / n, count["!"] / n, count["A"] / max(letters, 1), count["|"] / n, repeats / n, few, odd / n, noise / solid]
    out = []
    for k, (x, (_, junk, clean)) in enumerate(zip(found, quality.LABELLERS, strict=True)):
        out.append(0 if short and k in (4, 5) else 2 if x >= junk else 1 if clean is not None and x <= clean else 0)
    return out


def word_bytes(raw):
    return [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw)]


def plain_posteriors(votes):
    """EM document by document."""
    either, junk = [c is not None for *_, c in quality.LABELLERS], [0.8 if 2 in v else 0.02 for v in votes]
    for _ in range(200):
        share = min(0.9, max(1e-4, (sum(junk) + 0.1) / (len(votes) + 2)))
        rate = []
        for k in range(8):
            of = []
            for y, pseudo in ((0, 0.01), (1, 1.0)):
                w = [q if y else 1 - q for q in junk]
                against = sum(x for x, v in zip(w, votes) if v[k] == 2)
                asked = sum(x for x, v in zip(w, votes) if v[k]) if either[k] else sum(w)
                of.append((against + pseudo) / (asked + 2))
            rate.append((min(of[0], quality.MAX_FALSE_ALARMS), of[1]))
        was, junk = junk, []
        for v in votes:
            odds = math.log(share / (1 - share))
            for k, x in enumerate(v):
                if x == 2:
                    odds += math.log(rate[k][1] / rate[k][0])
                elif x == 1 and either[k]:
                    odds += math.log((1 - rate[k][1]) / (1 - rate[k][0]))
            junk.append(1 / (1 + math.exp(-max(-500, min(500, odds)))))
        if max(abs(a - b) for a, b in zip(was, junk)) < 1e-9:
            break
    return junk, rate, share


def test_quality_against_brute_force(spark, sf_dir):
    """Votes, labellers' rates and scores of a table, document by document in plain Python."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    rows += [(1000, None), (1001, "\n"), (1002, "!!! ### %%%"), (1003, "ok"), (1004, "日本語のとても長い文章です。")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = quality.fit_quality(docs)
    votes = [plain_votes(t or "") for _, t in rows]
    junk, rate, share = plain_posteriors(votes)
    assert model.share == pytest.approx(share, abs=1e-6)
    assert np.array(list(model.rates.values())) == pytest.approx(np.array(rate), abs=1e-6)
    draws = {r.doc_id: r.draw for r in docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("draw")).collect()}
    order = sorted(range(len(rows)), key=lambda i: draws[rows[i][0]])
    x = np.stack([quality.statistics(rows[i][1] or "")[1] for i in order]).astype(float)
    weights, bias = quality.fit_scorer(x, np.array([junk[i] for i in order]))
    want = {}
    for (i, t), v in zip(rows, votes):
        code = int("".join(map(str, v)), 3)
        score = 1 / (1 + math.exp(-(quality.statistics(t)[1] @ weights + bias))) if (t or "").split() else 0.0
        want[i] = (code, pytest.approx(score, abs=1e-3))
    got = {r.row.doc_id: (r.votes, r.junk_score) for r in quality.classify_quality(docs, carry=["doc_id"]).collect()}
    assert got == want


def test_label_model_finds_junk_and_accuracies():
    rng = np.random.default_rng(1)
    m, n = len(quality.LABELLERS), 20_000
    junk = rng.random(n) < 0.15
    kinds = rng.integers(0, 4, n)
    v = np.zeros((n, m), int)
    for k in range(m):
        either = quality.LABELLERS[k][2] is not None
        hit = junk & ((kinds == k % 4) if not either else rng.random(n) < 0.6)
        v[:, k] = np.where(hit, 2, np.where(either & (rng.random(n) < 0.9), 1, 0))
    codes, counts = np.unique(v @ (3 ** np.arange(m)[::-1]), return_counts=True)
    posterior, rate, share = quality.fit_label_model(codes, counts)
    said = posterior[np.searchsorted(codes, v @ (3 ** np.arange(m)[::-1]))] > 0.5
    assert (said == junk).mean() > 0.99 and abs(share - 0.15) < 0.05 and (rate[1] > rate[0]).all()


# The pipeline


def test_stages_keep_columns_and_survive_awkward_rows(spark, tmp_path):
    import corpus_pipeline
    from test_texts import SCHEMA, awkward

    docs = spark.createDataFrame(awkward(), SCHEMA)
    for rows in (docs, docs.limit(0)):
        at = rows
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{rows is docs}-{i}")
            out = stage(spark, at, "")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(path)
            at = spark.read.parquet(path)
            assert (at.count() > 0) == (rows is docs)


def test_stage_decisions(spark, sf_dir):
    import corpus_pipeline
    from rfrank.llm.simhash import fingerprint

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    unique = stages["exact_dedup"](spark, docs, sf_dir).toPandas()
    texts = docs.toPandas().text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t))
    assert len(unique) == texts.nunique() and unique.text.map(lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t)).nunique() == len(unique)
    near = stages["near_dedup"](spark, docs, sf_dir).toPandas()
    prints = near.text.map(fingerprint).tolist()
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    mixed = stages["mix"](spark, docs, sf_dir)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    most = sum(r.n for r in docs.groupBy("source").agg(F.max(words).alias("n")).collect())
    assert abs(mixed.agg(F.sum(words)).first()[0] - docs.agg(F.sum(words)).first()[0]) <= most / 2  # whole texts only
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    assert all((r.doc_id, r.text) in whole for r in mixed.select("doc_id", "text").distinct().collect())


def plain_pipeline(rows, accepted):
    """Copies of each document that reach packing, in plain Python; ``accepted`` are the ids that quality keeps."""
    import hashlib

    from rfrank.llm.minhash import shingles
    from rfrank.llm.simhash import fingerprint

    docs = [r for r in rows if r[0] in accepted]
    kept = {}
    for r in docs:  # exact
        text = re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "")
        if text not in kept or (-len(r[1] or ""), r[0]) < (-len(kept[text][1] or ""), kept[text][0]):
            kept[text] = r
    docs = sorted(kept.values())
    root = list(range(len(docs)))  # near

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, prints = [set(shingles(r[1] or "").tolist()) for r in docs], [fingerprint(r[1] or "") for r in docs]
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (prints[i] ^ prints[j]).bit_count() <= 4 or a and b and len(a & b) >= 0.8 * len(a | b) or not a and not b:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = [r for i, r in enumerate(docs) if find(i) == i]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs}  # mix
    sources = sorted({r[2] for r in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in docs if r[2] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    full = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / max(1, sum(weight[s] for s in sources if s not in full))
        more = {s for s in sources if s not in full and 3 * total[s] < level * weight[s]}
        if not more:
            break
        full |= more
    copies = Counter()
    for s in sources:
        budget = 3 * total[s] if s in full else math.floor(level * weight[s] + 0.5)
        epochs, left = divmod(budget, total[s]) if total[s] else (0, 0)
        for r in sorted((r for r in docs if r[2] == s), key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest()):
            n = size[r[0]]
            if n:
                part = max(0, min(left, n))
                left -= part
                copies[r[0]] += epochs + (2 * part >= n)
    return +copies


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    import corpus_pipeline
    import public_tokenizers

    from rfrank.llm.packing import WordTokenizer

    rng = random.Random(8)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(220).collect()]
    rows = [(i, t, la, f"s{i % 5}" if i % 11 else None, n) for i, t, la, _, n in rows]
    for i in range(40):  # near and exact copies
        words = rows[3 * i][1].split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append((1000 + i, " ".join(words) if i % 2 else rows[3 * i][1] + " \n", "en", "s1", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, " \n", "en", None, 2), (2003, "one two", "en", "s2", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    accepted = {r.row.doc_id for r in quality.classify_quality(docs, carry=["doc_id"]).filter("accepted").collect()}
    want = plain_pipeline([(i, t, s) for i, t, _, s, _ in rows], accepted)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens, got = Counter(), {}
    for p in pieces:
        tokens[p.doc_id] += p.length
        got[p.doc_id] = p.doc_tokens
    t, texts = WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), {r[0]: r[1] for r in rows}
    assert {i: tokens[i] / n for i, n in got.items()} == dict(want) and len(want) > 100
    assert all(n == len(t.encode(texts[i] or "")) // 4 + 1 for i, n in got.items())


def test_entry_survives_without_the_operators(tmp_path):
    """A copy of the repository without these folders still imports and offers the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession; q = e.queries()\n"
        "assert 'rank_default' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q\n"
        "assert e.entry(SparkSession.builder.master('local[2]').getOrCreate()).count() > 0"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=300)


def test_top_k_sends_few_bytes_and_large_bins(spark):
    """Small integers take two bytes each, wider ones what they need; cells fill bins, so a query meets few of them; results are exact in any type."""
    from rfrank.llm import knn

    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 8))
    x[5], x[10], x[15] = x[5] * 1e3, x[10] * 1e9, -x[10] * 1e3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    celled, pairs = needed_pairs(frame, F.col("vec_id") % 5 == 0, "vec_id", "embedding", 1024, 10, None, 1024)
    assert {r[0] for r in celled.select(F.length("v")).distinct().collect()} == {16, 32, 64}
    assert pairs.select("bin").distinct().count() <= 4 < 30 < pairs.select("cell").distinct().count()
    assert pairs.groupBy("cell").agg(F.count_distinct("bin").alias("n")).filter("n > 1").count() == 0
    v = np.floor(1024 * x).astype(np.int64)
    got = {}
    for r in top_k(frame, F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for query in (0, 5, 10, 15, 20, 2995):
        found = (v.astype(object) @ v[query].astype(object)).tolist()
        want = sorted((-((int(s) + 2**63) % 2**64 - 2**63), i) for i, s in enumerate(found) if i != query)[:10]
        assert sorted(got[query]) == want
    sizes = {c: 10 + c for c in range(200)} | {200: 5000}
    bins = knn.data_bins(rng.standard_normal((201, 4)), sizes, 1024)
    held = {}
    for c, (b, n) in bins.items():
        held[b] = held.get(b, 0) + sizes[c] / n
    assert max(held.values()) <= 1024 and bins[200][1] == 5 and len(held) < 40
    for most, kind in ((2**11, np.float32), (2**13, np.float64), (2**31, np.int64)):
        a = rng.integers(-most, most, (50, 4))
        a[0] = most - 1
        assert knn._exact(a, a) == kind and (scores(a, a) == a @ a.T).all()
