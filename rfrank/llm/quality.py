"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote junk, clean or nothing on every document. Expectation-maximisation
over the counts of vote patterns estimates each labeller's accuracies and the share of junk; the
patterns' posteriors are soft labels for a logistic scorer over hashed features, which decides.

Texts are scanned where they lie and never shuffled. The first scan counts vote patterns over all documents
(at most 3 ** labellers rows, pre-aggregated); the features of at most ``sample_rows`` documents, vectors of
fixed length made where the texts are, are gathered for the fit; the last scan scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, ship_package, text_of

#: Byte classes: 0 white, 1 lower case or beyond ASCII, 2 upper case, 3 digits and the signs of ordinary
#: numbers, addresses and quotations, 4 stop, 5 comma, 6 "!", 7 "|", 8 other.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b"+-()@:;'\"/?=_")] = 3
for _char, _class in ((".", 4), (",", 5), ("!", 6), ("|", 7)):
    _CLASS[ord(_char)] = _class

DIMS = 1024  # class trigrams take the first 729; binned statistics are hashed into the rest
_GRAMS = 9**3
#: Of fewer words, labellers that compare words tell nothing; the others take the text for one of so many words
#: and ``MIN_CHARS`` characters, since one mark or acronym is much of a short text, or, where a script has no
#: spaces, for one word in every ``WORD_BYTES``.
MIN_WORDS, MIN_CHARS, WORD_BYTES = 5, 25, 8
SEVERAL_WORDS = [3 < k < 6 for k in range(8)]  # repeats, few_words
#: The score of a text without a word, whatever the corpus: there is nothing to reject.
EMPTY_SCORE = 0.0
#: A labeller is taken to call at most this share of clean texts junk.
MAX_FALSE_ALARMS = 0.01

#: Labellers: (statistic, at or above this: junk, at or below this: clean). Between the two it abstains; a
#: labeller for one kind of junk only never takes its absence for a sign of quality.
LABELLERS = (
    ("symbols", 0.30, None),  # signs other than . , ! | per word
    ("exclamations", 0.30, None),
    ("upper", 0.50, None),  # share of upper case among ASCII letters
    ("bars", 0.15, None),
    ("repeats", 0.30, None),  # share of words equal to the word before
    ("few_words", 0.65, 0.55),  # 1 - distinct words / words, in windows of 64 words
    ("unclean", 0.40, 0.15),  # share of words that hold a sign of classes 6 to 8
    ("signs", 0.12, 0.06),  # share of signs among the characters that are not white
)


def statistics(text: str, featured: bool = True) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The labellers' statistics (None for a text without a word; NaN where words are too few) and, if wanted, the hashed features."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    features = np.zeros(DIMS, np.float32) if featured else None
    words = text.split()
    if not words:
        return None, features
    c = _CLASS[raw]
    count = np.bincount(c, minlength=9).astype(float)
    if featured and len(c) > 2:
        codes = c[:-2].astype(np.int16) * 81 + c[1:-1].astype(np.int16) * 9 + c[2:]
        features[:_GRAMS] = np.bincount(codes, minlength=_GRAMS) / len(codes)
    n = len(words)
    solid = max(len(c) - count[0], 1)
    white = c == 0
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    odd = np.add.reduceat(c >= 6, starts) > 0 if len(starts) else np.zeros(1, bool)
    windows = [words[i : i + 64] for i in range(0, n, 64)]
    if len(windows) > 1 and len(windows[-1]) < 32:
        windows.pop()
    few = np.mean([1 - len(set(w)) / len(w) for w in windows])
    short, letters, odds = n < MIN_WORDS, count[2] + np.count_nonzero((raw >= 97) & (raw < 123)), odd.sum()
    if short:
        n, solid, letters = max(MIN_WORDS, solid / WORD_BYTES), max(solid, MIN_CHARS), max(letters, MIN_CHARS)
    found = np.array(
        [
            count[8] / n,
            count[6] / n,
            count[2] / max(letters, 1),
            count[7] / n,
            sum(map(str.__eq__, words, words[1:])) / n,
            few,
            odds / n if short else odd.mean(),
            (count[6] + count[7] + count[8]) / solid,
        ]
    )
    if short:
        found[SEVERAL_WORDS] = np.nan  # neither bound holds
    for k, x in enumerate(found if featured else ()):
        if np.isnan(x):
            continue
        bin_ = min(int(x * 20), 19)
        features[_GRAMS + (k * 2654435761 + bin_ * 40503) % (DIMS - _GRAMS)] += 0.25
    return found, features


def votes(found: np.ndarray | None) -> int:
    """The labellers' votes as one number in base 3: 0 abstains, 1 clean, 2 junk."""
    code = 0
    for k, (_, junk, clean) in enumerate(LABELLERS):
        vote = 0 if found is None else 2 if found[k] >= junk else 1 if clean is not None and found[k] <= clean else 0
        code = code * 3 + vote
    return code


def fit_label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, max_false_alarms: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns. Returns each pattern's posterior of junk, the labellers' rates of junk votes
    (class, labeller), and the share of junk. Class 1 is junk.

    Not voting says nothing: a labeller that can vote either way has its rate taken over its votes, one
    for a single kind of junk over all texts of a class, and only votes enter a posterior.

    The rates on junk are estimated freely. Those on clean texts are estimated below ``MAX_FALSE_ALARMS``, an
    assumption about the labellers, not a finding: it tells the two classes apart, as EM alone may take a
    kind of junk that few labellers see for a habit of clean texts. README has figures with and without it.
    """
    m = len(LABELLERS)
    bound = MAX_FALSE_ALARMS if max_false_alarms is None else max_false_alarms
    v = np.stack([codes // 3 ** (m - 1 - k) % 3 for k in range(m)], 1)
    against, for_ = (v == 2).astype(float), (v == 1).astype(float)
    either = np.array([clean is not None for *_, clean in LABELLERS])
    weight = counts.astype(float)
    junk = np.where(against.any(1), 0.8, 0.02)
    for _ in range(rounds):
        share = float(np.clip((weight @ junk + 0.1) / (weight.sum() + 2), 1e-4, 0.9))
        of_class = np.stack([weight * (1 - junk), weight * junk])
        asked = np.where(either, of_class @ (against + for_), of_class.sum(1)[:, None])
        rate = (of_class @ against + [[0.01], [1.0]]) / (asked + 2)
        rate[0] = np.minimum(rate[0], bound)
        odds = np.log(share / (1 - share)) + against @ np.log(rate[1] / rate[0]) + (for_ * either) @ np.log((1 - rate[1]) / (1 - rate[0]))
        was, junk = junk, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(was - junk).max() < 1e-9:
            break
    return junk, rate, share


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels, by accelerated gradient steps on scaled features."""
    scale = 1 / np.sqrt((x * x).mean(0) + 1e-4)
    z = x * scale
    w, b, mw, mb = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), 0.0, 0.0
    step = 4 / (np.square(z).sum(1).mean() + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -60, 60)))
        mw = 0.9 * mw - step * (z.T @ (p - y) / len(y) + l2 * w)
        mb = 0.9 * mb - step * float((p - y).mean())
        w, b = w + mw, b + mb
    return w * scale, b


@dataclass(frozen=True)
class QualityModel:
    """What was learned: the scorer, and what the label model says of the labellers."""

    weights: np.ndarray
    bias: float
    #: Each labeller's rate of junk votes on (clean, junk) texts, and the share of junk.
    rates: dict[str, tuple[float, float]]
    share: float


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, max_false_alarms: float | None = None) -> QualityModel | None:
    """Fit the label model on the votes on all documents, and the scorer on the ``sample_rows`` different
    (id, text) that hash lowest. None for an empty table."""
    ship_package(docs.sparkSession)
    seen = docs.select(F.xxhash64(F.col(id_col), text_of(text_col)).alias("draw"), text_of(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(statistics(t.as_py(), False)[0]) for t in batch.column(1)], pa.int32())], ["draw", "votes"])

    voted = materialize(seen.mapInArrow(vote, "draw bigint, votes int"), "quality-votes")
    patterns = voted.groupBy("votes").count().toPandas()
    if not len(patterns):
        return None
    codes = patterns["votes"].to_numpy()
    posterior, rate, share = fit_label_model(codes, patterns["count"].to_numpy(), max_false_alarms=max_false_alarms)
    limit = voted.select("draw").distinct().orderBy("draw").limit(sample_rows).agg(F.max("draw")).first()[0]
    discard(voted)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([votes(s) for s, _ in out], pa.int32()), pa.array([f.tobytes() for _, f in out], pa.binary())], ["draw", "votes", "features"]
            )

    sample = seen.filter(F.col("draw") <= limit).mapInArrow(features, "draw bigint, votes int, features binary").dropDuplicates(["draw"])
    sample = sample.toPandas().sort_values("draw")  # so that sums do not depend on the order of partitions
    x = np.frombuffer(b"".join(sample["features"]), np.float32).reshape(-1, DIMS)
    y = pd.Series(posterior, index=codes).reindex(sample["votes"]).to_numpy()
    weights, bias = fit_scorer(x.astype(np.float64), y)
    rates = {name: (float(c), float(j)) for (name, *_), c, j in zip(LABELLERS, *rate, strict=True)}
    return QualityModel(weights.astype(np.float32), bias, rates, share)


def classify_quality(
    docs: DataFrame,
    carry: Sequence[Column | str] = ("*",),
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 8000,
    threshold: float = 0.5,
    model: QualityModel | None = None,
) -> DataFrame:
    """Score every document; reject junk. Fits a model on the documents themselves if none is given.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns), ``junk_score``
    (probability of junk by the scorer), ``votes`` and ``accepted`` (score below ``threshold``).

    A null text counts as empty. A text without a word has the score ``EMPTY_SCORE``, any other the
    scorer's; on texts of fewer than ``MIN_WORDS`` words labellers that compare words abstain. Repeated rows
    are scored alike; an empty table gives an empty result. Other columns ride along inside ``row``,
    whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = model or fit_quality(docs, id_col, text_col, sample_rows)
    if model is None:
        empty = T.StructType([docs.select(F.struct(*carry).alias("row")).schema["row"]])
        return spark.createDataFrame([], empty).select("row", F.lit(0.0).alias("junk_score"), F.lit(0).alias("votes"), F.lit(True).alias("accepted"))
    weights, bias = model.weights, model.bias
    whole = list(carry) == ["*"]  # then the text travels inside the row, once
    source = docs.select(F.struct(*carry).alias("row"), *([] if whole else [text_of(text_col).alias("text")]))
    schema = T.StructType(
        [source.schema["row"], T.StructField("junk_score", T.DoubleType()), T.StructField("votes", T.IntegerType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, code = [], []
            for t in batch.column(0).field(text_col) if whole else batch.column(1):
                found, f = statistics(t.as_py() or "")
                code.append(votes(found))
                scores.append(float(1 / (1 + np.exp(-np.clip(f @ weights + bias, -60, 60)))) if found is not None else EMPTY_SCORE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(code, pa.int32())], ["row", "junk_score", "votes"])

    return source.mapInArrow(score, schema).withColumn("accepted", F.col("junk_score") < threshold)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Scores and decisions over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify_quality(docs, carry=["doc_id"]).select("row.doc_id", "junk_score", F.col("accepted").cast("int").alias("quality"))
