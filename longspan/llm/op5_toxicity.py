"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Signs of a text are its lower-cased words, the leading 4 to 7 letters of its words, and a few
patterns (capitals, marks in a row, words in a row). Over a bounded sample of labelled rows that
may be learned from, the signs that speak for a label are counted; those that speak most clearly
for the toxic one, and the patterns, are the voters. A voter votes or is silent.

The label model knows no labels after its start: expectation and maximisation estimate how often
each voter votes on toxic and on clean texts, and how far voters agree within a class. Agreement
beyond chance within a class is correlation, and correlated votes share their evidence. The
posteriors train a logistic regression over all chosen signs, which then scores every whole text.

Only the sample's counts by sign (cut to those that matter) and its rows as lists of chosen signs
reach the driver, both bounded by `fit_docs`. That is the documented bound of the sample: all
labelled rows of the fold if there are no more than that, else about that many, chosen by a hash.

Defined cases: null and empty texts have no sign and get the score of that, the intercept's. Rows
with a null doc_id or label are not learned from; a null doc_id is not held out. If nothing can be
learned the score is 0. Repeated rows each give a row, other columns are ignored, and an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from longspan.llm.batches import slices, texts
from longspan.llm.op2_language_id import remainder
from longspan.sources.stages import stage

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)
MARKS = re.compile(r"[!?]{2,}|\*{3,}")
#: Least correlation within classes that counts as a dependence.
TIED = 0.5
PATTERNS = ("<capitals>", "<marks>", "<again>")


def signs(text: bytes | None) -> set[str]:
    """Words, leading letters and patterns of a text.

    Leading letters are marked with ^, and again with + if several words share them and with % if
    these are a fiftieth of the words or more.
    """
    if not text:
        return set()
    plain = text.decode("utf-8", "replace")
    lower = plain.lower()
    listed = WORD.findall(lower)
    words = set(listed)
    found = set(words)
    for n in STEMS:
        for stem, k in Counter(w[:n] for w in words if len(w) >= n).items():
            found.add("^" + stem)
            if k > 1:
                found.add(f"^{stem}+")
                if 50 * k >= len(words):
                    found.add(f"^{stem}%")
    if 3 * sum(map(str.isupper, plain)) > len(plain):
        found.add(PATTERNS[0])
    if MARKS.search(plain):
        found.add(PATTERNS[1])
    if any(a == b == c for a, b, c in zip(listed, listed[1:], listed[2:])):
        found.add(PATTERNS[2])
    return found


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Posterior of the toxic class for each row of votes.

    `start` gives the labels that the rates start from. Each round estimates the voters' rates in
    both classes and their correlations within classes, then the posteriors. The class share stays
    as it starts, so the classes keep their meaning.
    """
    votes = votes.astype(np.float64)
    belief = np.clip(start.astype(np.float64), 0.02, 0.98)
    share = np.clip(start.mean(), 1e-3, 1 - 1e-3)
    for _ in range(rounds):
        rate = [((w @ votes) + 0.5) / (w.sum() + 1.0) for w in (1 - belief, belief)]
        spread, scale = np.zeros((votes.shape[1],) * 2), np.zeros(votes.shape[1])
        for w, r in zip((1 - belief, belief), rate):
            off = votes - r
            spread += (off * w[:, None]).T @ off
            scale += (off * off * w[:, None]).sum(0)
        tied = np.clip(spread / np.sqrt(np.outer(scale, scale) + 1e-12), 0.0, 1.0)
        tied[tied < TIED] = 0.0
        np.fill_diagonal(tied, 0.0)
        said = np.log(rate[1] / rate[0])
        silent = np.log((1 - rate[1]) / (1 - rate[0])) / (1 + tied.sum(0))
        evidence = (votes / (1 + votes @ tied)) @ said + (1 - votes) @ silent
        belief = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + evidence, -30, 30)))
    return belief


def fit_linear(rows: list[np.ndarray], width: int, belief: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; rows are the places of their ones."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    signs_at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    weight, bias = np.zeros(width), 0.0
    slope, square = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        score = bias + np.bincount(at, weight[signs_at], len(rows))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - belief
        pull = np.append(np.bincount(signs_at, error[at], width) / len(rows) + ridge * weight, error.mean())
        slope, square = 0.9 * slope + 0.1 * pull, 0.99 * square + 0.01 * pull * pull
        step = 0.1 * (1 - (t - 1) / rounds) * (slope / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, float(bias)


def fit(docs: DataFrame, labels: DataFrame, folds: int, held: int, fit_docs: int, voters: int, width: int) -> tuple[dict[str, float], float] | None:
    """Weights of signs, and the intercept."""
    usable = labels.where((remainder("doc_id", folds) != held) & F.col("toxic").isNotNull())
    usable = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = usable.count()
    spot = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / float(1 << 53)
    # About `fit_docs` rows of two numbers.
    chosen = F.broadcast(usable.where(spot < float(fit_docs) / max(rows, 1)))
    sample = stage(texts(docs).where(remainder("doc_id", folds) != held).join(chosen, "doc_id").select("text", "toxic"), "sample")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lots = [sorted(signs(t)) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"signs": pa.array(lots, pa.list_(pa.string())), "toxic": part.column(1).cast(pa.int32())})

    read = sample.mapInArrow(listed, "signs array<string>, toxic int")
    sums = sample.agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("int")).alias("toxic")).first()
    toxic, clean = sums.toxic or 0, sums.n - (sums.toxic or 0)
    if not toxic or not clean:
        return None
    counts = (
        read.select(F.explode("signs").alias("sign"), "toxic").groupBy("sign")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .withColumn("odds", F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0)))
    )
    # The signs that speak most for either label, by how often and how clearly they do.
    speaks = F.sqrt(F.col("t") + F.col("c")) * F.col("odds")
    strong = counts.where("t + c >= 3").orderBy(F.desc(F.abs(speaks)), "sign").limit(width).collect()
    names = sorted({r.sign for r in strong} | set(PATTERNS))
    place = {s: k for k, s in enumerate(names)}
    for_toxic = sorted((r for r in strong if r.odds > 3 and r.t >= max(3, 0.95 * (r.t + r.c))), key=lambda r: (-r.odds * r.t**0.5, r.sign))
    chosen_voters = [place[s] for s in dict.fromkeys([*(r.sign for r in for_toxic[:voters]), *PATTERNS])]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lots = [sorted(place[s] for s in signs(t) if s in place) for t in part.column(0).to_pylist()]
            packed = [np.array(x, "<i4").tobytes() for x in lots]
            yield pa.RecordBatch.from_pydict({"places": pa.array(packed, pa.binary()), "toxic": part.column(1).cast(pa.int32())})

    found = sample.mapInArrow(placed, "places binary, toxic int").toPandas().sort_values(["places", "toxic"])
    places = [np.frombuffer(p, "<i4").astype(np.int64) for p in found["places"]]
    votes = np.zeros((len(places), len(names)), bool)
    for k, p in enumerate(places):
        votes[k, p] = True
    belief = label_model(votes[:, chosen_voters], found["toxic"].to_numpy())
    weight, bias = fit_linear(places, len(names), belief)
    return {s: float(w) for s, w in zip(names, weight)}, bias


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, fit_docs: int = 16_000, voters: int = 120, width: int = 1500
) -> DataFrame:
    """doc_id, held_out and score for each row."""
    spark = docs.sparkSession
    fitted = spark.sparkContext.broadcast(fit(docs, labels, folds, held, fit_docs, voters, width))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if fitted.value is None:
                scores = [0.0] * part.num_rows
            else:
                weights, bias = fitted.value
                sums = [bias + sum(sorted(weights[s] for s in signs(t) if s in weights)) for t in part.column(1).to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(scores, pa.float64())})

    held_out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False))
    found = texts(docs).mapInArrow(score, "doc_id bigint, score double")
    return found.select("doc_id", held_out.alias("held_out"), "score")
