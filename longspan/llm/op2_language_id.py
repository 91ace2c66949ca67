"""Language ID by rank-order profiles of letter n-grams.

A text is lower-cased and everything but letters parts words; words carry a blank on both sides. A
profile is the list of the `top` most frequent 1- to 3-grams within words, most frequent first. A
document's profile is held against each language's: every n-gram costs the difference of its two
places, or `top` if the language lacks it, and the language with the smallest sum wins. The score
is 1 minus that sum over the largest possible one.

Profiles of languages are counted over learned-from rows: all of a language that has at most
`docs_per_language`, else about that many, chosen by a hash of doc_id. Of the counts only the
leading n-grams of each language reach the driver. Documents themselves are read whole.

Defined cases: a null text and one without a letter are `und` with score 0, as is every text if
nothing can be learned. Ties go to the language that sorts first. Rows with a null doc_id or lang
are not learned from, and a null doc_id is not held out. Repeated rows each give a row, other
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from longspan.llm.batches import slices, texts

TOP = 300
#: A text that scores less is in none of the learned languages. Rows of a learned language score 0.35
#: or more on the given tables; with their own language left out of the profiles, half score under
#: 0.27 (texts under 100 bytes score higher and cannot be told).
LEAST_SCORE = 0.33
UNKNOWN = "und"
#: Code points handled at a time, so that a very long text needs little memory.
PIECE = 1 << 18
BLANK = 32


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1- to 3-grams of a text, 21 bits a letter, and their counts."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return _merged([], [])
    # One blank for each run of other characters, one before and one behind the text.
    keep = letter | np.concatenate([[False], letter[:-1]])
    line = np.concatenate([[BLANK], np.where(letter, points, BLANK)[keep], [BLANK]]).astype(np.int64)
    codes, counts = [], []
    for k in range(0, len(line), PIECE):
        one = line[k : k + PIECE]
        two = line[k : k + PIECE + 1]
        three = line[k : k + PIECE + 2]
        pairs, middle = two[:-1] << 21 | two[1:], three[1:-1]
        triples = three[:-2] << 42 | middle << 21 | three[2:]
        lot = [one[one != BLANK], pairs[(two[:-1] != BLANK) | (two[1:] != BLANK)], triples[middle != BLANK]]
        distinct, n = np.unique(np.concatenate(lot), return_counts=True)
        codes.append(distinct)
        counts.append(n)
    return (codes[0], counts[0]) if len(codes) == 1 else _merged(codes, counts)


def leading(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes; ties by code."""
    if len(codes) > top:
        edge = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= edge
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))[:top]]


class Profiles:
    """Ranked n-grams by language."""

    def __init__(self, ranked: dict[str, list[int]], top: int):
        self.top, self.languages = top, sorted(ranked)
        self.tables = []
        for language in self.languages:
            codes = np.array(ranked[language], np.int64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        own = leading(*grams(text), self.top)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        ranks, sums = np.arange(len(own)), []
        for codes, places in self.tables:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            cost = np.where(codes[at] == own, np.abs(places[at] - ranks), self.top)
            sums.append(int(np.minimum(cost, self.top).sum()))
        best = int(np.argmin(sums))
        return self.languages[best], 1.0 - sums[best] / (self.top * len(own))


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by))


def fit_profiles(docs: DataFrame, folds: int = 5, docs_per_language: int = 5000, top: int = TOP) -> Profiles:
    """Learn from rows with a lang whose fold is not 0."""
    rows = docs.where((remainder("doc_id", folds) != 0) & F.col("lang").isNotNull())
    share = F.lit(float(docs_per_language)) / F.count("*")
    # One row for each language.
    shares = rows.groupBy("lang").agg(share.alias("_share"))
    spot = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(2)), 11) / float(1 << 53)
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").where(spot < F.col("_share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in slices(batches):
            lots: dict[str, list] = {}
            for text, language in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lots.setdefault(language, []).append(grams(text))
            for language, found in lots.items():
                if language in sums:
                    found.append(sums[language])
                sums[language] = _merged([c for c, _ in found], [n for _, n in found])
        for language, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [language] * len(codes), "code": codes, "n": counts})

    counted = texts(chosen, "lang").mapInArrow(count, "lang string, code bigint, n bigint")
    sums = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in ranked.toLocalIterator():
        found.setdefault(row.lang, []).append((row["rank"], row.code))
    return Profiles({k: [c for _, c in sorted(v)] for k, v in found.items()}, top)


def _predicted(rows: DataFrame, profiles: Profiles, keep: str, kind: str, within: str | None = None) -> DataFrame:
    """The column `keep`, lang_pred and score of rows with the columns `keep` and text (binary), or whose
    text is the field `within` of the struct `keep`, so that it is sent once."""
    sent = rows.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lot = pc.struct_field(part.column(keep), within).cast(pa.binary()) if within else part.column("text")
            found = [sent.value.predict(t) for t in lot.to_pylist()]
            languages, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(keep), languages, scores], [keep, "lang_pred", "score"])

    return rows.mapInArrow(predict, f"{keep} {kind}, lang_pred string, score double")


def language_id(docs: DataFrame, profiles: Profiles | None = None, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row. Profiles are learned unless given."""
    found = _predicted(texts(docs), profiles or fit_profiles(docs, folds), "doc_id", "bigint")
    held = F.coalesce(remainder("doc_id", folds) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, least_score: float = LEAST_SCORE, profiles: Profiles | None = None, folds: int = 5) -> DataFrame:
    """The rows, as they are, whose language is known with at least that score."""
    packed = docs.select(F.struct("*").alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    within = docs.select("text").columns[0]
    found = _predicted(packed, profiles or fit_profiles(docs, folds), "row", kind, within)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
