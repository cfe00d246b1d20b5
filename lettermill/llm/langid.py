"""Language by rank order of letter n-grams (Cavnar and Trenkle).

A profile is the list of a language's most frequent n-grams, counted over all training
texts.  A document's most frequent n-grams are compared with each profile: the distance is
the sum of how far each n-gram is out of its place, and the nearest profile wins.

An n-gram of up to three letters is a number, 21 bits for each code point, so counting is
sorting of numbers; ``_`` marks where a word begins and ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.textmap import filter_texts, held_out, map_texts
from lettermill.session import ship_package

PROFILE = 400
NONE = "und"
#: Lowest likeness at which a document may count as being in one of the languages; ``learn``
#: measures the threshold itself, which is higher where languages differ.
LEAST_LIKENESS = 0.15
#: The gap lies between these shares of the likenesses to the best other language and to the own one.
OTHER_BELOW, OWN_BELOW = 0.95, 0.001
_BINS = 1000
_PART = 1 << 20
_LETTERS = regex.compile(r"\p{L}+")
_NOT_LETTER = regex.compile(r"\P{L}")
_GAP = ord("_")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text, as numbers in ascending order, and their counts."""
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    end = 0
    while end < len(text):  # in parts that cut no word
        at, gap = end, _NOT_LETTER.search(text, end + _PART)
        end = gap.start() if gap else len(text)
        words = _LETTERS.findall(text[at:end].lower())
        if not words:
            continue
        c = np.frombuffer(f"_{'_'.join(words)}_".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        gap = c == _GAP
        two, three = c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        found, n = np.unique(np.concatenate([c[~gap], two, three[~gap[1:-1]]]), return_counts=True)
        if not len(grams):
            grams, counts = found, n
        else:
            grams, where = np.unique(np.concatenate([grams, found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
    return grams, counts


def top_grams(text: str, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams; equal counts in the order of their numbers."""
    grams, counts = gram_counts(text)
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        over, tied = counts > least, np.flatnonzero(counts == least)
        over[tied[: size - int(over.sum())]] = True
        grams, counts = grams[over], counts[over]
    return grams[np.argsort(-counts, kind="stable")]


@dataclass
class Profiles:
    """Ranked n-grams of each language; ``size`` is the length of a full profile, ``least`` the
    likeness below which a document is in none of the languages."""

    languages: list[str]
    ranked: list[np.ndarray]
    size: int = PROFILE
    least: float = LEAST_LIKENESS

    def __post_init__(self):
        self.grams = np.unique(np.concatenate(self.ranked)) if self.ranked else np.empty(0, np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, ranked in enumerate(self.ranked):
            self.ranks[np.searchsorted(self.grams, ranked), k] = np.arange(len(ranked))

    def likenesses(self, text: str | None) -> np.ndarray:
        """Likeness to each language: one less the share of the largest distance there can be.

        Empty if there is no letter or nothing was learned.
        """
        top = top_grams(text or "", self.size)
        if not len(top) or not self.languages:
            return np.empty(0)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        ranks = np.where((self.grams[at] == top)[:, None], self.ranks[at], -1)
        own = np.arange(len(top))[:, None]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - own)).sum(axis=0)
        return 1 - distance / (self.size * len(top))

    def guess(self, text: str | None) -> tuple[str, float]:
        """Nearest language and its likeness; equally near languages go by name.

        ``und`` with 0 if there is no letter or nothing was learned.
        """
        found = self.likenesses(text)
        if not len(found):
            return NONE, 0.0
        best = int(np.argmax(found))
        return self.languages[best], float(found[best])


def _count_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams per language; given out whenever many have gathered."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    n_held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            grams, counts = gram_counts(text)
            held.setdefault(lang, []).append((grams, counts))
            n_held += len(grams)
            if n_held > 8_000_000:
                yield from out()
                n_held = 0
    yield from out()


def _likeness_counter(profiles: Profiles):
    """Counts of likenesses to the own and to the best other language, in bins, per task.

    A row nearer to another language than to its own says nothing about either.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _BINS + 1), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found = profiles.likenesses(text)
                if not len(found) or profiles.languages[best := int(np.argmax(found))] != lang:
                    continue
                counts[0, int(found[best] * _BINS)] += 1
                if len(found) > 1:
                    counts[1, int(np.delete(found, best).max() * _BINS)] += 1
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "other": pa.array(kind, pa.int32()), "bin": pa.array(at, pa.int32()), "n": pa.array(counts[kind, at])})

    return run


def gap(own: np.ndarray, other: np.ndarray) -> float:
    """Threshold from counts of likenesses in bins: the middle between nearly all likenesses to
    the best other language and nearly all to the own one.

    Where they overlap, next to no row of its own language may fall below.  The gap begins at
    ``LEAST_LIKENESS`` if there is one language only.
    """
    if not own.sum():
        return LEAST_LIKENESS
    low = int(np.searchsorted(np.cumsum(own), OWN_BELOW * own.sum(), "right")) / _BINS
    high = LEAST_LIKENESS
    if other.sum():
        high = (int(np.searchsorted(np.cumsum(other), OTHER_BELOW * other.sum())) + 1) / _BINS
    return max(LEAST_LIKENESS, min(low, (low + high) / 2))


def learn(docs: DataFrame, size: int = PROFILE, text: str = "text", lang: str = "lang",
          threshold: bool = True) -> Profiles:
    """Profiles of all languages of ``docs``, over all its rows that have a text and a language.

    With ``threshold``, the same rows are read again to measure ``least``.  What comes to the
    driver is ``size`` numbers for each language and the likenesses' counts in bins: the
    languages of ``lang`` must be few (thousands at most), as each becomes a profile that
    every document is compared with.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    languages = sorted(profiles)
    found = Profiles(languages, [np.array(profiles[k], np.int64) for k in languages], size)
    if threshold and languages:
        counts = np.zeros((2, _BINS + 1), np.int64)
        binned = rows.mapInArrow(_likeness_counter(found), "other int, bin int, n long")
        for row in binned.groupBy("other", "bin").agg(F.sum("n").alias("n")).collect():
            counts[row.other, row.bin] = row.n
        found.least = gap(*counts)
    return found


def _guesses(profiles: Profiles, texts: list[bytes | None]) -> list[tuple[str, float]]:
    return [profiles.guess(None if t is None else t.decode("utf-8", "replace")) for t in texts]


def predict(docs: DataFrame, profiles: Profiles, held, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    return map_texts(docs, lambda texts: [list(x) for x in zip(*_guesses(profiles, texts))],
                     "lang_pred string, score double", {"doc_id": F.col(doc_id), "held_out": held}, text)


def known_rows(docs: DataFrame, profiles: Profiles, least: float | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in one of the languages: not ``und``, and not too far from all profiles.

    ``least`` is that of the profiles if not given.  If nothing was learned, every text with
    a letter stays.
    """
    least = profiles.least if least is None else least
    if not profiles.languages:
        return filter_texts(docs, lambda texts: [
            bool(t) and _LETTERS.search(t.decode("utf-8", "replace")) is not None for t in texts], text)
    return filter_texts(docs, lambda texts: [k != NONE and s >= least for k, s in _guesses(profiles, texts)], text)


def fold_out(doc_id: str = "doc_id"):
    return held_out(doc_id, 4, 2)
