"""Toxicity by a weighted lexicon.

Words are folded first: case, compatibility forms, letters of other scripts that look like
Latin ones, and digits or signs set for letters inside a word.  The lexicon holds whole
words and beginnings of words with weights, learned from a bounded sample of labelled
documents; an Aho-Corasick automaton finds all of them in one pass.  Phrases in which a
lexicon word stood in harmless documents only are exceptions and take its weight away
again.  The sum of weights is set against the length of the document, and a logistic curve
fitted on other documents than the lexicon gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.textmap import filter_texts, held_out, labelled_sample, map_texts
from lettermill.llm.wordcache import WordCache

SAMPLE_ROWS = 20_000
LEXICON_SIZE = 3_000
_LEAST_EVIDENCE = 10.0
_LEAST_WEIGHT = 1.5

# Letters that look like a Latin letter (Cyrillic, Greek, others), and digits
# or signs that are written for letters.
LOOKALIKES = dict(zip("авеёзіїјкмнорстухѕԁԛԝһɡɩαβεηικνορτυχωıł", "abee3iijkmhopctyxsdqwhgiabenikvoptuxwil"))
DIGITS = dict(zip("0134578@$!|", "oieastbasii"))

_UNSEEN = re.compile("[­​-‏⁠-⁤﻿]")
_INSIDE = re.compile(r"(?<=[^\W\d_])[\d@$!|]+(?=[^\W\d_])")
_BEFORE = re.compile(r"(?<![^\W_])[\d@$!|]+(?=[^\W\d_]{2})")
_AT_END = re.compile(r"(?<=[^\W\d_])[\d@$]+(?=[^\w@$]*$)")
_MAYBE_AT_END = re.compile(rb"[\d@$][^0-9A-Za-z]*$")
_RUN = re.compile(r"[^\W\d_]+")
_ALIKE = str.maketrans(LOOKALIKES)
_DIGITS = str.maketrans(DIGITS)


def fold(chunk: str, end: bool = False) -> list[str]:
    """The folded words of a text without white space.

    Digits and signs at its end stand for themselves (``room101``, ``the$$$``), with ``end``
    for letters (``worthle55``).
    """
    if not (chunk.isascii() and chunk.isalpha()):
        chunk = unicodedata.normalize("NFKC", _UNSEEN.sub("", chunk))
    word = chunk.lower()
    if not word.isascii():
        latin = word.translate(_ALIKE)
        # a word wholly in another script stays what it is
        if any("a" <= c <= "z" for c in word) or latin.isascii():
            word = latin
    if not word.isalpha():
        for place in (_INSIDE, _BEFORE, _AT_END) if end else (_INSIDE, _BEFORE):
            word = place.sub(lambda m: m[0].translate(_DIGITS), word)
    return _RUN.findall(word)


def _patterns(word: str) -> Iterator[str]:
    """What the lexicon may hold for a word: itself, and its beginnings from four letters on."""
    yield f"^{word}$"
    for n in range(4, min(len(word), 8) + 1):
        yield f"^{word[:n]}"


@dataclass
class Lexicon:
    """Weights of patterns (``^word$`` or ``^beginning``), exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str]] = frozenset()
    curve: tuple[float, ...] = (-10.0, 0.0, 0.0)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve}

    def _start(self) -> None:
        import ahocorasick

        self._find = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            self._find.add_word(pattern, weight)
        if self.weights:
            self._find.make_automaton()
        self._words = WordCache(self._weigh, limit=60_000)

    def _weigh(self, chunks: list[bytes]) -> list[tuple[float, str, str]]:
        """Weight, first and last folded word of each text without white space."""
        out = []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            words = fold(text)
            weight = self._weight(words)
            if _MAYBE_AT_END.search(chunk):
                other = fold(text, end=True)
                if other != words and (more := self._weight(other)) > weight:
                    words, weight = other, more
            out.append((weight, words[0] if words else "", words[-1] if words else ""))
        return out

    def _weight(self, words: list[str]) -> float:
        if not self.weights or not words:
            return 0.0
        ends: dict[int, float] = {}
        for at, found in self._find.iter("".join(f"^{w}$" for w in words)):
            ends[at] = max(found, ends.get(at, 0.0))
        return max(ends.values(), default=0.0) if len(words) == 1 else sum(ends.values())

    def sums(self, texts: list[bytes | None]) -> np.ndarray:
        """Per text: the sum of weights, how many words are hit, the number of words."""
        if not hasattr(self, "_words"):
            self._start()
        split = [(t or b"").split() for t in texts]
        known = self._words.lookup(chain.from_iterable(split))
        out = np.zeros((len(texts), 3))
        for row, chunks in zip(out, split):
            found = [known[c] for c in chunks]
            row[2] = len(found)
            for at, (weight, first, last) in enumerate(found):
                if not weight:
                    continue
                before = found[at - 1][2] if at else ""
                after = found[at + 1][1] if at + 1 < len(found) else ""
                if (before, first) in self.exceptions or (last, after) in self.exceptions:
                    continue
                row[0] += weight
                row[1] += 1
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        x = features(self.sums(texts)) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(sums: np.ndarray) -> np.ndarray:
    """One, the sum of weights per square root of length, and the density of weights."""
    total, words = sums[:, 0], sums[:, 2]
    return np.stack([np.ones(len(sums)), np.log1p(total / np.sqrt(1 + words / 100)),
                     np.log1p(100 * total / (words + 20))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _count_patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents each pattern stands, per task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        record = {"pattern": names, "toxic": [counts[1][n] for n in names], "other": [counts[0][n] for n in names]}
        counts[0].clear()
        counts[1].clear()
        return pa.RecordBatch.from_pydict(record)

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {w for chunk in set((text or "").split()) for w in fold(chunk)}
            counts[label].update({p for w in words for p in _patterns(w)})
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield out()
    yield out()


def _choose(rows: list, size: int) -> dict[str, float]:
    """The best patterns, none of which is the beginning of another one."""
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for row in sorted(rows, key=lambda r: (-r.gain, -len(r.pattern), r.pattern)):
        starts = {row.pattern[:n] for n in range(2, len(row.pattern))}
        if row.pattern in beginnings or not starts.isdisjoint(chosen):
            continue
        chosen[row.pattern] = row.weight
        beginnings |= starts
        if len(chosen) == size:
            break
    return chosen


def learn(docs: DataFrame, labels: DataFrame, out: Column, rows: int = SAMPLE_ROWS, size: int = LEXICON_SIZE,
          doc_id: str = "doc_id", text: str = "text") -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents for which ``out`` (on ``doc_id`` of
    ``labels``) is false.  Without labelled documents it is empty and nothing is toxic."""
    from lettermill.session import materialise

    sample = labelled_sample(docs, labels, "toxic", rows, out, doc_id, text).dropDuplicates(["text"])
    sample = materialise(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3))), "toxic-sample")
    words, rest = sample.where("fold > 0"), sample.where("fold = 0")
    n = {r.label: r.n for r in words.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon()

    counted = words.select("text", "label").mapInArrow(_count_patterns, "pattern string, toxic long, other long")
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    share = (F.col("toxic") + F.col("other")) / float(bad + good)
    gain = 2 * (F.col("toxic") * F.log(a / (share * bad)) + F.col("other") * F.log(b / (share * good)))
    best = (
        counted.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .withColumn("weight", F.log(a / (bad + 1)) - F.log(b / (good + 1)))
        .withColumn("gain", gain)
        .where((F.col("toxic") >= 2) & (F.col("weight") > _LEAST_WEIGHT) & (F.col("gain") > _LEAST_EVIDENCE))
        .orderBy(F.desc("gain"), F.desc(F.length("pattern")), "pattern").limit(10 * size).collect()
    )
    found = Lexicon(_choose(best, size))
    found.exceptions = frozenset(
        (r.first, r.second) for r in words.select("text", "label").mapInArrow(
            _phrase_counter(found), "first string, second string, toxic long, other long")
        .groupBy("first", "second").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where((F.col("toxic") == 0) & (F.col("other") >= 3))
        .orderBy(F.desc("other"), "first", "second").limit(size).collect()
    )
    sums = map_texts(rest, lambda texts: list(found.sums(texts).T), "total double, hits double, words double",
                     {"label": F.col("label")}).collect()  # at most ``rows`` rows of four numbers
    if sums:
        x = features(np.array([[r.total, r.hits, r.words] for r in sums]))
        found.curve = tuple(fit_curve(x, np.array([r.label for r in sums], float)).tolist())
    return found


def _phrase_counter(found: Lexicon):
    """Counts the phrases of two words that hold a lexicon word, by label, per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found._start()
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                chunks = (text or "").encode().split()
                known = found._words.lookup(chunks)
                seen = set()
                for at, chunk in enumerate(chunks):
                    weight, first, last = known[chunk]
                    if weight:
                        if at and (before := known[chunks[at - 1]][2]):
                            seen.add((before, first))
                        if at + 1 < len(chunks) and (after := known[chunks[at + 1]][1]):
                            seen.add((last, after))
                counts[label].update(seen)
        both = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "first": pa.array([p[0] for p in both], pa.string()), "second": pa.array([p[1] for p in both], pa.string()),
            "toxic": pa.array([counts[1][p] for p in both], pa.int64()),
            "other": pa.array([counts[0][p] for p in both], pa.int64())})

    return run


def score(docs: DataFrame, lexicon: Lexicon, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, null and empty texts too."""
    scored = map_texts(docs, lambda texts: [lexicon.scores(texts)], "score double",
                       {"doc_id": F.col(doc_id), "held_out": held}, text)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_rows(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    return filter_texts(docs, lambda texts: lexicon.scores(texts) < 0.5, text)


def fold_out(doc_id: str = "doc_id") -> Column:
    return held_out(doc_id, 5, 0)
