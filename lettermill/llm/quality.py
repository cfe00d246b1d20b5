"""Document quality by gradient-boosted trees over document statistics.

Statistics of whole texts are computed by tasks.  The trees are grown on a bounded sample of
labelled documents from histograms of binned statistics, and are then flattened into arrays,
so that a batch of documents goes through all trees with a few numpy steps.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.textmap import filter_texts, held_out, labelled_sample, map_texts
from lettermill.session import materialise

SAMPLE_ROWS = 20_000
STATISTICS = (
    "chars", "words", "word_length", "long_words", "distinct_words", "commonest_word", "commonest_pair",
    "upper", "digits", "signs", "spaces", "other_letters", "pipes", "word_ends", "no_letters", "lines",
    "line_length", "repeated_lines", "repeated_chars", "all_caps", "sentence_ends", "commonest_letter",
    "letter_spread", "links",
)
_WORD = re.compile(r"[^\W\d_]+")
_SIGN_END = re.compile(r"[^\w\s.,;:?!'\")\]]$|[!?.,]{2,}$")
_SAME = re.compile(r"(.)\1{2,}")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all zero for null, empty and blank ones."""
    text = text or ""
    chunks = text.split()
    if not chunks:
        return [0.0] * len(STATISTICS)
    n, w = len(text), len(chunks)
    letters = sum(map(len, _WORD.findall(text)))
    ascii_letters = Counter(text.lower())
    counts = Counter(chunks)
    pairs = Counter(zip(chunks, chunks[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    digits = sum(ascii_letters[d] for d in "0123456789")
    spaces = sum(ascii_letters[s] for s in " \n\t\r")
    plain = sum(ascii_letters[c] for c in "abcdefghijklmnopqrstuvwxyz")
    shares = np.array([v for c, v in ascii_letters.items() if c.isalpha()], float)
    shares = shares / shares.sum() if len(shares) else np.ones(1)
    return [
        float(np.log1p(n)), float(np.log1p(w)), (n - spaces) / w, sum(len(c) > 12 for c in chunks) / w,
        len(counts) / w, max(counts.values()) / w, max(pairs.values(), default=0) / w,
        upper / n, digits / n, (n - letters - digits - spaces) / n, spaces / n, (letters - plain) / n,
        text.count("|") / w, sum(1 for c in chunks if _SIGN_END.search(c)) / w,
        sum(1 for c in chunks if not _WORD.search(c)) / w,
        float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)), sum(len(m[0]) for m in _SAME.finditer(text)) / n,
        sum(1 for c in chunks if len(c) > 1 and c.isupper()) / w,
        sum(1 for c in chunks if c[-1] in ".?!") / w, float(shares.max()),
        float(-(shares * np.log(shares)).sum()), (text.count("http") + text.count("www.")) / w,
    ]


def _table(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(None if t is None else t.decode("utf-8", "replace")) for t in texts], float)


@dataclass
class Trees:
    """All trees in flat arrays: node ``k`` asks whether ``column[k]`` is at most ``limit[k]``
    and goes on at ``left[k]`` or ``right[k]``; leaves point to themselves and hold ``value[k]``."""

    column: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.column[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(_table(texts)), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
         least_rows: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1.  Every level of a tree is grown from one histogram of
    slopes and bends per node, statistic and bin."""
    n, columns = x.shape
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, c], cuts)) if n else np.empty(0) for c in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], axis=1)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(base / (1 - base)))
    margin = np.full(n, start)
    column, limit, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(column)
        column.append(0)
        limit.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(0.0)
        return k

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        where = np.full(n, root)
        level = [root]
        for deep in range(depth + 1):
            spot = {k: i for i, k in enumerate(level)}
            mine = np.array([spot.get(k, -1) for k in range(len(column))])[where]
            inside = mine >= 0
            shape = (len(level), columns, bins)
            flat = (mine[inside, None] * columns + np.arange(columns)) * bins + binned[inside]
            size = int(np.prod(shape))
            hist = [np.bincount(flat.ravel(), np.repeat(v[inside], columns), size).reshape(shape).cumsum(axis=2)
                    for v in (slope, bend, np.ones(n))]
            total = [h[:, :1, -1:] for h in hist]
            fit = [(h[0] ** 2) / (h[1] + ridge) for h in (hist, [t - h for t, h in zip(total, hist)], total)]
            gain = fit[0] + fit[1] - fit[2]
            enough = (hist[2] >= least_rows) & (total[2] - hist[2] >= least_rows)
            gain = np.where(enough, gain, -1.0).reshape(len(level), -1)
            following = []
            for i, k in enumerate(level):
                best = int(gain[i].argmax())
                c, b = divmod(best, bins)
                if deep == depth or gain[i, best] <= 1e-6 or b >= len(edges[c]):
                    value[k] = float(-rate * total[0][i, 0, 0] / (total[1][i, 0, 0] + ridge))
                    continue
                column[k], limit[k] = c, float(edges[c][b])
                left[k], right[k] = node(), node()
                here = where == k
                where = np.where(here, np.where(binned[:, c] <= b, left[k], right[k]), where)
                following += [left[k], right[k]]
            level = following
            if not level:
                break
        margin += np.array(value)[where]
    return Trees(np.array(column, int), np.array(limit, float), np.array(left, int), np.array(right, int),
                 np.array(value, float), np.array(roots, int), depth, start)


def learn(docs: DataFrame, labels: DataFrame, out: Column, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id",
          text: str = "text", **growth) -> Trees:
    """Trees from at most ``rows`` labelled documents for which ``out`` (on ``doc_id`` of
    ``labels``) is false.  Only their statistics, some 25 numbers each, come to the driver.
    Without labelled documents every score is one half."""
    sample = labelled_sample(docs, labels, "quality", rows, out, doc_id, text)
    fields = ", ".join(f"{s} double" for s in STATISTICS)
    measured = materialise(map_texts(sample, lambda texts: list(_table(texts).T), fields,
                                     {"doc_id": F.col("doc_id"), "label": F.col("label")}), "quality-sample")
    got = measured.orderBy("doc_id", *STATISTICS).toPandas()
    return grow(got[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), got["label"].to_numpy(float), **growth)


def score(docs: DataFrame, trees: Trees, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, null and empty texts too."""
    scored = map_texts(docs, lambda texts: [trees.scores(texts)], "score double",
                       {"doc_id": F.col(doc_id), "held_out": held}, text)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_rows(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted to be good, all columns as they are."""
    return filter_texts(docs, lambda texts: trees.scores(texts) >= 0.5, text)


def fold_out(doc_id: str = "doc_id") -> Column:
    return held_out(doc_id, 3, 1)
