"""Spelling variants: words one edit apart, and the frequent form that each belongs to.

Two words one edit apart share either the first half of the shorter one or the rest of it.
Every word therefore joins a few groups: one for each length class (that of the shorter word
of a pair) and half.  What the words of a group share is cut off, and the rest goes into an
index of bit sets, one bit a word, one set per (position, letter).  For each word, recurrences
over its letters keep, for all words of the group at once, the set that agrees so far (no
error) and the sets with one error (a letter replaced, one too many, one missing), which read
the index at the same, the next and the previous position.

A pair with a common first half is left to the group of that half, so every pair is found
once, and only counts and the best near word of each word leave a group.  Crowded groups are
cut into blocks, and each pair of blocks is a task's work of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.session import materialise, ship_package

RUN = "[a-zÀ-ÿ]+"
GROUP_LIMIT = 16_384
_TEXT_PART = 1 << 20
_KEPT_WORDS = 100_000
_WORD = re.compile(RUN)
_NOT_LETTER = re.compile("[^a-zÀ-ÿ]")
_QUERY, _INDEXED = 1, 2


def _parts(text: bytes) -> Iterator[str]:
    """A text with A-Z lower-cased, in parts cut where no run is cut."""
    if len(text) <= _TEXT_PART:
        yield text.lower().decode("utf-8", "replace")  # ``lower`` of bytes knows A-Z only
        return
    whole, at = text.lower().decode("utf-8", "replace"), 0
    while len(whole) - at > _TEXT_PART:
        gap = _NOT_LETTER.search(whole, at + _TEXT_PART)
        if gap is None:
            break
        yield whole[at : gap.start()]
        at = gap.end()
    yield whole[at:]


def misspelled(run: str, doc_id: bytes, every: int) -> str:
    """The run, without one code point if the CRC-32 of ``<doc_id>:<run>`` is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), doc_id)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, every: int, shortest: int, least: int, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``word`` and ``n`` of words of at least ``shortest`` code points and ``least`` occurrences.

    Words are runs of Latin letters of whole texts with A-Z lower-cased, some misspelled by
    :func:`misspelled` with the row's id (a null id counts as empty).  Null texts have none.
    Each task adds up its words before they are shuffled; other columns are not read.
    """
    ship_package(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                        F.col(text).cast("string").cast("binary").alias("text"))

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                          ["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, body in zip(batch.column("id"), batch.column("text")):
                if not body.is_valid:
                    continue
                start = zlib.crc32(f"{i.as_py()}:".encode())
                for part in _parts(body.as_py()):
                    for word, n in Counter(_WORD.findall(part)).items():
                        word = misspelled(word, start, every)
                        if len(word) >= shortest:
                            held[word] += n
                    if len(held) > _KEPT_WORDS:
                        yield rows(held)
                        held = Counter()
        if held:
            yield rows(held)

    counts = given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


class PositionIndex:
    """Bit sets per (position, letter) over the rests of a group's words, of two lengths."""

    def __init__(self, rests: list[str], short: int, common_start: bool):
        self._short_length, self._common_start = short, common_start
        self._at: list[dict[str, int]] = [{} for _ in range(short + 1)]
        self.all = (1 << len(rests)) - 1
        columns: list[dict[str, list[int]]] = [{} for _ in range(short + 1)]
        longer = []
        for k, rest in enumerate(rests):
            if len(rest) > short:
                longer.append(k)
            for column, letter in zip(columns, rest):
                column.setdefault(letter, []).append(k)
        wide = len(rests) // 8 + 1
        for sets, column in zip(self._at, columns):
            for letter, places in column.items():
                sets[letter] = _bits(places, wide)
        self.long = _bits(longer, wide)
        self.short = self.all ^ self.long

    def near(self, rest: str) -> int:
        """The set of words one edit away (for a group of common ends: those not with a common start)."""
        return self._near_short(rest) if len(rest) == self._short_length else self._near_long(rest)

    def _near_short(self, rest: str) -> int:
        """Words of equal length with one letter replaced, or with one letter more."""
        exact, replaced, extra, at = self.all, 0, 0, self._at
        for i, letter in enumerate(rest):
            here, after = at[i].get(letter, 0), at[i + 1].get(letter, 0)
            extra = (extra | exact) & after
            replaced = replaced & here | exact & ~here
            exact &= here
            if not (exact | replaced | extra):
                return 0
        extra = extra | exact if self._common_start else extra & ~exact
        return replaced & self.short | extra & self.long

    def _near_long(self, rest: str) -> int:
        """Words with one letter less."""
        exact, missing, at, last = self.all & self.short, 0, self._at, len(rest) - 1
        for i in range(last):
            letter = rest[i]
            missing = (missing & at[i - 1].get(letter, 0) if i else 0) | exact
            exact &= at[i].get(letter, 0)
            if not (exact | missing):
                return 0
        missing = (missing & at[last - 1].get(rest[last], 0) if last else 0) | exact
        return (missing if self._common_start else missing & ~exact) & self.short


def _bits(places: list[int], wide: int) -> int:
    out = bytearray(wide)
    for k in places:
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


def _best(found: int, words: list[str], counts: list[int]) -> tuple[int, int, str]:
    """How many words a set holds, and the one of largest count, ties to the smallest word."""
    n, best, name = 0, -1, ""
    while found:
        low = found & -found
        k = low.bit_length() - 1
        found ^= low
        n += 1
        if counts[k] > best or counts[k] == best and words[k] < name:
            best, name = counts[k], words[k]
    return n, best, name


def _groups(words: DataFrame, limit: int) -> DataFrame:
    """Each word in its groups: ``short`` (length of shorter rests), ``start`` (whether the common part is
    at the start), ``key``, block pair, ``role`` and ``rest``."""
    size = F.char_length("word")
    pieces = []
    for less in (0, 1):  # the word as the shorter or equally long one, and as the longer one
        length = size - less
        half = F.floor(length / 2).cast("int")
        tail = length - half
        pieces.append(F.struct(
            length.alias("length"), tail.alias("short"), F.lit(True).alias("start"),
            F.col("word").substr(F.lit(1), half).alias("key"), F.col("word").substr(half + 1, size).alias("rest")))
        pieces.append(F.struct(
            length.alias("length"), half.alias("short"), F.lit(False).alias("start"),
            F.col("word").substr(size - tail + 1, tail).alias("key"),
            F.col("word").substr(F.lit(1), size - tail).alias("rest")))
    member = words.select("word", "n", F.explode(F.array(*pieces)).alias("g")).select("word", "n", "g.*")
    member = member.where("length > 0")
    keys = ["start", "length", "key"]
    sizes = member.groupBy(*keys).agg(F.count("*").alias("size"))
    crowded = sizes.where(F.col("size") > limit).select(*keys, F.ceil(F.col("size") / limit).cast("int").alias("blocks"))
    member = member.join(crowded, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    member = member.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = member.withColumn("other", other)
    asks = F.struct(F.col("own").alias("q"), F.col("other").alias("v"),
                    F.when(F.col("own") == F.col("other"), _QUERY | _INDEXED).otherwise(_QUERY).alias("role"))
    told = F.struct(F.col("other").alias("q"), F.col("own").alias("v"), F.lit(_INDEXED).alias("role"))
    pairs = F.when(F.col("own") == F.col("other"), F.array(asks)).otherwise(F.array(asks, told))
    return member.select(*keys, "short", "rest", "word", "n", F.explode(pairs).alias("pair")).select(
        *keys, "pair.q", "pair.v", "pair.role", "short", "rest", "word", "n")


def near_words(words: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """``word``, ``near`` (how many words are one edit away), ``best_n`` and ``best`` (the near word of
    largest ``n``, ties to the smaller word) of words with at least one.

    ``words`` has distinct, non-null ``word`` and its ``n``.
    """
    ship_package(words.sparkSession)
    keys = ["start", "length", "key", "q", "v"]

    def found(group: list, start: bool, short: int) -> Iterator[tuple]:
        indexed = [(rest, word, n) for role, rest, word, n in group if role & _INDEXED]
        if not indexed:
            return
        rests, names, counts = zip(*indexed)
        index = PositionIndex(list(rests), short, start)
        for role, rest, word, _ in group:
            if role & _QUERY:
                hits = index.near(rest)
                if hits:
                    yield (word, *_best(hits, names, counts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def rows(out: list) -> pa.RecordBatch:
            word, near, n, best = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best)],
                ["word", "near", "best_n", "best"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "short", "role", "rest", "word", "n")]
            for *key, role, rest, word, n in zip(*columns):
                if key != now:
                    if len(group) > 1:
                        out += found(group, now[0], now[5])
                    now, group = key, []
                    if len(out) > 10_000:
                        yield rows(out)
                        out = []
                group.append((role, rest, word, n))
        if len(group) > 1:
            out += found(group, now[0], now[5])
        if out:
            yield rows(out)

    dealt = _groups(words, limit).repartition(*keys).sortWithinPartitions(*keys)
    pairs = dealt.mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return pairs.groupBy("word").agg(F.sum("near").alias("near"), best.alias("first")).select(
        "word", "near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def forms(words: DataFrame, factor: int = 2, limit: int = GROUP_LIMIT) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of a vocabulary.

    ``form`` is the near word of largest ``n`` (ties: smallest by code points), if that is at
    least ``factor`` times the word's own, else null.  ``root`` is where following forms ends;
    counts grow along the way, so there are no circles (``factor`` must be at least 2) and at
    most log2 of the largest count steps.  Roots are handed down step by step: in each step a
    word meets its form, which has few words below it, never all words of a root in one place.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    words = materialise(words.select("word", "n"), "words")
    found = words.join(near_words(words, limit), "word", "left")
    known = F.col("best_n") >= factor * F.col("n")
    table = materialise(found.select(
        "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(known, F.col("best")).alias("form"),
        F.when(known, F.col("best_n")).alias("form_n")), "forms")
    front = table.where("form is null").select("word", F.col("word").alias("root"))
    below = table.where("form is not null").select("word", "form")
    done = front
    while True:
        front = materialise(below.join(front.withColumnRenamed("word", "form"), "form").select("word", "root"), "roots")
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return table.join(done, "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, every: int, shortest: int, least: int, factor: int = 2,
                      limit: int = GROUP_LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`forms` of the :func:`vocabulary` of ``docs``; no words give no rows."""
    return forms(vocabulary(docs, every, shortest, least, doc_id, text), factor, limit)
