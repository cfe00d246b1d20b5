"""BPE encoding and decoding over a trie of distinct words.

The encoding of a text is the encodings of its words one after another.  Words share
prefixes, and for byte pair encoding the last token of a prefix does not depend on what
follows: it is the longest token that ends the prefix and may follow the last token of what
stands before it.  New words go into a trie in sorted order, so the walk goes through it depth
first; it finds the last token of every new node from those of its ancestors.  A shared prefix
is worked out once, and a word's encoding is read backwards from its node.

Each node also holds its state in an automaton of the vocabulary, which names the tokens that
end there: no other beginnings are tried.  The trie is kept from batch to batch, and its
oldest branches (words with the same first two symbols) are dropped when it grows too large.

No text is shuffled: texts are encoded where they are read.  Python workers keep the trie and a
bounded cache of what stands between white space.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.textmap import text_parts
from lettermill.llm.wordcache import WordCache
from lettermill.session import ship_package

_NODES = 400_000
_LONGEST = 48
_PAIRS = 300_000
_PLAIN_CODES = 512
_SIGNS = b".,;:!?"
# the end of a split pattern: runs of letters, single digits, runs of other signs
_LETTERS_ALONE = "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Latin letters, digits and marks that are the same in every normal form; nothing unseen
_PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u017f]+")


class PairRules:
    """Which token may follow which.

    Merging the symbols of both must give both again.  Merges are made in the order of
    their ranks, so it is enough to walk up the right edge of the first token and the left
    edge of the second and to see whether a merge across the border is ever the next one.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Iterable, end: str):
        self.ids, self.end = vocabulary, end
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(merges)}
        self._made = {a + b: (a, b) for a, b in self.rank}
        self._edges: dict[tuple[str, bool], list[tuple[str, int]]] = {}
        of = {t: self.rank[p] for t, p in self._made.items()}
        self.ordered = len(of) == len(self.rank) and all(
            of.get(a, -1) < r and of.get(b, -1) < r for (a, b), r in self.rank.items())
        # tokens that are the encoding of their own symbols
        self.usable = {t for t in vocabulary if self.merge(self.symbols(t)) == [t]}

    def symbols(self, token: str) -> list[str]:
        """Characters; the end mark belongs to the character before it."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """The definition of the encoding: join the pair of lowest rank, leftmost first."""
        parts = list(parts)
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """Parts at one edge of a token from symbol to token, each with the rank that consumes it."""
        known = self._edges.get((token, right))
        if known is None:
            known, up = [], len(self.rank)
            part = token
            while True:
                known.append((part, up))
                pair = self._made.get(part)
                if pair is None:
                    break
                part, up = pair[right], self.rank[pair]
            known.reverse()
            self._edges[token, right] = known
        return known

    def follows(self, before: str, token: str) -> bool:
        if not self.ordered:
            return self.merge(self.symbols(before) + self.symbols(token)) == [before, token]
        left, right, rank = self._edge(before, True), self._edge(token, False), self.rank
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            across = rank.get((a, b))
            # a merge to the left of an equal one comes first
            if across is not None and across < a_ends and across <= b_ends:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1



class Endings:
    """An automaton over the symbols of all tokens: which tokens a run of symbols ends with."""

    def __init__(self, rules: PairRules):
        symbols = {t: rules.symbols(t) for t in rules.usable}
        alphabet = sorted({s for given in symbols.values() for s in given if s in rules.ids})
        self.codes = {s: k for k, s in enumerate(alphabet)}
        self.width = max(len(self.codes), 1)
        self._next: dict[int, int] = {}
        parent, code, depth, own = [0], [0], [0], [()]
        for token, given in symbols.items():
            state = 0
            for c in map(self.codes.get, given):
                if c is None:
                    break  # such a symbol is never given
                key = state * self.width + c
                state = self._next.get(key)
                if state is None:
                    state = self._next[key] = len(parent)
                    parent.append(key // self.width)
                    code.append(c)
                    depth.append(depth[parent[-1]] + 1)
                    own.append(())
            else:
                own[state] = ((len(given), rules.ids[token]),)
        #: (number of symbols, token) of the tokens that end in a state, longest first
        self.tokens: list[tuple[tuple[int, int], ...]] = own
        self._back = array("i", [0]) * len(parent)
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            if parent[state]:
                self._back[state] = self.step(self._back[parent[state]], code[state])
            shorter = own[self._back[state]]
            own[state] = own[state] + shorter if own[state] else shorter

    def step(self, state: int, code: int) -> int:
        while True:
            after = self._next.get(state * self.width + code)
            if after is not None:
                return after
            if not state:
                return 0
            state = self._back[state]


class PrefixTrie:
    """Encodes words; see the head of this module."""

    def __init__(self, rules: PairRules, most_nodes: int = _NODES):
        self._rules, self._most = rules, most_nodes
        self._endings = Endings(rules)
        self._fits: dict[int, bool] = {}
        self._many = max(rules.ids.values(), default=0) + 1
        self._branches: dict[int, tuple] = {}
        self._letters, self._ends = self._tables()
        self.nodes = 0

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of characters below 512 inside a word and at its end; -1 where there is none."""
        known, end = self._endings.codes, self._rules.end
        return tuple(np.array([known.get(chr(c) + mark, -1) for c in range(_PLAIN_CODES)], np.int32)
                     for mark in ("", end))

    def _branch(self) -> tuple:
        """Children, last token, how many symbols it spans, and state of each node; node 0 is empty."""
        return {}, array("I", [0]), array("I", [0]), array("I", [0])

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids of distinct words as little-endian unsigned 32-bit integers; symbols outside
        the vocabulary are dropped, and words of many symbols are not kept."""
        words, out = sorted(words), {}
        plain = [w for w in words if 1 < len(w) <= _LONGEST and ord(max(w)) < _PLAIN_CODES]
        if plain:
            self._walk_sorted(plain, out)
        if len(out) < len(words):
            end, known = self._rules.end, self._endings.codes
            for word in words:
                if word not in out:
                    symbols = [*word[:-1], word[-1] + end] if word else []
                    out[word] = self._walk(self._branch(), [known[x] for x in symbols if x in known])
        return out

    def _walk_sorted(self, words: list[str], out: dict[str, bytes]) -> None:
        """Depth first: what a word shares with the one before it is not walked again."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(lengths.max())
        letters = np.array(words, f"U{wide}").view(np.uint32).reshape(len(words), wide)
        codes = self._letters[letters]
        codes[np.arange(len(words)), lengths - 1] = self._ends[letters[np.arange(len(words)), lengths - 1]]
        inside = np.arange(wide) < lengths[:, None]
        strange = ((codes < 0) & inside).any(axis=1)
        codes[~inside] = -2
        same = np.zeros(len(words), np.int64)
        if len(words) > 1:
            equal = codes[1:] == codes[:-1]
            same[1:] = np.where(equal.all(axis=1), wide, equal.argmin(axis=1))
        width, path, branch, key = self._endings.width, [0], None, None
        for word, row, n, shared, skip in zip(words, codes.tolist(), lengths.tolist(), same.tolist(), strange.tolist()):
            if skip:
                path, key = [0], None
                continue
            now = row[0] * width + row[1]
            if now != key:
                key, path = now, [0]
                branch = self._branches.get(key)
                if branch is None:
                    self._make_room()
                    branch = self._branches[key] = self._branch()
            else:
                del path[min(shared, n) + 1 :]
            before = len(branch[1])
            out[word] = self._walk(branch, row[:n], path)
            self.nodes += len(branch[1]) - before

    def _make_room(self) -> None:
        while self.nodes > self._most:
            oldest = next(iter(self._branches))
            self.nodes -= len(self._branches.pop(oldest)[1]) - 1

    def _walk(self, branch: tuple, codes: list[int], path: list[int] | None = None) -> bytes:
        """Ids of a word, of whose nodes ``path`` has the first ones; adds the others to it."""
        children, last, span, state = branch
        path = [0] if path is None else path
        width, node, depth = self._endings.width, path[-1], len(path) - 1
        for code in codes[depth:]:
            depth += 1
            key = node * width + code
            below = children.get(key)
            if below is None:
                ending = self._endings.step(state[node], code)
                for length, token in self._endings.tokens[ending]:
                    if length == depth or self._follows(last[path[depth - length]], token):
                        break
                else:
                    raise ValueError(f"no token can end {codes[:depth]}")
                below = children[key] = len(last)
                last.append(token)
                span.append(length)
                state.append(ending)
            node = below
            path.append(node)
        back = array("I")
        while depth:
            node = path[depth]
            back.append(last[node])
            depth -= span[node]
        back.reverse()
        return back.tobytes()

    def _follows(self, before: int, token: int) -> bool:
        key = before * self._many + token
        fits = self._fits.get(key)
        if fits is None:
            if len(self._fits) > _PAIRS:
                self._fits.clear()
            names = self._rules.tokens
            fits = self._fits[key] = self._rules.follows(names[before], names[token])
        return fits


class Codec:
    """One tokenizer file.

    Normalising and splitting treat what stands between white space on its own, so its
    encoding can be cached.  Text of Latin letters in the usual form only needs lower case
    and the split pattern; for the rest the library's own normaliser and splitter are used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"not a BPE tokenizer: {path}")
        self._library = Tokenizer.from_file(path)
        self._rules = PairRules(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = self._rules.tokens | {i: s for s, i in self._special.items()}
        marks = sorted(self._special, key=len, reverse=True)
        self._marks = re.compile(f"({'|'.join(map(re.escape, marks))})") if marks else None
        self._split = _plain_split(spec)
        # letters, and letters before one sign, are split in the same way whatever they are
        self._alone = self._split is not None and self._split.pattern.endswith(_LETTERS_ALONE) and all(
            a.startswith("'") for a in self._split.pattern.removesuffix(_LETTERS_ALONE).split("|")) and not any(
            re.fullmatch("[A-Za-z]+[.,;:!?]?", m) for m in marks)
        self._letters = _byte_letters()
        self._cache = WordCache(self._encode_chunks)
        self._trie: PrefixTrie | None = None

    def _encode_words(self, words: set[str]) -> dict[str, bytes]:
        if self._trie is None:
            self._trie = PrefixTrie(self._rules)
        return self._trie.encode(words)

    def _pieces(self, text: str) -> list[str]:
        """Words of a text without special marks, in the letters that stand for bytes."""
        if self._split and _PLAIN.fullmatch(text):
            words = self._split.findall(text.lower())
            return [w if w.isascii() else w.encode().decode("latin-1").translate(self._letters) for w in words]
        text = self._library.normalizer.normalize_str(text)
        return [word for word, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids as little-endian bytes of texts without white space."""
        plan: list[list] = []
        for chunk in chunks:
            if self._alone and chunk.isalpha():  # of bytes: ASCII letters
                plan.append([chunk.lower().decode()])
                continue
            if self._alone and chunk[-1] in _SIGNS and chunk[:-1].isalpha():
                plan.append([chunk[:-1].lower().decode(), chr(chunk[-1])])
                continue
            text = chunk.decode("utf-8", "replace")
            parts: list = []
            for piece in self._marks.split(text) if self._marks else [text]:
                if piece in self._special:  # found before anything is normalised
                    parts.append(self._special[piece])
                elif piece:
                    parts += self._pieces(piece)
            plan.append(parts)
        known = self._encode_words({p for parts in plan for p in parts if isinstance(p, str)})
        return [b"".join([known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts])
                for parts in plan]

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [text.split() for text in texts]
        gc.disable()  # tries and caches are large and hold no cycles
        try:
            known = self._cache.lookup(chain.from_iterable(split))
        finally:
            gc.enable()
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does it."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in memoryview(ids).cast("I")])


def _plain_split(spec: dict):
    """The split pattern, if the file normalises and splits in the way that :class:`Codec`
    knows a short cut for; else ``None``, and the library does all of it."""
    import regex

    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"]
    if not plain or not before[0].get("invert") or before[0]["behavior"] != "Removed" or before[1]["add_prefix_space"]:
        return None
    return regex.compile(before[0]["pattern"]["Regex"])


def _byte_letters() -> dict[int, int]:
    """Which character stands for which byte: itself if it can be seen, else one from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    unseen = (b for b in range(256) if b not in seen)
    return {b: 256 + n for n, b in enumerate(unseen)}


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """Kept by the Python worker from task to task."""
    return Codec(path)


_KINDS = {"ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_columns(docs: DataFrame, tokenizer: str, out: list[str], text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``n_tokens`` and those of ``out``: ``ids`` (little-endian unsigned
    32-bit), ``decoded`` (the text that decoding them gives), and SHA-256 of either.

    Every row gives one row, repeated ones too.  A null or empty text has no ids and
    decodes to the empty text; other columns of ``docs`` are not read.
    """
    ship_package(docs.sparkSession)
    given = docs.select(*keep, _bytes(text).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens bigint", *(f"{o} {_KINDS[o]}" for o in out)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            for start, texts in text_parts(batch.column("_text")):
                coded = coder.encode_batch([t or b"" for t in texts])
                columns = [batch.column(k).slice(start, len(coded)) for k in keep]
                columns.append(pa.array([len(c) // 4 for c in coded], pa.int64()))
                made = {o: [] for o in out}
                for ids in coded:
                    back = coder.decode(ids) if "decoded" in made or "decoded_sha256" in made else ""
                    for o, values in made.items():
                        values.append(ids if o == "ids" else back if o == "decoded" else hashlib.sha256(
                            ids if o == "ids_sha256" else back.encode()).hexdigest())
                columns += [pa.array(made[o], pa.binary() if o == "ids" else pa.string()) for o in out]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", *out])

    return given.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, tokenizer: str, text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """SHA-256 of ids and decoded texts, without these."""
    return encode_columns(docs, tokenizer, ["ids_sha256", "decoded_sha256"], text, keep)


def decode_ids(coded: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the text of ids as :func:`encode_columns` gives them; null ids give null."""
    ship_package(coded.sparkSession)
    given = coded.select(*keep, F.col(ids).alias("_ids"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())],
                                             [*keep, "text"])

    return given.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string"]))


def _bytes(text: str) -> Column:
    return F.col(text).cast("string").cast("binary")
