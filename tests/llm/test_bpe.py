import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tables import no_docs, odd_docs
from tokenizers import Tokenizer

from lettermill.llm.bpe import PairRules, PrefixTrie, codec, decode_ids, encode_columns
from lettermill.llm.tokenfile import (
    TokenFileReader,
    TokenFileWriter,
    from_planes,
    read_token_files,
    to_planes,
    write_token_files,
)
from lettermill.llm.wordcache import WordCache
from lettermill.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ΑΣ ΣΣ", "\x85z \x1cq ½ ١٢٣ \x00", "a<|endoftext|>b <|startoftext|>", "can't's '''s !!!...",
       "é ª²µº _a_b x y ­ ŉ ß ﬁ Å", "日本語 👍🏽 ‍", "aaaaaaa " * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    coded = library.encode(text or "", add_special_tokens=False)
    return coded.ids, library.decode(coded.ids, skip_special_tokens=False)


def test_codec_agrees_with_library(library):
    rng = random.Random(5)
    letters = "abcdeéßZ0'.,!\n ́Ñ中"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    coder = codec(PATH)
    for text, ids in zip(texts, coder.encode_batch([t.encode() for t in texts])):
        want, back = plain(library, text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert coder.decode(ids) == back


def test_trie_is_the_merge_order():
    rng = random.Random(3)
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("a", "a"), ("aa", "b"), ("c", "c"), ("bc", "ca")]
    vocabulary = {t: n for n, t in enumerate([*"abc", *(x + y for x, y in merges)])}
    rules = PairRules(vocabulary, merges, "")
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    words += ["abcab" * 30, "abdcé", "d", "", "c"]
    for most in (10**6, 20):  # with and without dropping branches
        trie = PrefixTrie(rules, most)
        for part in (words[::2], words[1::2], words):
            got = trie.encode(set(part))
            for w in set(part):
                known = [c for c in w if c in vocabulary]
                assert list(memoryview(got[w]).cast("I")) == [vocabulary[p] for p in rules.merge(known)], w
    assert trie.nodes <= 20 + 16 * 48 and len(trie._branches) < 9


def test_rules_for_merges_out_of_order():
    merges = [("ab", "c"), ("a", "b"), ("b", "c")]
    vocabulary = {t: n for n, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    rules = PairRules(vocabulary, merges, "")
    assert not rules.ordered and rules.follows("c", "ab")


def test_cache_is_bounded():
    asked = []
    cache = WordCache(lambda ws: asked.extend(ws) or [len(w) for w in ws], limit=4, longest=5)
    for words in (["a", "bb"], ["a", "ccc"], ["dddd", "e"], ["a"], ["much longer"], ["much longer"]):
        assert all(cache.lookup(words)[w] == len(w) for w in words)
    assert len(cache._new) <= 4 and asked.count("much longer") == 2 and asked.count("a") == 1


def test_encode_odd_tables(spark, library):
    docs = odd_docs(spark, ODD)
    got = encode_columns(docs, PATH, ["ids", "ids_sha256", "decoded_sha256", "decoded"], keep=("doc_id", "score"))
    rows = got.join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 7").collect()
    assert got.count() == docs.count() and len(rows) == 7 + len(ODD)
    for r in rows:
        ids, back = plain(library, r.text)
        raw = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.decoded) == (len(ids), raw, back)
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    again = decode_ids(got, PATH).where("doc_id = 1").first()
    assert again.text == plain(library, "one two three four five six")[1]
    assert encode_columns(no_docs(spark), PATH, ["ids"]).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_and_file(tmp_path, kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, np.uint32)
        assert (from_planes(to_planes(ids, kind), n, kind) == ids).all()
    docs = [(k if k != 3 else None, rng.integers(0, 50_000, n, np.uint32)) for k, n in enumerate([5, 0, 300, 1, 64, 2])]
    path = tmp_path / "x.tok"
    with path.open("wb") as out:
        writer = TokenFileWriter(out, kind, block_ids=64)
        for i, ids in docs:
            writer.add(i, ids)
        writer.close()
    with path.open("rb") as stream:
        reader = TokenFileReader(stream, path.stat().st_size)
        starts = np.cumsum(reader.lengths) - reader.lengths
        for k, (i, ids) in reversed(list(enumerate(docs))):
            got = [p for p in reader.pieces(int(starts[k]), len(ids))]
            assert np.concatenate([np.empty(0, np.uint32), *got]).tolist() == ids.tolist()
            assert bool(reader.null_ids[k]) == (i is None) and (i is None or reader.doc_ids[k] == i)
    with path.open("rb") as stream, pytest.raises(ValueError):
        TokenFileReader(stream, path.stat().st_size - 1)


def test_files_of_odd_tables(spark, library):
    docs = odd_docs(spark, ODD)
    folder = scratch_path(spark, "token-test")
    manifest = write_token_files(docs, folder, PATH, end_id=2, kind="bit", block_ids=16)
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: (r.start, r.n_tokens))
    assert sum(r.n_docs for r in manifest.collect()) == len(got) == docs.count()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda i: (i is not None, i or 0))
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            ids = [*plain(library, texts[r.doc_id])[0], 2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    empty = scratch_path(spark, "token-test")
    write_token_files(no_docs(spark), empty, PATH, end_id=2)
    assert read_token_files(spark, empty).count() == 0
