import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import no_docs, odd_docs

import __spark_entry__ as entry
from lettermill.llm import langid, quality, toxicity
from lettermill.llm.textmap import held_out, labelled_sample

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    return got, got.merge(labels, on="doc_id")


def rank_quality(labels, scores):
    """How often a row of label 1 scores above one of label 0."""
    ones, zeros = scores[labels == 1], scores[labels == 0]
    return (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2


@pytest.mark.parametrize("word, folded", [
    ("Idiot!", ["idiot"]), ("1d10t", ["idiot"]), ("ｍoron", ["moron"]), ("mоrоn", ["moron"]), ("tr@sh", ["trash"]),
    ("st​upid", ["stupid"]), ("the$$$", ["the"]), ("2024", []), ("привет", ["привет"]), ("a-b", ["a", "b"]),
    ("10th", ["ioth"]), ("3", []), ("été", ["été"])])
def test_fold(word, folded):
    assert toxicity.fold(word) == folded


def test_lexicon_by_hand():
    lexicon = toxicity.Lexicon({"^idiot$": 3.0, "^mor": 2.0, "^moron$": 5.0}, frozenset({("useful", "idiot")}), (-3, 2, 2))
    sums = lexicon.sums([b"you idiot", b"a useful idiot here", b"M0R0N morals, amoral", None, b"", b"idiotic"])
    assert sums[:, 0].tolist() == [3, 0, 7, 0, 0, 0] and sums[:, 2].tolist() == [2, 4, 3, 0, 0, 1]
    scores = lexicon.scores([b"you idiot", b"a useful idiot here", b"idiot " + b"fine words " * 5000])
    assert scores[0] > 0.5 > scores[2] >= scores[1]  # diluted by length


def test_toxicity_on_held_out_rows(spark):
    got, known = labelled(spark, "/root/testdata/sf0.1", "op4_toxicity")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    out = known[known.held_out]
    assert rank_quality(out.toxic.to_numpy(), out.score.to_numpy()) > 0.93
    assert (out.predicted[out.toxic == 0] == 1).mean() < 0.01
    assert (out.predicted[out.toxic == 1] == 1).mean() > 0.75
    assert ((got.score >= 0.5).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = entry.queries()["op5_language"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    out = got[got.held_out]
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.99 and got.score.between(0, 1).all()


def test_quality_on_held_out_rows(spark):
    got, known = labelled(spark, SF, "op6_quality")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    out = known[known.held_out]
    assert (out.predicted == out.quality).mean() > 0.97 and got.score.between(0, 1).all()


def test_grams_by_hand(monkeypatch):
    def number(gram):
        return sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))

    want = {}
    for word in ("ab", "abé"):
        padded = f"_{word}_"
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                if padded[k : k + n] != "_":
                    want[number(padded[k : k + n])] = want.get(number(padded[k : k + n]), 0) + 1
    grams, counts = langid.gram_counts("AB, 12 Abé!")
    assert dict(zip(grams.tolist(), counts.tolist())) == want
    text = "some words to count " * 40
    whole = [x.tolist() for x in langid.gram_counts(text)]
    monkeypatch.setattr(langid, "_PART", 60)  # a multiple of the repeated text: words are not cut
    assert [x.tolist() for x in langid.gram_counts(text)] == whole


def test_profiles_by_plain_ranks():
    texts = {"x": "aa ab aa ac", "y": "zz zy zz xx"}
    profiles = langid.Profiles(list(texts), [langid.top_grams(t, 8) for t in texts.values()], 8)
    for text in ("aa ab", "zz", "qq", "aa zz zz"):
        top = langid.top_grams(text, 8).tolist()
        far = {k: sum(abs(i - (r := langid.top_grams(t, 8).tolist()).index(g)) if g in langid.top_grams(t, 8).tolist()
                      else 8 for i, g in enumerate(top)) for k, t in texts.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert profiles.guess(text) == (best, pytest.approx(1 - far[best] / (8 * len(top))))
    assert profiles.guess("12 !") == profiles.guess(None) == ("und", 0.0)


def test_trees_agree_with_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grow(x, y, trees=40, depth=3)
    margins = trees.margins(x)
    for row, margin in zip(x[:30], margins):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = (trees.left if row[trees.column[node]] <= trees.limit[node] else trees.right)[node]
            total += trees.value[node]
        assert margin == pytest.approx(total)
    assert ((margins > 0) == (y == 1)).mean() > 0.97
    assert quality.grow(np.empty((0, 4)), np.empty(0)).margins(x).tolist() == [0.0] * 600


def test_statistics_of_odd_texts():
    for text in (None, "", " \n"):
        assert quality.statistics(text) == [0.0] * len(quality.STATISTICS)
    for text in ("x", "!!", "\n\nABC\n", "1 2 3", "é" * 5000):
        values = quality.statistics(text)
        assert len(values) == len(quality.STATISTICS) and np.isfinite(values).all()


def test_odd_tables(spark):
    docs, never = odd_docs(spark), held_out("doc_id", 5, 0)
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 0, 0), (None, 1, 1), (3, None, None), (99, 1, 1)], LABELS)
    for table in (docs, no_docs(spark)):
        for labels in (none, some):
            lexicon = toxicity.learn(table, labels, never)
            trees = quality.learn(table, labels, never, trees=3, least_rows=1)
            for got in (toxicity.score(table, lexicon, never), quality.score(table, trees, never)):
                assert got.columns == ["doc_id", "held_out", "score", "predicted"]
                assert got.count() == table.count() and got.where("score is null or held_out is null").count() == 0
            kept = toxicity.clean_rows(table, lexicon)
            assert kept.columns == table.columns and kept.count() <= table.count()
            assert quality.good_rows(table, trees).columns == table.columns
        profiles = langid.learn(table)
        got = langid.predict(table, profiles, never)
        assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == table.count()
        kept = langid.known_rows(table, profiles)
        assert kept.columns == table.columns
        assert kept.where("text is null or trim(text) = ''").count() == 0
    profiles = langid.learn(docs.where(F.lit(False)))
    assert langid.known_rows(docs, profiles).count() == docs.where("text rlike '\\\\p{L}'").count()


@pytest.mark.parametrize("word, folded", [
    ("worthle55", ["worthless"]), ("idio7.", ["idiot"]), ("the$$$", ["thesss"]), ("2024", []), ("room101", ["roomioi"])])
def test_fold_with_end(word, folded):
    assert toxicity.fold(word, end=True) == folded


def test_digits_at_the_end_count_if_that_weighs_more():
    lexicon = toxicity.Lexicon({"^idiot$": 3.0, "^worthless$": 2.0, "^room$": 1.0}, frozenset(), (-3, 2, 2))
    texts = [b"idio7", b"worthle55!", b"the$$$ room101", b"worthle5 s"]
    assert lexicon.sums(texts)[:, 0].tolist() == [3, 2, 1, 0]


def test_automaton_agrees_with_naive_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.fold_out())
    texts = [r.text for r in docs.collect()]
    assert len(lexicon.weights) > 3

    def weigh(words):
        marked = "".join(f"^{w}$" for w in words)
        ends = {}
        for pattern, weight in lexicon.weights.items():
            at = marked.find(pattern)
            while at >= 0:
                ends[at + len(pattern)] = max(weight, ends.get(at + len(pattern), 0.0))
                at = marked.find(pattern, at + 1)
        return max(ends.values(), default=0.0) if len(words) == 1 else sum(ends.values())

    seen = {}
    for text in texts:
        total, hits, words = 0.0, 0, text.split()
        for word in words:
            if word not in seen:
                forms = [toxicity.fold(word), toxicity.fold(word, end=True)]
                weights = [weigh(f) for f in forms]
                best = int(weights[1] > weights[0])
                seen[word] = weights[best], forms[best][0] if forms[best] else "", forms[best][-1] if forms[best] else ""
        for at, word in enumerate(words):
            weight, first, last = seen[word]
            before = seen[words[at - 1]][2] if at else ""
            after = seen[words[at + 1]][1] if at + 1 < len(words) else ""
            if weight and (before, first) not in lexicon.exceptions and (last, after) not in lexicon.exceptions:
                total, hits = total + weight, hits + 1
        got = lexicon.sums([text.encode()])[0]
        assert np.allclose(got, [total, hits, len(words)]), text[:80]


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.range(5_000).selectExpr("1L as doc_id", "concat('text ', id) as text").union(
        spark.range(2, 50).selectExpr("id as doc_id", "null as text"))
    labels = spark.range(1, 50).selectExpr("id as doc_id", "1 as toxic")
    got = labelled_sample(docs, labels, "toxic", 10, F.lit(False)).collect()
    assert len(got) == 10 and len({r.doc_id for r in got}) == 10
    everything = labelled_sample(docs, labels, "toxic", 1000, F.lit(False)).collect()
    assert sorted(r.doc_id for r in everything) == list(range(1, 50))


def test_texts_without_letters_have_no_language():
    profiles = langid.Profiles(["de"], [langid.top_grams("wort um wort", 10)], 10)
    for text in ("½ ² ① Ⅷ", "123 _ !", "", None, "́"):
        assert profiles.guess(text) == ("und", 0.0)
    assert profiles.guess("ª")[0] == "de"


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "several words1of different-length und ÄÖÜ " * 30 + "x" * 500
    whole = [x.tolist() for x in langid.gram_counts(text)]
    for part in (1, 7, 50, 333):
        monkeypatch.setattr(langid, "_PART", part)
        assert [x.tolist() for x in langid.gram_counts(text)] == whole
