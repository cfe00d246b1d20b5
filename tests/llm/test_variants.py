import random
import re
import zlib
from collections import Counter

import pytest
from tables import no_docs, odd_docs

import __spark_entry__ as entry
from lettermill.llm.variants import PositionIndex, forms, near_words, spelling_variants, vocabulary

SF = "/root/testdata/sf0.001"
_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows, every, shortest, least):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_near(words):
    """Neighbours by writing out all words without one letter, and with a hole."""
    holes = {}
    for w in words:
        holes.setdefault(w, set()).add(w)
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
            holes.setdefault(w[:k] + "\0" + w[k + 1 :], set()).add(w)
    near = {w: set() for w in words}
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b != a and is_near(a, b)}
    return near


def plain_forms(words, factor=2):
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def rows_of(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def test_query_agrees_with_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_forms(plain_words(docs, 97, 5, 3))
    got = rows_of(entry.queries()["op12_spelling_variants"](spark, SF))
    assert got == want and len({r[2] for r in got}) < len(got)
    assert any(r[2] != r[1] and r[1] for r in got)  # chains


@pytest.mark.parametrize("limit", [16_384, 5])
def test_dense_words_with_runs_of_letters(spark, limit):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.randint(1, 40) for _ in range(400)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    near = plain_near(words)
    got = {r.word: (r.near, r.best_n, r.best) for r in near_words(table, limit).collect()}
    for w in words:
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        assert got.get(w) == (None if best is None else (len(near[w]), words[best], best)), w
    if limit > 5:
        assert rows_of(forms(table, limit=limit)) == plain_forms(words)


def test_index_against_pairs():
    rng = random.Random(4)
    for start in (True, False):
        for short in (1, 2, 3):
            rests = sorted({"".join(rng.choice("abc") for _ in range(short + rng.randint(0, 1))) for _ in range(40)})
            index = PositionIndex(rests, short, start)
            for a in rests:
                want = 0
                for k, b in enumerate(rests):
                    both_long = len(a) > short and len(b) > short
                    if not both_long and is_near(a, b) and (start or len(a) == len(b) or a[:short] != b[:short]):
                        want |= 1 << k
                assert index.near(a) == want


def test_odd_tables(spark):
    texts = ["Straße STRASSE straße ÀÉ àé ab×cd x" * 3, "hello " * 5 + "helo hello9hello", "word" * 400_000, "word" * 400_000 + "x",
             "many words " * 200_000]
    docs = odd_docs(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.word: r.n for r in vocabulary(docs, 3, 1, 1).collect()}
    assert got == plain_words(rows, 3, 1, 1)
    short, rows = docs.where("text is null or text not like 'wordword%'"), [r for r in rows if "wordword" not in (r[1] or "")]
    assert rows_of(spelling_variants(short, 3, 3, 1)) == plain_forms(plain_words(rows, 3, 3, 1))
    long = spelling_variants(docs, 97, 3, 1).where("length(word) > 1000000").collect()
    assert len(long) == 2 and {r.form for r in long} == {None} and {r.n_near for r in long} == {1}
    assert spelling_variants(no_docs(spark), 97, 5, 3).count() == 0
