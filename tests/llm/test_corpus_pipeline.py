from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lettermill.llm import langid, mixing, queries, simhash, toxicity
from lettermill.session import materialise
from tables import no_docs, odd_docs

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language", "near_copies", "source_mix", "bpe_encode"]

    def after(name, given):
        out = materialise(stages[name](spark, given, SF), name)
        if name != "bpe_encode":
            assert out.columns == COLUMNS
            assert all(tuple(r) == tuple(rows[r.doc_id]) for r in out.collect())
        return out

    lexicon = toxicity.learn(docs, queries.table(spark, SF, "labels"), toxicity.fold_out())
    clean = after("toxicity", docs)
    ids = {i for i, r in rows.items() if lexicon.scores([r.text.encode()])[0] < 0.5}
    assert {r.doc_id for r in clean.collect()} == ids

    profiles = langid.learn(clean.where(~langid.fold_out()))
    known = after("language", clean)
    ids = {i for i in ids if (g := profiles.guess(rows[i].text))[0] != "und" and g[1] >= profiles.least}
    assert {r.doc_id for r in known.collect()} == ids

    fps = {i: simhash.fingerprint(rows[i].text.encode()) for i in ids}
    group = {i: i for i in ids}
    for _ in ids:
        new = {i: min(group[j] for j in ids if bin(fps[i] ^ fps[j]).count("1") <= 4) for i in ids}
        if new == group:
            break
        group = new
    single = after("near_copies", known)
    assert {r.doc_id for r in single.collect()} == {i for i in ids if group[i] == i} and single.count() == len(set(group.values()))

    picks = {r.doc_id: r.copies for r in mixing.mix(single, queries.quality_weights(spark, SF)).collect()}
    mixed = after("source_mix", single)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in picks.items() if n})

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = after("bpe_encode", mixed).collect()
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed.collect())
    for r in coded:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(rows[r.doc_id].text, add_special_tokens=False).ids
    whole = entry.queries()["pipeline"](spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, coded))


def test_odd_tables(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, SF), name)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
