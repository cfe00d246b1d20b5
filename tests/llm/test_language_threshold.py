import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_left_out_language_and_random_letters_go(spark, left_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.learn(docs.where((F.col("lang") != left_out) & ~langid.fold_out()))
    foreign, own = docs.where(F.col("lang") == left_out), docs.where(F.col("lang") != left_out)
    assert langid.known_rows(foreign, profiles).count() < 0.1 * foreign.count()
    assert langid.known_rows(own, profiles).count() == own.count()
    short = own.where("n_chars < 300")
    assert short.count() > 10 and langid.known_rows(short, profiles).count() == short.count()
    rng = random.Random(5)
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
               for n in (20, 100, 1000) for _ in range(20)]
    noise = spark.createDataFrame([(t,) for t in letters], "text string")
    assert langid.known_rows(noise, profiles).count() == 0


def test_gap_by_hand():
    own, other = np.zeros((2, 1001), int)
    assert langid.gap(own, other) == langid.LEAST_LIKENESS  # nothing measured
    own[500], own[700] = 10, 90
    assert langid.gap(own, other) == pytest.approx((0.5 + langid.LEAST_LIKENESS) / 2)  # one language
    other[250], other[299], other[600] = 90, 6, 4
    assert langid.gap(own, other) == pytest.approx(0.4)
    other[899] = 900
    assert langid.gap(own, other) == pytest.approx(0.5)  # overlap: no row of its own language falls
