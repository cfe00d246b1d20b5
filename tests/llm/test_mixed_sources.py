from collections import Counter

from pyspark.sql import functions as F

from lettermill.llm.mixing import mixed_rows


def test_equal_rows_of_two_sources(spark):
    rows = [(1, "same", "a"), (1, "same", "b"), (2, "same", None), (2, "same", None), (2, "same", "a"), (None, "x", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = [3, 0, 2, 1, 0, 4]
    picks = spark.createDataFrame([(*r, n) for r, n in zip(rows, copies)],
                                  "doc_id long, text string, source string, copies long")
    picks = picks.withColumn("content", F.xxhash64("text")).drop("text")
    want = Counter()
    for row, n in zip(rows, copies):
        want[row] += n
    assert Counter(map(tuple, mixed_rows(docs, picks).collect())) == +want
