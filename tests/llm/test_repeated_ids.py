"""Op 9 where a doc_id stands on unlike texts."""

from collections import Counter

from tidewater.llm import neardup


def test_unlike_texts_of_one_doc_id_both_stay(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(5, one), (5, two), (8, one + " end"), (9, two + " end"), (5, one)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(5, one), (5, two)])
