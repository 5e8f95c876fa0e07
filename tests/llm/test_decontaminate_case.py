"""Op 7 on letters whose lower case depends on what is around them."""

import pytest

from tests.llm.test_operators import _judged, rows_of
from tidewater.llm import decontaminate


@pytest.mark.parametrize("bound", [decontaminate.SET_ROWS, 1])
def test_capital_sigma_before_a_break_is_found(spark, bound):
    passage = " ".join(f"w{i} ΟΔΟΣ.Α Α:Σ" for i in range(8))
    docs = [(1, f"before {passage} after"), (2, "other words"), (3, passage.upper())]
    bench = [(7, passage), (8, "x " * 20)]
    found = decontaminate.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), set_rows=bound)
    want = sorted(_judged(docs, bench), key=repr)
    assert [w[-1] for w in want] == [True, False, True]
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_texts_are_split_once_and_never_within_a_window(spark, tmp_path):
    """The decision must not be moved into a filter over the scan, where it would split a text for each of its windows."""
    from tidewater import shared

    passage = " ".join(f"w{i}" for i in range(30))
    docs, _ = shared.written(spark.createDataFrame([(1, passage), (2, None), (3, "a b")], "doc_id long, text string"), "plan")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    kept = decontaminate.remove_documents(docs, bench)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 0 and "LeftAnti" in plan
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontaminate.digest(docs, bench)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
