"""Hydration of a page, and of a list too long for one: the same rows, in the same order."""

import pytest

from tidewater.operators import catalogue


@pytest.mark.parametrize("most", [catalogue.PAGE_IDS, 5])
def test_every_id_is_hydrated_in_order(spark, monkeypatch, most):
    monkeypatch.setattr(catalogue, "PAGE_IDS", most)
    items = spark.createDataFrame([(i, f"n{i}", None if i % 3 else "2024-01-01") for i in range(20)], "id long, name string, deleted_at string")
    ids = [(p, p * 7 % 23) for p in range(40)]
    rows = catalogue.hydrate(spark.createDataFrame(ids, "pos long, id long"), items).collect()
    assert [(r.pos, r.id, r.name) for r in rows] == [(p, i, f"n{i}") for p, i in ids if i < 20 and i % 3]
