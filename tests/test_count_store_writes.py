"""What the opening batch of a count store writes."""

from __future__ import annotations

from ridegrid.operators import incremental as I


def test_opening_batch_of_a_count_store_is_written_once(spark, tmp_path, monkeypatch):
    staged, kept = [], I.materialize

    def noting(df, label="stage"):
        staged.append(label)
        return kept(df, label)

    monkeypatch.setattr(I, "materialize", noting)
    store = I.CountStore(spark, str(tmp_path / "store"), "k int")
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (3, -1), (None, 1)], "k int, Sign int")
    got = store.add(rows, 0)
    assert sorted(((r.k or 0), r.n, r.was) for r in got.collect()) == [(0, 1, 0), (1, 2, 0), (2, 1, 0)]
    assert staged == []
    again = store.add(rows, 0)  # a replayed opening batch rewrites its own version
    assert again.count() == 3 and sorted(((r.k or 0), r.n) for r in store.read().collect()) == [(0, 1), (1, 2), (2, 1)]
    later = store.add(spark.createDataFrame([(1, -1), (4, 1)], "k int, Sign int"), 1)
    assert sorted((r.k, r.n, r.was) for r in later.collect()) == [(1, 1, 2), (4, 1, 0)]
    assert sorted(((r.k or 0), r.n) for r in store.read().collect()) == [(0, 1), (1, 1), (2, 1), (4, 1)]
