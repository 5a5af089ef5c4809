"""Increments that are delivered twice, and batches that die half-way."""

import pytest

from terracadence.streaming.ledger import Ledger, cached

SCHEMA = "id long, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(ledger, spark):
    return sorted(tuple(r) for r in ledger.table(spark).collect())


def test_rows_are_taken_once(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "t"), SCHEMA)
    assert held(ledger, spark) == []
    ledger.add(rows(spark, (1, "a"), (1, "a"), (2, None)), 0)
    ledger.add(rows(spark, (1, "a"), (1, "b"), (2, None)), 1)
    ledger.add(rows(spark), 2)
    assert held(ledger, spark) == [(1, "a"), (1, "b"), (2, None)]
    by_id = Ledger(str(tmp_path / "k"), SCHEMA, ["id"])
    by_id.add(rows(spark, (1, "a")), 0)
    by_id.add(rows(spark, (1, "b"), (3, "c")), 1)
    assert held(by_id, spark) == [(1, "a"), (3, "c")]


@pytest.mark.parametrize("dies", ["before", "between", "after"])
def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch, dies):
    """The stream is killed at one of three points of its second batch and started again from its checkpoint."""
    feed, folder = tmp_path / "feed", str(tmp_path / "t")
    rows(spark, (1, "a"), (2, "b")).coalesce(1).write.parquet(str(feed / "0"))
    ledger = Ledger(folder, SCHEMA)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{feed}/*")
    ledger.follow(stream(), f"{folder}/progress").awaitTermination()
    rows(spark, (2, "b"), (3, "c")).coalesce(1).write.parquet(str(feed / "1"))
    whole, seen = ledger.add, []

    def dying(batch_rows, batch):
        seen.append(batch)
        if dies == "between":
            part = ledger._part
            monkeypatch.setattr(ledger, "_part", lambda kind, n: part(kind, n) if kind == "data" else (_ for _ in ()).throw(RuntimeError("killed")))
            try:
                whole(batch_rows, batch)
            finally:
                monkeypatch.setattr(ledger, "_part", part)
        elif dies == "after":
            whole(batch_rows, batch)
        raise RuntimeError("killed")

    monkeypatch.setattr(ledger, "add", dying)
    with pytest.raises(Exception, match="killed"):
        ledger.follow(stream(), f"{folder}/progress").awaitTermination()
    monkeypatch.setattr(ledger, "add", whole)
    assert held(ledger, spark) == ([(1, "a"), (2, "b"), (3, "c")] if dies == "after" else [(1, "a"), (2, "b")])
    ledger.follow(stream(), f"{folder}/progress").awaitTermination()
    assert seen == [1] and held(ledger, spark) == [(1, "a"), (2, "b"), (3, "c")]


def test_answers_are_kept(spark, tmp_path):
    asked = []

    def producer(wanted):
        asked.append(sorted(r.id for r in wanted.collect()))
        return wanted.where("id < 90").selectExpr("id", "concat('v', id) as v")

    ask = lambda *ids: {r.id: (r.v, r.cached) for r in cached(spark.createDataFrame([(i,) for i in ids], "id long"), producer, str(tmp_path / "c"), ["id"], SCHEMA).collect()}
    assert ask(1, 2, 2) == {1: ("v1", False), 2: ("v2", False)}
    assert ask(2, 3, 99) == {2: ("v2", True), 3: ("v3", False)}
    assert ask(1, 3) == {1: ("v1", True), 3: ("v3", True)} and ask(99) == {}
    assert asked == [[1, 2], [3, 99], [99]]
