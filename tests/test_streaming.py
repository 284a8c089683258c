import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import sync
from sparkloom.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def streamed(spark, tmp_path, rows, schema, build, batches=2):
    """Rows of a stream over files of rows, a file per micro-batch, and one late file that moves the watermark."""
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_debounce(spark, tmp_path):
    rows = [("a", "created", at(0)), ("a", "modified", at(0.5)), ("b", "created", at(0.2)), ("a", "deleted", at(5)), ("z", "created", at(500)), ("z", "created", at(900))]
    out = streamed(spark, tmp_path, rows, "path string, op string, ts timestamp", stateful.debounce)
    assert {(r["path"], r["op"], r["events"]) for r in out if r["path"] != "z"} == {("a", "modified", 2), ("b", "created", 1), ("a", "deleted", 1)}


def test_idempotent(spark, tmp_path):
    rows = [("k1", at(0)), ("k2", at(1)), ("k1", at(2)), ("k1", at(3))]
    out = streamed(spark, tmp_path, rows, "key string, ts timestamp", stateful.idempotent)
    assert sorted(r["key"] for r in out) == ["k1", "k2"]


def test_rate_limit(spark, tmp_path):
    rows = [(i, "u", at(i * 10)) for i in range(4)] + [(4, "u", at(70)), (5, "v", at(71))]
    out = streamed(spark, tmp_path, rows, "id int, who string, ts timestamp", lambda s: stateful.rate_limited(s, "who", "ts", "id", 60, 2))
    assert {r["id"]: r["allowed"] for r in out} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}
    assert pytest


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600


def answers(spark, tmp_path, rows, batches):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        return streamed(spark, tmp_path, rows, "id long, who string, ts timestamp, done boolean, response string", lambda s: stateful.answered(s, "who", "ts", "id", "done", "response", "1 hour"), batches)
    finally:
        spark.conf.set(key, old)


def test_answers(spark, tmp_path):
    """Replays of a completed answer, refusals while the work goes on, forgetting after 24 hours from the start or
    from the completion, and work that is never completed."""
    rows = [(1, "a", at(0), False, None), (2, "a", at(60), False, None), (3, "b", at(70), False, None)]
    rows += [(4, "a", at(10 * HOUR), True, "ok"), (5, "a", at(11 * HOUR), False, None), (6, "a", at(33 * HOUR), False, None)]
    rows += [(7, "a", at(34 * HOUR), False, None), (8, "c", at(35 * HOUR), False, None), (9, "b", at(35 * HOUR), False, None)]
    rows += [(10, "z", at(200 * HOUR), True, "late"), (11, "z", at(201 * HOUR), False, None), (12, "z", at(202 * HOUR), False, None)]
    out = answers(spark, tmp_path, rows, 4)
    got = {r["id"]: (r["outcome"], r["answer"]) for r in out if r["id"] is not None}
    assert got == {1: ("started", None), 2: ("refused", None), 3: ("started", None), 4: ("completed", "ok"), 5: ("answered", "ok"), 6: ("answered", "ok"), 7: ("started", None), 8: ("started", None), 9: ("started", None), 10: ("completed", "late"), 11: ("answered", "late"), 12: ("answered", "late")}
    lost = [r["key"] for r in out if r["id"] is None]
    assert set(lost) >= {"a", "b", "c"} and all(r["outcome"] == "abandoned" for r in out if r["id"] is None)


def test_answers_of_a_stream_are_those_of_the_batch_form(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "cast(user_id AS string) AS who", "ts", "event_type = 'purchase' AS done", "concat('r', event_id) AS response")
    rows = [tuple(r) for r in events.orderBy("ts").collect()]
    out = {r["id"]: (r["outcome"], r["answer"]) for r in answers(spark, tmp_path, rows, 3) if r["id"] is not None}
    batch = sync.answered(events, "who", "ts", "id", "response", F.col("done"))
    assert out == {r["id"]: (r["outcome"], r["answer"]) for r in batch.collect()}
