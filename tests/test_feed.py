"""A feed of pages as a stream and as a table: what is taken, once each, over stops and failures."""

import pytest

from sparkloom.operators import sync
from sparkloom.sources import feed


def page(spark, at, name, *ids):
    spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, value string").repartition(2).write.parquet(str(at / "pages" / name))


def stream(spark, at, **options):
    feed.register(spark)
    return spark.readStream.format("paged").options(path=str(at / "pages"), **options)


def run(source, at, each):
    q = source.writeStream.foreachBatch(each).option("checkpointLocation", str(at / "checkpoint")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    page(spark, tmp_path, "001", 1, 2)
    got = []
    take = lambda df, n: got.extend((r["id"], r["value"], r["page"]) for r in df.collect())
    run(stream(spark, tmp_path).load(), tmp_path, take)
    assert got == []  # where the feed stands is noted
    page(spark, tmp_path, "002", 3, 4, 5)
    (tmp_path / "pages/003").mkdir()  # not complete
    run(stream(spark, tmp_path).load(), tmp_path, take)
    assert sorted(got) == [(3, "v3", "002"), (4, "v4", "002"), (5, "v5", "002")]
    run(stream(spark, tmp_path).load(), tmp_path, take)
    assert len(got) == 3
    (tmp_path / "pages/003").rmdir()
    page(spark, tmp_path, "003", 6)
    page(spark, tmp_path, "004", 7)
    run(stream(spark, tmp_path).load(), tmp_path, take)
    assert sorted(got)[3:] == [(6, "v6", "003"), (7, "v7", "004")]


def test_a_failed_batch_is_taken_again_whole(spark, tmp_path):
    page(spark, tmp_path, "a", 1, 2, 3)
    seen, kept = [], {}

    def take(df, n):
        seen.append(sorted(r["id"] for r in df.collect()))
        if len(seen) == 1:
            raise RuntimeError("lost")
        kept[n] = seen[-1]

    source = stream(spark, tmp_path, **{"from": "beginning"}).load()
    with pytest.raises(Exception, match="lost"):
        run(source, tmp_path, take)
    page(spark, tmp_path, "b", 4)
    run(stream(spark, tmp_path, **{"from": "beginning"}).load(), tmp_path, take)
    assert seen[0] == seen[1] == [1, 2, 3] and sorted(i for ids in kept.values() for i in ids) == [1, 2, 3, 4]


def test_as_a_table(spark, tmp_path):
    feed.register(spark)
    (tmp_path / "pages").mkdir()
    read = lambda: spark.read.format("paged").option("path", str(tmp_path / "pages"))
    with pytest.raises(Exception, match="no page yet"):
        read().load()
    assert read().schema("id long, page string").load().collect() == []
    page(spark, tmp_path, "x", 1, 2)
    page(spark, tmp_path, "y", 3)
    assert sorted(tuple(r) for r in read().load().collect()) == [(1, "v1", "x"), (2, "v2", "x"), (3, "v3", "y")]
    assert sorted(tuple(r) for r in read().schema("page string, id long").load().collect()) == [("x", 1), ("x", 2), ("y", 3)]


def test_a_page_that_comes_between_is_left_for_next_time(spark, tmp_path):
    page(spark, tmp_path, "p", 1)
    rows = spark.read.parquet(str(tmp_path / "pages/p")).selectExpr("id", "1 AS page")
    rows.write.parquet(str(tmp_path / "feed"))
    read = lambda: spark.read.parquet(str(tmp_path / "feed"))
    _, state = sync.changes_after(read(), None, "page")
    rows.selectExpr("id + 1 AS id", "2 AS page").write.mode("append").parquet(str(tmp_path / "feed"))
    taken, state = sync.changes_after(read(), state, "page")
    rows.selectExpr("id + 2 AS id", "3 AS page").write.mode("append").parquet(str(tmp_path / "feed"))
    assert [r["id"] for r in taken.collect()] == [2] and state.first()["page"] == 2
    taken, state = sync.changes_after(read(), state, "page")
    assert [r["id"] for r in taken.collect()] == [3] and state.first()["page"] == 3
