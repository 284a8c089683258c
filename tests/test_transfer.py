"""Copies by ranges: cut off and gone on with, checked on both sides, from frames and from a database."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import transfer


def table(spark, n=300):
    return spark.createDataFrame([(i * 7 % 1000 if i % 50 else None, f"v{i}", [i], i % 3 or None) for i in range(n)], "id long, `v x` string, more array<int>, m int")


def test_a_copy_that_was_cut_off_goes_on(spark, tmp_path):
    df, asked = table(spark), []

    def broken(predicate):
        asked.append(predicate)
        if len(asked) == 6:
            raise ConnectionError("lost")
        return df.where(predicate)

    copy = transfer.Transfer(spark, str(tmp_path), "id", parts=8, at_once=2)
    assert copy.rows() is None and copy.checks().count() == 0
    with pytest.raises(ConnectionError):
        copy.run(broken)
    assert 0 < copy.rows().count() < df.count() and copy.checks().where("same").count() == 4
    first = asked[1:]
    again = transfer.Transfer(spark, str(tmp_path), "id", parts=3, at_once=2)  # the plan is kept
    asked.clear()
    checks = again.run(lambda p: asked.append(p) or df.where(p)).collect()
    assert not set(first[:4]) & set(asked) and len(checks) == 9 and all(r["same"] for r in checks)
    assert sum(r["rows"] for r in checks) == df.count() and again.rows().exceptAll(df).count() == df.exceptAll(again.rows()).count() == 0
    asked.clear()
    assert len(again.run(lambda p: asked.append(p) or df.where(p)).collect()) == 9 and asked == []


def test_a_range_whose_sides_differ_is_copied_again(spark, tmp_path):
    df, turns = table(spark), []
    copy = transfer.Transfer(spark, str(tmp_path), "id", parts=4, at_once=5)
    assert copy.verify().count() == 0
    source = lambda p: turns.append(p) or df.where(p)
    copy.run(source)
    assert copy.verify().where("same").count() == 5
    files = [p for i in (1, 3) for p in (tmp_path / f"rows/range={i}").iterdir() if p.suffix == ".parquet"]
    files[0].unlink()
    spark.read.parquet(str(files[-1])).withColumn("m", F.lit(9)).coalesce(1).write.parquet(str(tmp_path / "other"))
    next((tmp_path / "other").glob("*.parquet")).replace(files[-1])
    (files[-1].parent / f".{files[-1].name}.crc").unlink(missing_ok=True)
    assert sorted(r["range"] for r in copy.verify().where("not same").collect()) == [1, 3]
    turns.clear()
    assert copy.run(source).where("same").count() == 5
    assert len(turns) == 2 and copy.rows().exceptAll(df).count() == df.exceptAll(copy.rows()).count() == 0
    assert copy.verify().where("same").count() == 5


def test_ranges_cover_all_keys(spark, tmp_path):
    for values in ([], [None, None], [3], [5] * 40, list("áb'cz") * 9, [dt.date(2024, 1, d) for d in range(1, 29)]):
        kind = "string" if values and isinstance(values[0], str) else "date" if values and isinstance(values[0], dt.date) else "int"
        df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
        found = transfer.predicates("k", transfer.bounds(df, 5))
        assert sum(df.where(p).count() for p in found) == df.count()
        copy = transfer.Transfer(spark, str(tmp_path / f"{kind}{len(values)}"), "k", parts=5, at_once=3)
        assert copy.run(transfer.of_frame(df)).where("same").count() == len(found)


def test_from_a_database(spark, tmp_path):
    """Over JDBC from the database that Spark brings along."""
    options = {"url": f"jdbc:derby:memory:t{abs(hash(str(tmp_path)))};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(i, f"n{i % 13}", i * 0.5) for i in range(500)], "ID long, NAME string, X double")
    df.write.jdbc(options["url"], "people", properties={"driver": options["driver"]})
    copy = transfer.Transfer(spark, str(tmp_path), "ID", parts=6, at_once=4)
    checks = copy.run(transfer.of_jdbc(spark, options, "people")).collect()
    assert len(checks) == 7 and all(r["same"] for r in checks) and {r["rows"] for r in checks if r["rows"]} <= {83, 84}
    assert sorted(copy.rows().collect()) == sorted(df.collect())


def test_only_the_quantiles_come_to_the_driver(spark, monkeypatch):
    df, given = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k")), []
    kind = type(df)
    monkeypatch.setattr(kind, "collect", lambda self, collect=kind.collect: given.append(collect(self)) or given[-1])
    assert transfer.bounds(df, 5, 5000) == transfer.bounds(df, 5) == [1000, 2000, 3000, 4000]
    assert transfer.bounds(df.select(F.when(F.col("k") < 3500, 7).otherwise(F.col("k")).alias("k")), 5) == [4000]
    some = transfer.bounds(df, 5, 1000)
    assert len(some) == 4 and all(abs(a - b) < 400 for a, b in zip(some, (1000, 2000, 3000, 4000), strict=True))
    assert max(map(len, given)) <= 5
