import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dml
from sparkloom.plans.builder import PREDICATES, Conditions, Query, bound, flatten, literal, predicate, similar_to_regex, split_items


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 30), (2, "bob", None), (3, None, 50), (4, "ann_b", 20)], "id int, name string, age int")


def ids(q):
    return [r["id"] for r in q.to_df().orderBy("id").collect()]


def test_there_are_all_operators(spark):
    assert len(PREDICATES) == 22
    with pytest.raises(ValueError):
        predicate(F.col("x"), "=>", 1)


def test_null_logic(people):
    q = Query(people)
    assert ids(q.where("age", "=", None)) == []
    assert ids(q.where_not_in("age", [30, 20])) == [3]
    assert ids(q.where_not_in("age", [])) == [1, 2, 3, 4]
    assert ids(q.where_in("age", [])) == []
    assert ids(q.where_null("name").or_where("age", "IS NULL")) == [2, 3]


def test_like_and_similar(people):
    q = Query(people)
    assert ids(q.where_like("name", "ann%", case_sensitive=False)) == [1, 4]
    assert ids(q.where("name", "similar to", "(ann|bob)%")) == [2, 4]
    assert similar_to_regex("a.b%_") == r"^(?s:a\.b.*.)$"


def test_queries_are_immutable(people):
    q = Query(people).select("id")
    q.where("id", "=", 1)
    assert ids(q) == [1, 2, 3, 4] and q.info()["conditions"] == 0


def test_groups(people):
    q = Query(people).where("id", ">", 1).group(lambda g: g.where("age", ">", 40).or_where("name", "=", "bob"))
    assert ids(q) == [2, 3]
    assert ids(Query(people).group(lambda g: g)) == [1, 2, 3, 4]
    assert ids(Query(people).where("id", "=", 1).group(lambda g: g.where("id", "=", 2), "OR")) == [1, 2]


def test_select_list():
    assert split_items("a, f(b, 'x,y') AS c, d") == ["a", "f(b, 'x,y') AS c", "d"]
    assert flatten(["a", None, ["b", ("c",)], 1]) == ["a", "b", "c", "1"]


def test_columns_of_a_query(people):
    q = Query(people).select("id", "name n")
    assert q.has_column("N") and not q.has_column("age")
    assert q.remove_column("n").items == ("id",)
    assert q.to_df().columns == ["id", "n"]


def test_raw_conditions(people):
    assert ids(Query(people).where_raw("name = :n OR age > :a", {"n": "it's", "a": 40})) == [3]
    assert bound("x = ':y' AND z = :z", {"z": dt.date(2020, 1, 2)}) == "x = ':y' AND z = DATE '2020-01-02'"
    assert literal("a'b\\") == "'a\\'b\\\\'"
    with pytest.raises(ValueError):
        Query(people).where_raw("1 = 1; DROP TABLE x")
    with pytest.raises(ValueError):
        Query(people).where_raw("a = :b")
    assert ids(Query(people).where_raw("name != 'updated at'")) == [1, 2, 4]


@pytest.mark.parametrize("bad", [lambda q: q.order_by("id", "UP"), lambda q: q.limit(-1), lambda q: q.offset(-1), lambda q: q.where("id; --", "=", 1), lambda q: q.where_between("id", 1, None).where("id", "BETWEEN", [1]), lambda q: q.where_function("name", "=", 1), lambda q: q.join(q.source, None), lambda q: q.join(q.source, "a = b", "CROSS"), lambda q: q.join(q.source, "a = b", "ODD"), lambda q: q.where("id", None)])
def test_what_is_refused(people, bad):
    with pytest.raises(ValueError):
        bad(Query(people))


def test_group_having_order(people):
    q = Query(people).select("age IS NULL AS unknown", "count(*) AS n", "max(id) AS last").group_by("age IS NULL")
    assert {(r["n"], r["last"]) for r in q.to_df().collect()} == {(3, 4), (1, 2)}
    q = Query(people).select("name", "count(*) n").group_by("name").having("count(*) >= :k AND max(id) > 1", {"k": 1}).order_by("name", "DESC").limit(1)
    assert [r["name"] for r in q.to_df().collect()] == ["bob"]


def test_filters_reach_the_scan(spark, sf_dir):
    df = Query(spark.read.parquet(f"{sf_dir}/orders.parquet")).select("o_orderkey").where("o_totalprice", ">", 100.0).to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100.0)" in plan and "o_orderpriority" not in plan


def test_changes(people):
    assert dml.insert_rows(people, {"id": 9}).count() == 5
    assert dml.affected(people, Conditions().where("age", ">", 25)) == 2
    done = dml.update(people, {"name": "x"}, Conditions().where("age", ">", 25))
    assert [(r["id"], r["name"]) for r in done.orderBy("id").collect()] == [(1, "x"), (2, "bob"), (3, "x"), (4, "ann_b")]
    for bad in (lambda: dml.update(people, {"name": "x"}), lambda: dml.update(people, {}, Conditions().where("id", "=", 1)), lambda: dml.insert_rows(people, []), lambda: dml.insert_rows(people, [{"id": 1}, {"name": "x"}]), lambda: dml.insert_rows(people, {"id": [1, 2], "age": [1]}), lambda: dml.insert_rows(people, {"no": 1}), lambda: dml.insert_from(people, people.select("id"))):
        with pytest.raises(ValueError):
            bad()
    assert dml.update(people, {"age": 1}, allow_full=True).agg(F.sum("age")).first()[0] == 4


def test_what_a_query_tells_of_itself(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    q = Query(df)
    assert q.is_select_all and len(q) == 0 and q and q.get_columns() == []
    q = q.add_column("id", "upper(name) AS big", ["ID", None]).join(df.alias("o"), "o.id = id", "left")
    assert q.get_columns() == ["id", "upper(name) AS big"] and q.aliases() == {"big": "upper(name)"} and len(q) == 2 and not q.is_select_all
    assert q.has_column("big") and not q.remove_column("big").has_column("big") and len(q) == 2
    assert q.info()["joins"] == [{"how": "left", "on": "o.id = id", "columns": ["id", "name"]}] and q.info()["aliases"] == {"big": "upper(name)"}
