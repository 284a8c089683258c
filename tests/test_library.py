import datetime as dt
import hashlib
import hmac
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import assertions, code, security, text
from sparkloom.operators import deid, generate, identity, reshape, rollups, sync
from sparkloom.operators.numbering import numbered, with_checkpoints
from sparkloom.plans.builder import Query
from sparkloom.plans.queries import ORACLES
from sparkloom.sources import config, files, scripts, tables, versions


def column(spark, values, c, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", c(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    day = dt.datetime(2001, 2, 3)
    assert column(spark, ["2/3/2001", "02/03/2001", "02/30/2001", "", None], lambda c: text.parse_date(c, "%m/%d/%Y")) == [day, day, None, None, None]
    assert column(spark, ["2001-02-03", None], lambda c: text.year_text(c.cast("date"))) == ["2001", ""]
    days = column(spark, ["2023-12-31"], lambda c: F.size(text.weekdays_after(c.cast("date"), F.lit("2024-01-31").cast("date"))))
    assert days == [23]
    with pytest.raises(ValueError):
        text.java_format("%q")


def test_text(spark):
    assert column(spark, ["Robert", "Tymczak", "Pfister", "Ashcraft", "Éva", "", None], text.soundex_part) == ["R163", "T522", "P236", "A261", "E100", "", ""]
    assert column(spark, ["  Hello,\n WORLD! é "], text.normalized) == ["hello world é"]
    assert column(spark, ["My Part! 1", "!!", "a-b_c"], text.slug) == ["my_part_1", "untitled", "a-b_c"]
    assert column(spark, ["a/b.txt", "a", "a.b/c"], lambda c: text.conflict_name(c, F.lit("7"))) == ["a/b_conflict_7.txt", "a_conflict_7", "a.b/c_conflict_7"]
    assert column(spark, ["core\\x\\y.py"], text.module_of) == ["core.x.y"]
    assert column(spark, ["from libs.a import b\nimport libs.c\nimport os\nimport libs.c"], lambda c: text.imported_modules(c, "libs")) == [["libs.a", "libs.c"]]
    assert column(spark, ["```json\n{\"a\": 1}\n```", "no"], lambda c: text.fenced_json(c, "a int")["a"]) == [1, None]
    assert column(spark, ["ValueError: x: y", "", None], lambda c: text.exception_class(c, "?")) == ["ValueError", "?", "?"]
    assert column(spark, ["x {{a}} {{b}}"], lambda c: text.fill_template(c, {"a": F.lit("1"), "b": F.lit("2")})) == ["x 1 2"]
    parts = column(spark, ["postgres://u:p@h:5432/db?x=1&password=2#f", "file"], text.url_parts)
    assert parts[0].asDict() == {"scheme": "postgres", "host": "h", "port": 5432, "path": "/db", "user": "u", "query": "x=1&password=2"}
    assert column(spark, ["x=1&password=2"], lambda c: text.safe_query(c, security.SENSITIVE)) == [{"x": "1"}]


def test_assertions(spark):
    near = lambda a, b, **k: column(spark, [a], lambda c: assertions.equal(c, F.lit(b), **k), "double")[0]
    assert near(1.0, 1.0 + 1e-12) and not near(1.0, 1.001) and near(1.0, 1.001, tolerance=0.01)
    with pytest.raises(Exception, match="NaN"):
        near(float("nan"), 1.0)
    with pytest.raises(ValueError):
        assertions.in_range(F.lit(1), 2, 1)
    assert column(spark, ["A b", "c"], lambda c: assertions.contains(c, F.lit("a  B!"))) == [True, False]
    assert column(spark, ["kitten", "", None], lambda c: assertions.similarity(c, F.lit("sitting"))) == [pytest.approx(8 / 13), 0.0, None]
    assert assertions.indel_ratio("", "") == 1.0
    assert column(spark, ["a\nB "], lambda c: assertions.same_lines(c, F.lit("A\n b"))) == [True]
    assert column(spark, ["ﬁ"], assertions.nfkc) == ["fi"]
    assert column(spark, ["a"], lambda c: assertions.text_diff(c, F.lit("a"))) == [""] and "+b" in column(spark, ["a"], lambda c: assertions.text_diff(c, F.lit("b")))[0]


@pytest.mark.parametrize("key", [b"k", b"x" * 100])
def test_keyed_hashes(spark, key):
    want = [hmac.new(key, m.encode(), "sha256").hexdigest() for m in ("", "é")]
    assert column(spark, ["", "é"], lambda c: security.hmac_sha256(key, c)) == want
    made = column(spark, ["é", None], lambda c: security.tokens(key, F.lit("n"), c))
    assert made == [security.token(key, "n", "é"), security.token(key, "n", "")] and all(len(t) == 22 for t in made)


def test_base62():
    assert [security.base62(b) for b in (b"", b"\0", b"\x01", b"\x3e", b"\xff\xff")] == ["0", "0", "1", "10", "H31"]


def test_encryption(spark):
    key = b"0" * 32
    sealed = column(spark, ["secret", "é"], lambda c: security.encrypt(c, key))
    assert column(spark, sealed, lambda c: security.decrypt(c, key)) == ["secret", "é"]
    with pytest.raises(ValueError):
        security.checked_key(b"short")
    salt = b"s" * 16
    sealed = column(spark, ["x"], lambda c: security.encrypt_with_password(c, "pw", salt))
    assert column(spark, sealed, lambda c: security.decrypt_with_password(c, "pw", salt)) == ["x"]


def test_content_hash(spark):
    assert column(spark, ["abc"], security.content_hash) == [hashlib.sha256(b"abc").hexdigest()]
    assert column(spark, ["abc"], lambda c: security.content_hash(c, F.lit("p"), "md5")) == [hashlib.md5(b"PATH::pabc").hexdigest()]
    assert column(spark, ["abc"], lambda c: security.content_hash(c, None, "blake2b")) == [hashlib.blake2b(b"abc").hexdigest()]


def test_masking(spark):
    raw = ["postgres://u:pw@h/db", "postgres://h/db", "user=a;PWD=b;x=1", "a=1&token=2", "log in with password=abc now", "mail u:pw@h", "", "plain"]
    want = ["postgres://u:****@h/db", "postgres://h/db", "user=a;PWD=****;x=1", "a=1&token=****", "log in with password=**** now", "mail u:****@h", "", "plain"]
    assert column(spark, raw, security.masked) == want
    assert column(spark, ['my token = "abc" and', "Bearer abc.def", "the password: x, yes"], lambda c: security.masked_text(c, security.ASSIGNED)) == ['my token = "****" and', "Bearer ****", "the password: ****, yes"]


def test_recipes(spark):
    df = spark.createDataFrame([("1", "Ann", None)], "tokenid string, first string, last string")
    recipes = {"a_1": {"version": "v1", "family": "f", "parts": ["first:2", "soundex:first", "last"]}, "b_1": {"version": "v9", "family": "f", "parts": ["first"]}}
    got = deid.build_tokens(df, {}, recipes, b"k", ["v1"], {"f": True}).collect()
    assert [(r["token_name"], r["token_hash"]) for r in got] == [("a_1", security.token(b"k", "a_1", "AnA500", 43))]
    assert deid.build_tokens(df, {}, recipes, b"k", [], {}).count() == 0
    with pytest.raises(KeyError):
        deid.part("nothing", {}, df.columns)
    with pytest.raises(ValueError):
        deid.part("first:x", {}, df.columns)
    with pytest.raises(KeyError):
        deid.derived_fields(df, {}, {"x": {"from": "y", "transform": "year"}})


def test_identity_chain_and_second_run(spark):
    facts = spark.createDataFrame([("A", "t_1", "h1"), ("B", "t_1", "h1"), ("B", "t_2", "h2"), ("C", "t_2", "h2"), ("D", "t_1", "missing TOKEN"), ("E", "t_1", "h1")], "tokenid string, token_name string, token_hash string")
    at = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "tokenid string, detokenid string, startdate timestamp, enddate timestamp")
    rows = identity.with_create_date(identity.without_invalid(identity.with_order(identity.token_rows(facts))), empty, at)
    alt = {(r["tokenid"], r["token_hash"]): r["alt_tokenid"] for r in identity.with_alternative(rows).collect()}
    assert alt["A", "h1"] == "E" and alt["E", "h1"] is None and alt["D", "missing TOKEN"] is None and alt["B", "h2"] == "C"
    best = identity.best_rows(identity.with_alternative(rows))
    done = {r["tokenid"]: r["detokenid"] for r in identity.with_identity(best, empty, F.concat(F.lit("N"), "tokenid")).collect()}
    assert done == {"A": "NE", "B": "NC", "C": "NC", "D": "ND", "E": "NE"}
    mapping = identity.new_mapping(identity.with_identity(best, empty, F.concat(F.lit("N"), "tokenid")))
    first = identity.upsert_tokens(empty, mapping, at)
    assert identity.upsert_tokens(first, mapping, at).count() == first.count() == 5
    hashes = identity.upsert_hashes(spark.createDataFrame([], "detokenid string, token_hash string, token_order int"), mapping)
    assert identity.upsert_hashes(hashes, mapping).count() == hashes.count()


def test_reshape(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["x", None])], "k int, a array<int>, b array<string>")
    assert [(r["position"], r["a"], r["b"]) for r in reshape.columns_to_rows(df, ["a", "b"], "?", strict=False).collect()] == [(0, 1, "x"), (1, 2, None), (2, 3, "?")]
    with pytest.raises(Exception, match="length"):
        reshape.columns_to_rows(df, ["a", "b"]).collect()
    m = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],), ([],)], "m array<array<int>>")
    assert [r[0] for r in m.select(reshape.transpose_matrix(F.col("m"))).collect()] == [[[1, 4], [2, 5], [3, 6]], []]
    rows = reshape.ragged_rows([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert {tuple(r) for r in rows.collect()} == {(1, None), (None, 2)}
    assert reshape.to_mapping(reshape.to_namespace({"a": [{"b": 1}]})) == {"a": [{"b": 1}]}
    assert reshape.datatype_spec("int4:2;varchar(10):1,int4:1") == {"int4": 3, "varchar(10)": 1}
    assert [len(b) for b in reshape.batches(spark.range(2500).toDF("id"))] == [1000, 1000, 500]
    issues = {r["column"]: r["issue"] for r in reshape.profile(spark.createDataFrame([(1, None, None), (2, 3, None)], "a int, b int, c int")).collect()}
    assert issues == {"a": "none", "b": "some null", "c": "all null"}


def test_rollups(spark):
    assert rollups.status_counts(spark.createDataFrame([], "s string"), "s").first()["success_rate"] == 0
    args = spark.sql("SELECT array(named_struct('name', 'a', 'type_hint', 'int', 'default', '1', 'is_kwarg', false, 'is_variadic', false), named_struct('name', 'k', 'type_hint', CAST(NULL AS STRING), 'default', CAST(NULL AS STRING), 'is_kwarg', true, 'is_variadic', true)) AS args")
    assert args.select(rollups.signature(F.lit("f"), F.col("args"))).first()[0] == "f(a: int = 1, **k)"
    methods = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "file string, n int, source string")
    assert [r["contenthash"] for r in rollups.cumulative_hashes(methods, "file", "n", "source").orderBy("n").collect()] == [hashlib.sha256(x).hexdigest() for x in (b"a", b"ab")]


def test_index_diff_table(spark):
    kind = "rel_path string, mtime long, size long, md5 string"
    local = spark.createDataFrame([("l", 1, 1, "a"), ("gone", 1, 1, "a"), ("same", 9, 1, "a"), ("newer", 9, 1, "a"), ("older", 1, 1, "a"), ("equal", 5, 1, "a")], kind)
    remote = spark.createDataFrame([("r", 1, 1, "a"), ("same", 1, 1, "a"), ("newer", 1, 2, "b"), ("older", 9, 1, "b"), ("equal", 5, 2, "b"), ("left", 1, 1, "a")], kind)
    state = spark.createDataFrame([("gone",), ("left",)], "rel_path string")
    found = sync.index_diff(local, remote, state)
    assert {r["rel_path"]: r["action"] for r in found.collect()} == {"l": "upload", "gone": "delete_local", "r": "download", "left": "delete_remote", "same": "refresh", "newer": "remote_conflict", "older": "local_conflict", "equal": "local_conflict"}
    assert sync.permitted(found, "upload").count() == 1 and sync.permitted(found, "manual").count() == 0
    with pytest.raises(ValueError):
        sync.permitted(found, "odd")


def test_paths_of_a_tree(spark):
    with_checkpoints(spark)
    nodes = spark.createDataFrame([(1, "root", None), (2, "a", 1), (3, "b", 2), (4, "x", 5), (5, "y", 4)], "id int, name string, parent int")
    assert {r["id"]: r["path"] for r in sync.paths(nodes).collect()} == {1: "root", 2: "root/a", 3: "root/a/b"}


def test_paths_of_a_deep_tree(spark):
    with_checkpoints(spark)
    nodes = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None) for i in range(36)], "id int, name string, parent int")
    found = {r["id"]: r["path"] for r in sync.paths(nodes).collect()}
    assert found == {i: "/".join(f"n{k}" for k in range(i + 1)) for i in range(36)}
    with pytest.raises(ValueError):
        sync.paths(spark.createDataFrame([(1, "a", None), (2, "b", 1), (2, "b", 2)], "id int, name string, parent int"))


def test_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    assert [(r["x"], r["number"]) for r in numbered(df, F.col("x").desc()).orderBy("number").collect()] == [(999 - i, i + 1) for i in range(1000)]
    assert numbered(df.where("x < 0"), F.col("x")).count() == 0


def test_distributions_have_their_means(spark):
    means = {"uniform": 50, "normal": 0, "exponential": 1, "poisson": 5, "binomial": 5, "gamma": 4, "beta": 2 / 7, "pareto": 1, "weibull": 1, "lognormal": 1.6487}
    df = spark.range(40_000).select(*[generate.distribution(n, 3).alias(n) for n in means])
    got = df.agg(*[F.avg(n).alias(n) for n in means]).first().asDict()
    for n, m in means.items():
        assert got[n] == pytest.approx(m, abs=0.25 if n != "uniform" else 1)


def test_generated_tables(spark):
    df = generate.table(spark, 12, 1000, "int2:1;int8:1;float4:1;char:1;varchar(7):1;uuid:1;date:1;datetime:1;time:1")
    assert df.columns == ["int2_1", "int8_1", "float4_1", "char_1", "varchar(7)_1", "uuid_1", "date_1", "datetime_1", "time_1", "int4_1", "int4_2", "int4_3"]
    row = df.first()
    assert len(row["varchar(7)_1"]) == 7 and len(row["uuid_1"]) == 36 and -128 <= row["int8_1"] <= 127
    with pytest.raises(ValueError):
        generate.table(spark, 1, 1, "int4:2")
    for kind in generate.PROFILES:
        assert generate.profiles(spark, kind, 5).count() == 5


def test_files(spark, tmp_path):
    for name, body in (("a.csv", "id,zip\n1,007\n2,\n"), ("b.csv", "zip,id,more\n01,3,x\n"), ("c.csv", "id\n1\n")):
        (tmp_path / name).write_text(body)
    df = files.read_directory(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["id", "zip"])
    assert df.columns == ["id", "zip", "more"] and {tuple(r) for r in df.collect()} == {("1", "007", None), ("2", None, None), ("3", "01", "x")}
    with pytest.raises(KeyError):
        files.read_directory(spark, [str(tmp_path / "c.csv")], ["id", "zip"])
    assert files.latest_file(spark, str(tmp_path), "b", ".csv").endswith("b.csv")
    assert files.walk(spark, str(tmp_path), ["/a."]).count() == 2
    schema = spark.createDataFrame([], "id long, masked_id string").schema
    assert files.read_crosswalk(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "x.txt").write_text("id|masked_id|odd\n1|a|z\n1|a|y\nq|b|y\n")
    assert {tuple(r) for r in files.read_crosswalk(spark, str(tmp_path / "x.txt"), schema).collect()} == {(1, "a"), (None, "b")}
    files.write_text_table(df, str(tmp_path / "out"), "psv")
    assert files.read_text_table(spark, str(tmp_path / "out"), "|").count() == 3
    with pytest.raises(ValueError):
        files.write_text_table(df, str(tmp_path / "out2"), "odd")
    xml = spark.createDataFrame([("<urlset xmlns='http://x'><url><loc>http://a/</loc></url><url><loc>http://b/</loc></url></urlset>",)], "x string")
    assert [r["url"] for r in files.sitemap_locations(xml, "x").collect()] == ["http://a/", "http://b/"]


def test_scripts(spark, tmp_path):
    script = "-- head; er\nSELECT 'a;b--c' AS x; /* no; */ SELECT \"it''s\" AS y;;\nSELECT 1 + 1 AS z"
    assert scripts.statements(script) == ["SELECT 'a;b--c' AS x", "SELECT \"it''s\" AS y", "SELECT 1 + 1 AS z"]
    results, stats = scripts.run(spark, [("s", script), ("bad", "SELECT * FROM no_such_table; SELECT 5 AS v")])
    assert [r.first()[0] for r in results if r.columns[0] in "xzv"] == ["a;b--c", 2, 5]
    assert rollups.script_statistics(stats, "ok", "ms").first()["failed"] == 1
    assert scripts.run(spark, [("s", "SELECT raise_error('x') AS v")])[1].first()["ok"] is False
    (tmp_path / "b.sql").write_text("SELECT 1")
    (tmp_path / "a.txt").write_bytes("SELECT 'é'".encode("latin-1"))
    assert [p.name for p in scripts.script_files(str(tmp_path))] == ["b.sql", "a.txt"]
    assert scripts.read_script(tmp_path / "a.txt") == "SELECT 'é'"
    with pytest.raises(FileNotFoundError):
        scripts.script_files(str(tmp_path / "none"))


@pytest.mark.parametrize(
    ("dialect", "sql", "want"),
    [
        ("sqlite", "SELECT NOW(),  'NOW()  s.t' FROM s.t\n WHERE t.a = TRUE -- NOW()", "SELECT CURRENT_TIMESTAMP, 'NOW()  s.t' FROM t WHERE a = 1"),
        ("sqlite", 'INSERT INTO "s"."t" (id BIGSERIAL, ok BOOLEAN, x DOUBLE DEFAULT 1.5) VALUES (CURRENT_TIMESTAMP()) RETURNING id, a', 'INSERT INTO "t" (id INTEGER, ok INTEGER, x DOUBLE DEFAULT 1.5) VALUES (CURRENT_TIMESTAMP)'),
        ("postgresql", "SELECT `a b`, CURRENT_TIMESTAMP() FROM t WHERE 1 = 1 AND x = '1=1'", "SELECT \"a b\", CURRENT_TIMESTAMP FROM t WHERE TRUE AND x = '1=1'"),
        ("postgresql", "CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT)", "CREATE TABLE t (id INTEGER PRIMARY KEY GENERATED BY DEFAULT AS IDENTITY)"),
        ("mysql", 'CREATE TABLE "t" (id SERIAL, at TIMESTAMP DEFAULT CURRENT_TIMESTAMP, ok INT DEFAULT false)', "CREATE TABLE `t` (id BIGINT AUTO_INCREMENT, at TIMESTAMP DEFAULT CURRENT_TIMESTAMP(), ok INT DEFAULT 0)"),
        ("mariadb", "SELECT TRUE, 'TRUE', CURRENT_TIMESTAMP()", "SELECT 1, 'TRUE', CURRENT_TIMESTAMP()"),
        ("odd", "SELECT  x", "SELECT x"),
    ],
)
def test_dialects(dialect, sql, want):
    assert scripts.normalize(sql, dialect) == want


def test_columns_without_sequences():
    columns = [{"name": "id", "type": "INTEGER", "primary_key": True, "identity": True, "default": "nextval('s'::regclass)"}, {"name": "k", "type": "VARCHAR(5)", "primary_key": True, "default": "'x'"}, {"name": "n", "type": "int8"}]
    assert tables.sanitized(columns) == [{"name": "id", "type": "INTEGER", "primary_key": True, "autoincrement": True}, {"name": "k", "type": "VARCHAR(5)", "primary_key": True, "default": "'x'"}, {"name": "n", "type": "int8"}]


def test_probe_tells_what_is_wrong(spark):
    assert tables.probe(spark, {"url": "jdbc:nothing:x"})


def test_limits_keep_odd_rows(spark):
    """Ids that repeat under two keys, null ids, keys and times, and columns of any type stay as they are."""
    rows = [("a", 1, 0.0), ("a", 2, 10.0), ("a", 3, 20.0), ("b", 1, 5.0), ("b", None, 6.0), (None, 9, 7.0), (None, 9, 8.0), ("a", 4, 500.0), ("c", 7, None)]
    df = spark.createDataFrame([(k, i, t, [i]) for k, i, t in rows], "k string, id int, at double, more array<int>").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at")
    found = sync.fixed_window_limit(df, "k", "ts", "id", 60, 2)
    assert found.columns == ["k", "id", "more", "ts", "allowed", "hits"] and found.count() == len(rows)
    assert {(r["k"], r["id"], r["allowed"], r["hits"]) for r in found.collect()} == {("a", 1, True, 1), ("a", 2, True, 2), ("a", 3, False, 3), ("b", 1, True, 1), ("b", None, True, 2), (None, 9, True, 1), (None, 9, True, 2), ("a", 4, True, 1), ("c", 7, None, None)}
    assert {(r["k"], r["id"]) for r in sync.idempotent(df, "k", "ts", "id").where("fresh").collect()} == {("a", 1), ("b", 1), (None, 9)}


def test_crawl_stays_on_its_host_and_knows_pages_without_fragments(spark):
    with_checkpoints(spark)
    edges = spark.createDataFrame([("http://a/1", "http://a/2#x"), ("http://a/1", "http://a/2#y"), ("http://a/2#z", "http://A/3"), ("http://a/1", "http://b/1"), ("http://a/3", None), ("http://A/3", "http://a/1#top")], "url string, href string")
    start = spark.createDataFrame([("http://a/1#here",)], "url string")
    assert {tuple(r) for r in sync.crawl(edges, start, 5).collect()} == {("http://a/1", 0), ("http://a/2", 1), ("http://A/3", 2)}
    assert ("http://b/1", 1) in {tuple(r) for r in sync.crawl(edges, start, 5, internal=False).collect()}


def test_paths_take_turns_by_the_logarithm_of_the_depth(spark):
    """A chain of 10,000 nodes, circles, nodes below these and below an unknown id."""
    rows = [(i, i - 1 if i else None) for i in range(10_000)] + [(20_000, 20_001), (20_001, 20_000), (20_002, 20_001), (30_000, 99_999), (30_001, 30_000), (40_000, 40_000), (50_000, None)]
    nodes = spark.createDataFrame(rows, "id int, parent int")
    found = {r["id"]: (r["root"], r["depth"]) for r in sync.depths(nodes).collect()}
    assert found == {i: (0, i) for i in range(10_000)} | {50_000: (50_000, 0)}
    few = nodes.where("id < 200 or id >= 20000").withColumn("name", F.concat(F.lit("n"), "id"))
    found = {r["id"]: r["path"] for r in sync.paths(few.union(few)).collect()}
    assert found == {i: "/".join(f"n{j}" for j in range(i + 1)) for i in range(200)} | {50_000: "n50000"}
    _, turns = sync._above(nodes, F.col("upper") + F.col("lower"), F.lit(1), "depth")
    assert turns <= 15
    assert sync.depths(nodes.limit(0)).collect() == []


def test_large_trees_are_led_up_by_leaders(spark):
    """With a bound of few nodes: a chain whose ids are in no order, a broad tree, circles and unknown ids."""
    rows = [(i * 701 % 3000, (i - 1) * 701 % 3000 if i else None) for i in range(3000)] + [(10_000 + i, 10_000 + (i - 1) // 9 if i else None) for i in range(500)]
    odd = [(20_000 + i, 20_000 + (i + 1) % 7) for i in range(7)] + [(21_000, 20_000), (30_000, 99_999), (30_001, 30_000), (40_000, 40_000)]
    want = {}
    for i, parent in rows:
        root, depth, path = want.get(parent, (i, -1, ""))
        want[i] = (root, depth + 1, f"{path}/{i}")
    nodes = spark.createDataFrame(rows + odd, "id int, parent long")
    whole = F.struct((F.col("upper.d") + F.col("lower.d")).alias("d"), F.concat("upper.p", "lower.p").alias("p"))
    first = F.struct(F.when(F.col("parent").isNull(), 0).otherwise(1).alias("d"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("p"))
    got = sync._above(nodes, whole, first, "of", small=100)[0].collect()
    assert {r["id"]: (r["top"], r["of"]["d"], r["of"]["p"]) for r in got} == want and len(got) == len(want)


def test_tasks_do_not_add_up_over_turns(spark):
    nodes = spark.range(3000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert sync.depths(nodes).rdd.getNumPartitions() <= 8 < sync.depths(nodes).count()


def test_routing_beside_letters_that_are_not_ascii(spark):
    prompts = ["undßstä einer", "Undüzube", "éAND", "the\u0301 x", "ünd", "an_the", "der9 und_", "band", "AND", "x\nder", "", None, "the und"]
    df = spark.createDataFrame(list(enumerate(prompts)), "conv_id int, text string").withColumn("turn", F.lit(1))
    rules = [("english", ["the", "and"]), ("german", ["der", "und"])]
    got = {r["conv_id"]: r["provider"] for r in df.select("conv_id", text.routed(F.col("text"), rules, "other").alias("provider")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id INT, turn INT, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, 1, ?)", [list(p) for p in enumerate(prompts)])
    assert got == {r[0]: r[2] for r in con.execute(ORACLES["prompt_routing"]).fetchall()}
    assert [got[i] for i in range(4)] == ["german", "german", "english", "english"]


def test_change_feed_goes_on_where_it_stopped(spark):
    feed = spark.createDataFrame([("a", 1), ("b", 2)], "id string, page int")
    taken, state = sync.changes_after(feed, None, "page")
    assert taken.count() == 0 and state.first()["page"] == 2
    later = feed.union(spark.createDataFrame([("c", 3)], feed.schema))
    taken, state = sync.changes_after(later, state, "page")
    assert [r["id"] for r in taken.collect()] == ["c"] and state.first()["page"] == 3
    assert sync.changes_after(later.limit(0), state, "page")[1].first()["page"] == 3


def test_numbers_within_classes(spark):
    rows = [(i, ["A: x", "B: y", "no colon", None][i % 4 if i % 3 else 0]) for i in range(200)]
    found = rollups.failures_by_class(spark.createDataFrame(rows, "id int, m string"), "m", "id").collect()
    count = {}
    for r in sorted(found, key=lambda r: r["id"]):
        count[r["failure_class"]] = count.get(r["failure_class"], 0) + 1
        assert r["number"] == count[r["failure_class"]]
    assert len(found) == 200 and len(count) == 4


def test_a_batch_counts_whole_or_not_at_all(spark, tmp_path):
    tables_ = versions.SnapshotSet(spark, str(tmp_path / "set"))
    assert tables_.read("a") is None and tables_.versions() == []
    assert tables_.write([("a", lambda read: spark.range(3).toDF("id")), ("b", lambda read: read("a").where("id > 0"))]) == 1
    assert tables_.write([("a", lambda read: read("a").union(read("b"))), ("a", lambda read: read("a").where("id <> 2"))]) == 2
    assert sorted(r["id"] for r in tables_.read("a").collect()) == [0, 1, 1] and tables_.read("b").count() == 2
    with pytest.raises(ZeroDivisionError):
        tables_.write([("a", lambda read: read("a").limit(0)), ("b", lambda read: spark.range(1 // 0))])
    assert tables_.versions() == [1, 2] and tables_.read("a").count() == 3 and tables_.read("a", 1).count() == 3
    assert tables_.write([("b", lambda read: read("b").limit(0))]) == 3 and tables_.read("b").count() == 0


def test_sinks_and_what_a_detokenizer_reads(spark, tmp_path):
    out, master = tmp_path / "out", tmp_path / "master"
    master.mkdir()
    frame = lambda *ids: spark.createDataFrame([(i, "t1", "h") for i in ids], "tokenid string, token_name string, token_hash string")
    assert files.write_tokens([], str(out), "token", "1") is None and files.write_masked(frame().limit(0), str(out), "phi", "1") is None
    files.write_tokens([frame("1")], str(out), "token", "1")
    path = files.write_tokens([frame("007"), frame("2").withColumn("more", F.lit("x"))], str(out), "token", "2")
    assert path.endswith("token_2.csv") and files.read_text_table(spark, path, "|").count() == 2
    assert files.read_text_table(spark, files.write_masked(frame("1"), str(out), "phi", "9", "psv"), "|").count() == 1
    (master / "token_crosswalk.csv").write_text("tokenid|detokenid|startdate|enddate\n007|D1|2024-01-02|\n")
    found = files.detokenizer_tables(spark, str(out), str(master), "token", [("t1", "v1", "f")])
    assert {r["tokenid"] for r in found["token"].collect()} == {"007", "2"} and found["merge_history"].count() == 0 and found["tokencfg"].count() == 1
    row = found["token_crosswalk"].first()
    assert row["startdate"].year == 2024 and row["enddate"] is None
    with pytest.raises(FileNotFoundError):
        files.detokenizer_tables(spark, str(out), str(master), "none", [])


def test_conversion_and_moves(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,zip\n1,007\n")
    source = str(tmp_path / "a.csv")
    assert files.convert(spark, source, "odd", str(tmp_path / "x")) == source
    for kind in ("parquet", "ptxt"):
        target = files.convert(spark, source, kind, str(tmp_path / kind))
        back = spark.read.parquet(target) if kind == "parquet" else files.read_text_table(spark, target, "|")
        assert tuple(back.first()) == ("1", "007")
    files.move(spark, source, str(tmp_path / "deep" / "b.csv"))
    assert (tmp_path / "deep" / "b.csv").exists() and not (tmp_path / "a.csv").exists()
    with pytest.raises(FileExistsError):
        files.move(spark, str(tmp_path / "parquet"), str(tmp_path / "deep"))


def test_parts_of_a_query_are_reset(spark):
    q = Query(spark.range(5).toDF("id")).select("id").where("id", ">", 3).order_by("id", "DESC")
    assert [r["id"] for r in q.reset("conditions").to_df().collect()] == [4, 3, 2, 1, 0] and q.to_df().count() == 1
    assert q.reset().info()["order_by"] == [] and q.with_option("hint", 1).info()["options"] == {"hint": 1} and q.info()["options"] == {}
    assert "Filter" in q.plan_text()
    with pytest.raises(ValueError):
        q.reset("source")


def test_small_expressions(spark, tmp_path):
    df = spark.sql("SELECT DATE'2024-06-05' AS wed, DATE'2024-12-25' AS feast, uuid() AS u")
    entry = lambda c: tuple(df.select(text.timesheet_entry(F.col(c), {"2024-12-25": "Christmas"}, F.lit("work"))).first()[0])
    assert entry("wed") == (8, "task", "work from office", "work") and entry("feast") == (8, "holiday", None, "Christmas - A Company Holiday")
    assert df.select(text.timesheet_entry(F.col("feast"), {}, F.lit("w"))).first()[0]["activity"] == "task"
    assert df.select(text.percent(F.lit(1), F.lit(0)).alias("p"), text.gigabytes(F.lit(1 << 30)).alias("g")).first() == (None, 1.0)
    assert re.fullmatch("[0-9A-F-]{36}", df.select(text.new_id()).first()[0])
    assert config.masked_parameters({"a": "x" * 21, "b": "x" * 20, "c": 10**30}) == {"a": "***", "b": "x" * 20, "c": 10**30}
    assert config.preview("x" * 201) == "x" * 200 + "..." and config.preview("x") == "x"
    (tmp_path / "c.yaml").write_text("a: [1, {b: '${X}'}]")
    pytest.importorskip("yaml")
    assert config.with_environment(config.load_yaml(str(tmp_path / "c.yaml")), {"X": "y"}) == {"a": [1, {"b": "y"}]}


def test_catalog(spark):
    assert tables.connections({"db": {"type": "postgres", "user": "u", "database": "d"}}, {"db_pass": "p@"})["db_conn"] == {"url": "jdbc:postgresql://localhost:5432/d", "user": "u", "password": "p@"}
    with pytest.raises(ValueError):
        tables.connection("x", {"type": "odd"})
    frames = {"a": spark.range(3).toDF("id"), "b": spark.range(2).toDF("id")}
    assert {r["action"] for r in tables.migrate(spark, frames, "copies", dry_run=True).collect()} == {"planned"}
    assert {(r["name"], r["action"], r["rows"]) for r in tables.migrate(spark, frames, "copies", "p__").collect()} == {("a", "created", 3), ("b", "created", 2)}
    assert {(r["action"], r["rows"]) for r in tables.migrate(spark, frames, "copies", "p__", only=["a"]).collect()} == {("appended", 6)}
    assert {(r["table"], r["column"]) for r in tables.reflect(spark, "copies").collect()} == {("p__a", "id"), ("p__b", "id")}
    assert not tables.ensure_table(spark, "copies.p__a", frames["a"].schema)
    spark.sql("DROP SCHEMA copies CASCADE")


def test_functions_of_sources(spark):
    source = 'class A:\n    def f(self, a: int = 1, *rest, k=None, **more):\n        """Doc."""\n        def g(): pass\n\nasync def h(x): return x\n'
    df = spark.createDataFrame([("a.py", source), ("bad.py", "def ("), ("none.py", None)], "path string, source string")
    found = code.function_rows(df, "path", "source")
    rows = {r["name"]: r for r in found.collect()}
    assert set(rows) == {"f", "g", "h"} and rows["f"]["owner"] == "A" and rows["g"]["owner"] == "A.f" and rows["f"]["docstring"] == "Doc."
    signatures = {r["name"]: r["s"] for r in found.select("name", rollups.signature(F.col("name"), F.col("args")).alias("s")).collect()}
    assert signatures == {"f": "f(self, a: int = 1, *rest, k = None, **more)", "g": "g()", "h": "h(x)"}


def test_configuration():
    assert config.with_environment({"a": ["${X}/b", 1]}, {"X": "y"}) == {"a": ["y/b", 1]}
    with pytest.raises(KeyError):
        config.with_environment("${NO}", {})
    assert config.extract({"a": {"b": 1}}, ["a.b", "a.c"], strict=False) == {"a": {"b": 1}}
    nested = {"a": {"b": [1, {"c": 2}], "d": {}}, "e": {5: "${X}"}, "f": []}
    assert config.extract(nested, ["a", "e.5"]) == {"a": nested["a"], "e": nested["e"]} and config.extract(nested, ["a.b.1.c"]) == {"a": {"b": [{"c": 2}]}}
    assert config.with_environment(nested, {"X": "y"}) == nested | {"e": {5: "y"}} and config.with_environment((1, 2), {}) == [1, 2]
    with pytest.raises(KeyError):
        config.extract({}, ["a"])
    assert config.coerced("Yes", "bool") is True and config.coerced("a, b,", "list") == ["a", "b"]
    assert config.delays(4, 1, 2, 5) == [1, 2, 4, 5] and all(0 <= d <= 5 for d in config.delays(9, 1, 2, 5, jitter=True, seed=1))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "<a>"), (2, None)], "n int, t string")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    files.write_lines(df, str(tmp_path / "t"), "n")
    assert {r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"1", "2"}
    assert files.html_table(df.where("n = 1")) == "<table><tr><th>n</th><th>t</th></tr><tr><td>1</td><td>&lt;a&gt;</td></tr></table>"
    assert column(spark, [["2024-01-01 - New - Year", "odd"]], text.dated_names, "array<string>") == [{"2024-01-01": "New - Year"}]
    assert tables.ddl("x", tables.SITE_PAGES).startswith("CREATE TABLE IF NOT EXISTS x (id long")


def test_profiles_merge_and_copy_no_rows(spark):
    rows = [(i, i % 7 or None, "x" if i % 2 else "y", [i % 3], None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b int, `c d` string, e array<int>, f double").withColumn("part", F.col("a") % 4)
    plan = reshape.profile(df.drop("part"))._jdf.queryExecution().toString() + reshape.profile(df.drop("part"), exact=True)._jdf.queryExecution().toString()
    assert "Expand" not in plan
    want = {"a": (1000, 0, 1000, "none"), "b": (1000, 143, 6, "some null"), "c d": (1000, 0, 2, "none"), "e": (1000, 0, 3, "none"), "f": (1000, 1000, 0, "all null")}
    exact = {r["column"]: (r["rows"], r["nulls"], r["distinct"], r["issue"]) for r in reshape.profile(df.drop("part"), exact=True).collect()}
    assert exact == want
    found = {r["column"]: r for r in reshape.described(reshape.merged(reshape.sketches(df, ["part"]))).collect()}
    whole = {r["column"]: r for r in reshape.described(reshape.sketches(df.drop("part"))).collect()}
    for c, (n, nulls, distinct, issue) in want.items():
        for r in (found[c], whole[c]):
            assert (r["rows"], r["nulls"], r["issue"]) == (n, nulls, issue) and abs(r["distinct"] - distinct) <= 0.05 * distinct
    assert found["a"]["quantiles"][0] == 0 and found["a"]["quantiles"][2] == 999 and abs(found["a"]["quantiles"][1] - 500) < 50
    assert found["f"]["quantiles"] is None and found["c d"]["quantiles"] is None
    assert {r["column"]: (r["rows"], r["distinct"], r["issue"]) for r in reshape.profile(df.limit(0).select("a", "f")).collect()} == {"a": (0, 0, "none"), "f": (0, 0, "none")}


def test_globs_with_sets():
    import fnmatch

    rng = random.Random(8)
    for _ in range(2000):
        pattern = "".join(rng.choice(["a", "b", "*", "?", "[ab]", "[!a]", "[a-c]", "[^b]", "[]a]", "[", ".", "\\"]) for _ in range(rng.randrange(6)))
        name = "".join(rng.choice("abcd^].[\\") for _ in range(rng.randrange(6)))
        assert bool(re.search(assertions.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_jitter():
    assert all(0 <= d <= 4 for d in config.delays(3, jitter="full", seed=1)) and config.delays(3, jitter=True, seed=1) == config.delays(3, jitter="full", seed=1)
    for base, d in zip(config.delays(50, most=8), config.delays(50, most=8, jitter="uniform", seed=2), strict=True):
        assert 0.75 * base <= d <= 1.25 * base
    with pytest.raises(ValueError):
        config.delays(1, jitter="odd")


def test_readers_by_ending(spark, tmp_path):
    (tmp_path / "t.PSV").write_text("a|b\n1|x\n")
    assert [tuple(r) for r in files.load(spark, str(tmp_path / "t.PSV")).collect()] == [("1", "x")]
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "t.odd"))

    @files.loader(".odd")
    def odd(session, path):
        return session.read.text(path).withColumnRenamed("value", "line")

    try:
        (tmp_path / "t.odd").write_text("one\ntwo\n")
        assert files.load(spark, str(tmp_path / "t.odd")).columns == ["line"]
    finally:
        del files.LOADERS["odd"]


def test_generated_values_follow_from_their_row(spark):
    df = spark.range(500).withColumn("k", F.concat(F.lit("x"), "id"))
    made = lambda d: {r["id"]: tuple(r) for r in generate.with_profile(generate.with_columns(d, "k", 4, "varchar(5):1;time:1;datetime:1", "normal", 9), "k", "medical", 4).collect()}
    assert made(df.repartition(7)) == made(df.coalesce(1)) and len({v[2:] for v in made(df).values()}) == 500
    draws = df.select("id", *[generate.distribution(n, 1, "k", **p).alias(n) for n, p in (("poisson", {"lam": 400.0}), ("gamma", {"shape": 2.5}), ("beta", {"a": 0.5}), ("binomial", {"n": 1000}))])
    assert sorted(draws.repartition(5).collect()) == sorted(draws.coalesce(1).collect())
    mean = draws.agg(F.avg("poisson"), F.avg("gamma"), F.avg("binomial")).first()
    assert mean[0] == pytest.approx(400, abs=5) and mean[1] == pytest.approx(5, abs=0.6) and mean[2] == pytest.approx(500, abs=5)
