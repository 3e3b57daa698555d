"""The session's dialect and statements, with their errors."""

import decimal

import pyarrow.compute as pc
import pytest
from pyspark.errors import PySparkException

from lodestone.plans import dialect
from lodestone.plans.dialect import StatementError
from lodestone.session import Session


@pytest.fixture()
def session(spark):
    return Session(spark)


def rows(session, text):
    return sorted((tuple(r) for r in session.sql(text).collect()), key=repr)


def one(session, text):
    return tuple(session.sql(text).first())


def numbers(session, *triples, columns="v1 INT, v2 INT, v3 INT"):
    session.sql(f"CREATE TABLE t ({columns})")
    session.sql("INSERT INTO t VALUES " + ", ".join(str(x).replace("None", "NULL") for x in triples))
    return session


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT 7 / 2, -7 / 2, 7 / 2 * 2, (1 + 9) / (2 + 2)", (3, -3, 6, 2)),
        ("SELECT 100 / 7 / 2, 2 * 9 / 4", (7, 4)),
        ("SELECT 7.0::DOUBLE / 2", (3.5,)),
        ("SELECT CAST(1 AS DECIMAL(10,2)) / 8", (0.125,)),
        ("SELECT CASE WHEN 9 / 2 = 4 THEN 'int' ELSE 'float' END", ("int",)),
        ("SELECT 5 / CASE WHEN 4 / 3 = 1 THEN 2 ELSE 1 END", (2,)),
        ("SELECT '𝔘' || CAST(9 / 2 AS VARCHAR)", ("𝔘4",)),
        ("SELECT 1 + 0.1", (decimal.Decimal("1.1"),)),
        ("SELECT 3 > 4, 2 >= 2, 1 != 1, 1 <> 2", (False, True, False, True)),
        ("SELECT NULL AND FALSE, NULL OR TRUE, NOT TRUE", (False, True, False)),
        ("SELECT 1 IS NOT NULL AND 2 IS NULL", (False,)),
        ("SELECT CAST(DATE '2024-02-28' + INTERVAL 2 * 1 DAY AS STRING)", ("2024-03-01",)),
        ("SELECT EXTRACT(YEAR FROM DATE '2031-05-06'), EXTRACT(MONTH FROM DATE '2031-05-06')", (2031, 5)),
        ("SELECT 'a;b', 'it''s' -- a comment; with a semicolon", ("a;b", "it's")),
        ("SELECT x.a FROM (SELECT (SELECT 5 / 2) AS a) x WHERE x.a / 2 = 1;", (2,)),
    ],
)
def test_expressions(session, text, want):
    assert one(session, text) == want


@pytest.mark.parametrize("text", ["SELECT 1 / 0", "SELECT CAST('x' AS INT)", "SELECT * FORM t", "SELECT 9223372036854775807 + 1", "SELECT a FROM nowhere", "SELECT v1, COUNT(*) FROM t", "SELECT COUNT(v1) FROM t GROUP BY COUNT(v1)", "SELECT v1 FROM t GROUP BY v2", "SELECT nope(1)", "SELECT (1"])
def test_spark_refuses(session, text):
    numbers(session, (1, 2, 3))
    with pytest.raises(PySparkException):
        session.sql(text).collect()


@pytest.mark.parametrize(
    "text",
    [
        "", "FROB x", "SELECT 1; SELECT 2", "SELECT 'open", "WITH a AS (SELECT 1), a AS (SELECT 2) SELECT 1", "SELECT CAST(1 AS DECIMAL(40, 2))",
        "CREATE TABLE", "CREATE TABLE x", "CREATE TABLE x (a INT, a INT)", "CREATE TABLE x (a INT FUNNY)", "CREATE TABLE no.such.x (a INT)", "DROP TABLE nowhere", "DROP SCHEMA nowhere",
        "INSERT INTO nowhere VALUES (1)", "INSERT INTO t VALUES (1)", "INSERT INTO t (v1, v1) VALUES (1, 2)", "INSERT INTO t (zz) VALUES (1)", "INSERT INTO t VALUES (1, 2, 3), (1, 2)", "INSERT INTO t VALUES (1, 2, 3) ON CONFLICT (v1) DO DANCE", "INSERT INTO t VALUES (1, 2, 3) ON CONFLICT DO NOTHING", "INSERT INTO t VALUES (1, 2, 3), (1, 2, 3) ON CONFLICT (v1) DO UPDATE SET v2 = 0", "SELECT * FROM read_csv('x', columns = {'a'})", "INSERT INTO t VALUES (1, 2, 3) garbage",
        "INSERT INTO strict VALUES (NULL, 1)", "INSERT INTO strict (b) VALUES (1)", "UPDATE strict SET a = NULL", "UPDATE t SET v1", "DELETE FROM nowhere", "DELETE FROM t garbage", "COPY t FROM 5", "COPY t FROM 'x' (FORMAT json)", "COPY t TO 'x' (COLOUR red)", "SHOW WINDOWS",
        "SELECT * FROM read_csv(5)", "SELECT * FROM read_json('x', header = true)", "SELECT DATE '2020-01-01' + INTERVAL '1.5' DAY", "SELECT DATE '2020-01-01' + INTERVAL 1 / 0 DAY",
    ],
)
def test_engine_refuses(session, text):
    numbers(session, (1, 2, 3))
    session.sql("CREATE TABLE strict (a INT NOT NULL, b INT)")
    session.sql("INSERT INTO strict VALUES (1, 1)")
    with pytest.raises(StatementError):
        session.sql(text).collect()


def test_names_fold(session):
    session.sql("CREATE TABLE Mixed (Aa INT)")
    session.sql("INSERT INTO mIXED VALUES (4)")
    assert rows(session, "SELECT aA FROM MIXED") == [(4,)]
    assert rows(session, "SELECT m.aa FROM lodestone.public.mixed m") == [(4,)]
    assert rows(session, "SELECT public.mixed.aa FROM public.mixed") == [(4,)]


def test_catalogs(session, spark):
    session.register_catalog("Lake", "raw")
    session.register_table("lake.raw.t", spark.range(3))
    assert rows(session, "SELECT MAX(t.id) FROM lake.raw.t") == [(2,)]
    assert rows(session, "SELECT catalog_name, schema_name FROM information_schema.tables") == [("lake", "raw")]


def test_catalog_names_in_queries(session, spark):
    session.register_catalog("lake", "raw", "clean")
    session.register_table("lake.raw.t", spark.range(3))
    session.register_table("lake.clean.t", spark.range(2, 5))
    assert rows(session, "SELECT t.id, lake.raw.t.id FROM lake.raw.t WHERE t.id > 1") == [(2, 2)]
    assert rows(session, "SELECT t.* FROM lake.raw.t LIMIT 1") == [(0,)]
    assert rows(session, "SELECT x.id FROM lake.raw.t x JOIN lake.clean.t AS y ON x.id = y.id") == [(2,)]
    assert rows(session, "SELECT lake.raw.t.id FROM lake.raw.t JOIN lake.clean.t ON lake.raw.t.id = lake.clean.t.id") == [(2,)]
    assert rows(session, "SELECT id FROM lake.raw.t WHERE id IN (SELECT t.id FROM lake.clean.t WHERE t.id < 9)") == [(2,)]
    assert rows(session, "SELECT COUNT(*) FROM lake.raw.t, lake.clean.t c WHERE EXTRACT(YEAR FROM DATE '2020-01-01') = 2020") == [(9,)]


def test_distinct_on(session, spark):
    session.register_table("u", spark.sql("SELECT id % 1000 AS k, id AS x, id % 7 AS __place FROM range(5000)"))
    got = [r[0] for r in session.sql("SELECT DISTINCT ON (k) k, x FROM u ORDER BY k DESC, x LIMIT 5").collect()]
    assert got == [999, 998, 997, 996, 995]
    assert rows(session, "SELECT SUM(d.x) FROM (SELECT DISTINCT ON (k % 2) x FROM u ORDER BY k % 2, x DESC) d") == [(4999 + 4998,)]
    assert rows(session, "SELECT DISTINCT ON (1) __place, MAX(x) AS m FROM u GROUP BY __place ORDER BY 1, m DESC LIMIT 2") == [(0, 4998), (1, 4999)]
    assert rows(session, "WITH f AS (SELECT DISTINCT ON (k) k, x FROM u ORDER BY x DESC) SELECT MIN(x) FROM f") == [(4000,)]
    assert rows(session, "SELECT DISTINCT ON (__place) __place FROM u WHERE k IN (SELECT DISTINCT ON (k) k FROM u ORDER BY k DESC LIMIT 3)") == [(i,) for i in range(7)]
    assert session.sql("SELECT DISTINCT ON (k) * FROM u").columns == ["k", "x", "__place"]


def test_upserts_and_returning(session):
    session.sql("CREATE TABLE p (k INT PRIMARY KEY, v INT)")
    assert rows(session, "INSERT INTO p VALUES (1, 10), (2, 20) RETURNING k, v / 3 AS third") == [(1, 3), (2, 6)]
    assert one(session, "INSERT INTO p VALUES (2, 21), (3, 30), (3, 31) ON CONFLICT DO NOTHING") == (1,)
    assert one(session, "INSERT INTO p AS q (v, k) VALUES (5, 1), (6, 4) ON CONFLICT (k) DO UPDATE SET v = p.v + excluded.v") == (2,)
    assert rows(session, "SELECT * FROM p") == [(1, 15), (2, 20), (3, 30), (4, 6)]


def test_many_values(session):
    numbers(session, *((i, -i, None) for i in range(3000)))
    assert rows(session, "SELECT COUNT(*), SUM(v1), SUM(v2), COUNT(v3) FROM t") == [(3000, 4498500, -4498500, 0)]


def test_filters_and_groups(session):
    numbers(session, (1, 4, 2), (2, 3, 3), (3, 4, 4), (4, 3, 5))
    assert rows(session, "SELECT v1, v3 FROM t WHERE v2 > 3") == [(1, 2), (3, 4)]
    assert rows(session, "SELECT v1 + v2 FROM t") == [(5,), (5,), (7,), (7,)]
    assert rows(session, "SELECT SUM(v1), COUNT(v3), MIN(v3), MAX(v1) FROM t GROUP BY v2, v2") == [(4, 2, 2, 3), (6, 2, 3, 4)]
    assert rows(session, "SELECT COUNT(v3) = MIN(v3) FROM t GROUP BY v2") == [(False,), (True,)]
    assert rows(session, "SELECT v2 + 1 AS k, COUNT(*) * 2 FROM t GROUP BY k HAVING k > 4") == [(5, 4)]
    assert rows(session, "SELECT -COUNT(*), SUM(v1) + SUM(v2) FROM t WHERE 1 = 0") == [(0, None)]
    assert rows(session, "SELECT DISTINCT v2 FROM t") == [(3,), (4,)]
    assert rows(session, "SELECT DISTINCT ON (v2) v2, v1 FROM t ORDER BY v1 DESC") == [(3, 4), (4, 3)]


def test_nulls(session):
    numbers(session, (1, 1, None), (None, 2, 1), (None, 3, 2), (4, None, 3))
    assert rows(session, "SELECT v2 FROM t WHERE v1 > 0 AND v2 IS NOT NULL AND v3 IS NULL") == [(1,)]
    assert rows(session, "SELECT v2 FROM t WHERE v1 IS NULL") == [(2,), (3,)]
    assert [r[0] for r in session.sql("SELECT v1 FROM t WHERE v3 IS NOT NULL ORDER BY v1 DESC, v2").collect()] == [None, None, 4]
    assert rows(session, "SELECT v3 FROM t WHERE v1 NOT IN (1, NULL)") == []
    assert rows(session, "SELECT COUNT(*), COUNT(v1), SUM(v1), MAX(v2) FROM t") == [(4, 2, 5, 3)]


def test_limits(session):
    numbers(session, *((i, i, i) for i in range(6)))
    ordered = "SELECT v1 FROM t ORDER BY v1 "
    for tail, want in (("LIMIT 2", [0, 1]), ("OFFSET 4", [4, 5]), ("LIMIT 2 OFFSET 1", [1, 2]), ("OFFSET 1 LIMIT 2", [1, 2]), ("LIMIT 0", []), ("OFFSET 9", []), ("LIMIT 99", list(range(6)))):
        assert [r[0] for r in session.sql(ordered + tail).collect()] == want


def test_joins(session):
    session.sql("CREATE TABLE x (a INT, b INT)")
    session.sql("CREATE TABLE y (c INT, d INT)")
    assert rows(session, "SELECT * FROM x FULL JOIN y ON a = c") == []
    session.sql("INSERT INTO x VALUES (1, 20), (1, 30), (3, 40), (NULL, 50)")
    session.sql("INSERT INTO y VALUES (1, 25), (2, 70), (NULL, 80)")
    assert rows(session, "SELECT b, d FROM x JOIN y ON a = c AND b < d") == [(20, 25)]
    assert rows(session, "SELECT b, d FROM x LEFT JOIN y ON a = c") == [(20, 25), (30, 25), (40, None), (50, None)]
    assert rows(session, "SELECT b, d FROM x RIGHT JOIN y ON a = c") == [(20, 25), (30, 25), (None, 70), (None, 80)]
    assert len(rows(session, "SELECT * FROM x FULL JOIN y ON a = c")) == 6
    assert len(rows(session, "SELECT * FROM x CROSS JOIN y")) == len(rows(session, "SELECT * FROM x, y")) == 12
    assert rows(session, "SELECT y.* FROM x, y WHERE a = c AND b = 20") == [(1, 25)]


def test_changes(session):
    numbers(session, (1, 10, 100), (2, None, 200), (3, 30, 300))
    assert one(session, "DELETE FROM t WHERE v2 > 15") == (1,)
    assert rows(session, "SELECT v1 FROM t") == [(1,), (2,)]
    assert one(session, "UPDATE t SET v2 = v3 / 3, v1 = v1 + 10 WHERE v2 IS NULL") == (1,)
    assert rows(session, "SELECT * FROM t") == [(1, 10, 100), (12, 66, 200)]
    assert one(session, "INSERT INTO t (v3, v1) SELECT v1, v2 FROM t") == (2,)
    assert rows(session, "SELECT * FROM t WHERE v2 IS NULL") == [(10, None, 1), (66, None, 12)]
    for _ in range(10):  # past the point where lineage is cut
        session.sql("UPDATE t SET v1 = v1 + 1")
    assert rows(session, "SELECT MIN(v1) FROM t") == [(11,)]
    assert one(session, "DELETE FROM t") == (4,)
    assert rows(session, "SELECT * FROM t") == []


def test_divisions_of_other_texts(session, spark):
    session.register_table("t", spark.sql("SELECT id / 4 AS quarter, id FROM range(7, 9)"))
    assert rows(session, "SELECT quarter, id / 2 FROM t") == [(1.75, 3), (2.0, 4)]
    assert one(session, "DELETE FROM t WHERE id / 2 = 3") == (1,)
    session.sql("UPDATE t SET id = CASE WHEN id / 3 = 2 THEN id / 3 / 2 ELSE 0 END")
    assert rows(session, "SELECT id FROM t") == [(1,)]


def test_ctas_and_short_forms(session):
    numbers(session, (1, 2, 3))
    session.sql("CREATE TABLE u AS SELECT v1 AS k, v2 / 2 AS h FROM t")
    session.sql("CREATE TABLE w AS FROM u")
    session.sql("INSERT INTO w FROM u")
    assert rows(session, "SELECT * FROM w") == [(1, 1), (1, 1)]
    session.sql("CREATE TABLE IF NOT EXISTS w (other VARCHAR)")
    assert session.table("w").columns == ["k", "h"]
    session.sql("DROP TABLE w")
    session.sql("DROP TABLE IF EXISTS w")
    assert ("w",) not in rows(session, "SELECT table_name FROM information_schema.tables")
    assert len(rows(session, "SHOW TABLES")) == 2


def test_files(session, tmp_path):
    (tmp_path / "a.csv").write_text('id;"name"\n1;"x;y"\n2;z\n')
    (tmp_path / "b.tbl").write_text("1|one|2.50|\n2|two||\n")
    (tmp_path / "c.json").write_text('{"id": 1, "tags": [1, 2]}\n{"id": 2, "tags": []}\n')
    assert rows(session, f"SELECT id, name FROM read_csv('{tmp_path}/a.csv', delim = ';')") == [(1, "x;y"), (2, "z")]
    assert session.sql(f"SELECT id FROM read_csv('{tmp_path}/a.csv', delim = ';')").dtypes == [("id", "bigint")]
    assert rows(session, f"SELECT COUNT(*) FROM read_csv('{tmp_path}/a.csv', header = false) f") == [(3,)]
    assert rows(session, f"SELECT id, tags[0] FROM read_json('{tmp_path}/c.json') WHERE id = 1") == [(1, 1)]
    session.sql("CREATE TABLE l (k INT, w VARCHAR, p DECIMAL(15,2), rev VARCHAR)")
    assert one(session, f"COPY l FROM '{tmp_path}/b.tbl' (DELIMITER '|')") == (2,)
    assert rows(session, "SELECT k, w, p FROM l") == [(1, "one", decimal.Decimal("2.50")), (2, "two", None)]
    assert one(session, f"COPY (SELECT k FROM l) TO '{tmp_path}/out' (FORMAT parquet)") == (2,)
    assert rows(session, f"SELECT k FROM read_parquet('{tmp_path}/out')") == [(1,), (2,)]


def test_functions(session):
    session.register_udf("Twice", lambda x: pc.multiply(x, 2), "long")
    numbers(session, (1, 2, 3))
    assert rows(session, "SELECT twice(v3), TWICE(v1) + 1 FROM t") == [(6, 3)]


def test_aggregate_and_table_functions(session):
    session.register_udaf("spread", lambda x: float(pc.subtract(pc.max(x), pc.min(x)).as_py()), "double")
    numbers(session, (1, 4, 2), (1, 9, 3), (2, 5, 4))
    assert rows(session, "SELECT v1, spread(v2) FROM t GROUP BY v1") == [(1, 5.0), (2, 0.0)]

    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield i, i * i

    session.register_udtf("upto", Upto, "i int, square int")
    assert rows(session, "SELECT * FROM upto(3)") == [(0, 0), (1, 1), (2, 4)]
    assert rows(session, "SELECT v3, square FROM t, LATERAL upto(CAST(v1 AS INT)) WHERE v1 = 2") == [(4, 0), (4, 1)]


def test_defaults(session, spark):
    session.register_table("p", spark.createDataFrame([], "id long, name string"), defaults={"name": "nobody"}, required=("id",))
    session.sql("INSERT INTO p (id) VALUES (1)")
    assert rows(session, "SELECT * FROM p") == [(1, "nobody")]
    with pytest.raises(StatementError):
        session.sql("INSERT INTO p (name) VALUES ('x')")


@pytest.mark.parametrize("text", ["SELECT a.b, c[1], f(x) FROM t WHERE y = 'q' -- end", "SELECT \"odd name\" FROM t", "SELECT 1.5e3, .5, 2L"])
def test_tokens_survive(text):
    tokens = dialect.tokens_of(text)
    assert dialect.tokens_of(dialect.text_of(tokens)) == tokens
