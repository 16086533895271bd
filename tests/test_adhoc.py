from datetime import date

import pytest
from helpers import AS_OF, event, events

from eventmetrics.operators import adhoc as ad

REFUSED = {
    "INSERT INTO users VALUES (1)": ad.START_MESSAGE,
    "UPDATE users SET a = 1": ad.START_MESSAGE,
    "DELETE FROM users": ad.START_MESSAGE,
    "DROP TABLE users": ad.START_MESSAGE,
    "ALTER TABLE users ADD x int": ad.START_MESSAGE,
    "TRUNCATE users": ad.START_MESSAGE,
    "CREATE TABLE x (a int)": ad.START_MESSAGE,
    "SELECT 1; DROP TABLE users;": ad.WORD_MESSAGE % "DROP",
    "select 1; dRoP table users": ad.WORD_MESSAGE % "DROP",
    "SELECT 1; DROP      TABLE users": ad.WORD_MESSAGE % "DROP",
    "SET TRANSACTION READ WRITE": ad.START_MESSAGE,
    "EXECUTE something": ad.START_MESSAGE,
    "": ad.EMPTY_MESSAGE,
    "  \n-- only a comment": ad.EMPTY_MESSAGE,
    "/* x */": ad.EMPTY_MESSAGE,
    "SELECT 'drop'": ad.WORD_MESSAGE % "DROP",
    "SELECT replace(a, 'x', 'y') FROM t": ad.WORD_MESSAGE % "REPLACE",
    "SELECT /* hidden */ 1 -- x\n; vacuum": ad.WORD_MESSAGE % "VACUUM",
    "SELECT 1; analyze t": ad.WORD_MESSAGE % "ANALYZE",
    "WITH x AS (SELECT 1) update t set a = 1; insert": ad.WORD_MESSAGE % "INSERT",
    "SELECTED": ad.START_MESSAGE,
    "/* select */ table t": ad.START_MESSAGE,
}
ACCEPTED = [
    "SELECT 1 + 1 AS addition, 'hello' AS text_val",
    "  with x as (select 1) select * from x",
    "-- drop it\nSELECT session_id, created_at, updates FROM events",
    "SELECT /* update\n everything */ 1",
    "EXPLAIN ANALYZE SELECT 1",
    "explain select 1",
    "SELECT '-- ' , 1",
    "SELECT 1; SELECT 2",
    "SELECT éset FROM t",
]


def test_screen(spark):
    texts = [(s,) for s in [*REFUSED, *ACCEPTED]]
    found = {r.sql: r for r in ad.screen(spark.createDataFrame(texts, "sql string")).collect()}
    for text, reason in REFUSED.items():
        assert (found[text].accepted, found[text].reason) == (False, reason), text
    for text in ACCEPTED:
        assert found[text].accepted and found[text].reason is None, text


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("adhoc") / "events")
    table = events(
        spark, [event("a", AS_OF), event("a", AS_OF), event("b", AS_OF), event("z", AS_OF, org="org_b")]
    )
    table.write.parquet(path)
    return ad.tenant_session(spark, "org_a", {"events": lambda s: s.read.parquet(path)}), path


def test_only_own_rows(session):
    result = ad.run_sql(
        session[0],
        "-- starter\nSELECT event_name, count(*) AS event_count FROM events GROUP BY event_name "
        "ORDER BY event_count DESC",
    )
    assert result.success and result.columns == ["event_name", "event_count"]
    found, elapsed, error = ad.fetch(result, 100)
    assert found == [{"event_name": "a", "event_count": 2}, {"event_name": "b", "event_count": 1}]
    assert elapsed > 0 and error is None


def test_values_are_printable(session):
    result = ad.run_sql(
        session[0],
        "SELECT timestamp, date '2026-01-02' AS d, 1.50 AS n, 2 AS i, true AS b, array(1, 2) AS l, "
        "named_struct('x', 1) AS s, NULL AS nothing, 1 AS i FROM events LIMIT 1",
    )
    row = result.frame.first()
    assert row[:7] == ("2026-05-21 12:00:00", str(date(2026, 1, 2)), "1.50", 2, True, [1, 2], (1,))
    assert result.columns == ["timestamp", "d", "n", "i", "b", "l", "s", "nothing", "i"]


def test_errors_are_returned(session):
    for sql in (
        "DROP TABLE events",
        "SELECT * FROM nowhere",
        "SELEC 1",
        "SELECT nothing FROM events",
        f"SELECT * FROM parquet.`{session[1]}`",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT transform(event_name) USING 'cat' FROM events",
    ):
        result = ad.run_sql(session[0], sql)
        assert not result.success and result.error and result.frame is None, sql
    late = ad.run_sql(session[0], "SELECT 1 / (count(*) - 3) AS x FROM events")
    rows, _, error = ad.fetch(late, 10)
    assert late.success and rows == [] and "DIVIDE_BY_ZERO" in error


def test_tables_need_a_tenant_column(spark):
    with pytest.raises(ValueError):
        ad.tenant_session(spark, "org_a", {"plain": lambda s: s.range(3)})


OUTSIDE = {
    "SELECT java_method/**/('java.lang.Math', 'abs', -1)": "java_method",
    "SELECT `java_method`('java.lang.Math', 'abs', -1)": "java_method",
    "SELECT ReFlect('a', 'b')": "ReFlect",
    "SELECT TRANSFORM(event_name) USING/**/'cat' AS (x string) FROM events": "ScriptTransformation",
    "WITH a AS (SELECT reflect('x', 'y') r) SELECT * FROM a": "reflect",
    "SELECT (SELECT max(java_method('a', 'b')) FROM events) x": "java_method",
    "SELECT 1 FROM events WHERE EXISTS (SELECT try_reflect('a', 'b'))": "try_reflect",
    "SELECT filter(array(1, 2), x -> java_method('a', 'b') > 1)": "java_method",
    "SELECT * FROM events, LATERAL (SELECT java_method('a', 'b'))": "java_method",
    "EXPLAIN SELECT reflect('a', 'b')": "reflect",
    "SELECT no_such_function(1)": "no_such_function",
    "SELECT IDENTIFIER('java_method')('a', 'b')": "ExpressionWithUnresolvedIdentifier",
    "SELECT * FROM IDENTIFIER('saved')": "PlanWithUnresolvedIdentifier",
    "SELECT * FROM range(10)": "UnresolvedTableValuedFunction",
    "SELECT * FROM saved": "saved",
    "SELECT * FROM default.saved": "default.saved",
    "SELECT * FROM saved WHERE 1 IN (WITH saved AS (SELECT 1 AS x) SELECT x FROM saved)": "saved",
}


def test_nothing_outside_the_lists(spark, session):
    spark.sql("CREATE TABLE IF NOT EXISTS saved (x int) USING parquet")
    try:
        for sql, name in OUTSIDE.items():
            result = ad.run_sql(session[0], sql)
            assert result.error == ad.OUTSIDE_MESSAGE % name and result.frame is None, sql
        for sql in (
            "WITH a AS (SELECT 1 AS x) SELECT * FROM a JOIN events ON true",
            "SELECT upper(event_name), sum(1) OVER (PARTITION BY event_name) FROM events ORDER BY 1 LIMIT 2",
            "SELECT EXTRACT(year FROM timestamp), CAST(timestamp AS date) FROM events LATERAL VIEW explode(array(1)) t AS z",
        ):
            assert ad.run_sql(session[0], sql).success, sql
    finally:
        spark.sql("DROP TABLE saved")
