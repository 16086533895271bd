"""Statement screen and read-only SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from eventmetrics.operators import adhoc as ad
from eventmetrics.plans.common import EV, RULES
from eventmetrics.sources import sample
from eventmetrics.sources.sample import table

# Whole documents as parts of statements: as literal, comment or free text.
STATEMENT = (
    "CASE doc_id % 6 WHEN 0 THEN 'SELECT * FROM events WHERE note = ''' || text || '''' "
    "WHEN 1 THEN 'with t as (select 1) ' || text WHEN 2 THEN '-- ' || text "
    "WHEN 3 THEN '/* ' || text || ' */ EXPLAIN ANALYZE SELECT 1' WHEN 4 THEN text "
    "ELSE 'select session_id from events -- ' || lang || chr(10) || '; analyze ' || lang END"
)

FREQUENCY_SQL = (
    "-- rows per event name\nSELECT event_name, count(*) AS event_count FROM events "
    "GROUP BY event_name ORDER BY event_count DESC"
)
ROLLUP_SQL = (
    "WITH daily AS (SELECT date_trunc('day', timestamp) AS day, event_name, count(*) AS n FROM events "
    "GROUP BY ALL) SELECT day, coalesce(event_name, 'all') AS event_name, sum(n) AS n, "
    "sum(sum(n)) OVER (PARTITION BY coalesce(event_name, 'all') ORDER BY day) AS running "
    "FROM daily GROUP BY day, ROLLUP (event_name)"
)
JOIN_SQL = (
    "SELECT r.metric_type, count(DISTINCT r.id) AS rules, max(e.names) AS names FROM alert_rules r "
    "JOIN (SELECT organization_id, count(DISTINCT event_name) AS names FROM events GROUP BY ALL) e "
    "ON e.organization_id = r.organization_id GROUP BY r.metric_type HAVING count(*) > 1"
)


def statement_screen(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.expr(STATEMENT).alias("sql"))
    return ad.screen(texts).select("doc_id", "accepted", "reason")


def _adhoc(sql, org):
    def query(spark, sf_dir):
        session = ad.tenant_session(
            spark,
            org,
            {
                "events": partial(sample.events, sf_dir=sf_dir),
                "alert_rules": partial(sample.alert_rules, sf_dir=sf_dir),
            },
        )
        result = ad.run_sql(session, sql)
        if not result.success:
            raise ValueError(result.error)
        return result.frame

    return query


QUERIES = {
    "statement_screen": statement_screen,
    "adhoc_frequency": _adhoc(FREQUENCY_SQL, "org_1"),
    "adhoc_rollup": _adhoc(ROLLUP_SQL, "org_2"),
    "adhoc_join": _adhoc(JOIN_SQL, "org_3"),
}


def _word(word: str) -> str:
    return f"regexp_matches(s, '(^|[^\\p{{L}}\\p{{N}}_]){word}([^\\p{{L}}\\p{{N}}_]|$)', 'i')"


def _screen_sql() -> str:
    stripped = (
        "trim(regexp_replace(regexp_replace(sql, '(?m)--.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), "
        "' ' || chr(9) || chr(10) || chr(13))"
    )
    words = " ".join(
        f"WHEN {_word(w)}{' AND NOT ' + _word('explain') if w == 'analyze' else ''} "
        f"THEN '{(ad.WORD_MESSAGE % w.upper()).replace(chr(39), chr(39) * 2)}'"
        for w in ad.FORBIDDEN_WORDS
    )
    start = "regexp_matches(s, '^(select|with|explain)([^\\p{L}\\p{N}_]|$)', 'i')"
    return (
        f"WITH d AS (SELECT doc_id, {STATEMENT} AS sql FROM documents), t AS (SELECT doc_id, {stripped} AS s FROM d), "
        f"r AS (SELECT doc_id, CASE WHEN s = '' THEN '{ad.EMPTY_MESSAGE}' WHEN NOT {start} "
        f"THEN '{ad.START_MESSAGE}' {words} END AS reason FROM t) "
        "SELECT doc_id, reason IS NULL AS accepted, reason FROM r"
    )


ORACLES = {
    "statement_screen": _screen_sql(),
    "adhoc_frequency": (
        f"WITH {EV} SELECT event_name, count(*) AS event_count FROM ev WHERE organization_id = 'org_1' GROUP BY ALL"
    ),
    "adhoc_rollup": (
        f"WITH {EV}, daily AS (SELECT date_trunc('day', ts) AS day, event_name, count(*) AS n FROM ev "
        "WHERE organization_id = 'org_2' GROUP BY ALL), g AS (SELECT day, coalesce(event_name, 'all') AS event_name, "
        "cast(sum(n) AS bigint) AS n FROM daily GROUP BY GROUPING SETS ((day, event_name), (day))) "
        "SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS day, event_name, n, cast(sum(n) OVER "
        "(PARTITION BY event_name ORDER BY day) AS bigint) AS running FROM g"
    ),
    "adhoc_join": (
        f"WITH {EV}, {RULES} SELECT metric_type, count(DISTINCT id) AS rules, "
        "(SELECT count(DISTINCT event_name) FROM ev WHERE organization_id = 'org_3') AS names "
        "FROM rules WHERE organization_id = 'org_3' GROUP BY metric_type HAVING count(*) > 1"
    ),
}
