"""Read-only SQL over one tenant's tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# What a statement may start with, the words it must not
# contain (checked in this order), and the messages of the screen.
ALLOWED_STARTS = ("SELECT", "WITH", "EXPLAIN")
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "drop", "alter", "truncate", "create",
    "replace", "grant", "revoke", "session", "transaction", "set", "execute",
    "vacuum", "analyze",
)
EMPTY_MESSAGE = "Query string is empty."
START_MESSAGE = "Security violation: Only SELECT, WITH, or EXPLAIN statements are permitted."
WORD_MESSAGE = "Security violation: Forbidden database operation '%s' detected."

# Functions a statement may call, and the kinds of plan nodes it may be made of.
# Whatever is not named here is refused, so a new function of the engine that
# reads files or runs code is refused as well.
FUNCTIONS = frozenset(
    """
    abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max
    array_min array_position array_size array_sort ascii asin atan atan2 avg bool_and bool_or bround btrim cardinality
    cast cbrt ceil ceiling char_length character_length chr coalesce collect_list collect_set concat concat_ws contains
    corr cos count count_if covar_pop covar_samp cume_dist current_date current_timestamp date date_add date_diff
    date_format date_from_unix_date date_part date_sub date_trunc datediff day dayname dayofmonth dayofweek dayofyear
    decode degrees dense_rank element_at elt endswith equal_null every exp explode explode_outer extract filter first
    first_value flatten floor from_json from_unixtime get get_json_object greatest hash hex histogram_numeric hour if
    ifnull ilike initcap instr isnan isnotnull isnull json_array_length json_object_keys kurtosis lag last last_day
    last_value lcase lead least left len length levenshtein like ln locate log log10 log2 lower lpad ltrim make_date
    make_timestamp map map_contains_key map_entries map_from_arrays map_from_entries map_keys map_values max max_by
    md5 mean median min min_by minute mod mode month months_between named_struct nanvl now ntile nth_value nullif nvl
    nvl2 overlay percent_rank percentile percentile_approx percentile_cont percentile_disc pi pmod position
    posexplode posexplode_outer pow power quarter radians rank regexp regexp_count regexp_extract regexp_extract_all
    regexp_instr regexp_like regexp_replace regexp_substr regr_slope replace reverse right rint rlike round row_number
    rpad rtrim second sequence sha1 sha2 sign signum sin size skewness slice some sort_array split split_part sqrt
    startswith std stddev stddev_pop stddev_samp struct substr substring substring_index sum tan timestamp
    timestamp_micros timestamp_millis timestamp_seconds to_char to_date to_json to_number to_timestamp transform
    translate trim trunc try_add try_avg try_cast try_divide try_element_at try_multiply try_subtract try_sum
    try_to_number try_to_timestamp typeof ucase unbase64 unhex unix_date unix_micros unix_millis unix_seconds
    unix_timestamp upper var_pop var_samp variance weekday weekofyear width_bucket window xxhash64 year
    """.split()
)
NODES = frozenset(
    """
    Aggregate Distinct Except ExplainCommand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit
    LocalRelation Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedInlineTable
    UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition
    """.split()
)
OUTSIDE_MESSAGE = "Security violation: The statement uses '%s', which is not available here."


def screen(statements: DataFrame, column: str = "sql") -> DataFrame:
    """Add ``accepted`` and ``reason`` to a table of SQL texts.

    Comments are removed first, even inside literals, and words are matched
    wherever they occur; ``analyze`` passes in a statement that says
    ``explain``. One expression finds all words in one reading, and only in
    texts that start like a query.
    """
    text = F.regexp_replace(F.col(column), r"(?md)--.*$", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    empty = ~F.col("_text").rlike(r"(?U)\S")
    starts = F.col("_text").rlike(rf"(?iU)^\s*({'|'.join(ALLOWED_STARTS)})\b")
    words = F.regexp_extract_all(
        F.lower("_text"), F.lit(rf"(?U)\b({'|'.join(FORBIDDEN_WORDS)}|explain)\b"), F.lit(1)
    )
    reason: Column = F.when(empty, F.lit(EMPTY_MESSAGE)).when(
        F.col("_words").isNull(), F.lit(START_MESSAGE)
    )
    for word in FORBIDDEN_WORDS:
        hit = F.array_contains("_words", word)
        if word == "analyze":
            hit = hit & ~F.array_contains("_words", "explain")
        reason = reason.when(hit, F.lit(WORD_MESSAGE % word.upper()))
    return (
        statements.withColumn("_text", text)
        .withColumn("_words", F.when(starts, words))
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .drop("_text", "_words")
    )


def tenant_session(
    spark: SparkSession, org: str, tables: dict[str, Callable[[SparkSession], DataFrame]]
) -> SparkSession:
    """A session that sees one tenant's rows of ``tables`` as views and no files.

    Views live in a session of their own, and reading files by path is off.
    ``run_sql`` lets a statement name only these views and its own common table
    expressions, so tables of a shared catalog stay out of sight.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, load in tables.items():
        table = load(session)
        if "organization_id" not in table.columns:
            raise ValueError(f"table {name} has no organization_id to filter by")
        table.filter(F.col("organization_id") == org).createOrReplaceTempView(name)
    session.conf.set(VIEWS, ",".join(tables))
    return session


# Where a tenant session keeps the names of its views.
VIEWS = "spark.eventmetrics.views"


class _Parsed:
    """A parsed, unresolved statement: every node in it, subqueries and common table expressions included."""

    PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"

    def __init__(self, session: SparkSession, sql: str) -> None:
        self._gateway = session.sparkContext._gateway
        open_ = [session._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
        self.nodes = []
        while open_:
            value = open_.pop()
            if not isinstance(value, JavaObject):  # numbers, texts, booleans and nulls
                continue
            # Plans, expressions and tuples list their fields; collections and options their elements.
            if self._is(value, "scala.collection.Iterable") or self._is(value, "scala.Option"):
                open_.extend(self.elements(value.iterator()))
            elif self._is(value, "scala.Product"):
                name = value.getClass().getName()
                if name.startswith("org.apache.spark.sql."):
                    self.nodes.append((name.rpartition(".")[2].rstrip("$"), self._is(value, self.PLAN), value))
                open_.extend(self.elements(value.productIterator()))

    def _is(self, value: JavaObject, kind: str) -> bool:
        return is_instance_of(self._gateway, value, kind)

    @staticmethod
    def elements(iterator: JavaObject) -> list:
        found = []
        while iterator.hasNext():
            found.append(iterator.next())
        return found


def outside(session: SparkSession, sql: str) -> str | None:
    """The first thing in a statement that is not on the lists; the statement is parsed, not run."""
    parsed = _Parsed(session, sql)
    views = {name.lower() for name in session.conf.get(VIEWS, "").split(",") if name}
    for kind, _, node in parsed.nodes:
        if kind == "UnresolvedWith":
            named = {relation._1() for relation in parsed.elements(node.cteRelations().iterator())}
            # Such a name holds only inside its clause; outside it would reach a saved table of that name.
            if clash := [n for n in named if n.lower() not in views and session.catalog.tableExists(n)]:
                return min(clash)
            views |= {n.lower() for n in named}
    for kind, plan, node in parsed.nodes:
        parts, known = [kind], True
        if kind == "UnresolvedFunction":
            parts, known = parsed.elements(node.nameParts().iterator()), FUNCTIONS
        elif kind == "UnresolvedGenerator":
            parts, known = [node.name().unquotedString()], FUNCTIONS
        elif kind == "UnresolvedRelation":
            parts, known = parsed.elements(node.multipartIdentifier().iterator()), views
        elif plan:
            known = {name.lower() for name in NODES}
        elif "Identifier" in kind and kind.startswith(("PlanWith", "ExpressionWith")):
            known = ()
        if known is not True and (len(parts) != 1 or parts[0].lower() not in known):
            return ".".join(parts)
    return None


@dataclass
class SqlResult:
    """Outcome of a statement; ``frame`` is not computed yet."""

    success: bool
    error: str | None = None
    columns: list[str] | None = None
    frame: DataFrame | None = None


def printable(frame: DataFrame) -> DataFrame:
    """Keep numbers, booleans, texts and nested values; everything else becomes text."""
    kept = (T.NumericType, T.BooleanType, T.StringType, T.ArrayType, T.MapType, T.StructType)
    names = [f"c{i}" for i in range(len(frame.columns))]
    columns = []
    for name, field in zip(names, frame.schema.fields):
        column = F.col(name)
        if isinstance(field.dataType, T.DecimalType) or not isinstance(field.dataType, kept):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return frame.toDF(*names).select(*columns)


def run_sql(session: SparkSession, sql: str) -> SqlResult:
    """Screen and plan one statement in a tenant session; errors are returned, not raised."""
    verdict = screen(session.sql("SELECT :sql AS sql", args={"sql": sql})).first()
    if not verdict.accepted:
        return SqlResult(False, verdict.reason)
    try:
        if found := outside(session, sql):
            return SqlResult(False, OUTSIDE_MESSAGE % found)
        frame = printable(session.sql(sql))
    except PySparkException as error:
        return SqlResult(False, str(error))
    return SqlResult(True, None, frame.columns, frame)


def fetch(result: SqlResult, rows: int) -> tuple[list[dict], float, str | None]:
    """The first ``rows`` rows as dicts, elapsed milliseconds and the error, if any."""
    if result.frame is None:
        return [], 0.0, result.error
    begin = time.perf_counter()
    try:
        found = [r.asDict(recursive=True) for r in result.frame.limit(rows).collect()]
        return found, (time.perf_counter() - begin) * 1000.0, None
    except PySparkException as error:
        return [], (time.perf_counter() - begin) * 1000.0, str(error)
