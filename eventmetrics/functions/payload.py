"""Columns read out of an event: payload properties, identity, event classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Event names that count as a page view or an error, and the
# payload keys that identify a session and a visitor, in order of preference.
PAGE_VIEW_NAMES = ("page_view", "page.view")
ERROR_NAME = "error"
SESSION_KEY = "session_id"
VISITOR_KEYS = ("user_id", "visitor_id", "anonymous_id")


def _struct_of(keys: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(key, T.StringType()) for key in keys])


def prop(key: str, payload: str = "payload") -> Column:
    """Top-level payload property as text; NULL when missing or JSON null.

    ``from_json`` is used instead of a JSON path because a path cannot name
    every key (quotes, question marks) and because the last of two equal keys
    must win.
    """
    return F.from_json(F.col(payload), _struct_of((key,))).getField(key)


def properties(payload: str = "payload") -> Column:
    """All top-level properties as ``map<string,string>``, for keys known per row only."""
    return F.from_json(F.col(payload), T.MapType(T.StringType(), T.StringType()))


def last_value(entries: str, key: Column) -> Column:
    """Value of a key known per row only; of equal keys the last one, as ``prop`` has it."""
    found = F.filter(F.map_entries(entries), lambda e: e.getField("key") == key)
    return F.try_element_at(found, F.lit(-1)).getField("value")


def with_identity(events: DataFrame) -> DataFrame:
    """Add ``session_id`` and ``visitor_id``.

    Stored events carry both as columns (see ``sources.store``), so a query
    over the store parses no JSON; otherwise the payload is parsed once per row.
    """
    if "session_id" in events.columns and "visitor_id" in events.columns:
        return events
    parsed = F.from_json(F.col("payload"), _struct_of((SESSION_KEY, *VISITOR_KEYS)))
    return (
        events.withColumn("_identity", parsed)
        .withColumns(
            {
                "session_id": F.col("_identity").getField(SESSION_KEY),
                "visitor_id": F.coalesce(*[F.col("_identity").getField(k) for k in VISITOR_KEYS]),
            }
        )
        .drop("_identity")
    )


def is_page_view(name: str = "event_name") -> Column:
    return F.col(name).isin(*PAGE_VIEW_NAMES)


def is_error(name: str = "event_name") -> Column:
    return F.col(name) == ERROR_NAME
