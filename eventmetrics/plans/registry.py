"""All named queries and their SQL."""

from __future__ import annotations

from eventmetrics.plans import adhoc, alerting, analytics, ingest, live, reporting

MODULES = (analytics, alerting, ingest, reporting, adhoc, live)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        part = getattr(module, attribute)
        if clash := merged.keys() & part.keys():
            raise ValueError(f"query names used twice: {sorted(clash)}")
        merged |= part
    return merged


def in_utc(query):
    """Run a query with the session in UTC, the time zone of all stored times."""

    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: in_utc(query) for name, query in _merged("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
