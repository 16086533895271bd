import hashlib
import json
import re
from datetime import timedelta

import pytest
from helpers import AS_OF, ago, event, events, local, rows, utc
from pyspark.sql import functions as F

from eventmetrics import schema
from eventmetrics.functions import dates, text
from eventmetrics.operators import access as ac
from eventmetrics.sources import events as src
from eventmetrics.sources import store

SOURCE = "11111111-2222-3333-4444-555555555555"


def write(path, name, content):
    target = path / name
    target.write_text(content, encoding="utf-8")
    return str(target)


def test_json_lines(spark, tmp_path):
    lines = [
        {"event_name": "user.login", "timestamp": "2026-05-21T10:00:00Z", "payload": {"ip": "1.2.3.4", "n": 1}, "data_source_id": SOURCE},
        {"event_name": "a" * 255},
        {"event_name": "a" * 256},
        {"event_name": ""},
        {"payload": {}},
        {"event_name": "x", "timestamp": "yesterday"},
        {"event_name": "x", "timestamp": "2026"},
        {"event_name": "x", "payload": [1]},
        {"event_name": "x", "payload": "text"},
        {"event_name": "x", "data_source_id": "nope"},
        [{"event_name": "one"}, {"event_name": "two", "timestamp": "2026-05-21T12:00:00+02:00"}],
    ]
    path = write(tmp_path, "in.jsonl", "\n".join(map(json.dumps, lines)) + "\n{broken")
    found, rejected = src.read_json_events(spark, path, "org_a", AS_OF)
    got = {r.event_name: r for r in found.collect()}
    assert set(got) == {"user.login", "a" * 255, "one", "two"}
    login = got["user.login"]
    assert json.loads(login.payload) == {"ip": "1.2.3.4", "n": 1}
    assert (login.organization_id, login.data_source_id) == ("org_a", SOURCE)
    assert login.timestamp == local(utc(2026, 5, 21, 10))
    assert got["one"].timestamp == local(AS_OF) and got["one"].payload == "{}"
    assert got["two"].timestamp == local(utc(2026, 5, 21, 10))
    assert len({r.id for r in got.values()}) == 4
    reasons = sorted(r.reason for r in rejected.select("reason").collect())
    assert reasons == sorted(
        ["event_name_too_long", "event_name_missing", "event_name_missing", "bad_timestamp", "bad_timestamp"]
        + ["bad_payload", "bad_payload", "bad_data_source_id", "not_json"]
    )


def test_csv(spark, tmp_path):
    path = write(
        tmp_path,
        "in.csv",
        "event_name,timestamp,user_id,plan,a.b\n"
        "csv.import.first,2026-05-21T12:00:00+00:00,user_99,enterprise,1\n"
        'csv.import.second,2026-05-21T12:05:00Z,user_100,"free\nforever",\n'
        ",2026-05-21T12:05:00Z,user_101,free,2\n"
        "late,never,,,\n",
    )
    found, rejected = src.read_csv_events(spark, path, "org_a", "src", AS_OF)
    got = {r.event_name: r for r in found.collect()}
    assert set(got) == {"csv.import.first", "csv.import.second", "late"}
    assert json.loads(got["csv.import.first"].payload) == {"user_id": "user_99", "plan": "enterprise", "a.b": "1"}
    assert json.loads(got["csv.import.second"].payload) == {"user_id": "user_100", "plan": "free\nforever", "a.b": ""}
    assert got["csv.import.second"].timestamp == local(utc(2026, 5, 21, 12, 5))
    assert got["late"].timestamp == local(AS_OF)
    assert rows(rejected, "reason") == [("event_name_missing",)]


def test_csv_other_names_and_no_payload(spark, tmp_path):
    path = write(tmp_path, "in.csv", "event,time\nalpha,2026-05-21T01:00:00\n")
    found, _ = src.read_csv_events(spark, path, "org_a", "src", AS_OF)
    one = found.first()
    assert (one.event_name, one.payload) == ("alpha", "{}")
    assert one.timestamp == local(utc(2026, 5, 21, 1))


def test_csv_without_events(spark, tmp_path):
    with pytest.raises(ValueError):
        src.read_csv_events(spark, write(tmp_path, "empty.csv", ""), "o", "s", AS_OF)
    with pytest.raises(ValueError):
        src.read_csv_events(spark, write(tmp_path, "none.csv", "event_name,x\n,1\n"), "o", "s", AS_OF)


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(
        [
            ("hook", "org_a", "h", "webhook", {"event_name_path": "kind", "timestamp_path": "at"}, True, False),
            ("plain", "org_a", "h", "webhook", None, True, False),
            ("off", "org_a", "h", "webhook", None, False, False),
            ("gone", "org_a", "h", "webhook", None, True, True),
            ("file", "org_a", "h", "csv", None, True, False),
            ("theirs", "org_b", "h", "api", None, True, False),
        ],
        schema.DATA_SOURCES,
    )


def test_webhooks(spark, sources):
    raw = spark.createDataFrame(
        [
            ("hook", '{"kind":"push","at":"2026-05-21T10:00:00Z","ref":"main","repository":{"name":"x"}}'),
            ("hook", '{"event":"ignored"}'),
            ("plain", '{"event":"push","timestamp":1747821600}'),
            ("plain", '{"a.b":1}'),
            ("off", "{}"),
            ("gone", "{}"),
            ("file", "{}"),
            ("none", "{}"),
            ("plain", "[1]"),
            ("plain", "text"),
        ],
        "source_id string, body string",
    )
    found, rejected = src.read_webhook_events(raw, sources, AS_OF)
    got = rows(found, "data_source_id", "event_name", "timestamp")
    assert got == [
        ("hook", "push", local(utc(2026, 5, 21, 10))),
        ("hook", "webhook_event", local(AS_OF)),
        ("plain", "push", local(AS_OF)),
        ("plain", "webhook_event", local(AS_OF)),
    ]
    assert json.loads(found.filter("event_name = 'push' AND data_source_id = 'hook'").first().payload)["kind"] == "push"
    assert rows(rejected, "source_id", "reason") == [
        ("file", "source_not_found"),
        ("gone", "source_not_found"),
        ("none", "source_not_found"),
        ("off", "source_not_found"),
        ("plain", "not_json"),
        ("plain", "not_json"),
    ]


def test_source_gate(spark, sources):
    table = events(
        spark,
        [event("x", AS_OF, source=s) for s in (None, "file", "off", "gone", "theirs", "none")]
        + [event("x", AS_OF, org="org_b", source="theirs")],
    ).withColumn("batch", F.when(F.col("organization_id") == "org_b", "b").otherwise("a"))
    accepted, rejected = ac.gate_sources(table, sources)
    assert rows(accepted, "data_source_id") == [("file",), ("theirs",), (None,)]
    assert rejected.count() == 4
    whole, refused = ac.gate_sources(table, sources, batch="batch")
    assert rows(whole, "organization_id") == [("org_b",)]
    assert sorted({r.reason for r in refused.collect()}) == ["batch_source_not_usable", "source_not_usable"]
    assert refused.count() == 6
    typed, _ = ac.gate_sources(table, sources, source_type="csv")
    assert rows(typed, "data_source_id") == [("file",), (None,)]


def test_normalise(spark):
    uid = "0" * 32
    queue = spark.createDataFrame(
        [
            (uid, uid, None, "a", "2026-05-21T10:00:00Z", None, 1),
            (None, uid, None, "b", None, '{"x":1}', 1),
            ("bad", uid, None, "c", None, "{}", 2),
            (uid, uid, None, "d", None, "{}", 2),
            (uid, uid, "bad", "e", "when", "{}", 3),
        ],
        "id string, organization_id string, data_source_id string, event_name string, timestamp string, payload string, batch int",
    )
    accepted, rejected = src.normalise(queue, AS_OF)
    assert rows(accepted, "event_name", "payload") == [("a", "{}"), ("b", '{"x":1}'), ("d", "{}")]
    assert accepted.filter("id IS NULL").isEmpty()
    assert rows(rejected, "event_name", "reason") == [("c", "bad_id"), ("e", "bad_timestamp")]
    whole, _ = src.normalise(queue, AS_OF, batch="batch")
    assert rows(whole, "event_name") == [("a",), ("b",)]


def key(secret, **given):
    base = dict(
        organization_id="org_a",
        name="k",
        prefix=secret[:16],
        hashed_key=hashlib.sha256(secret.encode()).hexdigest(),
        is_active=True,
        expires_at=None,
        is_deleted=False,
    )
    return tuple((base | given).values())


def test_key_attribution(spark):
    good, old, off = "pk_live_good0000-secret", "pk_live_old00000-secret", "pk_live_off00000-secret"
    edge, twin = "pk_live_edge0000-secret", "pk_live_twin0000-secret"
    keys = spark.createDataFrame(
        [
            key(good),
            key(old, expires_at=ago(seconds=1)),
            key(edge, expires_at=AS_OF),
            key(off, is_active=False),
            key(twin),
            key(twin, organization_id="org_b"),
        ],
        schema.API_KEYS,
    )
    tried = [good, old, edge, off, twin, good + "x", "pk_live_short", "pk_test_good0000-secret", None]
    raw = spark.createDataFrame([(str(i), k) for i, k in enumerate(tried)], "request_id string, api_key string")
    accepted, rejected = ac.attribute_keys(raw, keys, AS_OF)
    assert rows(accepted, "request_id", "organization_id") == [("0", "org_a"), ("2", "org_a")]
    assert rows(rejected, "request_id", "reason") == [
        ("1", "expired_key"),
        ("3", "unknown_key"),
        ("4", "ambiguous_key"),
        ("5", "invalid_key"),
        ("6", "invalid_format"),
        ("7", "invalid_format"),
        ("8", "missing_key"),
    ]


def requests(spark, rows_):
    return spark.createDataFrame(rows_, "request_id string, key_prefix string, received_at timestamp")


def test_admission_limit_is_per_key_and_minute(spark):
    minute = utc(2026, 5, 21, 12, 0)
    raw = requests(
        spark,
        [(f"a{i:03d}", "k1", minute + timedelta(milliseconds=500 * i)) for i in range(101)]
        + [(f"b{i:03d}", "k2", minute) for i in range(100)]
        + [("c", "k1", minute + timedelta(seconds=60))],
    )
    admitted, throttled = ac.admit(raw)
    assert rows(throttled, "request_id", "reason") == [("a100", "rate_limited")]
    assert admitted.count() == 201


def test_admission_counts_earlier_requests(spark):
    minute = utc(2026, 5, 21, 12, 0)
    raw = requests(
        spark, [(f"{k}{i}", k, minute + timedelta(seconds=i)) for k in ("p", "q", "r", "s") for i in range(4)]
    )
    used = spark.createDataFrame(
        [("p", minute, 2), ("q", minute, 5), ("r", minute, 0), ("s", utc(2026, 5, 21, 11, 59), 5)],
        "key_prefix string, minute timestamp, used bigint",
    )
    admitted, _ = ac.admit(raw, 3, used=used)
    assert rows(admitted, "request_id") == [("p0",), ("r0",), ("r1",), ("r2",), ("s0",), ("s1",), ("s2",)]


@pytest.mark.parametrize("max_small", [500_000, 0])
def test_admission_of_one_hot_minute(spark, monkeypatch, max_small):
    """One key-minute with nearly all requests, arriving at few distinct times."""
    monkeypatch.setattr(ac, "MAX_SMALL_ROWS", max_small)
    base = utc(2026, 5, 21, 12, 0)
    raw = (
        spark.range(30_000)
        .select(
            F.format_string("%06d", "id").alias("request_id"),
            F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("key_prefix"),
            F.timestamp_micros(F.lit(int(base.timestamp() * 1e6)) + F.col("id") % 7).alias("received_at"),
        )
        .repartition(8)
    )
    admitted, throttled = ac.admit(raw, 50)
    got = {(r.key_prefix, r.request_id) for r in admitted.collect()}
    everything = sorted((r.received_at, r.request_id, r.key_prefix) for r in raw.collect())
    wanted = set()
    for k in ("hot", "cold"):
        wanted |= {(k, i) for _, i, p in [e for e in everything if e[2] == k][:50] for k in [p]}
    assert got == wanted
    assert throttled.count() == 30_000 - 100


def test_roles(spark):
    members = spark.createDataFrame(
        [
            ("u", "org_a", "analyst", False),
            ("u", "org_b", "viewer", False),
            ("u", "org_c", "owner", True),
            ("w", "org_a", "stranger", False),
        ],
        schema.MEMBERSHIPS,
    )
    table = events(spark, [event("x", AS_OF, org=o) for o in ("org_a", "org_b", "org_c", "org_d")])
    assert rows(ac.entitled(table, members, "u", "analyst"), "organization_id") == [("org_a",)]
    assert rows(ac.entitled(table, members, "u"), "organization_id") == [("org_a",), ("org_b",)]
    assert ac.entitled(table, members, "w").isEmpty()
    assert ac.entitled(table, members, "x", "owner", superuser=True).count() == 4
    tried = spark.createDataFrame(
        [("u", "org_a", False), ("u", "org_b", False), ("u", "org_c", False), ("s", "org_c", True)],
        "user_id string, organization_id string, is_superuser boolean",
    )
    assert rows(ac.access_verdicts(tried, members, "analyst"), "user_id", "organization_id", "verdict") == [
        ("s", "org_c", "allowed"),
        ("u", "org_a", "allowed"),
        ("u", "org_b", "role_too_low"),
        ("u", "org_c", "not_a_member"),
    ]


def test_slugs(spark):
    names = ["Acme, Inc.", "acme inc", "ACME -- Inc!", "  ", "日本", "Ünïcode Café", "a--b", "--x--"]
    orgs = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    found = {r.id: r.slug for r in ac.slugs(orgs).collect()}
    assert found == {
        0: "acme-inc",
        1: "acme-inc--1",
        2: "acme-inc--2",
        3: "org",
        4: "org--4",
        5: "ncode-caf",
        6: "a-b",
        7: "x",
    }


def test_store_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "events")
    table = events(
        spark,
        [event("page_view", utc(2026, m, 15), user_id=f"u{m}", session_id="s") for m in (3, 4, 5)]
        + [event("page_view", utc(2026, 5, 1)), event("page_view", utc(2026, 4, 30, 23, 59, 59))],
    )
    observed, receipt = store.observed(table)
    store.write_events(observed, path)
    assert receipt.get["processed_records"] == 5
    stored = store.read_events(spark, path)
    counts = {str(r.event_month): r.row_count for r in store.partition_counts(stored).collect()}
    assert counts == {"2026-03-01": 1, "2026-04-01": 2, "2026-05-01": 2}
    assert rows(stored.filter("event_month = '2026-05-01'"), "visitor_id") == [("u5",), (None,)]
    from eventmetrics.operators.overview import overview

    result = overview(stored, utc(2026, 5, 1), utc(2026, 5, 31))
    assert result.first().page_views == 2
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan
    assert "payload" not in plan.split("ReadSchema")[1]
    store.write_events(table, path)
    assert store.read_events(spark, path).count() == 10


def test_batch_write_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "events")
    for batch, n in ((0, 2), (1, 3), (1, 3)):
        store.write_events(events(spark, [event("x", utc(2026, 5, d + 1)) for d in range(n)]), path, batch=batch)
    assert store.read_events(spark, path).count() == 5
    # Run again with other months: nothing of the first attempt is left.
    store.write_events(events(spark, [event("x", utc(2026, m, 1)) for m in (1, 2)]), path, batch=7)
    store.write_events(events(spark, [event("y", utc(2026, 2, 1))]), path, batch=7)
    found = store.read_events(spark, path)
    assert rows(found.filter("event_name = 'y' OR event_month < '2026-05-01'"), "event_name") == [("y",)]
    store.write_events(events(spark, [event("loaded", utc(2026, 5, 1))]), path)
    assert found.columns == store.read_events(spark, path).columns
    target = str(tmp_path / "compact")
    store.compact_events(spark, path, target)
    assert store.read_events(spark, target).count() == store.read_events(spark, path).count() == 7


def test_ids_do_not_change_on_a_rerun(spark):
    frame = spark.createDataFrame([("r1", 0), ("r1", 1), ("r11", 0)], "request string, nth int")
    ids = [rows(frame.select(src.hashed_id(F.col("request"), F.col("nth")).alias("id")), "id") for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3
    assert all(re.fullmatch(src.UUID_PATTERN[4:], i) for (i,) in ids[0])


def test_csv_files_with_other_headers(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder, "a.csv", "event_name,timestamp,user_id,plan\na,2026-05-21T12:00:00Z,u1,free\n")
    write(folder, "b.csv", "plan,user_id,time,event\npro,u2,2026-05-21T13:00:00Z,b\n" + f"x,u3,,{'n' * 256}\n")
    write(folder, "c.csv", "event_name,timestamp,user_id,plan\nc,,u4,\n")
    found, rejected = src.read_csv_events(spark, str(folder), "org_a", "src", AS_OF)
    got = {r.event_name: (json.loads(r.payload), r.timestamp) for r in found.collect()}
    assert got == {
        "a": ({"user_id": "u1", "plan": "free"}, local(utc(2026, 5, 21, 12))),
        "b": ({"user_id": "u2", "plan": "pro"}, local(utc(2026, 5, 21, 13))),
        "c": ({"user_id": "u4", "plan": ""}, local(AS_OF)),
    }
    assert rows(rejected, "reason") == [("event_name_too_long",)]


def test_calendar(spark):
    table = events(spark, [event("x", utc(2026, 11, 2)), event("x", utc(2027, 2, 28)), event("x", utc(2027, 3, 1))])
    calendar = store.expected_partitions(spark, utc(2026, 11, 30, 23), table)
    assert [(n, str(a), str(b), c) for n, a, b, c in rows(calendar, "partition_name", "range_from", "range_to", "row_count")] == [
        ("events_y2026m11", "2026-11-01", "2026-12-01", 1),
        ("events_y2026m12", "2026-12-01", "2027-01-01", 0),
        ("events_y2027m01", "2027-01-01", "2027-02-01", 0),
        ("events_y2027m02", "2027-02-01", "2027-03-01", 1),
    ]
    inside, outside = store.split_by_calendar(table, calendar)
    assert (inside.count(), rows(outside, "reason")) == (2, [("no_partition",)])


def test_listing(spark):
    table = events(spark, [event("x", ago(hours=h)) for h in (3, 1, 2, 1)] + [event("x", AS_OF, org="org_b")])
    assert [r.id for r in store.list_events(table, "org_a").collect()] == ["e0001", "e0003", "e0002", "e0000"]
    assert [r.id for r in store.list_events(table, "org_a", limit=2, skip=1).collect()] == ["e0003", "e0002"]


def test_texts(spark):
    table = spark.createDataFrame(
        [(59.4, -1.5), (59.5, 0.0), (60.0, 2.0), (125.4, 1.0), (0.4, -2.0)], "s double, c double"
    )
    found = table.select(
        text.duration_text(F.col("s")).alias("d"),
        text.trend(F.col("c")).alias("up"),
        text.trend(F.col("c"), True).alias("down"),
        text.signed_text(F.col("c")).alias("signed"),
    ).collect()
    assert [r.d for r in found] == ["59s", "60s", "1m 0s", "2m 5s", "0s"]
    assert [r.up for r in found] == ["bad", "flat", "good", "good", "bad"]
    assert [r.down for r in found] == ["good", "flat", "bad", "bad", "good"]
    assert [r.signed for r in found] == ["-1.5%", "+0.0%", "+2.0%", "+1.0%", "-2.0%"]
    one = spark.range(1).select(
        text.metric_title(F.lit("avg_session_duration")).alias("t"),
        text.unit_suffix(F.lit("error_rate")).alias("p"),
        dates.minute_key(F.lit(AS_OF)).alias("m"),
        dates.iso_text(F.lit(AS_OF + timedelta(microseconds=5))).alias("i"),
    ).first()
    assert tuple(one) == ("Avg Session Duration", "%", "202605211200", "2026-05-21T12:00:00.000005+00:00")


def test_pages_behind_a_cursor(spark, tmp_path):
    made = [event("x", utc(2026, 1 + i % 4, 1 + i % 7, i % 5), org="org_a" if i % 5 else "org_b") for i in range(200)]
    store.write_events(events(spark, made), str(tmp_path / "store"))
    stored = store.read_events(spark, str(tmp_path / "store"))
    counts = store.tenant_months(stored)
    want = [r.id for r in store.list_events(stored, "org_a", limit=1000).collect()]
    got, cursor = [], None
    while True:
        page = store.events_page(stored, counts, "org_a", cursor, limit=23)
        found = [r.id for r in page.collect()]
        if not found:
            break
        assert len(found) == 23 or len(got) + len(found) == 160
        got += found
        cursor = store.cursor_of(page)
    assert got == want and len(got) == 160
    # A deep page reads the folders of one or two months.
    deep = store.events_page(stored, counts, "org_a", (utc(2026, 2, 4, 2), ""), limit=10)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "2026-01-01" in filters and "2026-02-01" in filters
    assert store.events_page(stored, counts, "nobody").collect() == []


def test_closed_months_are_compacted_once(spark, tmp_path):
    path = str(tmp_path / "store")

    def batch(n, *months):
        made = [event(f"b{n}", utc(2026, m, 1 + n % 20, n % 24), org=o) for m in months for o in ("org_a", "org_b")]
        given = [(f"{n}-{i}", *r[1:]) for i, r in enumerate(made)]
        store.write_events(spark.createDataFrame(given, schema.EVENTS), path, batch=n)

    def ids():
        return sorted(r.id for r in store.read_events(spark, path).collect())

    for n in range(4):
        batch(n, 3, 4, 5)
    batch(4, 4)
    store.write_events(spark.createDataFrame([("loaded", *event("x", utc(2026, 3, 2))[1:])], schema.EVENTS), path)
    before = ids()
    # May is open, March lies in too few batches.
    assert store.compact_closed_months(spark, path, utc(2026, 5, 9), least_batches=5) == [utc(2026, 4, 1).date()]
    assert ids() == before and len(before) == 4 * 6 + 2 + 1
    files = [f for f in store.read_events(spark, path).inputFiles() if "event_month=2026-04" in f]
    april = store.read_events(spark, path).filter("event_month = DATE '2026-04-01'")
    assert {f.split("/")[-3] for f in (r.f for r in april.select(F.input_file_name().alias("f")).distinct().collect())} == {"ingest_batch=-2"}
    assert files
    # Nothing to do a second time; rows written again by a resumed run do not come back.
    assert store.compact_closed_months(spark, path, utc(2026, 5, 9), least_batches=5) == []
    batch(4, 4)
    assert ids() == before
    # Late rows are seen at once, and gathered when there are enough of them.
    for n in range(5, 10):
        batch(n, 4)
    late = ids()
    assert len(late) == len(before) + 10
    assert store.compact_closed_months(spark, path, utc(2026, 5, 9), least_batches=5) == [utc(2026, 4, 1).date()]
    assert ids() == late
    # A try that was cut short before it was published: its folder is not seen, and the next one replaces it.
    for n in range(10, 14):
        batch(n, 3)
    whole = ids()
    unfinished = spark.createDataFrame([("ghost", *event("x", utc(2026, 3, 3))[1:])], schema.EVENTS)
    store.write_events(unfinished, path, batch=-4)
    assert ids() == whole
    assert store.compact_closed_months(spark, path, utc(2026, 5, 9), least_batches=5) == [utc(2026, 3, 1).date()]
    assert ids() == whole
