"""CSV files read in pieces: the same records as one reader finds."""

import csv
import io
import json
import random

import pytest
from helpers import AS_OF, rows

from eventmetrics.sources import csv_records as cr
from eventmetrics.sources import events as src


def plain_rows(text):
    found = [r for r in csv.reader(io.StringIO(text)) if r]
    return [(tuple(found[0]), tuple(r)) for r in found[1:]]


def field(rng):
    """A field as it may stand in a file: plain, quoted, with breaks, doubled quotes, and quotes in odd places."""
    kind = rng.randrange(7)
    word = rng.choice(["a", "bb", "", "x y", "7"])
    if kind < 3:
        return word
    if kind == 3:
        return '"' + rng.choice(["line\none", 'say ""hi""', "a,b", '""', "\n", "\n\n,\n"]) + word + '"'
    if kind == 4:
        return word + '5" pipe'  # a quote that opens nothing
    if kind == 5:
        return '"closed"' + word  # goes on behind its quotes
    return '"' + "long text\nover lines, " * rng.randrange(12) + '"'


def made(rng, n, end="\n"):
    width = rng.randrange(2, 5)
    lines = [",".join(f"c{i}" for i in range(width))]
    lines += [",".join(field(rng) for _ in range(rng.choice([width, width, width - 1, width + 1]))) for _ in range(n)]
    return end.join(lines) + rng.choice(["", end])


@pytest.fixture
def small_pieces(spark):
    """Files are cut every few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_open_after():
    rng = random.Random(9)
    for _ in range(20_000):
        line = "".join(rng.choice('ab",') for _ in range(rng.randrange(9)))
        alone = list(csv.reader([line + "\n", "END\n"]))
        assert cr.open_after(line, False) is (alone[-1] != ["END"]), line
        within = list(csv.reader(['"\n', line + "\n", "END\n"]))
        assert cr.open_after(line, True) is (within[-1] != ["END"]), line


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_of_files_in_pieces(spark, tmp_path, small_pieces, seed):
    rng = random.Random(seed)
    folder = tmp_path / "csv"
    folder.mkdir()
    want = []
    for i in range(5):
        text = made(rng, rng.choice([0, 3, 60]), "\r\n" if i == 4 else "\n")
        (folder / f"f{i}.csv").write_bytes(text.encode())
        want += plain_rows(text)
    (folder / "empty.csv").write_text("")
    (folder / "open.csv").write_text('h1,h2\n1,2\n3,"never closed\n4,5\n')
    want += plain_rows('h1,h2\n1,2\n3,"never closed\n4,5\n')
    header = "h" * 700
    (folder / "wide.csv").write_text(f'"{header}\n{header}",b\nv,w\n')
    want += plain_rows(f'"{header}\n{header}",b\nv,w\n')
    found = cr.read_records(spark, str(folder))
    got = [(tuple(r.names), tuple(r.fields)) for r in found.collect()]
    assert sorted(got) == sorted(want)
    pieces = spark.read.text(str(folder)).rdd.getNumPartitions()
    assert pieces > 12


def test_a_field_over_many_pieces(spark, tmp_path, small_pieces):
    body = "\n".join(f"line {i}, \"\"quoted\"\"" for i in range(300))
    text = f'event_name,note\nfirst,x\nbig,"{body}"\nlast,y\n'
    (tmp_path / "one.csv").write_text(text)
    accepted, rejected = src.read_csv_events(spark, str(tmp_path / "one.csv"), "org_a", "src", AS_OF)
    notes = {r.event_name: json.loads(r.payload)["note"] for r in accepted.collect()}
    assert notes == {"first": "x", "big": body.replace('""', '"'), "last": "y"}
    assert rejected.count() == 0


def test_many_header_rows(spark, tmp_path):
    for i in range(230):
        (tmp_path / f"{i}.csv").write_text(f"k{i},event,k{i},time\nold,e{i},new,\n")
    accepted, _ = src.read_csv_events(spark, str(tmp_path), "org_a", "src", AS_OF)
    assert rows(accepted, "event_name", "payload") == sorted((f"e{i}", json.dumps({f"k{i}": "new"}, separators=(",", ":"))) for i in range(230))
