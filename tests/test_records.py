"""JSON by record, and quoted CSV records over lines and splits, against Python's own readers."""

import csv
import io
import json
import random

import pytest

from strandline.schema import ParserSettings, TIME_NAMES
from strandline.sources import readers


def rows(df):
    return [(r.timestamp_raw, r.variable_name, r.value_raw) for r in df.orderBy("seq").collect()]


def leaves(obj, prefix=""):
    for k, v in obj.items():
        if isinstance(v, dict):
            yield from leaves(v, f"{prefix}{k}.")
        else:
            yield f"{prefix}{k}", v


def text_of(v):
    nested = isinstance(v, list) and any(isinstance(x, (list, dict)) for x in v)
    flat = "[" + ", ".join(map(str, v)) + "]" if isinstance(v, list) and not nested else str(v).strip()
    return "" if v is None else json.dumps(v, separators=(",", ":")) if nested else flat


def plain_json(obj):
    flat = dict(leaves(obj))
    time = next((k for k in flat if k.split(".")[-1].lower() in TIME_NAMES), None)
    stamp = None if time is None or flat[time] is None else str(flat[time])
    return [(stamp, k, text_of(v)) for k, v in flat.items() if k != time and text_of(v)]


OBJECTS = [
    {"z": 1, "time": 5, "a": {"t": 9, "x": "q"}, "on": True},
    {"m": {"q": {"w": 2.5, "date": "2026-01-02"}}, "t": 7},
    {"t": 8, "time": 9, "l": [1, "a", None, True], "o": [{"b": 1, "a": [2]}], "n": None, "s": '{"k": 1}', "blank": " "},
    {"a.b": {"c d": 1e3}, "e": 0.25, "big": 123456789012},
    {},
    {"no": "time"},
]


def test_types_times_and_leaves_of_each_row(spark, tmp_path):
    lines = [json.dumps(o) for o in OBJECTS]
    want = [x for o in OBJECTS for x in plain_json(o)]
    (tmp_path / "a.jsonl").write_text("\n".join([lines[0], "{bad", '{"a": 1} x', "[1]", "3", "", *lines[1:]]) + "\n")
    assert rows(readers.read(spark, str(tmp_path / "a.jsonl"))) == want
    # the same as lines of a .json with a bad one, in front or between
    for k, order in enumerate(([*lines[:2], "{bad", *lines[2:]], ["{bad", *lines])):
        (tmp_path / f"b{k}.json").write_text("\n".join(order))
        assert rows(readers.read(spark, str(tmp_path / f"b{k}.json"))) == want
    # as a document, with items that aren't objects, in one line or many
    for k, indent in enumerate((None, 2)):
        (tmp_path / f"d{k}.json").write_text(json.dumps([1, *OBJECTS, "x", [2]], indent=indent))
        assert rows(readers.read(spark, str(tmp_path / f"d{k}.json"))) == want
    (tmp_path / "one.json").write_text(json.dumps(OBJECTS[0], indent=1))
    assert rows(readers.read(spark, str(tmp_path / "one.json"))) == plain_json(OBJECTS[0])
    named = readers.read(spark, str(tmp_path / "one.json"), settings=ParserSettings(timestamp_column="a.t"))
    assert rows(named) == [("9", "z", "1"), ("9", "time", "5"), ("9", "a.x", "q"), ("9", "on", "True")]


def test_deep_and_repeated_names(spark):
    deep = {"v": 1}
    for i in range(12):
        deep = {f"k{i}": deep, f"s{i}": i}
    df = spark.createDataFrame([(0, json.dumps(deep)), (1, '{"a": 1, "b": 2, "a": 3, "t": 4, "t": 6}')], "line bigint, value string")
    assert rows(readers.parse_json(df)) == plain_json(deep) + [("6", "a", "3"), ("6", "b", "2")]
    assert readers.parse_json(df.limit(0)).count() == 0


def test_files_of_both_kinds_in_one_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"t": 1, "x": 2}\n{"t": 2, "x": 3}\n')
    (tmp_path / "d" / "b.json").write_text('[\n{"t": 3, "x": 4},\n{"t": 4, "x": 5}\n]\n')
    (tmp_path / "d" / "c.json").write_text("")
    assert sorted(rows(readers.read(spark, str(tmp_path / "d"), "json"))) == [(str(i), "x", str(i + 1)) for i in range(1, 5)]


def plain_csv(text):
    body = csv.reader(io.StringIO(text, newline=None))
    head = next(body)
    out = []
    for row in body:
        row = row + [""] * (len(head) - len(row)) if row else row
        out += [(row[0], n, v.strip()) for n, v in list(zip(head, row))[1:] if v.strip()]
    return out


def wild_csv(seed, n):
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(["a", "b", " ", ",", '"', "\n", '"', "\n"]) for _ in range(r.randrange(6)))
    lines = ["t,x,y"]
    for i in range(n):
        values = [cell() for _ in range(2)]
        # cells that hold no comma or break may stand unquoted, with quotes inside
        shown = [v if r.random() < 0.3 and v[:1] not in ('"', "") and "," not in v and "\n" not in v else '"' + v.replace('"', '""') + '"' for v in values]
        lines.append(",".join([str(i), *shown]))
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_quoted_breaks_at_any_split(spark, tmp_path, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in old.items():
            spark.conf.set(k, str(split if "max" in k else 1))
        text = wild_csv(split, 150)
        (tmp_path / "a.csv").write_text(text)
        assert rows(readers.read(spark, str(tmp_path / "a.csv"))) == plain_csv(text)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_headers_with_breaks_and_open_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a\nb",time,c\n1,5,"x\ny"\n2,6,z\n')
    assert rows(readers.read(spark, str(tmp_path / "a.csv"))) == [("5", "a\nb", "1"), ("5", "c", "x\ny"), ("6", "a\nb", "2"), ("6", "c", "z")]
    (tmp_path / "b.csv").write_text('t,x\n1,"open\n2,3\n')
    assert rows(readers.read(spark, str(tmp_path / "b.csv"))) == [("1", "x", "open\n2,3")]


def test_patterns_by_names_or_places(spark):
    lines = ["ts=5 load[cpu0]=12%", "fan:30 rpm", "(?"]
    s = ParserSettings(text_patterns=["(", r"ts=(?P<timestamp>\d+) load\[(?P<variable>\w+)\]=(?P<value>\d+)(?P<unit>%)", r"(\w+):(\d+) (\w+)"])
    got = [(r.timestamp_raw, r.variable_name, r.value_raw, r.unit_raw) for r in readers.read(spark, lines, "text", s).orderBy("seq").collect()]
    assert got == [("5", "cpu0", "12", "%"), (None, "fan", "30", "rpm"), (None, "log_line", "(?", None)]
