"""Sources: headers of several files, order without overflow, stated values, sniffed delimiters, formats of one's own."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import registry as R
from strandline.schema import ParserSettings
from strandline.sources import readers


def rows(df):
    return [(r.timestamp_raw, r.variable_name, r.value_raw) for r in df.orderBy("seq").collect()]


def test_each_file_has_its_header(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("time,x,y\n1,10,on\n2,11,\n")
    (tmp_path / "d" / "b.csv").write_text("time,x,y\n3,12,off,surplus\n4\n\n")
    assert sorted(rows(readers.read(spark, str(tmp_path / "d"), "csv"))) == [("1", "x", "10"), ("1", "y", "on"), ("2", "x", "11"), ("3", "x", "12"), ("3", "y", "off")]
    (tmp_path / "d" / "c.csv").write_text("time,other,y\n5,1,2\n")
    with pytest.raises(Exception, match="header"):
        readers.read(spark, str(tmp_path / "d"), "csv").collect()


def test_repeated_names_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,t,a\n1,7,2\n")
    assert rows(readers.read(spark, str(tmp_path / "a.csv"))) == [("7", "a", "1"), ("7", "a", "2")]
    (tmp_path / "e.csv").write_text("")
    assert readers.read(spark, str(tmp_path / "e.csv")).count() == 0
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "a.csv"), settings=ParserSettings(timestamp_column="zz"))


def test_sniffed_delimiter(spark, tmp_path):
    (tmp_path / "data").write_text("time;x\n1;2\n")
    assert rows(readers.read(spark, str(tmp_path / "data"))) == [("1", "x", "2")]
    (tmp_path / "tabs").write_text("time\tx\n1\t2\n")
    assert rows(readers.read(spark, str(tmp_path / "tabs"))) == [("1", "x", "2")]


def test_stated_values(spark):
    lines = {
        "Temperature = 28.5 C": ("Temperature", "28.5", "C"), "Battery Voltage: 4.18V": ("Battery_Voltage", "4.18", "V"), "Motor speed changed to 500 RPM": ("Motor_speed", "500", "RPM"),
        "depth is -3e2 m/s": ("depth", "-3e2", "m/s"), "error code=12 in module five": None, "job 4411 of queue size: 3 was dropped": None, "ratio is high": None, "x = 1 = 2": None, "9lives = 3": None,
    }
    got = {r.seq.line: (r.variable_name, r.value_raw, r.unit_raw) for r in readers.read(spark, list(lines), "text").collect()}
    for i, (line, want) in enumerate(lines.items()):
        assert got[i] == (want or ("log_line", line, None)), line


def test_leading_times(spark):
    lines = ["[2026-01-02 03:04:05] a = 1", "2026-01-02T03:04:05.5Z a = 1", "Jan  2 03:04:05 a = 1", "12.5 a = 1", "a = 1", "12.5", "2026-01-02 03:04:05"]
    got = [(r.timestamp_raw, r.variable_name) for r in readers.read(spark, lines, "text").orderBy("seq").collect()]
    assert got == [("2026-01-02 03:04:05", "a"), ("2026-01-02T03:04:05.5Z", "a"), ("Jan 2 03:04:05", "a"), ("12.5", "a"), (None, "a"), (None, "log_line"), ("2026-01-02 03:04:05", "event")]


def test_order_of_very_far_partitions_and_wide_lines(spark):
    far = spark.createDataFrame([(300_000 << 33, "a=1,b=2"), ((300_000 << 33) + 1, ",".join(f"v{i}={i}" for i in range(5000)))], "line bigint, value string")
    names = [r.variable_name for r in readers.parse_kv(far).orderBy("seq").collect()]
    assert names == ["a", "b", *[f"v{i}" for i in range(5000)]]


def test_last_of_equal_keys_wins(spark):
    wide = ",".join(f"k{i % 4000}={i}" for i in range(5000))
    got = readers.read(spark, ["b=1,a=2,b=3,time=7,c=,a=4", wide], "kv").orderBy("seq").collect()
    assert [(r.timestamp_raw, r.variable_name, r.value_raw) for r in got[:2]] == [("7", "b", "3"), ("7", "a", "4")]
    assert [(r.variable_name, r.value_raw) for r in got[2:]] == [(f"k{i % 4000}", str(i)) for i in range(1000, 5000)]


def test_a_format_of_ones_own(spark, tmp_path):
    def parse(spark, path, settings):
        df = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"\|", "=").alias("value"))
        return readers.parse_kv(df, settings, path)

    readers.register_parser("pipes", parse, ("pip",))
    (tmp_path / "a.pip").write_text("t|5,x|6\n")
    assert rows(readers.read(spark, str(tmp_path / "a.pip"))) == [("5", "x", "6")]
    obs, reg = R.observations(readers.read(spark, str(tmp_path / "a.pip"), "PIPES"))
    assert [(r.timestamp, r.value_int) for r in obs.collect()] == [(5.0, 6)] and reg.first().name == "x"
