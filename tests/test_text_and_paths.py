"""Parsers and scalar expressions on single lines and paths."""

import pytest
from pyspark.sql import functions as F

from lakekeep.functions import paths as P
from lakekeep.functions import scalars as S
from lakekeep.operators.diff import exclude_transient
from lakekeep.sources.listing import parse_changes, parse_listing, read_listing

FILE = "-rw-r--r--   3 ann staff   1024 2016-09-27 10:15 /a/b/f1"


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "raw string")


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression("v").alias("x")).collect()]


@pytest.mark.parametrize(
    "line,valid",
    [
        (FILE, True),
        ("drwxr-xr-x   - ann staff      0 2016-09-27 10:15 /a/b", True),
        (FILE + "   ", True),
        (FILE.replace("   ", "\t"), True),
        (" " + FILE, False),
        ("Found 3 items", False),
        ("-rw-r--r-- 3 ann staff 1 2016-09-27 10:15 /a/my file", False),
        ("", False),
    ],
)
def test_listing_line(spark, line, valid):
    good, bad = parse_listing(lines(spark, line))
    assert (good.count(), bad.count()) == ((1, 0) if valid else (0, 1))


def test_listing_values(spark):
    good, _ = parse_listing(lines(spark, FILE))
    row = good.withColumn("mtime", S.minute_stamp("mtime")).first()
    assert (row.permission, row.replication, row.owner, row.grp, row.size, row.mtime, row.path, row.raw) == (
        "-rw-r--r--", "3", "ann", "staff", 1024, "2016-09-27 10:15", "/a/b/f1", FILE,
    )


def test_unreadable_values_stay_whole(spark):
    odd = "-rw-r--r-- 3 ann staff 12x 2016-09-27 10:15 /a/f"
    good, bad = parse_listing(lines(spark, odd))
    assert good.count() == 0
    assert [(r.raw, r.reason) for r in bad.collect()] == [(odd, "value")]


def test_reading_position_orders_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(FILE.replace("1024", str(i)) for i in range(50)) + "\n")
    good, _ = read_listing(spark, str(tmp_path))
    assert [r.size for r in good.orderBy("pos").collect()] == list(range(50))


@pytest.mark.parametrize(
    "line,op",
    [
        (FILE, "ADD"),
        ("update " + FILE, "UPDATE"),
        ("MOVE " + FILE, "MOVE"),
        ("-rw-r--r-- 3 ann staff 1 2016-09-27 10:15 /a/my file", "-RW-R--R--"),
        ("a b c d e f g", None),
        ("a b c d e f g h i j", None),
    ],
)
def test_change_line(spark, line, op):
    assert parse_changes(lines(spark, line)).first().op == op


def test_transient_paths(spark):
    kept = ["/a/_temporary", "/a/f"]
    gone = ["/user/x/.Trash/Current/f", "/a/_temporary/0/f", "/a/_distcp_logs_x9/f"]
    df = spark.createDataFrame([(p,) for p in kept + gone], "path string")
    assert sorted(r.path for r in exclude_transient(df).collect()) == sorted(kept)


def test_protected(spark):
    cases = {
        "/user/ann": True, "/username/x": True, "/user/ann/.Trash": True, "/user/ann/data.Trash": True,
        "/user/ann/": True, "/user/ann/f": False, "/user": False, "/a/user/b": False, "/user/a/b/.Trash": False,
    }
    assert column(spark, list(cases), P.protected) == list(cases.values())


@pytest.mark.parametrize(
    "pattern,path,hit",
    [
        ("/a/*/*.txt", "/a/b/x.txt", True),
        ("/a/*", "/a/b/x.txt", False),
        ("/a/f?", "/a/f1", True),
        ("/a/f?", "/a/f12", False),
        ("/a/{x,y}[0-9]", "/a/y7", True),
        ("/a/{x,y}[0-9]", "/a/z7", False),
        ("/a/{b/c,d}", "/a/b/c", True),
        ("/a/[^b]", "/a/c", True),
        ("/a/[^b]", "/a/b", False),
        ("/a/x.y", "/a/xzy", False),
        ("/a/\\*", "/a/*", True),
        ("/a/\\*", "/a/b", False),
        ("/a/(b)+", "/a/(b)+", True),
    ],
)
def test_glob(spark, pattern, path, hit):
    assert column(spark, [path], lambda c: P.glob_match(c, pattern)) == [hit]


def test_open_brace_is_refused():
    with pytest.raises(ValueError):
        P.glob_regex("/a/{b")


def test_partition_text(spark):
    text = ["logdate=20160101/hour=05"]
    assert column(spark, text, lambda c: P.partition_value(c, "hour")) == ["05"]
    assert column(spark, text, lambda c: P.partition_value(c, "logdate")) == ["20160101"]
    assert column(spark, text, lambda c: P.partition_value(c, "date", strict=False)) == ["20160101"]
    assert column(spark, text, lambda c: P.partition_value(c, "date")) == [None]
    assert column(spark, text, lambda c: P.partition_value(c, "x")) == [None]
    assert column(spark, text, P.partition_values) == [["20160101", "05"]]
    assert P.parse_values("20160101 / 05") == ["20160101", "05"]
    assert P.parse_values("20160101/") == ["20160101"]


def test_path_parts(spark):
    assert column(spark, ["/a/b/c", "/a"], P.parent) == ["/a/b", "/"]
    assert column(spark, ["/a/b/c"], P.base_name) == ["c"]
    assert column(spark, ["/a/b/c", "/"], P.lineage) == [["/", "/a", "/a/b", "/a/b/c"], ["/"]]
    assert column(spark, ["/a/b/c", "/a"], P.ancestors) == [["/", "/a", "/a/b"], ["/"]]
    assert column(spark, ["/a//b"], lambda c: P.target_path("hdfs://nn/", c)) == ["hdfs://nn/a/b"]
    assert column(spark, ["/a/b"], lambda c: P.trash_path("/t/", "20240101", c)) == ["/t/20240101/a/b"]


def test_percent(spark):
    assert column(spark, [" 12.34% ", "0%", "x%", None], S.percent) == [0.1234, 0.0, None, None]


def test_typed_values(spark):
    assert column(spark, ["9007199254740993", "12.9", "x"], lambda c: S.typed_value(c, S.LONG)) == [
        float(9007199254740993), 12.0, None,
    ]
    assert column(spark, ["1.5"], lambda c: S.typed_value(c, S.DOUBLE)) == [1.5]
    with pytest.raises(ValueError):
        S.typed_value("v", "TEXT")


def test_mode(spark):
    cases = {
        "-rw-r--r--": "644", "drwxr-xr-x": "755", "drwxrwxrwt": "1777", "drwxrwxrwT": "1776",
        "-rwsr-Sr-x": "745", "----------": "0", "-rw": None,
    }
    assert column(spark, list(cases), S.mode_of) == list(cases.values())


def test_temperature(spark):
    times = {
        "2024-06-30 00:00:00": "HOT", "2024-07-01 00:00:00": "HOT", "2024-05-31 00:00:00": "HOT",
        "2024-05-30 23:59:59.999": "WARM", "2024-01-02 00:00:00": "WARM", "2024-01-01 23:59:59.999": "COLD",
        "1970-01-01 00:00:00": "COLD", None: "COLD",
    }

    def heat(c):
        return S.temperature(F.col(c).cast("timestamp_ntz"), "2024-06-30 00:00:00")

    assert column(spark, list(times), heat) == list(times.values())
