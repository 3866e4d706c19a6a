import datetime as dt

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import keys as K
from edgeloom.functions import payload as P
from edgeloom.functions import text as T


def answers(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_blank(spark):
    values = [None, "", "  ", "\t\n", "\x00", "a", " a ", " "]
    assert answers(spark, T.is_blank, values) == [True, True, True, True, True, False, False, False]
    assert answers(spark, T.is_white, values) == [True, True, True, True, False, False, False, True]


def test_short_name(spark):
    values = ["a", "a.b", "a.b.c", "a.", ".a", "a..b", "a.b.", None]
    assert answers(spark, T.short_name, values) == ["a", "b", "c", "a", "a", "b", "b", None]
    assert answers(spark, T.is_dots_only, [".", "..", "a.", "", None]) == [True, True, False, False, None]


def test_schema_of_name(spark):
    values = ["a", "a.b", "a.b.c", "a.", ".a", ".", "..", "a..b", "a.b.", "\ta.b ", " "]
    unknown = "unknown_schema"
    want = [unknown, "a", "a.b", unknown, "", unknown, unknown, "a.", "a", "a", unknown]
    assert answers(spark, T.schema_of_name, values) == want


def test_full_name_of_leading_dot(spark):
    assert answers(spark, lambda c: T.full_name(T.schema_of_name(c), c), [".a", "b", "x.b"]) == [
        ".a", "unknown_schema.b", "x.x.b",
    ]


def test_line_number_text(spark):
    values = ["L12", "l12", "L 5", "ll5", "x", " 5", "12.7", "+5", "-3", "", "99999999999", None]
    assert answers(spark, T.line_number, values) == [12, 12, None, None, None, 5, None, 5, -3, None, None, None]


@pytest.mark.parametrize(
    ("json", "want"),
    [("12", 12), ("12.7", 12), ('"12.7"', None), ('"L3"', 3), ("true", None), ("null", None), ("[1]", None),
     ('{"a":1}', None), ("1e300", None), ("-2.9", -2)],
)
def test_line_from_json(spark, json, want):
    v = F.parse_json(F.lit(json))
    got = spark.range(1).select(P.line_to_int(P.text(v), P.get(v, "$", "string"))).first()[0]
    assert got == want


def test_trim_lower_and_contains(spark):
    assert answers(spark, T.trim_lower, ["\t Ab \n", None]) == ["ab", None]
    assert answers(spark, lambda c: T.contains_any_case(c, F.lit("_")), ["a_b", "ab"]) == [True, False]
    assert answers(spark, lambda c: T.contains_any_case(c, F.lit("A%")), ["xa%", "xab"]) == [True, False]


def test_mask(spark):
    assert answers(spark, T.mask_secret, [None, "", "12345", "123456", "abcdefghij"]) == [
        "***", "***", "***", "123***456", "abc***hij",
    ]


def test_enums(spark):
    assert answers(spark, T.asset_role, ["source", "TARGET", "cte", None]) == [
        "SOURCE", "TARGET", "INTERMEDIATE", "INTERMEDIATE",
    ]
    assert answers(spark, T.edge_type, ["column_edge", "Column_Lineage", "x", None]) == [
        "column_edge", "column_edge", "table_edge", "table_edge",
    ]
    assert answers(spark, T.file_type, ["JINJA2", "jinja2", None]) == ["JINJA2", "SQL", "SQL"]
    assert answers(spark, T.file_status, ["success", "failed", "SUCCESS", None]) == [
        "SUCCESS", "FAILED", "SKIPPED", "SKIPPED",
    ]


def test_event_time(spark):
    base = "2024-01-02T03:04:05"
    good = [base] + [f"{base}.{'123456'[:n]}" for n in range(1, 7)]
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    micros = [0, 100000, 120000, 123000, 123400, 123450, 123456]
    assert answers(spark, P.event_time, good) == [at.replace(microsecond=m) for m in micros]
    bad = [base + "Z", "2024-01-02", base + ".", base + ".1234567", "", base + "\n", "2024-13-02T03:04:05", None]
    assert answers(spark, P.event_time, bad) == [None] * len(bad)


def test_page_bounds(spark):
    df = spark.createDataFrame([(0,), (19,), (20,), (45,)], "n bigint")
    got = [tuple(r) for r in df.select(*K.page_bounds(1, 20, F.col("n"))).collect()]
    assert got == [(0, 0, 0), (19, 19, 1), (20, 20, 1), (20, 40, 3)]


def test_ids_do_not_depend_on_the_run_of_the_job(spark):
    df = spark.createDataFrame([("r", 1)], "a string, b int")
    one, two = (df.select(K.stable_id("a", "b")).first()[0] for _ in range(2))
    assert one == two and len(one) == 64


def test_ids_tell_null_parts_apart(spark):
    from edgeloom.functions import keys as K

    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b")], "x string, y string, z string")
    ids = {r.id for r in df.select(K.stable_id("x", "y", "z").alias("id")).collect()}
    ids |= {r.id for r in df.filter("y IS NULL").select(K.stable_id("x", "z").alias("id")).collect()}
    assert len(ids) == 4
