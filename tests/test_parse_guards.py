"""What a guard keeps from the parser would not have parsed, and most texts don't get there."""

import itertools
import time

from pyspark.sql import functions as F

from millrace.functions import casts

DATES = ["2024-01-31 10:20:30", "2024-01-31 10:20:30.5", "2024-01-31 10:20:30.123456+02:00", "2024-01-31T10:20:30", "2024-01-31t10:20:30Z", "2024-01-31 10:20",
         "2024-01-31T10:20", "2024-01-31", " 2024-01-31 ", "2024/01/31", "01/31/2024", "31/01/2024", "1 Jan 2024", "31 jan 2024", "1 January 2024",
         "01 May 2024", "Jan 1, 2024", "MAY 31, 2024", "January 1, 2024", "2024-02-30", "2024-1-1", "+12024-01-01", "-2024-01-01", "12024-01-01",
         "1 2024", "Jan 2024", "20240131", "24-01-31", "2024-01-31x", "-1 Jan 2024", "Jan -1, 2024", "x", "", " ", "A 1, b", "1 A b", "\t2024-01-31"]
NUMBERS = ["1", "-1.5", "+.5", ".5", "5.", "1e3", "1E-3", " 7 ", "\t7\n", "\x007", "\x7f7", " 7", "0x1p3", "Infinity", "-inf", "+Inf", " infinity", "NaN", "nan", "-nan",
           "1d", "1f", "1.D", "", " ", "A", "e3", "1,5", "--1", "N", "Customer#1", "i", "I1", "١", "1 2"]


def plain_moment(c):
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("timestamp_ntz") for f in casts.DATE_FORMATS])


def plain_number(c):
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & ~F.rlike(c, F.lit(r"[0-9.][dDfF]\s*$")), x)


def test_guards_change_no_result(spark):
    odd = ["".join(p) for p in itertools.product(["2024", "1", "-", "/", " ", "Jan", ","], repeat=3)]
    df = spark.createDataFrame([(t,) for t in DATES + NUMBERS + odd + [None]], "t string")
    t = F.col("t")
    got = df.select("t", casts.to_moment(t).cast("string").alias("m"), plain_moment(t).cast("string").alias("pm"), casts.to_number(t).alias("x"), plain_number(t).alias("px")).collect()
    assert [r for r in got if r["m"] != r["pm"] or r["x"] != r["px"]] == []
    assert sum(r["m"] is not None for r in got) >= 15 and sum(r["x"] is not None for r in got) >= 15


def test_words_do_not_reach_the_date_parser(spark):
    df = spark.range(300_000).select(F.concat(F.lit("name#"), F.col("id").cast("string")).alias("t"))
    took = {}
    for parse in (casts.to_moment, plain_moment):
        df.limit(100).agg(F.count(parse(F.col("t")))).first()
        begun = time.perf_counter()
        assert df.agg(F.count(parse(F.col("t")))).first()[0] == 0
        took[parse.__name__] = time.perf_counter() - begun
    assert took["to_moment"] < took["plain_moment"] / 2, took
