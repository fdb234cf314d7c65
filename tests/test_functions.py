"""Column functions against plain Python."""

from __future__ import annotations

import datetime
import hashlib
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sheafline.functions import text as T


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_text(spark):
    v = F.col("v")
    row = one(spark, "  a　\x1cB\n c ", T.collapse(v), T.display_text(v, 4), T.compact_text(v, 4), T.normalize_text(v), T.compact_key(v))
    assert tuple(row) == ("a B c", "a B...", "a B…", "a b c", "abc")
    assert tuple(one(spark, "２5℃ Straße", T.normalize_text(v), T.normalize_enum(v))) == ("25°c strasse", "25°cstrasse")
    assert tuple(one(spark, None, T.collapse(v), T.normalize_enum(v), T.blank(v), T.normalize_bool(v))) == ("", "", True, None)
    assert [one(spark, x, T.normalize_bool(v))[0] for x in ("是", " YES ", "未配置", "0", "maybe")] == [True, True, False, False, None]


def test_numbers_dates_lists(spark):
    v = F.col("v")
    number = lambda x: one(spark, x, T.parse_number(v))[0]
    assert tuple(number("约 1,500 W")) == (1.5, "kw") and tuple(number("-2.5MVA")) == (-2500.0, "kva") and tuple(number("3 台")) == (3.0, "count") and tuple(number("7 foo")) == (7.0, "foo") and number("none") is None
    date = lambda x: one(spark, x, T.parse_date(v))[0]
    assert date("2024年2月9日") == date("2024/2/9") == date("20240209") == datetime.date(2024, 2, 9) and date("2024-02-30") is None and date("on 2024-02-03") is None
    assert one(spark, "b、A;b, ,c/", T.normalize_list(v))[0] == ["a", "b", "b", "c"]


def test_ids(spark):
    v = F.col("v")
    row = one(spark, "chunk/1", T.point_id(v), T.file_id(v), T.stable_hash(v, F.lit(None), F.lit(3)))
    assert row[0] == str(uuid.UUID(hashlib.sha256(b"chunk/1").hexdigest()[:32])) and row[1] == "file_" + hashlib.sha1(b"chunk/1").hexdigest()[:10]
    assert row[2] == hashlib.sha256(b"chunk/1||3").hexdigest()[:16]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 18278), min_size=50, max_size=50))
def test_addresses(numbers):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(n,) for n in numbers], "n int")
    for r in df.select("n", T.num_to_col(F.col("n")).alias("s"), T.split_ref(T.cell_ref(F.lit(7), F.col("n"))).alias("p")).collect():
        n, s = r.n, ""
        while n:
            n, k = divmod(n - 1, 26)
            s = chr(65 + k) + s
        assert r.s == s and (r.p.row, r.p.col) == (7, r.n)


def test_lexical_and_recall(spark):
    v = F.col("v")
    assert one(spark, "UPS 容量", T.lexical_score(v, F.lit("ups 容量 is here")), T.lexical_score(v, F.lit("容量")), T.lexical_score(F.lit("solo"), F.lit("a solo")))[:] == (3, 1, 2)
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, "", T.recall_at(ids("a", "b"), ids("b", "c", "a"), 2), T.recall_at(F.array().cast("array<string>"), ids("a"), 2))[:] == (0.5, None)


def test_pairs(spark):
    values = F.array(F.lit("1"), F.lit(" "), F.lit("3"))
    assert one(spark, "", T.pair_values(F.array(F.lit("a"), F.lit("b")), values), T.alternating_pairs(F.array(*[F.lit(x) for x in "kvxy"])), T.sentence_field("x", F.lit("ok。。")))[:] == ("a：1；字段3：3", "k：v；x：y", "x：ok。")
