"""Audit rules, classes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from sheafline.operators import audits


def test_audits(spark):
    rows = spark.createDataFrame([(1, "网络设备清单", "型号", 0.2), (2, "职责|表", "岗位", 0.9), (3, "x", "y", None)], "id int, anchor string, header_sample string, score double")
    rules = [audits.Rule("table", "low", "score < 0.5", "weak header", "look"), audits.Rule("table", "high", "anchor rlike '职责'", "subject"), audits.Rule("gap", "medium", "score is null", "no score")]
    found = audits.cases(rows, rules, ["id"]).orderBy("severity_rank")
    assert [(r.id, r.severity) for r in found.collect()] == [(2, "high"), (3, "medium"), (1, "low")]
    named = audits.classified(rows, [("network", "review", "网络"), ("duty", "auto", "职责|网络")])
    assert {r.id: (r.table_category, r.source_group) for r in named.collect()} == {1: ("network", "review"), 2: ("duty", "auto"), 3: ("other", "other")}
    assert [r.id for r in audits.selected(named, "recommended", recommended=["review"]).collect()] == [1]
    assert [r.id for r in audits.selected(named, "category", "duty").collect()] == [2] and audits.selected(named, "all").count() == 3
    assert audits.report(rows, ["id", "anchor"], ["id"], 2) == "| id | anchor |\n| --- | --- |\n| 1 | 网络设备清单 |\n| 2 | 职责\\|表 |\n"
    values = spark.createDataFrame([(["1", "2024-01-02", "name"],), (["name", "phone"],)], "v array<string>").select(audits.value_like(F.col("v")).alias("x"))
    assert [r.x for r in values.collect()] == [True, False]


def test_optical_specs(spark):
    from sheafline.operators import tables

    rows = [
        (1, ["属性", "描述", "描述", "描述"]), (2, ["", "CFP", "CFP", "QSFP28"]), (3, ["速率", "100G", "100G", "40G"]), (4, ["接口", "LC", "SC", "MPO"]),
        (5, ["单模模块", "单模模块", "", ""]), (6, ["传输距离", "10km", "40km"]), (7, ["波长", "1310", "1550"]), (8, ["", ""]),
    ]
    df = spark.createDataFrame([("t", r, v) for r, v in rows], "table_id string, row int, values array<string>")
    got = {r.row: (r.role, r.group, r.text) for r in tables.optical_specs(df).collect()}
    assert got == {
        3: ("data_row", "CFP/QSFP28", "属性：速率；CFP：100G；QSFP28：40G"), 4: ("data_row", "CFP/QSFP28", "属性：接口；CFP：LC、SC；QSFP28：MPO"),
        6: ("distance_options", "单模模块", "传输距离选项：10km、40km"), 7: ("data_row", "单模模块", "属性：波长；10km：1310；40km：1550"),
    }
