"""Named table layouts, and segments of documents, sheets, slides and drawings."""

from __future__ import annotations

import io
import zipfile

import pytest
from sheafline.operators import layouts
from sheafline.sources import segments

ROWS = "table_id string, category string, row int, values array<string>"


def texts(df):
    return sorted((r.table_id, r.row, r.role, r.group, r.text) for r in df.collect())


def frame(spark, name, values):
    return spark.createDataFrame([("t", name, i, v) for i, v in enumerate(values, 1)], ROWS)


def test_department(spark):
    rows = frame(spark, "d", [["部门：", "运维", "负责人", "甲"], ["编制", "5"], ["目标", ""], ["简介"], ["", ""], ["序号", "工作领域", "内部分配主要职责、任务"], ["日常"], ["1", "巡检", "每日"], ["2", "-", "每周", "多"]])
    assert texts(layouts.profiles(rows, 6)) == [
        ("t", 1, "metadata", None, "部门：运维；负责人：甲"), ("t", 2, "kv", None, "部门：运维；负责人：甲；编制：5"), ("t", 3, "context", "目标", "部门：运维；负责人：甲；栏目：目标"), ("t", 4, "context", "简介", "部门：运维；负责人：甲；栏目：简介"),
        ("t", 7, "context", "日常", "部门：运维；负责人：甲；栏目：日常"), ("t", 8, "data_row", "日常", "部门：运维；负责人：甲；序号：1；工作领域：巡检；职责/任务：每日"), ("t", 9, "data_row", "日常", "部门：运维；负责人：甲；序号：2；职责/任务：每周；字段4：多"),
    ]
    assert {r.row for r in layouts.profiles(rows, 6).where("fallback").collect()} == {9}


def test_position(spark):
    rows = frame(spark, "p", [["岗位", "值班"], ["职责"], ["学历", "本科", "年限", "2"], ["要求", "证书"]])
    assert texts(layouts.profiles(rows)) == [
        ("t", 1, "metadata", None, "岗位：值班"), ("t", 2, "context", "职责", "岗位：值班；栏目：职责"), ("t", 3, "kv", "职责", "岗位：值班；学历：本科；年限：2"), ("t", 4, "kv", "职责", "岗位：值班；字段：要求；内容：证书"),
    ]


def test_cabinets(spark):
    rows = frame(spark, "c", [["标题"], ["表头"], ["", "r0", "9", "1", "8", "x"], ["A", "r1", "5", "2", "3", "y"], ["/", "r2", "6", "3", "3", "z"], ["合计", "", "11", "5", "6", ""], ["r3", "7", "1", "w"], ["B", "r4", "7", "1", "v"]])
    got = [t[-1] for t in texts(layouts.cabinets(rows))]
    assert got[0].startswith("数据中心名称：A；机房：r0") and got[2].startswith("数据中心名称：A；机房：r2") and got[3].startswith("数据中心名称：合计；机柜总数：11")
    assert got[4:] == ["机房：r3；机柜总数：7；已使用：1；具体机柜分布情况：w", "数据中心名称：B；机房：r4；机柜总数：7；已使用：1；具体机柜分布情况：v"]


def test_questionnaires_and_hints(spark):
    rows = frame(spark, "q", [["服务方面", "□a", "□b", "□c"], ["态度", "□1", "□2"], ["其他"], ["速度", "□"]])
    assert [(r[1], r[3], r[4]) for r in texts(layouts.questionnaires(rows))] == [(2, "服务方面", "满意度问卷模板项；评价项：态度；非常满意：□1；满意：□2"), (4, "其他", "满意度问卷模板项；评价项：速度；非常满意：□")]
    hints = spark.createDataFrame([("t", ["项", "甲"], [2, 4, 9])], "table_id string, headers array<string>, data_rows array<int>")
    assert [r[4] for r in texts(layouts.questionnaires(rows, hints))] == ["满意度问卷模板项；项：态度；甲：□1；字段3：□2", "满意度问卷模板项；项：速度；甲：□"]
    many = frame(spark, "a", [[f"v{i}", "", f"w{i}"] for i in range(1, 10)] + [["备注：", "说明文"]])
    plain = texts(layouts.LAYOUTS["assessment"](many))
    assert [r[1] for r in plain] == list(range(3, 11)) and plain[0][4] == "测评项目：v3；评分标准：w3" and plain[-1][2:] == ("note", None, "备注：说明文")
    hinted = texts(layouts.LAYOUTS["addresses"](many, hints=hints))
    assert [(r[1], r[4]) for r in hinted] == [(2, "项：v2；字段3：w2"), (4, "项：v4；字段3：w4"), (9, "项：v9；字段3：w9")]


def test_teams_roles_steps(spark):
    team = frame(spark, "g", [["指挥组"], ["单位", "职责"], ["甲", "乙"], ["保障组"], ["丙", "丁", "长", "值班", "110"]])
    assert [r[3:] for r in texts(layouts.teams(team))] == [("指挥组", "单位/厂家/专业：甲；职责/岗位：乙"), ("保障组", "单位：丙；姓名：丁；职务：长；职责：值班；电话：110")]
    assert [r[4] for r in texts(layouts.roles(frame(spark, "r", [["角色", "职责"], ["", "a", "b"], ["c", "c", "d"]])))] == ["角色：a；职责：b", "角色：c；职责：d"]
    done = texts(layouts.steps(frame(spark, "s", [["开"], [" "], ["关"]]), "全部"))
    assert [(r[1], r[2], r[4]) for r in done] == [(0, "procedure", "全部：1. 步骤1：开；2. 步骤2：关"), (1, "instruction_step", "步骤1：开"), (3, "instruction_step", "步骤2：关")]
    faults = texts(layouts.commands(frame(spark, "f", [["项", "命令"], ["华为", "中兴"], ["查", "show"], ["看", "-"]]), "步骤表"))
    assert [(r[1], r[4]) for r in faults] == [(0, "步骤表：1. 项：查；命令：show；2. 项：看"), (3, "项：查；命令：show"), (4, "项：看")]


@pytest.mark.parametrize("n", [0, 1])
def test_dispatch(spark, n):
    rows = [("a", "team", 1, ["g"]), ("a", "team", 3, ["x", "y"]), ("b", "free", 1, ["h"]), ("b", "free", 2, ["v"]), ("c", "names", 1, ["a：", "b"]), ("d", None, 1, ["h"]), ("d", None, 2, [None]), ("e", "team", 3, None)]
    found = layouts.resolved(spark.createDataFrame(rows if n else [], ROWS), {"team": "team", "names": "schema"})
    assert texts(found) == ([("a", 3, "data_row", "g", "单位/厂家/专业：x；职责/岗位：y"), ("b", 2, "data_row", None, "h：v"), ("c", 1, "schema", None, "字段：a、b")] if n else [])


def test_document_segments(spark):
    schema = "file_id string, block_index long, block_type string, style string, level int, table_index int, row int, col int, text string"
    cell = lambda r, c, t: ("f", 4, "table_cell", None, 0, 1, r, c, t)
    rows = [("f", 1, "paragraph", "heading 1", 1, None, None, None, "一"), ("f", 2, "paragraph", "heading 2", 2, None, None, None, "二"), ("f", 3, "paragraph", None, 0, None, None, None, "文")]
    rows += [cell(1, 1, "编号"), cell(1, 2, "7"), cell(2, 1, "项目"), cell(2, 2, "结果"), cell(3, 1, ""), cell(3, 2, " "), cell(4, 1, "电"), cell(4, 2, "好"), cell(4, 3, "外")]
    found = {r.ordinal: r.text for r in segments.document_segments(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert found == {1: "一", 2: "章节：一。二", 3: "章节：一 / 二。文", 4: "章节：一 / 二。编号：7", 5: "章节：一 / 二。表头：项目 | 结果", 6: "章节：一 / 二。项目：电；结果：好；列3：外"}


def test_sheet_and_page_segments(spark):
    cells = spark.createDataFrame([("f", 0, "S", 2, 2, "b"), ("f", 0, "S", 2, 1, " a "), ("f", 0, "S", 1, 1, " "), ("f", 1, "T", 1, 1, "c")], "file_id string, sheet_index int, sheet_name string, row int, col int, value string")
    assert sorted((r.ordinal, r.row, r.text) for r in segments.sheet_rows(cells).collect()) == [(1, 2, "a | b"), (2, 1, "c")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<s xmlns:a="x"><a:t>one</a:t><a:x>no</a:x><a:t> two </a:t></s>')
        z.writestr("ppt/slides/slide2.xml", "<s/>")
        z.writestr("visio/pages/page1.xml", "<p><q>v</q></p>")
        z.writestr("visio/pages/page2.xml", "<broken")
    made = spark.createDataFrame([("a", out.getvalue()), ("b", b"PK\x03\x04no"), ("c", None)], "attachment_id string, payload binary")
    assert sorted((r.ordinal, r.block_type, r.page_index, r.text) for r in segments.page_segments(made).collect()) == [(1, "pptx_slide", 1, "one；two"), (2, "vsdx_page", 1, "v")]
