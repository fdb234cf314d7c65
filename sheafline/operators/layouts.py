"""Tables of a known layout as segments, one plan for each layout.

Rows are ``(table_id, category, row, values)``; ``row`` counts from 1. Segments are those of ``tables.resolve``:
``table_id, category, row, role, group, text, fallback``. Every step is a projection or a window over one table's
rows, so tables of all categories go through in one shuffle by table. Rows without a value give nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import carry_forward, first_match
from .tables import Spec, aggregates, optical_specs, resolve, without_repeats

#: Header names of the layouts.
DUTIES, DUTIES_HEADER = ("序号", "工作领域", "职责/任务"), ("序号", "工作领域", "内部分配主要职责、任务")
KEY_VALUE = ("字段", "内容")
CABINETS = ("数据中心名称", "机房", "机柜总数", "已使用", "未使用", "具体机柜分布情况")
CABINETS_BY_WIDTH = {4: ("机房", "机柜总数", "已使用", "具体机柜分布情况"), 5: ("数据中心名称", "机房", "机柜总数", "已使用", "具体机柜分布情况")}
RATINGS = ("评价项", "非常满意", "满意", "一般", "不满意", "非常不满意")
ASSESSMENT = ("测评项目", "评分标准", "评分", "备注")
ADDRESSES = ("地址类型", "互联地址", "业务地址")
TEAM, TEAM_OF_TWO = ("单位", "姓名", "职务", "职责", "电话"), ("单位/厂家/专业", "职责/岗位")
ROLES = ("角色", "职责")
VENDORS = ("华为", "诺基亚", "中兴", "锐捷", "华三")
TOTAL, NOTE = "合计", ("备注", "说明")


def _texts(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _prepared(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: the values that aren't empty, without those that equal the one before."""
    shown = rows.withColumn("shown", F.transform("values", T.collapse))
    return shown.withColumn("kept", without_repeats(F.filter("shown", lambda v: v != ""))).withColumn("n", F.size("kept"))


def _segments(rows: DataFrame, role: Column | str, headers: Column, values: Column, group: Column | None = None, prefix: str = "") -> DataFrame:
    text, role = T.pair_values(headers, values), F.lit(role) if isinstance(role, str) else role
    group = F.lit(None).cast("string") if group is None else group
    return rows.where(F.col("n") > 0).select("table_id", "category", "row", role.alias("role"), group.alias("group"), F.concat(F.lit(prefix), text).alias("text"), T.lacks_header(headers, values).alias("fallback"))


def profiles(rows: DataFrame, fields_before: int | None = None) -> DataFrame:
    """A subject in the first row, then fields; a row of one value names the group of the rows below.

    With ``fields_before`` rows before that one are single fields, it and any inner header are left out, and the
    rows after have the columns of duties. Without, rows of four values or more in pairs are keys and values by
    turns. All texts but the first start with the subject.
    """
    table = Window.partitionBy("table_id")
    rows = _prepared(rows).withColumn("lead", F.lit(1) if fields_before else F.min("row").over(table))
    subject = F.max(F.when(F.col("row") == F.col("lead"), T.alternating_pairs(F.col("kept")))).over(table)
    rows = rows.withColumn("subject", subject).where((F.col("n") > 0))
    if fields_before:
        rows = rows.where((F.col("row") != fields_before) & ~F.coalesce(F.slice("values", 1, 3) == _texts(*DUTIES_HEADER), F.lit(False)))
    top, single, fields = F.col("row") == 1, F.col("n") == 1, F.col("row") < (fields_before or 0)
    group = carry_forward(F.when(single & ~top, F.col("kept")[0]), ["table_id"], ["row"])
    by_turns = (F.col("n") > 2) & (F.col("n") % 2 == 0) if fields_before is None else F.lit(False)
    headers = _texts(*(DUTIES if fields_before else KEY_VALUE))
    one_field = F.concat_ws("：", T.clean_header(F.col("kept")[0]), F.get("kept", F.lit(1)))
    body = first_match([(top | by_turns, T.alternating_pairs(F.col("kept"))), (single, F.concat(F.lit("栏目："), F.col("kept")[0])), (fields, one_field)], T.pair_values(headers, F.col("kept")))
    role = first_match([(top, "metadata"), (single, "context"), (fields, "kv")], "data_row" if fields_before else "kv")
    named = rows.withColumns({"role": role, "body": body, "group": F.when(~top & ~(fields & ~single), group)})
    known = top | (F.col("subject") == "") | (F.col("body") == "") | F.startswith("body", F.col("subject"))
    text = F.when(F.coalesce(known, F.lit(True)), F.col("body")).otherwise(F.concat("subject", F.lit("；"), "body"))
    lacks = ~(top | single | fields | by_turns) & T.lacks_header(headers, F.col("kept"))
    return named.select("table_id", "category", "row", "role", "group", text.alias("text"), lacks.alias("fallback"))


def cabinets(rows: DataFrame) -> DataFrame:
    """Rows from the third on, of four, five or six columns. A blank first of six takes the centre above, or the next below; totals are none."""
    rows = _prepared(rows).where(F.col("row") > 2)
    first, wide = F.get("shown", F.lit(0)), F.size("values") >= 6
    own = F.when(wide & ~T.marked_blank(first) & (first != TOTAL), first)
    rows = rows.withColumn("centre", carry_forward(own, ["table_id"], ["row"], look_ahead=True))
    values = F.when(wide & T.marked_blank(first), F.concat(F.array(F.coalesce("centre", F.lit(""))), F.slice("values", 2, F.size("values") - 1))).otherwise(F.col("values"))
    headers = first_match([(F.size("values") == n, _texts(*names)) for n, names in CABINETS_BY_WIDTH.items()], _texts(*CABINETS))
    return _segments(rows, "data_row", headers, values)


def _hinted(rows: DataFrame, hints: DataFrame | None, headers: Sequence[str], data_rows: Sequence[int] = ()) -> DataFrame:
    """``rows`` with headers and data_rows: those of ``hints(table_id, headers, data_rows)``, one row a table, else these."""
    given = rows.withColumn("own", F.lit(True)) if hints is None else rows.join(hints.select("table_id", F.col("headers").alias("h"), F.col("data_rows").alias("d")), "table_id", "left")
    if hints is None:
        return given.withColumns({"headers": _texts(*headers), "data_rows": F.array(*[F.lit(i) for i in data_rows]).cast("array<int>")}).drop("own")
    told = lambda c: F.when(F.size(c) > 0, F.col(c))
    return given.withColumns({"headers": F.coalesce(told("h"), _texts(*headers)), "data_rows": F.coalesce(told("d"), F.array(*[F.lit(i) for i in data_rows]).cast("array<int>"))}).drop("h", "d")


def questionnaires(rows: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Options under a group; a group is one value, or an aspect (``方面``) with three boxes or more."""
    rows = _hinted(_prepared(rows), hints, RATINGS).where(F.col("n") > 0)
    boxes = F.size(F.filter(F.slice("kept", 2, F.size("kept")), lambda v: F.startswith(v, F.lit("□"))))
    is_group = (F.col("n") == 1) | (F.endswith(F.col("kept")[0], F.lit("方面")) & (boxes >= 3))
    rows = rows.withColumn("group", carry_forward(F.when(is_group, F.col("kept")[0]), ["table_id"], ["row"])).where(~is_group)
    return _segments(rows, "questionnaire_option", F.col("headers"), F.col("kept"), F.col("group"), "满意度问卷模板项；")


def chosen_rows(rows: DataFrame, headers: Sequence[str], data_rows: Sequence[int], hints: DataFrame | None = None, whole: bool = False, note_row: int | None = None) -> DataFrame:
    """The rows of a fixed or hinted set; ``whole`` keeps empty and repeated values in place. ``note_row`` gives a remark besides."""
    rows = _hinted(_prepared(rows), hints, headers, data_rows)
    found = _segments(rows.where(F.array_contains("data_rows", F.col("row"))), "data_row", F.col("headers"), F.col("values" if whole else "kept"))
    if note_row is None:
        return found
    told = (T.clean_header(F.get("kept", F.lit(0))) == NOTE[0]) & (F.col("n") > 1)
    values = F.when(told, F.slice("kept", 2, 1)).otherwise(F.col("kept"))
    return found.unionByName(_segments(rows.where(F.col("row") == note_row), "note", _texts(*NOTE), values))


def teams(rows: DataFrame) -> DataFrame:
    """The first row is a group, the second a header, a single value the next group; two columns or five."""
    rows = _prepared(rows)
    group = F.when(F.col("row") == 1, F.get("kept", F.lit(0))).when((F.col("row") > 2) & (F.col("n") == 1), F.get("kept", F.lit(0)))
    rows = rows.withColumn("group", carry_forward(group, ["table_id"], ["row"])).where("row > 2 and n <> 1")
    return _segments(rows, "data_row", F.when(F.col("n") == 2, _texts(*TEAM_OF_TWO)).otherwise(_texts(*TEAM)), F.col("kept"), F.col("group"))


def roles(rows: DataFrame) -> DataFrame:
    """Role and duty; where the first of three cells is empty they are the second and third."""
    moved = (F.size("values") >= 3) & (F.get("shown", F.lit(0)) == "")
    return _segments(_prepared(rows).where("row > 1"), "data_row", _texts(*ROLES), F.when(moved, F.slice("values", 2, 2)).otherwise(F.col("kept")))


def steps(rows: DataFrame, title: str, label: str = "步骤") -> DataFrame:
    """Each row's first value as a numbered step, and the whole procedure where there are two or more."""
    rows = _prepared(rows).where("n > 0")
    number = F.row_number().over(Window.partitionBy("table_id").orderBy("row"))
    found = rows.select("table_id", "category", "row", F.lit("instruction_step").alias("role"), F.lit(None).cast("string").alias("group"), F.concat(F.lit(label), number.cast("string"), F.lit("："), F.col("kept")[0]).alias("text"), F.lit(False).alias("fallback"))
    return found.unionByName(aggregates(found, None, title=title))


def statements(rows: DataFrame) -> DataFrame:
    """Each row's first value as a statement."""
    return _prepared(rows).where("n > 0").select("table_id", "category", "row", F.lit("statement").alias("role"), F.lit(None).cast("string").alias("group"), F.concat(F.lit("说明："), F.col("kept")[0]).alias("text"), F.lit(False).alias("fallback"))


def commands(rows: DataFrame, title: str, role: str = "data_row", whole: bool = True, vendors: Sequence[str] = VENDORS) -> DataFrame:
    """Rows under the header of the first, without rows that only name vendors, and all of them as one procedure."""
    rows = _prepared(rows).withColumn("head", F.max(F.when(F.col("row") == 1, F.col("values"))).over(Window.partitionBy("table_id")))
    only_vendors = (F.size(F.array_except("kept", _texts(*vendors))) == 0) & (F.col("n") >= 2) if vendors else F.lit(False)
    found = _segments(rows.where((F.col("row") > 1) & ~only_vendors), role, F.coalesce("head", F.array().cast("array<string>")), F.col("values" if whole else "kept"))
    return found.unionByName(aggregates(found, None, "table_procedure", title))


def schema(rows: DataFrame, row: int = 1) -> DataFrame:
    """The names in one row, as a segment that holds no data."""
    names = F.filter(F.transform("values", T.clean_header), lambda v: v != "")
    return _prepared(rows).where((F.col("row") == row) & (F.col("n") > 0)).select("table_id", "category", "row", F.lit("schema").alias("role"), F.lit(None).cast("string").alias("group"), F.concat(F.lit("字段："), F.array_join(names, "、")).alias("text"), F.lit(False).alias("fallback"))


def specified(rows: DataFrame, spec: Spec) -> DataFrame:
    return resolve(rows.withColumn("category", F.lit(spec.category)), [spec])


def optical(rows: DataFrame) -> DataFrame:
    named = rows.select("table_id", "category").distinct()
    return optical_specs(rows).join(named, "table_id").select("table_id", "category", "row", "role", "group", "text", F.lit(False).alias("fallback"))


Layout = Callable[[DataFrame], DataFrame]
#: Layouts by name, for ``resolved``.
LAYOUTS: dict[str, Layout] = {
    "department": partial(profiles, fields_before=6), "position": profiles, "cabinets": cabinets, "questionnaire": questionnaires,
    "assessment": partial(chosen_rows, headers=ASSESSMENT, data_rows=range(3, 10), note_row=10), "addresses": partial(chosen_rows, headers=ADDRESSES, data_rows=range(3, 7), whole=True),
    "team": teams, "roles": roles, "steps": partial(steps, title="完整步骤"), "statements": statements,
    "faults": partial(commands, title="完整排查步骤"), "commands": partial(commands, title="完整命令序列", role="command_row", whole=False, vendors=()), "schema": schema, "optical": optical,
}


def resolved(rows: DataFrame, layouts: Mapping[str, str], specs: Sequence[Spec] = (), hints: DataFrame | None = None) -> DataFrame:
    """Segments of all tables, by the layout of their category; other categories go by ``specs`` or the default.

    ``layouts`` maps categories to names of LAYOUTS. ``hints(table_id, headers, data_rows)`` is for the layouts
    that take hints.
    """
    parts = [resolve(rows.where(~F.coalesce(F.col("category").isin(*layouts), F.lit(False))) if layouts else rows, specs)]
    for name in sorted(set(layouts.values())):
        own = rows.where(F.col("category").isin(*[c for c, n in layouts.items() if n == name]))
        takes = name in ("questionnaire", "assessment", "addresses") and hints is not None
        parts.append(LAYOUTS[name](own, hints=hints) if takes else LAYOUTS[name](own))
    return reduce(DataFrame.unionByName, parts)
