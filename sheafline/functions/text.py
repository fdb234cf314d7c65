"""Column functions over text, cells, numbers, dates and identifiers.

White space is Unicode white space everywhere, as the fields come from spreadsheets with full-width blanks. All
functions are built-in expressions but ``normalize_text``, which needs Unicode compatibility forms and case folding
that Spark has no function for; it is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the fields use it, in Java's syntax.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: Texts that stand for an empty cell.
BLANK_MARKS = ("", "\\", "/", "／", "-", "—", "－")
#: Spellings of true and false.
TRUE_WORDS = ("1", "true", "yes", "y", "是", "有", "支持", "满足", "可提供", "能", "可以", "已配置")
FALSE_WORDS = ("0", "false", "no", "n", "否", "无", "不支持", "不满足", "无法提供", "不能", "不可以", "未配置")
#: Unit spellings (after normalising) as (unit, canonical unit, factor).
UNITS = (
    ("w", "kw", 0.001),
    ("kw", "kw", 1.0),
    ("mw", "kw", 1000.0),
    ("瓦", "kw", 0.001),
    ("千瓦", "kw", 1.0),
    ("kva", "kva", 1.0),
    ("mva", "kva", 1000.0),
    ("个", "count", 1.0),
    ("台", "count", 1.0),
    ("套", "count", 1.0),
    ("路", "count", 1.0),
)
#: Delimiters of lexical tokens.
DELIMITERS = r"""[\s,，;；:：。.!！?？/\\()（）【】\[\]{}<>《》"'“”‘’`~_-]+"""


def blank(value: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(F.length(collapse(value)) == 0, F.lit(True))


def collapse(value: Column) -> Column:
    """Null counts as empty; runs of white space become one space; no space at either end."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), SPACES, " "))


def display_text(value: Column, limit: int | None = None) -> Column:
    """Collapsed text; over ``limit`` characters it becomes its first ``limit - 1`` and three dots."""
    text = collapse(value)
    return text if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("..."))).otherwise(text)


def compact_text(value: Column, limit: int) -> Column:
    """Collapsed text, cut to ``limit`` characters, the last of them an ellipsis if something was cut."""
    text = collapse(value)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def markdown_cell(value: Column) -> Column:
    return F.replace(display_text(value), F.lit("|"), F.lit("\\|"))


@F.pandas_udf(StringType())
def _fold(value: pd.Series) -> pd.Series:
    # Python splits at the white space that SPACES names
    return value.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()), na_action="ignore")


def normalize_text(value: Column) -> Column:
    """Compatibility forms, collapsed white space, case folded. The forms come first, so ℃ becomes °c."""
    return _fold(F.coalesce(value.cast("string"), F.lit("")))


def normalize_enum(value: Column, folded: bool = False) -> Column:
    """Normalised text with letters, digits and ``% °`` only. ``folded``: the value is normalised already."""
    return F.regexp_replace(value if folded else normalize_text(value), r"[^\p{L}\p{N}%℃°]", "")


def _looked_up(table: dict[str, Column], key: Column) -> Column:
    """The key's entry of a constant table, else null. The key is evaluated once, where a chain of conditions does so for each of them."""
    return F.try_element_at(F.create_map(*[x for name, value in table.items() for x in (F.lit(name), value)]), key)


def normalize_bool(value: Column, folded: bool = False) -> Column:
    """True, false or null by fixed spellings."""
    return _looked_up({w: F.lit(truth) for words, truth in ((TRUE_WORDS, True), (FALSE_WORDS, False)) for w in words}, normalize_enum(value, folded))


def parse_number(value: Column, folded: bool = False) -> Column:
    """``struct<value: double, unit: string>`` of the first number and the unit that follows; null without a number."""
    text = F.replace(value if folded else normalize_text(value), F.lit(","), F.lit(""))
    number = F.regexp_extract(text, r"([+-]?\d+(?:\.\d+)?)", 1)
    unit = normalize_enum(F.regexp_extract(text, r"[+-]?\d+(?:\.\d+)?\s*([a-zA-Z\x{4e00}-\x{9fff}%℃°]*)", 1), folded=True)
    factor = F.coalesce(_looked_up({name: F.lit(times) for name, _, times in UNITS}, unit), F.lit(1.0))
    canonical = F.coalesce(_looked_up({name: F.lit(of) for name, of, _ in UNITS}, unit), unit)
    return F.when(number != "", F.struct((number.cast("double") * factor).alias("value"), canonical.alias("unit")))


def parse_date(value: Column, folded: bool = False) -> Column:
    """A date of ``Y-M-D`` (also with /, . or 年月日) or ``YYYYMMDD``; null if the text is none or the day impossible."""
    text = value if folded else normalize_text(value)
    parts = r"^(\d{4})(?:[-/.年](\d{1,2})[-/.月](\d{1,2})日?|(\d{2})(\d{2}))$"
    month = F.concat(F.regexp_extract(text, parts, 2), F.regexp_extract(text, parts, 4))
    day = F.concat(F.regexp_extract(text, parts, 3), F.regexp_extract(text, parts, 5))
    written = F.concat_ws("-", F.regexp_extract(text, parts, 1), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(text.rlike(parts), F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date"))


def normalize_list(value: Column, folded: bool = False) -> Column:
    """Sorted parts between six delimiters, each normalised as an option, blanks dropped, repeats kept."""
    text = value if folded else normalize_text(value)
    return F.array_sort(F.filter(F.transform(F.split(text, r"[,，;；、/]+"), lambda x: normalize_enum(x, folded=True)), lambda x: x != ""))


def compact_key(value: Column) -> Column:
    """No white space at all, full-width brackets as plain ones, lower case."""
    return F.lower(F.translate(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), SPACES, ""), "（）：", "():"))


def sentence_field(label: str, value: Column) -> Column:
    """``label：value。`` without the value's own end marks; null for a blank value."""
    text = F.regexp_replace(collapse(value), r"[。；;，,.]+$", "")
    return F.when(text != "", F.concat(F.lit(f"{label}："), text, F.lit("。")))


def marked_blank(value: Column) -> Column:
    """True for null, white space and the marks that stand for an empty cell."""
    return collapse(value).isin(*BLANK_MARKS)


def clean_header(value: Column) -> Column:
    """A header without white space and without colons at its end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), SPACES, ""), "[：:]+$", "")


def pair_values(headers: Column, values: Column, fallback: str = "字段") -> Column:
    """``header：value`` of the values that aren't blank, joined by ``；``. A missing header becomes ``fallback`` and its place."""

    def one(v: Column, i: Column) -> Column:
        name = clean_header(F.get(headers, i))
        return F.when(~marked_blank(v), F.concat(F.when(name == "", F.concat(F.lit(fallback), (i + 1).cast("string"))).otherwise(name), F.lit("："), collapse(v)))

    return F.array_join(F.array_compact(F.transform(values, one)), "；")


def lacks_header(headers: Column, values: Column) -> Column:
    """True if ``pair_values`` has to make up a header."""
    return F.exists(F.transform(values, lambda v, i: ~marked_blank(v) & (clean_header(F.get(headers, i)) == "")), lambda x: x)


def alternating_pairs(values: Column, fallback: str = "字段") -> Column:
    """Key and value by turns, as ``key：value`` joined by ``；``; keys without a value give nothing."""

    def one(v: Column, i: Column) -> Column:
        key, value = clean_header(v), F.get(values, i + 1)
        return F.when((i % 2 == 0) & ~marked_blank(value), F.concat(F.when(key == "", F.concat(F.lit(fallback), (i + 1).cast("string"))).otherwise(key), F.lit("："), collapse(value)))

    return F.array_join(F.array_compact(F.transform(values, one)), "；")


def col_to_num(letters: Column) -> Column:
    """A=1, Z=26, AA=27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def num_to_col(number: Column) -> Column:
    """The letters of a column number up to 18278 (three letters)."""
    n = number.cast("int")
    third, rest = (n - 703) / 676, n
    letter = lambda x: F.chr((F.lit(65) + x).cast("int"))
    one = letter((rest - 1) % 26)
    two = F.when(rest > 26, letter(F.floor((rest - 27) / 26) % 26)).otherwise("")
    three = F.when(rest > 702, letter(F.floor(third) % 26)).otherwise("")
    return F.concat(three, two, one)


def split_ref(ref: Column) -> Column:
    """``struct<row, col>`` of an A1 address with or without ``$``; null for anything else."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?(\d{1,7})$"
    return F.when(ref.rlike(pattern), F.struct(F.regexp_extract(ref, pattern, 2).cast("int").alias("row"), col_to_num(F.regexp_extract(ref, pattern, 1)).alias("col")))


def cell_ref(row: Column, col: Column) -> Column:
    return F.concat(num_to_col(col), row.cast("string"))


def stable_hash(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by ``|``; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file_"), F.substring(F.sha1(path), 1, 10))


def point_id(chunk_id: Column) -> Column:
    """A UUID of the first 32 hex digits of the id's SHA-256."""
    return F.regexp_replace(F.substring(F.sha2(chunk_id, 256), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def lexical_tokens(query: Column) -> Column:
    """The whole phrase and its parts between delimiters, of two characters or more, lower case, repeats kept."""
    text = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    return F.filter(F.concat(F.array(text), F.split(text, DELIMITERS)), lambda t: F.length(t) >= 2)


def lexical_score(query: Column, text: Column) -> Column:
    """How many of the query's tokens the text contains."""
    lowered = F.lower(text)
    return F.size(F.filter(lexical_tokens(query), lambda t: F.contains(lowered, t)))


def recall_at(gold: Column, found: Column, k: int) -> Column:
    """Share of the distinct gold ids among the first ``k`` found; null without gold."""
    distinct = F.array_distinct(gold)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, F.slice(found, 1, k))) / F.size(distinct))


def prediction_comment(confidence: Column, chunk_ids: Column, attachment_ids: Column, status: Column, trace_id: Column) -> Column:
    """Five lines that tell where an answer comes from. Nulls are empty, a confidence of null is 0."""
    listed = lambda ids: F.coalesce(F.array_join(ids, ", "), F.lit(""))
    # fixed values: the names of the lines
    lines = {"confidence": F.format_string("%.4f", F.coalesce(confidence, F.lit(0.0))), "source_chunk_ids": listed(chunk_ids), "evidence_attachment_ids": listed(attachment_ids), "answer_status": F.coalesce(status, F.lit("")), "trace_id": F.coalesce(trace_id, F.lit(""))}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines.items()])
