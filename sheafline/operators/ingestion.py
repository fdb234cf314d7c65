"""The expanded manifest: everything that is embedded, from the curated manifest, introductions and embedded objects.

Each source is a plan that yields the same columns; the union keeps, of records with the same chunk_id, that of the
earliest source. Where a record's namespace comes from is a column of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .manifest import facet_counts

#: The namespace of what belongs to several centres, and what is not embedded.
GLOBAL = "global"
LEFT_OUT_ROLES, LEFT_OUT_TYPES = ("survey_form",), ("dwg",)
#: Texts around an introduction's content, and the places in it.
INTRO_TEXT = "数据中心：{namespace}。文件：{file_name}。文档类型：机房情况说明介绍。位置：{place}。内容：{raw_text}。"
PARAGRAPH, TABLE_ROW, COLUMN = "段落{0}", "表{0} 行{1}", "列"
#: Names and boosts of the three sources, in the order in which they win.
CURATED, INTRO, EMBEDDED = "step11_curated_manifest", "step04a_intro_doc", "step04b_raw_embedded_segments"
EMBEDDED_BOOST = 0.88

COLUMNS = (
    "chunk_id string, source_type string, source_segment_id string, namespace string, namespace_source string, namespace_candidates array<string>, corpus_layer string, embedding_policy string, default_index boolean, full_store_source string, manifest_default_index boolean, rank_boost double, "
    "text_for_embedding string, raw_text string, file_name string, relative_path string, sheet_name string, row_index string, anchor string, table_id string, parent_chunk_id string, parent_attachment_id string, embedded_file_name string, embedded_file_type string, proof_cell_refs array<string>, retrieval_tags array<string>"
)


def filled(pattern: str, **values: Column) -> Column:
    """A text with the columns in the places of their names in braces; a null is an empty text."""
    parts, rest = [], pattern
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        name, _, rest = after.partition("}")
        if brace:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def first_filled(sources: Sequence[tuple[str, Column]], default: str) -> Column:
    """``struct<value, source>``: the first of the named columns that is neither null nor empty, else the default."""
    held = F.array(*[F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("value"), F.lit(n).alias("source")) for n, c in sources], F.struct(F.lit(default).alias("value"), F.lit("default").alias("source")))
    return F.filter(held, lambda x: x["value"] != "")[0]


def namespaces(files: DataFrame, routed: DataFrame) -> DataFrame:
    """``file_id, namespace, namespace_source, namespace_candidates`` for every row of ``files(file_id, data_center_id)``.

    A file's own centre comes first, then the one it was routed to, then ``global``; candidates are those of
    ``routed(file_id, data_center_id, route_candidates)`` that aren't empty, in their order, also where they weren't taken.
    """
    own = files.select("file_id", F.col("data_center_id").alias("__own"))
    to = routed.select("file_id", F.col("data_center_id").alias("__to"), F.col("route_candidates").alias("__candidates"))
    taken = first_filled([("file", F.col("__own")), ("routed", F.col("__to"))], GLOBAL)
    candidates = F.filter(F.coalesce("__candidates", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")
    return own.join(to, "file_id", "left").select("file_id", taken.alias("__n"), candidates.alias("namespace_candidates")).select("file_id", F.col("__n.value").alias("namespace"), F.col("__n.source").alias("namespace_source"), "namespace_candidates")


def _shaped(df: DataFrame) -> DataFrame:
    """The columns of a record in their order and types; those that a source doesn't have are null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ") for c in COLUMNS.split(", "))])


def curated_records(manifest: DataFrame) -> DataFrame:
    """The chunks of ``manifest`` whose text isn't blank, with their own layers; ``manifest_default_index`` says whether they were in the default index."""
    kept = manifest.where(T.collapse(F.col("text_for_embedding")) != "")
    return _shaped(kept.withColumns({"full_store_source": F.lit(CURATED), "manifest_default_index": F.coalesce("default_index", F.lit(False))}))


def _table_rows(cells: DataFrame) -> DataFrame:
    """``file_id, table_index, row, raw_text`` of cells ``(file_id, table_index, row, col, text)``: the values of a row under those of the table's first."""
    keys = ["file_id", "table_index"]
    listed = cells.where("row > 0 and col > 0").groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", T.collapse(F.col("text"))))).alias("by_col"))
    values = F.transform(F.sequence(F.lit(1), F.array_max(F.map_keys("by_col"))), lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit("")))
    listed = listed.withColumn("values", values)
    # the first row of a table is one row: it is found by an aggregate and joined to the others
    header = listed.groupBy(*keys).agg(F.min_by("values", "row").alias("header"))
    label = lambda i: F.coalesce(F.get("header", i), F.concat(F.lit(COLUMN), (i + 1).cast("string")))
    paired = F.transform("values", lambda v, i: F.when(v == "", None).when(label(i) == "", v).otherwise(F.concat(label(i), F.lit("："), v)))
    plain = F.filter("values", lambda v: v != "")
    text = F.when(F.col("row") == 1, F.array_join(plain, "；")).otherwise(F.array_join(F.array_compact(paired), "；"))
    return listed.join(header, keys).select(*keys, "row", T.collapse(text).alias("raw_text"))


def intro_records(files: DataFrame, routed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Paragraphs and table rows of introductions, under the namespace of their file.

    ``files(file_id, file_name, relative_path, document_role, data_center_id)``; ``blocks`` as ``ooxml.blocks`` yields
    them. Paragraphs are numbered among the paragraphs of their file.
    """
    intro = files.where("document_role = 'intro_doc'").select("file_id", "file_name", "relative_path", "data_center_id")
    held = intro.drop("data_center_id").join(namespaces(intro, routed), "file_id")
    number = F.row_number().over(Window.partitionBy("file_id").orderBy("block_index"))
    told = blocks.where("block_type = 'paragraph'").select("file_id", "block_index", T.collapse(F.col("text")).alias("raw_text")).where("raw_text <> ''")
    told = told.select("file_id", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("table_index"), number.alias("row"), "raw_text")
    rows = _table_rows(blocks.where("block_type = 'table_cell'")).where("raw_text <> ''").select("file_id", F.lit("table").alias("kind"), "table_index", "row", "raw_text")
    both = told.unionByName(rows).join(held, "file_id")
    table = F.col("kind") == "table"
    place = F.when(table, filled(TABLE_ROW, **{"0": F.col("table_index"), "1": F.col("row")})).otherwise(filled(PARAGRAPH, **{"0": F.col("row")}))
    chunk = F.concat(F.lit("intro_"), F.when(table, T.stable_hash(F.col("file_id"), F.col("kind"), F.col("table_index"), F.col("row"), F.col("raw_text"))).otherwise(T.stable_hash(F.col("file_id"), F.col("kind"), F.col("row"), F.col("raw_text"))))
    named = both.withColumns({
        "chunk_id": chunk, "source_segment_id": chunk, "place": place, "source_type": F.when(table, "intro_doc_table_row").otherwise("intro_doc_paragraph"), "corpus_layer": F.lit("intro_doc"), "embedding_policy": F.lit("embed_intro"),
        "default_index": F.lit(True), "full_store_source": F.lit(INTRO), "rank_boost": F.lit(1.0), "row_index": F.col("row"),
        "anchor": F.when(table, filled("{f}!table {t} row {r}", f=F.col("file_name"), t=F.col("table_index"), r=F.col("row"))).otherwise(filled("{f}!paragraph {r}", f=F.col("file_name"), r=F.col("row"))),
        "table_id": F.when(table, filled("intro_table_{f}_{t}", f=F.col("file_id"), t=F.col("table_index"))),
        "proof_cell_refs": F.array().cast("array<string>"), "retrieval_tags": F.when(table, F.array(F.lit("intro_doc"), F.lit("intro_doc_table"), "namespace", "file_name")).otherwise(F.array(F.lit("intro_doc"), "namespace", "file_name")),
    })
    return _shaped(named.withColumn("text_for_embedding", filled(INTRO_TEXT, namespace=F.col("namespace"), file_name=F.col("file_name"), place=F.col("place"), raw_text=F.col("raw_text"))))


def embedded_records(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments of embedded objects: not those of forms, drawings or images, nor blank ones.

    ``segments(segment_id, segment_type, raw_text, embedding_text, data_center_id, embedded_file_type,
    embedded_file_name, local_part, parent_file_id, parent_file_name, parent_sheet_name, parent_source_cell,
    parent_segment_id, parent_attachment_id)``; ``files(file_id, document_role, relative_path)``.
    """
    parent = files.select(F.col("file_id").alias("parent_file_id"), F.col("document_role").alias("__role"), F.col("relative_path").alias("__path"))
    kind = F.lower(T.collapse(F.coalesce("embedded_file_type", F.lit(""))))
    raw = T.collapse(F.coalesce("raw_text", F.lit("")))
    told = T.collapse(F.coalesce(F.nullif(F.col("embedding_text"), F.lit("")), "raw_text", F.lit("")))
    space = first_filled([("segment", T.collapse(F.col("data_center_id")))], GLOBAL)
    rows = segments.join(parent, "parent_file_id", "left").withColumns({"kind": kind, "raw_text": raw, "told": told, "space": space})
    image = F.contains(F.lower(T.collapse(F.coalesce("segment_type", F.lit("")))), F.lit("image"))
    kept = rows.where(~F.coalesce(F.col("__role").isin(*LEFT_OUT_ROLES), F.lit(False)) & ~F.col("kind").isin(*LEFT_OUT_TYPES) & ~image & (F.col("raw_text") != "") & (F.col("told") != ""))
    cell = F.col("parent_source_cell")
    named = kept.select(
        F.concat(F.lit("raw_"), T.stable_hash(F.lit("embedded_raw"), F.col("segment_id"), F.col("told"))).alias("chunk_id"), F.lit("embedded_raw_segment").alias("source_type"), F.col("segment_id").alias("source_segment_id"), F.col("space.value").alias("namespace"), F.col("space.source").alias("namespace_source"),
        F.array().cast("array<string>").alias("namespace_candidates"), F.lit("raw_text").alias("corpus_layer"), F.lit("embed_raw_full").alias("embedding_policy"), F.lit(True).alias("default_index"), F.lit(EMBEDDED).alias("full_store_source"), F.lit(EMBEDDED_BOOST).alias("rank_boost"), F.col("told").alias("text_for_embedding"), "raw_text",
        F.col("parent_file_name").alias("file_name"), F.coalesce("__path", "parent_file_name").alias("relative_path"), F.col("parent_sheet_name").alias("sheet_name"), cell.alias("row_index"),
        F.trim(filled("{s}!{c} {k} {p}", s=F.col("parent_sheet_name"), c=cell, k=F.col("kind"), p=F.col("local_part"))).alias("anchor"), F.col("parent_segment_id").alias("parent_chunk_id"), "parent_attachment_id", "embedded_file_name", F.col("kind").alias("embedded_file_type"),
        F.when(F.coalesce(cell, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(cell)).alias("proof_cell_refs"), F.array(F.lit("embedded_raw"), F.col("space.value"), "kind", "segment_type", "embedded_file_name").alias("retrieval_tags"),
    )
    return _shaped(named)


def expanded_manifest(parts: Sequence[DataFrame]) -> DataFrame:
    """The records of all parts; of those with the same chunk_id, one of the earliest part that has it, by its texts.

    Only ids are shuffled to find them where they don't repeat: counts are added up before, and repeats alone are ranked.
    """
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in out.columns if c != "chunk_id"]), F.struct("__part", "text_for_embedding", "raw_text", "anchor")).alias("r")).select("chunk_id", *[F.col(f"r.{c}") for c in out.columns if c not in ("chunk_id", "__part")])


FACETS = ("full_store_source", "source_type", "corpus_layer", "namespace", "embedding_policy")


def manifest_summary(parts: Sequence[DataFrame], manifest: DataFrame) -> DataFrame:
    """``facet, value, n``: counts of each facet, ``total_records``, and the ``duplicate_chunk_ids_skipped`` of the parts."""
    read = parts[0].select("chunk_id")
    for part in parts[1:]:
        read = read.unionByName(part.select("chunk_id"))
    skipped = read.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("k")).select(F.lit("duplicate_chunk_ids_skipped").alias("facet"), F.lit("all").alias("value"), (F.col("n") - F.col("k")).alias("n"))
    total = manifest.agg(F.count("*").alias("n")).select(F.lit("total_records").alias("facet"), F.lit("all").alias("value"), "n")
    return facet_counts(manifest, *FACETS).unionByName(total).unionByName(skipped)
