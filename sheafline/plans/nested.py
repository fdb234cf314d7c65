"""Registered queries over archives, sheets, the expanded manifest, vectors by cluster, templates and traces.

As in ``catalogue``, the driver's tables stand in for office files; each query says how.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import ingestion, intervals
from sheafline.sources import archives, clusters
from sheafline.stored import scratch

from .catalogue import COSINE_SQL, query, read

# --- archives ----------------------------------------------------------------------------------------------------


@query("""
    select 'd' || lpad(doc_id::varchar, 12, '0') || '.txt' as name, 'p' || doc_id // 400 || '.zip' as root_id, 'g' || lpad((doc_id // 20)::varchar, 12, '0') || '.zip > d' || lpad(doc_id::varchar, 12, '0') || '.txt' as lineage,
           2 as depth, 'leaf' as status, strlen(coalesce(text, ''))::bigint as size, sha256(coalesce(text, '')) as digest, 0 as n_members from documents
    union all
    select 'g' || lpad((doc_id // 20)::varchar, 12, '0') || '.zip', 'p' || doc_id // 400 || '.zip', 'g' || lpad((doc_id // 20)::varchar, 12, '0') || '.zip', 1, 'parsed_archive', null, null, count(*)::int
    from documents group by doc_id // 20, doc_id // 400
    union all
    select 'p' || doc_id // 400 || '.zip', 'p' || doc_id // 400 || '.zip', '', 0, 'parsed_archive', null, null, count(distinct doc_id // 20)::int from documents group by doc_id // 400
""")
def nested_archives(spark, sf_dir):
    """Every document as a file in an archive of 20, those archives in archives of 20, and all of it taken out again."""
    docs = read(spark, sf_dir, "documents")
    padded = lambda c: F.lpad(c.cast("string"), 12, "0")
    group = lambda n: F.floor(F.col("doc_id") / n)
    files = docs.select(F.concat(F.lit("g"), padded(group(20)), F.lit(".zip")).alias("name"), F.concat(F.lit("d"), padded(F.col("doc_id")), F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content"))
    inner = archives.packed(files)
    number = F.floor(F.substring("name", 2, 12).cast("long") / 20)
    outer = archives.packed(inner.select(F.concat(F.lit("p"), number.cast("string"), F.lit(".zip")).alias("name"), F.col("name").alias("member"), "content"))
    found = archives.expanded(outer.select(F.col("name").alias("attachment_id"), "name", "content"), contents=False)
    leaf = F.col("status") == "leaf"
    return found.select("name", "root_id", archives.lineage(F.col("path")).alias("lineage"), "depth", "status", F.when(leaf, F.col("size")).alias("size"), F.when(leaf, F.col("digest")).alias("digest"), "n_members")


@query("""
    select 'p' || doc_id // 400 || '.zip' as root_id, (count(*) + count(distinct doc_id // 20) + 1)::bigint as n_objects, 2 as depth, count(*)::bigint as n_leaves, (count(distinct doc_id // 20) + 1)::bigint as n_archives
    from documents group by doc_id // 400
""")
def archive_totals(spark, sf_dir):
    """The same archives, summed up by root."""
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("g"), F.lpad(F.floor(F.col("doc_id") / 20).cast("string"), 12, "0"), F.lit(".zip"))
    inner = archives.packed(docs.select(name.alias("name"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content")))
    root = F.concat(F.lit("p"), F.floor(F.substring("name", 2, 12).cast("long") / 20).cast("string"), F.lit(".zip"))
    outer = archives.packed(inner.select(root.alias("name"), F.col("name").alias("member"), "content"))
    found = archives.archive_summary(archives.expanded(outer.select(F.col("name").alias("attachment_id"), "name", "content"), contents=False))
    return found.select("root_id", "n_objects", "depth", F.col("statuses")["leaf"].alias("n_leaves"), F.col("statuses")["parsed_archive"].alias("n_archives"))


# --- intervals ---------------------------------------------------------------------------------------------------

RANGES = "select (o_custkey % 40)::int as sheet, o_custkey as first, o_custkey + o_orderkey % 50 as last from orders where o_orderkey % 7 = 0"


@query(f"""
    with cells as (select (l_suppkey % 40)::int as sheet, l_partkey as place, count(*) as n from lineitem group by all), ranges as ({RANGES}),
    flagged as (select *, exists (select 1 from ranges r where r.sheet = c.sheet and c.place between r.first and r.last) as hidden from cells c),
    lengths as (
        select sheet, sum(greatest(0, last - greatest(first, coalesce(reached + 1, first)) + 1))::bigint as hidden_rows from (
            select sheet, first, last, max(last) over (partition by sheet order by first, last rows between unbounded preceding and 1 preceding) as reached from ranges) group by sheet)
    select f.sheet, sum(n)::bigint as n_cells, coalesce(sum(n) filter (where hidden), 0)::bigint as n_hidden, min(place) as least, max(place) as most, coalesce(any_value(hidden_rows), 0)::bigint as hidden_rows
    from flagged f left join lengths l on f.sheet = l.sheet group by f.sheet
""")
def hidden_cells(spark, sf_dir):
    """Line items as cells of 40 sheets at the row of their part; every seventh order hides rows from its customer's number on."""
    cells = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).cast("int").alias("sheet"), F.col("l_partkey").alias("at"))
    ranges = read(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select((F.col("o_custkey") % 40).cast("int").alias("sheet"), F.col("o_custkey").alias("first"), (F.col("o_custkey") + F.col("o_orderkey") % 50).alias("last"))
    flagged = intervals.covered(cells.groupBy("sheet", "at").agg(F.count("*").alias("n")), ranges, ["sheet"], "at", "hidden")
    counted = flagged.groupBy("sheet").agg(F.sum("n").alias("n_cells"), F.sum(F.when(F.col("hidden"), F.col("n")).otherwise(0)).alias("n_hidden"), F.min("at").alias("least"), F.max("at").alias("most"))
    lengths = intervals.covered_length(ranges, ["sheet"], "hidden_rows")
    return counted.join(lengths, "sheet", "left").withColumn("hidden_rows", F.coalesce("hidden_rows", F.lit(0)).cast("long"))


@query("""
    with ranges as (select c_custkey, (c_nationkey % 5)::int as sheet, c_custkey as first, c_custkey + (floor(c_acctbal)::bigint % 300) as last from customer)
    select c_custkey, count(*)::bigint as n_parts, min(p_partkey) as least, sum(p_partkey)::bigint as total
    from ranges r join part p on (p.p_size % 5) = r.sheet and p.p_partkey between r.first and r.last group by c_custkey
""")
def interval_matches(spark, sf_dir):
    """Each customer's range of numbers with the parts in it, sheets by nation and size."""
    ranges = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("int").alias("sheet"), F.col("c_custkey").alias("first"), (F.col("c_custkey") + F.floor("c_acctbal") % 300).alias("last"))
    points = read(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("int").alias("sheet"), "p_partkey")
    found = intervals.interval_pairs(points, ranges, ["sheet"], "p_partkey", "first", "last")
    return found.groupBy("c_custkey").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("least"), F.sum("p_partkey").alias("total"))


# --- the expanded manifest -----------------------------------------------------------------------------------------

# every document is a paragraph of the introduction of its source, nations are a table of the first one's; pages are
# embedded segments; items of the benchmark, and every seventh document under the id of its paragraph, are curated
COLLAPSED = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
MANIFEST_SQL = rf"""
    centres as (
        select file_id, n, case when n % 3 = 0 then 'dc' || n when n % 2 = 0 then 'r' || n else 'global' end as namespace, case when n % 3 = 0 then 'file' when n % 2 = 0 then 'routed' else 'default' end as namespace_source, 'c' || n || ',d' || n as candidates
        from (select distinct source as file_id, substr(source, 4)::bigint as n from documents)
    ), paragraphs as (
        select *, row_number() over (partition by source order by doc_id) as row from (select doc_id, source, {COLLAPSED.format("text")} as raw from documents) where raw <> ''
    ), intro as (
        select 'intro_' || substr(sha256(source || '|paragraph|' || row || '|' || raw), 1, 16) as chunk_id, doc_id, 'intro_doc_paragraph' as source_type, namespace, namespace_source, candidates, source || '.docx!paragraph ' || row as anchor,
               '数据中心：' || namespace || '。文件：' || source || '.docx。文档类型：机房情况说明介绍。位置：段落' || row || '。内容：' || raw || '。' as text_for_embedding
        from paragraphs join centres on source = file_id
    ), nations as (
        select file_id, namespace, namespace_source, candidates, n_nationkey + 2 as row, 'name：' || n_name || '；region：' || n_regionkey as raw from nation, centres where file_id = 'src0'
        union all select file_id, namespace, namespace_source, candidates, 1, 'name；region' from centres where file_id = 'src0'
    ), tables as (
        select 'intro_' || substr(sha256(file_id || '|table|1|' || row || '|' || raw), 1, 16) as chunk_id, null::bigint as doc_id, 'intro_doc_table_row' as source_type, namespace, namespace_source, candidates, file_id || '.docx!table 1 row ' || row as anchor,
               '数据中心：' || namespace || '。文件：' || file_id || '.docx。文档类型：机房情况说明介绍。位置：表1 行' || row || '。内容：' || raw || '。' as text_for_embedding
        from nations
    ), embedded as (
        select 'raw_' || substr(sha256('embedded_raw|' || page_id || '|' || raw), 1, 16) as chunk_id, 'embedded_raw_segment' as source_type, case when page_id % 4 = 0 then 'dc' || page_id % 8 else 'global' end as namespace,
               case when page_id % 4 = 0 then 'segment' else 'default' end as namespace_source, '' as candidates, 'Sheet!B' || page_id || ' docx row' as anchor, raw as text_for_embedding
        from (select page_id, {COLLAPSED.format("html")} as raw from pages where page_id % 5 <> 0 and page_id % 11 <> 0 and page_id % 13 <> 0) where raw <> ''
    ), curated as (
        select 'item_' || item_id as chunk_id, 'benchmark' as source_type, 'global' as namespace, text as text_for_embedding from benchmark where {COLLAPSED.format("text")} <> ''
        union all select chunk_id, 'paragraph', 'curated', 'curated ' || doc_id from intro where doc_id % 7 = 0
    ), parts as (
        select 0 as p, chunk_id, 'step11_curated_manifest' as full_store_source, source_type, namespace, null as namespace_source, null as candidates, null as anchor, text_for_embedding from curated
        union all select 1, chunk_id, 'step04a_intro_doc', source_type, namespace, namespace_source, candidates, anchor, text_for_embedding from intro
        union all select 1, chunk_id, 'step04a_intro_doc', source_type, namespace, namespace_source, candidates, anchor, text_for_embedding from tables
        union all select 2, chunk_id, 'step04b_raw_embedded_segments', source_type, namespace, namespace_source, candidates, anchor, text_for_embedding from embedded
    ), kept as (select * from parts qualify row_number() over (partition by chunk_id order by p, text_for_embedding) = 1)
"""


def _manifest_parts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    n = F.substring("file_id", 4, 20).cast("long")
    sources = docs.select(F.col("source").alias("file_id")).distinct().withColumn("n", n)
    files = sources.select("file_id", F.concat("file_id", F.lit(".docx")).alias("file_name"), F.col("file_id").alias("relative_path"), F.lit("intro_doc").alias("document_role"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("dc"), "n")).when(F.col("n") % 3 == 1, "").alias("data_center_id"))
    routed = sources.select("file_id", F.when(F.col("n") % 2 == 0, F.concat(F.lit("r"), "n")).alias("data_center_id"), F.array(F.concat(F.lit("c"), "n"), F.lit(""), F.lit(None), F.concat(F.lit("d"), "n")).alias("route_candidates"))
    no_int, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    told = docs.select(F.col("source").alias("file_id"), F.col("doc_id").alias("block_index"), F.lit("paragraph").alias("block_type"), no_int.alias("table_index"), no_int.alias("row"), no_int.alias("col"), "text")
    nation = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 2).cast("int").alias("row"), F.array(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("v"))
    lines = nation.unionByName(spark.range(1).select(F.lit(1).alias("row"), F.array(F.lit("name"), F.lit("region")).alias("v")))
    cells = lines.select("row", F.posexplode("v").alias("at", "text")).select(F.lit("src0").alias("file_id"), F.lit(0).cast("long").alias("block_index"), F.lit("table_cell").alias("block_type"), F.lit(1).alias("table_index"), "row", (F.col("at") + 1).alias("col"), "text")
    intro = ingestion.intro_records(files, routed, told.unionByName(cells))
    page = F.col("page_id")
    segments = read(spark, sf_dir, "pages").select(
        page.cast("string").alias("segment_id"), F.when(page % 11 == 0, "Image_ocr").otherwise("embedded_docx_row").alias("segment_type"), F.col("html").alias("raw_text"), no_text.alias("embedding_text"), F.when(page % 4 == 0, F.concat(F.lit(" dc"), page % 8)).alias("data_center_id"),
        F.when(page % 5 == 0, " DWG").otherwise("docx").alias("embedded_file_type"), F.lit("e").alias("embedded_file_name"), F.lit("row").alias("local_part"), F.when(page % 13 == 0, "form").otherwise("src1").alias("parent_file_id"), F.lit("k.xlsx").alias("parent_file_name"),
        F.lit("Sheet").alias("parent_sheet_name"), F.concat(F.lit("B"), page).alias("parent_source_cell"), no_text.alias("parent_segment_id"), no_text.alias("parent_attachment_id"),
    )
    forms = files.unionByName(spark.range(1).select(F.lit("form").alias("file_id"), F.lit("form.xlsx").alias("file_name"), F.lit("form.xlsx").alias("relative_path"), F.lit("survey_form").alias("document_role"), no_text.alias("data_center_id")))
    # the id of a paragraph needs its place among those of its file: the curated ones are taken from the introductions
    number = F.regexp_extract("anchor", r"paragraph (\d+)$", 1).cast("long")
    placed = docs.select("doc_id", F.col("source"), F.row_number().over(ingestion.Window.partitionBy("source").orderBy("doc_id")).alias("row"), "text").where(ingestion.T.collapse(F.col("text")) != "")
    again = intro.where("source_type = 'intro_doc_paragraph'").select("chunk_id", F.regexp_extract("anchor", r"^(.*)\.docx!", 1).alias("source"), number.alias("row"))
    ranked = placed.withColumn("row", F.row_number().over(ingestion.Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    curated = ranked.where("doc_id % 7 = 0").join(again, ["source", "row"]).select("chunk_id", F.lit("paragraph").alias("source_type"), F.lit("curated").alias("namespace"), F.concat(F.lit("curated "), "doc_id").alias("text_for_embedding"), F.lit(True).alias("default_index"))
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), "item_id").alias("chunk_id"), F.lit("benchmark").alias("source_type"), F.lit("global").alias("namespace"), F.col("text").alias("text_for_embedding"), F.lit(False).alias("default_index"))
    return [ingestion.curated_records(items.unionByName(curated)), intro, ingestion.embedded_records(segments, forms)]


@query(f"with {MANIFEST_SQL} select chunk_id, full_store_source, source_type, namespace, namespace_source, candidates, anchor, md5(text_for_embedding) as digest from kept")
def expanded_manifest(spark, sf_dir):
    found = ingestion.expanded_manifest(_manifest_parts(spark, sf_dir))
    return found.select("chunk_id", "full_store_source", "source_type", "namespace", "namespace_source", F.array_join("namespace_candidates", ",").alias("candidates"), "anchor", F.md5(F.col("text_for_embedding").cast("binary")).alias("digest"))


@query(f"""
    with {MANIFEST_SQL}
    select 'full_store_source' as facet, full_store_source as value, count(*) as n from kept group by all union all select 'source_type', source_type, count(*) from kept group by all
    union all select 'namespace', namespace, count(*) from kept group by all union all select 'total_records', 'all', count(*) from kept union all select 'duplicate_chunk_ids_skipped', 'all', count(*) - count(distinct chunk_id) from parts
""")
def manifest_totals(spark, sf_dir):
    parts = _manifest_parts(spark, sf_dir)
    return ingestion.manifest_summary(parts, ingestion.expanded_manifest(parts)).where("facet not in ('corpus_layer', 'embedding_policy')")


# --- vectors by cluster ----------------------------------------------------------------------------------------------


def _clustered(spark, sf_dir):
    held = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") < 5, "a").otherwise("b").alias("namespace"), F.col("embedding").alias("vector"))
    asked = held.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "namespace", "vector")
    return asked, clusters.write(held, scratch(spark))


@query(f"with {COSINE_SQL} select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s) where rank <= 10")
def clustered_topk(spark, sf_dir):
    """The stated query set is every vector whose id is divisible by 50, against all vectors, by clusters with bounds."""
    return clusters.search(*_clustered(spark, sf_dir), 10).select("query_id", "chunk_id", "rank")


@query(f"with {COSINE_SQL} select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s where namespace = target) where rank <= 5")
def clustered_target_topk(spark, sf_dir):
    """The same within each query's own namespace."""
    return clusters.search(*_clustered(spark, sf_dir), 5, "target").select("query_id", "chunk_id", "rank")
