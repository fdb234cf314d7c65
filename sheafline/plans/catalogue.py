"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

The operators are made for office files and their chunks; here the driver's tables stand in for them, by
projections that are stated with each query. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import redact
from sheafline.functions import text as T
from sheafline.operators import audits, evidence, forms, layouts, manifest, metrics, order, planning, retrieval, segments, services, tables, writeback
from sheafline.sources import files, index
from sheafline.sources import segments as sheets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "layered_topk"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- chunks and the manifest -------------------------------------------------------------------------------------

POLICY = "case when quality = 0 then 'exclude' when toxic = 1 then 'exclude_until_fixed' when quality is null then 'metadata_only' when lang = 'en' then 'embed_preferred' when lang = 'fr' then 'embed_with_parent' when lang = 'de' then 'embed_with_image_evidence' else 'embed' end"
CHUNKS_SQL = """
    chunks as (
        select doc_id as chunk_id, lower(text) as text, case when source = 'src0' then 'global' else source end as namespace,
               case lang when 'en' then 'fact' when 'fr' then 'evidence' when 'de' then 'intro_doc' else 'raw_text' end as corpus_layer
        from documents
    ), asked as (
        select item_id as query_id, split_part(text, '.', 1) as query, 'src' || (item_id % 20) as namespace from benchmark
    ), tokens as (
        select query_id, namespace, unnest(list_filter(list_concat([trim(lower(query))], regexp_split_to_array(trim(lower(query)), {delimiters})), lambda t: length(t) >= 2)) as token from asked
    ), scored as (
        select t.query_id, t.namespace as target, c.chunk_id, c.namespace, c.corpus_layer, count(*) filter (contains(c.text, t.token)) as hits
        from tokens t cross join chunks c group by all
    )
""".replace("{delimiters}", _quoted(T.DELIMITERS))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the namespace (the first is global), the language the layer."""
    lang = F.col("lang")
    layer = F.when(lang == "en", "fact").when(lang == "fr", "evidence").when(lang == "de", "intro_doc").otherwise("raw_text")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.when(F.col("source") == "src0", "global").otherwise(F.col("source")).alias("namespace"), layer.alias("corpus_layer"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's first sentence as a question of one of the namespaces."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring_index("text", ".", 1).alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("namespace"))


@query(f"""
    select d.doc_id, substr(sha256(concat_ws('|', 'doc', d.doc_id)), 1, 16) as chunk_id, policy as embedding_policy,
           case when policy = 'metadata_only' then 'meta' when policy = 'embed_as_template' then 'template' when policy like 'exclude%' then 'excluded' when policy like '%image%' then 'evidence' else 'fact' end as corpus_layer,
           case when policy like 'embed_preferred%' then 1.12::double when policy like 'embed_with_parent%' then 1.04::double else 1.0::double end as rank_boost,
           policy in ('embed', 'embed_preferred', 'embed_with_parent', 'embed_with_image_evidence') as default_index
    from (select d.doc_id, {POLICY} as policy from documents d left join labels l using (doc_id)) d
""")
def chunk_manifest(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    named = manifest.with_policy(joined, F.expr(POLICY)).withColumn("chunk_id", T.stable_hash(F.lit("doc"), F.col("doc_id")))
    return named.select("doc_id", "chunk_id", "embedding_policy", "corpus_layer", "rank_boost", "default_index")


@query(r"""
    with t as (select doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g')) as t from documents)
    select doc_id, case when length(t) > 160 then substr(t, 1, 159) || '...' else t end as display,
           case when length(t) > 80 then rtrim(substr(t, 1, 79)) || '…' else t end as compact from t
""")
def doc_compact_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.display_text(F.col("text"), 160).alias("display"), T.compact_text(F.col("text"), 80).alias("compact"))


@query("""
    select doc_id, (s // 500)::int as part, md5(substr(text, (s + 1)::bigint, 500)) as digest
    from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) as s from documents)
""")
def fixed_chunks(spark, sf_dir):
    return retrieval.fixed_chunks(read(spark, sf_dir, "documents"), 500).select("doc_id", "part", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query("""
    with parts as (
        select 'documents' as origin, 0 as p, doc_id as key, text from documents union all
        select 'pages', 1, page_id, html from pages union all
        select 'benchmark', 2, item_id, text from benchmark
    )
    select key, origin, length(text)::int as n from parts where trim(text) <> '' qualify row_number() over (partition by key order by p) = 1
""")
def manifest_union_dedup(spark, sf_dir):
    part = lambda name, key, text: read(spark, sf_dir, name).select(F.lit(name).alias("origin"), F.col(key).alias("key"), F.col(text).alias("text"))
    found = manifest.union_first([part("documents", "doc_id", "text"), part("pages", "page_id", "html"), part("benchmark", "item_id", "text")], "key")
    return found.select("key", "origin", F.length("text").alias("n"))


@query("""
    select coalesce(case when quality = 1 then 'embed' else 'exclude' end, 'exclude') as embedding_policy, l.doc_id is not null as audited, count(*) as n
    from documents d left join labels l using (doc_id) group by all
""")
def audit_left_default(spark, sf_dir):
    audits = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "embed").otherwise("exclude").alias("embedding_policy"), F.lit(True).alias("audited"))
    rows = manifest.audited(read(spark, sf_dir, "documents").select("doc_id"), audits.drop("audited"), "doc_id", "exclude")
    return rows.join(audits.select("doc_id", "audited"), "doc_id", "left").groupBy("embedding_policy", F.coalesce("audited", F.lit(False)).alias("audited")).agg(F.count("*").alias("n"))


@query("""
    with s as (
        select doc_id, lang, case doc_id % 6 when 0 then 'schema' when 1 then 'procedure' when 2 then 'data_row' when 3 then 'context' when 4 then 'instruction_step' else 'other' end as role,
               doc_id % 3 = 0 as has_image, doc_id % 4 = 0 as has_aggregate, doc_id % 5 <> 0 as has_subject, len(list_filter(string_split(text, ' '), lambda w: trim(w) <> '')) as n_words, lower(text) like '%the%' as device from documents
    ), r as (
        select *, case when lang = 'es' and n_words <= 2 and not device then 1 when lang = 'es' then 2 when role = 'schema' then 3 when lang = 'fr' then 4
                       when role in ('procedure', 'table_procedure') then 5 when has_aggregate and role in ('instruction_step', 'command_row', 'data_row') then 6 when role = 'context' then 7
                       when has_image then 8 when lang = 'de' and not has_subject and role <> 'metadata' then 9 when lang = 'de' then 10 else 11 end as k from s
    ), p as (
        select *, ['low_value_incomplete_source', 'ok', 'schema_only', 'template_not_fact', 'ok_aggregate', 'ok_row_with_aggregate', 'context_marker', 'ok_needs_image_evidence', 'needs_subject_context', 'ok_subject_scoped', 'ok'][k] as semantic_status,
               ['exclude', 'embed', 'metadata_only', 'embed_as_template', 'embed_preferred', 'embed_with_parent', 'metadata_only', 'embed_with_image_evidence', 'exclude_until_fixed', 'embed', 'embed'][k] as policy from r
    )
    select doc_id, semantic_status, case when not has_image or k = 8 then policy when policy = 'embed' then 'embed_with_image_evidence' when policy in ('embed_with_parent', 'embed_preferred') then policy || '_and_image' else policy end as embedding_policy from p
""")
def policy_rule_chain(spark, sf_dir):
    role = F.expr("case doc_id % 6 when 0 then 'schema' when 1 then 'procedure' when 2 then 'data_row' when 3 then 'context' when 4 then 'instruction_step' else 'other' end")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), "text", role.alias("role"), F.split("text", " ").alias("values"), F.expr("doc_id % 3 = 0").alias("has_image"), F.expr("doc_id % 4 = 0").alias("has_aggregate"), F.expr("doc_id % 5 <> 0").alias("has_subject"), F.lit(True).alias("has_centre"))
    return manifest.semantic_audit(rows, "es", "fr", "de", "none", ["the"]).select("doc_id", "semantic_status", "embedding_policy")


@query("""
    select 'lang' as facet, lang as value, count(*) as n from documents group by lang union all
    select 'source', source, count(*) from documents group by source
""")
def facet_counts(spark, sf_dir):
    return manifest.facet_counts(read(spark, sf_dir, "documents"), "lang", "source")


@query("""
    with g as (select doc_id, case when lower(text) like '%licen%' then 0 when lower(text) like '%password%' then 1 when lower(text) like '%http%' then 2 else 3 end as keyword_group from documents),
    r as (select *, row_number() over (partition by keyword_group order by doc_id) as turn from g),
    s as (select *, case when turn <= 20 and keyword_group < 3 then 0 else 1 end as stage from r where turn <= 60)
    select doc_id, keyword_group, stage from s order by stage, case when stage = 0 then keyword_group else 0 end, doc_id limit 60
""")
def keyword_budget_sample(spark, sf_dir):
    return manifest.keyword_budget(read(spark, sf_dir, "documents"), [("licence", "licen"), ("secret", "password"), ("link", "http")], 60, "doc_id")


@query("""
    with w as (select p_partkey as key, unnest(string_split(p_type, ' ')) as value, p_name || ' ' || p_brand || ' ' || p_type as text from part)
    select key, count(*) as n_values, count(*) filter (not kept) as n_lost from (select key, value, max(contains(text, value)) as kept from w group by all) group by key
""")
def preservation_audit(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key")
    sources = part.select("key", F.explode(F.split("p_type", " ")).alias("value"))
    return manifest.preservation(sources, part.select("key", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")), "key", "value", "text")


# --- retrieval ---------------------------------------------------------------------------------------------------


@query(f"with {CHUNKS_SQL} select query_id, chunk_id, hits::double as score, rank from (select *, row_number() over (partition by query_id order by hits desc, chunk_id)::int as rank from scored where hits > 0) where rank <= 10")
def lexical_topk(spark, sf_dir):
    return retrieval.lexical_topk(questions(spark, sf_dir), chunks(spark, sf_dir), retrieval.Plan()).drop("layer")


@query(f"""with {CHUNKS_SQL}, b as (select *, hits + case when namespace = target then 2.0::double else 0.0::double end as score from scored where namespace in (target, 'global'))
    select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from b where score > 0) where rank <= 10""")
def flat_boost_topk(spark, sf_dir):
    """Target chunks get a bonus of 2, so each of them qualifies; only target and global chunks take part."""
    return retrieval.flat_topk(questions(spark, sf_dir), chunks(spark, sf_dir), 10)


LAYERED = (retrieval.Layer("facts", "target", ("fact", "evidence"), (), 5), retrieval.Layer("own", "target", (), (), 5), retrieval.Layer("common", "global", ("fact",), (), 5))


@query(f"""with {CHUNKS_SQL}, p as (
        select *, 0 as layer from scored where namespace = target and corpus_layer in ('fact', 'evidence') union all
        select *, 1 from scored where namespace = target union all
        select *, 2 from scored where namespace = 'global' and corpus_layer = 'fact'
    ), k as (select *, row_number() over (partition by query_id, layer order by hits desc, chunk_id) as place from p where hits > 0 qualify place <= 5),
    d as (select * from k qualify row_number() over (partition by query_id, chunk_id order by layer) = 1)
    select query_id, layer, chunk_id, hits::double as score, row_number() over (partition by query_id order by layer, place)::int as rank from d""")
def layered_topk(spark, sf_dir):
    return retrieval.lexical_topk(questions(spark, sf_dir), chunks(spark, sf_dir), retrieval.Plan(layers=LAYERED))


COSINE_SQL = """
    q as (select vec_id as query_id, embedding::double[] as v, case when label < 5 then 'a' else 'b' end as target from embeddings where vec_id % 50 = 0),
    s as (select query_id, target, vec_id as chunk_id, case when label < 5 then 'a' else 'b' end as namespace, label, list_cosine_similarity(q.v, e.embedding::double[]) as score from q, embeddings e)
"""


def _vectors(spark, sf_dir):
    held = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.when(F.col("label") < 5, "a").otherwise("b").alias("namespace"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("corpus_layer"), F.when(F.col("label") % 2 == 0, 1.12).otherwise(1.0).alias("rank_boost"))
    asked = held.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "namespace", "vector")
    return asked, held


@query(f"with {COSINE_SQL} select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s) where rank <= 10")
def cosine_topk(spark, sf_dir):
    """The stated query set is every vector whose id is divisible by 50, against all vectors."""
    asked, held = _vectors(spark, sf_dir)
    return retrieval.vector_topk(asked, held, retrieval.Plan(least=None)).select("query_id", "chunk_id", "rank")


@query(f"with {COSINE_SQL} select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score * case when label % 2 = 0 then 1.12::double else 1.0::double end desc, chunk_id)::int as rank from s where label in (1, 2, 4, 7)) where rank <= 12")
def cosine_filtered_boosted(spark, sf_dir):
    asked, held = _vectors(spark, sf_dir)
    plan = retrieval.Plan(layers=(retrieval.Layer("some", layers=("l1", "l2", "l4", "l7"), top_k=12),), least=None, boost=True)
    return retrieval.vector_topk(asked, held, plan).select("query_id", "chunk_id", "rank")


@query(f"""with {COSINE_SQL}, p as (select *, 0 as layer from s where namespace = target and label in (0, 1, 5, 6) union all select *, 1 from s where namespace = target union all select *, 2 from s where namespace = 'b'),
    k as (select *, row_number() over (partition by query_id, layer order by score desc, chunk_id) as place from p qualify place <= 6),
    d as (select * from k qualify row_number() over (partition by query_id, chunk_id order by layer) = 1)
    select query_id, layer, chunk_id, row_number() over (partition by query_id order by layer, place)::int as rank from d""")
def layered_vector_topk(spark, sf_dir):
    asked, held = _vectors(spark, sf_dir)
    layers = (retrieval.Layer("near", "target", ("l0", "l1", "l5", "l6"), (), 6), retrieval.Layer("own", "target", (), (), 6), retrieval.Layer("common", "global", (), (), 6))
    return retrieval.vector_topk(asked, held, retrieval.Plan(layers=layers, least=None, global_namespace="b")).select("query_id", "layer", "chunk_id", "rank")


@query("""select item_id, concat_ws(' ', 'dc1', case when quality is not null then 'q' || quality end, trim(regexp_replace(text, '\\s+', ' ', 'g'))) as query_text from benchmark b left join labels l on l.doc_id = b.item_id""")
def masked_query(spark, sf_dir):
    held = read(spark, sf_dir, "benchmark").join(read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id"), "item_id", "left")
    named = held.withColumns({"room": F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"))), "ns": F.lit("dc1")})
    return named.select("item_id", retrieval.masked_query("ns", "room", "text").alias("query_text"))


# --- cells, rows and tables --------------------------------------------------------------------------------------


@query("""
    select 'r' || r_regionkey as file_id, 1 as header_row, 6::bigint as score, 1 as question_col, 2 as answer_col from region where r_regionkey in (select n_regionkey from nation)
""")
def header_score(spark, sf_dir):
    """Each region as a sheet: a header row, then its nations."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sheet = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    head = nation.select(sheet.alias("file_id")).distinct().select("file_id", F.lit(1).alias("row"), F.posexplode(F.array(F.lit("Question"), F.lit("Answer"))).alias("c", "value"))
    body = nation.withColumn("row", F.row_number().over(order.Window.partitionBy("r_regionkey").orderBy("n_nationkey")) + 1).select(sheet.alias("file_id"), "row", F.posexplode(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("c", "value"))
    cells = head.unionByName(body).select("file_id", F.lit(0).alias("sheet_index"), "row", (F.col("c") + 1).alias("col"), "value")
    found = segments.header_rows(cells, forms.FORM_ROLES)
    return found.select("file_id", "header_row", "score", F.col("columns")["question"].alias("question_col"), F.col("columns")["target"].alias("answer_col"))


@query("""
    select l_orderkey, l_linenumber, min(case when l_linenumber = 1 then l_returnflag end) over (partition by l_orderkey) as value from lineitem
""")
def merge_inherit(spark, sf_dir):
    """Each order as a sheet whose first column is one merged cell over all its lines; only the first holds a value."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("row")).agg(F.min("l_returnflag").alias("flag"))
    cells = lines.select("file_id", F.lit(0).alias("sheet_index"), "row", F.lit(1).alias("col"), F.when(F.col("row") == 1, F.col("flag")).alias("value"))
    merges = lines.groupBy("file_id").agg(F.max("row").alias("last_row")).select("file_id", F.lit(0).alias("sheet_index"), F.lit(1).alias("first_row"), "last_row", F.lit(1).alias("first_col"), F.lit(1).alias("last_col"))
    full = segments.inherited(cells, merges)
    have = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return have.join(full, (F.col("l_orderkey") == F.col("file_id")) & (F.col("l_linenumber") == F.col("row"))).select("l_orderkey", "l_linenumber", "value")


@query("""
    select o_orderkey, coalesce(string_agg('a' || l_linenumber, ',' order by 'a' || l_linenumber), '') as attachments, count(l_linenumber) as n
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey
""")
def attach_collect(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    held = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("attachment_id"))
    bound = orders.join(segments.bound_attachments(held, ["o_orderkey"]), "o_orderkey", "left")
    return bound.select("o_orderkey", F.coalesce(F.array_join("proof_attachments", ","), F.lit("")).alias("attachments"), F.coalesce(F.size("proof_attachments"), F.lit(0)).cast("long").alias("n"))


@query("""
    select o_orderkey, unnest(range(1, 8))::int as row from orders except select l_orderkey, l_linenumber from lineitem
""")
def skipped_rows(spark, sf_dir):
    mapping = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit(0).alias("sheet_index"), F.lit(1).alias("data_start"), F.lit(7).alias("data_end"))
    held = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit(0).alias("sheet_index"), F.col("l_linenumber").alias("row"))
    return segments.skipped_rows(mapping, held).select(F.col("file_id").alias("o_orderkey"), "row")


@query("""
    with e as (select event_id, user_id, ts, case when event_type in ('signup', 'purchase') then event_type || event_id end as label from events)
    select event_id, coalesce(last_value(label ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row),
                              first_value(label ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following)) as label from e
""")
def carry_forward_group(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("label", F.when(F.col("event_type").isin("signup", "purchase"), F.concat("event_type", F.col("event_id").cast("string"))))
    return rows.select("event_id", order.carry_forward(F.col("label"), ["user_id"], ["ts", "event_id"], look_ahead=True).alias("label"))


@query("""
    with recursive h as (
        select conv_id, turn, case when role = 'assistant' then 0 else 1 + (turn * 7) % 3 end as level, role || turn as title, row_number() over (partition by conv_id order by turn) as k from conversations
    ), w as (
        select conv_id, turn, k, case when level > 0 then [title] else []::varchar[] end as path from h where k = 1
        union all
        select h.conv_id, h.turn, h.k, case when level > 0 then list_append(path[1:level - 1], title) else path end from h join w on h.conv_id = w.conv_id and h.k = w.k + 1
    )
    select conv_id, turn, array_to_string(path, ' > ') as path from w
""")
def heading_stack(spark, sf_dir):
    """Each conversation as a document; user and system turns are headings of levels that skip."""
    level = F.when(F.col("role") == "assistant", 0).otherwise(1 + (F.col("turn") * 7) % 3)
    blocks = read(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"), F.concat("role", F.col("turn").cast("string")).alias("title"))
    return order.heading_paths(blocks, "conv_id", "turn", "level", "title", deepest=3).select("conv_id", "turn", F.array_join("heading_path", " > ").alias("path"))


@query("""
    select p_partkey, array_to_string(list_filter(['name：' || p_name, 'brand：' || p_brand, case when p_type <> '' then '字段3：' || p_type end, '字段4：' || p_size], lambda x: x is not null), '；') as text,
           'k' || p_brand || '：' || p_size || '；' || p_type || '：' || p_name as pairs from part
""")
def pair_values_text(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    values = part.withColumns({"vs": F.array("p_name", "p_brand", "p_type", size), "ps": F.array(F.concat(F.lit("k"), "p_brand"), size, F.col("p_type"), F.col("p_name"))})
    return values.select("p_partkey", T.pair_values(F.array(F.lit("name"), F.lit("brand"), F.lit("")), F.col("vs")).alias("text"), T.alternating_pairs(F.col("ps")).alias("pairs"))


@query("""
    select n_regionkey as table_id, (row_number() over (partition by n_regionkey order by n_nationkey))::int as row, 'name：' || n_name || '；key：' || n_nationkey as text from nation
""")
def pivot_transpose(spark, sf_dir):
    """Each region as a table of two rows whose columns are its nations; columns become segments."""
    held = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    named = held.select("table_id", F.concat(F.array(F.lit("name")), "ns.n_name").alias("a"), F.concat(F.array(F.lit("key")), F.transform("ns.n_nationkey", lambda x: x.cast("string"))).alias("b"))
    rows = named.select("table_id", F.lit("grades").alias("category"), F.posexplode(F.array("a", "b")).alias("r", "values")).withColumn("row", F.col("r") + 1).drop("r")
    return tables.resolve(rows, [tables.Spec("grades", "transpose")]).select("table_id", "row", "text")


@query("""
    select l_orderkey, l_linenumber, case when l_linenumber in (2, 4, 6) then 'flag：' || l_returnflag || '；status：' || l_linestatus else 'flag：' || l_returnflag end as text from lineitem where l_linenumber > 1
""")
def table_resolve(spark, sf_dir):
    """Each order as a table with fixed headers; data starts at its second line."""
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("table_id"), F.lit("order").alias("category"), F.col("l_linenumber").alias("row"), F.array("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus"))).alias("values"))
    found = tables.resolve(rows, [tables.Spec("order", headers=("flag", "status"))])
    return found.select(F.col("table_id").alias("l_orderkey"), F.col("row").alias("l_linenumber"), "text")


EVENTS_SQL = "e as (select user_id as table_id, (row_number() over (partition by user_id order by event_id))::int as row, event_id, event_type from events)"


def _event_tables(spark: SparkSession, sf_dir: str, values) -> DataFrame:
    """Each user's events, in order, as the rows of a table."""
    row = F.row_number().over(order.Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), F.lit("events").alias("category"), row.alias("row"), values.alias("values"))


@query(f"""
    with {EVENTS_SQL}, d as (select *, case when event_type = 'error' then 'E' || event_id end as own from e where row > 2),
    c as (select *, coalesce(last_value(own ignore nulls) over (partition by table_id order by row rows between unbounded preceding and current row), first_value(own ignore nulls) over (partition by table_id order by row rows between current row and unbounded following)) as centre from d)
    select table_id, row, case when centre is null then '' else '数据中心名称：' || centre || '；' end || '机房：' || event_type || '；机柜总数：' || event_id as text from c
""")
def cabinet_fill(spark, sf_dir):
    """Errors name the centre of the rows around them."""
    first = F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id").cast("string"))).otherwise("/")
    rows = _event_tables(spark, sf_dir, F.array(first, F.col("event_type"), F.col("event_id").cast("string"), F.lit(""), F.lit("-"), F.lit(None)))
    return layouts.cabinets(rows).select("table_id", "row", "text")


@query(f"""
    with {EVENTS_SQL}, g as (select *, case when event_type = 'signup' then 'g' || event_id when row = 1 then event_type end as own from e),
    c as (select *, last_value(case when row <> 2 then own end ignore nulls) over (partition by table_id order by row rows between unbounded preceding and current row) as grp from g)
    select table_id, row, grp, '单位/厂家/专业：' || event_type || '；职责/岗位：' || event_id as text from c where row > 2 and event_type <> 'signup'
""")
def org_teams(spark, sf_dir):
    """Signups name the group of the rows below."""
    key = F.col("event_id").cast("string")
    rows = _event_tables(spark, sf_dir, F.when(F.col("event_type") == "signup", F.array(F.concat(F.lit("g"), key), F.lit(""))).otherwise(F.array(F.col("event_type"), key)))
    return layouts.teams(rows).select("table_id", "row", F.col("group").alias("grp"), "text")


@query(f"""
    with {EVENTS_SQL}, s as (select table_id, row, 'instruction_step' as role, '步骤' || row || '：' || event_type as text from e)
    select * from s union all
    select table_id, 0, 'procedure', '完整步骤：' || string_agg(row || '. ' || text, '；' order by row) from s group by table_id having count(*) > 1
""")
def step_procedures(spark, sf_dir):
    return layouts.LAYOUTS["steps"](_event_tables(spark, sf_dir, F.array(F.col("event_type")))).select("table_id", "row", "role", "text")


@query(f"""
    with {EVENTS_SQL}
    select table_id, row, case when table_id % 2 = 0 then '类型：' || event_type || '；字段2：' || event_id else '地址类型：' || event_type || '；互联地址：' || event_id end as text
    from e where case when table_id % 2 = 0 then row in (2, 5) else row in (3, 4, 5, 6) end
""")
def hinted_rows(spark, sf_dir):
    """Tables of even users have a hint on their header and data rows."""
    rows = _event_tables(spark, sf_dir, F.array(F.col("event_type"), F.col("event_id").cast("string")))
    hints = rows.where("table_id % 2 = 0").select("table_id").distinct().withColumns({"headers": F.array(F.lit("类型：")), "data_rows": F.array(F.lit(2), F.lit(5))})
    return layouts.LAYOUTS["addresses"](rows, hints=hints).select("table_id", "row", "text")


@query("select 'c' || o_custkey as file_id, o_orderkey as row, (row_number() over (partition by o_custkey order by o_orderkey))::int as ordinal, o_orderstatus || ' | ' || o_orderpriority as text from orders")
def sheet_row_text(spark, sf_dir):
    """Each customer as a sheet, each order as a row of three cells."""
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_id"), F.lit(0).alias("sheet_index"), F.lit("orders").alias("sheet_name"), F.col("o_orderkey").alias("row"), F.posexplode(F.array("o_orderstatus", F.lit(" "), "o_orderpriority")).alias("col", "value"))
    return sheets.sheet_rows(orders).select("file_id", "row", "ordinal", "text")


@query("""
    with n as (select distinct l_partkey % 18278 + 1 as n, l_linenumber as row from lineitem)
    select n::bigint as n, row, case when n > 702 then chr((65 + (n - 703) // 676 % 26)::int) else '' end || case when n > 26 then chr((65 + (n - 27) // 26 % 26)::int) else '' end || chr((65 + (n - 1) % 26)::int) || row as ref, n::int as back from n
""")
def a1_roundtrip(spark, sf_dir):
    keys = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 18278 + 1).alias("n"), F.col("l_linenumber").alias("row")).distinct()
    return keys.withColumn("ref", T.cell_ref(F.col("row"), F.col("n"))).select("n", "row", "ref", T.split_ref(F.col("ref"))["col"].alias("back"))


@query("""
    with p as (select doc_id, source || '/' || lang as path from documents),
    c as (select doc_id, path, list_filter([case when regexp_matches(path, 'src1') then 'A' end, case when regexp_matches(path, 'src[2-4]/') then 'B' end, case when regexp_matches(path, '/(de|fr)$') then 'C' end], lambda x: x is not null) as cs from p)
    select doc_id, case when len(cs) = 1 then 'exact' when len(cs) > 1 then 'ambiguous' else 'unrouted' end as route_status, case when len(cs) = 1 then cs[1] end as center_id, case len(cs) when 0 then null when 1 then 0.95::double else 0.5::double end as confidence from c
""")
def route_rules(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    return segments.route(rows, [("A", "src1"), ("B", "src[2-4]/"), ("C", "/(de|fr)$")]).select("doc_id", "route_status", "center_id", "confidence")


@query("""
    select page_id, 'file_' || substr(sha1(url), 1, 10) as file_id, regexp_extract(url, '[^/]+$') as file_name, strlen(html) as size_bytes, round_even(strlen(html) / 1048576.0, 3) as size_mb from pages
""")
def file_register(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size_bytes"))
    return files.registered(rows).select("page_id", "file_id", "file_name", "size_bytes", "size_mb")


@query(r"""
    select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g')) as text from pages
""")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("""
    with i as (select n_nationkey, n_name, n_regionkey, (row_number() over (partition by n_regionkey order by n_nationkey) + 1)::int as row from nation)
    select 'r' || n_regionkey as file_id, row, n_name as question, 'B' || row as target_cell, case when n_nationkey % 3 = 0 then 'empty' when n_nationkey % 3 = 1 then 'placeholder' else 'filled' end as answer_state,
           case when n_nationkey % 3 = 0 then 'fill_empty' when n_nationkey % 3 = 1 then 'fill_placeholder' else 'verify_or_rewrite_existing' end as task_action, 'dc ' || n_name as query_text
    from i
""")
def form_requests(spark, sf_dir):
    """Each region as a form of a question and an answer column; its nations are the questions."""
    nation = read(spark, sf_dir, "nation")
    sheet = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file_id")
    answer = F.when(F.col("n_nationkey") % 3 == 0, " ").when(F.col("n_nationkey") % 3 == 1, "TBD").otherwise("done")
    body = nation.withColumn("row", F.row_number().over(order.Window.partitionBy("n_regionkey").orderBy("n_nationkey")) + 1).select(sheet, "row", F.posexplode(F.array(F.col("n_name"), answer)).alias("c", "value"))
    head = nation.select(sheet).distinct().select("file_id", F.lit(1).alias("row"), F.posexplode(F.array(F.lit("Question"), F.lit("Answer"))).alias("c", "value"))
    cells = head.unionByName(body).select("file_id", F.lit(0).alias("sheet_index"), "row", (F.col("c") + 1).alias("col"), "value")
    found = forms.items(cells, forms.profiles(cells))
    asked = forms.requests(found, "dc").select("form_item_id", "task_action", "retrieval.query_text")
    return found.join(asked, "form_item_id").select("file_id", "row", "question", "target_cell", "answer_state", "task_action", "query_text")


# --- evidence, metrics and write-back ----------------------------------------------------------------------------

GOLD_SQL = """
    f as (
        select p_partkey as pk, p_partkey % 4 as kind, p_size, p_name from part
    ), v as (
        select pk, kind, p_size, case kind when 0 then p_name when 1 then p_size || ' kW' when 2 then 'yes' else '2024-01-' || lpad((1 + p_size % 28)::varchar, 2, '0') end as gold,
               case when pk % 11 = 0 or pk % 7 = 0 then null else case kind when 0 then upper(p_name) when 1 then (p_size * 1000) || ' W' when 2 then case when p_size > 25 then 'true' else 'no' end else '2024/1/' || (1 + p_size % 28) end end as got,
               case when pk % 11 = 0 or pk % 7 = 0 then 'not_found' else 'answered' end as status, case when pk % 13 = 0 then 'not_found' else 'answered' end as expected,
               case when pk % 11 = 0 then 0.0::double when pk % 5 = 0 then 0.4::double else 0.9::double end as confidence, case when pk % 11 <> 0 and pk % 3 = 0 then 1 else 0 end as n_ids
        from f
    ), m as (
        select *, coalesce(lower(gold) = lower(got), false) as exact_match, got is not null and (kind in (0, 1, 3) or p_size > 25) as semantic_match, expected = status as status_match,
               status = 'answered' and n_ids > 0 as evidence_supported, case when status = 'not_found' then expected = 'not_found' end as abstention_correct,
               (case when status <> 'answered' then 1 else 0 end) + (case when kind = 1 and got is not null and (p_size < 10 or p_size > 40) then 1 else 0 end) as n_violations
        from v
    ), r as (
        select *, n_violations > 0 or confidence < 0.55 or (status = 'answered' and n_ids = 0) or (expected = 'answered' and not semantic_match) as needs_review,
               not status_match or (expected = 'answered' and not semantic_match) or (expected <> 'answered' and status = 'answered') as needs_correction from m
    )
"""


def _gold(spark, sf_dir):
    """Parts as fields of four types with their predictions, some of them missing or abstaining."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name", "p_size", (F.col("p_partkey") % 4).alias("kind"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("text", "number", "bool", "date")]), (F.col("kind") + 1).cast("int"))
    gold = F.expr("case kind when 0 then p_name when 1 then concat(p_size, ' kW') when 2 then 'yes' else concat('2024-01-', lpad(1 + p_size % 28, 2, '0')) end")
    got = F.expr("case kind when 0 then upper(p_name) when 1 then concat(p_size * 1000, ' W') when 2 then if(p_size > 25, 'true', 'no') else concat('2024/1/', 1 + p_size % 28) end")
    none = F.array().cast("array<string>")
    bound = lambda x: F.when(F.col("kind") == 1, F.lit(x))
    golds = part.select(
        F.col("pk").alias("field_id"), gold.alias("expected_value"), F.expr("if(pk % 13 = 0, 'not_found', 'answered')").alias("expected_status"), none.alias("aliases"), kinds.alias("field_type"), F.lit(True).alias("required"), F.lit(True).alias("must_have_evidence"),
        F.array(F.lit("a"), F.lit("b")).alias("gold_ids"), F.lit(None).cast("string").alias("regex"), none.alias("options"), bound(10.0).alias("min"), bound(40.0).alias("max"),
    )
    absent = F.expr("pk % 7 = 0")
    told = part.where("pk % 11 <> 0").select(
        F.col("pk").alias("field_id"), F.lit(1).alias("ordinal"), F.when(~absent, got).alias("answer_value"), F.when(absent, "not_found").otherwise("answered").alias("answer_status"),
        F.expr("if(pk % 5 = 0, 0.4D, 0.9D)").alias("confidence"), F.when(F.expr("pk % 3 = 0"), F.array(F.lit("a"))).otherwise(none).alias("source_ids"),
    )
    return golds, told


@query(f"""with {GOLD_SQL} select pk as field_id, exact_match, semantic_match, status_match, evidence_supported, abstention_correct, n_violations, needs_review, needs_correction from r""")
def field_metrics(spark, sf_dir):
    rows = metrics.evaluate(*_gold(spark, sf_dir))
    return rows.select("field_id", "exact_match", "semantic_match", "status_match", "evidence_supported", "abstention_correct", F.size("violations").alias("n_violations"), "needs_review", "needs_correction")


@query(f"""with {GOLD_SQL} select kind as k, count(*) as field_count, avg(exact_match::int::double) as exact_match, avg(semantic_match::int::double) as semantic_match, avg(status_match::int::double) as status_accuracy,
    avg(evidence_supported::int::double) as evidence_support, coalesce(avg(abstention_correct::int::double), 0) as abstention_precision, avg((n_violations > 0)::int::double) as violation_rate, avg(needs_review::int::double) as review_rate, avg(needs_correction::int::double) as correction_rate from r group by kind""")
def metric_summary(spark, sf_dir):
    rows = metrics.evaluate(*_gold(spark, sf_dir)).withColumn("k", F.col("field_id") % 4)
    return metrics.summarize(rows, "k").drop("evidence_recall")


@query(f"""with {GOLD_SQL}, c as (select unnest(list_filter([
        case when not exact_match then 'exact_mismatch' end, case when expected = 'answered' and not semantic_match then 'semantic_mismatch' end, case when not status_match then 'status_mismatch' end,
        case when status = 'answered' and n_ids = 0 then 'evidence_missing' end, 'evidence_low_recall', case when not abstention_correct then 'abstention_error' end, case when n_violations > 0 then 'constraint_violation' end,
        case when needs_review then 'needs_human_review' end, case when needs_correction then 'correction_required' end], lambda x: x is not null)) as badcase from r)
    select badcase, count(*) as n from c group by badcase""")
def badcase_counts(spark, sf_dir):
    return metrics.badcase_counts(metrics.evaluate(*_gold(spark, sf_dir)))


@query(f"""with {GOLD_SQL} select pk as field_id, array_to_string(list_filter([case when not semantic_match and kind <> 2 then 'semantic' end], lambda x: x is not null), ',') as reasons from r where not semantic_match and kind <> 2""")
def method_diff(spark, sf_dir):
    """Against a method that always answers with the gold text of all but bool fields."""
    golds, told = _gold(spark, sf_dir)
    base = metrics.evaluate(golds, told).select("field_id", F.col("semantic_match").alias("semantic"))
    perfect = golds.select("field_id", F.lit(1).alias("ordinal"), F.when(F.col("field_type") != "bool", F.col("expected_value")).otherwise("no").alias("answer_value"), F.lit("answered").alias("answer_status"), F.lit(0.9).alias("confidence"), F.array(F.lit("a"), F.lit("b")).alias("source_ids"))
    better = metrics.evaluate(golds, perfect).select("field_id", F.col("semantic_match").alias("semantic"))
    return order.changed(base, better, "field_id", ["semantic"]).select("field_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
    with a as (select l_orderkey, list_distinct(list(l_suppkey) filter (l_returnflag = 'R')) as gold, list(l_suppkey order by l_linenumber, l_suppkey)[1:3] as found from lineitem group by l_orderkey)
    select l_orderkey, case when len(gold) > 0 then len(list_intersect(gold, found))::double / len(gold) end as recall from a
""")
def evidence_recall(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("gold"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("ls"))
    return lines.select("l_orderkey", T.recall_at(F.col("gold"), F.col("ls.l_suppkey"), 3).alias("recall"))


@query("""
    select p_partkey, array_to_string(list_filter([case when p_brand like '%1' then 'regex_mismatch' end, case when p_size < 10 then 'number_below_min' end, case when p_size > 40 then 'number_above_max' end], lambda x: x is not null), ',') as violations from part
""")
def constraint_violations(spark, sf_dir):
    none = F.array().cast("array<string>")
    row = {"answer_value": F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand"), "answer_status": F.lit("answered"), "field_type": F.lit("number"), "required": F.lit(True), "regex": F.lit("[^1]$"), "options": none, "aliases": none, "min": F.lit(10.0), "max": F.lit(40.0)}
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(evidence.constraint_violations(row), ",").alias("violations"))


CANDIDATES_SQL = """
    c as (
        select distinct l_orderkey as field_id, l_linenumber * 100000000 + l_partkey as chunk_id, l_returnflag in ('N', 'A') as own, case when l_returnflag in ('N', 'A') then case when l_linestatus = 'F' then 1 else 2 end else 6 end as priority,
               'v' || l_suppkey % 2 as answer, l_quantity as score from lineitem
    ), b as (select field_id, priority, count(distinct answer) as answers, string_agg(distinct chunk_id::varchar, ',' order by chunk_id::varchar) as ids from c where own group by all),
    x as (select field_id, arg_min(ids, priority) as conflict_ids from b where answers > 1 group by field_id),
    t as (select field_id, count(*) filter (own) as n_own, arg_min(chunk_id, {'p': priority, 's': -score, 'c': chunk_id}) filter (own) as pick, string_agg(distinct chunk_id::varchar, ',' order by chunk_id::varchar) filter (not own) as other_ids from c group by field_id)
"""


def _candidates(spark, sf_dir):
    """Lines as candidate chunks of their order."""
    own = F.col("l_returnflag").isin("N", "A")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("field_id"), F.lit("text").alias("field_type"), F.lit("T").alias("target"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("chunk_id"), F.when(own, "T").otherwise("G").alias("namespace"),
        F.when(F.col("l_linestatus") == "F", evidence.MAIN).otherwise(evidence.EMBEDDED).alias("source_type"), F.concat(F.lit("v"), (F.col("l_suppkey") % 2).cast("string")).alias("answer_value"), F.lit("answered").alias("answer_status"), F.col("l_quantity").alias("score"),
    )


@query(f"""with {CANDIDATES_SQL} select t.field_id, case when n_own = 0 then 'clue_only' when conflict_ids is not null then 'conflict_unresolved' else 'use_direct_evidence' end as decision,
    case when n_own > 0 and conflict_ids is null then pick end as chunk_id, case when n_own = 0 then other_ids when conflict_ids is not null then conflict_ids else '' end as ids from t left join x using (field_id)""")
def evidence_decision(spark, sf_dir):
    found = evidence.select_evidence(_candidates(spark, sf_dir))
    return found.select("field_id", "decision", F.col("chunk.chunk_id").alias("chunk_id"), F.array_join("chunk_ids", ",").alias("ids"))


@query(f"with {CANDIDATES_SQL} select field_id, conflict_ids from x")
def priority_conflict(spark, sf_dir):
    found = evidence.select_evidence(_candidates(spark, sf_dir)).where("decision = 'conflict_unresolved'")
    return found.select("field_id", F.array_join("chunk_ids", ",").alias("conflict_ids"))


@query(f"""with {CANDIDATES_SQL}, d as (select o_orderkey as field_id, case when t.field_id is null then 'no_evidence' when n_own = 0 then 'clue_only' when conflict_ids is not null then 'conflict_unresolved' else 'use_direct_evidence' end as decision
        from orders o left join t on t.field_id = o_orderkey left join x on x.field_id = o_orderkey)
    select decision, case decision when 'use_direct_evidence' then 'answered' when 'clue_only' then 'partial_clue' when 'conflict_unresolved' then 'conflict_unresolved' else 'not_found' end as answer_status,
           case decision when 'use_direct_evidence' then 'none' else 'review' end as repair_action, case decision when 'use_direct_evidence' then null when 'clue_only' then 'partial_clue' when 'conflict_unresolved' then 'conflict_unresolved' else 'not_found' end as review_reason, count(*) as n from d group by all""")
def agent_run(spark, sf_dir):
    """All stages for every order as a field."""
    none = F.array().cast("array<string>")
    fields = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("field_id"), F.lit("text").alias("field_type"), F.lit(True).alias("required"), F.lit(True).alias("must_have_evidence"), F.lit("").alias("regex"), none.alias("option_values"), none.alias("aliases"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    ran = evidence.run_fields(fields, _candidates(spark, sf_dir))
    return ran.groupBy("decision", "answer_status", "repair_action", "review_reason").agg(F.count("*").alias("n"))


@query("""
    with t as (select o_orderkey, o_orderstatus, 'S' || o_custkey % 3 as sheet_name, case when o_orderkey % 17 = 0 or o_custkey < 1 then null else o_custkey end as row from orders),
    n as (select *, case when row is null then 1 else count(*) over (partition by sheet_name, row) end as n from t)
    select o_orderkey, sheet_name, 'C' || row as cell, case when row is null then 'invalid' when n > 1 then 'conflict' when o_orderstatus <> 'F' then 'skipped' else 'written' end as action,
           case when row is null then 'invalid_cell' when n > 1 then 'duplicate_target_cell' when o_orderstatus <> 'F' then 'skipped_status' else 'written' end as reason from n
""")
def target_conflicts(spark, sf_dir):
    """Orders as predictions that aim at a cell for their customer."""
    at = F.concat(F.lit("'S"), (F.col("o_custkey") % 3).cast("string"), F.lit("'!"), F.when(F.col("o_orderkey") % 17 == 0, F.lit("??")).otherwise(F.concat(F.lit("$c$"), F.col("o_custkey").cast("string"))))
    told = read(spark, sf_dir, "orders").select("o_orderkey", at.alias("target_cell"), F.when(F.col("o_orderstatus") == "F", "answered").otherwise("not_found").alias("answer_status"), F.lit(True).alias("validation_pass"), F.lit(False).alias("evidence_missing"), F.array().cast("array<string>").alias("violations"))
    return writeback.actions(writeback.targets(told, "S0")).select("o_orderkey", "sheet_name", "cell", "action", "reason")


@query("""
    select field_id, reason, min(origin) as origin from (
        select o_custkey as field_id, o_orderstatus as reason, 'agent' as origin from orders where o_totalprice > 200000 union all
        select o_custkey, o_orderstatus, 'writeback' from orders where o_totalprice < 300000) group by all
""")
def review_merge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field_id"), F.col("o_orderstatus").alias("reason"), "o_totalprice")
    return evidence.merge_reviews(orders.where("o_totalprice > 200000").drop("o_totalprice"), orders.where("o_totalprice < 300000").drop("o_totalprice"))


@query("""
    select count(*) as n_events, count(distinct user_id) as n_fields, count(*) filter (event_type = 'purchase') as n_completed, count(*) filter (event_type = 'purchase' and value > 50) as n_answered,
           count(*) filter (event_type = 'error') as n_repaired, count(*) filter (event_type = 'signup') as n_reviewed from events
""")
def trace_summary(spark, sf_dir):
    step = F.expr("case event_type when 'purchase' then 'field_completed' when 'error' then 'repaired' when 'signup' then 'reviewed' else event_type end")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("field_id"), step.alias("step"), F.when(F.col("value") > 50, "answered").otherwise("not_found").alias("status"))
    return evidence.trace_summary(events)


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_anti(spark, sf_dir):
    """Orders that are not done yet; those with a returned line are."""
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return index.pending(read(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("select event_type, list_sort(list(value))[(round_even((count(*) - 1) * 0.95::double, 0))::bigint + 1] as p95, count(*) as n from events where value is not null group by event_type")
def p95_latency(spark, sf_dir):
    return metrics.p95(read(spark, sf_dir, "events"), "value", "event_type")


# --- plans and services ------------------------------------------------------------------------------------------


@query("select item_id, substr(sha256('offline' || chr(10) || text), 1, 16) as prompt_key, length(text)::varchar as response from benchmark")
def prompt_cache(spark, sf_dir):
    """Each benchmark item as a prompt of an offline generator; half of them are in the cache already."""
    prompts = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    held = prompts.where("item_id % 2 = 0").select(services.prompt_key("offline", F.col("prompt")).alias("prompt_key"), F.length("prompt").cast("string").alias("response"))
    return services.ask(prompts, lambda texts: [str(len(t)) for t in texts], "offline", held).select("item_id", "prompt_key", "response")


@query("""
    with q as (select item_id, split_part(text, '.', 1) as q, case when split_part(text, '.', 1) ilike '%ups%' then ['不间断电源', 'UPS容量', '后备电源'] else []::varchar[] end as more from benchmark)
    select item_id, case when len(more) > 0 then 'ups' else 'general' end as intent, array_to_string(list_concat(['east'], list_concat(list_filter([q], lambda x: x <> ''), more)), ' ') as primary_query from q
""")
def query_plans(spark, sf_dir):
    fields = read(spark, sf_dir, "benchmark").select("item_id", F.substring_index("text", ".", 1).alias("question_text"), F.array().cast("array<string>").alias("aliases"))
    return planning.query_plans(fields, "east").select("item_id", "intent", "primary_query")


@query("""
    select o_orderpriority as grp, count(*) as sample_count, count(*) filter (o_orderstatus = 'F') as acceptable_or_better, count(*) filter (o_orderstatus in ('F', 'P')) as partial_or_better from orders group by all
""")
def judged_counts(spark, sf_dir):
    label = F.expr("case o_orderstatus when 'F' then 'exact' when 'P' then 'partial' else 'wrong' end")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), label.alias("label"), F.lit(1.0).alias("score"))
    return services.judged_summary(rows, "grp").drop("average_score")


# --- reranking, traces, routes, lineage and audits ---------------------------------------------------------------


@query(f"""with {CHUNKS_SQL}, h as (select query_id, chunk_id, hits, row_number() over (partition by query_id order by hits desc, chunk_id) as rank from scored where hits > 0 qualify rank <= 10),
    r as (select h.*, (hits * 1000 - length(c.text))::double as rerank_score from h join chunks c using (chunk_id))
    select query_id, chunk_id, rerank_score, (row_number() over (partition by query_id order by rerank_score desc, rank))::int as rerank_rank from r qualify rerank_rank <= 5""")
def rerank_topk(spark, sf_dir):
    """The ten best chunks of each question, ranked again by a second score that prefers short texts; the best five."""
    asked, held = questions(spark, sf_dir), chunks(spark, sf_dir)
    found = retrieval.lexical_topk(asked, held, retrieval.Plan())
    again = retrieval.rerank(found, held, asked, 5, lambda q, t: T.lexical_score(q, t) * 1000 - F.length(t))
    return again.select("query_id", "chunk_id", "rerank_score", "rerank_rank")


DECISIONS_SQL = f"""{CANDIDATES_SQL}, d as (select o_orderkey as field_id, case when t.field_id is null then 'no_evidence' when n_own = 0 then 'clue_only' when conflict_ids is not null then 'conflict_unresolved' else 'use_direct_evidence' end as decision
        from orders o left join t on t.field_id = o_orderkey left join x on x.field_id = o_orderkey)"""


def _ran(spark, sf_dir) -> DataFrame:
    none = F.array().cast("array<string>")
    fields = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("field_id"), F.lit("text").alias("field_type"), F.lit(True).alias("required"), F.lit(True).alias("must_have_evidence"), F.lit("").alias("regex"), none.alias("option_values"), none.alias("aliases"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    return evidence.run_fields(fields, _candidates(spark, sf_dir))


@query(f"""with {DECISIONS_SQL}, s as (select unnest(['field_started', 'query_planned', 'retrieved', 'evidence_selected', 'predicted', 'validated', 'reviewed', 'field_completed']) as step)
    select step, count(*) as n from d, s where step <> 'reviewed' or decision <> 'use_direct_evidence' group by step""")
def agent_trace(spark, sf_dir):
    """The events that the run of all orders leaves, by step."""
    return evidence.trace(_ran(spark, sf_dir), "run").groupBy("step").agg(F.count("*").alias("n"))


@query(f"""with {DECISIONS_SQL} select sum(case when decision = 'use_direct_evidence' then 7 else 8 end)::bigint as n_events, count(*) as n_fields, count(*) as n_completed,
    count(*) filter (decision = 'use_direct_evidence') as n_answered, 0::bigint as n_repaired, count(*) filter (decision <> 'use_direct_evidence') as n_reviewed from d""")
def agent_trace_summary(spark, sf_dir):
    return evidence.trace_summary(evidence.trace(_ran(spark, sf_dir), "run"))


@query("""
    select s_suppkey, case s_suppkey % 7 when 0 then 'survey_form' when 1 then 'intro_doc' when 2 then 'knowledge_base' when 3 then 'proof_attachment' when 4 then 'unknown' end as role
    from supplier where s_suppkey % 7 < 5
""")
def document_roles(spark, sf_dir):
    """Suppliers as files of several folders, names and extensions; hidden files and unknown extensions aren't registered."""
    key = F.col("s_suppkey").cast("string")
    named = [F.concat(F.lit("d/工勘单/f"), key, F.lit(".xlsx")), F.concat(F.lit("d/k/情况说明介绍"), key, F.lit(".docx")), F.concat(F.lit("d/k/"), key, F.lit(".XLS")), F.concat(F.lit("d/"), key, F.lit(".png")), F.concat(F.lit("d/"), key, F.lit(".doc")), F.concat(F.lit("d/."), key, F.lit(".xlsx")), F.concat(F.lit("d/"), key, F.lit(".txt"))]
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*named), (F.col("s_suppkey") % 7 + 1).cast("int")).alias("path"))
    return files.registrable(rows).select("s_suppkey", files.document_role(F.col("path")).alias("role"))


@query(r"""
    with p as (select doc_id, source || '/' || lang as path, lang from documents),
    c as (select *, regexp_extract(path, 'src1(\d)', 1) as number, path like 'src1%' as place, regexp_matches(path, '/(de|fr)$') as other from p)
    select doc_id, case when number <> '' then 'exact' when other and lang = 'fr' then 'needs_review' when other then 'exact' when place then 'ambiguous' else 'unrouted' end as route_status,
           case when number <> '' then 'hall_' || number when other and lang <> 'fr' then 'C' end as center_id,
           case when number <> '' then 0.99::double when other and lang = 'fr' then 0.62::double when other then 0.95::double when place then 0.5::double end as confidence from c
""")
def route_numbers(spark, sf_dir):
    """Routes by numbered halls first, then by rules; rows of one language stand for forms, which need a review."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("/", "source", "lang").alias("path"))
    return segments.route(rows, [("C", "/(de|fr)$")], numbered=("hall_", r"src1(\d)"), form=F.col("lang") == "fr").select("doc_id", "route_status", "center_id", "confidence")


@query("""
    select l_orderkey, l_linenumber, case when o_orderstatus = 'F' then 'seg_' || o_orderkey end as parent_segment_id, case when p_size > 25 then 'p' || p_partkey end as embedded_file_id
    from lineitem left join orders on o_orderkey = l_orderkey left join part on p_partkey = l_partkey
""")
def attachment_lineage(spark, sf_dir):
    """Lines as attachments of their order's row; finished orders have a segment, large parts were unpacked as files."""
    one = F.lit("f").alias("file_id")
    held = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", one, F.lit(0).alias("sheet_index"), F.col("l_orderkey").alias("row"), F.col("l_partkey").cast("string").alias("media_path"))
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(one, F.lit(0).alias("sheet_index"), F.col("o_orderkey").alias("row"), F.concat(F.lit("seg_"), F.col("o_orderkey").cast("string")).alias("segment_id"))
    inner = read(spark, sf_dir, "part").where("p_size > 25").select(F.lit("f").alias("parent_file_id"), F.col("p_partkey").cast("string").alias("relative_path"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"))
    return segments.lineage(held, rows, inner).select("l_orderkey", "l_linenumber", "parent_segment_id", "embedded_file_id")


@query("""
    with t as (select o_orderkey, o_orderstatus, case when o_orderkey % 17 = 0 or o_custkey < 1 then null else o_custkey end as row from orders),
    n as (select *, case when row is null then 1 else count(*) over (partition by row) end as n from t)
    select count(*) as n_fields, count(*) filter (row is not null and n = 1 and o_orderstatus = 'F') as n_written, count(*) filter (row is not null and n = 1 and o_orderstatus <> 'F') as n_skipped,
           count(*) filter (row is not null and n > 1) as n_conflict, count(*) filter (row is null) as n_invalid, count(*) filter (row is null or n > 1 or o_orderstatus <> 'F') as n_review from n
""")
def writeback_summary(spark, sf_dir):
    at = F.when(F.col("o_orderkey") % 17 == 0, F.lit("??")).otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    told = read(spark, sf_dir, "orders").select(at.alias("target_cell"), F.when(F.col("o_orderstatus") == "F", "answered").otherwise("not_found").alias("answer_status"), F.lit(True).alias("validation_pass"), F.lit(False).alias("evidence_missing"), F.array().cast("array<string>").alias("violations"))
    return writeback.summary(writeback.actions(writeback.targets(told, "S0")))


@query("""
    select o_orderkey, case when o_orderstatus = 'F' or o_orderkey % 3 = 0 then 'confidence: ' || printf('%.4f', (o_orderkey % 8) / 8.0) || chr(10) || 'source_chunk_ids: c' || o_custkey || ', d' || chr(10)
           || 'evidence_attachment_ids: ' || chr(10) || 'answer_status: ' || case when o_orderstatus = 'F' then 'answered' else 'not_found' end || chr(10) || 'trace_id: run' end as comment from orders
""")
def comment_texts(spark, sf_dir):
    """The comment of each prediction that gets one."""
    told = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "answered").otherwise("not_found").alias("answer_status"), ((F.col("o_orderkey") % 8) / 8).alias("confidence"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("d")).alias("source_chunk_ids"), ((F.col("o_orderstatus") == "F") | (F.col("o_orderkey") % 3 == 0)).alias("write_comment"))
    return writeback.commented(told, "run").select("o_orderkey", "comment")


@query(r"""
    select o_orderkey, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(o_orderpriority) || '、' || lower(o_orderstatus) || '//' || lower(o_clerk_) || ';', '[,，;；、/]+'),
           lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '')), '|') as parts from (select *, 'Clerk ' || o_custkey as o_clerk_ from orders)
""")
def option_lists(spark, sf_dir):
    text = F.concat("o_orderpriority", F.lit("、"), "o_orderstatus", F.lit("//Clerk "), F.col("o_custkey").cast("string"), F.lit(";"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.normalize_list(text), "|").alias("parts"))


@query(r"""
    select item_id, case when trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' then 'text：' || regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[。；;，,.]+$', '') || '。' end as sentence from benchmark
""")
def sentence_fields(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.sentence_field("text", F.col("text")).alias("sentence"))


@query("""
    with o as (select o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as last from orders)
    select o_custkey, string_agg(o_orderstatus, '' order by o_orderkey) as statuses from o where last is null or last <> o_orderstatus group by o_custkey
""")
def repeats_compacted(spark, sf_dir):
    """The statuses of each customer's orders, without those that equal the one before."""
    listed = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    return listed.select("o_custkey", F.array_join(tables.without_repeats(F.col("o.o_orderstatus")), "").alias("statuses"))


@query("""
    select o_orderkey, 'late' as need_type, 'high' as severity, 0::int as severity_rank from orders where o_orderstatus = 'O' and o_totalprice > 200000 union all
    select o_orderkey, 'priority', 'medium', 1 from orders where o_orderpriority like '1%'
""")
def audit_cases(spark, sf_dir):
    """The cases that two audit rules make of orders."""
    rules = [audits.Rule("late", "high", "o_orderstatus = 'O' and o_totalprice > 200000", "open and large", "look"), audits.Rule("priority", "medium", "o_orderpriority like '1%'", "urgent", "ship")]
    return audits.cases(read(spark, sf_dir, "orders"), rules, ["o_orderkey"]).select("o_orderkey", "need_type", "severity", "severity_rank")


@query("""
    with c as (select p_partkey, case when regexp_matches(p_name || ' ' || p_type, 'STEEL') then 'metal' when regexp_matches(p_name || ' ' || p_type, '^[a-m]') then 'first' else 'other' end as table_category from part)
    select p_partkey, table_category, case table_category when 'metal' then 'main' else 'side' end as source_group from c where table_category in ('metal', 'first')
""")
def candidate_classes(spark, sf_dir):
    """Parts as tables, classed by ordered patterns; those of the recommended groups."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("anchor"), F.col("p_type").alias("header_sample"))
    classed = audits.classified(rows, [("metal", "main", "STEEL"), ("first", "side", "^[a-m]")])
    return audits.selected(classed, recommended=("main", "side")).select("p_partkey", "table_category", "source_group")


@query("""select event_id, '{"user":' || user_id || ',"api_token":"[redacted]","text":"' || event_type || '","at":["' || event_type || '"]}' as payload from events""")
def redacted_payloads(spark, sf_dir):
    """Events as payloads with a secret; the secret is hidden."""
    payload = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"api_token":"s3cret","text":" '), F.col("event_type"), F.lit('  ","at":["'), F.col("event_type"), F.lit('"]}'))
    return read(spark, sf_dir, "events").select("event_id", redact.redacted(payload).alias("payload"))


@query("""select o_orderkey, '{"row": ' || o_custkey || '}' as answer from orders""")
def fenced_answers(spark, sf_dir):
    """Answers of a chat service: fenced, inside other words, or plain."""
    plain = F.concat(F.lit('{"row": '), F.col("o_custkey").cast("string"), F.lit("}"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("It is "), plain, F.lit(" I think"))).otherwise(plain)
    return read(spark, sf_dir, "orders").select("o_orderkey", services.json_object(said).alias("answer"))


@query(f"""
    with q as (select item_id as query_id, split_part(text, '.', 1) as question, 'src' || (item_id % 20) as target from benchmark),
    t as (select query_id, unnest(list_filter(list_concat([question], regexp_split_to_array(question, {_quoted(T.DELIMITERS)})), lambda x: length(x) >= 2)) as token from q),
    c as (select doc_id as chunk_id, doc_id % 500 as field_id, text, source as namespace, lang from documents),
    f as (select query_id, chunk_id, 0.5::double as base from q join c on c.field_id = q.query_id union all select distinct t.query_id, c.chunk_id, 0.2::double from t join c on contains(c.text, t.token)),
    b as (select query_id, chunk_id, max(base) as base from f group by all)
    select b.query_id as field_id, chunk_id, round(base + case when namespace = target then 0.3::double else 0.0::double end + case lang when 'en' then 0.2::double when 'fr' then 0.15::double else 0.0::double end, 6) as score from b join q using (query_id) join c using (chunk_id)
""")
def coarse_candidates(spark, sf_dir):
    """Documents that a question finds by its field or by its words, with a coarse score."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("field_id"), F.substring_index("text", ".", 1).alias("question_text"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("target_namespace"))
    kind = F.when(F.col("lang") == "en", evidence.MAIN).when(F.col("lang") == "fr", evidence.EMBEDDED).otherwise("other")
    held = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 500).alias("field_id"), "text", F.lit(None).cast("string").alias("question_text"), F.lit(None).cast("string").alias("answer_value"), F.col("source").alias("namespace"), kind.alias("source_type"))
    return planning.mini_candidates(asked, held)
