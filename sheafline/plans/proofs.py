"""Registered queries over traces, evidence, citations, reconciliations, contracts and templates.

As in ``catalogue``, the driver's tables stand in for office files; each query says how.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import asof, contracts, proofs, reconcile
from sheafline.stored import scratch
from sheafline.streaming import runs

from .catalogue import query, read

#: Microseconds of a bucket of the as-of join.
HOUR = 3_600_000_000



def micros(name: str):
    """Microseconds of a time without a zone, read as UTC whatever the session's zone is."""
    return F.unix_micros(F.concat(F.col(name).cast("string"), F.lit("Z")).cast("timestamp"))


# --- traces and evidence -------------------------------------------------------------------------------------------


@query("""
    with asked as (select event_id, user_id, epoch_us(ts) as at from events where event_type <> 'error'), told as (select user_id, epoch_us(ts) as at, max(event_id) as error_id from events where event_type = 'error' group by all)
    select a.event_id, a.user_id, t.error_id, t.at as at_matched from asked a asof left join told t on a.user_id = t.user_id and a.at >= t.at
""")
def events_asof(spark, sf_dir):
    """Every event that isn't an error with the last error of its user before it."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    asked = events.where("event_type <> 'error'").drop("event_type")
    told = events.where("event_type = 'error'").select("user_id", "at", F.col("event_id").alias("error_id"))
    return asof.asof(asked, told, ["user_id"], "at", ["error_id"], HOUR).select("event_id", "user_id", "error_id", "at_matched")


TRACED_SQL = """
    records as (
        select epoch_us(o_orderdate) as us, o_orderkey as seq, nullif(case when o_orderkey % 5 <> 0 then (o_custkey % 500)::varchar else '' end, '') as own, case when o_orderkey % 2 = 0 then (o_custkey % 700)::varchar end as predicted,
               case when o_orderkey % 3 = 0 then 't' || o_orderkey end as t, case when o_orderkey % 3 = 1 then 'i' || o_orderkey when o_orderkey % 7 = 0 then 'j' || o_orderkey end as i, case when o_orderkey % 4 = 0 then 'r' || o_orderkey // 100 end as r from orders
    ), named as (select us, seq, coalesce(own, predicted) as field_id, coalesce(t, i, r) as trace_id from records where coalesce(own, predicted) is not null and coalesce(t, i, r) is not null)
"""


def _records(spark, sf_dir):
    """Orders as trace records that name their field and their trace in any of the ways that records do."""
    key, text = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    own = F.when(key % 5 != 0, (F.col("o_custkey") % 500).cast("string")).otherwise("")
    predicted = F.struct(F.when(key % 2 == 0, (F.col("o_custkey") % 700).cast("string")).alias("field_id"))
    ids = [F.when(key % 3 == 0, text("t", key)).alias("trace_id"), F.when(key % 3 == 1, text("i", key)).when(key % 7 == 0, text("j", key)).otherwise("").alias("id"), F.when(key % 4 == 0, text("r", F.floor(key / 100))).alias("run_id")]
    return read(spark, sf_dir, "orders").select(micros("o_orderdate").alias("at"), key.alias("seq"), own.alias("field_id"), predicted.alias("prediction"), *ids)


@query(f"with {TRACED_SQL} select field_id, arg_max(trace_id, (us, seq, trace_id)) as trace_id from named group by field_id")
def trace_index(spark, sf_dir):
    return proofs.trace_index(_records(spark, sf_dir), ["at", "seq"])


PREDICTED_SQL = """
    predicted as (
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 500)::varchar as field_id, 'B' || (l_partkey % 900 + 1) as target_cell, case l_returnflag when 'A' then 'answered' when 'N' then 'not_found' else 'partial_clue' end as answer_status,
               l_discount * 10 as confidence, 'c' || l_suppkey as chunk, epoch_us(l_shipdate) as us from lineitem
    )
"""


def _predictions(spark, sf_dir):
    """Line items as predictions of 500 fields, written when they were shipped."""
    status = F.when(F.col("l_returnflag") == "A", "answered").when(F.col("l_returnflag") == "N", "not_found").otherwise("partial_clue")
    part = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (part % 500).cast("string").alias("field_id"), F.concat(F.lit("B"), part % 900 + 1).alias("target_cell"), status.alias("answer_status"),
        (F.col("l_discount") * 10).alias("confidence"), F.array(F.concat(F.lit("c"), "l_suppkey")).alias("source_chunk_ids"), F.array().cast("array<string>").alias("evidence_attachment_ids"), micros("l_shipdate").alias("at"),
    )


PLACES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"""
    with {TRACED_SQL}, {PREDICTED_SQL}, told as (select field_id, us, max(trace_id) as trace_id from named group by all)
    select p.field_id, t.trace_id, count(*) as n, sum(l_orderkey)::bigint as orders from predicted p asof left join told t on p.field_id = t.field_id and p.us >= t.us group by all
""")
def traces_at_write(spark, sf_dir):
    """The trace that every prediction's field had when it was written, counted."""
    placed = proofs.traced_at(_predictions(spark, sf_dir), _records(spark, sf_dir), "at", HOUR * 24 * 90)
    return placed.groupBy("field_id", "trace_id").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


@query(f"""
    with {TRACED_SQL}, {PREDICTED_SQL}, idx as (select field_id, arg_max(trace_id, (us, seq, trace_id)) as trace_id from named group by field_id),
    lasts as (select * from predicted qualify row_number() over (partition by field_id order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1),
    earlier as (select p_partkey::varchar as field_id, 'Z' || (p_size + 1) as target_cell from part)
    select field_id, target_cell, answer_status, round(confidence, 4) as confidence, chunk as chunks, trace_id from lasts left join idx using (field_id)
    union all select field_id, target_cell, 'answered', 1.0::double, '', null from earlier where field_id not in (select field_id from lasts)
""")
def evidence_map(spark, sf_dir):
    """Records of the fields of all predictions, over a map of a former write that names every part."""
    told = proofs.traced(_predictions(spark, sf_dir), proofs.trace_index(_records(spark, sf_dir), ["at", "seq"]))
    none = F.array().cast("array<string>")
    earlier = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("field_id"), F.concat(F.lit("Z"), F.col("p_size") + 1).alias("target_cell"), F.lit("answered").alias("answer_status"), F.lit(1.0).alias("confidence"), none.alias("source_chunk_ids"), none.alias("evidence_attachment_ids"), F.lit(None).cast("string").alias("trace_id"))
    found = proofs.evidence_map(told, PLACES, earlier)
    return found.select("field_id", "target_cell", "answer_status", F.round("confidence", 4).alias("confidence"), F.array_join("source_chunk_ids", ",").alias("chunks"), "trace_id")


@query("""
    with hits as (select l_orderkey as query_id, l_linenumber as rank, l_partkey as chunk_id, max(l_returnflag) as file_name, case when l_partkey % 11 = 0 then '' else 'P' || l_partkey end as anchor, max(l_linestatus) as raw_text from lineitem group by all),
    held as (select * from hits qualify row_number() over (partition by query_id, chunk_id order by rank desc) = 1),
    best as (select * from hits qualify row_number() over (partition by query_id order by rank, chunk_id) = 1),
    lines as (select *, concat_ws(' / ', nullif(file_name, ''), nullif(anchor, ''), nullif(raw_text, '')) as line from held), cited as (
        select o_orderkey as query_id, string_agg(line, '；' order by pos, h.chunk_id) as s, count(line) as n
        from (select o_orderkey, unnest([2, 1, 2]) as which, unnest([0, 1, 2]) as pos from orders where o_orderkey % 3 = 1) join hits h on h.query_id = o_orderkey and h.rank = which
        join lines l on l.query_id = o_orderkey and l.chunk_id = h.chunk_id group by o_orderkey
    )
    select o_orderkey as query_id, case when o_orderkey % 3 = 0 then 'references' when c.n > 0 then 'chunks' when b.query_id is not null then 'best_hit' else 'none' end as source,
           case when o_orderkey % 3 = 0 then 2 when c.n > 0 then c.n else 0 end::int as n_cited,
           case when o_orderkey % 3 = 0 then o_orderstatus || ' / C' || o_custkey || '；' || o_orderpriority when c.n > 0 then c.s else coalesce(concat_ws(' / ', nullif(b.file_name, ''), nullif(b.anchor, ''), nullif(b.raw_text, '')), '') end as summary
    from orders left join cited c on c.query_id = o_orderkey left join best b on b.query_id = o_orderkey
""")
def answer_citations(spark, sf_dir):
    """Orders as answers, their lines as hits: a third names references, a third cites its second, first and second line, a third nothing."""
    key, no = F.col("o_orderkey"), F.lit(None).cast("string")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("chunk_id")).agg(F.max("l_returnflag").alias("file_name"), F.max("l_linestatus").alias("raw_text"))
    hits = lines.withColumn("anchor", F.when(F.col("chunk_id") % 11 == 0, "").otherwise(F.concat(F.lit("P"), "chunk_id")))
    places = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("query_id"), F.posexplode(F.array(F.lit(2), F.lit(1), F.lit(2))).alias("pos", "rank"))
    cited = places.join(hits, ["query_id", "rank"]).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunk_ids"))
    reference = lambda a, b, c: F.struct(a.alias("file_name"), b.alias("anchor"), c.alias("reason"))
    named = F.when(key % 3 == 0, F.array(reference(F.col("o_orderstatus"), F.concat(F.lit("C"), "o_custkey"), no), reference(F.lit(""), no, F.col("o_orderpriority"))))
    answers = read(spark, sf_dir, "orders").select(key.alias("query_id"), named.alias("references")).join(cited, "query_id", "left")
    return proofs.citations(answers, hits)


@query("""
    with steps as (select user_id, strftime(ts, '%Y-%m') as month, event_id, epoch_us(ts) // 1000 as ms, event_type from events where user_id is not null and event_id is not null and ts is not null)
    select user_id::varchar as run_id, month as field_id, count(*)::bigint as n_events, min(ms)::bigint as first_ms, max(ms)::bigint as last_ms, arg_max(event_type, event_id) as status,
           bool_or(coalesce(event_type = 'purchase', false)) as completed, bool_or(coalesce(event_type = 'error', false)) as repaired, bool_or(coalesce(event_type = 'click', false)) as reviewed
    from steps group by all
""")
def streamed_runs(spark, sf_dir):
    """Events as a stream, delivered twice: a user's month is a field's run; purchases complete it, errors repair it, clicks review it."""
    paths = f"{sf_dir}/events*.parquet"
    kind = F.col("event_type")
    step = F.when(kind == "purchase", "field_completed").when(kind == "error", "repaired").when(kind == "click", "reviewed").otherwise("other")
    told = spark.readStream.schema(spark.read.parquet(paths).schema).parquet(paths)
    events = told.select(F.col("user_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM").alias("field_id"), F.col("event_id").alias("seq"), step.alias("step"), kind.alias("status"), F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("ts"))
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).drop("delivery")
    found = runs.stored_runs(twice, scratch(spark), late="3650 days")
    return found.select("run_id", "field_id", "n_events", "first_ms", "last_ms", "status", "completed", "repaired", "reviewed")


# --- reconciliations -------------------------------------------------------------------------------------------------


@query("""
    with a as (select o_orderkey as k, 1 + o_orderkey % 4 as n from orders where o_orderkey % 10 <> 3), b as (select l_orderkey as k, count(*) as n from lineitem where l_orderkey % 10 <> 4 group by all)
    select k as order_id, coalesce(a.n, 0)::bigint as n_expected, coalesce(b.n, 0)::bigint as n_actual, case when a.n is null then 'unexpected' when b.n is null then 'missing' when a.n <> b.n then 'differs' else 'equal' end as status
    from a full join b using (k)
""")
def lines_reconciled(spark, sf_dir):
    """Orders say how many lines they should have, line items how many there are; some are left out on either side."""
    said = read(spark, sf_dir, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("order_id"), (1 + F.col("o_orderkey") % 4).alias("n"))
    lines = read(spark, sf_dir, "lineitem").where("l_orderkey % 10 <> 4").select(F.col("l_orderkey").alias("order_id"))
    return reconcile.reconciled(said, lines, ["order_id"], F.col("n"))


@query("""
    with rows as (select p_partkey // 100 as f, 0 as s, p_partkey % 100 as r, p_partkey from part), segs as (select *, p_partkey % 13 = 0 as bare from rows where p_partkey % 7 <> 0),
    att as (select l_partkey as p_partkey, count(*) as n from lineitem where l_quantity > 30 group by all),
    compared as (select f, r, 's' as kind from rows where p_partkey % 7 = 0 union all select f, r, 'm' from segs where bare
        union all select s.f, s.r, 'a' from segs s left join att using (p_partkey) where coalesce(att.n, 0) <> (p_partkey % 9))
    select 'f' || f as file_id, count(*) filter (where p_partkey % 7 <> 0) as n_segments, any_value(sk) as n_skipped, any_value(mm) as n_bare, any_value(am) as n_attachments_differ, case when any_value(mm) + any_value(am) = 0 then 'pass' else 'review' end as verdict
    from rows join (select rows.f, coalesce(count(*) filter (where kind = 's'), 0) as sk, count(*) filter (where kind = 'm') as mm, count(*) filter (where kind = 'a') as am from (select distinct f from rows) rows left join compared using (f) group by rows.f) using (f)
    group by f
""")
def segments_audited(spark, sf_dir):
    """Parts as rows of sheets of 100: most are segments that say how many line items above 30 they are bound to."""
    part, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    place = [F.concat(F.lit("f"), F.floor(key / 100).cast("string")).alias("file_id"), F.lit(0).alias("sheet_index"), (key % 100).cast("int").alias("row")]
    segments = part.where("p_partkey % 7 <> 0").select(*place, F.when(key % 13 != 0, F.col("p_name")).alias("capability"), F.lit(" ").alias("answer"), (key % 9).alias("proof_attachment_count"))
    mapping = part.groupBy(place[0]).agg(F.lit(0).alias("sheet_index"), F.min(key % 100).cast("int").alias("data_start"), F.max(key % 100).cast("int").alias("data_end"))
    line = F.col("l_partkey")
    bound = read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.concat(F.lit("f"), F.floor(line / 100).cast("string")).alias("file_id"), F.lit(0).alias("sheet_index"), (line % 100).cast("int").alias("row"))
    return reconcile.audited_segments(mapping, segments, bound)


@query(r"""
    with p as (select doc_id, source, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g')) as t from documents), w as (select source, doc_id, unnest(generate_series(1, 2)) as k, t from p where t <> ''),
    titles as (select source, case when k = 1 then (doc_id % 9 + 1) || '、' || substr(t, 1, (doc_id % 60)::bigint + 1) else t end as t from w),
    h as (select source, length(trim(t)) as n from titles where regexp_matches(trim(t), '^([一二三四五六七八九十]+、|[0-9]+、)')),
    media as (select 'src' || (page_id % 20) as source, page_id from pages)
    select source as file_id, any_value(c) as n_paragraphs, count(n) filter (where n <= 40) as n_short, count(n) filter (where n > 40) as n_long, any_value(bad) as n_invalid_media, case when any_value(bad) = 0 then 'pass' else 'review_media' end as verdict
    from (select source, count(*) as c from titles group by source) left join h using (source) left join (select source, count(*) filter (where page_id % 97 = 0) as bad from media group by source) using (source) where bad is not null group by source
""")
def documents_audited(spark, sf_dir):
    """Documents as two paragraphs each of the file of their source, one under a number; pages as the files' media, some without a name."""
    docs = read(spark, sf_dir, "documents")
    text = reconcile.T.collapse(F.col("text"))
    title = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("、"), F.substring(text, F.lit(1), (F.col("doc_id") % 60 + 1).cast("int")))
    blocks = docs.where(text != "").select(F.col("source").alias("file_id"), F.lit("paragraph").alias("block_type"), F.explode(F.array(title, text)).alias("text"))
    page = F.col("page_id")
    media = read(spark, sf_dir, "pages").select(F.concat(F.lit("src"), (page % 20).cast("string")).alias("file_id"), F.when(page % 97 == 0, "word/media/").otherwise(F.concat(F.lit("word/media/image"), page.cast("string"), F.lit(".png"))).alias("media_path"))
    files = media.select("file_id").distinct().join(docs.select(F.col("source").alias("file_id")).distinct(), "file_id")
    return reconcile.audited_documents(files, blocks, media).select("file_id", "n_paragraphs", "n_short", "n_long", "n_invalid_media", "verdict")


# --- contracts -------------------------------------------------------------------------------------------------------

MODE_SQL = "case o_orderkey % 4 when 0 then 'cell_answer' when 1 then 'status_with_current_info' when 2 then 'finding_row' else 'risk_row' end"


@query(f"""
    with a as (select o_orderkey as request_id, {MODE_SQL} as mode, o_orderpriority as p, o_totalprice as v, o_orderstatus as s from orders where o_orderkey % 4 < 2),
    n as (select l_orderkey as request_id, count(*) as chunks from lineitem group by all)
    select request_id, mode, concat_ws('|',
        case when mode = 'cell_answer' and s = 'F' then 'missing answer_value' end, case when mode = 'status_with_current_info' and p = '5-LOW' then 'missing current_info' end,
        case when coalesce(chunks, 0) = 0 then 'missing source_chunks' end, case when v > 400000 then 'confidence must be between 0 and 1' end, case when mode = 'status_with_current_info' and s = 'F' then 'status is none of its values' end) as problems
    from a left join n using (request_id)
""")
def contract_checks(spark, sf_dir):
    """Orders as answers in two modes, their lines as the chunks that they rest on; each with what breaks its contract."""
    orders, key = read(spark, sf_dir, "orders").where("o_orderkey % 4 < 2"), F.col("o_orderkey")
    chunks = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("c")))), lambda x: x["c"]).alias("chunks"))
    joined = orders.join(chunks, "o_orderkey", "left").withColumn("mode", F.when(key % 4 == 0, "cell_answer").otherwise("status_with_current_info"))
    fields = [F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("answer_value"), F.when(F.col("o_orderstatus") == "F", "maybe").otherwise("满足").alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise(" ").alias("current_info"), F.when(F.col("o_totalprice") > 400000, 1.5).otherwise(0.5).alias("confidence"), F.col("chunks").alias("source_chunks")]
    answers = joined.select(key.alias("request_id"), "mode", F.to_json(F.struct(*fields)).alias("answer"))
    return contracts.checked(answers).select("request_id", "mode", F.array_join("problems", "|").alias("problems"))


@query("""
    with sheets as (select c_custkey as sheet_id, c_custkey % 5 as k, case c_custkey % 5 when 0 then 'fill_form' when 1 then 'assessment_matrix' when 2 then 'filtered_findings' when 3 then 'risk_register' else 'layout' end as kind, c_mktsegment = 'BUILDING' as sample, case when c_nationkey % 4 = 0 then 'finding_row' when c_nationkey % 4 = 1 then 'nonsense' when c_nationkey % 4 = 2 then 'evidence_or_layout_reference' end as hinted, c_acctbal > 0 as proof from customer)
    select sheet_id, case when k = 4 then 'evidence_or_layout_reference' when hinted = 'finding_row' then hinted when hinted = 'evidence_or_layout_reference' then 'cell_answer'
           when k = 1 then 'status_with_current_info' when k = 2 then 'finding_row' when k = 3 then 'risk_row' else 'cell_answer' end as mode,
           'target_namespace,category,question' || case when k in (1, 2) then ',status,current' when k = 3 then ',target,current' else '' end as include_fields, 'instruction' || case when sample then ',sample' else '' end as auxiliary_fields, proof as needs_evidence
    from sheets
""")
def sheet_templates(spark, sf_dir):
    """Customers as sheets of five kinds with or without a hinted mode; each with the template of its kind."""
    k = F.col("c_custkey") % 5
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("fill_form", "assessment_matrix", "filtered_findings", "risk_register", "layout")]), (k + 1).cast("int"))
    n = F.col("c_nationkey") % 4
    hinted = F.when(n == 0, "finding_row").when(n == 1, "nonsense").when(n == 2, "evidence_or_layout_reference")
    sheets = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sheet_id"), kinds.alias("sheet_kind"), hinted.alias("hinted_mode"), (F.col("c_mktsegment") == "BUILDING").alias("has_sample"), (F.col("c_acctbal") > 0).alias("needs_evidence"))
    made = contracts.templates(sheets)
    return made.select("sheet_id", "mode", F.array_join("include_fields", ",").alias("include_fields"), F.array_join("auxiliary_fields", ",").alias("auxiliary_fields"), "needs_evidence")
