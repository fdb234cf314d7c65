"""SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import licenses

ORACLES: dict[str, str] = {
    "op1_license_scans": licenses.oracle(),
    "op4_warc_archives": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
        f as (select *, min(page_id) over (partition by h) as first_id from p)
        select page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::bigint, 1)), '') as payload_digest,
               case when page_id = first_id then 'response' else 'revisit' end as record_type,
               case when page_id = first_id then null else first_id end as refers_to
        from f
    """,
    "op8_tool_call_linking": """
        with calls as (
            select conv_id, turn, 'c' || turn as call_id, coalesce(text, '') as text,
                   row_number() over (partition by conv_id, turn % 2 order by turn) - turn // 2 as run
            from conversations where role = 'user' and turn is not null and conv_id is not null
        ), leveled as (
            select *, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as level,
                   case when length(text) between 1 and 1000 then '' else 'range:text' end as errors,
                   json_object('text', text, 'turn', turn) as arguments
            from calls
        ), results as (
            select conv_id, turn as result_turn, 'c' || (turn - 1) as call_id, coalesce(text, '') as content
            from conversations where role = 'assistant' and turn is not null and conv_id is not null
        ), j as (
            select coalesce(l.conv_id, r.conv_id) as conv_id, coalesce(l.call_id, r.call_id) as call_id, turn as call_turn, result_turn, level,
                   case when l.call_id is null then 'orphan' when r.call_id is null then 'unanswered' else 'answered' end as status,
                   coalesce(errors, '') as errors, (l.call_id is not null)::bigint as n_calls, (r.call_id is not null)::bigint as n_results, arguments, content
            from leveled l full outer join results r on l.conv_id = r.conv_id and l.call_id = r.call_id
        )
        select conv_id, call_id, call_turn, result_turn, level, status, errors, n_calls, n_results,
               case status when 'orphan' then json_object('content', content, 'id', call_id, 'status', status)
                    when 'unanswered' then json_object('arguments', arguments, 'id', call_id, 'name', 'reply', 'status', status)
                    else json_object('arguments', arguments, 'content', content, 'id', call_id, 'name', 'reply', 'status', status) end::varchar as record
        from j
    """,
    "op9_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        select doc_id,
               max(doc_id) over (partition by text_sha256) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = max(doc_id) over (partition by text_sha256) as kept,
               text_sha256
        from d
    """,
    "op11_ranked_lexical_search": r"""
        with held as (
            select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents
        ), asked as (
            select row_number() over () as q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark
        ), corpus as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from held where len(terms) > 0),
        sized as (
            select d, doc_id, terms, 50 + (50 * len(terms) * n_docs) // n_terms as m from held, corpus where len(terms) > 0
        ), postings as (
            select d, doc_id, m, term, count(*) as tf from (select d, doc_id, m, unnest(terms) as term from sized)
            where term in (select term from asked) group by all
        ), weights as (
            select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from postings, corpus group by term, n_docs
        ), scores as (
            select q, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
            from asked join postings using (term) join weights using (term) group by all
        )
        select item_id, row_number() over (partition by q order by score desc, doc_id nulls last)::int as rank, doc_id, score from scores where score > 0
        qualify rank <= 50
    """,
    "op12_conversation_repair": r"""
        with recursive keyed as (
            select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
        ), hashed as (  -- crc32 bit by bit: eight steps after each byte
            select * exclude key, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)),
                   lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, z: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0 end))), 4294967295) % 20 as kind
            from keyed
        ), damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
                   case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text
            from hashed, range(case when kind = 3 then 2 else 1 end) where kind <> 0
        ), placed as (
            select *, row_number() over w as n, lag(role[1]) over w as before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare
            from damaged window w as (partition by conv_id order by turn nulls first, role, sha256(text))
        ), counted_up as (
            select *, row_number() over (partition by conv_id, role, text order by n) as seen from placed
        ), judged as (
            select *, case when bare = '' then 'blank' when seen > 1 then 'duplicate' when bare[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault,
                   case when bare = '' or seen > 1 then null when bare[-1] not in ('.', '!', '?') then 3 else 0 end as kept
            from counted_up
        ), counted as (
            select conv_id, count(*) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                   count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
                   count(*) filter (where n > 1 and before || role[1] not in ('su', 'ua', 'au')) as illegal
            from judged group by conv_id
        ), solved as (  -- from the last row to the first; for each state of the roles before it (0 none, s, u, a) the cost, the edits and the turns from here on
            select conv_id, rows as n, {c: 0::bigint, e: '', t: []::varchar[]} as f0, {c: 6::bigint, e: 'II', t: ['user:', 'assistant:']} as fs,
                   {c: 3::bigint, e: 'I', t: ['assistant:']} as fu, {c: 0::bigint, e: '', t: []::varchar[]} as fa
            from counted
            union all
            select conv_id, n, least(r0, {c: iu.c + 3, e: 'I' || iu.e, t: ['user:'] || iu.t}), least(rs, {c: iu.c + 3, e: 'I' || iu.e, t: ['user:'] || iu.t}), iu,
                   least(ra, {c: iu.c + 3, e: 'I' || iu.e, t: ['user:'] || iu.t})
            from (
                select *, least(ru, {c: ra.c + 3, e: 'I' || ra.e, t: ['assistant:'] || ra.t}) as iu from (
                    select s.conv_id, s.n - 1 as n,
                           least({c: f0.c + 4, e: 'D' || f0.e, t: f0.t}, {c: fu.c + kept + 3, e: 'R' || fu.e, t: ['user:' || text] || fu.t},
                                 case when role[1] = 's' then {c: fs.c + kept, e: 'K' || fs.e, t: [role || ':' || text] || fs.t} when role[1] = 'u' then {c: fu.c + kept, e: 'K' || fu.e, t: [role || ':' || text] || fu.t} end) as r0,
                           least({c: fs.c + 4, e: 'D' || fs.e, t: fs.t}, {c: fu.c + kept + 3, e: 'R' || fu.e, t: ['user:' || text] || fu.t},
                                 case when role[1] = 'u' then {c: fu.c + kept, e: 'K' || fu.e, t: [role || ':' || text] || fu.t} end) as rs,
                           least({c: fu.c + 4, e: 'D' || fu.e, t: fu.t}, {c: fa.c + kept + 3, e: 'R' || fa.e, t: ['assistant:' || text] || fa.t},
                                 case when role[1] = 'a' then {c: fa.c + kept, e: 'K' || fa.e, t: [role || ':' || text] || fa.t} end) as ru,
                           least({c: fa.c + 4, e: 'D' || fa.e, t: fa.t}, {c: fu.c + kept + 3, e: 'R' || fu.e, t: ['user:' || text] || fu.t},
                                 case when role[1] = 'u' then {c: fu.c + kept, e: 'K' || fu.e, t: [role || ':' || text] || fu.t} end) as ra
                    from solved s join judged j on s.conv_id is not distinct from j.conv_id and s.n = j.n
                )
            )
        )
        select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, coalesce(f0.c, 0) as cost, coalesce(f0.e, '') as audit, sha256(coalesce(array_to_string(f0.t, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join counted k on o.conv_id is not distinct from k.conv_id
        left join solved s on o.conv_id is not distinct from s.conv_id and s.n = 0
    """,
}
