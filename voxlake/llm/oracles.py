"""SQL (DuckDB) for the queries that SQL can express on whole tables in reasonable time."""

ORACLE_SQL = {
    "op6_topk_search": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings),
 s as (select q.vec_id as query_id, r.vec_id, list_dot_product(q.e, r.e)::bigint as score from v q, v r where q.vec_id % 50 = 0 and q.vec_id <> r.vec_id),
 k as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select * from k where rank <= 5""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as h from pages), d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
 f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f""",
}
