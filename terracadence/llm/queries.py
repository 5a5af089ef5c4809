"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, hardneg, heaplloyd, linededup, mixing, neardup, packing, quality, secrets, substring, topk, toxicity, wrappers
from .common import read


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(read(spark, sf_dir, "documents")))


def op3_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("repeats", "mix_key")


def op6_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


def op7_line_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_de_bruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op11_gemm_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hardneg.mine(rows, rows.where("vec_id % 100 = 0"))


def op12_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read(spark, sf_dir, "pages"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heaplloyd.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_fm, op2_credential_links, op3_block_topk, op4_toxicity_chain, op5_hash_mix, op6_canonical_digest, op7_line_setjoin, op8_min_slack_packing, op9_odd_sketch_minhash, op10_de_bruijn_spans, op11_gemm_negatives, op12_html_wrappers, op13_heap_lloyd)}

def _lloyd_sql() -> str:
    """Two rounds and a last assignment, written out: m is 64 * distance + entry, so its least value breaks ties to the lower index."""
    way = " + ".join(f"(s[{d}] - c[{d}]) * (s[{d}] - c[{d}])" for d in range(1, 5))
    mean = ", ".join(f"cast(floor(sum(s[{d}]) / cast(count(*) as double)) as bigint)" for d in range(1, 5))
    assign = lambda r: f"a{r} as materialized (select x.n, x.p, any_value(s) as s, min(({way}) * 64 + e) as m from x join b{r} b on x.p = b.p group by x.n, x.p)"
    update = lambda r: f"b{r + 1} as materialized (select b.p, b.e, coalesce(u.c, b.c) as c from b{r} b left join (select p, m % 64 as e, [{mean}] as c from a{r} group by all) u on b.p = u.p and b.e = u.e)"
    return f"""
        with v as materialized (
            select row_number() over (order by vec_id nulls last) - 1 as n, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) is not false
        ), x as materialized (select n, p, v[4 * p + 1:4 * p + 4] as s from v, range(16) t(p)),
        b0 as materialized (select p, n as e, s as c from x where n < 64),
        {assign(0)}, {update(0)}, {assign(1)}, {update(1)}, {assign(2)},
        r as (select n, string_agg(format('{{:02x}}', m % 64), '' order by p) as code, cast(sum(m // 64) as bigint) as error from a2 group by n),
        h as (select sha256(string_agg(array_to_string(list_transform(c, lambda y: cast(y as varchar)), ','), ',' order by p, e)) as codebooks_sha256 from b2)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from r join v using (n), h"""


def _secrets_sql() -> str:
    """The scan in SQL: places from the lengths of gaps and matches, links from a join of intervals."""
    quote = lambda x: x.replace("'", "''")
    found = " union all ".join(
        f"select doc_id, '{kind}' as kind, {secrets.ORDER[kind]} as ord, string_split_regex(t, '{quote(pattern)}') as gaps, regexp_extract_all(t, '{quote(pattern)}', 0) as hits, regexp_extract_all(t, '{quote(pattern)}', {group}) as vals, {least} as least from d"
        for kind, pattern, group, least in secrets.BASE + secrets.WEAK
    )
    role = "case " + " ".join(f"when kind = '{k}' then '{r}'" for k, r in secrets.ROLE.items()) + " end"
    n_base, reach = len(secrets.BASE), secrets.REACH
    return f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        f as ({found}),
        u as (select doc_id, kind, ord, gaps, hits, vals, least, unnest(generate_series(1, len(hits))) as i from f where len(hits) > 0),
        s as (
            select doc_id, kind, ord, vals[i] as val, least, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) as start, len(hits[i]) as n from u
        ), p as (
            select doc_id, kind, ord, start, start + n as stop, {role} as role from s
            where len(val) >= least and (kind <> 'bare_secret' or (regexp_matches(val, '[0-9]') and regexp_matches(val, '[a-z]') and regexp_matches(val, '[A-Z]')))
        ), w as (
            select a.doc_id, a.kind, a.ord, a.start, a.stop, a.role, bool_or(b.role = 'id') as has_id, bool_or(b.role = 'secret') as has_secret, bool_or(b.ord < {n_base} and b.start < a.stop and b.stop > a.start) as covered
            from p a join p b on a.doc_id = b.doc_id and a.ord >= {n_base} and b.start <= a.stop + {reach} and b.stop >= a.start - {reach} group by all
        ), k as (
            select doc_id, kind, ord, start, stop from p where ord < {n_base} union all
            select doc_id, kind, ord, start, stop from w where not covered and case role when 'id' then has_secret when 'secret' then has_id else has_id and has_secret end
        ), g as (
            select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
                   string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (ord < {n_base}) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans
            from k group by doc_id
        )
        select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


SQL = {
    "op2_credential_links": _secrets_sql(),
    "op3_block_topk": """
        with v as (
            select vec_id, list_transform(min(embedding), lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
            where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) is not false
            group by vec_id
        ), s as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
        ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op11_gemm_negatives": """
        with v as materialized (
            select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
            where vec_id is not null and label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) is not false
        ), s as materialized (
            select a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
            from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id
        ), p as (
            select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
        ), n as (
            select anchor_id, positive_id, id as negative_id, positive_score, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
            from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
        )
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op13_heap_lloyd": _lloyd_sql(),
    "op5_hash_mix": r"""
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                   substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 9) as key
            from documents
        ), t as (select source, cast(sum(size) as bigint) as source_size from d group by source),
        w as (select *, 1.0::double + (row_number() over (order by source asc nulls last) - 1) % 3 as w, cast(3 * source_size as double) as cap from t),
        o as (
            select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over b, 0))::double / ((sum(w) over ()) - coalesce(sum(w) over b, 0)) as level
            from w window b as (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding)
        ), p as (
            select source, source_size,
                   case when cap / w > level then w * (select min_by(level, cap / w) from o where cap / w > level) else cap end as target
            from o
        ), q as (
            select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as whole from p
        ), c as (
            select d.*, q.source_size, q.target, q.whole, greatest(q.target - q.whole * q.source_size, 0) as rest,
                   sum(d.size) over (partition by d.source order by key range between unbounded preceding and current row) as upto,
                   sum(d.size) over (partition by d.source, key) as n
            from d join q on d.source is not distinct from q.source
        )
        select doc_id, cast(size as bigint) as size, source_size, target,
               cast(size * least(whole + (case when upto <= rest or (upto - n < rest and upto - rest < rest - (upto - n)) then 1 else 0 end), 3) as bigint) as taken
        from c""",
    "op9_odd_sketch_minhash": r"""
        with recursive d as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents
        ), s as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                   else list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
            from d
        ), e as (select doc_id, len(s) as n, unnest(s) as x from s),
        p as (select a.doc_id as u, b.doc_id as v, a.n as n, b.n as m, count(*) as meet from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
        l as (select u, v from p where 100 * meet >= 85 * (n + m - meet)),
        g as (select u, v from l union all select v, u from l),
        r as (select u as node, u as seen from g union select r.node, g.v from r join g on r.seen = g.u),
        c as (select node, min(seen) as component from r group by node)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.component, s.doc_id) as component_id, s.doc_id = coalesce(c.component, s.doc_id) as kept
        from s left join c on s.doc_id = c.node""",
    "op10_de_bruijn_spans": r"""
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (
            select doc_id, unnest(generate_series(1, len(w) - 19)) as pos from d where len(w) >= 20
        ), h as (select s.doc_id, s.pos, array_to_string(d.w[s.pos:s.pos + 19], ' ') as x from s join d using (doc_id)),
        l as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by x order by doc_id, pos) as r from h) where r > 1),
        g as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(generate_series(pos, pos + 19)) as p from l) group by doc_id),
        k as (
            select d.doc_id, d.w, case when g.gone is null then d.w else list_filter(d.w, lambda x, i: not list_contains(g.gone, i)) end as kept
            from d left join g using (doc_id)
        )
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - len(kept) as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k""",
    "op7_line_setjoin": r"""
        with l as (
            select doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1))) as x from documents
        ), s as (
            select doc_id, x[2] as ln, x[1] as line, list_sort(list_distinct(list_filter(string_split_regex(x[1], '[\x20\x09-\x0D]+'), lambda w: w <> ''))) as s from l
        ), o as (select *, len(s) as n, row_number() over (order by doc_id, ln) as pos from s),
        d as (select s, min(pos) as pos, any_value(n) as n from o where n > 0 group by s),
        e as (select pos, n, unnest(s) as w from d),
        p as (select a.pos as x, b.pos as y, a.n as n, b.n as m, count(*) as meet from e a join e b on a.w = b.w and a.pos > b.pos and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
        r as (select distinct x from p where 100 * meet >= 80 * (n + m - meet)),
        k as (select o.*, (o.n > 0 and (o.pos > d.pos or d.pos in (select x from r))) as gone from o left join d on o.s = d.s)
        select doc_id, count(*) as n_lines, cast(count_if(gone) as bigint) as n_removed,
               case when any_value(t.text) is null then null else sha256(coalesce(string_agg(line, chr(10) order by ln) filter (not coalesce(gone, false)), '')) end as kept_sha256
        from k join documents t using (doc_id) group by doc_id""",
}
