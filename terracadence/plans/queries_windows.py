"""Registered window queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from .tables import DAILY, OBS, daily, observations
from .temporal import weak_labels

K = ["user_id"]
QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add




@query(f"""with {OBS}, p as (
        select o.event_id, max({{'t': p.ts_us, 'e': p.event_id, 'v': p.v}}) as m from o join o p on p.user_id = o.user_id and p.ts_us < o.ts_us and p.ok and p.v is not null group by o.event_id
    ) select o.event_id, o.v, m.v as v_prev, m.t as v_prev_ts, o.v - m.v as v_delta, case when abs(m.v) > 1e-6 then (o.v - m.v) / abs(m.v) end as v_pct_change
      from o left join p using (event_id)""")
def prev_valid_block(spark, sf):
    """W-01 to W-03."""
    o = observations(spark, sf)
    return W.change(W.previous(o, K, F.col("v"), F.col("ok"), "v", tie="event_id"), F.col("v"), "v").select("event_id", "v", "v_prev", "v_prev_ts", "v_delta", "v_pct_change")


HIST = f"""with {OBS}, g as (
        select o.event_id, list([p.ts_us::double, p.event_id::double, p.v] order by p.ts_us, p.event_id) as h from o join o p on p.user_id = o.user_id and p.ts_us < o.ts_us and p.ok and p.v is not null group by o.event_id
    ), x as (
        select o.*, list_transform(coalesce(h, [])[-3:], lambda e: e[3]) as h, list_transform(coalesce(h, [])[-2:], lambda e: e[1]) as t from o left join g using (event_id)
    ), s as (select *, case when v is null then h else list_concat(h, [v]) end as q from x)"""


@query(HIST + """ select event_id, case when len(h) >= 2 then v - h[-2] end as v_delta_2obs,
    case when len(q) >= 2 then (q[-2] + q[-1]) / 2 end as v_rolling_mean_2, case when len(q) >= 3 then (q[-3] + q[-2] + q[-1]) / 3 end as v_rolling_mean_3 from s""")
def rolling_valid_means(spark, sf):
    """W-04, W-05."""
    o = observations(spark, sf)
    out = W.valid_window_stats(W.valid_history(o, K, F.col("v"), F.col("ok"), "v", tie="event_id"), F.col("v"), "v")
    return out.select("event_id", "v_delta_2obs", "v_rolling_mean_2", "v_rolling_mean_3")


@query(HIST + """, m as (select *, (q[-3] + q[-2] + q[-1]) / 3 as m, (h[-2] + h[-1] + v) / 3 as mp, (0 + (t[2] - t[1]) / 86400000000 + (ts_us - t[1]) / 86400000000) / 3 as md from s)
    select event_id, case when len(q) >= 3 then sqrt(((q[-3] - m) * (q[-3] - m) + (q[-2] - m) * (q[-2] - m) + (q[-1] - m) * (q[-1] - m)) / 3) end as v_rolling_std_3,
    case when v is not null and len(h) >= 2 then ((0 - md) * (h[-2] - mp) + ((t[2] - t[1]) / 86400000000 - md) * (h[-1] - mp) + ((ts_us - t[1]) / 86400000000 - md) * (v - mp))
      / nullif((0 - md) * (0 - md) + ((t[2] - t[1]) / 86400000000 - md) * ((t[2] - t[1]) / 86400000000 - md) + ((ts_us - t[1]) / 86400000000 - md) * ((ts_us - t[1]) / 86400000000 - md), 0) end as v_slope_last_3 from m""")
def slope_last3(spark, sf):
    """W-06, W-07."""
    o = observations(spark, sf)
    out = W.valid_window_stats(W.valid_history(o, K, F.col("v"), F.col("ok"), "v", tie="event_id"), F.col("v"), "v")
    return out.select("event_id", "v_rolling_std_3", "v_slope_last_3")


@query(f"""with {OBS}, c as (
        select o.event_id, o.ts_us, o.v, p.v as pv, p.ts_us as pt from o left join o p on p.user_id = o.user_id and p.ok and p.v is not null and (p.ts_us < o.ts_us or p.event_id = o.event_id)
    ), m as (select event_id, max(pv) as v_peak from c group by event_id),
    t as (select c.event_id, any_value(c.ts_us) as ts_us, any_value(c.v) as v, any_value(m.v_peak) as v_peak, min(case when c.pv = m.v_peak then c.pt end) as v_peak_ts from c join m using (event_id) group by c.event_id)
    select event_id, v_peak, v_peak_ts, v - v_peak as v_drop_from_peak, (v - v_peak) / case when abs(v_peak) > 1e-6 then abs(v_peak) end as v_drop_fraction, (ts_us - v_peak_ts) / 86400000000 as v_days_since_peak from t""")
def running_peak(spark, sf):
    """W-08."""
    o = observations(spark, sf)
    return W.running_peak(o, K, F.col("v"), F.col("ok"), "v").select("event_id", "v_peak", "v_peak_ts", "v_drop_from_peak", "v_drop_fraction", "v_days_since_peak")


@query(f"""with {OBS} select event_id, dense_rank() over (partition by user_id order by ts_us) as observation_number, (ts_us - min(ts_us) over (partition by user_id)) / 86400000000 as days_since_first,
    count(*) over (partition by user_id, ts_us) > 1 as duplicate_timestamp from o""")
def obs_number_gap(spark, sf):
    """W-09, W-23."""
    return W.observation_number(observations(spark, sf), K).select("event_id", "observation_number", "days_since_first", "duplicate_timestamp")


@query(f"""with {OBS}, w as (select *, lag(v) over k as prev_v, lead(v) over k as next_v, max(v) over (k rows between unbounded preceding and current row) as running_max from o window k as (partition by user_id order by ts_us, event_id)),
    t as (select user_id, min(case when running_max >= 15000 and v < 3000 then ts_us end) as transition from w group by user_id)
    select event_id, prev_v, next_v, running_max, transition, coalesce(ts_us >= transition, false) as after_transition from w join t using (user_id)""")
def neighbours_first_transition(spark, sf):
    """W-10 to W-13."""
    o = W.neighbours(observations(spark, sf), K, ["ts_us", "event_id"], ["v"])
    o = W.first_transition(o, K, "ts_us", F.col("v"), 15000, 3000, tie="event_id")
    return o.select("event_id", "prev_v", "next_v", "running_max", "transition", "after_transition")


@query(f"""with {OBS}, i as (select user_id, ts_us as s, ts_us + 7200000000 * (1 + event_id % 5) as e from o where event_type = 'purchase'),
    m as (select *, case when s <= max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from i),
    g as (select *, sum(f) over (partition by user_id order by s, e rows between unbounded preceding and current row) as k from m)
    select user_id, min(s) as s, max(e) as e from g group by user_id, k""")
def merge_intervals(spark, sf):
    """W-15, A-27."""
    i = observations(spark, sf).where("event_type = 'purchase'").select("user_id", F.col("ts_us").alias("s"), (F.col("ts_us") + 7_200_000_000 * (1 + F.col("event_id") % 5)).alias("e"))
    return W.merge_intervals(i, K, "s", "e")


@query("""with c as (select user_id, event_id, case when event_id % 5 <> 0 then event_type end as t from events), f as (select *, case when lag(t) over (partition by user_id order by event_id) = t then 0 else 1 end as n from c where t is not null),
    r as (select *, sum(n) over (partition by user_id order by event_id rows between unbounded preceding and current row) as r from f)
    select user_id, t, min(event_id) as run_start, max(event_id) as run_end, count(*) as n_rows from r group by user_id, r, t""")
def run_collapse(spark, sf):
    """W-16."""
    o = observations(spark, sf).select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("t"))
    return W.collapse_runs(o, K, ["event_id"], "t")


@query(f"""with {DAILY} select user_id, day, case when count(total) over k = 3 then sum(total) over k end as total_3 from d window k as (partition by user_id order by day rows between 2 preceding and current row)""")
def complete_window_sum(spark, sf):
    """W-17."""
    return W.complete_sum(daily(spark, sf), K, ["day"], "total", 3, "total_3").select("user_id", "day", "total_3")


@query(f"""with {DAILY} select user_id, day, case when count(total) over k = 7 then sum(case when total < 20000 then 1 else 0 end) over k end::bigint as dry_days from d window k as (partition by user_id order by day rows between 6 preceding and current row)""")
def dry_days_7(spark, sf):
    """W-18, W-19."""
    return W.dry_days(daily(spark, sf), K, "day", "total", 20000).select("user_id", "day", "dry_days")


@query("""with r as (select s_nationkey, s_suppkey, round(s_acctbal) as size, row_number() over k as n, sum(round(s_acctbal)) over (k rows between unbounded preceding and current row) as running_size from supplier where s_acctbal > 0 window k as (partition by s_nationkey order by s_acctbal desc, s_suppkey))
    select s_nationkey, s_suppkey, size, running_size from r where running_size <= 20000 or n = 1""")
def capacity_fill(spark, sf):
    """W-20."""
    from .tables import read

    s = read(spark, sf, "supplier").where("s_acctbal > 0").select("s_nationkey", "s_suppkey", F.round("s_acctbal").alias("size"), "s_acctbal")
    return W.fill_capacity(s, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], "size", 20000).select("s_nationkey", "s_suppkey", "size", "running_size")


@query("""select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as n from customer) where n <= 4""")
def topk_per_cell(spark, sf):
    """W-21, T-04."""
    from .tables import read

    return W.top_per_group(read(spark, sf, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 4).select("c_nationkey", "c_custkey")


@query("""select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as n, case c_mktsegment when 'BUILDING' then 40 when 'MACHINERY' then 30 else 20 end as q from customer) where n <= q""")
def quota_topk(spark, sf):
    """T-05."""
    from .tables import read

    quota = F.when(F.col("c_mktsegment") == "BUILDING", 40).when(F.col("c_mktsegment") == "MACHINERY", 30).otherwise(20)
    return W.top_per_group(read(spark, sf, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], quota).select("c_mktsegment", "c_custkey")


@query("""select c_custkey, greatest(1, ceil((row_number() over (order by c_acctbal, c_custkey) - 1) * 10 / (count(*) over () - 1)))::bigint as decile from customer""")
def rank_deciles(spark, sf):
    """W-25."""
    from .tables import read

    return W.deciles(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "decile")


@query("""with e as (select quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) as e from part) select p_partkey, (1 + (p_retailprice > e[1])::int + (p_retailprice > e[2])::int + (p_retailprice > e[3])::int + (p_retailprice > e[4])::int)::bigint as bin from part, e""")
def value_quintiles(spark, sf):
    """W-26."""
    from .tables import read

    return W.quantile_bins(read(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "bin")


@query("""with recursive d as (select distinct user_id, cast(ts as date) as day from events),
    k as (select user_id, min(day) as day from d group by user_id union all select k.user_id, (select min(d.day) from d where d.user_id = k.user_id and d.day >= k.day + 4) from k where k.day is not null)
    select user_id, day from k where day is not null""")
def revisit_thinning(spark, sf):
    """W-27."""
    return W.thin_dates(observations(spark, sf), K, "day", 4)


@query("""with p as (select user_id, date_diff('day', date '2024-01-01', cast(ts as date)) as x, max(round(value * 100)) as v from events group by all),
    g as (select user_id, unnest(range(0, 30, 5)) as x from (select distinct user_id from p)),
    b as (select g.user_id, g.x, max(case when p.x <= g.x then p.x end) as lx, min(case when p.x >= g.x then p.x end) as hx from g join p using (user_id) group by all),
    v as (select b.*, l.v as lv, h.v as hv from b left join p l on l.user_id = b.user_id and l.x = b.lx left join p h on h.user_id = b.user_id and h.x = b.hx)
    select user_id, x::integer as x, coalesce(lv + (hv - lv) * (x - lx) / case when hx <> lx then hx - lx end, lv, hv) as v from v""")
def curve_interpolation(spark, sf):
    """W-28."""
    from .tables import read

    e = read(spark, sf, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("x"), F.round(F.col("value") * 100).alias("v"))
    p = e.groupBy("user_id", "x").agg(F.max("v").alias("v"))
    grid = p.select("user_id").distinct().withColumn("x", F.explode(F.array(*[F.lit(x) for x in range(0, 30, 5)])))
    return W.interpolate(p, grid, K, "x", "v")


@query(f"""with {DAILY} select day, min(top) as low, sum(top) / count(top) as mean, max(top) as high from d group by day""")
def curve_envelope(spark, sf):
    """W-29."""
    return W.envelope(daily(spark, sf), ["day"], "top")


@query("""with c as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from c) where r = 1""")
def modal_class(spark, sf):
    """W-34."""
    return W.modal_class(observations(spark, sf), K, "event_type")


WEAK = """s as (
        select event_id, user_id, ts_us, (v % 100) / 100 as x, case when event_type = 'error' then 'POOR' else 'GOOD' end as q, (event_id % 10) / 10 as c from o
    ), u as (select *, coalesce(q <> 'POOR' and x is not null, false) as u from s),
    i as (select user_id, ts_us, max(case when u then {'k': event_id, 'x': x} end) as m, max(case when u and x >= 0.55 then 1 end) as hi, max(case when u and x <= 0.35 then 1 end) as lo from u group by all),
    k as (select *, max(case when m is not null then {'t': ts_us, 'x': m.x} end) over b as p, max(case when hi = 1 then ts_us end) over b as ht, max(case when lo = 1 then ts_us end) over b as lt, min(case when hi = 1 then ts_us end) over b as ft
        from i window b as (partition by user_id order by ts_us rows between unbounded preceding and 1 preceding)),
    w as (select u.*, k.p.t as pt, k.p.x as px, ht, lt, ft from u join k using (user_id, ts_us)),
    l as (select *, u and coalesce(c >= 0.5, false) and pt is not null as g, (ts_us - pt) / 86400000000 as gap, (ts_us - ht) / 86400000000 as sh from w),
    m as (select *, case when g and ht is not null and (lt is null or lt <= ht) and x <= 0.35 and sh > 0 and sh <= 75 then 'HARVESTED'
        when g and gap > 0 and gap <= 75 and ft < pt and px <= 0.30 and x - px >= 0.15 then 'SOWN' when g and gap > 0 and gap <= 75 and x >= 0.55 and abs(x - px) < 0.15 then 'STANDING' else 'UNKNOWN' end as weak_label from l)"""


@query(f"with {OBS}, {WEAK} select event_id, weak_label, case when weak_label = 'HARVESTED' then sh else gap end as evidence_window_days from m")
def weak_label_state_machine(spark, sf):
    """W-30."""
    o = observations(spark, sf).select("event_id", "user_id", "ts_us", (F.col("v") % 100 / 100).alias("x"), F.when(F.col("ok"), "GOOD").otherwise("POOR").alias("q"), (F.col("event_id") % 10 / 10).alias("c"))
    return weak_labels(o, K, "ts_us", "x", "q", "c", "event_id").select("event_id", "weak_label", "evidence_window_days")


@query(f"""with {OBS} select user_id, arg_max(event_id, (ts_us, event_id)) as event_id from o where ok and v is not null group by user_id""")
def latest_usable(spark, sf):
    """W-31, T-08."""
    o = observations(spark, sf).where("ok and v is not null")
    return o.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts_us", "event_id")).alias("event_id"))


@query("""select o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey)::bigint as place from orders""")
def priority_order(spark, sf):
    """W-32, T-01."""
    from .tables import read

    o = read(spark, sf, "orders")
    return o.select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("place"))
