"""Registered aggregation, scalar and rule queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import spectral as S
from ..functions import texts as X
from ..functions import times as T
from ..operators import aggregates as A
from ..operators import audit, rules, sampling
from .tables import DAILY, OBS, SPECTRA, daily, observations, read, spectra

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


c = F.col


@query(f"with {SPECTRA} select l_orderkey, l_linenumber, (b08 - b04) / nullif(b08 + b04, 0) as ndvi, (b8a - b12) / nullif(b8a + b12, 0) as nbr, (b11 - b12) / nullif(b11 + b12, 0) as nbr2, (b08 - b12) / nullif(b08 + b12, 0) as nbr_b08 from b")
def nd_index(spark, sf):
    """F-01 to F-03, P-01."""
    return spectra(spark, sf).select("l_orderkey", "l_linenumber", S.ndvi(c("b08"), c("b04")).alias("ndvi"), S.nbr(c("b8a"), c("b12")).alias("nbr"), S.nbr2(c("b11"), c("b12")).alias("nbr2"), S.nbr_b08(c("b08"), c("b12")).alias("nbr_b08"))


@query(f"""with {SPECTRA} select l_orderkey, l_linenumber, case when b04 <> 0 and b12 + b8a > 0 then (1 - sqrt(b06 * b07 * b8a / nullif(b04, 0))) * ((b12 - b8a) / sqrt(nullif(b12 + b8a, 0)) + 1) end as strict,
    case when b04 >= 0.005 then (1 - sqrt(greatest(b06 * b07 * b8a / greatest(b04, 0.005), 0))) * ((b12 - b8a) / sqrt(greatest(b12 + b8a, 1e-8)) + 1) end as floored,
    case when b04 > 0 then (1 - sqrt(greatest(b06 * b07 * b8a / nullif(b04, 0), 0))) * ((b12 - b8a) / sqrt(greatest(b12 + b8a, 1e-8)) + 1) end as of_means from b""")
def bais2(spark, sf):
    """F-04 to F-06."""
    b = (c("b04"), c("b06"), c("b07"), c("b8a"), c("b12"))
    return spectra(spark, sf).select("l_orderkey", "l_linenumber", S.bais2_strict(*b).alias("strict"), S.bais2_floored(*b).alias("floored"), S.bais2_of_means(*b).alias("of_means"))


HAZE = "h as (select *, n_valid / greatest(n_valid + n_cloud, 1) as vf, case when l_orderkey % 31 = 0 then null else b02 end as blue from b)"
CLASS = "case when blue is null then 'NO_DATA_EXCLUDED' when vf < 0.6 then 'CLOUD_EXCLUDED' when blue >= 0.2 then 'THICK_SMOKE_EXCLUDED' when blue >= 0.1 then 'HAZE_DOWNGRADED' else 'CLEAR' end"


@query(f"""with {SPECTRA}, {HAZE} select l_orderkey, l_linenumber, vf, {CLASS} as haze_class, {CLASS} in ('CLEAR', 'HAZE_DOWNGRADED') as usable,
    case when n_valid >= 10 and vf >= 0.5 and b04 > 0 then 'GOOD' when n_valid >= 5 and vf >= 0.25 and b04 > 0 then 'LIMITED' else 'POOR' end as quality from h""")
def haze_ladder(spark, sf):
    """P-02 to P-04, P-08, P-09, F-43."""
    h = spectra(spark, sf).withColumns({"vf": S.valid_fraction(c("n_valid"), c("n_cloud")), "blue": F.when(c("l_orderkey") % 31 != 0, c("b02"))})
    h = h.withColumn("haze_class", S.haze_class(c("blue"), c("b8a"), c("b12"), c("vf")))
    return h.select("l_orderkey", "l_linenumber", "vf", "haze_class", S.usable(c("haze_class"), c("b8a")).alias("usable"), S.product_quality(c("n_valid"), c("vf"), S.physical(c("b04"))).alias("quality"))


@query(f"""with {SPECTRA} select l_orderkey, count(b04) as n, sum(b04) / count(b04) as mean, median(b04) as median, min(b04) as low, max(b04) as high from b group by l_orderkey""")
def pixel_stats(spark, sf):
    """A-01. The population deviation has its own test: its last digit depends on the order of addition."""
    s = {x: e for x, e in zip(("mean", "median", "std", "low", "high"), A.number_stats(c("b04"), "b"), strict=True)}
    return spectra(spark, sf).groupBy("l_orderkey").agg(F.count("b04").alias("n"), *[e.alias(k) for k, e in s.items() if k != "std"])


@query(f"""with {SPECTRA}, {HAZE}, k as (select *, {CLASS} as k from h) select l_orderkey % 100 as scene, count(*) as n, count(*) filter (k = 'CLEAR') as clear, count(*) filter (k = 'HAZE_DOWNGRADED') as hazy,
    median(case when k <> 'NO_DATA_EXCLUDED' then blue end) as median_blue, round(quantile_cont(case when k <> 'NO_DATA_EXCLUDED' then blue end, 0.9), 9) as p90_blue,
    case when count(*) filter (k not in ('CLEAR', 'HAZE_DOWNGRADED')) / count(*) >= 0.5 then 'EXCLUDED' when count(*) filter (k = 'HAZE_DOWNGRADED') / count(*) >= 0.5 then 'HAZE_DOWNGRADED' else 'USABLE' end as status from k group by scene""")
def haze_audit_pivot(spark, sf):
    """A-12, P-11."""
    h = spectra(spark, sf).withColumns({"vf": S.valid_fraction(c("n_valid"), c("n_cloud")), "blue": F.when(c("l_orderkey") % 31 != 0, c("b02"))})
    h = h.withColumn("k", S.haze_class(c("blue"), c("b8a"), c("b12"), c("vf"))).withColumn("scene", c("l_orderkey") % 100)
    valid = F.when(c("k") != "NO_DATA_EXCLUDED", c("blue"))
    status = S.scene_status(A.share(~c("k").isin("CLEAR", "HAZE_DOWNGRADED")), A.share(c("k") == "HAZE_DOWNGRADED"))
    return h.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("k") == "CLEAR").alias("clear"), F.count_if(c("k") == "HAZE_DOWNGRADED").alias("hazy"), F.median(valid).alias("median_blue"), F.round(F.percentile(valid, F.lit(0.9)), 9).alias("p90_blue"), status.alias("status"))


@query("""select year(o_orderdate)::integer as year, count(*) as n, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'F' and o_totalprice > 200000) as big_f, sum(case when o_orderstatus = 'F' then round(o_totalprice)::bigint else 0 end)::bigint as f_total,
    count(*) filter (o_orderstatus = 'F') / count(*) as f_share, count(distinct o_custkey) as customers, median(round(o_totalprice)) as median_price from orders group by 1""")
def census_wide(spark, sf):
    """A-13, A-20, A-28."""
    o = read(spark, sf, "orders")
    f = c("o_orderstatus") == "F"
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(f).alias("f"), F.count_if(f & (c("o_totalprice") > 200000)).alias("big_f"), F.sum(F.when(f, F.round("o_totalprice").cast("long")).otherwise(0)).alias("f_total"), A.share(f).alias("f_share"), F.countDistinct("o_custkey").alias("customers"), F.median(F.round("o_totalprice")).alias("median_price"))


@query("""select year(o_orderdate)::integer as year, o_orderstatus as tier, count(*) as n, sum(round(o_totalprice)::bigint)::bigint as total from orders group by rollup (1, 2)""")
def tier_rollup(spark, sf):
    """A-13 at every depth."""
    o = read(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "tier": c("o_orderstatus")})
    return o.rollup("year", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("total"))


@query("""with d as (select year(o_orderdate)::integer as year, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as d from orders join lineitem on l_orderkey = o_orderkey)
    select year, median(d) as median, quantile_cont(d, 0.25) as p25, quantile_cont(d, 0.75) as p75, count(*) filter (d <= 30) / count(*) as within_30, count(*) filter (d > 60) / count(*) as beyond_60 from d group by year""")
def latency_quantiles(spark, sf):
    """A-19."""
    o, li = read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), read(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_shipdate")
    d = o.join(li, "o_orderkey").select(F.year("o_orderdate").alias("year"), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("d"))
    return d.groupBy("year").agg(F.median("d").alias("median"), *A.quantiles("d", {"p25": 0.25, "p75": 0.75}), A.share(c("d") <= 30).alias("within_30"), A.share(c("d") > 60).alias("beyond_60"))


@query("""with h as (select o_custkey, max(case when y = 1996 then h end) as a, max(case when y = 1997 then h end) as b, max(case when y = 1998 then h end) as c from (select o_custkey, year(o_orderdate) as y, (o_totalprice > 300000)::int as h from orders) group by o_custkey),
    k as (select * from h where a is not null and b is not null and c is not null), r as (select count(*) as n, avg(a) as pa, avg(b) as pb, avg(c) as pc, count(*) filter (a + b + c = 0) / count(*) as s0, count(*) filter (a + b + c = 1) / count(*) as s1, count(*) filter (a + b + c = 2) / count(*) as s2, count(*) filter (a + b + c = 3) / count(*) as s3 from k)
    select n as n_keys, s0 as share_0, s1 as share_1, s2 as share_2, s3 as share_3, pa * pb * pc as expected_all, 0 + (1 - pa) * pb * pc + (1 - pb) * pa * pc + (1 - pc) * pa * pb + pa * pb * pc as expected_all_but_one_or_more from r""")
def persistence_expected(spark, sf):
    """A-21."""
    o = read(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), (c("o_totalprice") > 300000).alias("h"))
    return A.persistence(o, "o_custkey", "y", "h", [1996, 1997, 1998])


@query(f"""with {OBS}, x as (select user_id, max(case when day between date '2024-01-01' and date '2024-01-10' then v end) as pre, median(case when day between date '2024-01-20' and date '2024-01-28' then v end) as post from o group by user_id) select *, pre - post as drop from x""")
def naive_change(spark, sf):
    """A-22."""
    return A.change_between(observations(spark, sf), "user_id", "day", "v", ("2024-01-01", "2024-01-10"), ("2024-01-20", "2024-01-28"))


@query(f"""with {OBS}, r as (select user_id, v, row_number() over (partition by user_id order by v) - 1 as r, count(*) over (partition by user_id) as n from o where v is not null)
    select user_id, max(case when r = round_even((n - 1) * 0.25, 0) then v end) as p25, max(case when r = round_even((n - 1) * 0.9, 0) then v end) as p90 from r group by user_id""")
def nearest_rank_quantile(spark, sf):
    """A-25."""
    return A.nearest_rank(observations(spark, sf), ["user_id"], "v", {"p25": 0.25, "p90": 0.9})


@query(f"""with {DAILY}, u as (select distinct user_id from events), p as (select distinct event_type from events), n as (select user_id, event_type, count(*) as n from events group by all), f as (select p.event_type, coalesce(n.n, 0) as n from u cross join p left join n using (user_id, event_type))
    select event_type, median(n) as median, min(n) as least, max(n) as most, count(*) filter (n >= 3) / count(*) as share_3, count(*) filter (n >= 5) / count(*) as share_5 from f group by event_type""")
def usable_matrix(spark, sf):
    """A-38."""
    e = read(spark, sf, "events").select("user_id", "event_type")
    return A.usable_matrix(e, e.select("user_id").distinct(), e.select("event_type").distinct(), "user_id", "event_type")


@query(f"""with {DAILY}, g as (select date_diff('day', lag(day) over (partition by user_id order by day), day) as g from d) select (g > 1)::int::bigint + (g > 2)::int + (g > 5)::int + (g > 10)::int as bin, count(*) as n,
    case when (g > 1)::int + (g > 2)::int + (g > 5)::int + (g > 10)::int is null then null else 1 end as known from g group by 1, 3""")
def gap_histogram(spark, sf):
    """A-39, W-14."""
    from pyspark.sql import Window

    g = daily(spark, sf).withColumn("g", F.datediff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day"))))
    return g.groupBy(A.histogram(c("g"), [1, 2, 5, 10]).alias("bin"), F.when(c("g").isNotNull(), 1).alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("""with l as (select doc_id // 2 as item, doc_id % 2 as reviewer, quality as label from labels), p as (select item, max(case when reviewer = 0 then label end) as a, max(case when reviewer = 1 then label end) as b from l group by item having count(*) = 2),
    t as (select count(*) as n, count(*) filter (a = b) as same, (count(*) filter (a = 0) * count(*) filter (b = 0) + count(*) filter (a = 1) * count(*) filter (b = 1))::double as ch from p)
    select n as n_items, same / n as agreement, case when ch / (n * n) < 1 then (same / n - ch / (n * n)) / (1 - ch / (n * n)) end as kappa from t""")
def kappa_consensus(spark, sf):
    """A-29."""
    l = read(spark, sf, "labels").select(F.floor(c("doc_id") / 2).alias("item"), (c("doc_id") % 2).alias("reviewer"), c("quality").alias("label"))
    return A.two_reviewer_agreement(l, "item", "reviewer", "label").select(c("n_items").cast("long").alias("n_items"), "agreement", "kappa")


@query("""with p as (select o_orderstatus as stratum, count(*) as n_population from orders group by 1), s as (select o_orderstatus as stratum, count(*) as n, count(*) filter (o_totalprice > 250000) as y from orders where o_orderkey % 50 = 0 group by 1),
    x as (select p.stratum, n_population, n, y / n as ph, n_population / (select sum(n_population) from p) as w from p left join s using (stratum)), e as (select stratum, n, w * ph as a, w * w * ph * (1 - ph) / greatest(n - 1, 1) as b, n_population * ph as h, n_population from x)
    select list_sum(list(round(a, 9) order by stratum)) as share, list_sum(list(round(h, 6) order by stratum)) as total from e""")
def stratified_estimator(spark, sf):
    """A-30. Rounded, since sums of three shares depend on their order in the last digit."""
    o = read(spark, sf, "orders").withColumnRenamed("o_orderstatus", "stratum")
    pop = o.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_population"))
    lab = o.where("o_orderkey % 50 = 0").select("stratum", F.when(c("o_totalprice") > 250000, "YES").otherwise("NO").alias("label"))
    out = A.stratified_estimate(lab, pop, "stratum", "label", "YES", "NO", ["F"])
    return out.select(F.round("share", 9).alias("share"), F.round("total", 6).alias("total"))


SCORED = "s as (select o_orderkey as id, (o_orderstatus = 'F')::int as y, (o_orderkey * 7919 % 64)::double as score from orders)"


@query(f"""with {SCORED}, g as (select score, sum(y)::bigint as p, count(*) - sum(y)::bigint as n from s group by score), r as (select *, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp from g)
    select sum(n * (tp - p + p / 2)) / ((select sum(y) from s) * (select count(*) - sum(y) from s)::double) as auc from r""")
def auc(spark, sf):
    """A-32."""
    s = read(spark, sf, "orders").select((c("o_orderstatus") == "F").cast("int").alias("y"), (c("o_orderkey") * 7919 % 64).cast("double").alias("score"))
    return A.score_metrics(s, "y", "score").select("auc")


@query(f"""with {SCORED}, t as (select y from s order by score desc, id limit (select greatest(1, round_even(count(*) * 0.1, 0))::bigint from s)) select count(*) as k, avg(y) as precision, avg(y) / (select avg(y) from s) as lift from t""")
def precision_at_k(spark, sf):
    """A-33."""
    s = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), (c("o_orderstatus") == "F").cast("int").alias("y"), (c("o_orderkey") * 7919 % 64).cast("double").alias("score"))
    return A.precision_at(s, "y", "score", 0.1, "id")


@query(f"""with x as (select o_orderkey as id, year(o_orderdate)::integer as t, (o_orderstatus = 'F')::int as y, (o_orderkey * 7919 % 64)::double as score from orders),
    r as (select *, row_number() over (partition by t order by score desc, id) as r, count(*) over (partition by t) as n from x)
    select t, sum(y)::bigint as positives, avg(y) as base, avg(case when r <= greatest(1, round_even(n * 0.1, 0)) then y end) as precision, avg(case when r <= greatest(1, round_even(n * 0.1, 0)) then y end) / avg(y) as lift from r group by t having sum(y) >= 20""")
def lift_per_pass(spark, sf):
    """A-34, T-04."""
    s = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.year("o_orderdate").alias("t"), (c("o_orderstatus") == "F").cast("int").alias("y"), (c("o_orderkey") * 7919 % 64).cast("double").alias("score"))
    return A.lift_per_group(s, "t", "y", "score", "id")


@query("""with x as (select case when quality = 1 then 'good' else 'bad' end as truth, case when doc_id % 3 = 0 then 'bad' else 'good' end as pred from labels), k as (select unnest(['good', 'bad']) as label),
    m as (select label, count(*) filter (truth = label) as support, count(*) filter (pred = label) as claimed, count(*) filter (truth = label and pred = label) as tp from k, x group by label)
    select label, support, tp / claimed as precision, tp / support as recall, 2 * (tp / claimed) * (tp / support) / (tp / claimed + tp / support) as f1 from m""")
def class_metrics(spark, sf):
    """A-31."""
    x = read(spark, sf, "labels").select(F.when(c("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(c("doc_id") % 3 == 0, "bad").otherwise("good").alias("pred"))
    return A.class_metrics(x, "truth", "pred")


@query("""select 'o_custkey' as column, count(*) as n_rows, count(*) filter (o_custkey is null) as n_missing, count(*) filter (o_custkey is null) / count(*) as rate from orders union all
    select 'late', count(*), count(*) filter (o_orderdate >= timestamp '2000-01-01'), count(*) filter (o_orderdate >= timestamp '2000-01-01') / count(*) from orders""")
def null_rates(spark, sf):
    """A-24."""
    o = read(spark, sf, "orders").withColumn("late", F.when(c("o_orderdate") < F.expr("timestamp_ntz'2000-01-01'"), 1))
    return A.null_rates(o, ["o_custkey", "late"])


@query("""select s_nationkey, array_to_string(list_sort(list(distinct case when s_acctbal < 0 then 'debt' when s_acctbal < 5000 then 'mid' else 'top' end)), ', ') as kinds, count(distinct case when s_acctbal < 0 then 1 when s_acctbal < 5000 then 2 else 3 end) as n from supplier group by s_nationkey""")
def sorted_sources(spark, sf):
    """A-40, A-41."""
    kind = F.when(c("s_acctbal") < 0, "debt").when(c("s_acctbal") < 5000, "mid").otherwise("top")
    return read(spark, sf, "supplier").groupBy("s_nationkey").agg(X.sorted_set(kind).alias("kinds"), F.countDistinct(kind).alias("n"))


@query("""with p as (select cast(o_orderdate as date) as d, o_orderpriority as p from orders where o_orderdate < timestamp '1995-03-01') select d, count(*) filter (p = '1-URGENT') as urgent, count(*) filter (p = '5-LOW') as low from p group by d""")
def pivot_counts(spark, sf):
    """A-23."""
    o = read(spark, sf, "orders").where(c("o_orderdate") < F.expr("timestamp_ntz'1995-03-01'")).select(F.to_date("o_orderdate").alias("d"), "o_orderpriority")
    out = o.groupBy("d").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return out.select("d", *[F.coalesce(F.col(k), F.lit(0).cast("long")).alias(n) for k, n in (("1-URGENT", "urgent"), ("5-LOW", "low"))])


RULE = "r as (select l_orderkey, l_linenumber, case when l_orderkey % 23 <> 0 then b08 end as v, b04 - 0.4 as dv, -b06 as drop, b07 - 0.5 as nd, b11 - 0.3 as bd, l_orderkey % 3 = 0 as fire from b)"


@query(f"""with {SPECTRA}, {RULE}, s as (select *, coalesce(drop <= -0.25, false) or coalesce(dv <= -0.2, false) as f, nd <= -0.15 as n, bd >= 0.1 as b from r)
    select l_orderkey, l_linenumber, case when v is null then null when f and n and b then 'BURNT' when f then 'HARVESTED' when dv >= 0.12 and v >= 0.3 then 'SOWN' when v >= 0.55 and dv > -0.15 then 'STANDING' end as status,
    case when v is not null and f and n then 'MODERATE' else 'LOW' end as band from s""")
def status_rules(spark, sf):
    """G-01."""
    r = spectra(spark, sf).select("l_orderkey", "l_linenumber", F.when(c("l_orderkey") % 23 != 0, c("b08")).alias("v"), (c("b04") - 0.4).alias("dv"), (-c("b06")).alias("drop"), (c("b07") - 0.5).alias("nd"), (c("b11") - 0.3).alias("bd"))
    status, band = rules.status_and_band(c("v"), c("dv"), c("drop"), c("nd"), c("bd"))
    return r.select("l_orderkey", "l_linenumber", status.alias("status"), band.alias("band"))


@query("""with x as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'HARVESTED' else 'STANDING' end as st, case when l_linestatus = 'F' then 'MODERATE' else 'LOW' end as band, l_quantity - 5 as area, case when l_linenumber < 5 then l_discount * 10 end as peak from lineitem),
    y as (select *, st = 'HARVESTED' and band = 'MODERATE' as ok, case when peak is null then 1.0::double else least(greatest(1 + 0.25::double * (peak - 0.75::double), 0.85::double), 1.1::double) end as f from x)
    select l_orderkey, l_linenumber, case when ok and area > 0 then 'PRELIMINARY_ESTIMATE' when ok then 'INSUFFICIENT_INPUT' else 'NOT_ELIGIBLE' end as state, case when ok and area > 0 then area * 6.0::double * f end as estimate_t from y""")
def straw_estimate(spark, sf):
    """G-02, F-14."""
    li = read(spark, sf, "lineitem")
    s = rules.straw_estimate(F.when(c("l_returnflag") == "R", "HARVESTED").otherwise("STANDING"), F.when(c("l_linestatus") == "F", "MODERATE").otherwise("LOW"), c("l_quantity") - 5, F.when(c("l_linenumber") < 5, c("l_discount") * 10))
    return li.select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.state", "s.estimate_t")


@query("""with x as (select l_orderkey, l_linenumber, case when l_linenumber <> 1 then least(greatest((l_quantity - 10) / 10, 0), 1) end as a, case when l_partkey % 4 <> 0 then least(greatest(1 - l_quantity / 12, 0), 1) end as b, case when l_suppkey % 3 <> 0 then least(greatest((100 - l_quantity) / 100, 0), 1) end as h from lineitem),
    w as (select *, 0 + case when a is null then 0 else 0.25 end + case when b is null then 0 else 0.2 end + case when h is null then 0 else 0.1 end as w, 0 + case when a is null then 0 else a * 0.25 end + case when b is null then 0 else b * 0.2 end + case when h is null then 0 else h * 0.1 end as s from x), r as (select *, case when w > 0 then s::double / w::double end as score from w)
    select l_orderkey, l_linenumber, round(score, 9) as score, case when score is null then 'INSUFFICIENT_DATA' when round(score, 9) < 0.25 then 'LOW' when round(score, 9) < 0.5 then 'MEDIUM' when round(score, 9) < 0.75 then 'HIGH' else 'CRITICAL' end as level from r""")
def risk_score_renormalised(spark, sf):
    """G-03, T-06."""
    li = read(spark, sf, "lineitem")
    parts = {"time_pressure": F.when(c("l_linenumber") != 1, N.clip((c("l_quantity") - 10) / 10, 0, 1)), "dry_weather": F.when(c("l_partkey") % 4 != 0, N.clip(1 - c("l_quantity") / 12, 0, 1)), "low_humidity": F.when(c("l_suppkey") % 3 != 0, N.clip((100 - c("l_quantity")) / 100, 0, 1))}
    s = li.select("l_orderkey", "l_linenumber", F.round(rules.risk_total(parts), 9).alias("score"))
    return s.select("l_orderkey", "l_linenumber", "score", rules.risk_level(c("score")).alias("level"))


@query("""with x as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'HARVESTED' when l_returnflag = 'A' then 'STANDING' end as st, case when l_linestatus = 'F' then 'HIGH' else 'LOW' end as conf, l_quantity - 3 as straw, case when l_partkey % 5 = 0 then 'POOR' else 'GOOD' end as q, case when l_suppkey % 4 = 0 then 'UNSUITABLE' when l_suppkey % 4 = 1 then 'UNKNOWN' else 'SUITABLE' end as w from lineitem),
    y as (select l_orderkey, l_linenumber, list_filter([case when not coalesce(st = 'HARVESTED' and conf = 'HIGH', false) then 'HARVEST_EVIDENCE_INSUFFICIENT' end, case when straw <= 0 then 'NO_POSITIVE_STRAW_ESTIMATE' end, case when q <> 'GOOD' then 'OBSERVATION_QUALITY_UNACCEPTABLE' end, case when w = 'UNSUITABLE' then 'WEATHER_UNSUITABLE' end], lambda r: r is not null) as r, w = 'UNKNOWN' as u from x)
    select l_orderkey, l_linenumber, len(r) = 0 as eligible, array_to_string(r, '|') as reasons, case when u then 'WEATHER_UNKNOWN' else '' end as warnings from y""")
def eligibility_reasons(spark, sf):
    """G-08, F-32."""
    li = read(spark, sf, "lineitem")
    e = rules.eligibility(F.lit(1.0), F.lit(1.0), F.when(c("l_returnflag") == "R", "HARVESTED").when(c("l_returnflag") == "A", "STANDING"), F.lit("SUPPORTED"), F.when(c("l_linestatus") == "F", "HIGH").otherwise("LOW"), F.lit("RULE"), c("l_quantity") - 3, F.when(c("l_partkey") % 5 == 0, "POOR").otherwise("GOOD"), F.when(c("l_suppkey") % 4 == 0, "UNSUITABLE").when(c("l_suppkey") % 4 == 1, "UNKNOWN").otherwise("SUITABLE"), F.lit(0.5))
    return li.select("l_orderkey", "l_linenumber", e.alias("e")).select("l_orderkey", "l_linenumber", "e.eligible", F.array_join("e.reasons", "|").alias("reasons"), F.array_join("e.warnings", "|").alias("warnings"))


@query(f"""with {SPECTRA}, x as (select l_orderkey, case when l_linenumber = 7 then 'POOR' else 'GOOD' end as q, b04 - 0.4 as n, b06 - 0.6 as b, b07 - 0.3 as v, false as fire, l_linenumber as day from b),
    y as (select *, (n <= -0.2)::int + (b >= 0.12)::int + (v <= -0.2)::int as s, (n <= -0.15)::int + (b >= 0.1)::int + (v <= -0.15)::int as m from x), e as (select *, case when q <> 'GOOD' then 'UNCLEAR' when s = 3 then 'STRONG' when m >= 2 then 'MODERATE' when m = 0 then 'NO_BURN' else 'UNCLEAR' end as e from y),
    g as (select l_orderkey, count(*) as n, count(*) filter (e = 'STRONG') as strong, count(*) filter (e in ('MODERATE', 'UNCLEAR')) as doubtful, max(day) - min(day) as span from e group by l_orderkey)
    select l_orderkey, n, strong, doubtful, case when strong > 0 then 'BURN_SIGNAL_DETECTED' when doubtful > 0 then 'MANUAL_REVIEW_REQUIRED' when n >= 2 and span >= 1 and l_orderkey % 2 = 0 then 'NO_BURN_VERIFIED' when l_orderkey % 2 = 0 then 'INSUFFICIENT_EVIDENCE' else 'MONITORING' end as state from g""")
def verification_eval(spark, sf):
    """G-09, G-10, W-33."""
    e = rules.burn_evidence(F.when(c("l_linenumber") == 7, "POOR").otherwise("GOOD"), c("b04") - 0.4, c("b06") - 0.6, c("b07") - 0.3, F.lit(False))
    g = spectra(spark, sf).withColumn("e", e).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("e") == "STRONG").alias("strong"), F.count_if(c("e").isin("MODERATE", "UNCLEAR")).alias("doubtful"), (F.max("l_linenumber") - F.min("l_linenumber")).alias("span"))
    return g.select("l_orderkey", "n", "strong", "doubtful", rules.case_state(c("n"), c("strong"), c("doubtful"), c("span"), F.lit(False), c("l_orderkey") % 2 == 0, least=2, least_span=1).alias("state"))


MOVES = [("view", "click"), ("click", "purchase"), ("signup", "view")]


@query("""with m as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as from_state from events) select user_id, event_id, from_state, event_type, (from_state, event_type) in (('view', 'click'), ('click', 'purchase'), ('signup', 'view')) as allowed from m where from_state is not null""")
def job_transition_audit(spark, sf):
    """X-03."""
    e = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return audit.transition_audit(e, "user_id", ["event_id"], "event_type", MOVES)


@query("""with k as (select user_id, event_type, count(*) as n from events group by all), m as (select user_id, event_type as stratum from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from k) where r = 1),
    r as (select *, row_number() over (partition by stratum order by md5(user_id::varchar || ':0'), user_id) as r, count(*) over (partition by stratum) as n from m)
    select user_id, stratum, case when r <= floor(n * 0.6::double) then 'train' when r <= floor(n * 0.6::double) + floor(n * 0.2::double) then 'validation' else 'test' end as split from r""")
def field_group_split(spark, sf):
    """V-06."""
    return audit.grouped_split(read(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type")


@query("""select count(*) as n_rows, count(*) filter (o_custkey is null) as missing_o_custkey, count(*) filter (not o_totalprice between 1000 and 400000) as range_o_totalprice, count(*) filter (o_custkey > o_orderkey) as leak_o_custkey,
    coalesce((select sum(n)::bigint from (select count(*) as n from orders group by o_custkey having count(*) > 1)), 0) as repeated_keys from orders""")
def dataset_audit(spark, sf):
    """V-01."""
    return audit.dataset_audit(read(spark, sf, "orders"), ["o_custkey"], ["o_custkey"], {"o_totalprice": (1000, 400000)}, [("o_custkey", "o_orderkey")])


@query("""select 'priced' as gate, count(*) filter (not o_totalprice > 0) as failures, count(*) filter (not o_totalprice > 0) = 0 as passed from orders union all select 'recent', count(*) filter (not o_orderdate >= timestamp '1996-01-01'), count(*) filter (not o_orderdate >= timestamp '1996-01-01') = 0 from orders""")
def data_gates(spark, sf):
    """V-05."""
    return audit.gates(read(spark, sf, "orders"), {"priced": c("o_totalprice") > 0, "recent": c("o_orderdate") >= F.expr("timestamp_ntz'1996-01-01'")})


@query("""select o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by md5(o_orderkey::varchar || ':7'), o_orderkey) as r from orders) where r <= 80""")
def stratified_sample(spark, sf):
    """B-14."""
    return sampling.stratified_sample(read(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 80, 7).select("o_orderstatus", "o_orderkey")


@query("""select o_orderkey from orders where ('0x' || substr(md5(o_orderkey::varchar || ':1'), 1, 8))::bigint < 429496729""")
def hash_sample(spark, sf):
    """B-11."""
    return sampling.hash_share(read(spark, sf, "orders"), "o_orderkey", 0.1, 1).select("o_orderkey")


@query("""select event_id, (props::json ->> '$.k')::bigint as k, json_extract_string(props, '$.none') as absent from events""")
def json_extract_feature(spark, sf):
    """F-36, D-20."""
    return read(spark, sf, "events").select("event_id", X.nested(c("props"), "$.k").cast("long").alias("k"), X.nested(c("props"), "$.none").alias("absent"))


@query("""select event_id, (hour(ts) * 100 + minute(ts))::bigint as hhmm, ((hour(ts) + minute(ts) / 60) + 5.5) % 24 as local_hour, dayofyear(ts)::integer as doy, case when (hour(ts) * 60 + minute(ts)) >= 1320 or (hour(ts) * 60 + minute(ts)) <= 300 then true else false end as night, last_day(ts) + 1 as month_end from events""")
def time_functions(spark, sf):
    """F-15 to F-20."""
    hhmm = (F.hour("ts") * 100 + F.minute("ts")).cast("long")
    night = T.within_clock(F.hour("ts") * 60 + F.minute("ts"), T.minutes(F.lit("22:00")), T.minutes(F.lit("05:00")))
    return read(spark, sf, "events").select("event_id", hhmm.alias("hhmm"), T.local_hour(hhmm).alias("local_hour"), F.dayofyear("ts").alias("doy"), night.alias("night"), T.period_end(F.to_date("ts"), "month").alias("month_end"))


@query("""select s_suppkey, sha256('{"a":"' || s_name || '","b":"' || s_nationkey || '"}') as h, case when s_acctbal < 0 then 'in debt; ' || s_name else s_name end as text from supplier""")
def canonical_hash(spark, sf):
    """F-31, F-34."""
    text = F.concat_ws("; ", F.when(c("s_acctbal") < 0, "in debt"), c("s_name"))
    return read(spark, sf, "supplier").select("s_suppkey", X.canonical_hash({"b": c("s_nationkey").cast("string"), "a": c("s_name")}).alias("h"), text.alias("text"))


@query("""select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 100""")
def watchlist(spark, sf):
    """T-02, T-03."""
    from .payloads import watchlist as top

    return top(read(spark, sf, "orders"), "o_totalprice", "o_orderkey", 100).select("o_orderkey")


@query("""select p_partkey, p_name from part where p_name like '%red%' and p_brand = 'Brand#17'""")
def text_search(spark, sf):
    """P-13 to P-18, S-26."""
    from .payloads import search

    return search(read(spark, sf, "part"), "RED", ("p_name",), {"p_brand": "Brand#17"}).select("p_partkey", "p_name")
