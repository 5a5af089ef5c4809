"""Registered queries of sources, sinks, radar and weather measures, and the remaining rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import spectral as S
from ..functions import texts as X
from ..operators import aggregates as A
from ..operators import audit, joins, rules, sampling
from ..operators import windows as W
from ..sources import readers as R
from ..sources import sinks
from . import panels
from .tables import OBS, SPECTRA, observations, read, spectra

QUERIES, SQL = {}, {}
c = F.col


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select l_suppkey % 7 as k, (l_orderkey // 4) as row, (l_partkey // 4) as col, sum(l_quantity) / count(l_quantity) as v from lineitem group by all""")
def block_average(spark, sf):
    """S-07."""
    px = read(spark, sf, "lineitem").select((c("l_suppkey") % 7).alias("k"), c("l_orderkey").alias("row"), c("l_partkey").alias("col"), c("l_quantity").alias("v"))
    return R.block_average(px, ["k"], "row", "col", 4, ["v"])


@query("""select o_orderdate::date as sensed, max(o_orderkey) as item from orders where o_totalprice / 5000 <= 90 group by 1""")
def latest_processing(spark, sf):
    """S-09."""
    o = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("sensed"), c("o_orderkey").alias("item"), (c("o_totalprice") / 5000).alias("cloud"))
    return R.latest_processing(o, "sensed", "item", "cloud").select("sensed", "item")


@query("""select d, p, o_orderkey from (select o_orderdate::date as d, o_orderpriority as p, o_orderkey, row_number() over (partition by o_orderdate::date, o_orderpriority order by case when o_orderkey % 5 <> 0 then o_totalprice end nulls last, o_orderkey) as n from orders) where n = 1""")
def clearest_scene(spark, sf):
    """W-22, S-08."""
    o = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), c("o_orderpriority").alias("p"), "o_orderkey", F.when(c("o_orderkey") % 5 != 0, c("o_totalprice")).alias("cloud"))
    return R.clearest(o, ["d", "p"], "cloud", "o_orderkey").select("d", "p", "o_orderkey")


@query("""with m as (select date_trunc('month', o_orderdate)::date as month, min(o_orderdate::date) as f, max(o_orderdate::date) as l from orders group by 1)
    select month, (f + k::integer)::date as start, least(f + k::integer + 4, l)::date as "end" from m, range(0, 31, 5) t(k) where f + k::integer <= l""")
def request_chunks(spark, sf):
    """S-10: requests for the days that each month holds."""
    months = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).groupBy(F.trunc("d", "month").alias("month")).agg(F.min("d").alias("f"), F.max("d").alias("l"))
    return R.request_chunks(months, "f", "l").select("month", "start", "end")


@query("""select s_suppkey, i::integer as i, case when i <= 3 then s_nationkey * i end as a, case when i <= 2 then s_suppkey + i end as b from supplier, range(1, 4) t(i)""")
def parallel_arrays(spark, sf):
    """S-12."""
    s = read(spark, sf, "supplier")
    s = s.select("s_suppkey", F.array(*[F.lit(k) for k in (1, 2, 3)]).alias("i"), F.array(*[(c("s_nationkey") * k).cast("long") for k in (1, 2, 3)]).alias("a"), F.array(*[c("s_suppkey") + k for k in (1, 2)]).alias("b"))
    return R.parallel_arrays(s, ["s_suppkey"], ["i", "a", "b"])


@query(f"with {SPECTRA} select l_orderkey, l_linenumber, case when l_linenumber not in (3, 6) then (n_valid * 100) * 1e-4 end as masked, (n_valid * 100 - case when n_cloud >= 4.0 then 1000 else 0 end) / 10000 as harmonised from b")
def masked_reflectance(spark, sf):
    """S-15, F-11."""
    b = spectra(spark, sf)
    return b.select("l_orderkey", "l_linenumber", S.masked_reflectance(c("n_valid") * 100, c("l_linenumber"), (3, 6)).alias("masked"), S.reflectance(c("n_valid") * 100, c("n_cloud")).alias("harmonised"))


@query("""select o_orderkey, case when o_orderstatus = 'F' then case when k < 30 then 'low' when k < 80 then 'nominal' when k <= 100 then 'high' end else case o_orderkey % 3 when 0 then 'low' when 1 then 'nominal' else 'high' end end as k from (select *, o_orderkey % 101 as k from orders)""")
def confidence_classes(spark, sf):
    """F-21, S-11, S-18."""
    raw = F.when(c("o_orderstatus") == "F", (c("o_orderkey") % 101).cast("string")).when(c("o_orderkey") % 3 == 0, "l").when(c("o_orderkey") % 3 == 1, "N").otherwise("h")
    return read(spark, sf, "orders").select("o_orderkey", R.confidence_class(F.when(c("o_orderstatus") == "F", "MODIS").otherwise("S-NPP"), raw).alias("k"))


@query("""select o_orderkey, (make_date(1996, 1, 1) + (o_orderkey % 366)::integer)::date as burn_date from orders where o_orderkey % 366 + 1 between 250 and 330""")
def burned_pixels(spark, sf):
    """S-19, F-18."""
    o = read(spark, sf, "orders").select("o_orderkey", (c("o_orderkey") % 366 + 1).alias("doy"), F.lit(1996).alias("y"))
    return R.burned_pixels(o, "doy", "y", 250, 330).select("o_orderkey", "burn_date")


@query("""select o_orderkey, case when o_orderdate::date between date '1996-09-01' and date '1996-12-31' then 1996 when o_orderdate::date between date '1997-09-01' and date '1997-12-31' then 1997 end as season from orders where season is not null""")
def season_listing(spark, sf):
    """S-05, S-27."""
    o = read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return R.in_season(o, "d", {1996: ("1996-09-01", "1996-12-31"), 1997: ("1997-09-01", "1997-12-31")}).select("o_orderkey", "season")


@query("""with b as (select c_nationkey, 70 + min(c_custkey % 1000) / 100 as west, 75 + max(c_custkey % 700) / 100 as east, 28 + min(c_custkey % 300) / 100 as south, 29 + max(c_custkey % 200) / 100 as north from customer group by 1)
    select c_nationkey, x * 0.25::double as longitude, y * 0.25::double as latitude from b, range(270, 340) s(x), range(100, 140) t(y) where x * 0.25 + 0.125 >= west and x * 0.25 - 0.125 <= east and y * 0.25 + 0.125 >= south and y * 0.25 - 0.125 <= north""")
def grid_nodes(spark, sf):
    """S-25: the nodes around each nation's customers."""
    low, high = (lambda m, f=f: f(c("c_custkey") % m) / 100 for f in (F.min, F.max))
    boxes = read(spark, sf, "customer").groupBy("c_nationkey").agg((70 + low(1000)).alias("west"), (75 + high(700)).alias("east"), (28 + low(300)).alias("south"), (29 + high(200)).alias("north"))
    return R.grid_nodes(boxes, 0.25).select("c_nationkey", "longitude", "latitude")


ITEM = "'S1' || case when s_suppkey % 2 = 0 then 'A' else 'C' end || '_IW_GRDH_1SDV_202509' || lpad((1 + s_suppkey % 20)::varchar, 2, '0') || 'T0100' || lpad((s_suppkey % 50)::varchar, 2, '0') || '_202509' || lpad((1 + s_suppkey % 20)::varchar, 2, '0') || 'T0102' || lpad((s_suppkey % 50)::varchar, 2, '0')"


@query(f"""with i as (select {ITEM} as item from supplier where s_suppkey % 9 <> 0) select substr(item, 1, 3) as platform, substr(item, 5, 2) as mode, strptime(substr(item, 18, 8), '%Y%m%d')::date as day, count(*) as slices, second(min(strptime(substr(item, 18, 15), '%Y%m%dT%H%M%S')))::integer as first_second, second(max(strptime(substr(item, 34, 15), '%Y%m%dT%H%M%S')))::integer as last_second from i group by 1, 2, 3""")
def pass_metadata(spark, sf):
    """S-14, S-24, F-33."""
    s = read(spark, sf, "supplier")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day, second = two(1 + c("s_suppkey") % 20), two(c("s_suppkey") % 50)
    item = F.concat(F.lit("S1"), F.when(c("s_suppkey") % 2 == 0, "A").otherwise("C"), F.lit("_IW_GRDH_1SDV_202509"), day, F.lit("T0100"), second, F.lit("_202509"), day, F.lit("T0102"), second)
    out = R.pass_metadata(s.select(F.when(c("s_suppkey") % 9 == 0, "other").otherwise(item).alias("item")), "item")
    return out.select("platform", "mode", "day", "slices", F.second("start").alias("first_second"), F.second("end").alias("last_second"))


@query(f"""with {SPECTRA} select l_orderkey % 50 as zone, count(*) as n, count(*) filter (b08 >= 0.1) as usable, case when count(*) filter (b04 >= 0.1) >= 3 then sum(case when b04 >= 0.1 then b04 end) / count(*) filter (b04 >= 0.1) end as b04,
    count(*) filter (b8a < 0.12 and b12 < 0.14 and b07 < 0) / count(*) as char_frac, count(*) filter (b06 >= 0.5) / count(*) as green_frac, case when count(*) filter (n_valid > 0) > 0 then count(*) filter (n_valid > 0 and n_cloud = 4) / count(*) filter (n_valid > 0) end as class_frac from b group by 1""")
def zonal_stats(spark, sf):
    """A-03 to A-05, A-44, F-10."""
    b = spectra(spark, sf).withColumn("zone", c("l_orderkey") % 50)
    char = S.char_pixel(c("b8a"), c("b12"), c("b07"))
    return b.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("b08") >= 0.1).alias("usable"), A.zonal_mean(c("b04"), c("b04") >= 0.1, 3).alias("b04"), A.zonal_share(char).alias("char_frac"), A.zonal_share(S.green_pixel(c("b06"))).alias("green_frac"), A.zonal_share(c("n_cloud") == 4, c("n_valid") > 0).alias("class_frac"))


@query("""with x as (select l_orderkey as f, l_linenumber as d, -20 + (l_partkey % 16) as db from lineitem), g as (select f, case when count(db) >= 2 then 10 * log10(avg(power(10, db / 10))) end as m, min(case when d between 1 and 3 then db end) as low, sum(case when d between 4 and 7 then db end) / count(case when d between 4 and 7 then db end) as canopy from x group by f)
    select f, round(m, 6) as mean_db, low, canopy, coalesce(low <= -18 and canopy - low >= 4, false) as paddy from g""")
def radar_season(spark, sf):
    """A-06 to A-08, A-46, F-12, G-11, G-12. Means of powers are rounded: their last digits depend on order."""
    li = read(spark, sf, "lineitem").select(c("l_orderkey").alias("f"), c("l_linenumber").alias("d"), (F.lit(-20) + c("l_partkey") % 16).alias("db"))
    low, canopy = A.season_low_and_canopy(c("d"), c("db"), (1, 3), (4, 7))
    g = li.groupBy("f").agg(F.round(A.db_mean(c("db"), 2), 6).alias("mean_db"), low.alias("low"), canopy.alias("canopy"))
    return g.withColumn("paddy", rules.paddy(c("low"), c("canopy")))


@query(f"""with {OBS}, h as (select user_id % 5 as node, day, count(*) as n, count(v) as k, sum(v) as s from o group by 1, 2) select node, day, n as n_hours, case when k = 24 then s end as v from h""")
def complete_days(spark, sf):
    """A-14."""
    o = observations(spark, sf).withColumn("node", c("user_id") % 5).withColumn("at", c("day").cast("timestamp_ntz"))
    return A.complete_day(o, ["node"], "at", "v", []).select("node", "day", "n_hours", "v")


@query(f"""with {OBS} select day, count(*) filter (ok) / count(*) as clear_share, count(*) filter (v is not null) / count(*) as usable_share, median(v) as median_blue from o group by day""")
def visibility(spark, sf):
    """A-18."""
    o = observations(spark, sf).select(c("day").alias("date"), c("ok").alias("clear"), c("v").isNotNull().alias("usable"), c("v").alias("B02"))
    return panels.visibility(o).withColumnRenamed("date", "day")


@query("""select s_suppkey, '{"s_suppkey":' || s_suppkey || ',"n":' || case when s_suppkey % 3 = 0 then 'null' else s_nationkey::varchar end || '}' as json from supplier""")
def strict_json(spark, sf):
    """K-03."""
    s = read(spark, sf, "supplier").select("s_suppkey", F.when(c("s_suppkey") % 3 != 0, c("s_nationkey")).alias("n"))
    return sinks.strict_json(s).select(F.get_json_object("json", "$.s_suppkey").cast("long").alias("s_suppkey"), "json")


@query("""select s_suppkey, s_acctbal from supplier where s_suppkey % 4 <> 0 union all select s_suppkey, s_acctbal + 1 from supplier where s_suppkey % 4 = 0""")
def manifest_upsert(spark, sf):
    """K-08, U-04."""
    s = read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return sinks.upsert(s, s.where("s_suppkey % 4 = 0").withColumn("s_acctbal", c("s_acctbal") + 1), ["s_suppkey"])


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 200000 then 'STRICT' when o_orderstatus = 'F' then 'LOOSE' else 'NONE' end as tier from orders""")
def tier_products(spark, sf):
    """K-06, F-45."""
    o = read(spark, sf, "orders").withColumns({"burned": c("o_orderstatus") == "F", "burned_strict": (c("o_orderstatus") == "F") & (c("o_totalprice") > 200000)})
    return sinks.tier_products(o, ["o_orderkey"])


@query("""select o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_custkey as split_group from orders""")
def training_contract(spark, sf):
    """K-09."""
    return sinks.training_contract(read(spark, sf, "orders"), ["o_orderkey", "o_custkey"], ["o_totalprice", "o_custkey"], ["o_orderstatus"], ["o_orderkey"], "o_custkey")


@query("""with x as (select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'SOWN' when l_linenumber = 2 then 'UNKNOWN' end as a, l_returnflag as d, l_partkey % 3 as dd, l_linestatus as i, l_suppkey % 3 as id from lineitem)
    select l_orderkey, l_linenumber, coalesce(case when a <> 'UNKNOWN' then a end, case when d = i and dd = id then d end) as agreed from x""")
def candidate_agreement(spark, sf):
    """G-06."""
    li = read(spark, sf, "lineitem")
    label = F.when(c("l_linenumber") == 1, "SOWN").when(c("l_linenumber") == 2, "UNKNOWN")
    return li.select("l_orderkey", "l_linenumber", rules.agreed_candidate(label, c("l_returnflag"), c("l_partkey") % 3, c("l_linestatus"), c("l_suppkey") % 3).alias("agreed"))


@query("""with g as (select o_custkey, count(*) as n, bool_or(o_orderstatus = 'F') as h, bool_or(o_orderstatus = 'P') as b, max(gap) as gap from (select *, date_diff('day', lag(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate::date) as gap from orders) group by o_custkey)
    select o_custkey, case when n < 3 then 'E' when h and b and gap <= 400 then 'A' when h and b then 'B' when h then 'C' else 'D' end as g from g""".replace("<= 400", "<= 14"))
def suitability_groups(spark, sf):
    """G-07."""
    from pyspark.sql import Window

    o = read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    o = o.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))))
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(c("o_orderstatus") == "F").alias("h"), F.bool_or(c("o_orderstatus") == "P").alias("b"), F.max("gap").alias("gap"))
    return g.select("o_custkey", rules.suitability_group(c("n"), c("h"), c("b"), c("gap")).alias("g"))


@query("""select o_orderkey, coalesce(o_orderdate <= timestamp '1998-01-01', false) as admissible, o_orderstatus = 'F' as may_decide, o_orderstatus = 'F' and o_custkey >= 1 as certifiable from orders""")
def trust_gates(spark, sf):
    """G-04, G-14, G-15."""
    o = read(spark, sf, "orders")
    trust = F.when(c("o_orderstatus") == "F", "VALIDATED_MODEL").otherwise("SYNTHETIC_TEST_MODEL")
    state = F.when(c("o_orderstatus") == "F", "NO_BURN_VERIFIED").otherwise("MONITORING")
    return o.select("o_orderkey", rules.forecast_admissible(c("o_orderdate"), F.expr("timestamp_ntz'1998-01-01'")).alias("admissible"), rules.may_decide(trust).alias("may_decide"), rules.certifiable(state, c("o_custkey")).alias("certifiable"))


@query("""select o_orderkey, (o_orderkey % 30)::double as fifo, round((o_orderkey * 7919 % 100) / 100 * (1 + (o_orderkey % 30) / 10), 9) as urgency, case when o_orderstatus = 'F' then 1000 - coalesce(case when o_orderkey % 4 <> 0 then (o_orderkey % 9)::double end, 999) else (o_orderkey % 30) * 1e-3 end as oracle from orders""")
def policy_priorities(spark, sf):
    """G-13."""
    age, score = (c("o_orderkey") % 30).cast("double"), c("o_orderkey") * 7919 % 100 / 100
    left = F.when(c("o_orderkey") % 4 != 0, (c("o_orderkey") % 9).cast("double"))
    p = lambda k: rules.policy_priority(k, age, F.lit(1.0), score, F.lit(None).cast("double"), c("o_orderstatus") == "F", left)
    return read(spark, sf, "orders").select("o_orderkey", p("fifo").alias("fifo"), F.round(p("risk_urgency"), 9).alias("urgency"), p("oracle").alias("oracle"))


@query("""with l as (select doc_id, quality as label, case when doc_id % 4 = 0 then null else 'S' || doc_id % 3 end as source, case when doc_id % 5 = 0 then 'C' else 'A' end as tier from labels),
    e as (select doc_id, list_filter([case when not coalesce(label = 1, false) then 'LABEL_UNKNOWN' end, case when not coalesce(source in ('S1', 'S2'), false) then 'SOURCE_UNKNOWN' end, case when coalesce(source in ('S1', 'S2'), false) and not ((source = 'S1' and tier = 'A') or (source = 'S2' and tier in ('A', 'C'))) then 'TIER_NOT_OF_SOURCE' end], lambda x: x is not null) as e from l)
    select doc_id, array_to_string(e, '|') as errors from e""")
def label_validation(spark, sf):
    """V-02, V-04."""
    l = read(spark, sf, "labels")
    source, tier = F.when(c("doc_id") % 4 != 0, F.concat(F.lit("S"), c("doc_id") % 3)), F.when(c("doc_id") % 5 == 0, "C").otherwise("A")
    e = audit.label_errors(c("doc_id").cast("string"), F.lit(1), c("quality"), source, tier, (1,), {"S1": ("A",), "S2": ("A", "C")})
    return l.select("doc_id", F.array_join(e, "|").alias("errors"))


@query("""select o_custkey, 'REPEATED_IN_FILE' as conflict from orders group by o_custkey having count(*) > 1 union all select distinct o_custkey, 'ALREADY_KNOWN' from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)""")
def import_conflicts(spark, sf):
    """V-03."""
    new = read(spark, sf, "orders").select("o_custkey")
    known = read(spark, sf, "customer").where("c_nationkey = 3").select(c("c_custkey").alias("o_custkey"))
    return audit.import_conflicts(new, known, ["o_custkey"])


@query("""select item, case when count(distinct label) = 1 then min(label) else 'DISAGREE' end as label, count(distinct reviewer) as reviewers from (select doc_id // 3 as item, doc_id % 3 as reviewer, quality::varchar as label from labels) group by item""")
def reviewer_consensus(spark, sf):
    """A-29."""
    l = read(spark, sf, "labels").select(F.floor(c("doc_id") / 3).alias("item"), (c("doc_id") % 3).alias("reviewer"), c("quality").cast("string").alias("label"))
    return A.consensus(l, "item", "reviewer", "label")


@query("""select event_id, event_type in ('VIEW', 'CLICK') or upper(event_type) in ('VIEW', 'CLICK') as accepted, regexp_matches(event_type || case when event_id % 2 = 0 then '/x' else '' end, '^[A-Za-z0-9_.-]+$') as safe, case when event_id % 3 = 0 then true when event_id % 3 = 1 then false end as flag, least(greatest(round(value), 10), 50) as clipped from events""")
def text_and_number_functions(spark, sf):
    """F-13, F-14, F-33, F-37, F-39."""
    e = read(spark, sf, "events")
    flag = F.when(c("event_id") % 3 == 0, " True").when(c("event_id") % 3 == 1, "FALSE").otherwise("maybe")
    name = F.concat("event_type", F.when(c("event_id") % 2 == 0, "/x").otherwise(""))
    return e.select("event_id", X.accepts(F.array(F.lit("View"), F.lit("CLICK")), c("event_type")).alias("accepted"), X.safe_name(name).alias("safe"), N.truthy(flag).alias("flag"), N.clip(F.round("value"), 10.0, 50.0).alias("clipped"))


@query("""with t as (select s_nationkey, s_suppkey, s_acctbal, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as n from supplier), k as (select s_nationkey, s_suppkey, row_number() over (order by s_suppkey) as r, count(*) over () as m from t where n <= 4)
    select s_nationkey, s_suppkey from k where m <= 5000""")
def spread_sample(spark, sf):
    """W-21."""
    s = read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return sampling.spread_sample(s, ["s_nationkey"], "s_acctbal", "s_suppkey", 4, 5000).select("s_nationkey", "s_suppkey")


@query("""(select 'order' as kind, o_orderdate::date as at, o_orderkey::varchar as title from orders order by 2 desc, 3 limit 5) union all (select 'shipment', l_shipdate::date, l_orderkey::varchar from lineitem order by 2 desc, 3 limit 5) order by 2 desc, 1, 3 limit 5""")
def recent_activity(spark, sf):
    """T-09, S-26."""
    from .payloads import recent_activity as latest

    o, li = read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")), read(spark, sf, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    return latest([("order", o, "d", "o_orderkey"), ("shipment", li, "d", "l_orderkey")], 5)


@query("""select o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)""")
def scoped_rows(spark, sf):
    """P-15, P-16, J-23."""
    from .payloads import visible_to

    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_nationkey")
    return visible_to(rows, read(spark, sf, "nation").where("n_regionkey = 1").select(c("n_nationkey").alias("c_nationkey")), "c_nationkey")


@query("""with e as (select user_id, min(cast(ts as date)) as a, max(cast(ts as date)) as b from events where event_type = 'purchase' group by user_id) select user_id, (b - a)::integer + 1 as days from e""")
def archive_span(spark, sf):
    """A-27: coverage from the first to the last day of an archive."""
    e = observations(spark, sf).where("event_type = 'purchase'")
    spans = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return W.merge_intervals(spans, ["user_id"], "a", "b").select("user_id", (F.datediff("b", "a") + 1).alias("days"))


@query("""select c_custkey, n from (select c_custkey, coalesce((select count(*) from orders where o_custkey = c_custkey), 0) as n from customer)""")
def composite_lookup(spark, sf):
    """J-05, J-08."""
    n = read(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return joins.lookup(read(spark, sf, "customer").select("c_custkey"), n, ["c_custkey"], {"n": 0})
