"""Registered models: fits whose steps SQL can write out, with that SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, learn
from ..operators.aggregates import score_metrics
from . import panels as P
from .queries_plans import _season_sql, season_fields
from .tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


c = F.col

RETURNS = {"l_quantity": [5, 10, 15, 20, 25, 30, 35, 40, 45], "l_discount": [0.02, 0.04, 0.06, 0.08], "price": [200, 400, 600, 800, 1000, 1500, 2000], "l_tax": [0.02, 0.04, 0.06], "ship": [60, 120, 180, 240, 300]}
RETURNS_MONOTONE = {"l_quantity": 1, "price": -1}
RETURNS_ROWS = "x as (select l_orderkey, l_linenumber, l_quantity, l_tax, nullif(l_discount, 0) as l_discount, l_extendedprice / nullif(l_quantity, 0) as price, dayofyear(l_shipdate) as ship, (l_returnflag = 'R')::int as y from lineitem)"


def _returns_sql() -> str:
    trees = boosting.boosted_sql("x", "l_orderkey, l_linenumber", list(RETURNS), "y", list(RETURNS.values()), [RETURNS_MONOTONE.get(f, 0) for f in RETURNS], 3, 2, 0.3, 1.0, 20)
    return f"with {RETURNS_ROWS},\n{trees}\nselect l_orderkey, l_linenumber, round(raw, 6) as raw from m_3"


def return_rows(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.nullif("l_discount", F.lit(0)).alias("l_discount"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.dayofyear("l_shipdate").alias("ship"), (c("l_returnflag") == "R").cast("int").alias("y"))


@query(_returns_sql())
def monotone_boost(spark, sf):
    """N-04, N-07: boosted trees under monotone constraints, missing values sent to the side that gains more."""
    rows = return_rows(spark, sf)
    model = boosting.fit(rows, list(RETURNS), "y", list(RETURNS.values()), RETURNS_MONOTONE, rounds=3, depth=2, rate=0.3)
    return rows.select("l_orderkey", "l_linenumber", F.round(model.raw(model.bins()), 6).alias("raw"))


RISK = {"prior_burn": [0], "nbhd_prior_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8], "nbhd_burned_before": [0, 1, 2, 4, 8, 16, 32], "nbhd_harvested_before": [0, 1, 2, 4, 8, 16, 32, 64], "harvest_doy": [30, 60, 90, 120, 180, 240, 300]}
RISK_MONOTONE = {"prior_burn": 1, "nbhd_prior_rate": 1}


def risk_season(spark, sf, year: int):
    return P.risk_features(season_fields(spark, sf, year), season_fields(spark, sf, year - 1)).withColumn("y", c("burned").cast("int"))


def _risk_sql(year: int, name: str) -> str:
    """The risk panel of a season by the neighbours' cells."""
    n, p = f"{name}n", f"{name}p"
    around = "abs(b.ix - q.ix) <= 1 and abs(b.iy - q.iy) <= 1"
    return f"""{_season_sql(year, n)}, {_season_sql(year - 1, p)}, {name}q as (select * from {n} where ndvi >= 0.6), {name}k as (select * from {p} where ndvi >= 0.6), {name}cells as (select distinct ix, iy from {name}k),
        {name}rt as (select q.ix, q.iy, count(*) filter (b.burned) / greatest(count(*), 1) as rate from {name}cells q join {name}k b on {around} group by all),
        {name}nb as (select q.field_id, count(*) filter (b.bd < q.hd) as nb, count(*) filter (b.hd < q.hd) as nh from {name}q q join {name}q b on {around} group by all),
        {name} as materialized (select q.field_id, coalesce(x.burned::int, 0) as prior_burn, coalesce(rt.rate, 0) as nbhd_prior_rate, nb as nbhd_burned_before, nh as nbhd_harvested_before, dayofyear(q.hd) as harvest_doy, q.burned::int as y
            from {name}q q join {name}nb using (field_id) left join {p} x on x.field_id = q.field_id left join {name}rt rt on rt.ix = q.ix and rt.iy = q.iy)"""


def _auc_sql(scores: str, y: str = "y", score: str = "score") -> str:
    """AUC by ranks, ties counting half."""
    return f"(select (sum(r) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2) / (count(*) filter (pos) * count(*) filter (not pos)) from (select {y} = 1 as pos, (rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2) as r from {scores}))"


def _risk_model_sql() -> str:
    trees = boosting.boosted_sql("seasons", "season, field_id", list(RISK), "y", list(RISK.values()), [RISK_MONOTONE.get(f, 0) for f in RISK], 3, 2, 0.2, 1.0, 20, train="season = 1997")
    return f"""with {_risk_sql(1997, "a")}, {_risk_sql(1998, "b")}, seasons as materialized (select 1997 as season, * from a union all select 1998, * from b),
        {trees} select field_id, round(raw, 6) as raw, round({_auc_sql("m_3 where season = 1998", "y", "round(raw, 6)")}, 9) as auc from m_3 where season = 1998"""


@query(_risk_model_sql())
def risk_boosted(spark, sf):
    """N-04, A-32: in-season burn risk fitted to one season and scored on the next, with the AUC there."""
    train, test = risk_season(spark, sf, 1997), risk_season(spark, sf, 1998)
    model = boosting.fit(train, list(RISK), "y", list(RISK.values()), RISK_MONOTONE, rounds=3, depth=2, rate=0.2)
    scored = test.select("field_id", "y", F.round(model.raw(model.bins()), 6).alias("raw"))
    auc = score_metrics(scored, "y", "raw").select(F.round("auc", 9).alias("auc"))
    return scored.drop("y").crossJoin(F.broadcast(auc))  # one row


def _logistic_sql(steps: int = 8) -> str:
    x = ["1.0::double", "x1", "x2"]
    ctes = [f"with {_risk_sql(1997, 'a')}, r as materialized (select y::double as y, (prior_burn - (select avg(prior_burn) from a)) / (select stddev_pop(prior_burn) from a) as x1, (nbhd_prior_rate - (select avg(nbhd_prior_rate) from a)) / (select stddev_pop(nbhd_prior_rate) from a) as x2 from a)", "w0 as (select 0.0::double as w0, 0.0::double as w1, 0.0::double as w2)"]
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    for k in range(steps):
        sums = [f"sum(p * (1 - p) * {x[i]} * {x[j]}){' + 1' if i == j > 0 else ''} as h{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum((y - p) * {x[i]}){f' - any_value(w{i})' if i else ''} as g{i}" for i in range(3)]
        ctes.append(f"s{k} as materialized (select {', '.join(sums)}, any_value(w0) as w0, any_value(w1) as w1, any_value(w2) as w2 from (select *, 1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2))) as p from r, w{k}))")
        h = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
        at = lambda c_: [[f"g{i}" if j == c_ else h[i][j] for j in range(3)] for i in range(3)]  # noqa: E731, B023
        ctes.append(f"w{k + 1} as materialized (select " + ", ".join(f"w{i} + {det(at(i))} / {det(h)} as w{i}" for i in range(3)) + f" from s{k})")
    return ",\n".join(ctes) + f"\nselect round(w0, 6) as intercept, round(w1, 6) as prior_burn, round(w2, 6) as nbhd_prior_rate from w{steps}"


@query(_logistic_sql())
def history_logistic(spark, sf):
    """N-03: the coefficients of the pre-season model."""
    model = learn.logistic(risk_season(spark, sf, 1997), ["prior_burn", "nbhd_prior_rate"], "y")
    return spark.range(1).select(*[F.round(F.lit(w), 6).alias(n) for n, w in zip(("intercept", *model.features), model.weights, strict=True)])


HAZARD = {"recent_burns_3": [0, 1, 2, 4], "recent_burns_9": [0, 1, 2, 4, 8, 16], "rain_before": [0, 1, 2, 4, 8], "rain_after": [0, 1, 2, 4, 8], "days_since_harvest": [0, 3, 7, 14, 21]}
HAZARD_GROUPS = {"neighbour_burns": ["recent_burns_3", "recent_burns_9"], "rain": ["rain_before", "rain_after"], "days_since_harvest": ["days_since_harvest"]}


def hazard_season(spark, sf, year: int):
    from .queries_plans import rain_and_passes

    passes, rain = rain_and_passes(spark, sf, year)
    return P.hazard_panel(season_fields(spark, sf, year), passes, rain)


def _hazard_sql(year: int, n: str) -> str:
    burns = lambda k: f"(select count(*) from {n}n b where b.burned and abs(b.ix - x.ix) <= {k} and abs(b.iy - x.iy) <= {k} and b.bd <= x.t and b.bd > x.t - 10)"
    return f"""{_season_sql(year, n + 'n')}, {n}t as (select distinct date '{year}-01-01' + (5 * (c_custkey % 80))::integer as t from customer),
        {n}r as (select day, sum(mm) / count(mm) as mm from (select date '{year}-01-01' + (s_suppkey % 300)::integer as day, (s_suppkey % 7)::double as mm from supplier) group by day),
        {n}x as (select s.*, t.t from {n}n s join {n}t t on hd <= t and t <= hd + 30 and not (burned and bd - 1 < t)),
        {n} as materialized (select {year} as season, field_id, t, (t - hd)::integer as days_since_harvest, coalesce(burned and bd - 1 = t, false)::int as label, {burns(1)} as recent_burns_3, {burns(4)} as recent_burns_9,
            coalesce((select sum(mm) from {n}r where day between x.t - 3 and x.t - 1), 0) as rain_before, coalesce((select sum(mm) from {n}r where day between x.t and x.t + 4), 0) as rain_after from {n}x x)"""


def _ablation_sql() -> str:
    ctes, rows = [_hazard_sql(1996, "ha"), _hazard_sql(1997, "hb"), "h as materialized (select * from ha union all select * from hb)"], []
    for k, left_out in enumerate([None, *HAZARD_GROUPS]):
        features = [f for g, fs in HAZARD_GROUPS.items() if g != left_out for f in fs]
        ctes.append(boosting.boosted_sql("h", "season, field_id, t", features, "label", [HAZARD[f] for f in features], [0] * len(features), 2, 2, 0.3, 1.0, 20, name=f"m{k}", train="season = 1996"))
        shown = f"'{left_out}'" if left_out else "null"
        rows.append(f"select {shown}::varchar as left_out, round({_auc_sql(f'm{k}_2 where season = 1997', 'y', 'round(raw, 9)')}, 6) as auc")
    return "with " + ",\n".join(ctes) + "\n" + " union all ".join(rows)


@query(_ablation_sql())
def hazard_ablation(spark, sf):
    """A-35: the hazard model's AUC with every group of features and without each."""
    out = learn.ablation(hazard_season(spark, sf, 1996), hazard_season(spark, sf, 1997), HAZARD_GROUPS, "label", HAZARD, rounds=2, depth=2, rate=0.3)
    return out.select("left_out", F.round("auc", 6).alias("auc"))


STATUS = {"o_totalprice": [50_000, 100_000, 150_000, 200_000, 300_000], "day": [1300, 1700, 2100, 2500, 2900, 3300], "clerk": [2, 4, 6, 8]}
STATUS_ROWS = "o as (select o_orderkey, o_orderstatus, o_totalprice, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as day, case when o_custkey % 11 > 0 then o_custkey % 11 end as clerk from orders), n as (select o_orderstatus as s, (sum(count(*)) over ())::double / ((count(*) over ()) * count(*)) as weight from o group by 1), x as (select o.*, n.weight from o join n on s = o_orderstatus)"


def _status_sql() -> str:
    ctes = []
    for k, s in enumerate("FOP"):
        ctes.append(f"x{k} as (select *, (o_orderstatus = '{s}')::int as y from x)")
        ctes.append(boosting.boosted_sql(f"x{k}", "o_orderkey", list(STATUS), "y", list(STATUS.values()), [0, 0, 0], 2, 2, 0.3, 1.0, 20, weight="weight", name=f"m{k}"))
    p = lambda k: f"(1 / (1 + exp(-m{k}_2.raw)))"
    best = f"greatest({p(0)}, {p(1)}, {p(2)})"
    return f"""with {STATUS_ROWS}, {", ".join(ctes)} select o_orderkey, case when {p(0)} = {best} then 'F' when {p(1)} = {best} then 'O' else 'P' end as predicted, round({best} / ({p(0)} + {p(1)} + {p(2)}), 6) as confidence, 'EXPERIMENTAL_MODEL' as trust, false as may_decide
        from m0_2 join m1_2 using (o_orderkey) join m2_2 using (o_orderkey)"""


@query(_status_sql())
def status_boosted(spark, sf):
    """N-05, N-06: a class for every row from boosted models with balanced classes, behind the trust gate."""
    o = read(spark, sf, "orders")
    rows = o.select("o_orderkey", "o_orderstatus", "o_totalprice", F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("day"), F.nullif(c("o_custkey") % 11, F.lit(0)).alias("clerk"))
    train = learn.class_weights(rows, "o_orderstatus")
    models = learn.one_against_rest(train, list(STATUS), "o_orderstatus", ["F", "O", "P"], list(STATUS.values()), "weight", rounds=2, depth=2, rate=0.3)
    scored = learn.most_likely(rows, models).select("o_orderkey", "predicted", F.round("confidence", 6).alias("confidence"))
    return learn.infer(scored, "EXPERIMENTAL_MODEL", learn.fingerprint("status-1", list(STATUS)), "status-1", list(STATUS))
