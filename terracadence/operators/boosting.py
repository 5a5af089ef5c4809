"""Boosted trees by histograms, with monotone features and missing values (N-04, N-05, N-07, A-35)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .aggregates import histogram

#: Gradients are summed as whole numbers of this fraction, so that a sum is the same in any order; splits must gain more than LEAST_GAIN.
UNIT, LEAST_GAIN, STAGE_EVERY = 1 << 20, 1e-9, 8


@dataclass
class Node:
    """A split (feature, bin, missing_left) or, without a feature, a leaf with its value."""

    value: float
    low: float = -np.inf
    high: float = np.inf
    feature: int | None = None
    bin: int = 0
    missing_left: bool = True
    gain: float = 0.0


@dataclass
class Boosted:
    """Trees over binned features; children of node k are 2k and 2k + 1."""

    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[dict[int, Node]] = field(default_factory=list)

    def bins(self) -> list[Column]:
        """0 for missing values, else one more than the number of edges below the value."""
        return [F.coalesce(histogram(F.col(f), e) + 1, F.lit(0)).cast("int") for f, e in zip(self.features, self.edges, strict=True)]

    def raw(self, bins: list[Column]) -> Column:
        return sum((self.rate * leaf(t, bins, lambda k, n: F.lit(n.value)) for t in self.trees), F.lit(self.base))

    def predict(self, df: DataFrame, name: str = "score") -> DataFrame:
        """The probability of the label, in a new column."""
        bins = {f"_b{k}": b for k, b in enumerate(self.bins())}
        out = df.withColumns(bins)
        return out.withColumn(name, 1 / (1 + F.exp(-self.raw([F.col(b) for b in bins])))).drop(*bins)


def leaf(tree: dict[int, Node], bins: list[Column], show, k: int = 1) -> Column:
    """show(node number, node) of the leaf a row falls into."""
    n = tree[k]
    if n.feature is None:
        return show(k, n)
    b = bins[n.feature]
    left = (b <= n.bin) if n.missing_left else b.between(1, n.bin)
    return F.when(left, leaf(tree, bins, show, 2 * k)).otherwise(leaf(tree, bins, show, 2 * k + 1))


def quantile_edges(df: DataFrame, features: list[str], most: int = 32) -> list[list[float]]:
    """Edges at which bins hold about equal numbers of rows, at most `most` a feature; features without values have none.

    A sketch of bounded size, to an eighth of a bin.
    """
    shares = [k / (most + 1) for k in range(1, most + 1)]
    found = df.stat.approxQuantile(features, shares, 1 / (8 * (most + 1)))
    return [sorted(set(e)) for e in found]


def best_split(counts: np.ndarray, node: Node, l2: float, least_rows: int, monotone: list[int]) -> tuple | None:
    """The split of greatest gain, ties to the first feature, the lowest bin, missing values left: gain, feature, bin, missing_left, left and right value.

    counts: feature, bin (0 is missing), (gradient, curvature, rows). A feature of order 1 (-1) takes only splits whose
    right value is not below (above) the left.
    """
    best = None
    worth = lambda g, h, w: g * w + 0.5 * (h + l2) * w * w
    value = lambda g, h: np.clip(-g / (h + l2), node.low, node.high)
    for f, c in enumerate(counts):
        whole = c.sum(0)
        total_g, total_h, total_n = whole[0] / UNIT, whole[1] / UNIT, whole[2]
        before = worth(total_g, total_h, np.clip(-total_g / (total_h + l2), node.low, node.high))
        run = np.cumsum(c[1:], axis=0)
        for missing_left in (True, False):
            left = run + (c[0] if missing_left else 0)
            lg, lh, ln = left[:, 0] / UNIT, left[:, 1] / UNIT, left[:, 2]
            right = whole - left
            rg, rh, rn = right[:, 0] / UNIT, right[:, 1] / UNIT, right[:, 2]
            wl, wr = value(lg, lh), value(rg, rh)
            gain = before - worth(lg, lh, wl) - worth(rg, rh, wr)
            fine = (c[1:, 2] > 0) & (ln >= least_rows) & (rn >= least_rows) & (monotone[f] * (wr - wl) >= 0)
            gain = np.where(fine, gain, -np.inf)
            if len(gain) and gain.max() > LEAST_GAIN:
                t = int(gain.argmax())
                found = (float(gain[t]), f, t + 1, missing_left, float(wl[t]), float(wr[t]))
                if best is None or found[0] > best[0] or (found[0] == best[0] and found[1] == best[1] and found[2] < best[2]):
                    best = found
    return best


def fit(df: DataFrame, features: list[str], label: str, edges: list[list[float]] | None = None, monotone: dict[str, int] | None = None, rounds: int = 40, depth: int = 4, rate: float = 0.05, l2: float = 1.0, least_rows: int = 20, weight: str | None = None, most_leaves: int | None = None) -> Boosted:
    """Boosted trees for a 0/1 label under logistic loss, grown level by level.

    A level is one groupBy (node, feature, bin) over all rows; only those sums, whose number depends on the tree and the
    bins alone, come to the driver, which picks the splits. monotone: +1 or -1 by feature; bounds that keep the order
    pass down to the children. Missing values go to the side that gains more. most_leaves: splits of a level stop at that
    number of leaves, the greatest gains first. Rows with a null label take no part. Raw scores are staged every few
    rounds, so that plans stay short and lost executors cost little. No rows give a model of no trees.
    """
    order = [(monotone or {}).get(f, 0) for f in features]
    model = Boosted(features, edges if edges is not None else quantile_edges(df, features), 0.0, rate)
    names = [f"b{k}" for k in range(len(features))]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), w.alias("w"), *[b.alias(n) for b, n in zip(model.bins(), names, strict=True)])
    units = lambda x: F.floor(x * UNIT + 0.5)
    start = rows.agg(F.sum(units(F.col("y") * F.col("w"))).alias("y"), F.sum(units(F.col("w"))).alias("w")).first()
    if not start.w or not 0 < start.y < start.w:
        model.base = 0.0 if not start.w else float(np.inf if start.y else -np.inf)
        return model
    model.base = float(np.log(start.y / (start.w - start.y)))
    bins = [F.col(n) for n in names]
    width = max(len(e) for e in model.edges) + 2
    rows = staged(rows.withColumn("raw", F.lit(model.base)))
    since = 0
    for _ in range(rounds):
        fresh = model.trees[since:]
        raw = sum((rate * leaf(t, bins, lambda k, n: F.lit(n.value)) for t in fresh), F.col("raw"))
        if len(fresh) >= STAGE_EVERY:
            rows, since, raw = staged(rows.withColumn("raw", raw)), len(model.trees), F.col("raw")
        p = 1 / (1 + F.exp(-F.col("r")))
        scored = rows.withColumn("r", raw).select(*names, units((p - F.col("y")) * F.col("w")).alias("g"), units(p * (1 - p) * F.col("w")).alias("h"))
        tree, open_ = {1: Node(0.0)}, [1]
        for _ in range(depth):
            at = scored.withColumn("node", leaf(tree, bins, lambda k, n: F.lit(k))).where(F.col("node").isin(open_))
            cells = F.array(*[F.struct(F.lit(k).alias("f"), F.col(n).alias("b")) for k, n in enumerate(names)])
            sums = at.select("node", "g", "h", F.inline(cells)).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).toArrow()
            counts = {k: np.zeros((len(features), width, 3), np.int64) for k in open_}
            for node, f, b, *c in zip(*(sums[x].to_pylist() for x in ("node", "f", "b", "g", "h", "n")), strict=True):
                counts[node][f, b] = c
            found = {k: best_split(counts[k], tree[k], l2, least_rows, order) for k in open_}
            ranked = sorted((k for k in open_ if found[k]), key=lambda k: (-found[k][0], k))
            room = len(ranked) if most_leaves is None else max(0, most_leaves - sum(n.feature is None for n in tree.values()))
            open_ = []
            for k in sorted(ranked[:room]):
                n, (n.gain, n.feature, n.bin, n.missing_left, left, right) = tree[k], found[k]
                a, b, mid = Node(left, n.low, n.high), Node(right, n.low, n.high), (left + right) / 2
                if order[n.feature] > 0:
                    a.high = b.low = mid
                elif order[n.feature] < 0:
                    a.low = b.high = mid
                tree[2 * k], tree[2 * k + 1] = a, b
                open_ += [2 * k, 2 * k + 1]
            if not open_:
                break
        if len(tree) == 1:
            break
        model.trees.append(tree)
    return model


def boosted_sql(rows: str, key: str, features: list[str], label: str, edges: list[list[float]], monotone: list[int], rounds: int, depth: int, rate: float, l2: float, least_rows: int, weight: str = "1.0::double", name: str = "m", train: str = "true") -> str:
    """The same fit written out as common table expressions over `rows` (a CTE with key, features, label), ending in {name}_{rounds} (key, raw). Rows where train does not hold are scored only."""
    bin_ = lambda f, e: f"case when {f} is null then 0 else 1 + " + (" + ".join(f"({f} > {x}::double)::int" for x in e) or "0") + " end"
    unit = lambda x: f"floor(({x}) * {UNIT} + 0.5)::bigint"
    ctes = [
        f"{name}_x as materialized (select {key}, {label}::double as y, {weight} as w, ({train}) and {label} is not null as fits, " + ", ".join(f"{bin_(f, e)} as b{k}" for k, (f, e) in enumerate(zip(features, edges, strict=True))) + f" from {rows})",
        f"{name}_0 as materialized (select *, (select ln(sum({unit('y * w')}) / (sum({unit('w')}) - sum({unit('y * w')}))) from {name}_x where fits) as raw from {name}_x)",
    ]
    worth = lambda g, h, w: f"({g} * {w} + 0.5 * ({h} + {l2}) * {w} * {w})"
    clip = lambda x: f"least(greatest({x}, lo), hi)"
    sign = "case f " + " ".join(f"when {k} then {s}" for k, s in enumerate(monotone)) + " end"
    for r in range(rounds):
        n = f"{name}_{r}"
        ctes.append(f"{n}_l0 as materialized (select *, 1 / (1 + exp(-raw)) as p, 1 as node, 0.0::double as val, '-infinity'::double as lo, 'infinity'::double as hi, true as open from {n})")
        for d in range(depth):
            at = f"{n}_l{d}"
            cells = " union all ".join(f"select node, lo, hi, {k} as f, b{k} as b, {unit('(p - y) * w')} as g, {unit('p * (1 - p) * w')} as h from {at} where fits and open" for k in range(len(features)))
            ctes += [
                f"{at}_c as materialized (select node, lo, hi, f, b, sum(g)::bigint as g, sum(h)::bigint as h, count(*) as n from ({cells}) group by all)",
                f"{at}_t as (select node, f, sum(g) as tg, sum(h) as th, sum(n) as tn, coalesce(sum(g) filter (b = 0), 0) as mg, coalesce(sum(h) filter (b = 0), 0) as mh, coalesce(sum(n) filter (b = 0), 0) as mn from {at}_c group by all)",
                f"{at}_s as (select node, lo, hi, f, b, sum(g) over w as cg, sum(h) over w as ch, sum(n) over w as cn from {at}_c where b > 0 window w as (partition by node, f order by b))",
                f"{at}_k as (select node, lo, hi, f, b, ml, (cg + ml * mg)::double / {UNIT} as lg, (ch + ml * mh)::double / {UNIT} as lh, cn + ml * mn as ln, (tg - cg - ml * mg)::double / {UNIT} as rg, (th - ch - ml * mh)::double / {UNIT} as rh, tn - cn - ml * mn as rn, tg::double / {UNIT} as tg, th::double / {UNIT} as th from {at}_s join {at}_t using (node, f), (values (1), (0)) q(ml))",
                f"{at}_w as (select *, {clip(f'-lg / (lh + {l2})')} as wl, {clip(f'-rg / (rh + {l2})')} as wr, {clip(f'-tg / (th + {l2})')} as wt from {at}_k where ln >= {least_rows} and rn >= {least_rows})",
                f"{at}_g as (select *, {worth('tg', 'th', 'wt')} - {worth('lg', 'lh', 'wl')} - {worth('rg', 'rh', 'wr')} as gain from {at}_w where ({sign}) * (wr - wl) >= 0)",
                f"{at}_b as materialized (select *, ({sign}) as s from {at}_g where gain > {LEAST_GAIN} qualify row_number() over (partition by node order by gain desc, f, b, ml desc) = 1)",
            ]
            side = "case b.f " + " ".join(f"when {k} then case when b{k} = 0 then b.ml = 1 else b{k} <= b.b end" for k in range(len(features))) + " end"
            kept = ", ".join(f"b{k}" for k in range(len(features)))
            ctes.append(f"""{n}_l{d + 1} as materialized (select {key}, y, w, fits, {kept}, raw, p, case when b.node is null then x.node when {side} then 2 * x.node else 2 * x.node + 1 end as node, case when b.node is null then x.val when {side} then b.wl else b.wr end as val,
                case when b.s = 1 and not ({side}) then (b.wl + b.wr) / 2 when b.s = -1 and {side} then (b.wl + b.wr) / 2 else x.lo end as lo, case when b.s = 1 and {side} then (b.wl + b.wr) / 2 when b.s = -1 and not ({side}) then (b.wl + b.wr) / 2 else x.hi end as hi, b.node is not null as open
                from {at} x left join {at}_b b on x.node = b.node and x.open)""")
        ctes.append(f"{name}_{r + 1} as materialized (select {key}, y, w, fits, {kept}, raw + {rate} * val as raw from {n}_l{depth})")
    return ",\n".join(ctes)
