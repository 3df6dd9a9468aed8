"""Evaluation statistics over result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordered import running
from tessella.operators.search import ship

NAN = float("nan")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of k successes in n; NaN for n = 0."""
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    side = lambda x: F.when(n == 0, F.lit(NAN)).otherwise(x / (1 + z2 / n))
    return side(mid - half), side(mid + half)


def accuracy(rows: DataFrame, by: str, correct: str = "correct") -> DataFrame:
    """by, n, k, acc and its Wilson interval."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("long")).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.withColumns({"acc": F.col("k") / F.col("n"), "lo": lo, "hi": hi})


def median_or_nan(x: Column) -> Column:
    return F.coalesce(F.median(x), F.lit(NAN))


def latency(rows: DataFrame, value: str = "latency_ms") -> DataFrame:
    """n, median, and the value at place int(0.9 n) from 0: exact, from running counts of the distinct values."""
    g = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = g.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    upto = running(g, [F.col("v")], {"upto": "c"}).crossJoin(F.broadcast(n))  # one row
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))  # noqa: E731  the value at a place from 0
    last = F.col("n") - 1
    out = upto.agg(((at(F.floor(last / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), at(F.least(F.floor(F.col("n") * 0.9), last)).alias("p90"))
    return n.crossJoin(out)


#: How often a cluster is drawn, as a step function of a uniform draw of eight hex digits: P(Poisson(1) <= k), up to where these end.
POISSON = tuple(f"{min(2**32 - 1, int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32)):08x}" for k in range(12))


def times_drawn(digits: Column) -> Column:
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(digits < POISSON[k], F.lit(k)).otherwise(out)
    return out


def replicates(cells: DataFrame, n_boot: int, salt: str) -> DataFrame:
    """Each row of cells (g: its cluster) once for each replicate b that draws its cluster, with times. Rows stream into a partial sum by b; draws need no order.

    One md5 of salt, b div 4 and cluster serves four replicates, eight hex digits each: equal on every engine.
    """
    each = cells.withColumn("__four", F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // 4) - 1))))
    each = each.withColumn("__digits", F.md5(F.concat_ws("-", F.lit(salt), F.col("__four").cast("string"), F.col("g").cast("string"))))
    each = each.withColumn("__j", F.explode(F.array(*[F.lit(j) for j in range(4)]))).withColumn("b", F.col("__four") * 4 + F.col("__j"))
    each = each.withColumn("times", times_drawn(F.substring("__digits", F.col("__j") * 8 + 1, F.lit(8))))
    return each.where((F.col("times") > 0) & (F.col("b") < n_boot)).drop("__four", "__j", "__digits")


def cluster_bootstrap(rows: DataFrame, value: str, group: str, n_boot: int = 10_000, alpha: float = 0.05, salt: str = "b") -> DataFrame:
    """point, lo, hi, n of a mean: whole clusters are drawn, a replicate's mean is over its rows.

    Clusters are summed first; each enters a replicate Poisson(1) times, the limit of drawing as many as there are with replacement, so that no
    cluster needs a place in an order. Rows without a group are the cluster -1. Empty input: NaN, n = 0.
    """
    g = rows.groupBy(F.coalesce(F.col(group).cast("long"), F.lit(-1)).alias("g")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    means = replicates(g, n_boot, salt).groupBy("b").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("m"))
    ends = means.agg(F.percentile("m", [alpha / 2, 1 - alpha / 2]).alias("q"))  # n_boot rows
    point = g.agg((F.sum("s") / F.sum("n")).alias("point"), F.sum("n").alias("n"))
    nan = lambda c: F.coalesce(c, F.lit(NAN))
    return point.crossJoin(ends).select(nan("point").alias("point"), nan(F.get("q", F.lit(0))).alias("lo"), nan(F.get("q", F.lit(1))).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def binomial_half_tail(k: Column, n: Column) -> Column:
    """P(Bin(n, 1/2) <= k), terms in logarithms."""
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i))).alias("s"))
    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, step, lambda a: a["s"])
    return F.when(k < 1, F.exp(-n * F.log(F.lit(2.0)))).otherwise(whole)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n01 (a alone), n10 (b alone), p_value (exact, two-sided), delta and n_pairs of paired booleans."""
    c = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col(a) & ~F.col(b)).alias("n01"), F.count_if(~F.col(a) & F.col(b)).alias("n10"),
        (F.avg(F.col(a).cast("double")) - F.avg(F.col(b).cast("double"))).alias("delta"),
    )
    n = F.col("n01") + F.col("n10")
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_half_tail(F.least("n01", "n10"), n)))
    return c.select("n01", "n10", p.alias("p_value"), F.when(n == 0, F.lit(0.0)).otherwise(F.col("delta")).alias("delta"), "n_pairs")


def paired(hard: DataFrame, clean: DataFrame, item: str = "item_id", correct: str = "correct") -> DataFrame:
    """Each hard row with whether its item is right in at least half of its clean rows."""
    c = clean.groupBy(item).agg((F.avg(F.col(correct).cast("double")) >= 0.5).alias("clean_correct"))
    return hard.join(c, item).withColumn("hard_correct", F.col(correct))


def cooccurrence(rows: DataFrame, key: str, values: str, names: list[str] | None = None) -> DataFrame:
    """a, b, both, n_a, n_b and Jaccard of every ordered pair of values, pairs that never meet included."""
    e = rows.select(F.col(key).alias("k"), F.explode(F.array_distinct(values)).alias("v"))
    n = e.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    if names is not None:
        n = rows.sparkSession.createDataFrame([(x,) for x in names], "v string").join(n, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))
    both = rows.select(F.explode(F.array_distinct(values)).alias("a"), F.array_distinct(values).alias("vs")).select("a", F.explode("vs").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    grid = n.select(F.col("v").alias("a"), F.col("n").alias("n_a")).crossJoin(n.select(F.col("v").alias("b"), F.col("n").alias("n_b")))  # of a condition vocabulary with itself
    out = grid.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    return out.withColumn("jaccard", F.when(union == 0, F.lit(0.0)).otherwise(F.col("both") / union))


def condition_histogram(rows: DataFrame, values: str) -> DataFrame:
    """n_conditions, n: dense from 0 to the largest."""
    c = rows.groupBy(F.size(values).cast("long").alias("n_conditions")).agg(F.count(F.lit(1)).alias("n"))
    top = c.agg(F.max("n_conditions").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("n_conditions"))
    return top.join(c, "n_conditions", "left").select("n_conditions", F.coalesce("n", F.lit(0)).alias("n"))


def auroc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """auroc, n_pos, n_neg by rank sums, ties at their mean rank; NaN if a class is empty.

    Equal scores are counted together first, so the ordered table has a row for each distinct score.
    """
    g = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count(F.lit(1)).alias("n"))
    r = running(g, [F.col("s")], {"upto": "n"}).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0)
    t = r.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"))
    pos, neg = F.coalesce("n_pos", F.lit(0)), F.coalesce("n_neg", F.lit(0))
    area = (F.col("r") - pos * (pos + 1) / 2.0) / (pos * neg)
    return t.select(F.when((pos == 0) | (neg == 0), F.lit(NAN)).otherwise(area).alias("auroc"), pos.alias("n_pos"), neg.alias("n_neg"))


def risk_curve(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", key: str = "id") -> DataFrame:
    """id, place, coverage and risk when answers are given in order of confidence, ties by id; and the risk of the best possible order."""
    right = F.col(correct).cast("long")
    rows = rows.select(F.col(key).alias("id"), F.col(confidence).alias("confidence"), right.alias("right"), (1 - right).alias("wrong"))
    totals = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("n_right")))  # one row
    out = running(rows, [(F.col("confidence"), True), F.col("id")], {"errors": "wrong"}).select("id", "right", "place", "errors")
    best = running(out, [(F.col("right"), True), F.col("id")], {}, "best_place").crossJoin(totals)
    lost = F.greatest(F.lit(0), F.col("best_place") - F.col("n_right"))  # in the best order all errors come last
    return best.select("id", "place", (F.col("place") / F.col("n")).alias("coverage"), (F.col("errors") / F.col("place")).alias("risk"), (lost / F.col("best_place")).alias("oracle_risk"))


def aurc(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", key: str = "id") -> DataFrame:
    """aurc and e_aurc (what it exceeds that of the best order by); NaN without rows."""
    c = risk_curve(rows, confidence, correct, key)
    nan = lambda x: F.coalesce(x, F.lit(NAN))
    return c.agg(nan(F.avg("risk")).alias("aurc"), nan(F.avg("risk") - F.avg("oracle_risk")).alias("e_aurc"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, weight: np.ndarray | None = None, rounds: int = 100) -> np.ndarray:
    """Intercept and coefficients that minimise weighted log loss + l2 / 2 * |coefficients|**2, by damped Newton steps."""
    w = np.ones(len(y)) if weight is None else weight
    a = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.full(a.shape[1], float(l2))
    ridge[0] = 0.0
    b = np.zeros(a.shape[1])
    loss = lambda b: float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ b))).sum() + (ridge * b * b).sum() / 2)
    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a @ b)))
        grad = a.T @ (w * (p - y)) + ridge * b
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-12)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b = b - size * step
        new = loss(b)
        if now - new < 1e-12 * max(1.0, abs(now)):
            break
        now = new
    return b


def condition_cells(rows: DataFrame, conditions: list[str], correct: str, group: str) -> DataFrame:
    """g and a count for each pattern of conditions and outcome: all that the regressions need, far fewer rows than photos."""
    mask = F.concat(*[F.when(F.array_contains("conditions", c), "1").otherwise("0") for c in conditions])
    return rows.groupBy(F.coalesce(F.col(group).cast("long"), F.lit(-1)).alias("g"), mask.alias("mask"), F.col(correct).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def marginal_effects(rows: DataFrame, conditions: list[str], correct: str = "correct", group: str = "item_id", l2: float = 1.0, n_boot: int = 2000, salt: str = "m") -> DataFrame:
    """condition, log_odds, lo, hi, marginal_pp, n: L2 logistic regression of correctness on condition indicators.

    Intervals come from redrawing items (see cluster_bootstrap); replicates of one class are left out, and fewer than 21 give none. marginal_pp is the
    average change of the predicted probability, in points, when a condition is switched on. A fit needs only the counts of each pattern of
    conditions and outcome, at most two for each pattern whatever the number of rows; replicates are summed to such counts and fitted in parallel.
    """
    spark = rows.sparkSession
    ship(spark)
    cells = condition_cells(rows, conditions, correct, group)
    whole = cells.groupBy("mask", "y").agg(F.sum("n").alias("n")).orderBy("mask", "y").collect()  # two rows for each pattern
    schema = "condition string, log_odds double, lo double, hi double, marginal_pp double, n long"
    if len({r.y for r in whole}) < 2:
        return spark.createDataFrame([(c, NAN, NAN, NAN, NAN, 0) for c in conditions], schema)
    x, y, n = _cells([r.mask for r in whole], [r.y for r in whole], [r.n for r in whole])
    base = logistic(x, y, l2, n)

    def replicate(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["mask", "y"])
        if f["y"].nunique() < 2:
            return pd.DataFrame({"place": [], "coef": []})
        coef = logistic(*_cells(f["mask"], f["y"], f["n"], l2))[1:]
        return pd.DataFrame({"place": np.arange(len(coef)), "coef": coef})

    drawn = replicates(cells, n_boot, salt).groupBy("b", "mask", "y").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    boot = drawn.groupBy("b").applyInPandas(replicate, "place long, coef double")
    ends = {r.place: (r.q, r.c) for r in boot.groupBy("place").agg(F.percentile("coef", [0.025, 0.975]).alias("q"), F.count(F.lit(1)).alias("c")).collect()}  # a row for each condition
    out = []
    for i, c in enumerate(conditions):
        (lo, hi), fits = ends.get(i, ((NAN, NAN), 0))
        on, off = x.copy(), x.copy()
        on[:, i], off[:, i] = 1.0, 0.0
        p = lambda a: 1 / (1 + np.exp(-(base[0] + a @ base[1:])))
        change = float(((p(on) - p(off)) * n).sum() / n.sum() * 100)
        out.append((c, float(base[1 + i]), float(lo) if fits > 20 else NAN, float(hi) if fits > 20 else NAN, change, int((x[:, i] * n).sum())))
    return spark.createDataFrame(out, schema)


def _cells(mask, y, n, l2: float | None = None) -> tuple:
    """Arguments of logistic from patterns, outcomes and counts."""
    x, y, n = np.array([[float(v) for v in m] for m in mask]), np.asarray(y, float), np.asarray(n, float)
    return (x, y, n) if l2 is None else (x, y, l2, n)


def dose_response(rows: DataFrame, count: str, correct: str = "correct") -> tuple[float, DataFrame]:
    """The odds ratio for each further condition, and accuracy by their number (level, n, k, acc, lo, hi)."""
    levels = accuracy(rows.withColumn("level", F.col(count).cast("long")), "level", correct)
    cells = levels.select("level", "n", "k").toPandas()
    if cells["k"].sum() in (0, cells["n"].sum()):
        return NAN, levels
    x = np.repeat(cells["level"].to_numpy(float), 2)[:, None]
    w = np.stack([cells["k"], cells["n"] - cells["k"]], axis=1).astype(float).ravel()
    return float(np.exp(logistic(x, np.tile([1.0, 0.0], len(cells)), 1.0, w)[1])), levels


def three_way(rows: DataFrame) -> DataFrame:
    """Counts and rates of accepting, refusing and erring; rows: in_catalogue, refused, correct."""
    inc, ok = F.col("in_catalogue"), ~F.col("refused")
    rate = lambda of, what: F.coalesce(F.avg(F.when(of, what.cast("double"))), F.lit(NAN))
    return rows.agg(
        F.count_if(inc & ok & F.col("correct")).alias("in_accepted_correct"), F.count_if(inc & ok & ~F.col("correct")).alias("in_accepted_wrong"),
        F.count_if(inc & ~ok).alias("in_refused"), rate(~inc, ok).alias("far"), rate(inc, ~ok).alias("frr"), rate(inc, ok & ~F.col("correct")).alias("wrong_accept"),
    )
