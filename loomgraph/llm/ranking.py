"""One global ranking from pairwise comparisons: weighted least squares on the comparison graph.

Votes are first aggregated to one row a pair of items, so a pair that holds a third of all votes is one row. A pair's log-odds
margin y = ln((w_a + h) / (w_b + h)) is set against the difference of two strengths with the weight of its precision,
(w_a + h)(w_b + h) / (w_a + w_b + 2h). The normal equations are a graph Laplacian, solved by conjugate gradient, by sparse
joins over the edges. A weak pull to zero (`ridge`) connects components and gives items without votes a strength.
What no ranking can explain is reported as the cyclic inconsistency: the residual of each pair, y - (s_a - s_b).

Defined results: a vote needs two different known items and an outcome; a tie is half a vote for each; exports of the same
packet count once (the smallest row stands for it); equal strengths are ordered by name; no votes at all give all items
strength 0 in order of name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import fold_name
from loomgraph.operators.order import positions
from loomgraph.session import cut

HALF, RIDGE, TOLERANCE = 0.5, 0.05, 1e-9
#: Up to this many pairs, counted first, the system is solved on the driver, where a step needs no Spark job; beyond it by distributed
#: joins. Both take the same steps and end by the same rule, so the size decides nothing but the time.
SMALL = 200_000


def most_steps(n: int) -> int:
    return 10 * n + 50


def votes(pairwise: DataFrame, totals: DataFrame, catalog: DataFrame) -> DataFrame:
    """a, b, wins_a, wins_b, source: aggregated by pair (a < b) and source of the votes."""
    out = F.lower(F.trim("human_outcome"))
    p = pairwise.select("packet_id", fold_name(F.col("baseline_variant")).alias("x"), fold_name(F.col("other_variant")).alias("y"), fold_name(F.col("human_preferred_variant")).alias("pref"), out.alias("h"), F.lower(F.trim("llm_strict_outcome")).alias("l"))
    known = p.filter("packet_id IS NOT NULL").groupBy("packet_id").agg(F.min(F.struct("x", "y", "pref", "h", "l")).alias("v")).select("v.*").unionByName(p.filter("packet_id IS NULL").drop("packet_id"))
    human = (
        F.when(F.col("pref") == F.col("x"), 0.0).when(F.col("pref") == F.col("y"), 1.0).when(F.col("pref") == "tie", 0.5)
        .when(F.col("h") == "other_win", 1.0).when(F.col("h") == "baseline_win", 0.0).when(F.col("h") == "tie", 0.5)
    )
    llm = F.when(F.col("l") == "other_win", 1.0).when(F.col("l") == "baseline_win", 0.0).when(F.col("l") == "tie", 0.5)
    one = known.select("x", "y", F.explode(F.array(F.struct(F.lit("human").alias("source"), human.alias("w")), F.struct(F.lit("llm").alias("source"), llm.alias("w")))).alias("v")).select("x", "y", "v.source", (1 - F.col("v.w")).alias("wx"), F.col("v.w").alias("wy"))
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("double")
    core = totals.select(fold_name(F.col("variant")).alias("x"), fold_name(F.col("baseline")).alias("y"), F.lit("judge").alias("source"), (n("raw_wins_vs_hi") + n("raw_ties") / 2).alias("wx"), (n("raw_losses_vs_hi") + n("raw_ties") / 2).alias("wy"))
    both = one.unionByName(core).filter("wx IS NOT NULL AND x <> y")
    swap = F.col("x") > F.col("y")
    pairs = both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "source").agg(F.sum(F.when(swap, F.col("wy")).otherwise(F.col("wx"))).alias("wins_a"), F.sum(F.when(swap, F.col("wx")).otherwise(F.col("wy"))).alias("wins_b"))
    names = catalog.select(fold_name(F.col("variant")).alias("n")).filter("n IS NOT NULL").distinct()
    return pairs.join(names.withColumnRenamed("n", "a"), "a", "left_semi").join(names.withColumnRenamed("n", "b"), "b", "left_semi").filter("wins_a + wins_b > 0")


def edges(pairs: DataFrame) -> DataFrame:
    """a, b, y, weight of each pair, over all sources of votes."""
    s = pairs.groupBy("a", "b").agg(F.sum("wins_a").alias("p"), F.sum("wins_b").alias("q"))
    p, q = F.col("p") + HALF, F.col("q") + HALF
    return s.select("a", "b", F.log(p / q).alias("y"), (p * q / (p + q)).alias("weight"), (F.col("p") + F.col("q")).alias("n"))


def unconverged(rr: float, r0: float) -> bool:
    """The stop rule of both solvers: the residual's norm against the right side's."""
    return rr > TOLERANCE**2 * max(r0, 1e-300)


def solve_small(a: np.ndarray, b: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, ridge: float) -> tuple[np.ndarray, float]:
    """Conjugate gradient on (L + ridge I) s = B' W y: (s, relative residual)."""
    rhs = np.bincount(a, w * y, n) - np.bincount(b, w * y, n)
    deg = np.bincount(a, w, n) + np.bincount(b, w, n) + ridge
    apply = lambda v: deg * v - np.bincount(a, w * v[b], n) - np.bincount(b, w * v[a], n)
    s, r = np.zeros(n), rhs.copy()
    p, rz, r0 = r / deg, r @ (r / deg), float(rhs @ rhs)
    for _ in range(most_steps(n)):
        if not unconverged(float(r @ r), r0):
            break
        q = apply(p)
        step = rz / (p @ q)
        s, r = s + step * p, r - step * q
        rz, old = r @ (r / deg), rz
        p = r / deg + rz / old * p
    return s, float(np.sqrt(r @ r / r0)) if r0 else 0.0


def solve_large(e: DataFrame, items: DataFrame, ridge: float) -> tuple[DataFrame, float]:
    """The same by sparse joins: the vectors are columns of a table keyed by item; a step is one join, one aggregation and one row of sums."""
    sym = cut(e.select("a", "b", "weight").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    deg = sym.groupBy("a").agg(F.sum("weight").alias("d")).withColumnRenamed("a", "item")
    rhs = e.select(F.col("a").alias("item"), (F.col("weight") * F.col("y")).alias("v")).unionByName(e.select(F.col("b").alias("item"), (-F.col("weight") * F.col("y")).alias("v"))).groupBy("item").agg(F.sum("v").alias("r"))
    st = items.join(deg, "item", "left").join(rhs, "item", "left").fillna(0.0, ["d", "r"]).withColumn("d", F.col("d") + ridge)
    st = cut(st.select("item", "d", F.lit(0.0).alias("s"), "r", (F.col("r") / F.col("d")).alias("p")))
    n, rz, r0 = st.agg(F.count("*"), F.sum(F.col("r") ** 2 / F.col("d")), F.sum(F.col("r") ** 2)).first()
    rr = r0 = r0 or 0.0
    for _ in range(most_steps(n)):
        if not unconverged(rr, r0):
            break
        pulled = sym.join(st.select(F.col("item").alias("b"), F.col("p").alias("pb")), "b").groupBy("a").agg(F.sum(F.col("weight") * F.col("pb")).alias("m")).withColumnRenamed("a", "item")
        st = cut(st.join(pulled, "item", "left").withColumn("q", F.col("d") * F.col("p") - F.coalesce("m", F.lit(0.0))).drop("m"))
        step = rz / st.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        st = st.withColumn("s", F.col("s") + step * F.col("p")).withColumn("r", F.col("r") - step * F.col("q")).drop("q")
        new, rr = st.agg(F.sum(F.col("r") ** 2 / F.col("d")), F.sum(F.col("r") ** 2)).first()
        st = st.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p"))
        rz = new
    return st.select("item", F.col("s").alias("strength")), float(np.sqrt(rr / r0)) if r0 else 0.0


def strengths(e: DataFrame, items: DataFrame, ridge: float = RIDGE, small: int = SMALL) -> DataFrame:
    """item, strength (mean zero over all items), residual (the solver's, relative, the same in all rows) for items(item). Raises if
    the solver doesn't reach TOLERANCE."""
    spark = e.sparkSession
    e = cut(e)
    if e.limit(small + 1).count() <= small and items.limit(small + 1).count() <= small:
        names = [r.item for r in items.orderBy("item").collect()]
        at = {n: i for i, n in enumerate(names)}
        rows = e.collect()
        a, b = (np.array([at[r[k]] for r in rows], np.int64) for k in ("a", "b"))
        s, left = solve_small(a, b, np.array([r.y for r in rows], float), np.array([r.weight for r in rows], float), len(names), ridge) if rows else (np.zeros(len(names)), 0.0)
        out = spark.createDataFrame([(n, float(v)) for n, v in zip(names, s, strict=True)], "item string, strength double")
    else:
        out, left = solve_large(e, items, ridge)
    if left > TOLERANCE:
        raise ArithmeticError(f"the solver stopped at a relative residual of {left:g}")
    mean = out.agg(F.avg("strength").alias("m"))
    return out.join(F.broadcast(mean)).select("item", (F.col("strength") - F.col("m")).alias("strength"), F.lit(left).alias("residual"))  # one row


def rank(pairwise: DataFrame, totals: DataFrame, catalog: DataFrame, small: int = SMALL) -> DataFrame:
    """variant, rank_pos, strength, n_votes, n_opponents, residual."""
    e = cut(edges(votes(pairwise, totals, catalog)))
    items = catalog.select(fold_name(F.col("variant")).alias("item")).filter("item IS NOT NULL").distinct()
    s = strengths(e, items, small=small)
    met = e.select(F.col("a").alias("item"), "n").unionByName(e.select(F.col("b").alias("item"), "n")).groupBy("item").agg(F.sum("n").alias("n_votes"), F.count("*").alias("n_opponents"))
    placed = positions(s, [F.desc(F.round("strength", 9)), F.asc("item")], "rank_pos", 1)
    return placed.join(met, "item", "left").fillna(0, ["n_votes", "n_opponents"]).select(F.col("item").alias("variant"), F.col("rank_pos").cast("int").alias("rank_pos"), "strength", "n_votes", "n_opponents", "residual")


def inconsistency(pairwise: DataFrame, totals: DataFrame, catalog: DataFrame) -> DataFrame:
    """a, b, n, margin, fitted, residual, weighted_share: what each pair adds to the cyclic inconsistency."""
    e = cut(edges(votes(pairwise, totals, catalog)))
    items = catalog.select(fold_name(F.col("variant")).alias("item")).filter("item IS NOT NULL").distinct()
    s = cut(strengths(e, items))
    r = e.join(s.select(F.col("item").alias("a"), F.col("strength").alias("sa")), "a").join(s.select(F.col("item").alias("b"), F.col("strength").alias("sb")), "b")
    r = r.select("a", "b", "n", F.col("y").alias("margin"), (F.col("sa") - F.col("sb")).alias("fitted"), (F.col("y") - F.col("sa") + F.col("sb")).alias("residual"), "weight")
    all_ = r.agg(F.sum(F.col("weight") * F.col("residual") ** 2).alias("t"))
    return r.join(F.broadcast(all_)).select("a", "b", "n", "margin", "fitted", "residual", (F.col("weight") * F.col("residual") ** 2 / F.col("t")).alias("weighted_share"))
