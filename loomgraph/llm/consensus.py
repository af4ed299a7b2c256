"""Consensus from several annotators' labels: spectral reliability.

Every annotator of a packet gives up to two signals: the vote (from whichever preference column still holds it) and the sign of
the difference of the two answers' scores. Each annotator's votes and scores are two raters with reliabilities of their own.

A rater's answer is a one-hot vector over {hi, other, tie} less the rater's own class shares, so agreement is centred by
chance and a rater who always gives the same answer agrees with nobody. The reliabilities r are, up to a factor, the leading
eigenvector of the matrix A of summed centred agreements, normalised by overlap counts, D^-1/2 A D^-1/2, found by power
iteration; the factor comes from the eigenvalue. One pass then corrects each r by the reliabilities of those the rater did overlap
with: r(i) = sum over j of n(ij) c(ij) r(j) / (k sum over j of n(ij) r(j)^2), where n(ij) counts common packets. The matrix is
never written out: a step joins the ratings with the raters and adds up by packet, then joins with the packets' sums and adds up
by rater, so neither a packet of very many annotators nor many annotators give pairs. A rater who votes against the truth gets a
negative r, and its votes count so.

Consensus: the choice of largest sum of log-odds weights ln((1 + 2r) / (1 - r)). Agreement: the share of a packet's votes for
its most frequent choice, and the weighted share for the consensus.

Defined results: exact duplicate rows count once; a packet's annotator with contradicting rows counts as the least of them;
a null annotator is an annotator of its own; unknown words in a preference column are no vote; scores above 1 are percent,
negative ones missing; a packet without any signal, and one whose sums are equal for all choices, is a tie; of equal sums the
choice of more plain votes wins, then hi, then the other, then the tie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import fold_name, strip
from loomgraph.session import written

#: Words for a tie, after folding (fixed by the export's spellings and their like).
TIES = ("tie", "both", "equal", "same", "draw", "neither", "even")
STEPS, TOLERANCE, SHRINK = 60, 3e-3, 5.0
#: Added to the diagonal, so that the largest eigenvalue is the one of largest size.
SHIFT = 0.02
LOW, HIGH = -0.45, 0.97
K = ("hi", "other", "tie")


def letter(c: Column) -> Column:
    """'a', 'b', 'tie' or null from any spelling of a label."""
    x = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z]+", ""), "^answer", "")
    return F.when(x.isin("a", "b"), x).when(x.isin(*TIES), "tie")


def score(c: Column) -> Column:
    return F.when(F.isnan(c) | (c < 0), None).when(c > 1, F.when(c <= 100, c / 100)).otherwise(c)


def ratings(df: DataFrame) -> DataFrame:
    """packet_id, pair, other, annotator, vote, by_score (each 'hi', 'other', 'tie' or null): one row an annotator of a packet."""
    pair = F.split(F.regexp_replace(fold_name(F.col("comparison_pair")), "_+vs_+", "|"), r"\|")
    x = df.filter("packet_id IS NOT NULL").select(
        F.col("packet_id").cast("bigint").alias("packet_id"),
        F.when(F.get(pair, F.lit(0)) == "hi", F.get(pair, F.lit(1))).otherwise(F.get(pair, F.lit(0))).alias("other"),
        F.coalesce(fold_name(F.col("annotator_id")), F.lit("")).alias("annotator"),
        fold_name(F.col("variant")).alias("v"), letter(F.col("label")).alias("l"),
        letter(F.col("preferred_label")).alias("pl"), fold_name(F.col("preferred_variant")).alias("pv"), letter(F.col("raw_preferred_answer")).alias("pr"),
        F.col("is_preferred_win").alias("w"), score(F.col("answers_question_score")).alias("q"),
    )
    hi = F.col("v") == "hi"
    g = x.groupBy("packet_id", "annotator").agg(
        F.min("other").alias("other"), F.min("pl").alias("pl"), F.min("pv").alias("pv"), F.min("pr").alias("pr"),
        F.min(F.when(hi, F.col("l"))).alias("lh"), F.min(F.when(~hi, F.col("l"))).alias("lo"),
        F.min(F.when(hi, F.col("w"))).alias("wh"), F.min(F.when(~hi, F.col("w"))).alias("wo"),
        F.min(F.when(hi, F.col("q"))).alias("qh"), F.min(F.when(~hi, F.col("q"))).alias("qo"),
    )
    flip = lambda c: F.when(c == "a", "b").when(c == "b", "a")
    at_hi = F.coalesce("lh", flip(F.col("lo")))
    side = lambda c: F.when(F.col(c) == "tie", "tie").when(F.col(c) == at_hi, "hi").when(F.col(c) == flip(at_hi), "other")
    named = F.when(F.col("pv").isin(*TIES), "tie").when(F.col("pv") == "hi", "hi").when(F.col("pv").isNotNull(), "other")
    won = F.coalesce("wh", 1 - F.col("wo"))
    flag = F.when(won == 1, "hi").when(won == 0, "other").when(won == 0.5, "tie")
    diff = F.col("qo") - F.col("qh")
    return g.select("packet_id", "other", "annotator", F.coalesce(side("pl"), named, side("pr"), flag).alias("vote"), F.when(diff > 0, "other").when(diff < 0, "hi").when(diff == 0, "tie").alias("by_score"))


def channels(r: DataFrame) -> DataFrame:
    """packet_id, rater, k: a row for each signal. The rater is the annotator and the kind of signal."""
    kinds = F.array(F.struct(F.lit("vote").alias("kind"), F.col("vote").alias("k")), F.struct(F.lit("score").alias("kind"), F.col("by_score").alias("k")))
    return r.select("packet_id", "annotator", F.explode(kinds).alias("x")).select("packet_id", F.struct("annotator", "x.kind").alias("rater"), F.col("x.k").alias("k")).filter("k IS NOT NULL")


def _product(sig: DataFrame, q: DataFrame, x: str) -> DataFrame:
    """rater, and the products of the raters' centred agreement matrix A (zero diagonal) with the column x of q, of the overlap counts with
    ones and with the squares of x: ax, n1, nxx. By packet sums, so that no pair of raters is written out."""
    full = sig.join(q.select("rater", *[f"q_{k}" for k in K], F.col(x).alias("x")), "rater")
    v = [(F.col("k") == k).cast("double") - F.col(f"q_{k}") for k in K]
    sums = full.groupBy("packet_id").agg(*[F.sum(F.col("x") * c).alias(f"s_{k}") for k, c in zip(K, v, strict=True)], F.sum(F.col("x") ** 2).alias("xx"), F.count("*").alias("m"))
    own = sum((c * (F.col(f"s_{k}") - F.col("x") * c) for k, c in zip(K, v, strict=True)), F.lit(0.0))
    return full.join(sums, "packet_id").groupBy("rater").agg(F.sum(own).alias("ax"), F.sum(F.col("m") - 1).alias("n1"), F.sum(F.col("xx") - F.col("x") ** 2).alias("nxx"))


def reliabilities(sig: DataFrame, steps: int = STEPS) -> DataFrame:
    """rater, r, n, turned: the sine of the angle by which the vector still turned in the last step, the same in all rows; above TOLERANCE
    the power iteration hadn't settled after `steps` steps. sig is best written before."""
    n = sig.count()
    q = sig.groupBy("rater").agg(F.count("*").alias("n"), *[F.avg((F.col("k") == k).cast("double")).alias(f"q_{k}") for k in K])
    if not n:
        return q.select("rater", F.lit(0.0).alias("r"), "n", F.lit(0.0).alias("turned"))
    share = sig.groupBy("k").count().collect()  # three rows
    kappa = max(0.05, 1 - sum((x["count"] / n) ** 2 for x in share))
    # D^-1/2 A D^-1/2 with D the overlap counts (SHRINK added) is a fixed symmetric matrix; y = D^-1/2 u is iterated in place of u.
    d = _product(sig, q.withColumn("one", F.lit(1.0)), "one").select("rater", (F.col("n1") + SHRINK).alias("d"))
    q = written(q.join(d, "rater").withColumn("y", 1 / F.sqrt(F.col("d"))), "raters")
    total = q.agg(F.sum("d")).first()[0]
    turned, size, zz = 1.0, 0.0, None
    for _ in range(steps):
        moved = F.coalesce("ax", F.lit(0.0)) / F.col("d") + SHIFT * F.col("y")
        z = written(q.join(_product(sig, q, "y").select("rater", "ax"), "rater", "left").withColumn("z", moved).drop("ax"), "raters")
        yy, yz, zz = z.agg(F.sum(F.col("d") * F.col("y") ** 2), F.sum(F.col("d") * F.col("y") * F.col("z")), F.sum(F.col("d") * F.col("z") ** 2)).first()
        if not zz:
            break
        size, turned = yz / yy - SHIFT, max(0.0, 1 - yz**2 / (yy * zz)) ** 0.5
        q = z.withColumn("y", F.col("z") / float(np.sqrt(zz))).drop("z")
        if turned < TOLERANCE:
            break
    # The eigenvector gives reliabilities up to a factor, which the eigenvalue gives; then one correction by each rater's own overlaps.
    scale = float(np.sqrt(max(size, 0.0) * total / kappa)) if zz else 0.0
    q = written(q.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("y") * scale))), "raters")
    new = _product(sig, q, "r").select("rater", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ax") / (kappa * (F.col("nxx") + SHRINK)))).alias("new"))
    q = written(q.join(new, "rater", "left").select("rater", "n", F.coalesce("new", F.lit(0.0)).alias("r")), "raters")
    # Ties in direction are broken towards a positive sum: most raters are taken to be honest.
    flip = q.agg(F.sum("r")).first()[0]
    return q.select("rater", "n", (F.col("r") * (1 if flip is None or flip >= 0 else -1)).alias("r"), F.lit(float(turned)).alias("turned"))


def solve(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratings, signals, reliabilities)."""
    r = written(ratings(df), "ratings")
    sig = written(channels(r), "signals")
    return r, sig, reliabilities(sig)


def weight(r: Column) -> Column:
    c = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), r))
    return F.log((1 + 2 * c) / (1 - c))


def packets(df: DataFrame) -> DataFrame:
    """packet_id, consensus_choice, n_votes, agreement, weighted_agreement, margin."""
    r, sig, rel = solve(df)
    w = sig.join(rel.select("rater", weight(F.col("r")).alias("w")), "rater")
    vote = F.col("rater.kind") == "vote"
    sums = w.groupBy("packet_id").agg(
        *[F.sum(F.when(F.col("k") == k, F.col("w")).otherwise(0.0)).alias(f"w_{k}") for k in K],
        *[F.count_if(vote & (F.col("k") == k)).alias(f"n_{k}") for k in K],
        F.sum(F.abs("w")).alias("all"),
    )
    order = [F.struct(F.round(F.col(f"w_{k}"), 9).alias("w"), F.col(f"n_{k}").alias("n"), F.lit(-i).alias("p"), F.lit(k).alias("k")) for i, k in enumerate(K)]
    best = F.greatest(*order)
    votes = sum((F.col(f"n_{k}") for k in K), F.lit(0))
    flat = (F.abs(F.col("w_hi") - F.col("w_other")) < 1e-9) & (F.abs(F.col("w_hi") - F.col("w_tie")) < 1e-9) & (F.greatest("n_hi", "n_other", "n_tie") == F.least("n_hi", "n_other", "n_tie"))
    second = F.element_at(F.sort_array(F.array(*[F.col(f"w_{k}") for k in K]), False), 2)
    per = sums.select("packet_id", F.when(flat, "tie").otherwise(best["k"]).alias("c"), votes.alias("n_votes"), F.when(votes > 0, F.greatest("n_hi", "n_other", "n_tie") / votes).alias("agreement"), F.when(F.col("all") > 0, F.greatest(F.lit(0.0), best["w"]) / F.col("all")).alias("weighted_agreement"), (best["w"] - second).alias("margin"))
    every = r.groupBy("packet_id").agg(F.min("other").alias("other"))
    out = every.join(per, "packet_id", "left")
    choice = F.when(F.col("c") == "hi", "hi").when((F.col("c") == "other") & F.col("other").isNotNull(), F.col("other")).otherwise("tie")
    return out.select("packet_id", choice.alias("consensus_choice"), F.coalesce("n_votes", F.lit(0)).cast("bigint").alias("n_votes"), "agreement", "weighted_agreement", "margin")


def annotators(df: DataFrame) -> DataFrame:
    """annotator, reliability (of the votes), score_reliability, n_votes, n_scores, turned (see reliabilities)."""
    _, _, rel = solve(df)
    k = F.col("rater.kind")
    return rel.groupBy(F.col("rater.annotator").alias("annotator")).agg(F.max(F.when(k == "vote", F.col("r"))).alias("reliability"), F.max(F.when(k == "score", F.col("r"))).alias("score_reliability"), F.coalesce(F.max(F.when(k == "vote", F.col("n"))), F.lit(0)).alias("n_votes"), F.coalesce(F.max(F.when(k == "score", F.col("n"))), F.lit(0)).alias("n_scores"), F.max("turned").alias("turned"))


def found(df: DataFrame) -> DataFrame:
    return packets(df).select("packet_id", "consensus_choice")
