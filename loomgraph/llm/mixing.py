"""Mixing sources to target weights: hierarchical budgeting.

The leaves of the tree domain > language > source are the combinations that occur. A leaf's weight is its part, by tokens, of
its source's target share; weights are propagated to the root. The budget goes down the tree by weight. A leaf can give at most
its tokens x max_repeats; what it can't take is shared among its siblings by weight, as far as they can take it, before the rest
goes up to the parent's siblings, and so on. Each leaf then takes a token-prefix of a seeded sequence of epochs: all its documents
in a random order, then all again in another one, until its budget is reached.

The total is stated: all tokens of the targets' documents unless another is given. With it, sources that are too small for their share
even when repeated fall short, and the others of their branch take over; the report sets reached shares against targets. With `exact`
the total is small enough for every share to be reached.

The tree has as many nodes as targets have domains and languages, so it is solved on the driver; the documents never leave the
executors. The running token sums over a leaf (which may hold a third of all rows) are two-level: per hash bucket, then inside a bucket.

Defined results: rows of a null source or one without a target aren't used; a target of null or no positive weight counts as
0, max_repeats null or below 1 as 1 and 0; a source repeated in the targets takes its largest share and repeats; documents
without tokens are never taken; a target source without documents is reported with share 0. A document is taken whole: a
leaf misses its budget by at most half of the document at its edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.functions.text import strip
from loomgraph.llm.tokenizing import encode
from loomgraph.session import written

SEED = 17
BUCKETS = 512


def fold(c):
    return F.lower(strip(c))


@dataclass
class Node:
    name: str
    weight: float = 0.0
    room: float = 0.0
    given: float = 0.0
    children: list[Node] = field(default_factory=list)

    def total(self) -> None:
        for c in self.children:
            c.total()
        if self.children:
            self.weight, self.room = sum(c.weight for c in self.children), sum(c.room for c in self.children)

    def fill(self, amount: float) -> None:
        """Hand down at most room; shortages of a child go to its siblings by weight first."""
        self.given = min(amount, self.room)
        open_, left = [c for c in self.children if c.weight > 0 and c.room > 0], self.given
        share = {id(c): 0.0 for c in self.children}
        while open_ and left > 1e-9 * max(1.0, self.given):
            w = sum(c.weight for c in open_)
            short = [c for c in open_ if share[id(c)] + left * c.weight / w >= c.room]
            if not short:
                for c in open_:
                    share[id(c)] += left * c.weight / w
                break
            for c in short:
                left -= c.room - share[id(c)]
                share[id(c)] = c.room
            open_ = [c for c in open_ if c not in short]
        for c in self.children:
            c.fill(share[id(c)])


def build_tree(leaves: list[dict]) -> Node:
    root = Node("")
    for x in leaves:
        at = root
        for name in (x["domain"], x["language"]):
            nxt = next((c for c in at.children if c.name == name), None)
            if nxt is None:
                nxt = Node(name)
                at.children.append(nxt)
            at = nxt
        at.children.append(Node(x["source"], x["weight"], x["room"] if x["weight"] > 0 else 0.0))
    root.total()
    return root


def exact_total(leaves: list[dict]) -> float:
    """The largest total with which every source that has documents reaches its share of it exactly."""
    alive = [x for x in leaves if x["weight"] > 0 and x["room"] > 0]
    scale = sum(x["weight"] for x in alive)
    return min((x["room"] * scale / x["weight"] for x in alive), default=0.0)


def budgets(leaves: list[dict], total: float | None = None) -> dict[tuple[str, str, str], float]:
    """Tokens for each leaf (source, domain, language). total defaults to the tokens of all leaves of positive weight."""
    root = build_tree(leaves)
    root.fill(sum(x["tokens"] for x in leaves if x["weight"] > 0) if total is None else total)
    return {(leaf.name, domain.name, language.name): leaf.given for domain in root.children for language in domain.children for leaf in language.children}


def leaves_of(docs: DataFrame, targets: DataFrame) -> list[dict]:
    """One leaf for each source, domain and language that occur together, with its part of the source's share by tokens, its tokens and
    its room; a target without documents is a leaf without room. docs: source, domain, language, n_tokens."""
    t = targets.groupBy(fold(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source IS NOT NULL")
    by = docs.groupBy("source", "domain", "language").agg(F.sum("n_tokens").alias("tokens"))
    rows = t.join(by, "source", "left").collect()  # a row for each target, domain and language
    whole: dict[str, int] = {}
    for r in rows:
        whole[r.source] = whole.get(r.source, 0) + (r.tokens or 0)
    out = []
    for r in sorted(rows, key=lambda r: (r.domain or "", r.language or "", r.source)):
        share, repeats, tokens = max(0.0, r.share or 0.0), max(0, 1 if r.repeats is None else r.repeats), r.tokens or 0
        part = tokens / whole[r.source] if whole[r.source] else 1.0
        out.append({"source": r.source, "domain": r.domain or "", "language": r.language or "", "share": share, "weight": share * part, "repeats": repeats, "tokens": tokens, "room": float(tokens * repeats)})
    return out


def prepared(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, domain, language, n_tokens of the documents whose source has a target."""
    names = [r[0] for r in targets.select(fold(F.col("source"))).distinct().collect() if r[0] is not None]  # one a target
    text = documents.select("doc_id", "text", fold(F.col("source")).alias("source"), F.coalesce(fold(F.col("dataset")), F.lit("")).alias("domain"), F.coalesce(F.regexp_extract(fold(F.col("lang")), "^[a-z]{2,3}", 0), F.lit("")).alias("language"))
    return written(encode(text.filter(F.col("source").isin(names)), counts_only=True, keep=("source", "domain", "language")).filter("n_tokens > 0"), "counted")


LEAF = ["source", "domain", "language"]


def select(docs: DataFrame, leaves: list[dict], given: dict, seed: int = SEED) -> DataFrame:
    """source, epoch, doc_id, n_tokens of every copy taken: the token-prefix of each leaf's epochs that comes nearest to its
    budget (the document at the edge is taken if more than half of it fits)."""
    spark = docs.sparkSession
    plan = []
    for x in leaves:
        leaf = tuple(x[k] for k in LEAF)
        if x["tokens"] and given.get(leaf, 0) > 0:
            full = min(int(given[leaf] // x["tokens"]), x["repeats"])
            rest = float(given[leaf] - full * x["tokens"]) if full < x["repeats"] else 0.0
            plan.append((*leaf, full, rest))
    epochs = spark.createDataFrame(plan, T.StructType([*[T.StructField(k, T.StringType()) for k in LEAF], T.StructField("full", T.IntegerType()), T.StructField("budget", T.DoubleType())]))
    all_ = docs.join(epochs, LEAF)
    whole = all_.filter("full > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "doc_id", "n_tokens")
    part = all_.filter("budget > 0").withColumn("h", F.xxhash64(F.lit(seed), "full", "doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 64 - (BUCKETS - 1).bit_length()))
    sums = part.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"))
    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket")) - F.col("n")).drop("n")  # at most BUCKETS rows a leaf
    inside = Window.partitionBy(*LEAF, "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = part.join(ahead, [*LEAF, "bucket"]).withColumn("reached", F.col("ahead") + F.sum("n_tokens").over(inside)).filter(F.col("reached") - F.col("n_tokens") / 2 <= F.col("budget"))
    return whole.unionByName(part.select("source", F.col("full").alias("epoch"), "doc_id", "n_tokens"))


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, exact: bool = False, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(what was taken, the report). The total is given in tokens, or all tokens of the targets' documents; with exact it is the largest
    with which all shares are reached. The report has source, target_share, budget_tokens, tokens, copies, epochs, actual_share."""
    docs = prepared(documents, targets)
    leaves = leaves_of(docs, targets)
    given = budgets(leaves, exact_total(leaves) if exact else total)
    taken = select(docs, leaves, given, seed)
    spark, sources = documents.sparkSession, {x["source"]: [x["share"], 0.0, 0] for x in leaves}
    for x in leaves:
        sources[x["source"]][1] += given.get(tuple(x[k] for k in LEAF), 0.0)
        sources[x["source"]][2] += x["tokens"]
    base = spark.createDataFrame([(k, *v) for k, v in sources.items()], "source string, target_share double, budget_tokens double, own_tokens bigint")
    sums = taken.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), (F.max("epoch") + 1).cast("bigint").alias("epochs"))
    out = base.join(sums, "source", "left").fillna(0, ["tokens", "copies", "epochs"])
    all_ = F.sum("tokens").over(Window.partitionBy())  # over one row a target
    return taken, out.withColumn("actual_share", F.when(all_ > 0, F.col("tokens") / all_).otherwise(0.0))
