"""Mixing sources to target weights, with a capped number of repeats.

The weights form a tree of domains, languages and sources. A source's target share is spread over its languages in
proportion to their tokens. Budgets flow from the root to the leaves; a child that cannot use its part, even with all
repeats allowed, leaves the rest to its siblings, in proportion to their weights, and only what no sibling can take goes
to the level above. Each leaf then takes as many whole epochs of its documents as its budget holds, and of the next epoch
a prefix in a seeded order, up to its budget.

Without a given total the mix is as large as it can be with every share reached exactly.

Defined results: sources without tokens get nothing, and their weight goes to the others; null and empty texts have no
tokens and come as often as their leaf has whole epochs, so never more often than allowed; rows of no target source are left out; repeated rows are documents of their own;
ties of the seeded order go to the lower id; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.dimensions import small
from ..sources.scratch import materialize
from . import tokens as _tokens

SEED = 20_240_229
#: Buckets of the seeded order within a leaf: only single buckets are ever sorted.
BUCKETS = 4096


@dataclass
class Node:
    """A node of the weight tree; a leaf has a capacity of its own, other nodes that of their children."""

    weight: float = 0.0
    own_capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def add(self, path: tuple[str, ...], weight: float, capacity: float) -> None:
        self.weight += weight
        self.own_capacity += capacity
        if path:
            self.children.setdefault(path[0], Node()).add(path[1:], weight, capacity)

    def spend(self, budget: float) -> None:
        """Give ``budget`` to the subtree: by weight, what one child cannot take to its siblings."""
        self.budget = min(budget, self.own_capacity)
        left, open_children = self.budget, [c for c in self.children.values() if c.weight > 0]
        while open_children and left > 0:
            whole = sum(c.weight for c in open_children)
            full = [c for c in open_children if c.own_capacity <= left * c.weight / whole]
            if not full:
                for c in open_children:
                    c.spend(left * c.weight / whole)
                return
            for c in full:
                c.spend(c.own_capacity)
                left -= c.own_capacity
            open_children = [c for c in open_children if c not in full]

    def leaves(self, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
        if not self.children:
            return {path: self.budget}
        return {p: b for name, c in self.children.items() for p, b in c.leaves((*path, name)).items()}


def plan(leaves: list[tuple[tuple[str, ...], float]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[tuple[str, ...], float]:
    """Budgets in tokens for (path, tokens) of every leaf; a path ends in its source. ``targets``: share and most repeats."""
    have: dict[str, float] = {}
    for path, n in leaves:
        have[path[-1]] = have.get(path[-1], 0) + n
    usable = {s: t for s, t in targets.items() if have.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return {}
    if total is None:
        total = min(repeats * have[s] * whole / share for s, (share, repeats) in usable.items())
    root = Node()
    for path, n in leaves:
        if path[-1] in usable and n > 0:
            share, repeats = usable[path[-1]]
            root.add(path, share / whole * n / have[path[-1]], repeats * n)
    root.spend(total)
    return root.leaves()


def language(lang: Column) -> Column:
    """The primary subtag in lower case, 'und' where there is none: a bounded number of languages."""
    found = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    return F.when(lang.isNull() | (found == ""), "und").otherwise(found)


def counted(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", domain: Column | None = None, ranks: str = _tokens.DEFAULT_RANKS) -> DataFrame:
    """(id, domain, language, source, n_tokens) of the documents of the target sources, as a written table."""
    wanted = docs.join(small(targets.select(F.col("source").alias(source_col)).distinct()), source_col, "left_semi")
    keyed = wanted.select(F.struct(F.col(id_col).alias("id"), (domain if domain is not None else F.lit("all")).alias("domain"), language(F.col(lang_col)).alias("language"), F.col(source_col).alias("source")).alias("key"), text_col)
    return materialize(_tokens.count_tokens(keyed, "key", text_col, ranks=ranks).select("key.*", "n_tokens"), "mix-tokens")


def mix(sized: DataFrame, targets: DataFrame, *, total: float | None = None, seed: int = SEED) -> DataFrame:
    """(id, source, language, n_tokens, copies): how often each document is used, for documents used at all."""
    rules = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").collect()}
    path = ("domain", "language", "source")
    stats = {tuple(r[c] for c in path): float(r["n"]) for r in sized.groupBy(*path).agg(F.sum("n_tokens").alias("n")).collect()}
    budgets = plan(list(stats.items()), rules, total)
    spark = sized.sparkSession
    shares = []
    for p, b in budgets.items():
        if stats[p] > 0:
            epochs = min(int(b / stats[p] + 1e-9), rules[p[-1]][1])
            shares.append((*p, epochs, max(0.0, b - epochs * stats[p]) if epochs < rules[p[-1]][1] else 0.0))
    leaf = spark.createDataFrame(shares, "domain string, language string, source string, epochs int, rest double")
    place = F.xxhash64(F.col("id"), F.col("source"), F.lit(seed), F.col("epochs"))
    # One row a leaf, of which there are as many as sources times languages.
    rows = sized.join(F.broadcast(leaf), list(path)).withColumn("place", place).withColumn("bucket", F.shiftrightunsigned("place", 52).cast("int"))
    sums = rows.groupBy(*path, "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*path, "bucket", "start")
    within = Window.partitionBy(*path, "bucket").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(starts, [*path, "bucket"]).withColumn("end", F.col("start") + F.sum("n_tokens").over(within))
    # A document without tokens fills no budget: it comes with the whole epochs only.
    placed = placed.withColumn("inside", (F.col("n_tokens") > 0) & (F.col("end") <= F.col("rest"))).withColumn("astride", (F.col("n_tokens") > 0) & ~F.col("inside") & (F.col("end") - F.col("n_tokens") < F.col("rest")))
    placed = materialize(placed.select("id", *path, "n_tokens", "epochs", "end", "inside", "astride"), "mix-places")
    taken = spark.createDataFrame(_astride(placed, shares, path), "domain string, language string, source string, end bigint, more int")
    placed = placed.join(F.broadcast(taken), [*path, "end"], "left")
    copies = F.col("epochs") + F.when(F.col("inside") | (F.col("astride") & F.col("more").isNotNull()), 1).otherwise(0)
    return placed.select("id", "source", "language", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def nearest_subset(sizes: list[int], wanted: float) -> list[int]:
    """The places of sizes whose sum is nearest to ``wanted``, the lesser of two sums as near: bit k of a number says whether
    the sizes so far can make k, so that every subset is weighed, however many there are."""
    reach = [1]
    for size in sizes:
        reach.append(reach[-1] | reach[-1] << size)
    bits, low = reach[-1], max(0, math.floor(wanted))
    below = (bits & ((1 << (low + 1)) - 1)).bit_length() - 1
    above = bits >> (low + 1)
    best = below if not above or wanted - below <= low + (above & -above).bit_length() - wanted else low + (above & -above).bit_length()
    chosen = []
    for k in range(len(sizes) - 1, -1, -1):
        if not reach[k] >> best & 1:
            chosen.append(k)
            best -= sizes[k]
    return chosen[::-1]


def _astride(placed: DataFrame, shares: list[tuple], path: tuple[str, ...]) -> list[tuple]:
    """Of the documents that stand astride their leaf's budget, at most one a leaf, those that bring each source nearest to its own."""
    inside = {r["source"]: r["n"] for r in placed.filter("inside").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rest: dict[str, float] = {}
    for *_, source, _, left in shares:
        rest[source] = rest.get(source, 0.0) + left
    by_source: dict[str, list] = {}
    for r in placed.filter("astride").select(*path, "end", "n_tokens").collect():
        by_source.setdefault(r["source"], []).append(r)
    chosen = []
    for source, rows in by_source.items():
        rows.sort(key=lambda r: (-r["n_tokens"], *(r[c] for c in path)))
        chosen += [rows[k] for k in nearest_subset([r["n_tokens"] for r in rows], rest[source] - inside.get(source, 0))]
    return [(*(r[c] for c in path), r["end"], 1) for r in chosen]


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, reached_share, n_documents, most_copies) for every target source."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    rows = targets.join(used, "source", "left").select("source", "target_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "n_documents", "most_copies")))
    # One row a target, put side by side to have their sum.
    whole = rows.agg(F.sum("tokens").alias("whole"), F.collect_list(F.struct(*rows.columns)).alias("rows")).select("whole", F.explode("rows").alias("r"))
    return whole.select("r.source", "r.target_share", "r.tokens", F.when(F.col("whole") > 0, F.col("r.tokens") / F.col("whole")).otherwise(0.0).alias("reached_share"), "r.n_documents", "r.most_copies")
