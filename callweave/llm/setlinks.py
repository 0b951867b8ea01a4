"""Which of many distinct sets are similar: banded candidates, exact comparison, groups by union-find.

Sets that share a band meet in its group.  A group is compared with a leader for
some rounds, and what is linked by then is one component.  Groups that still hold
several components go to an exact prefix join: with elements ordered from rare to
frequent, two sets that are similar enough share one of their first elements, in a
part of each set that shrinks with the similarity asked for.  A template that many
texts share is frequent, so texts which are alike in the template only never meet
there, and copies, which are one component by then, are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, meet
from .components import components

#: Rounds with leaders, and rows of a key that meet one copy of what they are joined with.
ROUNDS, ASKERS = 2, 1024
ALIKE = 1000


class UnionFind:
    """Least member of each group of what was joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, k: int) -> int:
        up = self.up
        while (over := up.setdefault(k, k)) != k:
            up[k] = up[over]
            k = over
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same nodes, one for each node of an Arrow batch at most: each batch's links go through a union-find."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            groups = UnionFind()
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                groups.join(a, b)
            ends = [(k, r) for k in list(groups.up) if (r := groups.find(k)) != k]
            pairs = np.array(ends, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def grouped(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges: union-find inside each batch, then stars over the batches."""
    return as_table(components(contracted(edges)), "roots")


def similar(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, items) are at least so similar: shared elements through all distinct ones."""
    sizes = as_table(pairs.groupBy("b").agg(F.count("*").alias("n")), "asked")
    right = sizes.join(sets.select(F.col("node").alias("b"), F.col("items").alias("right")), "b")
    both = meet(pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("left")), "a"), right, "b", "a", ASKERS)
    shared = F.size(F.array_intersect("left", "right"))
    found = both.select("a", "b", shared.alias("s"), (F.size("left") + F.size("right")).alias("t"))
    return found.where(F.col("s") * ALIKE >= (F.col("t") - F.col("s")) * round(at_least * ALIKE)).select("a", "b")


def prefix_pairs(sets: DataFrame, labels: DataFrame, at_least: float) -> DataFrame:
    """Pairs (a, b) with different labels, all that can be so similar among them: sets (node, items), labels (node, label).

    The smaller set of a pair shows n - ceil(2t n / (1 + t)) + 1 of its rarest
    elements, the larger one n - ceil(t n) + 1; without one in common the sets are
    less similar than t.  Of a shared element's place in both follows how many more
    they can share; pairs that cannot reach t are left out.
    """
    t = round(at_least * ALIKE)
    up = lambda x, y: F.expr(f"({x} + {y} - 1) div {y}")
    own = sets.select("node", F.size("items").alias("size"), F.explode("items").alias("e"))
    often = as_table(own.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "elements")
    known = meet(own, often, "e", "node", ASKERS)  # elements of one set only come first and are counted
    ordered = known.groupBy("node").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "e"))).alias("often"))
    ordered = ordered.withColumns({"alone": F.col("size") - F.size("often"), "shows": F.col("size") - up(f"size * {t}", ALIKE) + 1, "least": F.col("size") - up(f"size * {2 * t}", t + ALIKE) + 1})
    shown = ordered.where("shows > alone").select("node", "size", "alone", "least", F.posexplode(F.expr("slice(often, 1, int(shows - alone))")).alias("i", "o"))
    posting = shown.join(labels, "node").select("node", "size", "label", F.col("o.e").alias("e"), (F.col("i") + F.col("alone")).alias("place"), (F.col("i") + F.col("alone") < F.col("least")).alias("small"))
    posting = as_table(posting, "posting")
    lists = posting.groupBy("e").agg(F.count("*").alias("n"), F.min("label").alias("one"), F.max("label").alias("other"), F.max("small").alias("any")).where("one <> other AND any").select("e", "n")
    lists = as_table(lists, "lists")
    live = as_table(meet(posting, lists, "e", "node", ASKERS).withColumn("salts", F.expr(f"n div {ASKERS} + 1")), "live")
    a = live.where("small").select("e", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "label", "place")])
    b = live.select("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "label", "place")])
    both = a.join(b, ["e", "salt"]).where(f"label_a <> label_b AND (size_a < size_b OR (size_a = size_b AND node_a < node_b)) AND size_a * {ALIKE} >= size_b * {t}")
    reach = f"least(size_a - place_a, size_b - place_b) * {ALIKE + t} >= (size_a + size_b) * {t}"
    return both.where(reach).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def settle(banded: DataFrame, sets_of, at_least: float, first: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes that are linked: banded (node, bands) are distinct sets, sets_of(nodes) gives (node, items).

    `first` are pairs (a, b) to compare before the bands.  Only sets that share a
    band, or are in `first`, are made.
    """
    spark = banded.sparkSession
    keyed = banded.select("node", F.explode("bands").alias("key"))
    by = lambda salt: F.xxhash64("node", F.lit(salt))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), *[F.min_by("node", by(k)).alias(f"leader{k}") for k in range(ROUNDS)]).where("n > 1")
    groups = as_table(groups, "groups")
    member = as_table(meet(keyed, groups, "key", "node", ASKERS), "members")
    needed = member.select("node")
    if first is not None:
        needed = needed.unionByName(first.select(F.col("a").alias("node"))).unionByName(first.select(F.col("b").alias("node")))
    sets = as_table(sets_of(as_table(needed.distinct(), "needed")), "sets")
    links = as_table(similar(first, sets, at_least), "links") if first is not None else spark.createDataFrame([], "a long, b long")
    roots = grouped(links) if first is not None else spark.createDataFrame([], "node long, root long")
    split = member
    for k in range(ROUNDS):
        if k:
            split = _split(split, roots)
        asked = split.select(F.col("node").alias("a"), F.col(f"leader{k}").alias("b")).where("a <> b").distinct()
        pairs = as_table(_apart(asked, roots), "pairs")
        more = as_table(similar(pairs, sets, at_least), "links")
        links = links.unionByName(more)
        roots = grouped(links)
    rest = _split(split, roots)
    labels = as_table(_labelled(rest.select("node").distinct(), roots), "labels")
    if not labels.isEmpty():
        pairs = as_table(prefix_pairs(as_table(sets.join(labels, "node").select("node", "items"), "rest"), labels, at_least), "pairs")
        more = as_table(similar(pairs, sets, at_least), "links")
        roots = grouped(links.unionByName(more)) if not more.isEmpty() else roots
    return roots


def _labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that are in different components."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    same = F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))
    return pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where(~same).select("a", "b")


def _split(member: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the groups that hold several components."""
    told = as_table(_labelled(member, roots), "labelled")
    several = told.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("key", F.lit(0).alias("several"))
    counts = as_table(several.join(told.groupBy("key").agg(F.count("*").alias("n")), "key"), "several")
    return as_table(meet(told.drop("n", "label"), counts, "key", "node", ASKERS).drop("n", "several"), "split")
