"""Connected components and reachability on edge tables.

Components come by contraction. In a round each node follows its neighbour of least priority (a hash that changes from round
to round, so chains are short however nodes are numbered), links move to where their ends went, and links within one place
go: a third of a path's nodes are left, fewer of denser graphs. What one task can hold is solved there, and the rounds' maps
lead back from there to every node. All sizes shrink from round to round, so all rounds cost about as much as the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checked, stow, workers_import

#: Links that one task solves: some tens of bytes each.
SOLVED_AT_ONCE = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest number of each component of the links a, b, given labels so far."""
    while True:
        x, y = label[a], label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return label
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _ranked(nodes: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different nodes in order, and each one's place among them."""
    if pa.types.is_nested(nodes.type):
        rows = [tuple(x.values()) for x in nodes.to_pylist()]
        order = sorted(range(len(rows)), key=rows.__getitem__)
        fresh = np.array([not k or rows[i] != rows[order[k - 1]] for k, i in enumerate(order)], bool)
        places = np.empty(len(rows), np.int64)
        places[order] = np.cumsum(fresh) - 1
        return nodes.take(pa.array(np.array(order, np.int64)[fresh])), places
    coded = nodes.dictionary_encode()
    order = np.asarray(pa.compute.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[np.asarray(coded.indices)]


def _solved(links: DataFrame) -> DataFrame:
    """node, label in one task."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        columns = [pa.concat_arrays([b.column(k) for b in held]) for k in range(2)]
        nodes, places = _ranked(pa.concat_arrays(columns))
        label = least_labels(places[: len(columns[0])], places[len(columns[0]) :], np.arange(len(nodes)))
        for first in range(0, len(nodes), 10_000):
            part = slice(first, first + 10_000)
            yield pa.RecordBatch.from_arrays([nodes[part], nodes.take(pa.array(label[part]))], ["node", "label"])

    workers_import(links.sparkSession)
    return links.select("a", "b").repartition(1).mapInArrow(run, f"node {kind}, label {kind}")


def _followed(links: DataFrame, number: int) -> DataFrame:
    """node, goal: of each linked node, where the neighbour of least priority goes; nodes without a lesser neighbour stay."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("node"))
    least = both.groupBy("a").agg(F.min(mark("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", mark("a"))["node"].alias("goal"))
    steps = stow(least)
    further = steps.select(F.col("node").alias("goal"), F.col("goal").alias("next"))
    return stow(steps.join(further, "goal").select("node", F.col("next").alias("goal")))


def contracted(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """links(a, b) that one task may solve, and the map(node, goal) of each round that led there."""
    links, maps = stow(links.select("a", "b").where("a <> b").distinct()), []
    while links.count() > SOLVED_AT_ONCE:
        goals = _followed(links, len(maps))
        maps.append(goals)
        for side in ("a", "b"):
            links = links.join(goals.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("goal", side)
        links = stow(links.select("a", "b").where("a <> b").distinct())
    return links, maps


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of links(a, b); every linked node is there.

    A node that is linked with itself alone is its own component. Rounds are written to the shared folder.
    """
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    rest, maps = contracted(links)
    labels = stow(_solved(rest))
    for goals in reversed(maps):
        known = labels.withColumnRenamed("node", "goal")
        labels = goals.join(known, "goal", "left").select("node", F.coalesce("label", "goal").alias("label"))
    if maps:  # labels are nodes of the component, but not the smallest ones
        labels = stow(labels)
        least = labels.groupBy("label").agg(F.min("node").alias("least"))
        labels = stow(labels.join(checked(stow(least)), "label").select("node", F.col("least").alias("label")))
    return labels.unionByName(alone.distinct().join(labels.select("node"), "node", "left_anti"))


def reachable(nodes: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Those of nodes(node) in a component that holds one of seeds(node)."""
    known = seeds.join(nodes, "node", "left_semi").distinct()
    labels = components(links)
    wanted = labels.join(known, "node", "left_semi").select("label").distinct()
    return labels.join(wanted, "label", "left_semi").select("node").unionByName(known).distinct()
