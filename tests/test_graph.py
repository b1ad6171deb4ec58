"""Components against a plain union-find, by contraction and in one task."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph


def plain(links):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {x: find(x) for x in top}


@pytest.mark.parametrize("kind,at_once", [("long", 1_000_000), ("long", 0), ("string", 1_000_000), ("binary", 20), ("struct<x:int,y:string>", 1_000_000), ("struct<x:int,y:string>", 20)])
def test_components(spark, monkeypatch, kind, at_once):
    monkeypatch.setattr(graph, "SOLVED_AT_ONCE", at_once)
    rng = random.Random(len(kind))
    node = {"long": lambda k: k - 40, "string": lambda k: f"é{k}", "binary": lambda k: bytes([200 - k % 200, k % 7]), "struct<x:int,y:string>": lambda k: (k % 9, f"n{k}")}[kind]
    links = [(node(rng.randrange(160)), node(rng.randrange(160))) for _ in range(110)] + [(node(k), node(k + 1)) for k in range(170, 195)] + [(node(1), node(1)), (node(198), node(198))] * 2
    order = (lambda x: x.encode()) if kind == "string" else (lambda x: x)
    want = {}
    for x, root in plain(links).items():
        want.setdefault(root, []).append(x)
    want = {x: min(xs, key=order) for xs in want.values() for x in xs}
    held = spark.createDataFrame(links, f"a {kind}, b {kind}").repartition(3)
    plainly = lambda v: bytes(v) if kind == "binary" else tuple(v) if kind.startswith("struct") else v
    rows = graph.components(held).collect()
    assert {plainly(r.node): plainly(r.label) for r in rows} == want and len(rows) == len(want)
    assert graph.components(held.where("a <> a")).count() == 0


@pytest.mark.parametrize("numbers", ["in order", "mixed"])
def test_a_long_path_takes_few_rounds(spark, monkeypatch, numbers):
    monkeypatch.setattr(graph, "SOLVED_AT_ONCE", 2000)
    n = 200_000
    name = lambda c: F.pmod(c * 48271, F.lit(1_000_003)) if numbers == "mixed" else c
    links = spark.range(0, n, 1, 8).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    assert len(graph.contracted(links)[1]) <= 7
    found = graph.components(links)
    least = links.agg(F.least(F.min("a"), F.min("b"))).first()[0]
    assert found.agg(F.count("*"), F.count_distinct("node"), F.min("label"), F.max("label")).first() == (n + 1, n + 1, least, least)


def test_a_path_of_a_million_nodes(spark):
    links = spark.range(0, 1_000_000, 1, 8).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    assert len(graph.contracted(links)[1]) < 15 and graph.components(links).select("label").distinct().count() == 1
