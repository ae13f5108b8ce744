"""Components of chains, stars, rings and hubs."""

import random

import cases

from cartlens.llm.components import components


def test_shapes(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)]
    links += [(300, 301), (301, 302), (302, 300), (400, 400), (9_223_372_036_854_775_807, -5)]
    links += [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(180)]
    links += [(7, None)]
    frame = spark.createDataFrame(links + links[:10], "a long, b long")
    got = {row.node: row.component for row in components(frame).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = cases.reachable({x for e in real for x in e}, real)
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
