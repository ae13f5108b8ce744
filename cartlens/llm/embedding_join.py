"""Exact near-duplicate join of embeddings in metric space.

On unit vectors a cosine bound is a distance bound r. Per label, pivots taken
from a bounded sample partition the vectors: a vector's home is the cell of its
nearest pivot. Whoever is within r of a home vector of cell i is at most
2 r farther from pivot i than from its own pivot (triangle inequality), and its
difference of squared distances to the two pivots is at most 2 r times the
distance between them; vectors that satisfy both are copied into cell i. Each
home vector then meets all its partners inside its own cell, so cells are
joined independently, in square blocks of bounded size however large a cell is.

Equal vectors are joined once, with their number. A block gives, for each home
vector, how many it links with, and a spanning forest of its links; links
inside a dense group are counted but never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

COSINE = 0.98
#: rows of a cell's own vectors that a pivot is meant to gather
CELL = 1024
#: pivots of all labels together, at most; vectors sampled to choose them
PIVOTS = 2048
SAMPLE = 8 * PIVOTS
#: rows of one side of a block
BLOCK = 2048
_EPS = 1e-9


def spread_out(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the unit vectors, each the farthest from those before it."""
    chosen, far = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(count, len(vectors)):
        far = np.minimum(far, 2 - 2 * vectors @ vectors[chosen[-1]])
        if far.max() <= _EPS:
            break
        chosen.append(int(far.argmax()))
    return vectors[chosen]


def cells(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector; boolean (vectors, pivots): copied there."""
    square = np.maximum(2 - 2 * unit @ pivots.T, 0)
    home = square.argmin(1)
    own = square[np.arange(len(unit)), home][:, None]
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    copied = ((np.sqrt(square) <= np.sqrt(own) + 2 * radius + _EPS)
              & (square - own <= 2 * radius * between + _EPS))
    return home, copied


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For each node, the smallest node it is connected to by the links a-b."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while (jump := after[after] < after).any():
            after[jump] = after[after[jump]]
        if (after == root).all():
            return root
        root = after


def _unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # neither overflows nor vanishes when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label", cosine: float = COSINE, cell: int = CELL,
                    pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows link if their labels are equal and not null, their vectors have the
    same length and their cosine (in double precision) is at least ``cosine``
    (above 0). Null and zero vectors, and those with null or non-finite parts,
    link with nothing. Repeated rows are vectors of their own. Null ids count as
    links but are a component's smallest id only if it has no other. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("v")
    rows = stored(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"),
        F.col(label).alias("label"), F.col(vector).alias("v")).withColumn(
        "sound", F.coalesce(F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, bad)
                            & F.exists(v, lambda x: x != 0), F.lit(False))), "vectors")
    groups = stored(rows.where("sound").groupBy("label", "v").agg(
        F.min("row").alias("g"), F.min("vec_id").alias("first"),
        F.count(F.lit(1)).alias("w")).withColumn("dim", F.size("v")), "groups")

    per = groups.groupBy("label", "dim").count()
    total = per.agg(F.sum("count")).head()[0] or 0
    # at most ``pivots`` in all, so at most as many labels have any
    share = F.least(F.ceil(F.col("count") / cell),
                    F.floor(F.col("count") * pivots / F.lit(max(total, 1))))
    wanted = {(r["label"], r["dim"]): r["k"] for r in
              per.withColumn("k", share).where("k > 1").collect()}
    sampled: dict = {}
    if wanted:
        draw = F.pmod(F.xxhash64("g"), F.lit(1_000_000)) / 1_000_000
        keys = spark.createDataFrame([(*k,) for k in wanted], groups.select("label", "dim").schema)
        few = (groups.where(draw < min(1.0, SAMPLE / total))
               .join(F.broadcast(keys), ["label", "dim"]))  # at most ``pivots`` rows
        for r in few.select("label", "dim", "v").collect():  # about SAMPLE rows
            sampled.setdefault((r["label"], r["dim"]), []).append(r["v"])
    chosen = {k: spread_out(_unit(x), wanted[k]) for k, x in sampled.items()}
    shared = spark.sparkContext.broadcast(chosen)

    def deal(batches):
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                labels, dims, g, w, vs = (c.to_pylist() for c in part.columns)
                out: list[list] = [[] for _ in range(3)]
                unit: list[bytes] = []
                by: dict = {}
                for i, key in enumerate(zip(labels, dims, strict=True)):
                    by.setdefault(key, []).append(i)
                for key, at in by.items():
                    x = _unit([vs[i] for i in at])
                    if key in shared.value:
                        home, copied = cells(x, shared.value[key], radius)
                    else:
                        home, copied = np.zeros(len(x), int), np.ones((len(x), 1), bool)
                    for i, row, h, c in zip(at, x, home, copied, strict=True):
                        for j in np.flatnonzero(c):
                            for column, value in zip(out, (i, j, j == h), strict=True):
                                column.append(value)
                            unit.append(row.tobytes())
                take = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take),
                     pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()),
                     part.column(2).take(take), part.column(3).take(take),
                     pa.array(unit, pa.binary())],
                    ["label", "dim", "cell", "home", "g", "w", "unit"])

    source = groups.select("label", "dim", "g", "w", "v")
    schema = source.select(
        "label", "dim", F.lit(0).alias("cell"), F.lit(True).alias("home"), "g", "w",
        F.lit(b"").alias("unit")).schema
    dealt = stored(source.mapInArrow(deal, schema), "dealt")
    place = ["label", "dim", "cell"]
    blocks = dealt.groupBy(*place).agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("rows"),
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("columns"))
    blocks = blocks.where("rows > 0")
    met = dealt.join(blocks, place)
    mine = F.pmod(F.xxhash64("g"), F.col("rows")).cast("int")
    other = F.pmod(F.xxhash64("g", F.lit(1)), F.col("columns")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = met.where("home").select(*place, mine.alias("i"), every("columns").alias("j"),
                                      F.lit(True).alias("probe"), "g", "w", "unit")
    partners = met.select(*place, every("rows").alias("i"), other.alias("j"),
                          F.lit(False).alias("probe"), "g", "w", "unit")
    arrow = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def join(t: pa.Table) -> pa.Table:
        probe = t.column("probe").to_numpy()
        g, w = t.column("g").to_numpy(), t.column("w").to_numpy()
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(g), -1)
        a, b = np.flatnonzero(probe), np.flatnonzero(~probe)
        linked = x[a] @ x[b].T >= cosine
        linked |= g[a][:, None] == g[b][None, :]
        n = linked @ w[b]
        names, at = np.unique(g, return_inverse=True)
        i, j = np.nonzero(linked)
        root = forest(at[a[i]], at[b[j]], len(names))
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({
            "g": np.concatenate((g[a], names[tied])),
            "n": np.concatenate((n, np.zeros(len(tied), np.int64))),
            "to": pa.concat_arrays([pa.nulls(len(a), pa.int64()),
                                    pa.array(names[root[tied]], pa.int64())])}, schema=arrow)

    found = stored(probes.union(partners).groupBy(*place, "i", "j").applyInArrow(
        join, "g long, n long, to long"), "blocks")
    links = found.groupBy("g").agg((F.sum("n") - 1).alias("n_links"))
    member = components(found.where("to is not null").select("g", "to"), "g", "to")
    named = groups.select("g", "first").join(
        member.withColumnRenamed("node", "g"), "g", "left").withColumn(
        "component", F.coalesce("component", "g"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    result = (named.join(least, "component").join(links, "g")
              .select("g", "n_links", "component_id"))
    of_row = (rows.where("sound").join(groups.select("label", "v", "g"), ["label", "v"])
              .select("vec_id", "g").join(result, "g").select("vec_id", "n_links", "component_id"))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    return of_row.union(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
