"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to a few blocks of eight dimensions, and every block is decoded
to its nearest point of the E8 lattice: equal points make a cell. Several tables have projections of
their own, and a vector also enters the neighbouring cells it is nearest to. Vectors that share a
cell are compared by cosine in double precision.

A cell's members are compared in blocks of bounded size. A pair that shares several cells counts in
the first one only, which both vectors' cell lists tell without another shuffle: numbers of links are
sums over cells, and for the components each cell sends one edge per member, never all its pairs.
Equal vectors are one node with a count, so copies are not expanded.

Defined cases. Null vectors, vectors with null, NaN or infinite components, zero vectors, and null
labels link with nothing. Vectors of different lengths do not link. Repeated vec_ids: each row is a
vector and counts as one. Null vec_id: links, its component may be null. Empty table: empty result.
Other columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import components, map_batches, mix, written

COSINE = 0.93
TABLES = 6
BLOCKS = 2                  # of eight dimensions; more blocks make smaller cells
PROBES = 6
SCALE = 1.8                 # size of a cell
MEMBERS = 1024              # of a cell that one comparison holds on each side


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or all +-1/2 with an even number of minus signs."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(found)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight numbers."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


NEIGHBOURS = minimal_vectors()


def cells(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES,
          scale: float = SCALE, seed: int = 13) -> np.ndarray:
    """Cell names (vector, table, 1 + probes): the own cell and the nearest neighbouring ones."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng(seed * 1009 + t)
        plane = rng.normal(size=(dim, 8 * blocks))
        shift = rng.uniform(0, 1, 8 * blocks)
        x = unit @ plane / scale + shift
        parts, rises = [], []
        for b in range(blocks):
            y = x[:, 8 * b : 8 * b + 8]
            point = nearest_e8(y)
            rise = 1 - (y - point) @ NEIGHBOURS.T          # half the rise of the squared distance
            parts.append(point)
            rises.append(rise)
        order = np.argsort(np.hstack(rises), axis=1, kind="stable")[:, :probes]

        def name(points: list[np.ndarray]) -> np.ndarray:
            h = np.full(n, t + 1, np.uint64) + labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for column in (2 * np.hstack(points)).astype(np.int64).T:
                h = mix(h + column.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            return h

        out[:, t, 0] = name(parts)
        for k in range(probes):
            moved = [p.copy() for p in parts]
            for b in range(blocks):
                at = np.flatnonzero(order[:, k] // 240 == b)
                moved[b][at] += NEIGHBOURS[order[at, k] % 240]
            out[:, t, 1 + k] = name(moved)
    return out.reshape(n, tables * (1 + probes))


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(d, np.float64) for d in data])
    x = x / np.abs(x).max(axis=1, keepdims=True)      # first to size 1, so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their node (null when they link with nothing), and the nodes: node, label, vector, copies, first."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    fine = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(values, lambda v: v != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.when(fine, values).alias("v"))
    rows = written(rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))), "vectors")
    nodes = rows.where("node is not null").groupBy("node", "label", "v").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = written(nodes, "nodes")
    if not nodes.groupBy("node").count().where("count > 1").isEmpty():
        raise RuntimeError("vector names clash")
    return rows, nodes


def with_cells(nodes: DataFrame, **options) -> DataFrame:
    """node, copies, vector (bytes of doubles), names of its cells."""

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists, labels = batch.column(2), batch.column(1).to_numpy()
            data = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64).tobytes() for v in lists]
            names: list = [None] * len(data)
            sizes = np.array([len(d) for d in data])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                found = cells(_unit([data[i] for i in at]), labels[at], **options).view(np.int64)
                for i, row in zip(at, found):
                    names[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(data, pa.binary()), pa.array(names, pa.list_(pa.int64()))],
                ["node", "copies", "vector", "cells"])

    return map_batches(nodes.select("node", "label", "v", "copies"), step,
                       "node long, copies long, vector binary, cells array<long>", 2048)


def _compare(cell: int, left: list, right: list | None, cosine: float):
    """Per linked member of a cell: copies linked here first, and the smallest node it reaches by these links."""
    node, copies, vector, names = zip(*left)
    a, ca, ua, na = np.array(node), np.array(copies), _unit(list(vector)), np.array(names)
    if right is None:
        b, cb, ub, nb = a, ca, ua, na
    else:
        node, copies, vector, names = zip(*right)
        b, cb, ub, nb = np.array(node), np.array(copies), _unit(list(vector)), np.array(names)
    if ua.shape[1] != ub.shape[1]:
        return
    close = ua @ ub.T >= cosine
    if right is None:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    if not len(i):
        return
    # The first cell in the smaller node's list that the other node also has.
    swap = (a[i] > b[j])[:, None]
    x, y = np.where(swap, nb[j], na[i]), np.where(swap, na[i], nb[j])
    first = np.full(len(i), cell)
    undecided = np.arange(len(i))
    for k in range(x.shape[1]):
        hit = (y[undecided] == x[undecided, k : k + 1]).any(1)
        first[undecided[hit]] = x[undecided[hit], k]
        undecided = undecided[~hit]
        if not len(undecided):
            break
    own = first == cell
    i, j = i[own], j[own]
    if not len(i):
        return
    nodes, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    u, v = at[: len(i)], at[len(i) :]
    links = np.bincount(u, cb[j], len(nodes)) + np.bincount(v, ca[i], len(nodes))
    least = np.arange(len(nodes))
    while True:                     # smallest member reachable inside the cell
        low = np.minimum(least[u], least[v])
        now = least.copy()
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    yield from zip(nodes.tolist(), links.astype(np.int64).tolist(), nodes[least].tolist())


def cell_links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """node, links, other from rows (cell, lo, hi, block, node, copies, vector, cells)."""
    order = ["cell", "lo", "hi"]
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def step(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from orderloom.llm.common import batches

        def rows():
            key, held = None, {}

            def done():
                sides = list(held.values())
                if key[1] == key[2] and len(sides[0]) > 1:
                    yield from _compare(key[0], sides[0], None, cosine)
                elif key[1] != key[2] and len(sides) == 2:
                    yield from _compare(key[0], sides[0], sides[1], cosine)

            for batch in source:
                for cell, lo, hi, block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (cell, lo, hi) != key:
                        if held:
                            yield from done()
                        key, held = (cell, lo, hi), {}
                    held.setdefault(block, []).append(row)
            if held:
                yield from done()

        yield from batches(rows(), schema)

    return map_batches(
        members.select(*order, "block", "node", "copies", "vector", "cells").repartition(*order)
        .sortWithinPartitions(*order, "block"), step, "node long, links long, other long", 2048)


def linked(vectors: DataFrame, cosine: float = COSINE, members: int = MEMBERS, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, nodes = distinct_vectors(vectors)
    celled = written(with_cells(nodes, **options), "cells")
    entries = celled.select("node", F.explode(F.array_distinct("cells")).alias("cell"))
    sizes = entries.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(members)).cast("int")
    dealt = (entries.join(sizes, "cell").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
                     "node"))
    found = written(cell_links(dealt.join(celled, "node"), cosine), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = nodes.select("node", "copies", "first").join(reach.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "copies", "first", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    info = placed.join(least, "component").join(counts, "node", "left").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "node").join(info, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
