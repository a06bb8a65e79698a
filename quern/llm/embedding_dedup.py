"""Embedding near-duplicates by dual traversal of a cover tree: exact pairs over a cosine threshold.

Unit vectors at cosine c are sqrt(2 - 2c) apart. Each level of the tree is a net of points: its centres are
further apart than half the radius of the level above, every point lies within that of one of them, and each
centre is a centre of all levels below. The upper levels come from a bounded sample, and every vector goes down
them to its nearest centre; vectors in order of (centre, distance) are cut into packs of bounded size, however
many share a centre. A pack holds the lower levels, down to single vectors or to LEAF of them, with the exact
covering radius of each node; the tree is grown once and stored with the pack. The traversal starts at the pair
of the root with itself: pairs of upper nodes, then of packs, then of nodes within packs are pruned if their
centres are further apart than both radii and the threshold distance. A pair of nodes so near that all their
vectors must link is counted as a whole. Nearest centres are looked up in single precision, with slack for its
rounding; what decides a link is computed in double.

Equal vectors are one point with a count. A pack pair gives each point's links summed, and a spanning
forest of its links, so a large group of near copies never becomes its square of rows.

In many dimensions, vectors in general position are further from each other than half of any radius: the nets
then hold every vector at once, no pair of nodes is pruned above single vectors, and the work is that of the
exact comparison of all pairs, as matrix products of packs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do vectors of different lengths with each other; a row without an id has no links and no
component and is not kept; repeated rows are each other's links; other columns are ignored; an empty
table gives an empty result. Each length of vectors is a tree of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, pieces_of, prepare
from quern.llm.components import Joined, connected_components

#: Vectors of the sample that the upper nets come from, centres of the last upper net, at most.
SAMPLE, CENTRES = 2_048, 256
#: Vectors of a pack: about a 16th of all, within bounds; and of a leaf.
LEAST_PACK, MOST_PACK, PACKS, LEAF = 256, 4_096, 16, 16
#: Slack for the rounding of distances, and of cosines in single precision; pruning must not lose a pair.
SLACK, SINGLE = 1e-7, 1e-5
#: Nodes of this radius are leaves: single precision cannot tell their points apart.
POINT = 1e-3
#: Rows of a matrix product that are held at once.
ROWS = 512


def net(unit: np.ndarray, reach: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres, the first point among them, that are further than ``reach`` apart and within it of every point
    (of those before the ``most``-th centre), and the nearest centre of each point."""
    cosines = unit @ unit.T
    near = 1 - reach * reach / 2
    open_ones, chosen = np.ones(len(unit), bool), []
    for i in range(len(unit)):
        if open_ones[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            open_ones &= cosines[i] < near
    return np.array(chosen), cosines[:, chosen].argmax(1)


class Tree:
    """Points in the order of the tree, and its nodes, the root first: the points start … end - 1 of each, the place
    of its centre, its covering radius, and its parts first … last - 1 (none in a leaf)."""

    FIELDS = ("start", "end", "centre", "first", "last")

    def __init__(self, unit: np.ndarray, nodes: np.ndarray, radius: np.ndarray) -> None:
        self.unit, self.single, self.radius = unit, unit.astype(np.float32), radius
        self.start, self.end, self.centre, self.first, self.last = nodes


def grow(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of points in their tree, whose root's centre is the first point, its nodes and their radii."""
    single = unit.astype(np.float32)
    order = np.arange(len(unit))
    nodes, radii = [[0, len(unit), 0, 0, 0]], [0.0]
    at = 0
    while at < len(nodes):
        start, end, centre = nodes[at][:3]
        own = order[start:end]
        radii[at] = float(np.linalg.norm(unit[own] - unit[centre], axis=1).max()) if len(own) > 1 else 0.0
        if len(own) > LEAF and radii[at] > POINT:
            own = np.r_[centre, own[own != centre]]
            chosen, nearest = net(single[own], radii[at] / 2)
            nodes[at][3:] = len(nodes), len(nodes) + len(chosen)
            order[start:end] = own[np.argsort(nearest, kind="stable")]
            for c, size in zip(chosen, np.bincount(nearest, minlength=len(chosen))):
                nodes.append([start, start + int(size), int(own[c]), 0, 0])
                radii.append(0.0)
                start += int(size)
        at += 1
    place = np.empty(len(unit), np.int64)
    place[order] = np.arange(len(unit))
    found = np.array(nodes, np.int64).T
    found[2] = place[found[2]]
    return order, found, np.array(radii)


def traverse(a: Tree, b: Tree | None, copies_a: np.ndarray, copies_b: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, Joined, int]:
    """Linked vectors of each point of a and of b (or within a if b is None), the groups of points that links
    join, and how many pairs of points or centres were compared."""
    same = b is None
    b, copies_b, base = (a, copies_a, 0) if same else (b, copies_b, len(a.unit))
    linked_a = np.zeros(len(a.unit), np.int64)
    linked_b = linked_a if same else np.zeros(len(b.unit), np.int64)
    joined = Joined(len(a.unit) + (0 if same else len(b.unit)))
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    compared = 0

    def block(x: int, y: int) -> None:
        rows, columns = slice(a.start[x], a.end[x]), slice(b.start[y], b.end[y])
        close = a.unit[rows] @ b.unit[columns].T >= least
        if same and x == y:
            np.fill_diagonal(close, False)
        else:
            linked_b[columns] += close.T @ copies_a[rows]
        linked_a[rows] += close @ copies_b[columns]
        i, j = np.nonzero(close)
        joined.pairs(i + a.start[x], base + j + b.start[y])

    def whole(x: int, y: int) -> None:
        rows, columns = slice(a.start[x], a.end[x]), slice(b.start[y], b.end[y])
        if same and x == y:
            linked_a[rows] += copies_a[rows].sum() - copies_a[rows]
        else:
            linked_a[rows] += copies_b[columns].sum()
            linked_b[columns] += copies_a[rows].sum()
        joined.join(np.r_[a.start[x] : a.end[x], base + b.start[y] : base + b.end[y]])

    def points(i: np.ndarray, j: np.ndarray) -> None:
        for low in range(0, len(i), 65_536):
            x, y = i[low : low + 65_536], j[low : low + 65_536]
            near = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= least
            x, y = x[near], y[near]
            np.add.at(linked_a, x, copies_b[y])
            np.add.at(linked_b, y, copies_a[x])
            joined.pairs(x, base + y)

    def parts(tree: Tree, node: int) -> list[np.ndarray]:
        """The parts of a node, or itself: those of one vector, and the others."""
        own = np.arange(tree.first[node], tree.last[node]) if tree.last[node] else np.array([node])
        one = tree.end[own] - tree.start[own] == 1
        return [own[one], own[~one]]

    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        if not a.last[x] and not b.last[y]:
            compared += int((a.end[x] - a.start[x]) * (b.end[y] - b.start[y]))
            block(x, y)
            continue
        left, right = parts(a, x), parts(b, y)
        for p, xs in enumerate(left):
            for q, ys in enumerate(right):
                if not len(xs) or not len(ys) or same and x == y and p > q:
                    continue
                mirrored = same and x == y and p == q
                for low in range(0, len(xs), ROWS):
                    some = xs[low : low + ROWS]
                    others = ys[low:] if mirrored else ys
                    compared += len(some) * len(others)
                    cosines = a.single[a.centre[some]] @ b.single[b.centre[others]].T
                    if p == q == 0:
                        i, j = np.nonzero(cosines >= np.float32(least - SINGLE))
                    else:
                        wide = np.minimum(2.0, reach + SLACK + a.radius[some][:, None] + b.radius[others][None, :]).astype(np.float32)
                        i, j = np.nonzero(cosines >= 1 - wide * wide / 2 - np.float32(SINGLE))
                    if mirrored:
                        upper = (i <= j) if p else (i < j)
                        i, j = i[upper], j[upper]
                    if p == q == 0:
                        points(a.start[some[i]], b.start[others[j]])
                        continue
                    apart = np.linalg.norm(a.unit[a.centre[some[i]]] - b.unit[b.centre[others[j]]], axis=1)
                    radii = a.radius[some[i]] + b.radius[others[j]]
                    for u, v, near, sure in zip(some[i].tolist(), others[j].tolist(), apart - radii <= reach + SLACK, apart + radii <= reach - SLACK):
                        if sure:
                            whole(u, v)
                        elif near:
                            stack.append((u, v))
    return linked_a, linked_b, joined, compared


def upper_nets(sample: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the last upper net, and the one above each in every level, as chains: one row a level."""
    single = sample.astype(np.float32)
    radius, levels = 2.0, [np.array([0])]
    while len(levels[-1]) < most and radius > POINT:
        radius /= 2
        # centres of the level above come first, so that they stay centres
        ahead = np.r_[levels[-1], np.setdiff1d(np.arange(len(sample)), levels[-1])]
        found = ahead[net(single[ahead], radius, most)[0]]
        if len(found) == len(sample):
            levels.append(found)
            break
        levels.append(found)
    above = [np.arange(len(levels[-1]))]
    for level, below in zip(levels[-2::-1], levels[:0:-1]):
        nearest = (sample[below] @ sample[level].T).argmax(1)
        above.append(nearest[above[-1]])
    return sample[levels[-1]], np.array(above[::-1])


def surviving_leaves(centres: np.ndarray, parents: np.ndarray, radii: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs of last centres that may hold points within reach, from the pair of the root with itself downwards.
    ``radii`` are covering radii of the last centres."""
    pairs = {(parents[0][0], parents[0][0])}
    for level in range(len(parents)):
        last = level == len(parents) - 1
        names = np.arange(len(centres)) if last else parents[level]
        node = {n: np.flatnonzero(names == n) for n in np.unique(names)}
        middle = {n: centres[at[0]] if last else centres[at].mean(0) for n, at in node.items()}
        radius = {n: max(float(np.linalg.norm(centres[i] - middle[n])) + radii[i] for i in at) for n, at in node.items()}
        above = parents[level - 1] if level else np.full(len(centres), parents[0][0])
        under: dict = {}
        for n, at in node.items():
            under.setdefault(above[at[0]], []).append(n)
        found = set()
        for x, y in pairs:
            for u in under[x]:
                for v in under[y]:
                    if np.linalg.norm(middle[u] - middle[v]) - radius[u] - radius[v] <= reach + SLACK:
                        found.add((min(u, v), max(u, v)))
        pairs = found
    return sorted((int(u), int(v)) for u, v in pairs)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one, in double; scaled first, so that squares neither overflow nor vanish."""
    raw = raw.astype(np.float64)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _place(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = 2 - 2 * (_unit(_matrix(batch["vector"])) @ centres.T)
                nearest = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("point", "copies", "vector")), pa.array(nearest), pa.array(away[np.arange(len(nearest)), nearest])], names=["point", "copies", "vector", "leaf", "away"])

    return run


def _leaf_runs(size: int):
    """Runs of one leaf's points in order of their distance, of at most ``size``, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("leaf", "ascending"), ("away", "ascending"), ("point", "ascending")])
        leaf = table["leaf"].to_numpy()
        edges = np.r_[0, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, len(leaf)]
        spans = [(low, min(low + size, high)) for first, high in zip(edges, edges[1:]) for low in range(first, high, size)]
        for number, (low, high) in enumerate(spans):
            part = table.slice(low, high - low)
            ids, copies = (part[c].to_numpy().astype(np.int64).tobytes() for c in ("point", "copies"))
            values = [int(leaf[low]), TaskContext.get().partitionId() << 20 | number, int(high - low), ids, copies, _matrix(part["vector"]).tobytes()]
            kinds = [*[pa.int64()] * 3, *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["leaf", "run", "rows", "points", "copies", "vectors"])

    return run


def _pack(kind: str):
    """Packs in the order of their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, copies = (np.frombuffer(b"".join(row[c]), np.int64) for c in ("points", "copies"))
                raw = np.frombuffer(b"".join(row["vectors"]), kind).reshape(len(ids), -1)
                unit = _unit(raw)
                order, nodes, radius = grow(unit)
                values = [row["leaf"] << 32 | row["piece"], row["leaf"], unit[0].tolist(), float(radius[0]), *(x.tobytes() for x in (ids[order], copies[order], raw[order], nodes.astype(np.int32), radius))]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), *[pa.binary()] * len(BODY)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["pack", "leaf", "centre", "radius", *BODY])

    return run


#: What a pack holds, as bytes.
BODY = ("points", "copies", "vectors", "nodes", "radii")


def _compare(least: float, kind: str):
    held: dict = {}

    def load(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, Tree]:
        if row[side] not in held:
            if len(held) > 4:
                held.clear()
            points, copies, vectors, nodes, radii = (row[f"{c}_{side}"] for c in BODY)
            ids = np.frombuffer(points, np.int64)
            unit = _unit(np.frombuffer(vectors, kind).reshape(len(ids), -1))
            held[row[side]] = ids, np.frombuffer(copies, np.int64), Tree(unit, np.frombuffer(nodes, np.int32).reshape(len(Tree.FIELDS), -1).astype(np.int64), np.frombuffer(radii))
        return held[row[side]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, copies, tree = load(row, "a")
                if row["a"] == row["b"]:
                    linked, _, joined, _ = traverse(tree, None, copies, None, least)
                else:
                    other, copies_b, tree_b = load(row, "b")
                    linked, linked_b, joined, _ = traverse(tree, tree_b, copies, copies_b, least)
                    ids, linked = np.concatenate([ids, other]), np.concatenate([linked, linked_b])
                some = np.flatnonzero(linked)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(linked[some]), pa.array(ids[joined.roots()[some]])], names=["point", "links", "root"])

    return run


def near_pairs(points: DataFrame, cosine: float) -> DataFrame:
    """(point, links, root) rows for (point, copies, vector): links are to be summed by point, roots are a
    forest of all links. Vectors must be of one length."""
    spark = points.sparkSession
    rows = points.count()
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("vector").collect()  # in bounds: SAMPLE
    if not sample:
        return spark.createDataFrame([], "point long, links long, root long")
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    size = min(MOST_PACK, max(LEAST_PACK, rows // PACKS))
    centres, parents = upper_nets(_unit(np.array([r.vector for r in sample])), min(CENTRES, max(1, rows // size)))
    kind = points.schema["vector"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        points, kind = points.withColumn("vector", F.col("vector").cast("array<double>")), "double"
    placed = points.select("point", "copies", "vector").mapInArrow(_place(centres), f"point long, copies long, vector array<{kind}>, leaf long, away double")
    raw = ("points", "copies", "vectors")
    ordered = placed.repartitionByRange(max(1, -(-rows // size)), "leaf", "away", "point")
    runs = ordered.mapInArrow(_leaf_runs(max(1, size // 4)), "leaf long, run long, rows long, " + ", ".join(f"{c} binary" for c in raw))
    schema = "pack long, leaf long, centre array<double>, radius double, " + ", ".join(f"{c} binary" for c in BODY)
    pieces = pieces_of(cut_lineage(runs), size, raw, by=("leaf",)).select("leaf", "piece", *(F.col(f"parts.{c}").alias(c) for c in raw))
    packs = cut_lineage(pieces.mapInArrow(_pack("f4" if kind == "float" else "f8"), schema))
    apart = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p))
    own = F.broadcast(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "leaf long, middle array<double>"))
    radii = np.zeros(len(centres))
    for r in packs.join(own, "leaf").groupBy("leaf").agg(F.max(apart("centre", "middle") + F.col("radius")).alias("radius")).collect():  # in bounds: CENTRES
        radii[r.leaf] = r.radius
    leaves = spark.createDataFrame(surviving_leaves(centres, parents, radii, reach), "leaf_a long, leaf_b long")  # in bounds: CENTRES squared
    balls = packs.select("pack", "leaf", "centre", "radius")
    left, right = (balls.select(F.col("pack").alias(s), F.col("leaf").alias(f"leaf_{s}"), F.col("centre").alias(f"centre_{s}"), F.col("radius").alias(f"radius_{s}")) for s in "ab")
    pairs = left.join(F.broadcast(leaves), "leaf_a").join(right, "leaf_b").where((F.col("leaf_a") != F.col("leaf_b")) | (F.col("a") <= F.col("b")))
    full = pairs.where(apart("centre_a", "centre_b") - F.col("radius_a") - F.col("radius_b") <= reach + SLACK).select("a", "b")
    for side in "ab":
        full = full.join(packs.select(F.col("pack").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in BODY)), side)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return full.repartition(parts, "a", "b").mapInArrow(_compare(cosine, "f4" if kind == "float" else "f8"), "point long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    prepare(vectors.sparkSession)
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    marked = own.withColumn("vector", F.when(sound, F.col("vector")))
    points = cut_lineage(marked.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("id").alias("point"), F.count("*").alias("copies")))
    lengths = [r[0] for r in points.select(F.size("vector")).distinct().collect()]
    found = None
    for length in lengths:
        part = near_pairs(points.where(F.size("vector") == length), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = near_pairs(points, cosine)
    found = cut_lineage(found)
    groups = connected_components(found.select(F.col("point").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("point"), "component")
    summed = found.groupBy("point").agg(F.sum("links").alias("links"))
    named = points.join(summed, "point", "left").join(groups, "point", "left").select("vector", "point", "copies", "links", "component")
    loose = marked.where(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = marked.where(F.col("vector").isNotNull()).join(named, "vector").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    both = linked.unionByName(loose)
    return both.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
