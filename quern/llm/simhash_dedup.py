"""SimHash near-duplicates by tiled, exact comparison of fingerprints.

Distinct fingerprints are sorted by the population counts of their 16-bit lanes and cut into tiles.
Two fingerprints differ in at least as many bits as their lanes' counts differ in sum, so a pair of
tiles, and within it a pair of runs of equal counts, that differs by more than the radius is skipped;
all others are compared with exclusive-or and bit counts. A tile pair gives a spanning forest of its
links instead of all of them, so that a large group of near copies costs its size, not its square;
groups are what stars over these links reach.

`similar_documents` goes by the exact Jaccard similarity of shingle sets alone. Documents of equal sets are
one node, with four fingerprints of 64 bits over its distinct shingles, as the similarity counts them. Pairs
whose sizes allow the similarity and whose fingerprints are near are candidates, and only a verified candidate
is a link. First each node is held against the hub of the nodes that its nearest candidates chain it to, the
one with most of them: that settles a large group of near copies at the cost of its size. What is left are
candidates of different groups. They are compared in pairs of blocks whose shingle sets fit in memory; a task
gets each set once and gives a spanning forest of the links, so no pair of documents ever becomes a row. At
similarity s, fingerprints differ in about 256·acos(2s/(1+s))/pi bits: 39 at 0.8, with a deviation of 6, where
64 are allowed; in the first 64 bits 10, with a deviation of 3, where 22 are.

In `near_duplicates` nothing is lost or capped: equal fingerprints are one node, and every pair of tiles that may hold a
link is compared.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like
any other; a null id is a row of its own, and no group is named by it unless it has no other; repeated
rows each give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage, pieces_of, prepare, relieve_executors, texts
from quern.llm.components import Joined, connected_components

#: Fingerprints of a tile: about a 24th of all, so that there are pairs enough to deal out, in bounds.
LEAST_TILE, MOST_TILE, TILES = 2_048, 65_536, 24
#: Rows of the left and of the right tile that are compared at once.
ROWS, STRIDE = 128, 16_384
#: Nodes and shingles of a block whose sets are held in memory, at most (or one node).
BLOCK_NODES, BLOCK_SHINGLES = 2_048, 2_000_000
#: Nodes of a hub that one stretch of comparisons takes.
HELD = 2_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def hashes_of(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of fewer words, of the whole sequence."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = text.encode().translate(LOWER).split()
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(joined, seed)] if tokens else [], "<u8")
    ends = list(accumulate(len(t) + 1 for t in tokens))
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :])], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half the hashes; none: zero."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 4, seed: int = 42) -> tuple[int, int]:
    """The fingerprint and the number of distinct shingles."""
    hashes = hashes_of(text, words, seed)
    return majority(hashes), len(np.unique(hashes))


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits for each hash, unlike its own ones."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(29))


def _fingerprints(id_column: str, words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, words, seed) for text in batch["text"].to_pylist()]
            fps = pa.array(np.array([f for f, _ in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch[id_column], fps, pa.array([n for _, n in found], pa.int64())], names=[id_column, "fp", "size"])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, size): the fingerprint's 64 bits as a long, and the number of distinct shingles."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    return texts(docs, id_column, text=text).mapInArrow(_fingerprints(id_column, words, seed), f"`{id_column}` {kind}, fp long, size long")


def lanes(found: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit lanes, by row."""
    return np.bitwise_count(np.ascontiguousarray(found).view("<u2").reshape(-1, 4))


def lane(index: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", 16 * index).bitwiseAND(F.lit(65535).cast("long")))


def _runs_of(columns: tuple[str, ...], by_size: bool):
    """A partition's rows in order, as bytes, with the bounds of what tiles are told apart by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        own = {c: np.concatenate([np.asarray(b[c]) for b in batches]).astype(np.int64) for c in columns}
        counts = own["size"][:, None] if by_size else lanes(own["fp"].view(np.uint64))
        order = np.lexsort((own["fp"], *counts.T[::-1]))
        rows = [TaskContext.get().partitionId(), len(order), counts.min(0).tolist(), counts.max(0).tolist(), *(own[c][order].tobytes() for c in columns)]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * len(columns)]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(rows, kinds)], names=["run", "rows", "low", "high", *columns])

    return run


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane counts of the runs of equal counts, and where the runs start and end."""
    counts = lanes(found).astype(np.int16)
    starts = np.flatnonzero(np.r_[True, (counts[1:] != counts[:-1]).any(1)])
    return counts[starts], np.r_[starts, len(found)]


def near_blocks(a: np.ndarray, b: np.ndarray | None, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row of a, rows of b, bits that differ) for the blocks of two tiles, or of one with itself if
    b is None, that may hold pairs within reach. Within one tile, a pair may come twice."""
    other = a if b is None else b
    own, own_at = _runs(a)
    far, far_at = _runs(other)
    for i in range(len(own)):
        near = np.flatnonzero(np.abs(far - own[i]).sum(1) <= reach)
        if b is None:
            near = near[near >= i]
        if len(near):
            at = np.concatenate([np.arange(far_at[j], far_at[j + 1]) for j in near])
            right = other[at]
            for low in range(own_at[i], own_at[i + 1], ROWS):
                left = a[low : min(low + ROWS, own_at[i + 1])]
                yield low, at, np.bitwise_count(left[:, None] ^ right[None, :])


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within the radius between two tiles do, or within
    one tile if b is None."""
    nodes, base = (a, 0) if b is None else (np.concatenate([a, b]), len(a))
    joined = Joined(len(nodes))
    for low, at, apart in near_blocks(a, b, radius):
        close = apart <= radius
        for row in np.flatnonzero(close.any(1)):
            joined.join(np.r_[low + row, base + at[close[row]]])
    label = joined.roots()
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _read(batch: pa.RecordBatch, row: int, column: str, kind=np.int64) -> np.ndarray:
    found = batch[column][row].as_py()
    return np.frombuffer(b"".join(found) if isinstance(found, list) else found, kind)


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch["a"][i] == batch["b"][i]
                u, v = forest(_read(batch, i, "fp_a", np.uint64), None if same else _read(batch, i, "fp_b", np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


#: Fingerprints of a node; ``fp`` comes first and is what tiles are ordered by after the size.
MARKS = ("fp", "second", "third", "fourth")


def blocks_of(sizes: np.ndarray) -> np.ndarray:
    """Numbers of the blocks that a tile's nodes, in order of size, are cut into."""
    row, shingles = np.arange(len(sizes)) // BLOCK_NODES, np.cumsum(sizes) // BLOCK_SHINGLES
    return np.cumsum(np.r_[False, (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])])


def _side(batch: pa.RecordBatch, row: int, name: str, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    own = {c: _read(batch, row, f"{c}_{name}", np.uint64 if c in MARKS else np.int64) for c in columns}
    return own | {"block": blocks_of(own["size"])}


def candidates(a: dict, b: dict | None, wide: int, both: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two tiles, or of one with itself if b is None, that are near in their first and in all fingerprints
    and whose sizes allow the similarity; each pair once."""
    other = a if b is None else b
    for low in range(0, len(a["fp"]), ROWS):
        high = min(low + ROWS, len(a["fp"]))
        first, last = np.searchsorted(other["size"], [np.floor(similarity * a["size"][low]), np.ceil(a["size"][high - 1] / similarity) + 1])
        for start in range(max(first, low) if b is None else first, last, STRIDE):
            stop = min(start + STRIDE, last)
            apart = np.bitwise_count(a["fp"][low:high, None] ^ other["fp"][None, start:stop])
            x, y = np.nonzero(apart <= wide)
            total = apart[x, y].astype(np.int64)
            x, y = x + low, y + start
            for mark in MARKS[1:]:
                total += np.bitwise_count(a[mark][x] ^ other[mark][y])
            keep = (total <= both) & (np.minimum(a["size"][x], other["size"][y]) >= similarity * np.maximum(a["size"][x], other["size"][y]))
            if b is None:
                keep &= x < y
            if keep.any():
                yield x[keep], y[keep]


def _chained(wide: int, both: int, similarity: float):
    """(node, root, met): a spanning forest of the candidates of two tiles, and how many each node has."""
    columns = (*MARKS, "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = _side(batch, i, "a", columns)
                b = None if batch["a"][i] == batch["b"][i] else _side(batch, i, "b", columns)
                nodes = a["node"] if b is None else np.concatenate([a["node"], b["node"]])
                base = 0 if b is None else len(a["node"])
                joined, met = Joined(len(nodes)), np.zeros(len(nodes), np.int64)
                for x, y in candidates(a, b, wide, both, similarity):
                    y = y + base
                    met += np.bincount(x, minlength=len(nodes)) + np.bincount(y, minlength=len(nodes))
                    joined.pairs(x, y)
                some = np.flatnonzero(met)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[joined.roots()[some]]), pa.array(met[some])], names=["node", "root", "met"])

    return run


def _open_blocks(wide: int, both: int, similarity: float):
    """(u, v, node, …): each block of one tile and each of the other that hold candidates of different groups, with
    the nodes that have them."""
    columns = (*MARKS, "size", "node", "grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = _side(batch, i, "a", columns)
                b = None if batch["a"][i] == batch["b"][i] else _side(batch, i, "b", columns)
                other = a if b is None else b
                wide_a, wide_b = int(a["block"].max()) + 1, int(other["block"].max()) + 1
                left, right = np.array([], np.int64), np.array([], np.int64)
                for x, y in candidates(a, b, wide, both, similarity):
                    keep = a["grp"][x] != other["grp"][y]
                    x, y = x[keep], y[keep]
                    left = np.union1d(left, x * wide_b + other["block"][y])
                    right = np.union1d(right, y * wide_a + a["block"][x])
                if b is None:  # within one block, a node may be on either side
                    right = np.setdiff1d(right, left)
                number = [batch["a"][i].as_py() << 20, batch["b"][i].as_py() << 20]
                for side, rows, far, swap in ((a, left // wide_b, left % wide_b, False), (other, right // wide_a, right % wide_a, True)):
                    u, v = (far, side["block"][rows]) if swap else (side["block"][rows], far)
                    for low in range(0, len(rows), 5_000):
                        some = slice(low, low + 5_000)
                        values = [u[some] + number[0], v[some] + number[1], *(side[c][rows[some]].view(np.int64) for c in columns)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["u", "v", *columns])

    return run


def tile_pairs(found: DataFrame, reach: int, columns: tuple[str, ...] = ("fp",), similarity: float = 0.0) -> DataFrame:
    """Pairs of tiles of fingerprints (column fp) whose lane counts allow a pair within reach, with the
    tiles' columns as bytes, dealt out evenly. With a similarity, tiles go by the column size, and pairs
    are those whose sizes allow it."""
    spark = found.sparkSession
    rows = found.count()
    size = min(MOST_TILE, max(LEAST_TILE, rows // TILES))
    by = ["size", *MARKS] if similarity else [*(lane(i) for i in range(4)), "fp"]
    ordered = found.select(*columns).repartitionByRange(max(1, -(-rows // size)), *by)
    runs = ordered.mapInArrow(_runs_of(columns, similarity > 0), "run long, rows long, low array<long>, high array<long>, " + ", ".join(f"{c} binary" for c in columns))
    tiles = pieces_of(cut_lineage(runs), size, ("low", "high", *columns)).withColumnRenamed("piece", "tile")
    bound = lambda end, i: (F.array_min if end == "low" else F.array_max)(F.transform(f"parts.{end}", lambda x: x[i]))
    bounds = [F.array(*(bound(end, i) for i in range(1 if similarity else 4))).alias(end) for end in ("low", "high")]
    tiles = cut_lineage(tiles.select("tile", *bounds, *(F.col(f"parts.{c}").alias(c) for c in columns)))
    last = tiles.agg(F.coalesce(F.max("tile"), F.lit(0))).first()[0]
    spans = tiles.select("tile", "low", "high")
    left = spans.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence("tile", F.lit(last))).alias("b"))
    right = spans.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    if similarity:
        near = (F.col("high_a")[0] >= similarity * F.col("low_b")[0]) & (F.col("high_b")[0] >= similarity * F.col("low_a")[0])
    else:
        apart = [F.greatest(F.lit(0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i]) for i in range(4)]
        near = sum(apart[1:], apart[0]) <= reach
    full = left.join(right, "b").where(near).select("a", "b")
    for side in "ab":
        full = full.join(tiles.select(F.col("tile").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return full.repartition(parts, "a", "b")


def links(found: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): links that join the fingerprints (column fp, distinct) as all links within the radius do."""
    return tile_pairs(found, radius).mapInArrow(_links(radius), "u long, v long")


def _grouped(marked: DataFrame, nodes: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    groups = connected_components(found).withColumnRenamed("node", "fp")
    placed = nodes.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(named, "component").select("fp", "component_id"), "fp").select(id_column, "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links of the radius reach."""
    marked = cut_lineage(fingerprints(docs, id_column, text, words, seed))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min(id_column).alias("least")))
    return _grouped(marked, nodes, links(nodes.select("fp"), radius), id_column)


def shingle_set(text: str, words: int) -> set[bytes]:
    tokens = text.encode().translate(LOWER).split()
    return {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def set_hashes(text: str, words: int, seed: int) -> np.ndarray:
    return np.unique(hashes_of(text, words, seed))


def _sketches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = []
            for text in batch["text"].to_pylist():
                hashes = mixed = set_hashes(text, words, seed)
                row = [xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes)]
                for _ in MARKS:
                    row.append(majority(mixed))
                    mixed = remixed(mixed)
                found.append(row)
            columns = np.array(found, np.uint64).reshape(len(found), 2 + len(MARKS)).view(np.int64).T
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["doc_id", "node", "size", *MARKS])

    return run


def _sets(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [set_hashes(text, words, seed).tobytes() for text in batch["text"].to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found, pa.binary())], names=["node", "own"])

    return run


def _with_sets(docs: DataFrame, nodes: DataFrame, placed: DataFrame, words: int, seed: int) -> DataFrame:
    """``nodes`` (column node, repeats allowed) with the shingle set of each as ``own``."""
    wanted = nodes.select("node").distinct().join(placed.select("node", F.col("least").alias("doc_id")), "node").select("doc_id").distinct()
    bodies = texts(docs, "doc_id").join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_sets(words, seed), "node long, own binary")
    return nodes.join(bodies.groupBy("node").agg(F.first("own").alias("own")), "node")


def shared_counts(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, nodes: int) -> np.ndarray:
    """How many of the shingles numbered x each node has, by the lists of nodes of each shingle."""
    sizes = ends[x] - starts[x]
    ends_at = np.cumsum(sizes)
    if not len(x) or not ends_at[-1]:
        return np.zeros(nodes, np.int64)
    places = np.arange(ends_at[-1]) + np.repeat(starts[x] - (ends_at - sizes), sizes)
    return np.bincount(owners[places], minlength=nodes)


def linked_groups(own: dict, sets: list[np.ndarray], wide: int, both: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Groups of one block pair's nodes and their roots: a spanning forest of the candidates that are that similar."""
    names, group = np.unique(own["grp"], return_inverse=True)
    joined = Joined(len(names))
    sizes = np.array([len(s) for s in sets])
    # shingles that at least two nodes have, by number, and who has them
    shingles, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number, minlength=len(shingles)))
    starts = np.r_[0, ends[:-1]]
    at = np.r_[0, np.cumsum(sizes)]
    owners = owner[order]
    for x in range(len(sets) - 1):
        later = np.arange(x + 1, len(sets))
        apart = np.bitwise_count(own["fp"][x] ^ own["fp"][later])
        later = later[(apart <= wide) & (own["size"][later] >= similarity * own["size"][x]) & (similarity * own["size"][later] <= own["size"][x])]
        total = sum(np.bitwise_count(own[m][x] ^ own[m][later]).astype(np.int64) for m in MARKS)
        later = later[(total <= both) & (joined.find(group[later]) != joined.find(group[x : x + 1]))]
        if not len(later):
            continue
        mine = number[at[x] : at[x + 1]]
        if len(later) < 8:
            shared = np.array([len(np.intersect1d(mine, number[at[y] : at[y + 1]], assume_unique=True)) for y in later])
        else:
            shared = shared_counts(mine, starts, ends, owners, len(sets))[later]
        near = later[shared >= similarity * (sizes[x] + sizes[later] - shared)]
        if len(near):
            joined.join(np.r_[group[x], group[near]])
    root = joined.roots()
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _linked(wide: int, both: int, similarity: float):
    def run(table: pa.Table) -> pa.Table:
        found = table.combine_chunks().sort_by("node")
        node = found["node"].to_numpy()
        found = found.filter(pa.array(np.r_[True, node[1:] != node[:-1]]))
        own = {c: found[c].to_numpy().view(np.uint64) if c in MARKS else found[c].to_numpy() for c in (*MARKS, "size", "grp")}
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in found["own"]]
        u, v = linked_groups(own, sets, wide, both, similarity)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return run


def _like_hub(similarity: float):
    """(node, hub) of the rows that are that similar to their hub's, which comes first of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.array([], np.uint64)
        for batch in batches:
            keep = []
            for hub, part, node, own in zip(*(batch[c] for c in ("hub", "part", "node", "own"))):
                now, own = (hub.as_py(), part.as_py()), np.frombuffer(own.as_buffer(), np.uint64)
                if node == hub:
                    at, held = now, own
                shared = len(np.intersect1d(held, own, assume_unique=True)) if at == now and node != hub else -1
                keep.append(shared >= similarity * (len(held) + len(own) - shared) and shared >= 0)
            yield batch.select(["node", "hub"]).filter(pa.array(keep, pa.bool_()))

    return run


def settled(docs: DataFrame, placed: DataFrame, wide: int, near: int, similarity: float, words: int, seed: int) -> DataFrame:
    """(node, hub) of the nodes that are similar to the hub of the nodes which near candidates chain them to."""
    found = cut_lineage(tile_pairs(placed, wide, (*MARKS, "size", "node"), similarity).mapInArrow(_chained(wide, near, similarity), "node long, root long, met long"))
    chained = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = chained.join(found.groupBy("node").agg(F.sum("met").alias("met")), "node")
    hubs = counted.groupBy("component").agg(F.max_by("node", F.struct("met", "node")).alias("hub"), F.count("*").alias("nodes"))
    parts = F.ceil(F.col("nodes") / HELD).cast("long")
    members = chained.join(hubs, "component").where("node <> hub").select("hub", F.pmod(F.xxhash64("node"), parts).alias("part"), "node")
    heads = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("hub").alias("node"))
    full = _with_sets(docs, cut_lineage(members.unionByName(heads)), placed, words, seed)
    ordered = full.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub"))
    return ordered.mapInArrow(_like_hub(similarity), "node long, hub long")


#: Bits of 256 within which candidates are near enough to look for a hub.
NEAREST = 44


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, wide: int = 22, both: int = 64, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): groups of documents that links of the similarity join."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, node long, size long, " + ", ".join(f"{m} long" for m in MARKS)
    marked = cut_lineage(texts(docs, "doc_id").mapInArrow(_sketches(words, seed), schema))
    # equal sets have equal sizes and fingerprints
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("size", *MARKS)))
    nodes = cut_lineage(nodes)
    hubs = cut_lineage(settled(docs, nodes, wide, min(NEAREST, both), similarity, words, seed))
    relieve_executors(docs.sparkSession)  # of the jobs of the components
    placed = cut_lineage(nodes.join(hubs, "node", "left").withColumn("grp", F.coalesce("hub", "node")).drop("hub"))
    columns = (*MARKS, "size", "node", "grp")
    blocks = tile_pairs(placed, wide, columns, similarity).mapInArrow(_open_blocks(wide, both, similarity), ", ".join(f"{c} long" for c in ("u", "v", *columns)))
    full = _with_sets(docs, cut_lineage(blocks), placed, words, seed)
    linked = full.groupBy("u", "v").applyInArrow(_linked(wide, both, similarity), "u long, v long")
    joined = connected_components(linked).select(F.col("node").alias("grp"), "component")
    relieve_executors(docs.sparkSession)
    placed = cut_lineage(placed.join(joined, "grp", "left").select("node", "least", F.coalesce("component", "grp").alias("grp")))
    names = placed.groupBy("grp").agg(F.min("least").alias("component_id"))
    return marked.join(placed.join(names, "grp").select("node", "component_id"), "node").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id, of repeated rows one. Documents
    without an id cannot be named and all stay."""
    grouped = similar_documents(docs.where(F.col("doc_id").isNotNull()), similarity, words)
    kept = cut_lineage(grouped.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    named = lambda what: docs.join(kept.where(what).select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    return named("rows = 1").unionByName(named("rows > 1").dropDuplicates(["doc_id"])).unionByName(docs.where(F.col("doc_id").isNull()))
