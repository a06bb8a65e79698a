from collections import Counter

import numpy as np
import pytest
import xxhash

from quern.llm import simhash_dedup
from quern.llm.components import connected_components
from tests.llm.data import AWKWARD, docs


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def groups(found, radius):
    """Brute force: (id, fingerprint) -> smallest id reachable."""
    label = list(range(len(found)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(found):
            for j, (_, b) in enumerate(found):
                if label[j] < label[i] and (a ^ b).bit_count() <= radius:
                    label[i], changed = label[j], True
    out = {}
    for i, (key, _) in enumerate(found):
        if key is not None:
            out[label[i]] = min(out.get(label[i], key), key)
    return [(key, fp, out.get(label[i])) for i, (key, fp) in enumerate(found)]


def compare(spark, rows, monkeypatch=None):
    got = simhash_dedup.near_duplicates(docs(spark, rows)).collect()
    want = groups([(i, plain_fingerprint(t or "")) for i, t in rows], 4)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_awkward_rows_are_grouped_as_by_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 6
    compare(spark, [*AWKWARD, (20, base), (21, base.upper()), (22, base + "end"), (23, base + "end of it"), (11, "one two")])


def test_query_is_that_of_brute_force(spark, sf):
    from quern.llm.queries import op4_simhash_dedup

    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op4_simhash_dedup(spark, sf).collect())
    assert got == sorted(groups(rows, 4))


@pytest.mark.parametrize("seed", [0, 1])
def test_tiles_link_what_all_pairs_link(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "LEAST_TILE", 16)
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 40)
    found = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 6))) for c in np.repeat(centres, 8)})
    linked = simhash_dedup.links(spark.createDataFrame([(f,) for f in found], "fp long"), 4)
    placed = {r.node: r.component for r in connected_components(linked).collect()}
    want = groups([(f, f) for f in found], 4)
    assert {f: placed.get(f, f) for f in found} == {f: c for f, _, c in want}


def test_tiles_give_every_open_pair_once(spark, monkeypatch):
    """Blocks and nodes of the open pairs within and across tiles against all pairs, with all limits."""
    for name, value in (("LEAST_TILE", 16), ("BLOCK_NODES", 5), ("STRIDE", 7), ("ROWS", 3)):
        monkeypatch.setattr(simhash_dedup, name, value)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 62, (20, 4))
    flips = lambda: sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 12)))
    rows = [(i, *(int(x) ^ flips() for x in c), int(rng.integers(50, 70)), int(rng.integers(0, 60))) for i, c in enumerate(np.repeat(centres, 8, axis=0))]
    columns = ("node", *simhash_dedup.MARKS, "size", "grp")
    frame = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))
    pairs = simhash_dedup.tile_pairs(frame, 14, (*simhash_dedup.MARKS, "size", "node", "grp"), 0.8)
    schema = ", ".join(f"{c} long" for c in ("u", "v", *simhash_dedup.MARKS, "size", "node", "grp"))
    got = [(r.u, r.v, r.node) for r in pairs.mapInArrow(simhash_dedup._open_blocks(14, 40, 0.8), schema).collect()]
    assert len(got) == len(set(got))
    apart = lambda x, y: (x ^ y).bit_count()
    alike = lambda a, b: apart(a[1], b[1]) <= 14 and sum(map(apart, a[1:5], b[1:5])) <= 40 and min(a[5], b[5]) >= 0.8 * max(a[5], b[5])
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if alike(a, b) and a[6] != b[6]}
    assert len(want) > 50
    together: dict = {}
    for u, v, node in got:
        together.setdefault((u, v), set()).add(node)
    # each pair meets in some pair of blocks, and no node comes without a partner there
    assert all(any({x, y} <= held for held in together.values()) for x, y in want)
    assert all(any((min(x, y), max(x, y)) in want for y in held if y != x) for held in together.values() for x in held)


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "x y z"), (None, "x y z"), (None, None), (7, "")]
    kept = simhash_dedup.keep_first(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "ids", "words"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e"), (2, "x y z"), (None, "x y z"), (None, None), (7, "")], key=str)
    assert simhash_dedup.keep_first(docs(spark, [])).collect() == []


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)], "u long, v long")
    placed = {r.node: r.component for r in connected_components(edges).collect()}
    assert placed == {i: 0 for i in range(201)} | {300: 300, 301: 300}
    assert connected_components(edges.where("false")).collect() == []


def test_joined_places():
    rng = np.random.default_rng(1)
    joined, pairs = simhash_dedup.Joined(300), rng.integers(0, 300, (150, 2))
    joined.pairs(pairs[:100, 0], pairs[:100, 1])
    for x, y in pairs[100:]:
        joined.join(np.array([x, y]))
    label = list(range(300))
    for _ in range(300):
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
    assert joined.roots().tolist() == label
