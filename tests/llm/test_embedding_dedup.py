import math

import numpy as np
import pytest

from quern.llm import embedding_dedup


def brute(rows, cosine=0.95):
    """(id, n_links, component, kept) by comparing all pairs of rows."""
    sound = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        sound.append(np.array(v, float) / max(map(abs, v)) if ok else None)
    linked = [[] for _ in rows]
    for i, a in enumerate(sound):
        for j, b in enumerate(sound):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                linked[i].append(j)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in linked[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        component = None if key is None else min(rows[j][0] for j in seen)
        out.append((key, len(linked[i]), component, key is not None and component == key))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], "vec_id long, embedding array<double>, label int, copies int")
    return sorted((tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()), key=str)


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.3]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
        (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-200, 0.0]), (13, [1e200, 1e199]),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(4, None)]) == [(4, 0, 4, True)]


@pytest.mark.parametrize("dim", [3, 16])
def test_clouds_of_copies_and_scattered_vectors(spark, dim, monkeypatch):
    for name, value in (("LEAST_PACK", 32), ("MOST_PACK", 64), ("LEAF", 4)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(12, dim))
    near = np.repeat(centres, 15, axis=0) + rng.normal(scale=0.15, size=(180, dim))
    points = np.concatenate([near, near[:40], rng.normal(size=(80, dim))])
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(points)), points)]
    assert run(spark, rows) == brute(rows)


def test_query_is_that_of_brute_force(spark, sf):
    from quern.llm.queries import op5_embedding_dedup

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op5_embedding_dedup(spark, sf).collect()), key=str) == brute(rows)


def tree_of(points):
    order, nodes, radius = embedding_dedup.grow(points)
    assert sorted(order) == list(range(len(points)))
    return order, embedding_dedup.Tree(points[order], nodes, radius)


def clustered():
    rng = np.random.default_rng(5)
    return embedding_dedup._unit(np.repeat(rng.normal(size=(30, 8)), 40, axis=0) + rng.normal(scale=0.02, size=(1200, 8)))


def test_nets_nest_cover_and_separate():
    for points in (clustered(), embedding_dedup._unit(np.random.default_rng(1).normal(size=(600, 64)))):
        _, tree = tree_of(points)
        away = lambda x, y: np.linalg.norm(tree.unit[x] - tree.unit[y], axis=-1)
        assert tree.last[0] > 0
        for node in range(len(tree.start)):
            own = np.arange(tree.start[node], tree.end[node])
            assert away(own, tree.centre[node]).max() <= tree.radius[node] + 1e-12
            parts = np.arange(tree.first[node], tree.last[node])
            if len(parts):
                assert (tree.start[parts[0]], tree.end[parts[-1]]) == (tree.start[node], tree.end[node]) and (tree.end[parts[:-1]] == tree.start[parts[1:]]).all()
                assert tree.centre[node] in tree.centre[parts] and (tree.radius[parts] <= tree.radius[node] / 2 + 1e-4).all()
                assert all(away(tree.centre[parts], tree.centre[p])[parts != p].min(initial=9) > tree.radius[node] / 2 - 1e-4 for p in parts)
            else:
                assert len(own) <= embedding_dedup.LEAF or tree.radius[node] <= embedding_dedup.POINT


def test_traversal_gives_the_links_of_all_pairs_and_prunes_clusters():
    for points, share in ((clustered(), 0.1), (embedding_dedup._unit(np.random.default_rng(1).normal(size=(1200, 64))), 0.7)):
        copies = np.random.default_rng(2).integers(1, 4, len(points))
        close = points @ points.T >= 0.95
        np.fill_diagonal(close, False)
        order, tree = tree_of(points)
        linked, _, joined, compared = embedding_dedup.traverse(tree, None, copies[order], None, 0.95)
        assert (linked == (close @ copies)[order]).all() and compared <= share * len(points) ** 2
        groups = joined.roots()
        assert (groups[:, None] == groups[None, :])[close[np.ix_(order, order)]].all()
        half = len(points) // 2
        (left, a), (right, b) = tree_of(points[:half]), tree_of(points[half:])
        linked_a, linked_b, _, compared = embedding_dedup.traverse(a, b, copies[:half][left], copies[half:][right], 0.95)
        assert (linked_a == (close[:half, half:] @ copies[half:])[left]).all() and (linked_b == (close[half:, :half] @ copies[:half])[right]).all()


def test_upper_nets_prune_far_leaves_only():
    rng = np.random.default_rng(3)
    sample = embedding_dedup._unit(np.repeat(rng.normal(size=(12, 16)), 20, axis=0) + rng.normal(scale=0.05, size=(240, 16)))
    centres, parents = embedding_dedup.upper_nets(sample, 40)
    assert len(parents) > 1 and (parents[0] == 0).all() and all(set(up) <= set(down) for up, down in zip(parents, parents[1:]))
    assert all(len(set(up[down == n])) == 1 for up, down in zip(parents, parents[1:]) for n in down)  # chains
    nearest = (sample @ centres.T).argmax(1)
    radii = np.array([np.linalg.norm(sample[nearest == i] - c, axis=1).max(initial=0) for i, c in enumerate(centres)])
    kept = set(embedding_dedup.surviving_leaves(centres, parents, radii, 0.3))
    want = {(min(nearest[i], nearest[j]), max(nearest[i], nearest[j])) for i, j in zip(*np.nonzero(np.linalg.norm(sample[:, None] - sample[None], axis=2) <= 0.3))}
    assert want <= kept and len(kept) < len(centres) * (len(centres) + 1) / 2
