import math
import random
import sys
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import toxicity_knn
from quern.llm.common import crc_bucket
from tests.llm.data import AWKWARD, docs
from tests.llm.test_quality_rules import auc


def example(doc_id, text, label):
    found = toxicity_knn.terms_of(text)
    return doc_id, list(found), list(found.values()), label


def test_held_out_accuracy_and_calibration(spark):
    from quern.llm.queries import op3_toxicity

    sf = "/root/testdata/sf0.1"
    got = op3_toxicity(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc(rows, "score", "toxic") > 0.96
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.98
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # scores as probabilities: mean score and share of toxic ones, in all and in thirds of the scale
    for low, high in ((0, 1.01), (0, 1 / 3), (2 / 3, 1.01)):
        some = [r for r in rows if low <= r.score < high]
        assert abs(sum(r.score for r in some) - sum(r.toxic for r in some)) <= 0.08 * len(some) + 2


def plain_score(text, examples, frequencies, documents, k=15):
    """Votes by brute force over all examples, in plain loops."""
    have = {t: [0, 0] for _, terms, _, _ in examples for t in terms}
    for _, terms, _, label in examples:
        for t in terms:
            have[t][label] += 1
    weight = {t: (math.log((1 + documents) / (1 + frequencies.get(t, 0))) + 1) * math.log2(2 + a / max(1, c)) ** 2 for t, (c, a) in have.items()}

    def vector(found):
        own = {t: (1 + math.log(n)) * weight[t] for t, n in found.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in own.values())) or 1
        return {t: x / norm for t, x in own.items()}

    query = vector(toxicity_knn.terms_of(text))
    ranked = sorted(((sum(query.get(t, 0) * x for t, x in vector(dict(zip(terms, counts))).items()), label) for _, terms, counts, label in examples), reverse=True)
    ranked = [r for r in ranked if r[0] > 0]
    share = (sum(e[3] for e in examples) + 0.5) / (len(examples) + 1)
    if not ranked:
        blank = [e[3] for e in examples if not e[1]]
        return (sum(blank) + 0.5 * share) / (len(blank) + 0.5)
    least = ranked[min(k, len(ranked)) - 1][0]
    votes = [(1 / (1.05 - min(c, 1)), label) for c, label in ranked if c >= least - 1e-12]
    return (sum(w * y for w, y in votes) + 0.5 * share) / (sum(w for w, _ in votes) + 0.5)


def test_neighbours_and_scores_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity_knn, "BLOCK", 40)
    rng = random.Random(3)
    terms = [f"t{i}" for i in range(60)]
    draw = lambda: " ".join(rng.choices(terms, weights=range(1, 61), k=rng.randint(0, 12)))
    examples = [example(i, draw(), rng.randint(0, 1)) for i in range(900)]
    frequencies = {t: 1 + i * 7 for i, t in enumerate(terms)}
    index = toxicity_knn.Index(examples, frequencies, 1000)
    assert index.blocks == -(-sum(1 for e in examples if e[1]) // 40)
    assert 0 < len(index.common) < 60
    queries = [draw() for _ in range(80)] + ["", "unknown", "t3", "t59 t59 unknown"]
    for text, (score, _) in zip(queries, index.scores(queries)):
        assert math.isclose(score, plain_score(text, examples, frequencies, 1000), rel_tol=1e-9)


def test_half_of_the_blocks_are_skipped_at_the_registered_parameters(spark):
    """Over held-out texts of sf0.1; the neighbours are those of all blocks."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    rows = read("documents").join(read("labels"), "doc_id", "left").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    frequencies = Counter(t for r in rows for t in toxicity_knn.terms_of(r.text or ""))
    used = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5 != 0
    examples = [example(r.doc_id, r.text or "", r.toxic) for r in rows if r.toxic is not None and used(r)]
    index = toxicity_knn.Index(random.Random(5).sample(examples, toxicity_knn.EXAMPLES), frequencies, len(rows))
    assert index.blocks > 150
    searches = list(index.searches([r.text or "" for r in rows if not used(r)][:500]))
    scored = 0
    for n, search in enumerate(s for s in searches if s):
        numbers, cosines, blocks = index.nearest(*search)
        scored += blocks
        if n < 60:
            every = dict(zip(*index.nearest(*search, k=len(index.ids))[:2]))
            least = sorted(every.values())[-toxicity_knn.NEIGHBOURS]
            assert set(numbers) == {i for i, c in every.items() if c >= least - 1e-12}
    assert scored <= 0.5 * index.blocks * len(searches)


def test_one_long_example_does_not_drop_the_others(spark, monkeypatch):
    monkeypatch.setattr(toxicity_knn, "LONGEST", 50)
    monkeypatch.setattr(toxicity_knn, "POSTINGS", 300)
    rows = [(i, " ".join(f"w{n}" for n in range(1000 if i % 3 == 0 else 3)) + f" own{i}") for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    index = toxicity_knn.fit(docs(spark, rows), labels, F.lit(True))
    assert sorted(index.ids) == [i for i in range(30) if i % 3]


def test_query_scores_are_those_of_brute_force(spark, sf):
    from quern.llm.queries import op3_toxicity

    docs_now = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    usable = sorted(i for i in labels if i in docs_now and zlib.crc32(str(i).encode()) % 5)
    distinct = {(docs_now[i], labels[i]): i for i in reversed(usable)}
    examples = [example(i, t, y) for (t, y), i in distinct.items()]
    frequencies = Counter(t for text in docs_now.values() for t in toxicity_knn.terms_of(text))
    got = {r.doc_id: r.score for r in op3_toxicity(spark, sf).collect()}
    assert len(got) == len(docs_now)
    for i in sorted(docs_now)[:60]:
        assert math.isclose(got[i], plain_score(docs_now[i], examples, frequencies, len(docs_now)), rel_tol=1e-9)


def test_awkward_rows(spark):
    rows = [*AWKWARD, *((100 + i, f"bad{i % 3}, word{i} the") for i in range(60)), *((200 + i, f"fine word{i} the") for i in range(200))]
    labels = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(200)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    frame = docs(spark, rows)
    index = toxicity_knn.fit(frame, labels, F.lit(True))
    got = {(r.doc_id, r.predicted) for r in toxicity_knn.score_toxicity(frame, index).collect()}
    assert {i for i, p in got if p == 1} == {100 + i for i in range(60)}
    assert toxicity_knn.score_toxicity(docs(spark, []), index).collect() == []
    blank = toxicity_knn.fit(docs(spark, []), labels, crc_bucket(F.col("doc_id"), 5) != 0)
    assert {round(r.score, 3) for r in toxicity_knn.score_toxicity(frame, blank).collect()} == {0.5}


def test_terms_are_looked_up_without_a_step_of_python_for_each_word():
    words = [f"w{i}" for i in range(2000)]
    index = toxicity_knn.Index([example(1, " ".join(words), 1), example(2, "other", 0)], {}, 10)
    text, steps = " ".join(f'"W{i}",' for i in range(2000)) + " -- unknown", []
    sys.setprofile(lambda frame, event, arg: steps.append(event))
    terms, _ = index.vector(toxicity_knn.terms_of(text))
    sys.setprofile(None)
    assert sorted(terms) == sorted(index.number[w] for w in words)
    assert len(steps) < 200


def test_few_looks_at_the_bounds_where_no_block_can_be_skipped(monkeypatch):
    """Each look takes the ranges of some postings once; before, there were two of them for every STEP blocks."""
    monkeypatch.setattr(toxicity_knn, "STEP", 2)
    index = toxicity_knn.Index([example(i, f"same own{i}", 0) for i in range(toxicity_knn.BLOCK * 200)], {}, 10_000)
    looks, plain = [], toxicity_knn.spans
    monkeypatch.setattr(toxicity_knn, "spans", lambda *a: looks.append(1) or plain(*a))
    (search,) = index.searches(["same"])
    found, cosines, blocks = index.nearest(*search)
    assert blocks == index.blocks == 200 and len(found) == len(index.ids)
    assert len(looks) <= 12
