import gc
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, decontaminate, quality_rules, simhash_dedup, toxicity_knn
from quern.llm.common import collect_garbage
from tests.llm.data import AWKWARD, docs


def test_stages_and_run_agree(spark, sf):
    docs_now = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, before = docs_now.columns, docs_now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs_now, sf).cache()
        assert after.columns == columns and after.count() <= before
        assert after.join(docs_now, columns, "left_anti").count() == 0
        docs_now, before = after, after.count()
    want = corpus_pipeline.STAGES[-1][1](spark, docs_now, sf)
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash_dedup", "decontamination", "byte_bpe"]


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows, want = [], set()
    for g in range(25):
        base = text(200).split()
        rows.append((g * 10, " ".join(base)))
        want.add(g * 10)
        for c in range(1, 4):
            words = list(base)
            for _ in range(rng.randint(0, 1)):
                words[rng.randrange(200)] = "new"
            rows.append((g * 10 + c, " ".join(words)))
        far = base[:100] + text(100).split()
        rows.append((g * 10 + 9, " ".join(far)))
        want.add(g * 10 + 9)
    assert {r.doc_id for r in simhash_dedup.keep_first(docs(spark, rows)).collect()} == want


def test_links_are_those_of_brute_force_or_surer(spark):
    rng = random.Random(8)
    rows = []
    for g in range(15):
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(120)]
        for c in range(6):
            words = list(base)
            for _ in range(c):
                words[rng.randrange(120)] = "x"
            rows.append((g * 10 + c, " ".join(words)))
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs(spark, rows)).collect()}
    sets = {i: simhash_dedup.shingle_set(t, 5) for i, t in rows}
    for i in sets:
        for j in sets:
            similar = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert similar < 0.88 or found[i] == found[j]
            assert i // 10 == j // 10 or found[i] != found[j]


def test_filters_keep_rows_whole(spark):
    frame = docs(spark, AWKWARD)
    good = quality_rules.keep_good(frame, quality_rules.Rules(5.0, ()))
    assert sorted(map(str, good.collect())) == sorted(map(str, frame.collect())) and good.columns == frame.columns
    assert quality_rules.keep_good(frame, quality_rules.Rules(-5.0, ())).count() == 0
    index = toxicity_knn.Index([(1, ["bad"], [1], 1), (2, ["fine"], [1], 0), (3, [], [], 0)], {"bad": 1, "fine": 1}, 10)
    marked = frame.unionByName(docs(spark, [(99, "so bad, bad.")]))
    clean = toxicity_knn.keep_clean(marked, index)
    assert sorted(map(str, clean.collect())) == sorted(map(str, frame.collect())) and clean.columns == frame.columns
    assert decontaminate.drop_contaminated(frame, spark.createDataFrame([], "item_id long, text string")).count() == len(AWKWARD)
    assert clean.where(F.col("doc_id") == 99).count() == 0


def grouped(spark, rows):
    return {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs(spark, rows)).collect()}


def test_texts_that_share_only_a_repeated_passage_both_stay(spark):
    """Fingerprints over repeats would be ruled by the passage; the sets are alike to about 0.07."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = []
    for g in range(12):
        passage = text(41)
        rows += [(g * 10 + c, " ".join([passage] * 60) + " " + text(300)) for c in range(2)]
    assert grouped(spark, rows) == {i: i for i, _ in rows}


def test_near_fingerprints_link_only_verified_pairs(spark, monkeypatch):
    """Even if every fingerprint is the same, only pairs of the similarity are linked."""
    monkeypatch.setattr(simhash_dedup, "NEAREST", 256)
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = []
    for g in range(6):
        base = text(60).split()
        rows += [(g * 10, " ".join(base)), (g * 10 + 1, " ".join([*base[:-1], "end"]))]
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs(spark, rows), wide=64, both=256).collect()}
    assert found == {i: i // 10 * 10 for i, _ in rows}


def test_a_repeated_line_does_not_hide_a_near_copy(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = []
    for g in range(12):
        body, line = text(300), text(40)
        rows += [(g * 10, f"{body} {line}"), (g * 10 + 1, body + f" {line}" * 60)]
    assert grouped(spark, rows) == {i: i // 10 * 10 for i, _ in rows}


def test_pairs_just_at_the_similarity_are_those_of_brute_force(spark):
    """300 pairs of similarity 0.8 to 0.82, each of other words, and as many of 0.78 to 0.8."""
    rng = random.Random(7)
    text = lambda n: ["".join(rng.choices("abcdefgh", k=8)) for _ in range(n)]
    rows, want = [], {}
    for g in range(600):
        low, high = (0.8, 0.82) if g < 300 else (0.78, 0.7999)
        while True:
            base = text(rng.randint(60, 200))
            n = round(len(base) * rng.uniform(0.08, 0.14))
            other = text(n) + base[n:] if g % 2 else base + text(2 * n)
            x, y = (simhash_dedup.shingle_set(" ".join(t), 5) for t in (base, other))
            if low <= len(x & y) / len(x | y) <= high:
                break
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g if g < 300 else 2 * g + 1}
    assert grouped(spark, rows) == want


def test_a_group_of_near_copies_falls_apart_as_by_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice((1, 4, 6, 9))):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [simhash_dedup.shingle_set(t, 5) for _, t in rows]
    alike = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)]
    label = list(range(len(rows)))
    for _ in rows:
        for i, j in alike:
            label[i] = min(label[i], label[j])
    found = grouped(spark, rows)
    assert [found[i] for i in range(len(rows))] == label and 2 < len(set(label)) < 120


def test_groups_are_those_of_all_pairs_of_the_documents(spark):
    """Links by exact similarity between all documents of a whole table; at least 0.9 must be found, none added."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: simhash_dedup.shingle_set(t or "", 5) for i, t in rows}
    found = {r.doc_id: r.component_id for r in simhash_dedup.similar_documents(docs(spark, rows)).collect()}
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = hits = 0
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                links, hits = links + 1, hits + (found[i] == found[j])
                label[max(root(i), root(j))] = min(root(i), root(j))
    assert links > 50 and hits >= 0.98 * links
    assert all(root(i) == root(found[i]) for i in ids)


def test_a_large_group_of_near_copies_costs_its_size(spark, monkeypatch):
    """Copies of one base within the similarity of it but mostly not of each other, and many repeated rows."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    rows = [(0, " ".join(base))] + [(0, " ".join(base))] * 30
    for i in range(1, 700):
        words = list(base)
        for at in rng.sample(range(0, 200, 10), 4):
            words[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    compared = []
    whole = simhash_dedup._with_sets
    monkeypatch.setattr(simhash_dedup, "_with_sets", lambda docs, nodes, *more: compared.append(nodes.count()) or whole(docs, nodes, *more))
    assert grouped(spark, rows) == dict.fromkeys(range(700), 0)
    assert sum(compared) < 4 * 700


def test_nulls_repeats_and_empty_tables_through_all_stages(spark, tmp_path):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    rows = {
        "documents": [(i, t, None, "s", None) for i, t in AWKWARD],
        "labels": [(i, 1, 0) for i in range(12)] + [(None, None, None), (3, 1, 0), (4, None, 1)],
        "benchmark": [(1, None), (None, "one two three four five six"), (2, "")],
    }
    for folder, some in (("full", rows), ("none", {"documents": [], "labels": [], "benchmark": []}), ("unlabelled", rows | {"labels": []})):
        for name, kind in kinds.items():
            spark.createDataFrame(some[name], kind).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{folder}").collect()
        assert len(got) <= len(some["documents"])
    assert {r.doc_id for r in got} <= {i for i, _ in AWKWARD}


def test_the_drivers_garbage_goes_where_a_result_is_stored(spark, monkeypatch):
    jvm = spark._jvm
    forgotten = lambda: jvm.java.lang.ref.WeakReference(jvm.java.util.ArrayList())
    monkeypatch.setattr(common, "collect_garbage", lambda spark: collect_garbage(spark, 0.0))
    gone = forgotten()
    gc.collect()  # here as well, for the reference from Python
    assert common.cut_lineage(spark.range(3)).count() == 3
    assert gone.get() is None


def test_a_small_heap_is_left_alone(spark):
    class Quiet:
        def __getattr__(self, name):
            raise AssertionError("collected")

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime), System=Quiet())))
    collect_garbage(SimpleNamespace(_jvm=jvm), share=1.0)
    with pytest.raises(AssertionError, match="collected"):
        collect_garbage(SimpleNamespace(_jvm=jvm), share=0.0)


def test_each_stage_begins_with_the_garbage_of_executors_collected(spark, sf, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName())
    before = count()
    common.relieve_executors(spark)  # local: the driver is looked after elsewhere
    assert count() == before
    common.relieve_executors(spark, local=True)
    assert count() > before
    begun = []
    monkeypatch.setattr(corpus_pipeline, "relieve_executors", lambda s: begun.append(s))
    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, frame, sf)
    assert len(begun) == 5


def test_a_collection_gives_back_the_heap_that_it_frees(spark):
    jvm = spark._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    held = [spark.sparkContext._gateway.new_array(jvm.long, 2 << 20) for _ in range(40)]
    assert runtime.totalMemory() > 40 * (16 << 20)
    del held
    gc.collect()
    time.sleep(2)  # until Python's references are gone in the JVM as well
    before = common.free_heap(spark, 40, 70)
    collect_garbage(spark, share=0.0)
    assert runtime.freeMemory() < 0.6 * runtime.totalMemory()
    assert common.free_heap(spark, *before) == (40, 70)  # set back
    assert common.free_heap(spark) == ()
