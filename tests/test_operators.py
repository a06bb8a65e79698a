import datetime as dt
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import native_gaps, texts, times
from quern.functions.rules import all_reasons, any_of_groups, first_rule
from quern.functions.vectors import cosine
from quern.operators import intervals, matching, ranking
from quern.operators.grid import gap_centres, grid
from quern.operators.partitions import once_each


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_an_event_that_ends_where_the_range_starts_is_inside_only_by_the_inclusive_rule(spark):
    rows = [(1, ts("2024-01-01"), ts("2024-01-10"), None), (2, ts("2024-03-01"), ts("2024-03-02"), ts("2024-01-15")), (3, None, None, None), (4, ts("2024-01-12"), None, None)]
    e = spark.createDataFrame(rows, "id long, start timestamp_ntz, end timestamp_ntz, deadline timestamp_ntz")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10", "2024-01-20"))
    test = lambda inclusive: {r.id for r in e.where(intervals.occurs(F.col("start"), F.col("end"), F.col("deadline"), low, high, inclusive)).collect()}
    assert test(True) == {1, 2} and test(False) == {2}
    assert {r.id for r in e.where(intervals.active_or_future(F.col("deadline"), F.col("end"), F.col("start"), low)).collect()} == {1, 2, 4}


def test_overrides_replace_values_and_nulls_do_not(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, title string, n int")
    links = spark.createDataFrame([(1, None, 7, True)], "id long, override_title string, override_n int, is_hidden boolean")
    got = {r.id: (r.title, r.n, r.is_hidden) for r in intervals.with_overrides(base, links, ["id"], ["title", "n"]).collect()}
    assert got == {1: ("a", 7, True), 2: ("b", None, None)}


def test_weeks_start_on_monday_and_count_from_the_first_one(spark):
    days = spark.createDataFrame([(dt.date(2024, 9, d),) for d in (1, 2, 8, 9, 30)], "day date")
    got = days.select(times.week_of_month(F.col("day")).alias("w"), times.week_start(F.col("day")).alias("s"), times.nearest_weekday(F.col("day"), 4).alias("friday")).collect()
    assert [r.w for r in got] == [None, 1, 1, 2, 5]
    assert [r.s.day for r in got] == [26, 2, 2, 9, 30] and [r.friday.day for r in got] == [30, 6, 6, 13, 4]


def test_runs_ranks_and_turns(spark):
    days = spark.createDataFrame([("a", dt.date(2024, 1, d)) for d in (1, 2, 3, 4, 8, 9)] + [("b", dt.date(2024, 1, 5))], "k string, day date")
    got = [(r.k, r.day.day, r.run_length, r.run_position) for r in ranking.islands(days, ["k"], "day").orderBy("k", "day").collect()]
    assert got == [("a", 1, 4, 1), ("a", 2, 4, 2), ("a", 3, 4, 3), ("a", 4, 4, 4), ("a", 8, 2, 1), ("a", 9, 2, 2), ("b", 5, 1, 1)]
    rows = spark.createDataFrame([(i, "ab"[i > 3]) for i in range(6)], "id long, bucket string")
    assert [r.id for r in ranking.interleave(rows, "bucket", ["id"], 5).collect()] == [0, 4, 1, 5, 2]
    assert [r.id for r in ranking.first_per_key(rows, ["bucket"], ["id"], rank=3).collect()] == [2]
    assert [r.id for r in ranking.page(rows, ["id"], 2, 4).collect()] == [4, 5] and ranking.page(rows, ["id"], 9, 4).count() == 0
    assert [(r.bucket, r.n_removed) for r in ranking.duplicate_groups(rows.where("id <> 5"), ["bucket"], "id").collect()] == [("a", 3)]


def test_spread_ranks_are_plain_ranks(spark):
    from pyspark.sql import Window as W

    rows = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("key"))
    got = ranking.spread_rank(rows.unionByName(rows.where("id < 20")), "g", "key", "id", digits=1)
    plain = got.withColumn("want", F.row_number().over(W.partitionBy("g").orderBy("key", "id"))).withColumn("size", F.count("*").over(W.partitionBy("g")))
    assert plain.count() == 520 and plain.where("size <> group_size").count() == 0
    ranks = lambda c: sorted((r.g is None, r.g, r.id, r[c]) for r in plain.where("id >= 20").collect())
    assert [x for x in ranks("rank") if not x[0]] == [x for x in ranks("want") if not x[0]]


def test_matches_take_the_first_step_and_the_smallest_id(spark):
    left = spark.createDataFrame([(1, "u", "t"), (2, None, "t"), (3, "z", None)], "l long, url string, title string")
    right = spark.createDataFrame([(10, "u", "x"), (11, "u", "t"), (12, None, "t"), (9, "q", "t")], "r long, url string, title string")
    got = sorted(tuple(r) for r in matching.match_waterfall(left, right, "l", "r", [("url", "url"), ("title", "title")]).collect())
    assert got == [(1, 10, 0), (2, 9, 1)]


def test_changes_treat_nulls_as_equal(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "id long, v string")
    new = spark.createDataFrame([(1, None), (2, None), (4, "b")], "id long, v string")
    got = {r.id: r.change for r in matching.classify_changes(old, new, ["id"], ["v"]).collect()}
    assert got == {1: "skip", 2: "update", 3: "delete", 4: "insert"}
    assert sorted((r.id, r.v) for r in matching.upsert(old, new, ["id"]).collect()) == [(1, None), (2, None), (3, "a"), (4, "b")]


def fold(text, size, overlap, whole=False):
    """Chunks by a plain loop: blank lines part paragraphs, a text without any is one."""
    done, own, used = [], [], 0
    for part in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()] or [text]:
        if own and used + len(part) > size:
            done.append("\n\n".join(own))
            own = [own[-1] if whole else done[-1][-overlap:]]
            used = len(own[0])
        own.append(part)
        used += len(part)
    return [*done, "\n\n".join(own)]


def test_chunks_are_those_of_the_fold(spark):
    rows = ["", "one", "\n\n", " \n", "\n\n".join("p" * n for n in (50, 30, 90, 5, 5, 100, 1)), "\n \n".join(f"line {i}\nand " * (i % 4 + 1) for i in range(40))]
    frame = spark.createDataFrame([(t,) for t in [*rows, None]], "text string")
    got = frame.select(texts.paragraph_chunks(F.col("text"), 100, 12).alias("a"), texts.paragraph_chunks(F.col("text"), 100, whole_paragraph=True).alias("b")).collect()
    assert [r.a for r in got] == [*(fold(t, 100, 12) for t in rows), []]
    assert [r.b for r in got] == [*(fold(t, 100, 12, True) for t in rows), []]


def test_text_expressions(spark):
    row = spark.createDataFrame([("Mail a.b@c.org, 010-1234-5678, 12345678!", "Été  là\n", "First. Second part. Tail")], "a string, b string, c string")
    got = row.select(
        texts.mask_personal(F.col("a")).alias("masked"), texts.normal_text(F.col("b")).alias("normal"), texts.word_tokens(F.col("b")).alias("words"),
        texts.fingerprint(F.lit("  ")).alias("blank"), texts.cut_at_sentence(F.col("c"), 20).alias("cut"), texts.ascii_ratio(F.lit("ab")).alias("ratio"),
    ).first()
    assert got.masked == "Mail [EMAIL], [PHONE], [ID]!" and got.normal == "été là" and got.words == ["été", "là"]
    assert got.blank == "" and got.cut == "First. Second part." and got.ratio == 1.0


def test_functions_without_built_ins(spark):
    row = spark.createDataFrame([("ﬁ①", [10, 20, 30])], "t string, n array<int>")
    got = row.select(native_gaps.compatibility_form("t").alias("t"), texts.fitted_count(F.col("n"), 5, 36).alias("fit"), texts.fitted_count(F.col("n"), 99, 36).alias("one"), native_gaps.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("ratio")).first()
    assert (got.t, got.fit, got.one, got.ratio) == ("fi1", 2, 1, 0.75)


def test_repeated_sentences_go_within_their_memory(spark):
    cases = {
        "A one.  B two. A one. C": "A one. B two. C",
        "a. b.\n\n\n\nA. a.\nb.  c.": "a. b.\n\nA.\nc.",
        "a. b. c. d. e. f. g. a. g.": "a. b. c. d. e. f. g. a.",
        "같다 했다 같다 했다 3.5 x": "같다 했다 3.5 x",
        "": "",
        " x\n": "x",
    }
    frame = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert [r.t for r in frame.select(texts.without_repeats(F.col("t")).alias("t")).collect()] == [*cases.values(), None]


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], [])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0]


def test_rules_fold_in_order(spark):
    row = spark.createDataFrame([(5, None)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    got = row.select(first_rule([(b > 1, "null"), (a > 4, "first"), (a > 1, "second")], "none").alias("f"), all_reasons([(a > 1, "x"), (b > 1, "y"), (a > 4, "z")]).alias("r"), any_of_groups([[a > 9, a > 4], [b > 1]]).alias("g")).first()
    assert (got.f, got.r, got.g) == ("first", ["x", "z"], False)


def test_grid_cells(spark):
    lines = spark.createDataFrame([([100.0, 0.0, 10.0, 16.0],), ([],), ([5.0, 5.0],), ([0.0, 10.0, 10.0],)], "v array<double>")
    assert [r.c for r in lines.select(gap_centres(F.col("v"), 16.0).alias("c")).collect()] == [[10.5, 100.0], [], [5.0], [7.5]]
    boxes = [(1, "b", 100, 0, 140, 10, 0.5), (1, "a", 0, 0, 40, 10, 1.0), (1, "c", 0, 60, 40, 70, 0.5), (1, "d", 2, 62, 42, 72, 1.0), (2, "solo", 0, 0, 1, 1, None)]
    frame = spark.createDataFrame([(p, t, *map(float, xy), c) for p, t, *xy, c in boxes], "page long, text string, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = sorted((r.page, r.row_no, r.column_no, r.text, r.n_boxes) for r in grid(frame).collect())
    assert got == [(1, 0, 0, "a", 1), (1, 0, 1, "b", 1), (1, 1, 0, "c d", 2), (2, 0, 0, "solo", 1)]


def test_best_matches_by_kinds_are_those_of_plain_loops_from_few_pairs(spark, tmp_path, monkeypatch):
    from quern.queries import joins

    nations = [(0, "Peru"), (1, None), (2, ""), (3, "oman")]
    suppliers = [(i, i % 4) for i in range(-20, 400)]
    parts = [(i, None if i % 41 == 0 else i * 7 % 50, (None, "", "plate", "Old ring", "x")[i % 5]) for i in range(-30, 3000, 3)]
    for name, rows, kind in (("nation", nations, "n_nationkey int, n_name string"), ("supplier", suppliers, "s_suppkey long, s_nationkey int"), ("part", parts, "p_partkey long, p_size int, p_name string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    rest = lambda a, b: abs(a) % b * (1 if a >= 0 else -1)
    want, full = {}, 0
    for key, nation in suppliers:
        place = dict(nations)[nation]
        for part, size, name in parts:
            if rest(part, 25) == rest(key, 25):
                full += 1
                word = None not in (place, name) and place[:1].lower() == name[:1].lower()
                score = None if size is None else 2 * word + (abs(size - rest(key, 50)) <= 5) + (rest(part, 10) == rest(key, 10))
                if score is not None and score >= 2:
                    want[key] = max(want.get(key, (-1, 0)), (score, -part))
    sizes = []
    own = joins.best_match
    monkeypatch.setattr(joins, "best_match", lambda pairs, *rest: sizes.append(pairs.count()) or own(pairs, *rest))
    got = {r.s_suppkey: (r.score, -r.p_partkey) for r in joins.fuzzy_best_match(spark, str(tmp_path)).collect()}
    assert got == want
    assert sizes[0] < full / 2


def test_batch_search_by_products_is_that_of_plain_loops_with_copies_and_odd_vectors(spark, monkeypatch):
    import numpy as np

    from quern.plans import retrieval

    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    vectors = [list(map(float, v)) for v in np.vstack([np.repeat(base, 25, axis=0), base[:1] + 1e-3 * rng.normal(size=(60, 8)), np.zeros((3, 8))])]
    vectors += [None, [], [1.0, 2.0], [2.0, 1.0], [1.0, None], [None] * 8, [float("inf")] + [0.0] * 7, [float("nan")] * 8, [float("nan")] * 8]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)]
    index = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = index.where("id % 5 = 0 OR id > 999 OR id < 645").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    scored = index.join(asked).select("query_id", "id", F.round(cosine(F.col("vector"), F.col("q")), 4).alias("score"))
    ranked = scored.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("r <= 5 AND score > 0")
    want = sorted((r.query_id, r.id, str(r.score)) for r in ranked.collect())
    monkeypatch.setattr(retrieval, "PACK", 50)
    passes = []
    own = retrieval.in_passes
    monkeypatch.setattr(retrieval, "in_passes", lambda *a: passes.append(len(own(*a))) or own(*a))
    got = retrieval.vector_hits(index, asked, 5)
    assert sorted((r.query_id, r.id, str(r.score)) for r in got.collect()) == want
    many = spark.range(2000).select(F.col("id").alias("query_id"), F.array(F.col("id") + 1.0).alias("q"))
    retrieval.vector_hits(index, many, 5)
    assert passes == [1, 1]  # 2,000 questions took four passes over the index


def test_exact_cosines_are_those_of_column_expressions_to_the_last_bit(spark):
    import numpy as np

    from quern.plans.retrieval import exact_cosines

    a, b = np.random.default_rng(5).normal(size=(2, 200, 64))
    rows = [(i, list(map(float, x)), list(map(float, y))) for i, (x, y) in enumerate(zip(a, b))]
    want = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()
    assert exact_cosines(a, b).tolist() == [r.c for r in want]


def test_lexical_hits_in_small_parts_are_those_of_plain_loops(spark, monkeypatch):
    from quern.plans import retrieval

    words = "a b c d e f g h i j k l m n".split()
    documents = [(i, None if i % 31 == 3 else " ".join(w for j, w in enumerate(words) if (i >> j % 7) & 1 or i % (j + 2) == 0) + " zz zz") for i in range(400)]
    questions = [(1, " ".join(words) + " A b"), (2, "a zz"), (3, "nothing here"), (4, None), (5, ""), (6, "n m n")]
    want = set()
    for q, text in questions:
        asked = set((text or "").lower().split())
        scored = sorted((-round(min(1.0, len(asked & set((t or "").split())) * 0.1), 4), i) for i, t in documents)
        want |= {(q, i, -score) for score, i in scored[:20] if score < 0}
    monkeypatch.setattr(retrieval, "DOCUMENTS", 7)
    d, q = spark.createDataFrame(documents, "id long, text string").repartition(3), spark.createDataFrame(questions, "query_id int, question string")
    found = retrieval.lexical_hits(d, q, 20)
    assert {(r.query_id, r.id, r.score) for r in found.collect()} == want
    monkeypatch.setattr(retrieval, "LEXICAL_PASS", 2)
    assert {(r.query_id, r.id, r.score) for r in retrieval.lexical_hits(d, q, 20).collect()} == want
    # pairs of texts and questions are not grouped
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_reparse_keeps_what_an_order_protects_in_partitions_of_bounded_size(spark, tmp_path, monkeypatch):
    from quern.operators import partitions
    from quern.queries import records

    rows = [(None if i % 50 == 7 else i // 4, i % 4 + 1, float(i), (None, "F", "O", "O", "O", "O", "O")[i % 7]) for i in range(4000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    kept = {r[0] for r in rows if r[3] == "F"} - {None}
    want = {(r[0], r[1], r[2] if r[0] in kept else 2 * r[2], "old" if r[0] in kept else "new") for r in rows}
    monkeypatch.setattr(partitions.dealt, "__kwdefaults__", {"rows": 500})
    found = records.protected_reparse(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == want and found.count() == 4000
    assert found.rdd.getNumPartitions() >= 8  # by bytes all lines were one partition


def test_hashed_words_are_shuffled_with_their_text_only(spark, sf):
    from quern.queries import retrieval

    plan = retrieval.hash_embed_sparse(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_equal_rows_are_read_once_and_nulls_are_equal(spark):
    days = [None, dt.date(2026, 1, 1)]
    rows = [(i, f"q{i % 3}", days[i % 2]) for i in range(60)] + [(60, None, None)]
    df, seen = spark.createDataFrame(rows, "id long, t string, day date"), spark.sparkContext.accumulator(0)

    def read(own):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return own.mapInArrow(count, own.schema).withColumn("n", F.concat_ws("|", F.coalesce("t", F.lit("none")), F.coalesce(F.col("day").cast("string"), F.lit("none"))))

    got = {r.id: (r.t, r.day, r.n) for r in once_each(df, read, "t", "day").collect()}
    assert got == {i: (t, d, f"{t or 'none'}|{d or 'none'}") for i, t, d in rows}
    assert seen.value == 7
