import random
from collections import deque

from pyspark.sql import functions as F

from quern.functions import budgets, pages
from quern.operators import frontier


def fit(fixed, chunks, shots, memory, style, budget):
    """The same on texts, one thing after the other."""
    chunks, shots, memory, style = ["c" * n for n in chunks], ["s" * n for n in shots], "m" * memory, "y" * style
    tokens = lambda: max(1, len("\n".join(["f" * fixed, "\n".join(chunks), "\n".join(shots), memory, style])) // 4)
    while tokens() > budget:
        if memory:
            memory = memory[: len(memory) // 2]
        elif len(shots) > 1:
            shots.pop()
        elif chunks:
            i = max(range(len(chunks)), key=lambda k: len(chunks[k]))
            if len(chunks[i]) > 300:
                chunks[i] = chunks[i][: max(300, len(chunks[i]) // 2)]
            else:
                chunks.pop()
        elif style:
            style = style[: len(style) // 2]
        else:
            break
    return [len(c) for c in chunks], len(shots), len(memory), len(style), tokens()


def test_parts_fit_as_texts_do(spark):
    rng = random.Random(6)
    cases = [(100, [], [], 0, 0), (9000, [], [5], 10, 50), (9000, [400, 400, 301], [50], 0, 900), (10, [5000, 5000, 200], [100, 200, 300], 100_000, 400), (3000, [300] * 9, [1, 2], 1, 1)]
    cases += [(rng.randint(0, 3000), [rng.randint(0, 4000) for _ in range(rng.randint(0, 8))], [rng.randint(0, 900) for _ in range(rng.randint(0, 4))], rng.randint(0, 9000), rng.randint(0, 3000)) for _ in range(60)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f int, c array<int>, s array<int>, m int, y int")
    for r in rows.select("i", budgets.fitted_parts(F.col("f"), F.col("c"), F.col("s"), F.col("m"), F.col("y"), 900).alias("p")).collect():
        assert tuple(r.p) == fit(*cases[r.i], 900), cases[r.i]


def test_query_parts_of_whole_documents(spark, sf):
    from quern.functions import texts
    from quern.queries.beyond_sql import prompt_parts

    chunks = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", texts.paragraph_chunks(F.col("text"))).collect()}
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in prompt_parts(spark, sf).collect():
        text = whole[r.doc_id]
        want = fit(120, [len(c) for c in chunks[r.doc_id][:8]], [len(s) for s in text.split("\n")[:3]], len(text), 200, 900)
        assert (r.chunks, r.shots, r.memory, r.style, r.tokens) == (" ".join(map(str, want[0])), *want[1:])


def test_copies_of_a_row_differ(spark):
    rows = spark.range(3).select("id", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("copy"))
    made = lambda seed: {(r.id, r.copy): r.t for r in rows.select("id", "copy", budgets.rewritten(F.lit("text"), F.col("id"), F.col("copy"), ("a", "b", "c"), ("x", "y"), seed).alias("t")).collect()}
    one = made(1)
    assert all(one[i, 1] == "text" and len({one[i, c] for c in range(1, 15)}) == 14 for i in range(3))
    assert one == made(1) and one != made(2) and one[0, 2] == "b text x" and one[0, 8] == "(2) b text x"


def breadth_first(links, starts, most):
    queue, found = deque((s, 0) for s in starts), {}
    order = []
    while queue:
        page, depth = queue.popleft()
        if page in found or (most is not None and depth > most):
            continue
        found[page] = depth
        order.append(page)
        queue.extend((t, depth + 1) for _, t in sorted(links.get(page, [])) if t is not None)
    return order, found


def test_pages_are_reached_in_breadth_first_order(spark, tmp_path):
    rng = random.Random(3)
    links = {p: [(k, rng.choice([*range(60), None])) for k in range(rng.randint(0, 3))] for p in range(40)}
    links[5] = [(0, 5), (1, 6), (2, 6)]
    rows = spark.createDataFrame([(p, k, t) for p, own in links.items() for k, t in own], "page long, place int, target long")
    starts = [5, 17, 5]
    begin = spark.createDataFrame([(p, k) for k, p in enumerate(starts)], "page long, place int")
    for most in (None, 0, 2):
        folder = str(tmp_path / f"f{most}")
        for _ in range(2):  # again: all rounds are there already
            got = sorted(frontier.reached(rows, begin, folder, most).collect(), key=lambda r: (r.depth, r.trail))
            order, depth = breadth_first(links, starts, most)
            assert [r.page for r in got] == order and all(depth[r.page] == r.depth for r in got)
    assert frontier.reached(rows, begin.limit(0), str(tmp_path / "none")).collect() == []


def test_next_pages(spark):
    html = "<a href='?pageNo=4'>x</a><a href='#' onclick=\"goPage('3')\">on</a><a href=x>2</a><a href=y>777</a><a href='/l?a=1&pageIndex=9'>z</a>"
    rows = [(1, "http://x.example/l", html), (2, "http://x.example/l?pageNo=2&a=b#top", html), (3, "http://x.example/l?a=b&pageIndex=4", html), (4, "http://x.example/l?pageNo=9", html), (5, "http://x.example/l", None)]
    trees = pages.with_trees(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url")
    got = {r.page_id: r.n for r in trees.select("page_id", pages.next_page(F.col("url")).alias("n")).collect()}
    assert got == {1: "http://x.example/l?pageNo=2", 2: "http://x.example/l?pageNo=3&a=b", 3: "http://x.example/l?a=b&pageIndex=9", 4: None, 5: None}
    seen = trees.select("page_id", pages.next_page(F.col("url"), F.array(F.lit("http://x.example/l?pageNo=2"))).alias("n")).where("page_id = 1").first()
    assert seen.n == "http://x.example/l?pageNo=3"
