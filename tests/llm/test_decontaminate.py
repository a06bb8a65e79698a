import random

from quern.llm import decontaminate
from tests.llm.data import AWKWARD, docs

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(300)]


def text(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def items(spark, rows):
    return spark.createDataFrame([(i, t, "z", 3) for i, t in rows], "item_id long, text string, start string, size int")


def brute(doc_rows, item_rows, similarity=0.8):
    """Best similarity of any window of the item's size, for each pair that reaches the similarity."""
    found = {}
    for doc_id, body in doc_rows:
        words = decontaminate.words_of(body)
        for item_id, item in item_rows:
            own = decontaminate.words_of(item)
            if not own:
                continue
            n = min(5, len(own))
            shingles = [tuple(own[i : i + n]) for i in range(len(own) - n + 1)]
            every = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            best = max((decontaminate.weighted_similarity(every[i : i + len(shingles)], shingles) for i in range(max(1, len(every) - len(shingles) + 1))), default=0) if every else 0
            if best >= similarity:
                found[doc_id, item_id] = max(best, found.get((doc_id, item_id), 0))
    return found


def run(spark, doc_rows, item_rows):
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs(spark, doc_rows), items(spark, item_rows)).collect()}


def test_copies_edited_copies_and_clean_documents(spark):
    passages = [(i, text(RNG.randint(25, 60))) for i in range(20)] + [(90, None), (91, ""), (92, "one two"), (93, passage := text(40)), (94, passage)]
    rows = [*AWKWARD]
    for i in range(60):
        item = passages[i % 20][1]
        words = item.split()
        if i % 3 == 1:
            words = words[1:] + ["tail"]
        if i % 3 == 2:
            words[RNG.randrange(len(words))] = "changed"
        rows.append((100 + i, f"{text(RNG.randint(0, 200))} {' '.join(words).upper()}, {text(RNG.randint(0, 200))}"))
    rows += [(300 + i, text(300)) for i in range(20)] + [(400, "One, two"), (401, f"{passage}. {passage}"), (None, passage)]
    want, got = brute(rows, passages), run(spark, rows, passages)
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    sure = {k for k, s in want.items() if s >= 0.9}
    assert sure <= set(got) and len(got) >= 0.9 * len(want) and {(401, 93), (401, 94), (None, 93), (400, 92)} <= set(got)


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_CHARS", 300)
    passages = [(i, text(30)) for i in range(6)]
    rows = [(i, f"{text(50)} {p} {text(50)}") for i, p in passages]
    assert set(run(spark, rows, passages)) == {(i, i) for i in range(6)}


def test_no_rows(spark):
    assert run(spark, [], [(1, "a b c d e f")]) == {}
    assert run(spark, AWKWARD, []) == {}


def test_drop_keeps_columns_and_clean_rows(spark):
    kept = decontaminate.drop_contaminated(docs(spark, [(1, "x a b c d e f g y"), (2, "clean"), (None, "a b c d e f g"), (None, None)]), items(spark, [(5, "a b c d e f g")]))
    assert kept.columns == ["doc_id", "text", "key", "ids", "words"] and [r.doc_id for r in kept.collect()] == [2]


def test_every_value_within_reach_is_in_the_index(spark):
    rows = spark.createDataFrame([(-81985529216486896,)], "fp long").select(decontaminate.block_values("fp", 3).alias("at")).first().at
    value = -81985529216486896 & (1 << 64) - 1
    edges = [64 * i // decontaminate.BLOCKS for i in range(decontaminate.BLOCKS + 1)]
    assert len(rows) == len(set(rows)) and {r.block for r in rows} == set(range(decontaminate.BLOCKS)) and decontaminate.RADIUS // decontaminate.BLOCKS == 3
    for block, (low, high) in enumerate(zip(edges, edges[1:])):
        own = value >> low & (1 << high - low) - 1
        assert {r.value for r in rows if r.block == block} == {v for v in range(1 << high - low) if (v ^ own).bit_count() <= 3}


def test_query_finds_all_passages_that_brute_force_finds(spark, sf):
    from quern.llm.queries import op1_decontamination

    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]
    want = brute(read("documents"), read("benchmark"))
    got = {(r.doc_id, r.item_id): r.similarity for r in op1_decontamination(spark, sf).collect()}
    assert set(got) <= set(want) and {k for k, s in want.items() if s >= 0.9} <= set(got)


def test_documents_shorter_than_the_item(spark):
    """Whole documents that are an item less some words, against the similarity of all of their shingles."""
    passages = [(i, text(60)) for i in range(12)] + [(50, text(20)), (51, text(64)), (52, text(7))]
    rows = []
    for i, p in passages:
        words = p.split()
        for cut in (1, 2, 4, 9, 14):
            rows += [(len(rows), " ".join(words[:-cut])), (len(rows) + 1, " ".join(words[cut:]))]
        rows.append((len(rows), " ".join(words[:30] + words[31:])))
        rows.append((len(rows), " ".join(words[:8] + words[9:])))
    rows += [(900, passages[50 - 38][1]), (901, "one two three"), (902, text(55))]
    bag = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = dict(brute(rows, passages))
    for doc_id, body in rows:
        for item_id, item in passages:
            own, wanted = bag(body.split()), bag(item.split())
            if 0 < len(own) < len(wanted) and (alike := decontaminate.weighted_similarity(own, wanted)) >= 0.8:
                want[doc_id, item_id] = alike
    found = decontaminate.contaminated(docs(spark, rows), items(spark, passages)).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    assert len(want) > 80 and set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert {k for k, s in want.items() if s >= 0.85} <= set(got) and len(got) >= 0.9 * len(want)
    lengths = {i: len(t.split()) for i, t in rows}
    assert all((r.start_word, r.n_words) == (0, lengths[r.doc_id]) for r in found)


def test_recall_of_items_at_the_similarity(spark):
    """400 passages with 0.8 to 0.9 of an item's shingles, and 200 just below: all the former, none of the latter."""
    passages, rows, want = [], [], set()
    for i in range(600):
        low, high = (0.8, 0.9) if i < 400 else (0.74, 0.7999)
        while True:
            item = text(RNG.randint(40, 90)).split()
            words = list(item)
            for at in RNG.sample(range(len(words)), RNG.randint(1, 2)):
                words[at] = f"new{RNG.randrange(10**6)}"
            every = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
            if low <= decontaminate.weighted_similarity(every, [tuple(item[k : k + 5]) for k in range(len(item) - 4)]) <= high:
                break
        passages.append((i, " ".join(item)))
        rows.append((i, " ".join([text(30), *words, text(30)])))
        want |= {(i, i)} if i < 400 else set()
    got = set(run(spark, rows, passages))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_long_texts_and_items_of_many_sizes(spark):
    passages = [(i, text(20 + i)) for i in range(300)]
    rows = [(1, " ".join(t for _, t in passages)), (2, "w1 " * 300_000), (3, "x" * 2_000_000), (4, text(200_000))]
    got = run(spark, rows, passages)
    assert {k for k in got if k[0] == 1} == {(1, i) for i in range(300)} and not {k for k in got if k[0] in (2, 3)}
