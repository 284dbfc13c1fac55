"""Line deduplication against a brute-force version."""

import random

from wayfold.llm.linedup import dedup_lines


def brute(docs, min_words):
    """Delete, for every start whose least run of enough words stood before, the longest common run with its first copy."""
    order = sorted({(i is None, i if i is not None else 0, t or "") for i, t in docs})
    flat = [(d, k, line) for d, (_, _, t) in enumerate(order) for k, line in enumerate(t.split("\n"))]
    gone = [False] * len(flat)

    def need(g):
        words = 0
        for m in range(1, len(flat) - g + 1):
            if flat[g + m - 1][0] != flat[g][0]:
                return None
            words += len(flat[g + m - 1][2].split())
            if words >= min_words:
                return m
        return None

    run = lambda g, m: tuple(x[2] for x in flat[g : g + m]) if g + m <= len(flat) and flat[g + m - 1][0] == flat[g][0] else None
    for g in range(len(flat)):
        m = need(g)
        if m is None:
            continue
        first = next(j for j in range(g + 1) if run(j, m) == run(g, m))
        if first == g:
            continue
        while run(g, m + 1) is not None and run(g, m + 1) == run(first, m + 1):
            m += 1
        gone[g : g + m] = [True] * m
    out = {}
    for d, (null, i, t) in enumerate(order):
        out[None if null else i, t] = "\n".join(x[2] for x, dead in zip(flat, gone, strict=True) if x[0] == d and not dead)
    return out


def check(spark, docs, min_words):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, __doc string, n_lines int")
    got = dedup_lines(df, min_words).collect()
    assert len(got) == len(docs)
    want = brute(docs, min_words)
    left = list(docs)
    for r in got:
        source = [t for i, t in left if i == r.doc_id and want[i, t or ""] == (r.text or "")]
        assert source, (r, [want[i, t or ""] for i, t in docs if i == r.doc_id])
        left.remove((r.doc_id, source[0]))
    assert not left


def test_random_sequences_against_brute_force(spark):
    rng = random.Random(5)
    lines = ["a b c", "d", "", "e f", "g h i j", "k l", "m"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(60)]
    check(spark, docs, 6)


def test_one_word_is_enough_and_periods_collapse(spark):
    check(spark, [(0, "a\na\na\na"), (1, "a b\na b\na"), (2, "a\na b\nc\na b\nc\na b")], 1)


def test_odd_rows(spark):
    text = "one two three\nfour five"
    check(spark, [(1, None), (2, ""), (2, ""), (3, text), (3, text), (None, text), (4, "\n\n"), (5, text + "\nx"), (5, "x\n" + text), (6, "x " * 5000)], 4)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_repeats_take_every_level(spark):
    long = "\n".join(f"line {i % 7} {i}" for i in range(100))
    check(spark, [(1, long), (2, "new\n" + long + "\ntail"), (3, long[: len(long) // 2])], 20)


def longest_brute(docs, min_words):
    """Delete, for every start, the longest run of enough words that stands anywhere before."""
    order = sorted(docs)
    flat = [(d, line) for d, (_, t) in enumerate(order) for line in t.split("\n")]
    alike = lambda j, g, m: g + m < len(flat) and flat[g + m][0] == flat[g][0] and flat[j + m] == (flat[j][0], flat[g + m][1])
    gone = [False] * len(flat)
    for g in range(len(flat)):
        m = 0
        for j in range(g):
            n = 0
            while alike(j, g, n):
                n += 1
            m = max(m, n)
        if sum(len(line.split()) for _, line in flat[g : g + m]) >= min_words:
            gone[g : g + m] = [True] * m
    return {i: "\n".join(line for (x, line), dead in zip(flat, gone, strict=True) if x == d and not dead) for d, (i, _) in enumerate(order)}


def test_runs_reach_as_far_as_their_longest_earlier_copy(spark):
    passage = "\n".join(f"a{i} b{i} c{i}" for i in range(20))
    docs = [(1, passage + "\nx"), (2, passage + "\nt1\nt2"), (3, passage + "\nt1\nt2")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(df, 50, longest=True).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("t1\nt2", 20), 3: ("", 22)}
    rng = random.Random(11)
    lines = ["a b c", "d", "", "e f", "g h i j"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(40)))) for i in range(80)]
    tail = "\n".join(f"tail {i}" for i in range(37))
    docs += [(100 + i, docs[i][1] + "\n" + tail[: rng.randrange(len(tail))]) for i in range(0, 80, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(df, 8, longest=True).collect()} == longest_brute(docs, 8)


def test_the_query_and_the_stage_take_the_longest_copy(spark, tmp_path):
    import corpus_pipeline
    from wayfold.llm.queries import QUERIES

    passage = "\n".join(f"a{i} b{i} c{i}" for i in range(20))
    docs = [(1, passage + "\nx"), (2, passage + "\nt1\nt2"), (3, "own\n" + passage + "\nt1\nt2")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()} == {1: 0, 2: 20, 3: 22}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()}[3] == "own"
