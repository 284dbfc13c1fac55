"""Operators against brute-force versions, exact round trips, held-out accuracy, and odd rows."""

import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import chat, common, mixing, mjpeg, ngram_join, quality, sstable, warc
from wayfold.llm.components import connected_components
from wayfold.llm.fingerprint import canonical, edited_fingerprints, exact_fingerprints
from wayfold.llm.ngram_join import ngram_jaccard_components, sketch_distance, wide_sketch
from wayfold.llm.spiece import Pieces, default_model, encode_decode

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "x " * 30_000), (7, "😀 ﬁ é　z"), (7, "😀 ﬁ é　z"), (None, "a b c d e f g"), (9, "a  b\n\n\nc")]


def documents(spark, rows, extra=True):
    made = [(i, t, "en", "s", len(t or ""), 1, "k") for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, n long, id string") if extra else spark.createDataFrame([r[:5] for r in made], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# -- 1: n-gram Jaccard join -------------------------------------------------------


def components_by_pairs(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(own)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, all_ in sets.items() if i is not None for s in all_ if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[a + 1 :]:
            if den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[0]), find(i)) for i, s in sets.items() if i is not None}


def near_copies(rng, groups=12, members=8):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 8, 20, 60, 150]))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 12))):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = [f"w{rng.randrange(60)}"]
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, num):
    rows = near_copies(random.Random(n))
    want = components_by_pairs(rows, n, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(documents(spark, rows), n, num, 100).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_components_of_odd_rows(spark, odd, empty):
    got = [(r.doc_id, r.component_id) for r in ngram_jaccard_components(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (None, None), (9, 9)], key=str)
    assert ngram_jaccard_components(empty).collect() == []


def test_repeated_ids_with_other_texts(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[::-1]), " ".join(words[30:] + words[:30][::-1])
    rows = [(5, a), (5, b), (3, a + " end"), (9, b), (7, c), (7, c), (1, "alone here now"), (None, a), (None, None)]
    got = sorted((r.doc_id, r.component_id) for r in ngram_jaccard_components(documents(spark, rows)).collect() if r.doc_id is not None)
    assert got == [(1, 1), (3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (9, 3)]
    assert ngram_jaccard_components(documents(spark, rows)).where("doc_id is null and component_id is null").count() == 2


@pytest.mark.parametrize("few", [64, 4])
def test_one_key_of_many_unlinked_members(spark, monkeypatch, few):
    """A common passage gives one key to all texts; some link, most do not, none may be lost."""
    from wayfold.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(45)]
    rows = [(i, " ".join(passage + [f"u{i}x{j}" for j in range(15)])) for i in range(240)]
    rows += [(1000 + i, " ".join(passage + [f"u{i}x{j}" for j in range(13)] + ["y", "z"])) for i in rng.sample(range(240), 40)]
    rows += [(2000 + i, " ".join(passage)) for i in range(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(documents(spark, rows), n=4, num=85, den=100).collect()}
    assert got == components_by_pairs(rows, 4, 85, 100)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        x, y = pool[: rng.integers(1, 800)], pool[rng.integers(0, 100) : rng.integers(200, 900)]
        assert sketch_distance(wide_sketch(np.unique(x)), wide_sketch(np.unique(y))) <= len(np.setxor1d(x, y))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250), (5, 5)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[300] == got[250] == 200


# -- 2: chat formatting ---------------------------------------------------------------


def test_control_strings_cannot_be_imitated():
    rng = random.Random(1)
    bits = [*chat.CONTROLS, "\\", ";", "n", "\n", "<", "|", "a", "[", r"\;"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "a\\n\nb"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(4)]
        text, spans = chat.write(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        body = chat.escape(turns[0][1])
        assert not any(c in body for c in chat.CONTROLS)


def test_layouts_and_unknown_ones(spark):
    records = [
        '{"prompt": "p", "response": "r"}', '{"instruction": "i", "output": "o"}', '{"instruction": "s", "input": "i", "output": null}',
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"messages": []}', '{"other": 1}', "no json", None, "[1]",
    ]
    df = spark.createDataFrame(list(enumerate(records)), "k long, j string")
    got = {r.k: r for r in chat.format_chats(df, "k", "j").collect()}
    assert chat.parse(got[0].formatted) == [("user", "p"), ("assistant", "r")]
    assert chat.parse(got[1].formatted) == [("user", "i"), ("assistant", "o")]
    assert chat.parse(got[2].formatted) == [("system", "s"), ("user", "i"), ("assistant", "")]
    assert chat.parse(got[3].formatted) == [("user", "h"), ("assistant", "g")]
    assert got[4].formatted == "" and all(got[i].formatted is None for i in (5, 6, 7, 8))


def test_turn_rows_with_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (2, 1, "system", "only"), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(chat.records_of_turns(turns), "conv_id", "record").collect()}
    assert chat.parse(got[1].formatted) == [("", ""), ("user", "a"), ("user", "b")]
    assert chat.parse(got[2].formatted) == [("system", "only")] and chat.parse(got[None].formatted) == [("user", "x")]


def test_extra_missing_and_deep_fields(spark):
    records = [
        '{"id": 7, "prompt": "p", "meta": {"a": [1, {"b": 2}]}, "response": "r"}', '{"system": "s", "messages": []}', '{"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant"}]}',
        '{"messages": {"role": "user", "content": "a"}}', '{"messages": ["a"]}', "[" * 100_000 + "]" * 100_000, '{"system": "s", "prompt": "p", "completion": {"x": 1}}', '{"messages": null}',
    ]
    got = {r.k: r for r in chat.format_chats(spark.createDataFrame(list(enumerate(records)), "k long, j string"), "k", "j").collect()}
    turns = {k: r.formatted if r.formatted is None else chat.parse(r.formatted) for k, r in got.items()}
    assert turns == {0: [("user", "p"), ("assistant", "r")], 1: [("system", "s")], 2: [("user", "a"), ("assistant", "")], 3: None, 4: None, 5: None, 6: [("system", "s"), ("user", "p"), ("assistant", '{"x": 1}')], 7: []}
    assert got[3].fingerprint is not None and got[5].fingerprint is None


def test_long_conversations_are_digested_part_by_part(spark):
    rng = random.Random(9)
    rows = [(c, k, rng.choice(["system", "user", "assistant", None]), rng.choice(["", "x" * 50, "[INST] é\\", None])) for c, n in ((1, 300), (2, 2), (3, 1), (None, 40)) for k in range(n)]
    turns = spark.createDataFrame(rows * 2, "conv_id long, turn long, role string, text string")  # every row twice
    records = chat.records_of_turns(turns, part_bytes=1000)
    assert records.where("conv_id = 1").count() > 20
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(records, "conv_id", "record", "part")).collect()}
    for c in (1, 2, 3, None):
        own = sorted((k, role or "", text or "") for i, k, role, text in rows * 2 if i == c)
        learned = "".join(t for _, r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert len(got) == 4 and chat.read_back(chat.format_chats(chat.records_of_turns(turns.limit(0)), "conv_id", "record", "part")).collect() == []


# -- 3: quality -----------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly", "under", "green"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["$$$", "BUY!!", "click|", "win%%%"]) + rng.choice("abc") for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(n)]
    return documents(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = quality.quality_scores(docs, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97


def area_under_curve(truth, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    good = np.array(truth) == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_labels_of_the_given_tables(spark):
    """Real labels: as good as a logistic regression over other hashes by plain gradient descent."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    ours = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    held = sorted(i for i in truth if ours[i].held_out)
    taught = sorted(i for i in truth if not ours[i].held_out)
    text = {r.doc_id: r.text or "" for r in docs.join(labels, "doc_id", "left_semi").select("doc_id", "text").collect()}

    def vector(t):
        w = t.split()
        bits = w + [a + " " + b for a, b in zip(w, w[1:], strict=False)] + [t[k : k + 3] for k in range(len(t) - 2)]
        v = np.sqrt(np.bincount([zlib.crc32(b.encode()) % 4096 for b in bits], minlength=4096))
        return v / max(1, len(bits))

    x, y = np.array([vector(text[i]) for i in taught]), np.array([truth[i] for i in taught])
    scale = x.std(axis=0) + 1e-9
    x, w, b = x / scale, np.zeros(4096), 0.0
    for _ in range(300):
        off = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w, b = w - 0.02 * (x.T @ off / len(y) + 1e-3 * w), b - 0.2 * off.mean()
    theirs = np.array([vector(text[i]) for i in held]) / scale @ w + b
    right = [truth[i] for i in held]
    area = area_under_curve(right, np.array([ours[i].score for i in held]))
    assert area > 0.97 and area >= area_under_curve(right, theirs) - 0.02
    assert np.mean([ours[i].predicted == truth[i] for i in held]) > 0.96


def test_quality_of_odd_rows(spark, odd, empty):
    _, labels = labelled(spark, 30)
    got = quality.quality_scores(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(empty, labels).collect() == []
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_accepted_rows_keep_columns_of_any_name(spark):
    docs, labels = labelled(spark, 60)
    named = docs.selectExpr("*", "1 as score", "2 as held_out", "3 as label", "4 as weights", "5 as h")
    kept = quality.keep_good(named, labels)
    assert kept.columns == named.columns and 30 <= kept.count() < 60


# -- 4: fingerprints ------------------------------------------------------------------


def test_classes_of_equal_canonical_texts(spark, odd, empty):
    got = exact_fingerprints(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {frozenset(x) for x in by.values()} == {frozenset(x) for x in ({1, 2, 3}, {4, 5}, {6}, {7}, {None}, {9})}
    assert exact_fingerprints(empty).collect() == []
    assert canonical("ﬁ　 É") == canonical("FI é")


def test_edited_texts_by_their_definition(spark):
    rows = [(i * 7 % 40, t) for i, t in enumerate(["", None, "ab", "abc", "Héllo wörld 😀", "x" * 100, "same text", "same text", "q", "zz top"] * 4)]
    rows = list(dict(rows).items())
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in edited_fingerprints(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == float(canonical(edited) == canonical(t)) and got[i].near_next == float(canonical(after) == canonical(t))
    assert edited_fingerprints(documents(spark, [(5, "alone")])).collect()[0].near_next == 1.0


def test_edited_odd_rows(spark, odd, empty):
    assert len(edited_fingerprints(odd).collect()) == len(ODD)
    assert edited_fingerprints(empty).collect() == []


# -- 5: WARC ----------------------------------------------------------------------------


def test_revisits_take_the_latest_earlier_response(spark):
    w = lambda kind, url, date, name, status, headers, body=b"": (warc.write_record(kind, url, date, name, status, headers, body),)
    rows = [
        w("response", "http://A.example/x/", "2024-01-01T00:00:00Z", "r1", "200 OK", [("ETag", "1"), ("Content-Type", "t"), ("Cache-Control", "a")], b"one"),
        w("response", "https://www.a.example/x", "2024-01-03T00:00:00Z", "r2", "200 OK", [("ETag", "2")], b"two\r\n\r\ntwo"),
        w("revisit", "http://a.example/x#f", "2024-01-02T00:00:00Z", "v1", "304 Not Modified", [("ETag", "1"), ("Cache-Control", "b"), ("Content-Length", "0")]),
        w("revisit", "http://a.example/x?utm_x=1", "2024-01-04T00:00:00Z", "v2", "304 Not Modified", [("ETag", "1")]),
        w("revisit", "http://a.example/x", "2023-01-04T00:00:00Z", "v3", "304 Not Modified", [("ETag", "1")]),
        w("revisit", "http://a.example/x", "2024-02-01T00:00:00Z", "v4", "304 Not Modified", [("ETag", "2")]),
        w("response", "http://a.example/x", "2024-01-05T00:00:00Z", "e", "404 Not Found", [], b"gone"),
        w("revisit", "http://a.example/x", "2024-02-02T00:00:00Z", "v5", "304 Not Modified", []),
        (b"junk",), (None,),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(warc.parse_records(spark.createDataFrame(rows, "record binary"))).collect()}
    assert {k: v.outcome for k, v in got.items()} == {"r1": "full", "r2": "full", "v1": "resolved", "v2": "mismatch", "v3": "missing", "v4": "resolved", "e": "other", "v5": "mismatch"}
    assert got["v1"].source_id == "r1" and got["v1"].payload_sha256 == hashlib.sha256(b"one").hexdigest()
    assert got["v1"].merged == {"etag": "1", "content-type": "t", "cache-control": "b"}
    assert got["v4"].payload_bytes == 10


def test_equal_times_repeats_and_a_hot_url(spark):
    stamp = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    rng = random.Random(11)
    made = [("response", 5, "r1", "a"), ("response", 5, "r1", "a"), ("revisit", 5, "s1", "a"), ("response", 5, "z1", "b"), ("revisit", 6, "v1", "b"), ("revisit", 6, "v1", "b"), ("revisit", 6, "v2", "a")]
    made += [(rng.choice(["response", "revisit", "revisit"]), rng.randrange(7, 900), f"h{i:04d}", rng.choice("ab")) for i in range(500)]
    rows = [(warc.write_record(kind, "http://hot.example/", stamp(t), name, "200 OK" if kind == "response" else "304 Not Modified", [("ETag", tag)], name.encode() if kind == "response" else b""),) for kind, t, name, tag in made]
    got = sorted((r.record_id, r.outcome, r.source_id) for r in warc.resolve_revisits(warc.parse_records(spark.createDataFrame(rows, "record binary"))).collect())
    want, last = [], None
    for kind, _, name, tag in sorted(made, key=lambda x: (x[1], x[2])):
        if kind == "response":
            want.append((name, "full", name))
            last = (name, tag)
        else:
            same = last is not None and last[1] == tag
            want.append((name, "missing" if last is None else "resolved" if same else "mismatch", last[0] if same else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2] or "")) or sorted(map(str, got)) == sorted(map(str, want))


def test_no_records(spark):
    assert warc.resolve_revisits(warc.parse_records(spark.createDataFrame([], "record binary"))).collect() == []


# -- 6: SentencePiece -------------------------------------------------------------------


def test_ids_equal_the_library():
    import sentencepiece

    model, sp = Pieces(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    rng = random.Random(4)
    texts = ["", " ", "  a  b\n\tc  ", "▁▁ a", "日本語 テキスト", "\n\n x", "aaaa bbbb", "\x00a", "a\r\nb"]
    texts += ["".join(rng.choice("ab <(▁\n é日\tT1!?ehlotr") for _ in range(rng.randrange(40))) for _ in range(1500)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        got = np.frombuffer(ids, np.uint16)
        assert got.tolist() == sp.encode(text), text
        assert model.decode(got) == text.replace("▁", " ")


def test_long_words_and_runs_of_spaces(monkeypatch):
    import base64

    import sentencepiece

    from wayfold.llm import spiece

    model, sp = Pieces(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    rng = random.Random(5)
    texts = [" " * n + "word" * (n % 3) for n in (1, 2, 15, 16, 17, 31, 100, 999, 5000)] + ["a" + " " * 3000 + "b", "x" * 3000, "ab" * 2000 + " c"]
    texts += [base64.b64encode(rng.randbytes(9000)).decode(), "".join(rng.choice("的一是不了人我在有他这 中大来上") for _ in range(4000)), "the" * 300 + "\n" + "ing" * 400]
    for index in (spiece.INDEX_CHARS, 1000):
        monkeypatch.setattr(spiece, "INDEX_CHARS", index)
        for text, ids in zip(texts, model.encode(texts), strict=True):
            got = np.frombuffer(ids, np.uint16)
            assert got.tolist() == sp.encode(text), text[:50]
            assert model.decode(got) == text
    again = model.lattice(*(lambda w: (model.code_of[np.frombuffer("".join(w).encode("utf-32-le"), np.uint32)], np.array(list(map(len, w)))))(["▁hello", "▁worlds"]))
    assert again[0].tolist() == sp.encode("hello worlds") and again[1].sum() == len(again[0])


def test_suffixes_are_sorted_as_far_as_pieces_reach():
    model = Pieces(default_model())
    codes = np.random.default_rng(3).integers(0, 3, 400)  # many long repeats
    order, _ = model._suffixes(codes)
    cut = lambda i: codes[i : i + 16].tolist() + [0] * max(0, i + 16 - len(codes))
    assert sorted(order.tolist()) == list(range(400)) and all(cut(a) <= cut(b) for a, b in zip(order, order[1:], strict=False))


def test_encoding_odd_rows(spark, odd, empty):
    got = encode_decode(odd).collect()
    assert len(got) == len(ODD) and all(r.round_trip for r in got) and all(len(r.ids) == r.n_tokens for r in got)
    assert encode_decode(empty).collect() == []


# -- 7: token shards --------------------------------------------------------------------


def test_shards_hold_what_the_library_encodes(spark, odd):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i * 3, "".join(rng.choice("ab  (\t\n\r é日T1'!s\xa0") for _ in range(rng.randrange(60)))) for i in range(300)] + [(-5, None), (11, "")]
    folder, manifest = sstable.write_shards(documents(spark, rows))
    coder = Tokenizer.from_file(sstable.default_tokenizer())
    want, start = {}, 0
    for i, t in sorted(rows):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(folder, manifest).collect()}
    assert got == want
    for i in (-5, 0, 11, 3 * 299):
        (found,) = sstable.lookup(folder, manifest, i)
        assert len(found) == want[i][1]
    assert sstable.lookup(folder, manifest, 1) == []


def test_shards_are_cut_by_size(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_DOCS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 8 + [1] * 2, pa.int32()), pa.array(list(range(10)), pa.int64()), pa.array([bytes([i, 0]) for i in range(10)], pa.binary())], ["part", "id", "ids"])
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        rows = [r for b in sstable._write(folder, 2)([batch]) for r in b.to_pylist()]
        assert [(r["part"], r["docs"]) for r in rows] == [(0, 3), (0, 3), (0, 2), (1, 2)] and [r["seq"] for r in rows] == [0, 1, 2, 3]
        assert [(sstable.ident_of(r["lowest"]), sstable.ident_of(r["highest"])) for r in rows] == [(0, 2), (3, 5), (6, 7), (8, 9)]
        with open(f"{folder}/{rows[1]['name']}", "rb") as f:
            shard = sstable.Shard(pa.PythonFile(f))
            assert [int(shard.get(i)[0][0]) for i in (3, 4, 5)] == [3, 4, 5] and shard.get(6) == []


def test_shards_of_odd_rows(spark, odd, empty):
    assert len(sstable.index_of_tokens(odd).collect()) == len(ODD)
    assert sstable.index_of_tokens(empty).collect() == []
    folder, manifest = sstable.write_shards(odd)
    assert len(sstable.lookup(folder, manifest, 7)) == 2 and len(sstable.lookup(folder, manifest, None)) == 1


# -- 8: media ---------------------------------------------------------------------------


def test_frames_are_jpeg_and_lossless():
    for raw in (bytes(range(256)) * 3, b"\xff" * 192 * 17, np.random.default_rng(1).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes(), b" " * 192):
        data = mjpeg.write_avi(raw)
        payload, shapes = mjpeg.read_payload(data)
        assert payload == raw and np.allclose(shapes.sum(axis=1), 1)
        scan = mjpeg.parse_jpeg(bytes(mjpeg.read_avi(data).frames[0]))
        assert (mjpeg.coefficients(scan, min(len(raw) // 48, 64)) == mjpeg.coefficients(scan)).all()  # at once, and bit by bit


def test_index_and_chunks_name_the_same_frames():
    data = mjpeg.write_avi(b"abc " * 48 * 100)
    bare = data.replace(b"idx1", b"junk")
    assert [bytes(f) for f in mjpeg.read_avi(data).frames] == [bytes(f) for f in mjpeg.read_avi(bare).frames]


def test_shots_start_where_histograms_jump():
    calm, other = np.eye(16)[0], np.eye(16)[9]
    assert mjpeg.shots(np.array([calm] * 10 + [other] * 5)) == [(0, 10), (10, 15)]
    assert mjpeg.shots(np.array([calm] * 4)) == [(0, 4)] and mjpeg.shots(np.zeros((0, 16))) == []


def test_media_of_odd_rows(spark, odd, empty):
    stored = mjpeg.store(odd)
    got = mjpeg.read_back(stored).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(ODD, key=lambda x: (str(x[0]), len((x[1] or "").encode()))), strict=True):
        n, raw = mjpeg.padded(t)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    assert mjpeg.clips(stored).where("doc_id = 6").count() >= 1
    assert mjpeg.read_back(mjpeg.store(empty)).collect() == []


# -- 10: mixing -------------------------------------------------------------------------


def mixture(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long, k long, size long")
    return {r.doc_id: r for r in mixing.mix_sources(df).collect()}


def test_targets_and_taken_words(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(200), rng.choice(["a", "a", "a", "b", "c", "ä", None]), 0, 0, 0) for i in range(400)]
    got = mixture(spark, rows)
    again = mixture(spark, rows)
    assert got == again and len(got) == 400
    size = {}
    for i, t, s, *_ in rows:
        assert got[i].size == len(t.split()) and 0 <= got[i].taken <= 3 * got[i].size
        size[s] = size.get(s, 0) + got[i].size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(size.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    for s in order:
        mine = [got[i] for i, _, x, *_ in rows if x == s]
        assert all(abs(r.target - target[s]) < 1e-3 and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 8  # blocks of one word here: as far as the schedule is off


def test_the_schedule_decides_what_is_taken(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice("aaab")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda step: {r.doc_id: (r.taken, r.target) for r in mixing.mix_sources(df, step=step).collect()}
    golden, other = taken(mixing.STEP), taken(1)
    assert golden != other and {i: t for i, (_, t) in golden.items()} == {i: t for i, (_, t) in other.items()}
    mixed = sorted(mixing.mix_slots(df).collect(), key=lambda r: (r.slot, r.start))
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    assert words == {i: n for i, (n, _) in golden.items() if n}
    of, total, target = {i: s for i, _, s in rows}, sum(t.count("w") for _, t, _ in rows), {of_: t for of_, t in ((rows[i][2], t) for i, (_, t) in golden.items())}
    for n in (50, 500, 5000, len(mixed)):
        some, size = mixed[:n], sum(r.words for r in mixed[:n])
        for s in "ab":
            assert abs(sum(r.words for r in some if of[r.doc_id] == s) - size * target[s] / total) <= 4 * mixing.block_words(total, min(target.values()))


def test_blocks_of_many_words_and_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_OF_LEAST", 16)
    monkeypatch.setattr(mixing, "PART_ROWS", 4)
    rows = [(i, "w " * (1 + i * 7 % 90), "hot" if i % 10 else f"s{i % 3}") for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        s = rows[r.doc_id][2]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size
    block = mixing.block_words(sum(r.size for r in got), min(target.values()))
    assert block > 1 and all(abs(taken[s] - target[s]) <= 6 * block for s in taken)


def test_repeats_keep_columns_of_any_name(spark):
    names = ["mix_id", "mix_times", "mix_copy", "row", "key", "times", "k", "size", "taken", "slot"]
    rows = [(i, "w " * 50, "ab"[i % 2], *range(len(names))) for i in range(20)] + [(3, "other words", "a", *range(len(names))), (None, "x y z", None, *range(len(names))), (77, " ", "a", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = mixing.repeat_by_mix(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows)
    assert 77 not in {r.doc_id for r in out.collect()} and mixing.repeat_by_mix(df.limit(0)).collect() == []


def test_mixing_odd_rows(spark, odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(empty).collect() == []
    assert mixing.repeat_by_mix(odd).columns == odd.columns
    assert all(r.taken == 0 for r in mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect())


def test_slots_alternate_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100_000), ("b", 100_000), ("c", 100_000)], "source string, size long")
    slots = mixing.schedule(mixing.source_targets(sizes), 300_000, 3).orderBy("slot").collect()
    for k, share in ((1, 1 / 6), (2, 2 / 6), (3, 3 / 6)):
        for n in (60, 600, 6000):
            assert abs(sum(r.k == k for r in slots[:n]) - n * share) <= 6  # any prefix is close to the weights
    assert sorted(r["rank"] for r in slots if r.k == 2) == list(range(sum(r.k == 2 for r in slots)))


# -- word caches ------------------------------------------------------------------------


def test_batches_with_more_words_than_the_caches_hold(monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    from wayfold.llm import spiece

    monkeypatch.setattr(sstable, "CACHE_WORDS", 10)
    monkeypatch.setattr(spiece, "INDEX_CHARS", 100)
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:8]
    warm, texts = [" ".join(map(word, range(9)))], [" ".join(map(word, range(8, 40))), " ".join(map(word, range(35, 50)))]
    coder, plain = sstable.WordEncoder(sstable.default_tokenizer()), Tokenizer.from_file(sstable.default_tokenizer())
    model, sp = Pieces(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    for batch in (warm, texts, warm + texts):
        for text, ids in zip(batch, coder.encode(batch, 2), strict=True):
            assert np.frombuffer(ids, coder.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        for text, ids in zip(batch, model.encode(batch), strict=True):
            assert np.frombuffer(ids, np.uint16).tolist() == sp.encode(text)
        assert len(coder.cache) <= 10


def test_added_tokens_in_texts_are_what_the_library_makes_of_them():
    from tokenizers import Tokenizer

    coder, plain = sstable.WordEncoder(sstable.default_tokenizer()), Tokenizer.from_file(sstable.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>y <|endof text|>", "a b", ""]
    for text, ids in zip(texts, coder.encode(texts, 2), strict=True):
        assert np.frombuffer(ids, coder.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert 50256 in np.frombuffer(coder.encode(texts, 2)[0], coder.kind)


def test_pairs_of_many_keys_leave_the_join_about_once(spark):
    draw = random.Random(3)
    rows = [(key, i, i, 40, draw.random() < 0.5) for key in range(300) for i in draw.sample(range(12), 9)]
    ranked = spark.createDataFrame(rows, "key long, id long, part long, size long, leads boolean")
    facts = spark.createDataFrame([(i, 100, 0, 0, 0, 0) for i in range(12)], "id long, n long, s0 long, s1 long, s2 long, s3 long")
    met = facts.join(ngram_join._smallest_keys(ranked), "id")
    got = [tuple(r) for r in ngram_join._led_rows(ranked, met, 85, 100).collect()]
    by_key = {}
    for key, i, _, _, leads in rows:
        by_key.setdefault(key, []).append((i, leads))
    want = [(min(x, y), max(x, y)) for m in by_key.values() for x, leads in m if leads for y, too in m if x != y and (x < y or not too)]
    assert set(got) == set(want) and len(want) > 5000 and len(got) < 0.1 * len(want)


def test_tables_of_ended_rounds_are_deleted(spark):
    texts = [" ".join(f"w{i}" if i < 60 else f"t{d}x{i}" for i in range(120)) for d in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = set(common._WRITTEN)
    assert ngram_join.ngram_jaccard_components(docs).where("doc_id <> component_id").count() == 0
    left = {path.rpartition("/")[2].rpartition("-")[0] for path in set(common._WRITTEN) - known}
    assert not left & {"near", "doubt", "sets", "wanted", "open", "ranked", "met"}


@pytest.mark.parametrize("ordered", [1 << 19, 20])
def test_texts_with_a_common_passage_meet_by_rare_shingles(spark, monkeypatch, ordered):
    monkeypatch.setattr(ngram_join, "FEW", 8)
    monkeypatch.setattr(ngram_join, "ORDERED", ordered, raising=False)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(45)]
    rows = [(i, " ".join(passage + [f"u{i}x{j}" for j in range(15)])) for i in range(400)]
    rows += [(1000 + i, " ".join(passage + [f"u{i}x{j}" for j in range(13)] + ["y", "z"])) for i in rng.sample(range(400), 40)]
    met, led = [], ngram_join._led_rows

    def counted(ranked, *more):
        met.append(ranked.groupBy("key").agg((F.count_if("leads") * F.count("*")).alias("c")).agg(F.sum("c")).first()[0])
        return led(ranked, *more)

    monkeypatch.setattr(ngram_join, "_led_rows", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(documents(spark, rows), n=4, num=85, den=100).collect()}
    assert got == components_by_pairs(rows, 4, 85, 100) and len({c for _, c in got.values()}) == 400
    assert sum(met[1:]) < 440 * 440 / 8 or ordered < 45  # most of the passage is ordered by hash then


def test_rarest_shingles_of_linked_sets_have_one_in_common():
    draw = np.random.default_rng(8)
    pool = np.unique(draw.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [np.unique(draw.choice(pool, draw.integers(1, 120))) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[draw.random(len(s)) < 0.9], draw.choice(pool, len(s) // 12)])) for s in sets]
    sets.append(np.zeros(0, np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "tokens"])
    for most in (1000, 40):
        dealt = list(ngram_join._dealt_counts(1)([batch]))
        top = next(iter(ngram_join._most_common(most)(pa.RecordBatch.from_arrays(b.columns, ["bucket", "tokens", "counts"]) for b in dealt))).to_pylist()[0]
        known, counts = np.frombuffer(top["tokens"], np.uint64), np.frombuffer(top["counts"], np.int64)
        assert counts.tolist() == [sum(t in s for s in sets) for t in known] and top["whole"] == (most == 1000)
        order = np.argsort(known)
        common = SimpleNamespace(value=(known[order], counts[order], top["whole"]))
        keys = [set(k) for b in ngram_join._rarest(common, 80, 100)([batch]) for k in b.column(1).to_pylist()]
        linked = [(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if len(s) and 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))]
        assert len(linked) > 20 and all(keys[i] & keys[j] for i, j in linked)
        assert len(keys) == len(sets) and sum(map(len, keys)) < 0.4 * sum(map(len, sets))
