"""Dedup operators against brute force, on rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormspan.llm import components, neardup, sketch, substring, suffix

SCHEMA = "doc_id long, text string, tid string, marks string, n int, own string, c0 string"
MAX = (1 << 63) - 1


def corpus(seed, n=60, size=70):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)] + ["é", "日本", "x" * 300]
    passages = [" ".join(rng.choices(words, k=80)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, size)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), rng.choice(passages))
        if rng.random() < 0.2:
            parts.append(parts[0])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, " \n\t"), (105, "a b " * 200), (106, "a" * 900), (107, "one two"), (None, rows[3][1]), (None, passages[0])]
    rows += [(100, rows[3][1]), (5, passages[1]), (108, " ".join(rng.choices(words, k=30_000)) + passages[2])]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "q") for r in rows], SCHEMA).repartition(parts)


def test_substring_windows(spark):
    rows = corpus(1)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.dedup(frame(spark, rows)).collect())
    least = {}
    split = [(MAX if d is None else d, (t or "").split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            least[key] = min(least.get(key, MAX), d)
    want = Counter()
    for (d, w), (own, _) in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[own, len(w), sum(gone), kept] += 1
    assert got == want
    assert sum(k[2] for k in want) > 1000


def test_substring_empty_and_short_window(spark):
    assert substring.dedup(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (2, "x b c d e y"), (3, "b c d e")]
    got = {r.doc_id: r.text for r in substring.dedup(frame(spark, rows), window=4, gram=2).collect()}
    assert got == {1: "a b c d e f", 2: "x y", 3: ""}


@pytest.mark.parametrize("mode", ["all", "first"])
def test_suffix_strings(spark, mode):
    rows = [r for r in corpus(2) if r[0] != 108 and r != (100, dict(corpus(2)[3:4]).get(3))]
    if mode == "first":  # rows of equal id and text count as one there
        rows = list(dict.fromkeys(rows))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.dedup(frame(spark, rows), mode=mode).collect())
    texts = sorted(((MAX if d is None else d, i, (t or "").encode()) for i, (d, t) in enumerate(rows)), key=lambda x: x[:1])
    if mode == "first":  # ties by text where ids are equal: only null ids here, whose order doesn't matter to the counts below
        texts = [t for t in texts if rows[t[1]][0] is not None]
        rows_used = {t[1] for t in texts}
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.dedup(frame(spark, [rows[i] for i in rows_used if rows[i] != (5, rows[-1][1])]), mode=mode).collect())
        texts = [t for t in texts if rows[t[1]] != (5, rows[-1][1])]
    counts = Counter(b[i : i + 200] for _, _, b in texts for i in range(len(b) - 199))
    seen, want = set(), Counter()
    for _, k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            s = b[i : i + 200]
            if (counts[s] > 1) if mode == "all" else (s in seen):
                gone[i : i + 200] = b"\1" * 200
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[rows[k][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert sum(k[2] for k in want) > 1000


def test_suffix_hot_anchors(spark, monkeypatch):
    """Popular passages are dealt by string, with the same result."""
    rng = random.Random(5)
    passage = " ".join(str(rng.random()) for _ in range(30))
    rows = [(i, f"{rng.random()} " * 5 + passage + f" {rng.random()}" * 5) for i in range(30)]
    plain = {r.doc_id: r.n_removed for r in suffix.dedup(frame(spark, rows), mode="first").collect()}
    monkeypatch.setattr(suffix, "HOT", 5)
    hot = {r.doc_id: r.n_removed for r in suffix.dedup(frame(spark, rows), mode="first").collect()}
    assert plain == hot and plain[0] == 0 and plain[29] >= len(passage)


def common_prefix(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("least", [1, 4])
def test_longest_previous_factors(least):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("ab", k=rng.randint(0, 40)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = np.array([0, *(common_prefix(text[i:], text[j:]) for i, j in zip(order, order[1:], strict=False))][: len(text)], np.int64)
        got = np.empty(len(text), np.int64)
        got[order] = suffix.longest_previous(np.array(order, np.int64), shared, least)
        want = [max((common_prefix(text[i:], text[j:]) for j in range(i)), default=0) for i in range(len(text))]
        assert got.tolist() == [x if x >= least else 0 for x in want]


def test_factors_decide(monkeypatch):
    """What is removed follows from the factors, for whole blocks and for parts of them."""
    rows = [(7, 1, 1, 0, 11, False, b"abcdefghijklmnopqrst"), (7, 2, 2, 5, 11, False, b"abcdefghijklmnopqrst"), (7, 3, 3, 0, 6, False, b"XYcdefghijklmno")]
    assert sorted(suffix.settle(rows, 10, True)) == [(2, 2, 5, 11), *((3, 3, k, 1) for k in range(2, 6))]
    assert sorted(suffix.settle(rows, 10, False)) == [(1, 1, 0, 11), (2, 2, 5, 11), *((3, 3, k, 1) for k in range(2, 6))]
    monkeypatch.setattr(suffix, "longest_previous", lambda position, shared, least: np.zeros(len(position), np.int64))
    assert suffix.settle(rows, 10, True) == []


@pytest.mark.parametrize("mode", ["first", "all"])
def test_suffix_long_texts(spark, mode, monkeypatch):
    """A text in overlapping parts loses what it loses in one."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=500))
    rows = [(k, "".join(rng.choices("abcdefgh ", k=rng.randint(100, 3000))) + passage[rng.randint(0, 200) :] + "".join(rng.choices("xyz", k=2000))) for k in range(12)]
    whole = {r.doc_id: (r.n_removed, r.n_spans, r.kept) for r in suffix.dedup(frame(spark, rows), mode=mode).collect()}
    monkeypatch.setattr(suffix, "parts_of", lambda batches, length, also=None, own=suffix.parts_of: own(batches, length, also, 700))
    cut = {r.doc_id: (r.n_removed, r.n_spans, r.kept) for r in suffix.dedup(frame(spark, rows), mode=mode).collect()}
    assert whole == cut and sum(x[0] for x in whole.values()) > 3000


def test_remove_copies_keeps_columns_and_characters(spark):
    text = "é" * 150
    rows = [(1, text), (2, "abc" + text + "def"), (3, None)]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in suffix.remove_copies(docs, length_col="n").collect()}
    assert suffix.remove_copies(docs).columns == docs.columns
    assert out[2].text == "abcdef" and out[2].n == 6
    assert out[3].text is None and out[3].n == 1 and out[1].marks == "y"
    assert 0 < len(out[1].text) <= 150


def test_finishing_runs_one_python_evaluation_a_task(spark):
    """Few marks aren't broadcast: that would chain two evaluations, so a task would hold two workers."""
    rows = corpus(7)
    for out in (suffix.remove_copies(frame(spark, rows)), suffix.dedup(frame(spark, rows)), substring.dedup(frame(spark, rows))):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def jaccard_components(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
        sets.setdefault(MAX if d is None else d, []).append(s)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}, sets


def near_corpus(seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(500)]
    base = rng.choices(words, k=150)
    rows = []
    for i in range(70):
        own = list(base) if i % 2 else rng.choices(words, k=60)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return [*rows, (200, rows[1][1].lower()), (201, rows[1][1]), (202, None), (203, ""), (204, "a"), (205, "A"), (206, "a b"), (207, "a c"), (None, rows[5][1]), (1, rows[1][1])]


@pytest.mark.parametrize(("block", "wide"), [(512, 16), (7, 16), (7, 0)])
def test_near_duplicates(spark, block, wide):
    """With small blocks the grid of outsiders gives the same components, over whole components and over buckets."""
    rows = near_corpus(6)
    want, sets = jaccard_components(rows, 3, 85)
    got = neardup.near_duplicates(frame(spark, rows), 0.85, 3, block=block, wide=wide).collect()
    assert len(got) == len(rows)
    for r in got:
        d = MAX if r.doc_id is None else r.doc_id
        assert (MAX if r.component_id is None else r.component_id) == want[d]
        assert r.n_shingles in {len(s) for s in sets[d]}
    assert len(set(want.values())) < len(want) - 8


def test_near_duplicates_empty_and_keep_one(spark):
    assert neardup.near_duplicates(frame(spark, []), 0.8).count() == 0
    text = " ".join(f"t{i}" for i in range(100))
    docs = frame(spark, [(3, text), (7, text + " more"), (9, "other"), (10, None), (None, "x y")])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 9, 10, None}


def test_near_duplicates_null_ids_and_repeated_rows(spark):
    """Null-id copies don't link what they are copies of, and one row of each component stays."""
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = frame(spark, [(5, a), (9, b), (None, a + " more"), (None, b + " more"), (7, a), (7, a), (5, a), (None, "x y"), (None, "x y"), (None, None), (3, "q r"), (3, "s t")])
    got = neardup.near_duplicates(docs, 0.8).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("5", "5", True), ("5", "5", False), ("7", "5", False), ("7", "5", False), ("None", "5", False), ("9", "9", True), ("None", "9", False), ("None", "None", True), ("None", "None", False), ("None", "None", True), ("3", "3", True), ("3", "3", True)])
    kept = neardup.keep_one(docs).select("doc_id", "text").collect()
    assert sorted((str(d), str(t)) for d, t in kept) == sorted([("5", a), ("9", b), ("None", "x y"), ("None", "None"), ("3", "q r"), ("3", "s t")])


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (20, 10)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[3] == 1 and got[9] == 7 and got[20] == 10 and got[139] == 100 and got[340] == 300
    assert len(got) == 3 + 3 + 2 + 40 + 41
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands_miss_rarely():
    for t in (0.8, 0.85):
        assert (1 - t**5) ** neardup.n_bands(t) <= 1e-6


def test_sketch_never_underestimates(spark):
    import numpy as np
    import pyarrow as pa

    def hashes(batches):
        for b in batches:
            yield b.column("h").to_numpy().view(np.uint64)

    rows = spark.range(3000).select((F.col("id") % 1000 * 7919).alias("h"))
    found = sketch.sketch(rows, hashes, (2, 3, 4))
    own = (np.arange(1000, dtype=np.int64) * 7919).view(np.uint64)
    assert found.reaches(own, 0).all() and found.reaches(own, 1).all() and not found.reaches(own, 2).any()
    assert found.reaches(np.arange(10**6, 10**6 + 1000, dtype=np.uint64) * np.uint64(3)).sum() < 5
    assert pa is not None
