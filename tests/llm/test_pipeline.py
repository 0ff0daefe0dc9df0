"""The stages one after another: on the smallest tables, and against brute force on planted rows."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stormspan.llm import quality
from stormspan.llm.queries import fold
from tests.llm.test_operators import expected_hits

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, marks string, grp string, _row string, one string"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def planted():
    """Good documents with near copies, repeated rows, null ids, empty texts, shared and benchmark passages; and bad ones. Also labels and benchmark."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    noise = lambda n: " ".join("#%$!&"[rng.randint(0, 4)] * rng.randint(1, 9) for _ in range(n))
    items = [prose(20) for _ in range(5)]
    passage, rows = prose(70), []
    for i in range(60):
        text = prose(rng.randint(60, 200))
        if i % 6 == 0:
            text = f"{text} {passage} {prose(20)}"
        if i % 10 == 3:
            text = f"{prose(30)} {items[i % 5].upper()} {prose(30)}"
        rows.append((i, text))
    for i in range(0, 60, 4):  # two words of many differ
        own = rows[i][1].split()
        own[0], own[-1] = "start", "end"
        rows.append((100 + i, " ".join(own)))
    rows += [rows[7], rows[7], (None, rows[8][1]), (None, prose(80)), (None, prose(80)), (300, None), (301, ""), (302, None), (303, prose(4000))]
    rows += [(400 + i, noise(rng.randint(50, 200))) for i in range(60)]
    labels = [(d, 1 if d < 400 else 0, 0) for d, _ in dict(rows).items() if d is not None and d < 300 or d is not None and d >= 400]
    return rows, labels, [(f"item{i}", t) for i, t in enumerate(items)] + [("none", None), ("empty", "")]


def near_classes(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def without_later_copies(rows, length):
    """Rows in order of their ids; a byte goes if a string of `length` bytes that covers it starts earlier too."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        starts = [k for k in range(len(b) - length + 1) if b[k : k + length] in seen or seen.add(b[k : k + length])]
        gone = np.zeros(len(b) + 1, int)
        for k in starts:
            gone[k] += 1
            gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((d, None if t is None else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()))
    return out


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, bench = planted()
    extra = [(*r, "en", "s", None if r[1] is None else len(r[1]), k, "m", "g", "r", "o") for k, r in enumerate(rows)]
    docs = spark.createDataFrame(extra, COLUMNS).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    have = lambda: [(r.doc_id, r.text) for r in docs.collect()]
    counted = lambda x: Counter(map(str, x))
    stages = iter(corpus_pipeline.STAGES)

    def step(k):
        next(stages)[1](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or out.columns == docs.columns
        return out

    # quality: the machine's own scores decide, and clean documents stay
    good = {(r.doc_id, r.score >= 0.5) for r in quality.score(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), fold(3) != 1).collect()}
    before, docs = have(), step(0)
    assert counted(have()) == counted(r for r in before if r[0] is not None and (r[0], True) in good) + counted(r for r in have() if r[0] is None)
    assert {d for d, t in have() if t} >= set(range(60)) and not {d for d, _ in have() if d is not None and d >= 400}
    # near duplicates: one row of each class, that of the smallest id
    before, docs = have(), step(1)
    before.sort(key=lambda r: (r[0] is None, r[0] or 0))
    classes = near_classes([t for _, t in before], 5, 80)
    assert counted(have()) == counted(before[k] for k in sorted({classes.index(c) for c in classes}))
    assert len(have()) < len(before) - 10
    # suffix array: the first copy of each passage stays
    before, docs = have(), step(2)
    assert counted(have()) == counted(without_later_copies(before, 200))
    assert sum(len(t or "") for _, t in have()) < sum(len(t or "") for _, t in before) - 1000
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    # benchmark
    before, docs = have(), step(3)
    assert counted(have()) == counted(r for r in before if not expected_hits(r[1], bench)[3])
    assert len(have()) < len(before)
    # packing
    before, docs = have(), step(4)
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d, t in before:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want.append((d, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())))
    assert counted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect()) == counted(want)


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
