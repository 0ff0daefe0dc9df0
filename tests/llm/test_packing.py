import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stormspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, piece string, length string"


def expected(rows, capacity):
    tok = Tokenizer.from_file(PATH)
    out = set()
    for doc, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[s : s + capacity], "<u4")
            out.add((doc, k, s, len(own), zlib.crc32(own.tobytes())))
    return out


def check(spark, rows, capacity, parts=3, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = packing.pack(docs, PATH, capacity=capacity, **options).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected(rows, capacity))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


def test_pieces_and_places(spark):
    rng = random.Random(3)
    words = ["Thé", "straße", "it's", "<|endoftext|>", "12345", "á", "日本語", "x" * 90, "e f", "İI", "Σας", "\x1c", "##&&", "and", "of", " "]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300]))), "x", "y") for i in range(120)] + [(500, None, None, None), (501, "", None, None), (502, " \n ", None, None)]
    n, total = check(spark, rows, 64)
    assert n <= 1.1 * total / 64 + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_rounds(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["of"] * rng.randint(1, 120)), None, None) for i in range(600)]
    n, total = check(spark, rows, 128, parts=20, fan_in=3)
    assert n <= 1.03 * total / 128 + 1


def test_no_underfull_sequence_is_left_behind(spark):
    """Partitions of one size each fit only together: every long piece meets a short one in some round."""
    rows = [(i, " ".join(["of"] * (69 if i < 900 else 57)), None, None) for i in range(1800)]
    docs = spark.createDataFrame(rows, DOCS).repartitionByRange(12, "doc_id")
    got = packing.pack(docs, PATH, capacity=128, fan_in=3).select("sequence_id").distinct().count()
    assert got == 900


def test_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 200)
    enc, text = packing.Encoder(PATH), "Thé straße it's <|endoftext|> ##12 " * 60
    raw = np.frombuffer(text.encode(), np.uint8)
    parts = [enc.ids(p, np.array([0, len(p)]), 0)[0][:-1] for p in packing.blocks(raw, 200)]
    assert len(parts) > 5
    assert np.concatenate(parts).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_of_awkward_texts():
    """Parts joined give the ids of whole texts, also after the kept parts were forgotten."""
    tok, enc, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH, most=50), random.Random(5)
    signs = ["a", "Z", "é", "É", "ß", "×", "÷", "Þ", "ÿ", "7", "'", "'s", "'ll", "-", "<|", "|>", "<|endoftext|>", "\u0301", "İ", "Σ", "日", "\x1c", "\x85", "\u00a0", "\x01", "\x7f", " ", "\n", "\x0b"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        own = [t.encode() for t in texts[at : at + 100]]
        ids, cuts = enc.ids(np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in own]))), 0)
        for k, t in enumerate(own):
            assert ids[cuts[k] : cuts[k + 1]].tolist() == [*tok.encode(t.decode(), add_special_tokens=False).ids, 0], t


def best_fit_by_item(sizes, capacity):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= size]
        if fit:
            rooms[min(fit)[1]] -= size
        else:
            rooms.append(capacity - size)
    return sorted(rooms)


def test_plans_by_counts_are_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(500):
        capacity = rng.choice([10, 37, 100])
        sizes = rng.choices(range(1, capacity), k=rng.choice([1, 5, 50, 200]))
        if rng.random() < 0.3:
            sizes = rng.choices(sizes[:3], k=len(sizes))
        counts = {s: sizes.count(s) for s in set(sizes)}
        _, rooms = packing.best_fit(counts, capacity)
        assert sorted(r for r, groups in rooms.items() for _, n in groups for _ in range(n)) == best_fit_by_item(sizes, capacity)
        for slack in (-1, 0, 3):
            bins, ups, seen = defaultdict(list), defaultdict(list), dict.fromkeys(counts, 0)
            for length, lo, hi, per, first, place, up in packing.planned(counts, capacity, slack):
                assert lo == seen[length]
                seen[length] = hi
                for x in range(lo, hi):
                    bins[first + (x - lo) // per].append((place + (x - lo) % per * length, length, up is None))
                if up is not None:
                    ups[length] += range(up, up + hi - lo)
            assert seen == counts
            assert all(x == list(range(len(x))) for x in ups.values())
            for held in bins.values():
                at = 0
                for offset, length, _ in sorted(held):
                    assert offset == at
                    at += length
                assert at <= capacity and {x for *_, x in held} == {slack < 0 or capacity - at < slack}
