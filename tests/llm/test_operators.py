"""URL filter, decontamination, archives, classifiers and neighbours on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from stormspan.llm import decontam, langid, neighbours, quality, queries, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _words string, _row string"


def docs_frame(spark, rows):
    """rows: (doc_id, text[, lang])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1]), "w", "r") for r in rows], DOCS).repartition(3)


# --- URLs -------------------------------------------------------------------------------------------------------------


def url_rows():
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['a', 'b.c'])}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randint(1, 300)}{rng.choice(['', '?q=1', '#x', '/'])}") for i in range(400)]
    rows += [(500, None), (501, ""), (502, "no scheme"), (503, "://"), (504, "HTTP://Sub.EXAMPLE.org/ES/x"), (505, "http://example.org"), (506, "http://example.org?/es/"), (507, "http://org/"), (508, "http://myorg/x"), (509, "http://x.com/fr/://y"), (None, "http://é.com/de/ü"), (511, "http://h.net/" + "p" * 5000), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def expected_rule(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_url_rules_and_model(spark):
    rows = url_rows()
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, gram int").repartition(3)
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    right = total = 0
    for i, u in rows:
        host, path, rule, verdict = expected_rule(u)
        for r in by[i]:
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
            if rule is None and "/fr/" in (u or "") + " " and ".net" in (u or ""):
                total, right = total + 1, right + (r.verdict == "allow")
            if rule is None and "/de/" in (u or "") and ".net" in (u or ""):
                total, right = total + 1, right + (r.verdict == "block")
    assert total > 20 and right / total > 0.8
    kept = urls.url_filter(pages)
    assert kept.columns == pages.columns and 0 < kept.count() < len(rows)


def test_url_model_reads_the_whole_url(spark):
    """Queries, fragments and URLs without a scheme count."""
    urls_in = [f"http://x.com/{'fr' if i % 2 else 'de'}/{i}?{'good' if i % 2 else 'vile'}" for i in range(200)]
    odd = ["http://y.net/1?good", "http://y.net/1?vile", "http://y.net/1#good", "http://y.net/1#vile", "good good", "vile vile"]
    pages = spark.createDataFrame(list(enumerate(urls_in + odd)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages).where("page_id >= 200").collect()}
    assert [got[200 + i].score > got[201 + i].score for i in (0, 2, 4)] == [True] * 3
    assert (got[200].verdict, got[201].verdict, got[204].host) == ("allow", "block", "")


def test_url_model_without_labels(spark):
    rows = [(i, u) for i, u in url_rows() if expected_rule(u)[2] is None]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages).collect()} == {"allow"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


class Markov:
    """The interpolated model of one class, from its whole strings."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            for at, c in enumerate(t):
                for k in range(min(order - 1, at) + 1):
                    self.after[t[at - k : at]][c] += 1

    def p(self, context, c):
        lower = self.p(context[1:], c) if context else 1 / urls.ALPHABET
        own = self.after.get(context)
        return (own[c] + len(own) * lower) / (sum(own.values()) + len(own)) if own else lower


def expected_scores(rows, order):
    """Of each open URL the mean log-ratio, and the threshold."""
    classes, held, scores = {True: [], False: []}, {True: [], False: []}, {}
    whole = {i: urls.BEGIN + (u or "") + urls.END for i, u in rows}
    for i, u in rows:
        verdict = expected_rule(u)[3]
        if verdict:
            (held if zlib.crc32(whole[i].encode()) % 5 == 0 else classes)[verdict == "allow"].append(whole[i])
    both = {k: Markov(v, order) for k, v in classes.items()}
    known = {t[max(0, at - k) : at + 1] for v in classes.values() for t in v for at in range(len(t)) for k in range(order)}

    def ratio(context, c):
        """Of an n-gram that no class has, the escape weights of its context and the ratio of the shorter one stand."""
        if context + c in known:
            return math.log(both[True].p(context, c) / both[False].p(context, c))
        if not context:
            return 0.0
        escape = 0.0
        for m, sign in ((both[True], 1), (both[False], -1)):
            own = m.after.get(context)
            escape += sign * math.log(len(own) / (sum(own.values()) + len(own))) if own else 0.0
        return escape + ratio(context[1:], c)

    def score(t):
        return sum(ratio(t[max(0, at - order + 1) : at], c) for at, c in enumerate(t)) / len(t)

    scores = {i: score(whole[i]) for i, u in rows if not expected_rule(u)[3]}
    (ma, sa), (mr, sr) = ((np.mean(x), np.std(x)) for x in ([score(t) for t in held[k]] for k in (True, False)))
    return scores, (ma * sr + mr * sa) / (sa + sr)


@pytest.mark.parametrize("head", [urls.HEAD, 40])
def test_url_model_against_brute_force(spark, head):
    """Also where only few n-grams are looked up in a broadcast table."""
    rng = random.Random(8)
    rows = [(i, f"http://{rng.choice(['a.com', 'b.org', 'example.org', 'c.net'])}/{rng.choice(['fr', 'de', 'es', 'en'])}/{''.join(rng.choices('abcdé?#&', k=rng.randint(0, 9)))}") for i in range(300)] + [(300, None), (301, ""), (302, "no scheme")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), head=head).collect()}
    scores, threshold = expected_scores(rows, urls.ORDER)
    assert {i for i, r in got.items() if r.rule is None} == set(scores) and len(scores) > 50
    for i, score in scores.items():
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].threshold == pytest.approx(threshold)
        assert got[i].verdict == ("allow" if score >= threshold else "block")
    assert {got[i].verdict for i in scores} == {"allow", "block"}


def test_url_model_is_a_distribution(spark):
    """Witten-Bell by hand for one context."""
    labelled = spark.createDataFrame([("ab", True), ("ac", True), ("ab", False)], "_s string, accepted boolean")
    model = {r.gram: r for r in urls.train(labelled, order=2).collect()}
    base_a, base_r = (2 + 3 / 256) / 7, (1 + 2 / 256) / 4  # 'a': of 4 and 2 characters with 3 and 2 kinds
    b_a, b_r = (1 + 3 / 256) / 7, (1 + 2 / 256) / 4
    assert model["a"].llr == pytest.approx(np.log(base_a / base_r))
    assert model["ab"].llr == pytest.approx(np.log((1 + 2 * b_a) / 4 / ((1 + 1 * b_r) / 2)))
    assert model["a"].escape == pytest.approx(np.log(2 / 4) - np.log(1 / 2))


# --- decontamination --------------------------------------------------------------------------------------------------


def bench_rows():
    return [(1, " ".join(f"Word{i}" for i in range(20))), (2, "short item, three"), (3, None), (4, ""), (10, " ".join(f"word{i}" for i in range(5, 18))), (11, "x'y \\ z"), (12, "..."), (2, "short item, three")]


def contaminated_docs():
    w = [f"word{i}" for i in range(20)]
    return [(1, " ".join(w)), (2, "intro " + ", ".join(w[:13]).upper() + " end"), (3, "a b c " + " ".join(w[:12])), (4, None), (5, ""), (6, "short-ITEM_three " + "pad " * 80), (7, "short item three"), (8, "pad " * 30000 + " ".join(w)), (9, "X y Z é"), (1, " ".join(w)), (None, "the x y z"), (12, "wordé " * 20)]


def expected_hits(text, bench):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(urls.UPPER, urls.LOWER)))
    hit, items = set(), set()
    for i, t in bench:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(urls.UPPER, urls.LOWER)))
        for k in range(max(1, len(own) - 12) if own else 0):
            win = own[k : k + 13]
            for at in range(len(words) - len(win) + 1):
                if words[at] == win[0] and words[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    items.add(str(i))
    return len(words), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_hash_table():
    """Every window is within the longest probe of its home slot, also where slots collide."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 3000):
        codes = np.unique(rng.integers(-(1 << 62), 1 << 62, n) >> 3 << 3)  # homes at each eighth slot only
        table, second, free, mask, longest = decontam._table(codes, codes + 1)
        for c in codes.tolist():
            at = (c & mask) + np.flatnonzero(table[(c & mask) : (c & mask) + longest + 1] == c)
            assert len(at) == 1 and second[at[0]] == c + 1
        assert free not in codes.tolist() and (table != free).sum() == len(codes)


@pytest.mark.parametrize("most", [60_000, 3])
def test_decontamination(spark, most):
    """A benchmark beyond the bound is joined, with the same result."""
    docs = docs_frame(spark, contaminated_docs())
    bench = spark.createDataFrame([(*b, "t") for b in bench_rows()], "item_id long, text string, win string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"] or [], r.contaminated) for r in decontam.scan(docs, bench, max_windows=most).collect())
    assert got == sorted((str(d), *expected_hits(t, bench_rows())) for d, t in contaminated_docs())
    kept = decontam.decontaminate(docs, bench, max_windows=most)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in got if not x[4])
    assert {r._words for r in kept.collect()} == {"w"}


def test_decontamination_spans_and_empty(spark):
    """Spans are cut out alike on both sides of the bound."""
    docs, none = docs_frame(spark, [(1, "keep this short item three and that"), (2, None)]), docs_frame(spark, [])
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    for most in (60_000, 3):
        assert {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, "spans", max_windows=most).collect()} == {1: "keep this and that", 2: None}
    assert decontam.scan(none, bench).count() == 0
    assert decontam.scan(docs, bench.limit(0)).where("contaminated").count() == 0


# --- archives ---------------------------------------------------------------------------------------------------------


def page_rows():
    rng = random.Random(9)
    big = "".join(rng.choice("abc é\r\n") for _ in range(30_000))
    same = "WARC/1.1\r\n\r\n0\r\n\r\n" * 12
    rows = [(i, f"http://x/{i}", "".join(rng.choice("<p>ü\n") for _ in range(rng.randint(0, 400)))) for i in range(40)]
    return [*rows, (100, None, None), (101, "", ""), (102, "a\r\nb: c", big), (103, "u", big), (99, "u", big + "x"), (110, "u", same), (111, "u", same), (109, "u", same), (120, "u", "x" * 99), (121, "u", "x" * 99), (122, "u", "x" * 100), (123, "u", "x" * 100)]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 700, "records_per_file": 7}, {"compression": "none", "segment_bytes": 5000}])
def test_archives(spark, tmp_path, options):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, **options)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()}
    first = {}
    for i, _, h in sorted(rows):
        raw = (h or "").encode()
        if len(raw) >= 100:
            first.setdefault(raw, i)
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        other = first.get(raw, i)
        want[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other != i else "response", other if other != i else None)
    assert got == want


def test_archives_repeated_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "y" * 200), (1, "u", "y" * 200)], "page_id long, url string, html string")
    assert [r.record_type for r in warc.round_trip(pages).collect()] == ["response"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_keep_every_row(spark, tmp_path):
    """The query gives a row for each page as its SQL does, also for repeated rows and null ids."""
    same, big = "y" * 200, "".join(random.Random(5).choice("ab") for _ in range(150_000))
    rows = [(1, same), (1, same), (2, same), (2, same), (3, big), (3, big), (4, "z"), (4, "z"), (None, same), (None, same), (None, None), (5, None)]
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op10_warc(spark, str(tmp_path)).collect()]
    want = [(i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 1) if (i, h) == (2, same) else ("response", None))) for i, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_broken_archives(spark):
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))
    payload = bytes(range(256)) * 40
    assert warc.dechunked(warc.chunked(payload, 100)) == payload
    parts = [{"segment": k, "page_id": 1, "digest": None, "total": None, "block": b"x"} for k in (1, 3)]
    import pyarrow as pa

    with pytest.raises(ValueError):
        list(warc.reassembler(iter([pa.RecordBatch.from_pylist([{"origin": "o", "parts": parts}])])))


# --- classifiers ------------------------------------------------------------------------------------------------------

VOCABULARY = {"aa": "the of and to in is that".split(), "bb": "der die und zu das ist nicht".split(), "cc": "le la et les des est une".split()}


def lang_rows():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(VOCABULARY[k := rng.choice(sorted(VOCABULARY))], k=rng.randint(8, 60))), k) for i in range(300)]
    return [*rows, (900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (903, "the of and " * 20_000, None), (None, "le la les et", "cc"), (0, rows[0][1], rows[0][2])]


def test_language(spark):
    docs = docs_frame(spark, lang_rows())
    got = langid.identify(docs, queries.fold(5) != 0, max_train=150).collect()
    assert len(got) == len(lang_rows())
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903].lang_pred == "aa" and by[None].lang_pred == "cc"
    known = [(d, k) for d, t, k in lang_rows() if d is not None and d < 300]
    assert sum(by[d].lang_pred == k for d, k in known) / len(known) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_every_language_is_learned(spark):
    """More languages than any list of the most frequent would hold, each with a few documents."""
    rng, rows = random.Random(6), []
    for k in range(230):
        own = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        rows += [(1000 * k + i, "".join(rng.choices(own, k=60)), f"l{k}") for i in range(8)]
    got = langid.identify(docs_frame(spark, rows), queries.fold(5) != 0).collect()
    right = {d: k for d, _, k in rows}
    assert sum(r.lang_pred == right[r.doc_id] for r in got) / len(got) > 0.97


def test_long_text_and_bounded_lookups(spark, monkeypatch):
    """A text of some megabytes is scored by parts with the score that it has as a whole."""
    rows = [r for r in lang_rows() if r[0] is not None and r[0] < 900] + [(950, "the of and " * 100_000, None)]
    docs = docs_frame(spark, rows)
    whole = {r.doc_id: r for r in langid.identify(docs, queries.fold(5) != 0, max_train=100).collect()}
    monkeypatch.setattr(langid, "HELD", 1000)
    parts = {r.doc_id: r for r in langid.identify(docs, queries.fold(5) != 0, max_train=100).collect()}
    assert len(rows[-1][1]) > 1_000_000 and whole[950].lang_pred == "aa" == parts[950].lang_pred
    assert all(whole[d].lang_pred == parts[d].lang_pred and whole[d].score == pytest.approx(parts[d].score, abs=1e-6) for d in whole)


def test_language_without_labels(spark):
    docs = docs_frame(spark, [(1, "the", None), (2, None, None)])
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, queries.fold(5) != 0).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), queries.fold(5) != 0).count() == 0


def test_temperature_and_ftrl():
    scores = np.array([[4.0, 0], [4, 0], [4, 0], [4, 0]])
    t = langid.temperature(scores, np.array([0, 0, 0, 1]))
    assert 1 / (1 + np.exp(-4 / t)) == pytest.approx(0.75, abs=1e-3)
    rows = [(np.array([0, 2]), np.array([1.0, 1.0]), 0), (np.array([1, 2]), np.array([1.0, 1.0]), 1)] * 20
    w = langid.ftrl(rows, 4, 2)
    assert w[0, 0] > 0 > w[0, 1] and (w[3] == 0).all()


def quality_rows():
    rng = random.Random(8)
    rows = []
    for i in range(240):
        good = i % 4 > 0
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(10, 60))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "$$$" for w in words), int(good)))
    return rows


def test_quality(spark):
    rows = quality_rows()
    docs = docs_frame(spark, [r[:2] for r in rows] + [(900, None), (901, ""), (902, "ok fine words. " * 20_000), (None, "abc def"), (3, rows[3][1])])
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows] + [(5, 0, 0), (5, 1, 0), (None, 1, 1), (7777, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels, queries.fold(3) != 1, max_train=200).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert sum((by[d] >= 0.5) == bool(q) for d, _, q in rows) / len(rows) > 0.97
    kept = quality.keep_good(docs, labels, queries.fold(3) != 1, max_train=200)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, s in by.items() if s >= 0.5}


def test_quality_keys_need_no_other_workers(spark, monkeypatch):
    """Learning passes no list through Python workers besides those of mapInArrow."""
    docs = docs_frame(spark, [r[:2] for r in quality_rows()])
    labels = spark.createDataFrame([(d, q) for d, _, q in quality_rows()], "doc_id long, quality int")
    monkeypatch.setattr(RDD, "_to_java_object_rdd", None)
    assert quality.keep_good(docs, labels, queries.fold(3) != 1).count() > 0


def test_quality_without_labels(spark):
    docs = docs_frame(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, labels, queries.fold(3) != 1).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels, queries.fold(3) != 1).count() == 0


def test_machine_pairs_identity():
    m = quality.Machine(6 + quality.STATS, 3)
    m.w = np.random.default_rng(1).normal(size=len(m.w)).astype(np.float32)
    doc, ids, x = np.array([0, 0, 0]), np.array([1, 3, 5]), np.array([0.5, -1.0, 2.0])
    logit, _ = m.logits(1, doc, ids, x)
    pairs = sum(float(m.v[ids[i]] @ m.v[ids[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    assert logit[0] == pytest.approx(float(m.w[ids] @ x) + pairs, rel=1e-4)


# --- neighbours -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, cell int"


def brute(rows, asked, k):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float32).astype(float)
    return {q: sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:k] for q in good if asked(q)}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0, 1) for i in range(500)]
    same = rows[7][1]
    rows += [(1000 + i, same, 0, 1) for i in range(60)] + [(2000, None, 0, 1), (2020, [0.0] * 6, 0, 1), (2040, [float("nan")] * 6, 0, 1), (2060, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, 1), (2080, [1.0], 0, 1), (None, same, 0, 1), (20, rows[20][1], 0, 1), (2100, [float("inf")] * 6, 0, 1)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = {}
    for r in neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), k=20, block=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and len({x[2] for x in found}) == 20
        hits += len({x[2] for x in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    assert [x[2] for x in got[1000]] == [i for _, i in want[1000]]  # ties by id


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (1, [0.5, 0.5], 0, 0), (2, [2.0, 0.0], 0, 0)], VECTORS)
    got = [(r["rank"], r.vec_id, r.score) for r in neighbours.search(few, few.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2, 2.0), (2, 1, 0.5)]
    assert neighbours.search(few.limit(0), few).count() == 0
    assert neighbours.search(few, few.where("vec_id = 77")).count() == 0


def test_psi():
    assert neighbours.psi(np.array([15.507]))[0] == pytest.approx(0.95, abs=1e-4)
    assert F is not None
