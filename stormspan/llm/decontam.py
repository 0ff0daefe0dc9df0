"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. A test item gives
one window for each 13 consecutive words; an item of fewer words, but not none, is one window as a whole. Each document
is scanned once: its word windows are hashed and looked up in a hash table that the plan carries to the executors, an
array of 64-bit hashes with open addressing. A hit there is verified by a second 64-bit hash, made from the window's
characters and not from its words' hashes; the scan's result is verified on the windows' texts besides, by a join of the
few hits. All of the scan is row by row in the JVM, so it needs no shuffle, and a document that contains a popular
passage is no heavier than another.

The table is carried only while the benchmark has at most `max_windows` distinct windows, which is counted first: some
100 bytes for each window in each task. The windows of a larger benchmark are joined by text through a shuffle instead, with
equal results in both modes.

Defined cases: null or empty texts have no words, n_hit 0 and are not contaminated; repeated rows are judged each for
itself; null item texts have no windows; items with equal windows all count; empty tables give empty or clean results;
other columns of the inputs are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import materialize, plain_names

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N_WORDS = 13
#: Distinct windows that the plan carries at most.
MAX_WINDOWS = 1_000_000
SPAN = "array<struct<pos:int,len:int,win:string>>"

#: Lengths of the windows, and two hashes of each.
Known = tuple[list[int], np.ndarray, np.ndarray]


def words(text: Column | str) -> Column:
    """Normalised words of a text; of null an empty array."""
    return F.coalesce(F.regexp_extract_all(F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N_WORDS) -> DataFrame:
    """One row for each distinct window: win (words joined by a space), len, and the sorted ids of its items as strings."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    spans = F.when(F.size("w") < n, F.array(F.array_join("w", " "))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " ")))
    wins = items.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), F.explode(F.array_distinct(spans)).alias("win"))
    return wins.groupBy("win", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _table(codes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Open addressing: both hashes by slot, the number that marks a free slot, the mask of home slots, the longest probe."""
    size = 1 << max(4, int(4 * len(codes)).bit_length())
    home = codes & (size - 1)
    order = np.argsort(home, kind="stable")
    at = np.arange(len(codes))
    slot = np.maximum.accumulate(home[order] - at) + at if len(codes) else at
    used = set(codes.tolist())
    free = next(k for k in range(len(used) + 1) if k not in used)
    longest = int((slot - home[order]).max()) + 1 if len(codes) else 0
    table, second = np.full(size + longest + 1, free, np.int64), np.zeros(size + longest + 1, np.int64)
    table[slot], second[slot] = codes[order], checks[order]
    return table, second, free, size - 1, longest


def _array(values: np.ndarray) -> Column:
    """An array literal; folded by the optimiser from one string."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def spans_in_row(docs: DataFrame, known: Known, text_col: str, out: str = "_spans") -> DataFrame:
    """docs with the columns _words and `out`: array<struct<pos,len,win>> of all windows found in the table."""
    lengths, codes, checks = known
    docs = docs.withColumn("_words", words(text_col)).withColumn("_codes", F.expr("transform(_words, w -> xxhash64(w))"))
    table, second, free, mask, longest = _table(codes, checks)

    def found(tables: Column, code: Column, text: Column) -> Column:
        """Most home slots are free, so the probe is rare."""
        home = code.bitwiseAND(F.lit(mask)).cast("int")
        probe = F.sequence(home, home + F.lit(longest))
        same = F.exists(probe, lambda at: (F.get(tables["code"], at) == code) & (F.get(tables["check"], at) == F.xxhash64(text, F.lit(1))))
        return (F.get(tables["code"], home) != F.lit(free)) & same

    def spans(n: int, tables: Column) -> Column:
        # single elements, since a slice of an array takes time in proportion to its start
        def text(i: Column) -> Column:
            return F.concat_ws(" ", *(F.get("_words", i + (k - 1)) for k in range(n)))

        places = F.when(F.size("_codes") >= n, F.sequence(F.lit(1), F.size("_codes") - (n - 1))).otherwise(F.array().cast("array<int>"))
        # a code is computed once for each place
        coded = F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get("_codes", i + (k - 1)) for k in range(n))).alias("code")))
        hits = F.filter(coded, lambda x: found(tables, x["code"], text(x["pos"])))
        return F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), F.lit(n).alias("len"), text(x["pos"]).alias("win")))

    if not lengths:
        return docs.withColumn(out, F.array().cast(SPAN))
    # a lambda's variable holds the tables, so the plan has one copy of them
    both = F.array(F.struct(_array(table).alias("code"), _array(second).alias("check")))
    return docs.withColumn(out, F.get(F.transform(both, lambda t: F.concat(*(spans(n, t) for n in lengths))), F.lit(0)))


def spans_by_join(coded: DataFrame, windows: DataFrame) -> DataFrame:
    """From written rows (_row, _words) the columns _row, pos, len, win, items of all hits, by a join of every window's text."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    every = [F.expr(f"transform(filter(sequence(1, greatest(size(_words) - {n - 1}, 1)), i -> size(_words) >= {n}), i -> struct(i AS pos, {n} AS len, concat_ws(' ', {', '.join(f'get(_words, i + {k - 1})' for k in range(n))}) AS win))") for n in lengths]
    return materialize(coded.select("_row", (F.concat(*every) if every else F.array().cast(SPAN)).alias("_all")).select("_row", F.inline("_all")).join(windows, ["win", "len"]), "hits")


def covered(spans: str) -> Column:
    """Number of words inside any of the spans."""
    return F.expr(f"aggregate(array_sort(transform({spans}, s -> struct(s.pos AS pos, s.len AS len))), struct(0 AS n, 1 AS upto), (a, s) -> struct(a.n + greatest(0, s.pos + s.len - greatest(a.upto, s.pos)) AS n, greatest(a.upto, s.pos + s.len) AS upto), a -> a.n)")


def carried(windows: DataFrame, max_windows: int) -> Known | None:
    """The hashes of all windows, or None if there are more than max_windows."""
    code, check = F.expr("xxhash64(transform(split(win, ' '), w -> xxhash64(w)))"), F.xxhash64("win", F.lit(1))
    if windows.count() > max_windows:
        return None
    # one string for each column, which takes less of the driver than a million rows
    row = windows.agg(F.sort_array(F.collect_set("len")).alias("lengths"), F.concat_ws(",", F.collect_list(code.cast("string"))).alias("codes"), F.concat_ws(",", F.collect_list(check.cast("string"))).alias("checks")).first()
    return row.lengths, *(np.array(x.split(",") if x else [], np.int64) for x in (row.codes, row.checks))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """For each row of docs: id_col, n_words, n_hit, items (sorted ids of items with occurring windows), contaminated."""
    windows = materialize(benchmark_windows(benchmark), "windows")
    known = carried(windows, max_windows)
    base = docs.select(F.col(id_col), F.col(text_col).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    if known is not None:
        found = spans_in_row(base, known, "_text").select("_row", id_col, F.size("_words").alias("n_words"), F.explode_outer("_spans").alias("_s"))
        hits = found.select("_row", id_col, "n_words", "_s.pos", "_s.len", "_s.win").join(windows, ["win", "len"], "left")
    else:
        coded = materialize(base.select("_row", id_col, words("_text").alias("_words")), "words")
        hits = coded.select("_row", id_col, F.size("_words").alias("n_words")).join(spans_by_join(coded, windows), "_row", "left")
    # a row without hits has one row of nulls here
    span = F.when(F.col("items").isNotNull(), F.struct("pos", "len"))
    out = hits.groupBy("_row", id_col, "n_words").agg(F.collect_set(span).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = out.withColumn("n_hit", covered("_spans"))
    return out.select(id_col, F.col("n_words").cast("long"), F.col("n_hit").cast("long"), "items", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without contaminated documents (mode `documents`), or with the hit words of their normalised texts cut out (mode `spans`, texts become normalised words joined by a space)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is {mode!r}; it can be documents or spans")
    windows = materialize(benchmark_windows(benchmark), "windows")
    known = carried(windows, max_windows)
    names, (docs, own) = docs.columns, plain_names(docs)
    text_col = own[text_col]
    if known is None:
        numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        coded = materialize(numbered.select("_row", words(text_col).alias("_words")), "words")
        hits = spans_by_join(coded, windows).groupBy("_row").agg(F.collect_set(F.struct("pos", "len")).alias("_spans"))
        marked = numbered.join(hits, "_row", "left").withColumn("_words", words(text_col)).withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<pos:int,len:int>>")))
    else:
        marked = spans_in_row(docs, known, text_col)
    # The row number keeps the optimiser from writing the whole scan into the filter, once for each use of a column.
    marked = marked.withColumns({"_n_hit": covered("_spans"), "_row": F.monotonically_increasing_id()})
    bad = contaminated(F.col("_n_hit"), F.size("_words"))
    if mode == "documents":
        return marked.where((F.col("_row") >= 0) & ~bad).select(*docs.columns).toDF(*names)
    kept = F.expr("array_join(filter(_words, (w, i) -> NOT exists(_spans, s -> i + 1 >= s.pos AND i + 1 < s.pos + s.len)), ' ')")
    return marked.withColumn(text_col, F.when(F.col("_n_hit") > 0, kept).otherwise(F.col(text_col))).select(*docs.columns).toDF(*names)
