"""URL filter by a character language-model ratio.

Rules (host and path) decide some URLs. These decided URLs, but for a held-out fifth, train two variable-order Markov
models over characters, one of accepted and one of rejected URLs, smoothed by Witten-Bell interpolation over contexts of
0 to `order` - 1 characters. All other URLs are judged by the difference of both models' log-likelihoods divided by the
length, against a threshold calibrated on the held-out decided URLs: the point between both classes' means, each
weighted by the other's standard deviation.

Counts cover all decided URLs and all of their n-grams are kept; the model is a table that is joined, never collected. What
it says of a character depends on the n-gram that ends there alone, so each distinct n-gram of the URLs to be judged is
valued once, level by level; a key of these joins has no more rows than the alphabet has characters. Scoring explodes
characters and looks their n-grams up: the `head` most frequent ones in a broadcast table of that proven size, the rest,
none of which is frequent, through a shuffle. Partial sums leave the scan as one row for each URL, so no host or URL can
gather in one task.

The models read the whole URL, with scheme, query and fragment; rules and output columns host and path only.

Defined cases: a null URL or one without `://` has an empty host and path and is judged by the method (a null one as an
empty string); repeated rows are judged each for itself; without decided URLs of either verdict everything undecided is
allowed; other columns are not read. Ties at the threshold are allowed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import materialize, plain_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, start of the path, verdict)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER = 5
#: N-grams that are looked up in a broadcast table; the others are joined.
HEAD = 100_000
#: Possible characters for the shortest context.
ALPHABET = 256
#: Around a URL's characters.
BEGIN, END = "\x02", "\x03"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def grams(df: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of _s: the column gram is the character after up to order - 1 earlier ones."""
    at = F.explode(F.sequence(F.lit(1), F.length("_s"))).alias("_i")
    return df.select(*keep, "_s", at).select(*keep, F.substring(F.col("_s"), F.greatest(F.col("_i") - (order - 1), F.lit(1)), F.least(F.col("_i"), F.lit(order))).alias("gram"))


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """From rows (_s, accepted boolean) the model: gram, k (its length), llr (log-ratio of its last character after the others) and escape (log-ratio of the escape weights after it)."""
    longest = grams(labelled, order, "accepted").groupBy("gram").agg(F.sum(F.col("accepted").cast("long")).alias("na"), F.sum((~F.col("accepted")).cast("long")).alias("nr"))
    suffix = F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("k")
    counted = longest.select("gram", "na", "nr", suffix).select(F.expr("right(gram, k)").alias("gram"), "k", "na", "nr").groupBy("gram", "k").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    counted = materialize(counted, "grams")
    context = counted.groupBy(F.expr("left(gram, k - 1)").alias("ctx")).agg(*(f(x).alias(f"{n}{c}") for c, x in (("a", "na"), ("r", "nr")) for n, f in (("n_", F.sum), ("t_", lambda x: F.sum((F.col(x) > 0).cast("long"))))))
    context = materialize(context, "contexts")
    levels: list[DataFrame] = []
    for k in range(1, order + 1):
        level = counted.where(F.col("k") == k).withColumn("ctx", F.expr(f"left(gram, {k - 1})")).join(context, "ctx")
        if not levels:
            level = level.withColumns({"la": F.lit(1.0 / ALPHABET), "lr": F.lit(1.0 / ALPHABET)})
        else:
            lower = levels[-1].select(F.col("gram").alias("_g"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
            level = level.join(lower, F.expr("right(gram, k - 1)") == F.col("_g"), "left").fillna(1.0 / ALPHABET, ["la", "lr"])
        mixed = {f"p{c}": F.when(F.col(f"n_{c}") + F.col(f"t_{c}") > 0, (F.col(f"n{c}") + F.col(f"t_{c}") * F.col(f"l{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"l{c}")) for c in "ar"}
        levels.append(materialize(level.withColumns(mixed).select("gram", "k", "pa", "pr"), f"level{k}"))
    weight = {c: F.when(F.col(f"n_{c}") > 0, F.log(F.col(f"t_{c}") / (F.col(f"n_{c}") + F.col(f"t_{c}")))).otherwise(0.0) for c in "ar"}
    escapes = context.select(F.col("ctx").alias("gram"), (weight["a"] - weight["r"]).alias("escape"))
    probability = functools.reduce(DataFrame.unionByName, levels)
    model = probability.join(escapes, "gram", "left").select("gram", "k", F.log(F.col("pa") / F.col("pr")).alias("llr"), F.coalesce("escape", F.lit(0.0)).alias("escape"))
    return materialize(model, "model")


def valued(df: DataFrame, model: DataFrame, order: int, head: int) -> tuple[DataFrame, DataFrame | None]:
    """gram and value (log-ratio of its last character) of all n-grams of df's _s: the most frequent ones, at most `head`, and the others, if there are any."""
    counts = materialize(grams(df, order).groupBy("gram").agg(F.count("*").alias("n")), "counts")
    suffix = F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("k")
    needed = materialize(counts.select("gram", suffix).select(F.expr("right(gram, k)").alias("gram"), "k").distinct(), "needed")
    levels: list[DataFrame] = []
    for k in range(1, order + 1):
        own = model.where(F.col("k") == k).select("gram", "llr")
        level = needed.where(F.col("k") == k).select("gram").join(own, "gram", "left")
        lower: Column = F.lit(0.0)
        if levels:
            after = model.where(F.col("k") == k - 1).select(F.col("gram").alias("_c"), "escape")
            shorter = levels[-1].select(F.col("gram").alias("_g"), F.col("value").alias("_lower"))
            level = level.join(after, F.expr(f"left(gram, {k - 1})") == F.col("_c"), "left").join(shorter, F.expr(f"right(gram, {k - 1})") == F.col("_g"))
            lower = F.col("_lower") + F.coalesce("escape", F.lit(0.0))
        levels.append(materialize(level.select("gram", F.coalesce(F.col("llr"), lower).alias("value")), f"values{k}"))
    values = materialize(counts.join(functools.reduce(DataFrame.unionByName, levels), "gram"), "values")
    # at most 64 rows: n-grams by the size of their count
    sizes = {r.b: r.n for r in values.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= head:
        least -= 1
        total += sizes.get(least, 0)
    frequent = F.col("n") >= F.lit(1 << least)
    return values.where(frequent).select("gram", "value"), None if least == 0 else values.where(~frequent).select("gram", "value")


def scored(df: DataFrame, values: tuple[DataFrame, DataFrame | None], order: int, *keep: str) -> DataFrame:
    """keep and score (mean log-ratio of a character) for each row of df, which has _s; keep must tell rows apart."""
    chars, (head, tail) = grams(df, order, *keep), values
    sums = chars.join(F.broadcast(head), "gram").groupBy(*keep).agg(F.sum("value").alias("_sum"), F.count("*").alias("_n"))
    if tail is not None:
        rest = chars.join(F.broadcast(head.select("gram")), "gram", "left_anti").join(tail, "gram")
        sums = sums.unionByName(rest.groupBy(*keep).agg(F.sum("value").alias("_sum"), F.count("*").alias("_n"))).groupBy(*keep).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    return sums.select(*keep, (F.col("_sum") / F.col("_n")).alias("score"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER, head: int = HEAD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: id_col, host, path, rule, verdict, score (null where a rule decides), threshold."""
    host, path = parsed(F.col(url_col))
    whole = F.concat(F.lit(BEGIN), F.coalesce(F.col(url_col), F.lit("")), F.lit(END))
    base = pages.select(F.col(id_col), *(c.alias(n) for c, n in ((host, "host"), (path, "path"), (whole, "_s"))))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    base = base.select(id_col, "host", "path", "_s", rule.alias("rule"), verdict.alias("_verdict"))
    held_out = F.pmod(F.crc32(F.encode("_s", "UTF-8")), F.lit(5)) == 0
    decided = base.where("_verdict IS NOT NULL").withColumn("accepted", F.col("_verdict") == "allow")
    model = train(decided.where(~held_out).select("_s", "accepted"), order)
    values = valued(base.where(F.col("_verdict").isNull() | held_out), model, order, head)
    checked = scored(decided.where(held_out).withColumn("_row", F.monotonically_increasing_id()), values, order, "_row", "accepted")
    means = {r.accepted: (r.m, r.s) for r in checked.groupBy("accepted").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    if len(means) == 2:
        (ma, sa), (mr, sr) = means[True], means[False]
        threshold = (ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2
    else:
        threshold = float("-inf")
    keys = ("_row", id_col, "host", "path", "rule")
    open_rows = scored(base.where("_verdict IS NULL").withColumn("_row", F.monotonically_increasing_id()), values, order, *keys)
    judged = open_rows.select(id_col, "host", "path", "rule", F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
    ruled_rows = base.where("_verdict IS NOT NULL").select(id_col, "host", "path", "rule", F.col("_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled_rows.unionByName(judged).withColumn("threshold", F.lit(threshold))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER, head: int = HEAD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows of pages whose verdict is allow."""
    allowed = judge(pages, rules, order, head, id_col, url_col).where("verdict = 'allow'").select(F.col(id_col).alias("_allowed")).distinct()
    own, names = plain_names(pages)
    return own.join(allowed, F.col(names[id_col]).eqNullSafe(F.col("_allowed")), "left_semi").toDF(*pages.columns)
