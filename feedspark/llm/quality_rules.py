"""Quality rules with risk-controlled thresholds (native: DataFrame functions only).

Every document gets a few numeric signals. For each stratum (language) and signal a grid of cutoffs is
walked from the mildest to the strictest. A cutoff is certified while the exact binomial bound on the
labelled holdout says that at most ``alpha`` of the good documents lie above it; the walk stops at the
first cutoff that is not (fixed-sequence testing, no correction inside a walk). The walks share the error
probability ``delta`` (Bonferroni over strata x signals) and the signals of a stratum share ``alpha``,
so with probability 1 - delta every stratum loses at most ``alpha`` of its good documents to the method.
A stratum with too few labels certifies nothing and keeps everything that the base rules keep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_side, stored, words_of

#: Share of good documents that a stratum may lose, and the probability that the guarantee fails.
ALPHA, DELTA = 0.03, 0.05
SIGNALS = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio")
#: Cutoffs of every walk, mildest first; a document is rejected above the certified one.
GRID = (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04)
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words inside ``n``-word windows that occur at least twice in the array."""
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))),
                        lambda w, i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))

    def once(value: Column, body) -> Column:
        # binds a computed array to a name: inside a lambda an expression would be evaluated for every element
        return F.get(F.transform(F.array(value), body), 0)

    def starts(by_hash: Column) -> Column:
        twice = F.transform(by_hash, lambda x, i: F.when(
            F.coalesce(F.get(by_hash, i + 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get(by_hash, i - 1)["g"] == x["g"], F.lit(False)), x["i"]))
        return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))

    def total(starts: Column) -> Column:
        spans = F.transform(starts, lambda s, i: F.least(F.lit(n), F.coalesce(F.get(starts, i + 1) - s, F.lit(n))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(grams: Column) -> Column:
        pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return once(F.array_sort(pairs), lambda by_hash: once(starts(by_hash), total))

    return F.when(F.size(words) <= n, F.lit(0).cast("long")).otherwise(
        once(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long"))
             .otherwise(counted(g))))


def signals(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts and signals per row of ``docs``: doc_id, row_key, stratum, the base counts and SIGNALS.

    NULL or empty text: no words, all counts 0. ``row_key`` is a hash of id, text and stratum, so repeated
    ids with different texts stay apart. Extra columns of ``docs`` are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", F.xxhash64("doc_id", "text", stratum).alias("row_key"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        text.alias("text"), words_of(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = base.select(
        "doc_id", "row_key", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "*",
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact, for k below the mean; 1 above it (never a proof there).

    Summed downwards from the term of k, the largest one, so nothing underflows early.
    """
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_k = (F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))
             + k * math.log(p) + (n - k) * math.log1p(-p))
    series = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct(
            (a["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("term"),
            (a["sum"] + a["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)).alias("sum")))["sum"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(log_k) * series)


def certified_cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                      grid: tuple[float, ...] = GRID, signal_names: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Strictest certified cutoff per stratum: stratum and one column ``cut_<signal>`` (NULL: none).

    ``holdout`` holds good documents only: stratum and the signals. Rows with a NULL signal count as not
    rejected. The result has a row for each stratum with a certified cutoff.
    """
    steps = [F.struct(F.lit(i).alias("step"), F.lit(c).alias("cut")) for i, c in enumerate(grid)]
    counts = [F.sum((F.col(s) > c).cast("long")).alias(f"{s}_{i}")
              for s in signal_names for i, c in enumerate(grid)]
    by_stratum = stored(holdout.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "quality-counts")
    strata = max(1, by_stratum.count())
    tests = by_stratum.select(
        "stratum", "n", F.explode(F.array(*(
            F.struct(F.lit(s).alias("signal"), F.lit(i).alias("step"), F.lit(c).alias("cut"),
                     F.coalesce(F.col(f"{s}_{i}"), F.lit(0).cast("long")).alias("k"))
            for s in signal_names for i, c in enumerate(grid)))).alias("t")).select("stratum", "n", "t.*")
    proof = tests.withColumn("p", binomial_cdf(F.col("n"), F.col("k"), alpha / len(signal_names)))
    passed = proof.withColumn("ok", F.col("p") <= delta / (strata * len(signal_names)))
    walks = passed.groupBy("stratum", "signal").agg(
        F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))), F.lit(len(steps))).alias("stop"))
    ladder = F.array(*(F.lit(c) for c in grid))
    return (walks.filter(F.col("stop") > 0)
            .withColumn("cut", F.get(ladder, F.col("stop") - 1))
            .groupBy("stratum")
            .agg(*(F.max(F.when(F.col("signal") == s, F.col("cut"))).alias(f"cut_{s}") for s in signal_names)))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                     stratum: str = "lang") -> DataFrame:
    """Signals and verdict per row of ``docs``: the columns of ``signals`` and ``kept``.

    ``labels``: doc_id, quality, toxic. Good documents have quality 1 and are not toxic; of repeated labels
    of a document any 0 quality or toxic 1 makes it not good; NULL labels are ignored. Empty ``docs`` gives
    an empty result, empty ``labels`` certify nothing.
    """
    table = stored(signals(docs, stratum), "quality-signals")
    good = (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
            .filter((F.col("q") == 1) & (F.coalesce(F.col("x"), F.lit(0)) == 0)).select("doc_id"))
    cuts = stored(certified_cutoffs(table.join(good, "doc_id", "left_semi"), alpha, delta), "quality-cutoffs")
    over = F.lit(False)
    for s in SIGNALS:
        over = over | F.coalesce(F.col(s) > F.col(f"cut_{s}"), F.lit(False))
    return (table.join(small_side(cuts), "stratum", "left")
            .withColumn("kept", ~F.col("base_failed") & ~over))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    verdicts = quality_verdicts(docs, labels, **options)
    rejected = verdicts.filter(~F.col("kept")).select("doc_id", "row_key").distinct()
    stratum = options.get("stratum", "lang")
    return docs.join(rejected.hint("shuffle_hash"),
                     F.xxhash64(docs["doc_id"], docs["text"], docs[stratum]).eqNullSafe(rejected["row_key"])
                     & docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")
