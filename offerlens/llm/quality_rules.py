"""Quality rules in DataFrame functions only: counted faults, then a hashed n-gram likelihood ratio.

Two multinomials over hash buckets of single words and of word pairs are counted in one pass: one over the
trusted part of the corpus (texts beyond reproach by the counted faults), one over all of it. A document's
score is the mean, over its words and pairs, of the log ratio of the two smoothed shares; a document stays if
the score reaches the threshold. Counts are whole numbers and sums run in text order, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, pick, words_of

#: Symbols that the rules count.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def base_columns(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the extra columns, hashes (of the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select(
        "doc_id",
        *extra,
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.withColumn("n_words", F.size("hashes").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("windows", windows)
    # Sorted by hash and place, a window found twice stands next to its like.
    df = df.withColumn("by_hash", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("by_hash", lambda x, j: (F.get("by_hash", j - 1)["h"] == x["h"]) | (F.get("by_hash", j + 1)["h"] == x["h"]))
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("starts", lambda s, j: F.coalesce(F.least(F.lit(WINDOW), F.get("starts", j + 1) - s), F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select("doc_id", *extra, "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def trusted_by_faults() -> Column:
    """The default for trusted texts: 50 words or more, symbols at most 1 % of characters, nothing repeated."""
    return ~F.col("base_failed") & (F.col("n_words") >= 50) & (100 * F.col("n_symbols") <= F.col("word_chars")) & (F.col("n_dup_lines") == 0) & (F.col("n_repeat_words") == 0)


def buckets_of(hashes: Column, buckets: int) -> Column:
    """Buckets of the words (0 to buckets - 1) and of the pairs of neighbours (the next as many)."""
    singles = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.transform(hashes, lambda h, i: (F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)) + buckets).cast("int"))
    return F.concat(singles, F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def log_ratios(scored: DataFrame, trusted: Column, buckets: int) -> DataFrame:
    """One row, one array: the log ratio of each bucket, in order of buckets. Its size is fixed."""
    counts = scored.select(F.explode_outer("grams").alias("b"), trusted.cast("long").alias("t")).where("b is not null").groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    every = counts.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0, ["n", "t"])
    # Words and pairs are a multinomial each.
    half = F.col("b") >= buckets
    table = every.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("b", "n", "t"))).alias("rows"),
        *(F.sum(F.when(half == k, F.col(c))).alias(f"{c}{int(k)}") for c in ("n", "t") for k in (False, True)),
    )

    def ratio(x: Column) -> Column:
        pair = x["b"] >= buckets
        return F.log((x["t"] + 1) / (F.when(pair, F.col("t1")).otherwise(F.col("t0")) + buckets)) - F.log((x["n"] + 1) / (F.when(pair, F.col("n1")).otherwise(F.col("n0")) + buckets))

    return table.select(F.transform("rows", ratio).alias("ratios"))


def quality_rules(docs: DataFrame, trusted: Column | None = None, buckets: int = 8192, threshold: float = -0.12, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score of every row, then the carried columns.

    trusted picks the target texts by the counted columns. A null text counts as empty; texts without a word
    fail the base rules and have score 0. Repeated rows count repeatedly and give repeated results, null ids
    stay null, an empty table gives no rows, columns that are not named are not read. The table of ratios has a fixed
    number of entries.
    """
    extra = tuple(f"x{i}" for i in range(len(carry)))
    base = base_columns(pick(docs, doc_id=id_col, text=text_col, **dict(zip(extra, carry))), extra).withColumn("grams", buckets_of(F.col("hashes"), buckets))
    ratios = log_ratios(base, trusted_by_faults() if trusted is None else trusted, buckets).scalar()
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get("ratios", b))
    scored = base.withColumn("ratios", ratios).withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    made = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score", *(F.col(x).alias(c) for x, c in zip(extra, carry))]
    # A caller's filter on kept would be pushed through the projections, and the counts written out and computed
    # over again in it for each mention. It is not pushed through a generator, here of one row.
    return scored.select(F.inline_outer(F.array(F.struct(*made))))
