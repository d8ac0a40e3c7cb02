"""Quality rules: simple counts, and how far a text's n-grams look like trusted text rather than the raw corpus.

Everything here is Spark SQL functions on whole rows; no Python runs on the
executors.  A text's tokens (runs of letters, digits and underscores, or of
other signs that aren't white space; lower case) give unigrams and bigrams,
hashed into BUCKETS.  Two multinomials are counted: over the whole corpus, and
over trusted documents.  A document's score is the mean over its n-grams of
log p_trusted - log p_corpus; it is kept from THRESHOLD up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared

BUCKETS = 8192
#: Mean log ratio a gram from which a document is kept.
THRESHOLD = -0.3
#: Trusted documents that the target multinomial is fitted on, at most: those with the least hashes of their ids.
MOST_TRUSTED = 20_000
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30

_BLANK, _SOLID = r"[\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Runs of signs, set apart by blanks; other white space becomes blanks too.  A split at single blanks needs no pattern.
_APART = rf"([^\p{{L}}\p{{N}}_\s]+)|{_BLANK}"


def _pairs(name: str, step: int) -> Column:
    """Hashes of runs of twice the length, from each of the column's hashes and the one ``step`` further on; null at the end.

    The words' hashes are random already, so a shift and an exclusive or keep
    runs apart, and cost less than hashing again.  The array is an argument
    twice and never named in the lambda, where it would be made for each element.
    """
    ahead = F.slice(name, step + 1, F.greatest(F.lit(0), F.size(name) - step))
    return F.zip_with(F.col(name), ahead, lambda x, y: F.shiftleft(x, step).bitwiseXOR(y))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words and fails.  Each step is a projection of its own,
    so that no array is computed again inside a lambda.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("__t", text)
    df = df.withColumn("__w", F.array_remove(F.split(F.regexp_replace("__t", _BLANK, " "), " ", -1), ""))
    lines = F.filter(F.split("__t", "\n", -1), lambda line: line.rlike(_SOLID))
    df = df.withColumn("__l", lines)
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__h": F.transform("__w", lambda w: F.xxhash64(w)),
    }).drop("__w", "__l", "__t")
    n = F.col("n_words").cast("int")
    # hashes of 2, 4 and 8 words from halves; most texts have no 4 words twice, or no 8, and are done there
    nothing = F.array().cast("array<bigint>")
    df = df.withColumn("__h", _pairs("__h", 1))
    df = df.withColumn("__h", _pairs("__h", 2))
    for width in (4, 8):
        left = F.greatest(F.lit(0), n - (width - 1))
        df = df.withColumn("__h", F.slice("__h", 1, left))
        df = df.withColumn("__h", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.col("__h")).otherwise(nothing))
        if width == 4:
            df = df.withColumn("__h", _pairs("__h", 4))
    df = df.withColumn("__s", F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).drop("__h")
    pairs = F.greatest(F.lit(0), F.size("__s") - 1)
    df = df.withColumn("__e", F.zip_with(F.slice("__s", 1, pairs), F.slice("__s", 2, pairs), lambda a, b: a["h"] == b["h"]))
    edge = F.when(F.size("__s") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    either = F.zip_with(F.concat(edge, F.col("__e")), F.concat(F.col("__e"), edge), lambda a, b: a | b)
    df = df.withColumn("__f", F.zip_with("__s", either, lambda s, f: F.when(f, s["i"]))).drop("__s", "__e")
    df = df.withColumn("__p", F.sort_array(F.filter("__f", lambda i: i.isNotNull()))).drop("__f")
    gaps = F.greatest(F.lit(0), F.size("__p") - 1)
    steps = F.zip_with(F.slice("__p", 1, gaps), F.slice("__p", 2, gaps), lambda a, b: F.least(F.lit(8), b - a))
    repeated = F.when(F.size("__p") > 0, F.aggregate(steps, F.lit(8), lambda acc, x: acc + x)).otherwise(0)
    df = df.withColumn("n_repeat_words", repeated.cast("long")).drop("__p")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _with_grams(df: DataFrame) -> DataFrame:
    """df(text, ...) with __g: hashes of the text's unigrams and bigrams."""
    apart = F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), _APART, " $1 ")
    df = df.withColumn("__k", F.array_remove(F.split(apart, " ", -1), ""))
    df = df.withColumn("__u", F.transform("__k", lambda t: F.xxhash64(t))).drop("__k")
    return df.withColumn("__g", F.concat(F.col("__u"), F.slice(_pairs("__u", 1), 1, F.greatest(F.lit(0), F.size("__u") - 1)))).drop("__u")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """doc_id of at most ``most`` documents that all their rows in labels(doc_id, quality, toxic) call good and not toxic."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return one.where("q = 1 and x = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> str:
    """JSON array of log p_trusted - log p_corpus of every bucket, add-one smoothed; all zero if nothing is trusted.

    One pass over all of docs.  ``trusted`` has a bounded number of ids, so it
    is broadcast; the result has BUCKETS numbers.
    """
    chosen = F.broadcast(trusted.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__trusted")))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("__id"), "left")
    grams = _with_grams(joined.select("text", F.coalesce("__trusted", F.lit(0)).alias("trusted")))
    # outer: from a plain explode Spark infers a filter on the array's size and makes the array again for it, at the scan
    counts = grams.select(F.explode_outer("__g").alias("h"), "trusted").where("h is not null").groupBy(_bucket(F.col("h")).alias("bucket")).agg(F.count("*").alias("r"), F.sum("trusted").alias("t"))
    spark = docs.sparkSession
    every = spark.range(0, BUCKETS, 1, 1).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    found = every.agg(F.sum("r").alias("R"), F.sum("t").alias("T"), F.array_sort(F.collect_list(F.struct("bucket", "r", "t"))).alias("rows")).first()
    if not found["T"]:
        return "[" + ",".join(["0.0"] * BUCKETS) + "]"
    raw, trust = found["R"] + BUCKETS, found["T"] + BUCKETS
    return "[" + ",".join(repr(math.log((x["t"] + 1) / trust) - math.log((x["r"] + 1) / raw)) for x in found["rows"]) + "]"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) with the base counts, ``score`` and ``kept``.

    Every row comes out once, with all its columns (columns of the new names
    are replaced).  Null, empty and blank texts have no words: base_failed,
    score null, not kept.  A text that passes the base rules is kept if its
    score is the threshold or more, or null.  Repeated rows are judged and
    counted each.  Null doc_ids are in the corpus, never trusted.  labels may
    be empty or hold nulls, repeats and unknown ids; with nothing trusted all
    scores are 0.  Empty docs give an empty result.  Names that begin with two
    underscores are taken.
    """
    shared.small_batches(docs.sparkSession)
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    ratios = F.from_json(F.lit(log_ratios(docs, trusted_ids(labels))), "array<double>")
    df = _with_grams(base_counts(docs))
    total = F.aggregate("__g", F.lit(0.0), lambda acc, h: acc + F.get(ratios, _bucket(h)))
    df = df.withColumn("score", F.when(F.size("__g") > 0, F.round(total / F.size("__g"), 9))).drop("__g")
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(True)))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with their columns.

    The verdict stands below a column that isn't deterministic, so Spark can't
    push the filter down to the scan, where it would write out the whole
    verdict again for each of its parts.
    """
    judged = judge(docs, labels, threshold).withColumn("__row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__row") >= 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
