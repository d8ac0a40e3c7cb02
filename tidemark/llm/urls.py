"""URL filters: allow and block rules by host and path, and for the rest a linear model on hashed character n-grams.

All of it is Spark SQL functions; the model is fitted by full-batch gradient
steps, all in one job, over a small labelled table gathered in one row, and
held as an array of DIMENSIONS weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shared

DIMENSIONS = 4096
GRAMS = (3, 4)
STEPS = 25
RIDGE = 1.0
#: Labelled URLs that the model is fitted on, at most: those with the least hashes.
MOST_LABELLED = 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with ``host`` and ``path`` of a URL column."""
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def matched_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest of rules (verdict, 'host/path') that fits columns host and path; null if none does.

    A rule fits its host and all subdomains where the path starts with the
    rule's.  Of equally long rules the first in the alphabet wins.  Meant for
    a list of hand-written rules: each is a condition on the row.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, pattern in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]], r[0])):
        name, _, path = pattern.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))) & F.startswith(F.col("path"), F.lit(f"/{path}"))
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(mark: str, text: str, n: int) -> Column:
    """Buckets of a column's n-grams, from 1."""
    last = F.length(text) - (n - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: (F.pmod(F.xxhash64(F.lit(mark), F.substr(F.col(text), i, F.lit(n))), F.lit(DIMENSIONS - 1)) + 1).cast("int"))


def _features(df: DataFrame) -> DataFrame:
    """df(host, path) with __x: distinct buckets of the n-grams of both, and bucket 0 for every row."""
    df = df.withColumns({f"__{c}": F.concat(F.lit("^"), F.col(c), F.lit("$")) for c in ("host", "path")})
    every = [F.array(F.lit(0)), *(_grams(mark, text, n) for mark, text in (("h", "__host"), ("p", "__path")) for n in GRAMS)]
    return df.withColumn("__x", F.array_distinct(F.concat(*every))).drop("__host", "__path")


def _margin(weights: str) -> Column:
    w = F.from_json(F.lit(weights), "array<double>")
    return F.aggregate("__x", F.lit(0.0), lambda acc, i: acc + F.get(w, i))


def fit(labelled: DataFrame, steps: int = STEPS, ridge: float = RIDGE, most: int = MOST_LABELLED) -> str:
    """JSON array of weights from labelled(host, path, label): label 1 blocks, 0 allows.

    Repeated (host, path, label) count once; rows with nulls are left out;
    beyond ``most`` rows those with the least hashes are taken.  A step moves
    each weight by its gradient over a bound of the curvature, so the loss
    never grows.  Without rows of both labels all weights are 0.
    """
    rows = labelled.select("host", "path", F.col("label").cast("double").alias("y")).where("host is not null and path is not null and y is not null").distinct()
    rows = rows.withColumn("h", F.xxhash64("host", "path")).orderBy("h", "host", "path", "y").limit(most)
    rows = _features(rows.withColumn("at", F.row_number().over(Window.orderBy("h", "host", "path", "y")) - 1)).select("at", "__x", "y")
    # for each bucket, the rows that have it and a bound of the curvature
    held = rows.select("at", F.explode("__x").alias("i"), F.size("__x").alias("f")).groupBy("i")
    held = held.agg(F.array_sort(F.collect_list("at")).alias("at"), (0.25 * F.sum("f") + ridge).alias("bound")).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("at", "bound")))).alias("held"))
    other = F.struct(F.array().cast("array<int>").alias("at"), F.lit(ridge).alias("bound"))
    held = held.select(F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), other)).alias("held"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("at", "__x", "y"))).alias("rows"))
    both = rows.unionByName(held, allowMissingColumns=True).agg(F.first("rows", ignorenulls=True).alias("rows"), F.first("held", ignorenulls=True).alias("held"))
    # written, as an expression that a lambda names would be worked out at each of its calls
    sample = shared.materialise(both, "labelled-urls")

    def stepped(w: Column, _: Column) -> Column:
        missed = F.transform("rows", lambda r: r["y"] - 1 / (1 + F.exp(-F.aggregate(r["__x"], F.lit(0.0), lambda acc, i: acc + F.get(w, i)))))
        moved = lambda m: F.zip_with(w, "held", lambda v, b: v + (F.aggregate(b["at"], F.lit(0.0), lambda acc, at: acc + F.get(m, at)) - ridge * v) / b["bound"])
        # an array of one, so that what is missed is worked out once a step
        return F.get(F.transform(F.array(missed), moved), 0)

    zeros = F.array_repeat(F.lit(0.0), DIMENSIONS)
    learnt = F.size(F.array_distinct(F.transform("rows", lambda r: r["y"]))) > 1
    steady = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zeros, stepped)
    return sample.select(F.to_json(F.when(learnt, steady).otherwise(zeros))).first()[0]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score.

    Every row comes out once with all its columns; columns of the new names
    are replaced.  A URL that is null or has no :// has empty host and path.
    ``verdict`` is the rule's if one fits, else block if the model's log odds
    (``score``) are above 0, else allow.  labelled(host, path, label) trains
    the model; by default the pages that rules decide do, as a small labelled
    table of at most MOST_LABELLED.  Without labels of both kinds the model
    allows everything.  Repeated rows are judged alike; an empty table gives
    an empty result.
    """
    new = {"host", "path", "rule", "verdict", "score"}
    names = [c for c in pages.columns if c not in new]
    rule, verdict = matched_rule(rules)
    parted = parts(pages.select(*(F.col(f"`{c}`") for c in names)), url)
    judged = parted.withColumns({"rule": rule, "__verdict": verdict})
    if labelled is None:
        labelled = judged.where(F.col("rule").isNotNull()).select("host", "path", (F.col("__verdict") == "block").cast("int").alias("label"))
    weights = fit(labelled)
    scored = _features(judged).withColumn("score", F.round(_margin(weights), 6))
    model = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*(F.col(f"`{c}`") for c in names), "host", "path", "rule", F.coalesce("__verdict", model).alias("verdict"), "score")
