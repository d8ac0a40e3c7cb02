"""The queries of the corpus operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytepair, chat, leaks, lines, neardup, packing, quality, shared, substrings, tokenfiles, urls

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("leaks.item_id")
    return found.select("doc_id", F.size("leaks").cast("long").alias("n_items"), items.alias("item_ids"), F.array_min("leaks.distance").alias("least_distance"), (F.size("leaks") == 0).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = bytepair.count_tokens(docs, public_tokenizers.path(VOCABULARY))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=0)
    return files.documents()


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = bytepair.count_tokens(docs, public_tokenizers.path(VOCABULARY))
    # one more for the end of each document
    lengths = shared.materialise(counts.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens")), "lengths")
    return packing.pack_documents(lengths)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


#: The rules of the query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


#: The labelled URLs of the query, by hand: what to block, then what to allow.
BLOCKED_URLS = """
http://casino-royal.example.com/en/12 https://www.best-casino.example.net/de/481 http://online-casino.example.org/play https://poker-win.example.com/en/77
https://m.poker-room.example.net/fr/9 http://sports-bets.example.org/en/2210 https://bets-today.example.com/es/31 http://blog.free-bets-now.example.net/en/5
https://free-money.example.com/en/64?ref=x http://win-big.example.org/de/800 https://win-prizes.example.net/en/1 http://cheap-watches.example.com/es/72
https://cheap-meds.example.org/en/9021 http://www.cheap-loans.example.net/fr/18 http://pills-shop.example.com/en/33 https://blog.diet-pills.example.org/en/610
http://adult-video.example.net/en/414 https://www.adult-dating.example.com/de/52 http://xxx-adult.example.org/es/7 https://spam-mail.example.net/en/100
http://m.spam-links.example.com/fr/2 https://link-farm.example.org/en/3055 http://content-farm.example.net/de/46 https://ads-server.example.com/en/901
http://click-ads.example.net/es/15 https://www.ads-banner.example.org/en/27 http://track-user.example.com/en/8 https://pixel-track.example.net/fr/640
"""
ALLOWED_URLS = """
https://www.city-library.example.org/en/12 http://garden.example.com/de/481 https://blog.riverside.example.net/fr/9 http://weather.example.org/en/2210
https://m.history.example.com/es/31 http://science-news.example.net/en/5 https://recipes.example.com/en/64?ref=x http://museum.example.org/de/800
https://travel.example.net/en/1 http://blog.astronomy.example.com/es/72 https://math-help.example.org/en/9021 http://www.trains.example.net/fr/18
http://birds.example.com/en/33 https://blog.chess.example.org/en/610 http://orchestra.example.net/en/414 https://www.university.example.com/de/52
http://thehill.example.org/es/7 https://stonebridge.example.net/en/100 http://m.northern.example.com/fr/2 https://theatre.example.org/en/3055
http://oceans.example.net/de/46 https://handwriting.example.com/en/901 http://mountain.example.net/es/15 https://www.anthem.example.org/en/27
http://nations.example.com/en/8 https://motion.example.net/fr/640 http://edition.example.org/en/75 https://blog.thread.example.com/es/3310
https://m.other.example.net/en/6 http://ration.example.org/de/19 https://hothouse.example.com/fr/27 http://thorn.example.net/en/4415
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [f"('{u}', {label})" for label, listed in ((1, BLOCKED_URLS), (0, ALLOWED_URLS)) for u in listed.split()]
    return urls.parts(spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, label)")).select("host", "path", "label")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, RULES, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op10_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_benchmark_decontamination, op2_quality_rules, op3_token_counts, op4_token_files, op5_best_fit_packing,
        op6_substring_dedup, op7_url_filters, op8_perspective_rotation, op9_fuzzy_line_dedup, op10_hyperminhash_near_dedup,
    )
    return {f.__name__: f for f in every}


SUBSTRINGS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
h AS (SELECT doc_id, i, list_aggregate(list_slice(words, i, i + 19), 'string_agg', ' ') AS win FROM g),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM h),
gone AS (SELECT doc_id, list_distinct(list(j)) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE n > 1) GROUP BY 1),
k AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed, list_filter(words, lambda x, p: NOT list_contains(coalesce(gone, []), p)) AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256 FROM k
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(list_slice(words, i, i + 4), 'string_agg', ' ') AS sh FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
c AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.other = e.a),
m AS (SELECT doc_id, min(other) AS other FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.other, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.other, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; the other operators are tested against plain versions."""
    return {"op6_substring_dedup": SUBSTRINGS_SQL, "op8_perspective_rotation": chat.ORACLE_SQL, "op10_hyperminhash_near_dedup": NEAR_SQL}
