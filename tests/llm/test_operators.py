"""Each corpus operator against a plain version, on the smallest tables and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import duck, rows
from tests.conftest import SMALL
from tests.llm import brute
from tidemark.llm import bytepair, chat, components, leaks, lines, neardup, packing, quality, queries, shared, substrings, tokenfiles, urls

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def awkward_texts():
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(n))
    base = prose(60)
    near = base.split()
    near[30] = "changed"
    return {
        1: base, 2: None, 3: "", 4: " \n\t ", 5: base, 6: " ".join(near), 7: "two words", 8: "Two  WORDS", 9: "x", 10: prose(20_000),
        11: "same line here\n" * 40, 12: f"intro {base[:200]}\n{prose(30)}", 13: "é ü 中文 😀 " * 12, 14: base + "\n" + prose(25), 15: "a" * 30_000,
    }


def frame(spark, values, **extra):
    """documents with extra columns, two of which have names that operators use."""
    data = [(i, t, "en", 1, True) for i, t in values.items()]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n_words int, kept boolean")


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, awkward_texts())


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_words int, kept boolean")


def keyed(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


# 1

def test_leaks(spark, awkward, nothing):
    rng = random.Random(1)
    items = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20))) for i in range(6)]
    item = items[0][1]
    worn = item[:40] + item[42:70] + "zz" + item[70:100].upper() + item[100:]
    texts = {1: f"before {item} after", 2: worn, 3: item[:60], 4: None, 5: "", 6: item.replace(" ", "\n  "), 7: items[1][1] + " " + items[2][1], 8: "long " * 30_000 + item}
    benchmark = spark.createDataFrame([*items, (None, items[3][1]), (9, None), (10, ""), (11, "short item"), (12, item)], "item_id long, text string")
    found = {k: v for k, (v,) in keyed(leaks.find_leaks(frame(spark, texts), benchmark), "leaks").items()}
    ids = {k: [x["item_id"] for x in v] for k, v in found.items()}
    assert ids == {1: [0, 12], 2: [0, 12], 3: [], 4: [], 5: [], 6: [0, 12], 7: [1, 2], 8: [0, 12]}
    assert [x["distance"] for x in found[1]] == [0, 0] and found[2][0]["distance"] == brute.edit_distance_within(leaks.normalise(item), leaks.normalise(worn))
    for table in (awkward, nothing):
        assert leaks.find_leaks(table, benchmark.limit(0)).where(F.size("leaks") > 0).count() == 0
    out = leaks.find_leaks(awkward, benchmark)
    assert out.columns == [*awkward.columns, "leaks"] and out.count() == awkward.count()


def test_leaks_in_several_passes(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20))) for i in range(8)]
    monkeypatch.setattr(leaks, "PASS_CHARS", 300)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = frame(spark, {i: t for i, t in items})
    assert {k: [x["item_id"] for x in v] for k, (v,) in keyed(leaks.find_leaks(texts, benchmark), "leaks").items()} == {i: [i] for i, _ in items}


def test_short_items_are_found_as_words(spark):
    benchmark = spark.createDataFrame([(1, "What is the capital?"), (2, "moby-dick"), (3, "Who wrote"), (4, "x" * 31), (5, "-")], "item_id long, text string")
    values = {1: "Tell me: what  is the\nCapital? Now.", 2: "MOBY-DICKENS", 3: "who wrote Moby-Dick", 4: "whowrote, Who wroten", 5: "y" + "x" * 31, 6: "the end " + "x" * 31, 7: "a - b"}
    found = {k: [(x["item_id"], x["distance"]) for x in v] for k, (v,) in keyed(leaks.find_leaks(frame(spark, values), benchmark), "leaks").items()}
    assert found == {1: [(1, 0)], 2: [(5, 0)], 3: [(2, 0), (3, 0), (5, 0)], 4: [], 5: [], 6: [(4, 0)], 7: [(5, 0)]}


def test_leaks_query(spark, docs):
    """Every item against every whole text, by the distance alone."""
    out = keyed(queries.op1_benchmark_decontamination(spark, SMALL), "n_items", "item_ids", "least_distance", "kept")
    items = [(r["item_id"], leaks.normalise(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(out) == set(docs)
    for i, t in docs.items():
        text = leaks.normalise(t)
        held = {k: d[0] for k, item in items if (d := leaks.myers(item, text, leaks.budget(len(item)))) is not None}
        assert out[i] == (len(held), sorted(held), min(held.values(), default=None), not held)


# 2

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def xx(data, seed=42):
    value = xxhash.xxh64_intdigest(data if isinstance(data, bytes) else (data & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1)
    return value - (1 << 64) if value >> 63 else value


def grams(text):
    import regex

    tokens = [xx(t.encode()) for t in regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0d]+", (text or "").lower())]
    return [h % quality.BUCKETS for h in [*tokens, *((a << 1 & (1 << 64) - 1) ^ (b & (1 << 64) - 1) for a, b in zip(tokens, tokens[1:], strict=False))]]


def test_quality_query(spark, docs):
    out = keyed(queries.op2_quality_rules(spark, SMALL), *NAMES, "score", "kept")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    raw, target = Counter(), Counter()
    for i, t in docs.items():
        raw.update(grams(t))
        target.update(grams(t) if i in trusted else [])
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    for i, t in docs.items():
        assert out[i][:6] == brute.base_counts(t)
        g = grams(t)
        score = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in g) / len(g)
        assert out[i][6] == pytest.approx(score, abs=1e-6)
        assert out[i][7] == (not out[i][5] and score >= quality.THRESHOLD)


def test_quality_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (99, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    both = awkward.unionByName(spark.createDataFrame([(None, "a null id " * 10, "en", 0, True), (1, awkward_texts()[1], "en", 0, False)], awkward.schema))
    out = quality.judge(both, labels)
    assert out.count() == 17
    for r in out.where("doc_id is not null").collect():
        assert tuple(r[n] for n in NAMES) == brute.base_counts(awkward_texts()[r["doc_id"]])
    assert not out.where("doc_id = 2").first()["kept"]
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(awkward, labels.limit(0)).where("score <> 0").count() == 0


def test_quality_is_native(spark):
    plan = queries.op2_quality_rules(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


# 3 and 4

def test_token_counts_query(spark, docs):
    from tidemark.llm.encode import encoder

    library = encoder(PATH).library
    out = keyed(queries.op3_token_counts(spark, SMALL), "n_bytes", "n_tokens", "over_limit")
    for i, t in docs.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert out[i] == (len((t or "").encode()), n, n > 1024)


def test_token_counts_on_awkward_rows(spark, awkward, nothing):
    out = keyed(bytepair.count_tokens(awkward, PATH), "n_bytes", "n_tokens", "lang")
    assert out[2] == (0, 0, "en") and out[3] == (0, 0, "en") and out[15][0] == 30_000
    assert bytepair.count_tokens(nothing, PATH).count() == 0
    assert bytepair.count_tokens(awkward.unionByName(awkward), PATH).count() == 30


def test_token_files_query(spark, docs):
    from tidemark.llm.encode import encoder

    library = encoder(PATH).library
    out, start = keyed(queries.op4_token_files(spark, SMALL), "start", "n_tokens", "ids_crc32"), 0
    for i in sorted(docs):
        ids = [*library.encode(docs[i] or "", add_special_tokens=False).ids, 0]
        assert out[i] == (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)


def test_token_files_are_searched_and_small_shards_agree(spark, awkward, nothing):
    files = tokenfiles.write_tokens(awkward, PATH, 0, shard_tokens=500)
    assert files.index.count() >= 5
    assert files.count_ids([0]).first()["n"] == 15
    whole = tokenfiles.write_tokens(awkward, PATH, 0)
    assert rows(files.documents().toPandas()) == rows(whole.documents().toPandas())
    ends = files.find_id(0).toPandas()
    assert sorted(ends["doc_id"]) == sorted(awkward_texts()) and (ends.set_index("doc_id")["place"] + 1).to_dict() == {r["doc_id"]: r["n_tokens"] for r in whole.documents().collect()}
    assert tokenfiles.write_tokens(nothing, PATH, 0).documents().count() == 0
    odd = spark.createDataFrame([(None, "b"), (5, "x"), (5, "x"), (5, None)], "doc_id long, text string")
    found = tokenfiles.write_tokens(odd, PATH, 0).documents().orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in found] == [(None, 2), (5, 1), (5, 2), (5, 2)]


# 5

def test_packing_query_places_everything(spark, docs):
    out = queries.op5_best_fit_packing(spark, SMALL).toPandas()
    from tidemark.llm.encode import encoder

    library = encoder(PATH).library
    sizes = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    for (_, _), own in out.groupby(["shard", "bin"]):
        own = own.sort_values("bin_offset")
        ends = (own["bin_offset"] + own["n_tokens"]).tolist()
        assert own["bin_offset"].tolist() == [0, *ends[:-1]]
        assert own["bin_length"].iloc[0] == next(c for c in packing.CAPACITIES if c >= ends[-1])


def test_packing_on_awkward_rows(spark):
    lengths = spark.createDataFrame([(1, 100, 5), (1, 100, 5), (2, 0, 5), (3, None, 5), (None, 7, 5), (4, 5000, 5)], "doc_id long, n_tokens long, bin int")
    out = packing.pack_documents(lengths, (64, 128), shard_docs=10)
    got = out.toPandas()
    assert len(got) == 5 + 40 and got["n_tokens"].sum() == 5207 and got["bin"].isna().sum() == 2
    assert packing.pack_documents(lengths.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(lengths, ())


# 6

def test_substrings_query(spark, docs):
    out = keyed(queries.op6_substring_dedup(spark, SMALL), "n_words", "n_removed", "kept_sha256")
    assert out == brute.removed_windows(docs)


def test_substrings_on_awkward_rows(spark, awkward, nothing):
    values = awkward_texts()
    assert keyed(substrings.remove_repeats(awkward), "n_words", "n_removed", "kept_sha256") == brute.removed_windows(values)
    assert substrings.remove_repeats(nothing).count() == 0
    # equal rows are one document; another text of its id follows
    again = spark.createDataFrame([(1, values[1]), (1, values[1]), (1, values[14]), (None, values[1])], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(again).collect())
    assert out[0] == (0, 60, 0) and out[1:3] == [(1, 60, 60)] * 2 and out[3][:2] == (1, 85) and out[3][2] >= 60


def test_substrings_in_hot_groups(spark):
    rng = random.Random(3)
    passage = [f"w{rng.randint(0, 10**6)}" for _ in range(30)]
    values = {i: " ".join([f"a{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 25))] + passage + [f"b{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 25))]) for i in range(300)}
    assert keyed(substrings.remove_repeats(frame(spark, values)), "n_words", "n_removed", "kept_sha256") == brute.removed_windows(values)


# 7

def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "http://": ("", "", None), "HTTP://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7"),
        "https://x.net/de/": ("x.net", "/de/", "net/de/"), "https://x.example.net/de/81": ("x.example.net", "/de/81", "example.net/de/8"), "http://net/de/1": ("net", "/de/1", "net/de/"),
        "http://internet/de/1": ("internet", "/de/1", None), "a://b://c": ("b:", "//c", None), "x://h?a/b": ("h", "", None), "x://h#a": ("h", "", None), "x://ÄB.org/es/": ("Äb.org", "/es/", "org/es/"),
        "": ("", "", None), "x://" + "h" * 3000 + "/p": ("h" * 3000, "/p", None),
    }
    pages = spark.createDataFrame([(i, u, "mine", "x") for i, u in enumerate(cases)], "page_id long, url string, host string, note string")
    out = {r["url"]: r for r in urls.filter_urls(pages, queries.RULES, queries.labelled_urls(spark)).collect()}
    for u, (host, path, rule) in cases.items():
        assert (out[u]["host"], out[u]["path"], out[u]["rule"], out[u]["note"]) == (host, path, rule, "x")
    assert {r: out[u]["verdict"] for u, (_, _, r) in cases.items() if r} == {p: k for k, p in queries.RULES if p != "com/en/"}
    assert urls.filter_urls(pages.limit(0), queries.RULES, queries.labelled_urls(spark)).count() == 0
    assert urls.filter_urls(pages, [], queries.labelled_urls(spark).limit(0)).where("verdict <> 'allow'").count() == 0


def test_url_model_on_held_out_pages(spark):
    pages = queries.op7_url_filters(spark, SMALL.replace("0.001", "0.01")).where("rule is null").toPandas()
    bad = pages["host"].str.contains("casino|pills|spam|adult|bets|ads-")
    assert (pages.loc[bad, "verdict"] == "block").mean() >= 0.9
    assert (pages.loc[~bad, "verdict"] == "allow").mean() >= 0.97
    plan = queries.op7_url_filters(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


# 8

def test_rotation_query(spark):
    found = queries.op8_perspective_rotation(spark, SMALL).toPandas()
    expected = duck(SMALL).execute(chat.ORACLE_SQL).fetchdf()
    assert rows(found) == rows(expected)


def test_rotation_on_awkward_rows(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "cy", ""), (1, 3, None, "who"), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, 5000, "ann", "late"), (3, 1, "bob", "early")]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("mine"))
    out = chat.rotate(talk).toPandas()
    assert set(zip(out["conv_id"].fillna(-1), out["perspective"], strict=True)) == {(1, "ann"), (1, "bob"), (1, "cy"), (-1, "ann"), (3, "ann"), (3, "bob")}
    for _, own in out.groupby(["conv_id", "perspective"], dropna=False):
        own = own.sort_values("char_start")
        whole = "".join(own["rendered"])
        assert own["seat"].tolist() == list(range(len(own)))
        for r in own.itertuples():
            assert whole[r.char_start : r.char_start + len(r.rendered)] == r.rendered
            assert (r.role == "assistant") == (r.mask_start == r.mask_start)
            if r.role == "assistant":
                assert whole[int(r.mask_start) : int(r.mask_end)].endswith(chat.CLOSE)
    mine = out[(out["conv_id"] == 1) & (out["perspective"] == "ann")].sort_values("char_start")
    assert mine["role"].tolist() == ["user", "system", "assistant", "user", "user", "user"] and mine["name"].tolist()[0] == "cy"
    assert chat.rotate(talk.limit(0)).count() == 0


# 9

def test_lines_query(spark, docs):
    out = keyed(queries.op9_fuzzy_line_dedup(spark, SMALL), "n_lines", "removed_lines", "kept_sha256")
    gone = brute.removed_lines(docs)
    for i, t in docs.items():
        own = (t or "").split("\n")
        rest = "\n".join(x for k, x in enumerate(own) if k not in gone[i])
        assert out[i] == (sum(bool(brute.words(x)) for x in own), gone[i], hashlib.sha256(rest.encode()).hexdigest())


def test_lines_behind_other_centres(spark):
    """Template lines, none similar to another but a twin in the other task; both lie behind less similar lines in every band."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    values = {}
    for family in range(20):
        base = "".join(rng.choice(letters) for _ in range(200))
        for slot in range(10):
            # 11 of 196 runs change: 174 of 218 are common to two lines, 177 of 215 to twins
            for task, at in ((0, 19 * slot + 4), (1, 19 * slot + 12)):
                values[1000 * task + 10 * family + slot] = base[:at] + "".join(rng.choice("0123456789") for _ in range(7)) + base[at + 7 :]
    docs = frame(spark, values).repartitionByRange(2, "doc_id")
    out = keyed(lines.dedup_lines(docs), "removed_lines")
    assert {i: list(v[0]) for i, v in out.items()} == brute.removed_lines(values)


def test_profiles_refuse_no_similar_pair():
    """Sizes and profiles leave every pair at the threshold, of short, long and repeating sets alike."""
    rng = np.random.default_rng(9)
    refused = 0
    for size in [*range(1, 40), 100, 500, 3000, 40_000]:
        for _ in range(20):
            union = rng.integers(0, 1 << 63, size).astype(np.uint64)
            n = -(-4 * size // 5)
            a, b = union[: n + (size - n) // 2], np.concatenate([union[:n], union[n + (size - n) // 2 :], union[:3]])
            s, p = lines.profiles(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
            assert lines.possible(s[:1], s[1:], p[:1], p[1:], 0.8).all()
            other = rng.integers(0, 1 << 63, size).astype(np.uint64)
            s, p = lines.profiles(np.repeat([0, 1], size), np.concatenate([union, other]), 2)
            refused += not lines.possible(s[:1], s[1:], p[:1], p[1:], 0.8)[0]
    assert refused > 600


def test_line_keys_hash_each_block_once(monkeypatch):
    """However many lines a block has, its runs are hashed once, and a line that comes again in its task not at all; a line's hashes and keys are those that it has alone."""
    import pyarrow as pa

    own = [f"{'é' * (k % 3)}{k} {'word ' * (k % 7)}{k * k}" for k in range(5000)] + ["x", "中文", "  Padded Line \t"]
    column = pa.array(["", own[0], None, "\n".join(own[1:2600]), " \n", "\n".join(own[2600:])])
    calls, real = [], lines.Lines.shingles
    monkeypatch.setattr(lines.Lines, "shingles", lambda self, use: calls.append(len(use)) or real(self, use))
    # the second batch has the first's lines again
    parts = list(lines._keys(iter([pa.RecordBatch.from_arrays([column], names=["text"])] * 2)))
    assert sum(calls) == len(own) and len(calls) <= 2
    got = dict(zip(np.concatenate([n for _, n in parts])[:: lines.BANDS].tolist(), np.concatenate([k for k, _ in parts]).reshape(-1, lines.BANDS).tolist(), strict=True))
    assert len(got) == len(own)
    whole = lines.Lines(next(lines.tb.blocks(column)))
    for k in [*range(0, 5000, 250), 5000, 5001, 5002]:
        alone = lines.Lines(next(lines.tb.blocks(pa.array([own[k]]))))
        assert (alone.node[0], alone.check[0]) == (whole.node[k], whole.check[k])
        assert got[alone.node[0]] == lines.band_keys(lines.signatures(*real(alone, np.arange(1)), 1))[0].tolist()


def test_lines_on_awkward_rows(spark, awkward, nothing):
    values = awkward_texts()
    out = keyed(lines.dedup_lines(awkward), "removed_lines", "text", "lang")
    gone = brute.removed_lines(values)
    assert {i: o[0] for i, o in out.items()} == gone
    assert out[2][1] is None and out[3][1] == "" and out[4][1] == " \n\t " and out[5][1] == ""
    assert lines.dedup_lines(nothing).count() == 0
    same = spark.createDataFrame([(1, "a line of words"), (1, "a line of words"), (None, "A line of  words"), (2, "A LINE of words")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in lines.dedup_lines(same).collect())
    assert got[0] == (0, 0) and got[-1] == (2, 1)


# 10

def test_near_duplicates_query(spark, docs):
    out = keyed(queries.op10_hyperminhash_near_dedup(spark, SMALL), "n_shingles", "component_id", "kept")
    assert out == {i: (n, c, c == i) for i, (n, c) in brute.near_components(docs).items()}


def test_near_duplicates_on_awkward_rows(spark, awkward, nothing):
    out = keyed(neardup.near_duplicates(awkward), "n_shingles", "component_id", "kept")
    assert out == {i: (n, c, c == i) for i, (n, c) in brute.near_components(awkward_texts()).items()}
    assert neardup.near_duplicates(nothing).count() == 0
    six = "one two three four five six"
    odd = spark.createDataFrame([(None, six), (3, six), (3, six), (None, "seven eight nine"), (None, "seven eight nine"), (4, None), (4, None), (None, None), (3, "another text"), (7, "Another text")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(odd).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True), (3, 3, True), (3, 3, True), (4, 4, True), (4, 4, True), (7, 3, False)]
    rest = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.drop_near(odd).collect())
    assert rest == [(0, ""), (0, "seven eight nine"), (3, "another text"), (3, six), (4, "")]


@pytest.mark.parametrize("work", [0, 20_000_000])
def test_near_duplicates_in_a_hot_group(spark, monkeypatch, work):
    """Copies of one text with edits around the threshold, some linked to few others: blocks compare them all."""
    from tidemark.llm import bands

    monkeypatch.setattr(bands, "WORK", work)
    monkeypatch.setattr(bands, "LISTED", 50)
    monkeypatch.setattr(bands, "BLOCK", 64)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    values = {}
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = f"x{rng.randint(0, 10**9)}"
        values[i] = " ".join(w)
    out = keyed(neardup.near_duplicates(frame(spark, values)), "n_shingles", "component_id")
    assert out == brute.near_components(values)


@pytest.mark.parametrize("tasks", [1, 40])
def test_components(spark, monkeypatch, tasks):
    """Links in one task, and in so many tasks that rounds settle nearly all."""
    monkeypatch.setattr(components, "HELD", 20)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(500, i) for i in range(501, 700)] + [(7, 7), (None, 3)]
    edges += [(2000, i) for i in range(1000, 1200)] + [(i, i + 1) for i in rng.sample(range(3000, 3300), 300)]
    groups = brute.Union()
    for a, b in edges:
        if a is not None and a != b:
            groups.link(a, b)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    none = components.components(spark.createDataFrame([], "a long, b long")).count()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {x: groups.find(x) for x in list(groups)} and none == 0


def test_joins_of_hot_keys(spark, monkeypatch):
    """Keys apart and together, with and without a partner, inner and left."""
    monkeypatch.setattr(shared, "LEAST_HOT", 10)
    left = spark.sql("SELECT id, CASE WHEN id < 400 THEN 1 WHEN id < 700 THEN 2 ELSE id END AS k FROM range(900)")
    right = spark.sql("SELECT id AS k, id * 10 AS v FROM range(1, 900) WHERE id <> 2")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        out = shared.spread_join(left, right, ["k"], counts, how)
        assert sorted(map(tuple, out.select("id", "k", "v").collect())) == sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()))


@pytest.mark.parametrize("least, most", [(8, 12), (12, 40), (40, 300)])
def test_bands_find_similar_lines(least, most):
    """Of lines just above the threshold a band finds at least 0.99, of very short ones 0.95."""
    import pyarrow as pa

    rng = random.Random(least)
    letters = "abcdefghijklmnopqrstuvwxyz "
    found = tried = 0
    while tried < 400:
        a = "".join(rng.choice(letters) for _ in range(rng.randint(least, most))).strip()
        b = a[: rng.randint(len(a) - 3, len(a))] if least < 12 else a
        for _ in range(0 if least < 12 else rng.randint(1, max(1, len(a) // 40))):
            at = rng.randrange(len(b))
            b = b[:at] + rng.choice(letters) + b[at + 1 :]
        x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
        if a.strip() == b.strip() or b != b.strip() or not 0.8 <= len(x & y) / len(x | y) <= 0.9:
            continue
        tried += 1
        keys = []
        for block in lines.tb.blocks(pa.array([a, b])):
            own = lines.Lines(block)
            keys.append(lines.band_keys(lines.signatures(*own.shingles(np.arange(2)), 2)))
        found += bool((keys[0][0] == keys[0][1]).any())
    assert found >= (0.95 if least < 12 else 0.99) * tried
