"""Substring deduplication, the Jaccard join and sharding against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import jaccard, sharding, substring
from tickloom.llm.catalog import QUERIES
from tickloom.llm.shared import components
from tickloom.llm.wordhash import Words, sliding_min


def repeats(texts, window=50):
    """doc_id: (n_words, words that stay), each window judged against smaller ids."""
    words = [(i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def groups(texts, n=5):
    sets = {i: frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) for i, t in texts if (w := (t or "").encode().split())}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    root, links = {i: i for i, _ in texts}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in inverted[x]).items():
            if i != j and 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i, _ in texts}


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_substring_query_matches_brute_force(spark, folder, texts):
    got = collected(QUERIES["op2_substring_dedup"](spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in repeats(texts)), key=str)


def test_substring_edge_cases(nasty, empty):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    assert collected(substring.remove_repeats(nasty), "doc_id", "n_words", "n_removed", "kept_text") == repeats(rows)
    assert substring.remove_repeats(empty).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=8))
def test_substring_of_few_distinct_words(spark, docs):
    """Small alphabets make anchors tie and windows overlap themselves."""
    texts = [(i, " ".join("abc"[x] for x in d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert collected(substring.remove_repeats(df, window=6, anchor=3), "doc_id", "n_words", "n_removed", "kept_text") == repeats(texts, 6)


def test_factors_name_an_earlier_source(nasty):
    found = substring.factors(nasty).collect()
    assert found and all(r["source_id"] < r["doc_id"] and r["n_words"] >= 50 for r in found)
    assert {r["kind"] for r in found} == {"block", "edge"}


def check_parse(texts, found, window):
    """Factors are true copies, do not overlap, cover just the repeated words, and each is the longest the indexed matches allow."""
    words = {i: t.split() for i, t in texts}
    first = {}
    for i, t in sorted(texts):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    parses = defaultdict(list)
    for r in found:
        parses[r["doc_id"]].append(r)
    for i, w in words.items():
        copied = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                copied.update(range(k, k + window))
        done, seen = 0, set()
        for f in sorted(parses.pop(i, []), key=lambda f: f["parse_start"]):
            start, end, source = f["start"], f["start"] + f["n_words"], words[f["source_id"]]
            assert f["source_id"] < i and f["n_words"] >= window
            assert w[start:end] == source[f["source_start"] : f["source_start"] + f["n_words"]]
            assert f["parse_start"] == max(start, done) and f["parse_start"] < end
            seen.update(range(f["parse_start"], end))
            if end not in copied:  # at the end of a span no earlier document goes on
                longer = tuple(w[end - window + 1 : end + 1])
                assert len(longer) < window or first[longer] == i
            done = end
        assert seen == copied
    assert not parses


def test_parse_of_long_copies(spark):
    """A copy of one document is one factor, one of two overlapping documents is two, and the second is found across the boundary."""
    w = [f"w{k}" for k in range(400)]
    texts = [
        (1, " ".join(w[:200])), (2, " ".join(w[150:400])), (3, " ".join(["n1", *w[20:180], "n2"])),
        (4, " ".join(["o1", *w[100:300], "o2"])), (5, " ".join(["p1", *w[100:300], "p2", *w[:60]])),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = substring.factors(df).collect()
    check_parse(texts, found, 50)
    by_doc = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["doc_id"], r["parse_start"])):
        by_doc[r["doc_id"]].append((r["start"], r["n_words"], r["parse_start"], r["source_id"], r["source_start"]))
    assert by_doc[2] == [(0, 50, 0, 1, 150)]
    assert by_doc[3] == [(1, 160, 1, 1, 20)]
    assert by_doc[4][0] == (1, 100, 1, 1, 100)
    assert [f[2] for f in by_doc[4]][1] == 101 and by_doc[4][-1][3] == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=8))
def test_parse_of_few_distinct_words(spark, docs):
    texts = [(i, " ".join("abc"[x] for x in d)) for i, d in enumerate(docs)]
    found = substring.factors(spark.createDataFrame(texts, "doc_id long, text string"), window=6, anchor=3).collect()
    check_parse(texts, found, 6)


def plain_parse(matches):
    """Word by word: at each uncovered word the match that holds it and ends last."""
    out, at, stop = [], 0, max((e for _, e in matches), default=0)
    while at < stop:
        here = [k for k, (s, e) in enumerate(matches) if s <= at < e]
        if not here:
            at += 1
            continue
        best = max(here, key=lambda k: (matches[k][1], -k))
        out.append((best, at))
        at = matches[best][1]
    return out


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=12))
def test_greedy_is_the_longest_match_at_every_word(spans):
    matches = sorted((s, s + n) for s, n in spans)
    assert substring._greedy([s for s, _ in matches], [e for _, e in matches]) == plain_parse(matches)


def test_rows_that_share_an_id_are_parsed_by_their_own_text(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    texts = [(1, a), (2, b), (2, a), (2, a), (2, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert collected(substring.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_text") == repeats(texts)


def test_jaccard_query_matches_brute_force(spark, folder, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op5_jaccard_join"](spark, folder).collect()}
    assert got == groups(texts)


def test_jaccard_edge_cases(nasty, empty):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_groups(nasty).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 1), 8: (7, 1), 9: (9, 1), 10: (9, 1)}
    assert jaccard.similarity_groups(empty).count() == 0
    kept = jaccard.one_of_each(nasty)
    assert kept.columns == nasty.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 4, 5, 6, 7, 9, None, None]
    assert jaccard.one_of_each(empty).count() == 0


def test_large_component_is_compared_by_blocks(spark, monkeypatch):
    """More near copies than one block holds: links are those of brute force."""
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 + 1 :])) for i in range(90)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == groups(texts)


def test_blocks_without_documents(spark, monkeypatch):
    """Pairs and threes of long near copies in as many blocks as documents, some of them empty: a link counts once."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    texts = [(10 * g + k, " ".join([f"w{g}x{i}" for i in range(300)] + [f"end{k}"])) for g in range(8) for k in range(2 + g % 2)]
    got = jaccard.similarity_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == groups(texts)


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.95), (0.5, 0.9)):
        bands, rows = jaccard.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.MAX_HASHES
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.05, 0.99999)


def test_sliding_min():
    x = np.arange(50, dtype=np.uint64)[::-1] * np.uint64(7) % np.uint64(31)
    for width in (1, 2, 5, 41):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_words_split_at_six_spaces_only():
    w = Words([b"a\x0b b\x1cc\xc2\xa0d ", b"", b"  e"])
    assert w.counts.tolist() == [2, 0, 1] and w.first.tolist() == [0, 2, 2, 3]


def test_shards_divide_bytes(spark, folder):
    rows = QUERIES["op1_kd_sharding"](spark, folder).collect()
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(source)
    slots, size = defaultdict(list), Counter()
    import zlib

    for r in rows:
        raw = source[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # a split is off by half a row at most, and errors of the levels add up
    assert max(abs(s - sum(size.values()) / 40) for s in size.values()) <= 2 * max(r["size"] for r in rows)


def test_equal_rows_are_split_evenly_by_their_ids(spark):
    rows = [(i, "same text", "en", "hot") for i in range(4000)]
    sizes = [r["count"] for r in sharding.with_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 7).groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 4


def test_a_level_of_very_many_nodes(spark):
    """More shards than one expression could name: 6,000 of 12,000 equal texts, two rows each."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    sizes = [r["count"] for r in sharding.with_shards(docs, 6000).groupBy("shard").count().collect()]
    assert len(sizes) == 6000 and max(sizes) <= 3


def test_sharding_edge_cases(spark, nasty, empty, tmp_path):
    out = sharding.shard_slots(nasty, 3).collect()
    assert len(out) == nasty.count() and {r["shard"] for r in out} <= {0, 1, 2}
    assert {r["size"] for r in out if r["doc_id"] == 4} == {16}
    assert sharding.shard_slots(empty, 3).count() == 0
    n = sharding.write_shards(nasty, str(tmp_path / "shards"), 200_000)
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert n > 1 and again.count() == nasty.count() and again.select("shard").distinct().count() <= n


def test_a_large_component_of_stars(spark):
    """20,000 nodes with several hubs each, and a chain: labels are those of plain search; most nodes keep one edge."""
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a in range(30, 20_000) for b in rng.integers(0, 30, 4)] + [(30_000 + i, 30_001 + i) for i in range(40)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(20_000)}, **{30_000 + i: 30_000 for i in range(41)}}


def test_components_equal_search(spark):
    rng = np.random.default_rng(7)
    for n, m in ((40, 25), (300, 290), (3, 1)):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        want = {x: root[x] for a, b in edges if a != b for x in (a, b)}
        assert {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_repeated_ids_are_decided_by_their_text(spark):
    """Two texts under one id: every run compares, and keeps, the one with the smaller hash."""
    lorem = " ".join(f"w{i}" for i in range(60))
    rows = [(1, lorem, "x"), (1, "quite another text of some words here", "y"), (2, lorem, "z")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, text_hash string").repartition(2)
        chosen = docs.where("doc_id = 1").orderBy(F.xxhash64("text")).first()["text"]
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_groups(docs).collect()}
        assert got == ({1: (1, 1), 2: (1, 1)} if chosen == lorem else {1: (1, 0), 2: (2, 0)})
        kept = jaccard.one_of_each(docs)
        assert kept.columns == docs.columns and kept.where("doc_id = 1").first()["text"] == chosen
