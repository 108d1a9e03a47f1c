"""Quality model, rule cascade, token counts and mixing."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import cascade, mixing, quality_model, tokens
from tickloom.llm.catalog import QUERIES
from tickloom.llm.shared import components, numbered

MODEL = "piece_bpe_32k.model"


def model_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(MODEL)


def test_quality_model_agrees_with_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op4_quality_classifier"](spark, folder)
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    wrong = [r["doc_id"] for r in rows if r["kept"] != (r["quality"] == 1)]
    assert len(rows) > 300 and len(wrong) <= 0.02 * len(rows)
    assert out.count() == 1000


def test_label_model_finds_unequal_labellers():
    """Votes drawn with known rates: the estimate finds which labeller is right how often."""
    rng = np.random.default_rng(5)
    n, k = 20_000, len(quality_model.LABELLERS)
    junk = rng.random(n) < 0.2
    right = np.linspace(0.95, 0.7, k)
    votes = np.where(rng.random((n, k)) < right, np.where(junk[:, None], 2, 1), np.where(junk[:, None], 1, 2))
    votes = np.where((votes == 2) & ~junk[:, None] & (rng.random((n, k)) < 0.9), 1, votes)
    pattern, count = np.unique(votes @ 3 ** np.arange(k), return_counts=True)
    model = quality_model.fit_labels(pattern, count.astype(float))
    assert ((model.posterior(votes) < 0.5) == junk).mean() > 0.98
    assert model.accuracies()["symbols"][0] > model.accuracies()["sentences"][0]


def test_quality_edge_cases(nasty, empty):
    out = quality_model.classify(nasty).collect()
    assert len(out) == nasty.count()
    assert all(r["kept"] for r in out if r["doc_id"] in (4, 5, 6, 7, 8))
    assert quality_model.classify(empty).count() == 0
    kept = quality_model.keep_good(nasty)
    assert kept.columns == nasty.columns and kept.where("doc_id = 4").count() == 1
    assert quality_model.keep_good(empty).count() == 0


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = Counter(zip(words, words[1:], words[2:]))
    inside = {k + d for k in range(len(words) - 2) if count[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rule_features_match_brute_force(spark, folder, texts):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op6_quality_rules"](spark, folder).collect()}
    assert got == {i: base(t) for i, t in texts}


def test_rule_edge_cases(nasty, empty):
    rows = cascade.apply_rules(nasty).collect()
    got = sorted([(r["doc_id"], *(r[c] for c in COLUMNS)) for r in rows], key=str)
    assert got == sorted([(r["doc_id"], *base(r["text"])) for r in nasty.collect()], key=str)
    assert all(r["kept"] == (r["rejected_by"] is None) for r in rows)
    assert cascade.apply_rules(empty).count() == 0


def test_cascade_verdict_does_not_depend_on_the_order(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = lambda: sorted(r["doc_id"] for r in cascade.apply_rules(docs).where("kept").collect())
    one = kept()
    monkeypatch.setattr(cascade, "sampled_order", lambda docs, chosen, *_: list(reversed(chosen)))
    assert kept() == one and 0 < len(one) < docs.count()


def test_cascade_order_is_the_same_in_every_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    orders = [cascade.sampled_order(docs.repartition(k + 1), cascade.rules(), costs=cascade.work()) for k in range(5)]
    assert all(o == orders[0] for o in orders) and sorted(orders[0]) == sorted(cascade.rules()) == sorted(cascade.work())


def test_cascade_order_follows_known_costs(spark):
    """A cheap rule of few rejections may go before a dear one of many, and what another rule rejects anyway counts no more."""
    words = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i if i % 3 else None, f"row{i} {words}") for i in range(100)], "doc_id long, text string")
    number = F.regexp_extract("text", "^row([0-9]+)", 1).cast("int")
    chosen = {"dear_half": number < 50, "cheap_tenth": number < 10, "cheap_rest": number >= 90, "inside": number < 9, "never": number < 0}
    costs = {"dear_half": F.lit(100), "cheap_tenth": F.lit(1), "cheap_rest": F.lit(2), "inside": F.lit(1), "never": F.lit(1)}
    assert cascade.sampled_order(docs, chosen, costs=costs) == ["cheap_tenth", "cheap_rest", "dear_half", "inside", "never"]
    assert cascade.sampled_order(docs, chosen) == ["dear_half", "cheap_rest", "cheap_tenth", "inside", "never"]
    assert cascade.sampled_order(docs.where("false"), chosen, costs=costs) == list(chosen)


@given(st.lists(st.tuples(st.sets(st.sampled_from("abcd")), st.integers(1, 9)), max_size=8), st.lists(st.integers(1, 50), min_size=4, max_size=4))
def test_greedy_order_takes_the_best_rule_at_every_step(cells, per_row):
    cost = dict(zip("abcd", per_row))
    rows = [frozenset(rejects) for rejects, n in cells for _ in range(n)]
    got = cascade.greedy_order([(frozenset(r), n, {k: n * cost[k] for k in "abcd"}) for r, n in cells], list("abcd"))
    for at, name in enumerate(got):
        left = [r for r in rows if not r & set(got[:at])]
        gain = lambda k: sum(k in r for r in left) / (cost[k] * (len(left) or 1))
        assert gain(name) >= max(map(gain, got[at:])) * (1 - 1e-12)


def test_cascade_order_puts_rejections_per_second_first(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    order = cascade.sampled_order(docs, cascade.rules())
    assert sorted(order) == sorted(cascade.rules())


def test_token_query_matches_the_library(spark, folder, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op7_token_counts"](spark, folder).collect()}
    assert got == {i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in texts}


@pytest.mark.parametrize("head", [0, 3, 1 << 18])
def test_token_counts_of_odd_texts(spark, head):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    odd = ["", " ", "  ", " a", "a ", "a  b", "a\n b\n\nc", "▁x ▁", "<s> hi </s><unk>", "ﬁ ² ①", "a\tb\x00c", "é é", "😀 🇩🇪", "x" * 5000, " " * 40 + "y", "a   \n", " the the the "]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100, None), (0, ""), (5, odd[5]), (5, odd[5])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), model_path(), head_types=head).collect()}
    assert got == {i: (len(t.encode()), len(sp.encode(t))) for i, t in enumerate(odd)} | {100: (0, 0)}


def test_token_edge_cases(nasty, empty):
    assert {r["doc_id"] for r in tokens.token_counts(nasty, model_path()).collect()} == {*range(1, 11), None}
    assert tokens.token_counts(empty, model_path()).count() == 0


def edf(shares, slots):
    """(source, k) of every slot by the plain rule, ties by release and then by name."""
    total, done, run = sum(shares.values()), dict.fromkeys(shares, 0), []
    for t in range(slots):
        released = [(min(-(-(done[s] + 1) * total // shares[s]), slots + 1), done[s] * total // shares[s], s) for s in shares if done[s] * total // shares[s] <= t]
        source = min(released)[2]
        run.append((source, done[source]))
        done[source] += 1
    return run


@pytest.mark.parametrize("stretch_bits", [16, 3])
@pytest.mark.parametrize("shares, slots", [
    ({"a": 41, "b": 7, "c": 1, "d": 51}, 100),
    ({"hot": 1000, **{f"s{i:03d}": 1 + i % 3 for i in range(300)}}, 700),
    ({"one": 5}, 9),
    ({"x": 3, "y": 7, "z": 11}, 64),
])
def test_schedule_is_earliest_deadline_first(spark, monkeypatch, shares, slots, stretch_bits):
    monkeypatch.setattr(mixing, "STRETCH_BITS", stretch_bits)
    total = sum(shares.values())
    rows = mixing.edf_schedule(spark.createDataFrame(list(shares.items()), "key string, share long"), total, slots).collect()
    rows.sort(key=lambda r: r["slot"])
    assert [(r["key"], r["k"]) for r in rows] == edf(shares, slots)
    assert [r["slot"] for r in rows] == list(range(slots))
    done = Counter()
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        done[r["key"]] += 1
        assert all(abs(done[x] * total - (r["slot"] + 1) * w) < total for x, w in shares.items())


def test_very_many_sources_keep_their_weights(spark):
    """100,000 sources of one block beside a hot one that has a third of all blocks: no slot is lent to anyone."""
    n, hot = 100_000, 50_000
    sources = spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("share"))
    sources = sources.unionByName(spark.createDataFrame([("hot", hot)], "key string, share long"))
    out = mixing.edf_schedule(sources, n + hot, n + hot)
    facts = out.agg(F.count("*"), F.countDistinct("slot"), F.countDistinct("key"), F.count_if((F.col("slot") < F.col("release")) | (F.col("slot") >= F.col("deadline")))).first()
    assert tuple(facts) == (n + hot, n + hot, n + 1, 0)
    at = [r["slot"] for r in out.where("key = 'hot'").orderBy("slot").select("slot").collect()]
    assert all(abs(k + 1 - (t + 1) / 3) < 1 and abs(k - t / 3) < 1 for k, t in enumerate(at))


def test_mix_query(spark, folder):
    rows = QUERIES["op8_pfair_mixing"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    at = {r["slot"]: r["source"] for r in rows}
    assert len({(r["slot"], r["source"]) for r in rows}) == len(at)


def test_mix_goes_on_until_every_source_is_used(spark):
    rows = [(i, "big") for i in range(200)] + [(1000 + i, "small") for i in range(30)] + [(2000, None), (2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    shares = spark.createDataFrame([("big", 5), ("small", 4), (None, 1)], "source string, share int")
    got = mixing.mix(docs, shares, block_rows=1).collect()
    assert Counter(r["doc_id"] for r in got if r["source"] == "big") == Counter(range(200))
    slots = sorted((r["_slot"], r["source"]) for r in got)
    assert [s for s, _ in slots] == list(range(slots[-1][0] + 1))
    done = Counter()
    for t, s in slots:
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * w) < 1 for x, w in (("big", 0.5), ("small", 0.4), (None, 0.1)))
    again = defaultdict(list)
    for r in got:
        again[r["_epoch"], r["source"]].append(r["_block"])
    assert sorted(again[0, "small"]) == list(range(30)) and sorted(again[1, "small"]) == list(range(30))


def test_mix_edge_cases(spark, nasty, empty):
    out = mixing.mix(nasty)
    assert {r["doc_id"] for r in out.collect()} == {*range(1, 11), None}
    assert mixing.mix(empty).count() == 0
    shares = {r["source"]: r["share"] for r in mixing.tempered_shares(nasty, block_rows=1).collect()}
    assert abs(sum(shares.values()) - mixing.RESOLUTION) < 9 and max(shares, key=shares.get) == "a"
    with pytest.raises(Exception, match="no share"):
        mixing.mix(nasty, spark.createDataFrame([("a", 7)], "source string, share int")).count()
    replaced = mixing.mix(nasty.withColumns({"_slot": F.lit("mine"), "share": F.lit("x")}))
    assert dict(replaced.dtypes)["_slot"] == "bigint" and replaced.where("share = 'x'").count() == nasty.count()


def test_numbers_are_gapless_in_a_hot_group(spark):
    df = spark.createDataFrame([(i, "hot" if i % 10 else None) for i in range(3000)], "id long, g string")
    rows = numbered(df, "g", ["id"], "n").collect()
    for g, size in (("hot", 2700), (None, 300)):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(size))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)] + [(300, 299), (299, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 299: 299, 300: 299}
