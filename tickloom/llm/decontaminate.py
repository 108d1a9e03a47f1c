"""Benchmark decontamination over a distributed positional inverted index.

Test items are cut into phrases (13 consecutive terms; a shorter item is one phrase). One pass counts the phrase terms
in all training texts, so that every phrase knows its rarest terms; a second pass stores postings (term, document,
position) of just those terms. Offset-adjusted postings of a phrase's two rarest terms are intersected on (document,
start, phrase) by counting, which combines before the shuffle; what is left is compared with the whole phrase. Proximity matches
work alike, on a window of the phrase's length plus a slop, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole, written

WINDOW = 13
RAREST = 2
#: A term or phrase table goes to every task only up to this size; above it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast built-in does for texts that are ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _A_Z, _a_z))


def terms(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower(text), F.lit(f"({_TERM})"), F.lit(1)), F.array().cast("array<string>"))


def n_terms(text: Column) -> Column:
    """As many as ``terms``, without making them: what ends a term does not depend on case."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, *texts: str) -> DataFrame:
    """``df``, to be broadcast if its measured rows and bytes are within the bounds."""
    size = sum((F.coalesce(F.sum(F.octet_length(t)), F.lit(0)) for t in texts), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size + 48 * n <= BROADCAST_BYTES else df


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, length): each distinct phrase of each item; items without terms have none."""
    cut = items.select(F.col(id_col).alias("item_id"), terms(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - window + 1, F.lit(1)))
    cut = cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("t"), i, window))).alias("p"))
    return cut.select("item_id", F.array_join("p", " ").alias("phrase"), F.size("p").alias("length")).distinct()


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, doc_id, text_hash, pos) of the ``wanted`` (term) in ``docs`` (doc_id, text, text_hash)."""
    each = docs.select("doc_id", "text_hash", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    return each.join(_small(wanted, "term"), "term")


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    each = docs.select(F.explode(terms(F.col("text"))).alias("term"))
    return each.join(_small(wanted, "term"), "term").groupBy("term").count()


def rarest_terms(distinct: DataFrame, counts: DataFrame, k: int = RAREST) -> DataFrame:
    """(phrase, term, offset, needed) of the k rarest places of each phrase; a term no text holds counts as 0."""
    place = distinct.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    place = place.join(counts, "term", "left")
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "term"))), 1, k)
    best = place.groupBy("phrase").agg(best.alias("best"))
    return best.select("phrase", F.size("best").alias("needed"), F.explode("best").alias("b")).select("phrase", "needed", "b.term", "b.offset")


def _candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, phrase) where the rarest terms of the phrase stand at their offsets."""
    met = index.join(_small(rare, "term", "phrase"), "term").select("doc_id", "text_hash", (F.col("pos") - F.col("offset")).alias("start"), "phrase", "needed", "offset")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset")))
    met = met.where("start >= 0").groupBy("doc_id", "text_hash", "start", "phrase").agg(bits.alias("seen"), F.max("needed").alias("needed"))
    return met.where(F.bit_count("seen") == F.col("needed")).select("doc_id", "text_hash", "start", "phrase")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).where("doc_id IS NOT NULL")


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Exact occurrences (doc_id, text_hash, start, length, item_id) of the items' phrases in whole texts.

    A row is known by its id and its text's hash, so texts that share an id are kept apart. Equal phrases of several items
    match for each. Null texts have no terms; rows without a document id are not matched.
    """
    rows = _rows(docs, id_col, text_col)
    wanted = written(phrases(items, item_col, item_text, window), "phrases")
    distinct = wanted.select("phrase").distinct()
    vocabulary = written(distinct.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "vocabulary")
    rare = written(rarest_terms(distinct, term_counts(rows, vocabulary)), "rarest")
    index = written(postings(rows, rare.select("term").distinct()), "postings")
    found = written(_candidates(index, rare), "candidates")
    per_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "phrase")).alias("c"))
    checked = rows.join(per_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", terms(F.col("text")).alias("t"), "c")
    checked = checked.select("doc_id", "text_hash", "t", F.explode("c").alias("c")).select("doc_id", "text_hash", "c.start", "c.phrase", F.array_join(F.slice("t", F.col("c.start") + 1, F.size(F.split("c.phrase", " "))), " ").alias("here"))
    return checked.where("here = phrase").select("doc_id", "text_hash", "start", "phrase").distinct().join(wanted, "phrase").select("doc_id", "text_hash", "start", "length", "item_id")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows (doc_id, text_hash, start, length, item_id) of phrase length plus ``slop`` terms that start with a phrase term and hold all terms of the phrase, in any order."""
    rows = _rows(docs, id_col, text_col)
    wanted = written(phrases(items, item_col, item_text, window), "phrases")
    distinct = wanted.select("phrase", "length").distinct()
    vocabulary = written(distinct.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "vocabulary")
    rare = rarest_terms(distinct, term_counts(rows, vocabulary), 1).select("phrase", "term")
    rare = written(rare.join(distinct, "phrase"), "rarest")
    index = written(postings(rows, rare.select("term").distinct()), "postings")
    near = index.join(_small(rare, "term", "phrase"), "term").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "phrase", "length")).alias("c"))
    opened = rows.join(near, ["doc_id", "text_hash"]).select("doc_id", "text_hash", terms(F.col("text")).alias("t"), F.explode("c").alias("c"))
    span = F.col("c.length") + slop
    first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("c.pos") - span + 1), F.col("c.pos"))).alias("start")
    tried = opened.select("doc_id", "text_hash", "t", F.col("c.phrase").alias("phrase"), F.split("c.phrase", " ").alias("p"), span.alias("span"), first)
    holds = (F.size(F.array_except("p", F.slice("t", F.col("start") + 1, F.col("span")))) == 0) & F.array_contains("p", F.get("t", F.col("start")))
    return tried.where(holds).select("doc_id", "text_hash", "start", "phrase", F.col("span").alias("length")).distinct().join(wanted.drop("length"), "phrase").select("doc_id", "text_hash", "start", "length", "item_id")


def _covered(spans: Column) -> Column:
    """Number of places in the union of (start, length)."""
    step = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["sum"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("sum"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        ),
    )
    return step["sum"].cast("long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, items (sorted as strings), contaminated.

    A text is contaminated if a phrase occurs and at least a twentieth of its words lie in occurrences. Null and empty texts
    have no words and are clean; so are rows without an id. Rows that share an id are judged each by its own text. Other columns are not looked at.
    """
    hits = phrase_matches(docs, items, id_col, text_col, item_col, item_text, window)
    hits = hits.groupBy("doc_id", "text_hash").agg(_covered(F.collect_set(F.struct("start", "length"))).alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), n_terms(F.col(text_col)).alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(hits, ["doc_id", "text_hash"], "left").select(
        "doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated rows; columns as they are, whatever their names. Rows without an id stay, and so does
    a clean row that shares its id with a contaminated one."""
    bad = contamination(docs, items, id_col, text_col, **options).where("contaminated").select("doc_id", "text_hash").distinct()
    rows = whole(docs, id=id_col, hash=F.xxhash64(text_col))
    return rows.join(bad, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")
