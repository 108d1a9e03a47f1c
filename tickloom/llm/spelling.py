"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words and their numbers come from whole texts in one pass with partial aggregation (``counted_words``).
2. The gram dictionary grows by length. Grams of ``MIN_GRAM`` code points come first; a gram is extended only where it
   stands in more than ``FREQUENT`` places, so a rare gram has no longer ones (``gram_index``). Each word is filed under its
   dictionary grams together with its length and the gram's place.
3. A word is decomposed from left to right into variable grams that do not overlap: at each place the longest of the
   dictionary, but the first leaves room for a second. How many of them one edit can affect is the word's bound
   (``decompose``); a near word has all others, at the same distance from the word's start or end.
4. Lists merge by that bound: of its grams a word looks up the rarest ones, one more than the bound, for at least one of
   these is untouched (``near_pairs``). Longer words look for shorter or equally long ones, so a pair is met from one side.
5. Every word met is verified by its edit distance, inside the join: no candidate is stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import lower
from .shared import written

#: Code points of a word at least, and its occurrences.
MIN_LENGTH = 6
MIN_COUNT = 5
#: Lengths of grams, and places up to which a gram is not extended.
MIN_GRAM = 3
MAX_GRAM = 8
FREQUENT = 500
#: A run loses a code point if this divides its checksum.
NOISE = 199
#: A form has at least so many times the word's occurrences.
DOMINANCE = 5
#: A table of gram counts goes to every task only up to this size; above it the join shuffles.
BROADCAST_ROWS = 200_000
_RUN = r"[a-zÀ-ÿ]+"


def noisy_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """(word): the letter runs of whole texts, A-Z lower-cased, some without one code point.

    With h the CRC-32 of ``<id>:<run>``, a run whose h is divisible by ``noise`` loses code point h % length. Null texts have
    no runs; runs of rows without an id are left as they are.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(lower(F.col(text_col)), F.lit(f"({_RUN})"), F.lit(1))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n, length) of the words of ``noisy_runs`` that are long and frequent enough."""
    words = noisy_runs(docs, id_col, text_col, noise).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).withColumn("length", F.length("word"))


def gram_index(words: DataFrame, min_gram: int = MIN_GRAM, max_gram: int = MAX_GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, length, start, size, gram, places): every dictionary gram of every word, and in how many places the gram stands.

    The dictionary is closed under taking beginnings: a gram has extensions only if it stands in more than ``frequent`` places.
    One aggregate and one join for each gram length; what is left shrinks with each.
    """
    open_places = words.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - min_gram)).alias("start"))
    levels = []
    for size in range(min_gram, max_gram + 1):
        cut = open_places.withColumns({"size": F.lit(size), "gram": F.substring("word", F.col("start") + 1, F.lit(size))})
        counts = written(cut.groupBy("gram").agg(F.count(F.lit(1)).alias("places")), "gram_counts")
        counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
        levels.append(written(cut.join(counts, "gram").select("word", "n", "length", "start", "size", "gram", "places"), "grams"))
        open_places = levels[-1].where((F.col("places") > frequent) & (F.col("start") + size < F.col("length"))).select("word", "n", "length", "start")
    return reduce(DataFrame.unionByName, levels)


def decompose(index: DataFrame, min_gram: int = MIN_GRAM) -> DataFrame:
    """(word, n, length, grams, affected): each word's variable grams (start, size, gram, places), and how many one edit can affect.

    An edit changes one place, or opens a gap between two, so it affects the grams that cover it; these do not overlap, so
    the bound is their largest cover of a place, counted from the grams themselves.
    """
    entry = F.struct("start", (-F.col("size")).alias("shortness"), "size", "gram", "places")
    kind = "array<struct<start:int,size:int,gram:string,places:bigint>>"

    def take(acc, g):
        fits = (g["start"] == acc["end"]) & ((g["start"] > 0) | (g["size"] <= acc["room"]))
        more = F.array_append(acc["grams"], F.struct(g["start"].alias("start"), g["size"].alias("size"), g["gram"].alias("gram"), g["places"].alias("places")))
        return F.struct(F.when(fits, g["start"] + g["size"]).otherwise(acc["end"]).alias("end"), acc["room"].alias("room"), F.when(fits, more).otherwise(acc["grams"]).alias("grams"))

    start = F.struct(F.lit(0).alias("end"), (F.col("length") - min_gram).alias("room"), F.array().cast(kind).alias("grams"))
    each = index.groupBy("word").agg(F.first("n").alias("n"), F.first("length").alias("length"), F.array_sort(F.collect_list(entry)).alias("entries"))
    each = each.select("word", "n", "length", F.aggregate("entries", start, take, lambda acc: acc["grams"]).alias("grams"))
    cover = F.transform("grams", lambda g: F.size(F.filter("grams", lambda o: (o["start"] <= g["start"]) & (g["start"] < o["start"] + o["size"]))))
    return each.withColumn("affected", F.array_max(cover))


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, min_gram: int = MIN_GRAM, max_gram: int = MAX_GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(word, n, other, other_n): each unordered pair of ``words`` (word, n, length) that differ by one code point, once.

    Words must be distinct and have twice ``min_gram`` code points at least, so that two grams fit in each.
    """
    index = gram_index(words, min_gram, max_gram, frequent)
    rarest = F.slice(F.array_sort(F.transform("grams", lambda g: F.struct(g["places"].alias("places"), g["start"].alias("start"), g["gram"].alias("gram")))), 1, F.col("affected") + 1)
    looked_up = decompose(index, min_gram).select("word", "n", "length", F.explode(rarest).alias("g"))
    # an untouched gram keeps its distance from the start, or from the end: in a word one shorter that is one place less
    where = lambda length, start: F.struct(length.alias("length"), start.alias("start"))
    length, start = F.col("length"), F.col("g.start")
    places = F.array(where(length, start), where(length - 1, start), where(length - 1, start - 1))
    looked_up = looked_up.select("word", "n", F.col("g.gram").alias("gram"), F.explode(places).alias("p")).select("word", "n", "gram", "p.length", "p.start")
    # written, so that the join has two plain exchanges and the list of a very common gram can be split
    looked_up = written(looked_up, "lookups")
    listed = index.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("length").alias("other_length"), F.col("start").alias("other_start"), F.col("gram").alias("other_gram"))
    same_list = (F.col("gram") == F.col("other_gram")) & (F.col("length") == F.col("other_length")) & (F.col("start") == F.col("other_start"))
    once = (F.length("word") > F.col("other_length")) | (F.col("word") > F.col("other"))
    found = looked_up.join(listed, same_list & once & _one_edit(F.col("word"), F.col("other")))
    return found.select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from ``forms`` (word, form): forms followed to the last; a word without one is its own root.

    Pointers jump to their pointer's pointer, so a chain of c forms takes log2(c) joins. Chains must not run in a circle.
    """
    at = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(at.join(beyond, "root").select("word", F.col("beyond").alias("root"), F.col("root").alias("before")), "roots")
        at = step.select("word", "root")
        if step.where("root <> before").isEmpty():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the whole texts that is long and frequent enough.

    ``n_near`` counts the words one edit away. The form is the most frequent of them (ties: the smallest by code points) if it
    has ``dominance`` times the word's occurrences, else null. Numbers grow along forms, so they end; ``root`` is the last.
    Repeated rows count as often as they stand there; an empty table has no words. Other columns are not looked at.
    """
    words = written(counted_words(docs, id_col, text_col), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = words.select("word", "n").join(best, "word", "left")
    strong = -F.col("best.less") >= dominance * F.col("n")
    near = near.select("word", F.when(strong, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n"))
    near = written(near, "forms")
    return near.join(roots(near), "word").select("word", "form", "root", "n", "n_near", "form_n")
