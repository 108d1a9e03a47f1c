"""Audit of how filters interact: what each one removes in every order of application.

A row's failures are a set of filter letters, its mask. Rows count into cells (part, mask), at most 2^filters for each part.
Each cell then folds across the array of all orders, which every task has as a literal: ``aggregate`` walks one order and
``transform`` goes through all, which gives one struct for each order and step (600 for five filters), weighted with the
cell's counts. Cells of a part merge by elementwise sums of these arrays. No row is looked at once for each order.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, written

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: More filters would make more orders than a plan should hold as a literal (six: 720).
MAX_FILTERS = 6


def all_orders(letters: str) -> list[str]:
    if not 1 <= len(letters) <= MAX_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MAX_FILTERS} different letters are needed")
    return ["".join(p) for p in permutations(letters)]


def _steps(cell: Column, order: Column, n_steps: int) -> Column:
    """The counts of one cell in one order, first step first."""
    none = F.lit(0).cast("long")

    def step(acc, fails):
        gone = acc["gone"]
        made = F.struct(
            F.when(~(fails | gone), cell["n"]).otherwise(none).alias("kept"),
            F.when(fails & ~gone, cell["n"]).otherwise(none).alias("removed"),
            F.when(fails & gone, cell["n"]).otherwise(none).alias("redundant"),
            F.when(fails & cell["alone"], cell["n"]).otherwise(none).alias("unique_fails"),
            F.when(fails & ~gone, cell["good"]).otherwise(none).alias("good_lost"),
            F.when(fails & ~gone, cell["toxic"]).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.array_append(acc["steps"], made).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>").alias("steps"))
    fails = F.transform(F.sequence(F.lit(1), F.lit(n_steps)), lambda k: F.contains(cell["mask"], F.substring(order, k, 1)))
    return F.aggregate(fails, start, step, lambda acc: acc["steps"])


def fold_cells(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, counts, shapley) from ``cells`` (part, mask, n, good, toxic).

    ``mask`` holds the letters of the filters that the cell's rows fail; a part has a mask once. Steps count from 1.
    ``shapley`` is what the step's filter removes, summed over all orders at any step. No cells give no rows.
    """
    orders, n = F.lit(all_orders(letters)), len(letters)
    folded = lambda cell: F.flatten(F.transform(orders, lambda o: _steps(cell, o, n)))
    summed = lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])
    zeros = F.transform(F.sequence(F.lit(1), F.lit(n * len(all_orders(letters)))), lambda _: F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]))
    cell = F.struct("mask", "n", "good", "toxic", (F.length("mask") == 1).alias("alone"))
    parts = cells.groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 2^filters at most
    merged = parts.select("part", F.aggregate("cells", zeros, lambda acc, cell: F.zip_with(acc, folded(cell), summed)).alias("m"))
    rows = merged.select("part", F.posexplode("m").alias("at", "s"))
    rows = rows.select("part", F.get(orders, F.floor(F.col("at") / n).cast("int")).alias("filter_order"), (F.col("at") % n + 1).alias("step"), *[f"s.{c}" for c in COUNTS])
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))))


def document_failures(text: Column) -> Column:
    """Letters of the filters A to D that a whole text fails; null is empty.

    A: under 200 words; B: distinct words under half of all; C: more than 2 % A-Z; D: any of # $ % & * |. The words of B are
    case-sensitive; an empty text fails A alone.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACES}+"), "")
    few = F.size(words) < 200
    repeated = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    capitals = 100 * F.length(F.regexp_replace(text, "[^A-Z]++", "")) > 2 * F.length(text)
    symbols = text.rlike("[#$%&*|]")
    return F.concat(*[F.when(fails, letter).otherwise("") for fails, letter in ((few, "A"), (repeated, "B"), (capitals, "C"), (symbols, "D"))])


def document_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters A to E that they fail.

    E: the text equals that of a row with a smaller id, anywhere in the table; null texts equal empty ones. A row without
    an id has no smaller one and is no smaller one. Rows that repeat the smallest id all pass E. A row counts as good or
    toxic if any label of its id says so. A null part is the empty string. Other columns of either table are not looked at.

    Equal texts meet as SHA-256 digests: the smallest id of a text is a minimum with partial aggregation, and comes back by a
    join on (digest, id), so that thousands of copies of one text lie in as many places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), document_failures(F.col(text_col)).alias("mask"),
    )
    facts = written(facts, "facts")
    first = written(facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True)), "first_of_text")
    said = labels.select(F.col(label_id).alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id")
    said = written(said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels_of_id")
    rows = facts.join(first, ["digest", "id"], "left").join(said, "id", "left")
    mask = F.concat("mask", F.when(F.col("id").isNull() | F.col("first"), "").otherwise("E"))
    yes = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.select("part", mask.alias("mask"), "good", "toxic").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), yes("good"), yes("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Every order of the five document filters for every part: see ``document_cells`` and ``fold_cells``."""
    return fold_cells(document_cells(docs, labels, **columns), FILTERS)
