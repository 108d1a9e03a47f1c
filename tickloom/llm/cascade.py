"""Quality rules as a short-circuit cascade.

Every rule is one column expression that is true where it rejects, and has a second one for the work it takes on a row:
characters, lines or words it goes through, times what one of them takes. On a hashed sample one job adds up rows and
work by which rules reject them; then rules are ordered greedily, each by the rejections it adds per work among the rows
that the rules before it let through. Work is counted, not timed, so the order is the same in every run: the time of a
job on a sample is mostly its start. The cascade is a conjunction, which stops at the first rule that rejects. The order
changes the work, never the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, written

SAMPLE_ROWS = 1000
MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"
#: Nanoseconds on one core, measured on 28,000 rows with 76 million characters: a stored number is compared, a pattern that is
#: tried at every character passes one, a pattern finds every capital or every letter, an anchored one tries a line,
#: a word is looked up in a list. The order depends on their ratios only.
NUMBER, PASSED, CAPITALS, LETTERS, LINE, LOOKUP = 5, 37, 18, 92, 700, 86
#: Common words of the four languages.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "les", "et", "que", "el", "en", "y", "der", "die", "und", "das", "von")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once a row, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), use), 0)


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that the text holds twice or more.

    A window is a 64-bit number, as many high bits of a hash as its place leaves free above the low bits. Sorted, equal
    windows are neighbours, and neighbours with equal hashes are compared word by word.
    """
    n = F.size(words)
    bits = F.ceil(F.log2(n + F.lit(1.0))).cast("int") + 1

    def counted(b):
        left = lambda c: F.call_function("shiftleft", c, b["bits"])
        right = lambda c: F.call_function("shiftright", c, b["bits"])
        place = lambda c: c.bitwiseAND(b["mask"]).cast("int")
        coded = F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: left(right(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).bitwiseOR(i.cast("long"))
        )

        def equal(a, c):
            same = right(a) == right(c)
            for k in range(3):
                same &= F.get(words, place(a) + k) == F.get(words, place(c) + k)
            return F.coalesce(same, F.lit(False))

        # by place, the marked windows cover min(3, distance to the next) words each
        def covered(order):
            marked = F.filter(order, lambda x, i: equal(x, F.get(order, i + 1)) | ((i > 0) & equal(x, F.get(order, F.greatest(i - 1, F.lit(0))))))
            step = F.aggregate(
                F.sort_array(F.transform(marked, place)), F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
                lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"), p.alias("last")),
            )
            return step["sum"]

        return _with(F.sort_array(coded), covered)

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.when(n < 4, F.lit(0)).otherwise(_with(F.struct(bits.alias("bits"), mask.alias("mask")), counted)).cast("long")


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = F.struct(words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    facts = _with(
        cut,
        lambda c: F.struct(
            c["words"].alias("words"),
            c["lines"].alias("lines"),
            F.size(c["words"]).cast("long").alias("n_words"),
            F.char_length(F.array_join(c["words"], "")).cast("long").alias("word_chars"),
            (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(c["words"]).alias("n_repeat_words"),
        ),
    )
    rows = rows.select("doc_id", "text", facts.alias("f"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    rows = rows.select("doc_id", "text", "f.*", "n_symbols")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _share(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part > percent * whole


def rules() -> dict[str, Column]:
    n, lines = F.col("n_words"), F.col("lines")
    return {
        "word_length_short": F.col("word_chars") < 3 * n,
        "word_length_long": F.col("word_chars") > 12 * n,
        "symbols": _share(F.col("n_symbols"), n, 10),
        "repeated_lines": _share(F.col("n_dup_lines"), F.size(lines), 40),
        "ellipsis_lines": _share(F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)$"))), F.size(lines), 30),
        "bullet_lines": _share(F.size(F.filter(lines, lambda x: x.rlike("^[\\x20\\x09]*[-*•]"))), F.size(lines), 90),
        "few_letters": 100 * F.regexp_count("text", F.lit("[A-Za-z\\x{80}-\\x{10FFFF}]")) < 80 * F.col("word_chars"),
        "capitals": _share(F.regexp_count("text", F.lit("[A-Z]")), F.col("word_chars"), 30),
        "no_stop_words": F.size(F.array_intersect("words", F.array(*map(F.lit, STOP_WORDS)))) < 2,
    }


def work() -> dict[str, Column]:
    """Nanoseconds that each of ``rules`` takes on a row."""
    number, chars, lines = F.lit(NUMBER), F.char_length("text"), F.size("lines")
    return {
        "word_length_short": number,
        "word_length_long": number,
        "symbols": number,
        "repeated_lines": number,
        "ellipsis_lines": number + PASSED * chars,
        "bullet_lines": number + LINE * lines,
        "few_letters": number + LETTERS * chars,
        "capitals": number + CAPITALS * chars,
        "no_stop_words": number + LOOKUP * F.col("n_words"),
    }


def greedy_order(cells: list[tuple[frozenset[str], int, dict[str, float]]], names: list[str]) -> list[str]:
    """``names`` by rejections per work among what is left. A cell is the rules that reject its rows, their number, and each rule's work on them.

    Rules that reject none of what is left come last, cheapest first; ties keep the order of ``names``.
    """
    order: list[str] = []
    while len(order) < len(names):
        left = [c for c in cells if not c[0].intersection(order)] or cells
        cost = {n: sum(c[2][n] for c in left) or 1.0 for n in names}
        gain = {n: sum(c[1] for c in left if n in c[0] and not c[0].intersection(order)) / cost[n] for n in names}
        order.append(max((n for n in names if n not in order), key=lambda n: (gain[n], -cost[n])))
    return order


def sampled_order(
    docs: DataFrame, chosen: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, costs: dict[str, Column] | None = None,
) -> list[str]:
    """Rule names by rejections added per work, estimated on about ``sample_rows`` rows chosen by a hash of id and text.

    ``costs`` has the work of each of ``chosen`` on a row; without it all rules count as equally dear. Equal rows are sampled
    together or not at all. If the sample has no row that passes the base rules, the order is that of ``chosen``.
    """
    names = list(chosen)
    each = max(1, docs.count() // sample_rows)
    picked = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(each)) == 0)
    # written, or the features move into the filter that picks rows and are worked out for all of them
    sample = written(base_features(picked, id_col, text_col), "sample").where("NOT base_failed")
    taken = [F.sum((costs or {}).get(n, F.lit(1)).cast("double")).alias(f"work_{n}") for n in names]
    found = sample.groupBy(*[F.coalesce(chosen[n], F.lit(False)).alias(n) for n in names]).agg(F.count(F.lit(1)).alias("rows"), *taken)
    cells = [(frozenset(n for n in names if r[n]), r["rows"], {n: r[f"work_{n}"] for n in names}) for r in found.collect()]  # at most 2^rules
    return greedy_order(cells, names)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: the base features, base_failed, rejected_by (first rule of the cascade) and kept.

    A null or empty text has no words and fails the base rule. Equal texts get equal verdicts; which rule is named first
    depends on the order, which depends on the table only. Other columns are not looked at.
    """
    features = base_features(docs, id_col, text_col)
    chosen = rules()
    order = sampled_order(docs, chosen, id_col, text_col, sample_rows, work())
    rejected = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        rejected = rejected.when(chosen[name], F.lit(name))
    out = features.withColumn("rejected_by", rejected)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", F.col("rejected_by").isNull().alias("kept"))
