"""Token counts of whole texts without token ids: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the word after it. No piece of the vocabulary has a space mark behind another
character (this is checked when a counter is made), so byte-pair merges never cross from one pre-token into the next
and the count of a text is the sum over its pre-tokens.

1. Tasks count pre-tokens of their texts in bounded tables; the sums over all texts give the table of types.
2. Each type is encoded once.
3. The ``head`` most frequent short types, a table of bounded size, go to all tasks; they settle most occurrences on the
   spot. Of the rest each document sends its own frequencies, one row per distinct type, to join with the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .wordhash import chunks

#: Types held by every task, and the most bytes each may have: together they bound what is broadcast.
HEAD_TYPES = 1 << 18
HEAD_BYTES = 32
#: Distinct pre-tokens a task holds before it hands its counts on.
TASK_TYPES = 400_000

_MARK = "▁"
_PRE_TOKEN = re.compile(r" *[^ ]+| +")
_models: dict[str, object] = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, without the first of the spaces before each word; a lone run of n spaces keeps all n."""
    if not text:
        return []
    if _MARK in text:
        text = text.replace(_MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [t[1:] if t[-1] != " " else t for t in _PRE_TOKEN.findall(" " + text)]


def load(model: str):
    """The library's tokenizer; refuses one whose pieces or rules reach across pre-tokens."""
    if model not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        crossing = any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        probe = sp.encode("  a  b ", out_type=str)
        if crossing or "".join(probe) != f"{_MARK * 3}a{_MARK * 2}b{_MARK}" or "".join(sp.encode("ﬁ ²", out_type=str)) != f"{_MARK}ﬁ{_MARK}²":
            raise ValueError("the tokenizer's pieces or normalisation do not stop at spaces")
        _models[model] = sp
    return _models[model]


def piece_counts(sp, types: list[str]) -> list[int]:
    """Pieces of each pre-token with the space before it, as inside a text."""
    blank = [len(t) if not t.strip(" ") else 0 for t in types]
    # the library puts one space before what it encodes; a run of n spaces is then n - 1 of them
    encoded = sp.encode([t[1:] if b else t for t, b in zip(types, blank)], num_threads=1)
    return [1 if b == 1 else len(ids) for b, ids in zip(blank, encoded)]


def _types(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush():
            out = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["type", "n"])
            seen.clear()
            return out

        for _, texts in chunks(batches):
            for text in texts:
                seen.update(pre_tokens(text.decode()))
            if len(seen) > limit:
                yield flush()
        if seen:
            yield flush()

    return run


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(model)
        for batch in batches:
            types = batch.column("type").to_pylist()
            yield pa.record_batch([batch.column("type"), batch.column("n"), pa.array(piece_counts(sp, types), pa.int64())], names=["type", "n", "pieces"])

    return run


def _frequencies(head):
    """Texts to one row with what the head settles, and one row for each other distinct type."""
    names = ["doc_row", "doc_id", "n_bytes", "settled", "type", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch, texts in chunks(batches):
            rows = batch.column("doc_row").to_pylist()
            owner, settled, size, types, counts = [], [], [], [], []
            for i, text in enumerate(texts):
                total, rest = 0, []
                for t in pre_tokens(text.decode()):
                    c = known.get(t)
                    if c is None:
                        rest.append(t)
                    else:
                        total += c
                owner.append(i), settled.append(total), size.append(len(text)), types.append(None), counts.append(0)
                if rest:
                    own = Counter(rest)
                    owner += [i] * len(own)
                    settled += [0] * len(own)
                    size += [0] * len(own)
                    types += own.keys()
                    counts += own.values()
            at = pa.array(owner)
            yield pa.record_batch(
                [pa.array(rows, pa.int64()).take(at), batch.column("doc_id").take(at), pa.array(size, pa.int64()), pa.array(settled, pa.int64()), pa.array(types, pa.string()), pa.array(counts, pa.int64())],
                names=names,
            )

    return run


def frequent(types: DataFrame, most: int) -> DataFrame:
    """The most frequent short types, down to a frequency that at most ``most`` of them reach."""
    short = types.where(F.octet_length("type") <= HEAD_BYTES).withColumn("level", F.floor(F.log2("n") * 16))
    levels = sorted(((r["level"], r["count"]) for r in short.groupBy("level").count().collect()), reverse=True)  # at most 16 x 64 rows
    total, least = 0, None
    for level, count in levels:
        total += count
        if total > most:
            break
        least = level
    return short.where(F.lit(False) if least is None else F.col("level") >= least)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", head_types: int = HEAD_TYPES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens. ``model`` is the file of a sentencepiece model.

    A null text counts as empty (0 bytes, 0 tokens). Rows that share an id, or have none, are counted together only
    if their texts are equal, and then come once with the count of one. Other columns are not looked at.
    """
    load(model)
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    types = rows.select("text").mapInArrow(_types(TASK_TYPES), "type string, n long").groupBy("type").agg(F.sum("n").alias("n"))
    types = written(types.mapInArrow(_encode(model), "type string, n long, pieces long"), "types")
    head = {r["type"]: r["pieces"] for r in frequent(types, head_types).collect()}  # at most head_types short rows
    sent = spark.sparkContext.broadcast(head)
    own = rows.select("doc_id", "text", F.xxhash64("text").alias("doc_row")).mapInArrow(
        _frequencies(sent), "doc_row long, doc_id long, n_bytes long, settled long, type string, n long"
    )
    own = written(own, "frequencies")
    zero = F.lit(0).cast("long")
    settled = own.where("type IS NULL").select("doc_id", "doc_row", "n_bytes", "settled", F.lit(1).cast("long").alias("times"), zero.alias("rest"))
    rest = own.where("type IS NOT NULL").join(types.select("type", "pieces"), "type")
    rest = rest.select("doc_id", "doc_row", zero.alias("n_bytes"), zero.alias("settled"), zero.alias("times"), (F.col("n") * F.col("pieces")).alias("rest"))
    per_document = settled.unionByName(rest).groupBy("doc_id", "doc_row").agg(
        F.max("n_bytes").alias("n_bytes"), F.max("settled").alias("settled"), F.sum("times").alias("times"), F.sum("rest").alias("rest")
    )
    # a repeated row sends its frequencies again; the number of rows takes them back
    return per_document.select("doc_id", "n_bytes", (F.col("settled") + F.col("rest") / F.col("times")).cast("long").alias("n_tokens"))
