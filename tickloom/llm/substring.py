"""Substring deduplication by relative Lempel-Ziv parsing.

Every text is cut at content-defined points into *blocks*: the stretch of 50-word windows whose smallest 10-gram
hash (the anchor) is the same. Equal windows have equal anchors wherever they stand, so all places that could hold
a window are in the index under its anchor. The reference is the set of distinct blocks, each at the first place that
holds it (smallest document, then smallest start). A block of a later document is looked up whole; a block that is the
first of its kind, under an anchor that other blocks share, is where a copy begins or ends, and its windows are looked
up one by one.

The parse of a document is greedy. Look-ups that continue each other in the same source document are first joined into
matches of full length. From the first copied word on, the match that reaches furthest becomes the next factor, and
parsing goes on behind it. A match that begins before the end of the last factor is one that the check at the factor
boundary has found: it is of at least 50 words, though fewer of them are new. Factors do not overlap and their union
is the duplicate text. Where a duplicate span ends, its factor cannot be made longer in any earlier document, because
one more equal word would be one more window that the index knows.

Cost: about one block for 21 words, and window rows only for distinct variants of shared blocks. A group of equal
copies collapses to one index row per block in the partial aggregation; no group is gathered in one task, only the
matches of one document are. Keys are two independent 64-bit hashes (anchor and block, or anchor and window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .wordhash import BASES, Prefix, Words, chunks, signed, sliding_min

WINDOW = 50
ANCHOR = 10


def _blocks(window: int, anchor: int):
    names = ["doc_id", "text_hash", "anchor", "block", "start", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            w = Words(texts)
            n = len(w.hash)
            if n < window:
                continue
            grams = Prefix(w.hash).run(np.arange(n - anchor + 1), np.arange(anchor, n + 1))
            low = sliding_min(grams, window - anchor + 1)
            at = w.windows(window)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]])
            head = np.flatnonzero(new)
            start, count = at[head], np.diff(np.append(head, len(at)))
            mark = Prefix(w.hash, BASES[1]).run(start, start + count + window - 1)
            doc = w.doc[start]
            ids, hashes = (batch.column(c).take(pa.array(doc)) for c in ("doc_id", "text_hash"))
            out = pa.record_batch([ids, hashes, signed(low[start]), signed(mark), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32))], names=names)
            yield out.filter(ids.is_valid())

    return run


def _window_rows(window: int):
    """(doc_id, text_hash, text, blocks) to one row per window of these blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            w = Words(texts)
            lists = batch.column("blocks")
            owner = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            if not len(flat):
                continue
            anchor, start, count = (flat.field(i).to_numpy() for i in range(3))
            begin = np.repeat(start, count)
            inside = np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
            at, doc = begin + inside, np.repeat(owner, count)
            key = np.repeat(anchor, count)
            where = at + w.first[doc]
            mark = Prefix(w.hash, BASES[1]).run(where, where + window)
            ids, hashes = (batch.column(c).take(pa.array(doc)) for c in ("doc_id", "text_hash"))
            yield pa.record_batch([ids, hashes, pa.array(key), signed(mark), pa.array(at.astype(np.int32))], names=["doc_id", "text_hash", "anchor", "mark", "start"])

    return run


def _longest(owner, source, diagonal, start, end, whole):
    """Look-ups of the same ``owner``, ``source`` and ``diagonal`` that touch or overlap, joined: order of rows, first and last word, kind."""
    order = np.lexsort((start, diagonal, source, owner))
    owner, source, diagonal, start, end, whole = (x[order] for x in (owner, source, diagonal, start, end, whole))
    same = np.zeros(len(order), bool)
    same[1:] = (owner[1:] == owner[:-1]) & (source[1:] == source[:-1]) & (diagonal[1:] == diagonal[:-1])
    line = np.cumsum(~same) << 32
    reach = np.maximum.accumulate(line + end) - line
    new = ~same
    new[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    if not len(head):
        return tuple(x[:0] for x in (owner, source, diagonal, start, end, whole))
    return owner[head], source[head], diagonal[head], start[head], np.maximum.reduceat(end, head), np.logical_and.reduceat(whole, head)


def _greedy(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """(match, first word of its factor) of the greedy parse of one document, whose matches are in order of ``starts``."""
    factors = []
    i = done = 0
    while i < len(starts):
        at, best = max(done, starts[i]), -1
        while i < len(starts) and starts[i] <= at:
            if ends[i] > (at if best < 0 else ends[best]):
                best = i
            i += 1
        if best >= 0:
            factors.append((best, at))
            done = ends[best]
    return factors


_FACTOR = "start:int,n_words:int,parse_start:int,source_id:long,source_start:int,kind:string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, met) to (doc_id, text_hash, factors): the look-ups of a document to its factors."""
    item = pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("parse_start", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32()), ("kind", pa.string())])
    for batch in batches:
        lists = batch.column("met")
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        start, n, source, source_start = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "n_words", "source_id", "source_start"))
        whole = flat.field("whole").to_numpy(zero_copy_only=False)
        owner, source, diagonal, start, end, whole = _longest(owner, source, source_start - start, start, start + n, whole)
        order = np.lexsort((diagonal, source, start, owner))
        owner, source, diagonal, start, end, whole = (x[order] for x in (owner, source, diagonal, start, end, whole))
        bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
        out = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            starts, ends = start[low:high].tolist(), end[low:high].tolist()
            out.append([
                {"start": starts[k], "n_words": ends[k] - starts[k], "parse_start": at, "source_id": int(source[low + k]),
                 "source_start": starts[k] + int(diagonal[low + k]), "kind": "block" if whole[low + k] else "edge"}
                for k, at in _greedy(starts, ends)
            ])
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(out, pa.list_(item))], names=["doc_id", "text_hash", "factors"])


def _kept(window: int):
    """(doc_id, text, spans) to the words outside the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            spans = batch.column("spans").to_pylist()
            kept, total, removed = [], [], []
            for text, cut in zip(texts, spans):
                words = text.split()
                n = len(words)
                total.append(n)
                if cut:
                    gone = np.zeros(n + 1, np.int32)
                    for s in cut:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n_words"]] -= 1
                    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    words = [words[i] for i in keep.tolist()]
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _first_place() -> list[Column]:
    """The smallest document of a group as ``first``, its smallest start as ``first_start`` (by one number, so that the aggregate stays hash-based), and the largest document as ``last``."""
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("start").cast("decimal(10,0)")
    return [F.min("doc_id").alias("first"), F.min(place).alias("place"), F.max("doc_id").alias("last")]


def _source_start() -> Column:
    base = F.col("first").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)")
    return (F.col("place") - base).cast("int").alias("source_start")


def reference_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Index entries (doc_id, text_hash, anchor, block, start, n_windows) of every text of at least ``window`` words."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has between one word and a window")
    return _input(docs, id_col, text_col).mapInArrow(_blocks(window, anchor), "doc_id long, text_hash long, anchor long, block long, start int, n_windows int")


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, factors): the greedy parse of each text that copies from a smaller document; see ``factors``."""
    rows = _input(docs, id_col, text_col)
    blocks = written(reference_blocks(rows, window=window, anchor=anchor), "blocks")
    index = blocks.groupBy("anchor", "block").agg(*_first_place())
    shared = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    known = written(index.join(shared.select("anchor", "variants"), "anchor").select("anchor", "block", "first", _source_start(), "variants"), "known")
    met = written(
        blocks.join(known, ["anchor", "block"]).where("first < doc_id OR variants > 1")
        .select("doc_id", "text_hash", "anchor", "start", "n_windows", "first", "source_start"),
        "met",
    )
    found = ["doc_id", "text_hash", "start", "n_words", F.col("first").alias("source_id"), "source_start", "whole"]
    whole = met.where("first < doc_id").withColumns({"n_words": F.col("n_windows") + (window - 1), "whole": F.lit(True)}).select(*found)
    edges = met.where("first = doc_id").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("anchor", "start", "n_windows")).alias("blocks"))
    # sets, so that rows repeating an id and a text do not multiply
    texts = rows.join(edges, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "blocks")
    windows = written(texts.mapInArrow(_window_rows(window), "doc_id long, text_hash long, anchor long, mark long, start int"), "windows")
    # written, so that the join has two plain exchanges and a window that very many blocks hold can be split
    firsts = windows.groupBy("anchor", "mark").agg(*_first_place()).where("first < last").select("anchor", "mark", "first", _source_start())
    firsts = written(firsts, "firsts")
    edge = windows.join(firsts, ["anchor", "mark"]).where("first < doc_id").withColumns({"n_words": F.lit(window), "whole": F.lit(False)}).select(*found)
    each = whole.unionByName(edge).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n_words", "source_id", "source_start", "whole")).alias("met"))
    return each.mapInArrow(_parse, f"doc_id long, text_hash long, factors array<struct<{_FACTOR}>>")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Copied factors (doc_id, text_hash, start, n_words, parse_start, source_id, source_start, kind).

    Words ``start`` to ``start + n_words`` of the document equal those from ``source_start`` on in a row of the smaller
    document ``source_id``. The factor itself begins at ``parse_start``, behind the factor before it; ``start`` lies earlier if the
    match was found across that boundary. ``kind`` is ``block`` if the match is made of whole blocks and ``edge`` if windows at an end were looked up one by one.
    Texts under ``window`` words, null texts and rows without an id have none and are no reference. Rows that repeat a document's
    id do not copy each other; each is parsed by its own text.
    """
    each = parsed(docs, id_col, text_col, window, anchor)
    return each.select("doc_id", "text_hash", F.explode("factors").alias("f")).select("doc_id", "text_hash", "f.*")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A null or empty text has no words and keeps an empty text. Other columns of ``docs`` are not looked at.
    """
    rows = _input(docs, id_col, text_col)
    spans = parsed(rows, window=window, anchor=anchor).withColumnRenamed("factors", "spans")
    return rows.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_text string")
