"""N-gram Jaccard join by MinHash banding, and the near-duplicate groups that follow from it.

1. Equal word sequences form one class; only the smallest document of a class goes on.
2. Every class representative gets a MinHash signature over its word n-grams, cut into bands. Band and row counts
   come from the target recall at the threshold (``choose_bands``). Representatives shuffle on their band hashes, and
   each is tied to the smallest one of its bucket: a star, never all pairs of a bucket.
3. Connected components of the stars hold every pair of candidates. A component is cut into blocks; each pair of
   blocks is one group of rows, whose size is bounded whatever the size of the component. There the full n-gram sets
   are compared, and what comes out is one row per document: its number of links and a root it is linked with. A
   link is never dropped and no list of pairs is made.
4. Components of the verified links are the near-duplicate groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, whole, written
from .wordhash import BASES, Prefix, Words, chunks, mix, signed

N_GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: Documents of a component compared at once; a larger component is compared block by block.
BLOCK = 192
#: Bytes of text that a block holds on average at most; components of very long documents have smaller blocks.
BLOCK_BYTES = 8 << 20
#: n-grams compared at once.
COLUMNS = 1 << 14


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with the target recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {max_hashes} hashes reaches a recall of {recall} at {threshold}")
    return best


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word n-gram; a text of fewer words, but not none, is one n-gram."""
    prefix = Prefix(w.hash)
    at = w.windows(n)
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    start, end = np.concatenate((at, w.first[few])), np.concatenate((at + n, w.first[few + 1]))
    doc = np.concatenate((w.doc[at], few))
    if len(few):
        order = np.argsort(doc, kind="stable")
        start, end, doc = start[order], end[order], doc[order]
    return mix(prefix.run(start, end) + (end - start).astype(np.uint64)), doc


def _signatures(n: int, bands: int, rows: int):
    names = ["doc_id", "text_hash", "key1", "key2", "size", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(8128))
        a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        for batch, texts in chunks(batches):
            w = Words(texts)
            s, doc = shingles(w, n)
            if not len(s):
                continue
            head = np.flatnonzero(np.diff(doc, prepend=-1))
            at = doc[head]
            out = np.empty((len(head), bands), np.uint64)
            v = np.empty_like(s)
            for band in range(bands):
                acc = np.full(len(head), band + 1, np.uint64)
                for j in range(band * rows, band * rows + rows):
                    np.bitwise_xor(s, b[j], out=v)
                    np.multiply(v, a[j], out=v)
                    acc = mix(acc * np.uint64(BASES[0]) + np.minimum.reduceat(v, head))
                out[:, band] = acc
            ids, text_hash = (batch.column(c).take(pa.array(at)) for c in ("doc_id", "text_hash"))
            keys = [signed(Prefix(h).run(w.first[at], w.first[at + 1])) for h in (w.hash, mix(w.hash))]
            lists = pa.ListArray.from_arrays(np.arange(0, len(head) * bands + 1, bands, dtype=np.int32), signed(out.ravel()))
            size = pa.array(np.fromiter(map(len, texts), np.int64, len(texts))[at])
            yield pa.record_batch([ids, text_hash, *keys, size, lists], names=names).filter(ids.is_valid())

    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric 0/1 matrix is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_of(texts: list[bytes], n: int, num: int, den: int) -> np.ndarray:
    """Symmetric matrix of the pairs with Jaccard similarity num/den or more on full n-gram sets."""
    s, doc = shingles(Words(texts), n)
    order = np.lexsort((doc, s))
    s, doc = s[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[first], doc[first]
    m = len(texts)
    size = np.bincount(doc, minlength=m)
    column = np.cumsum(np.diff(s, prepend=s[:1] - np.uint64(1)) != 0) - 1 if len(s) else s.astype(np.int64)
    many = np.bincount(column)[column] > 1 if len(s) else np.zeros(0, bool)
    column, doc = column[many], doc[many]
    both = np.zeros((m, m), np.float64)
    while len(column):
        stop = np.searchsorted(column, column[0] + COLUMNS)
        part = np.zeros((m, COLUMNS), np.float32)
        part[doc[:stop], column[:stop] - column[0]] = 1
        both += part @ part.T
        column, doc = column[stop:], doc[stop:]
    both = np.rint(both).astype(np.int64)
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    linked &= (size[:, None] > 0) & (size[None, :] > 0)
    np.fill_diagonal(linked, False)
    return linked


def _verify(n: int, threshold: Fraction):
    """Rows sorted by (component, i, j) to (doc_id, links, root) of each pair of blocks."""
    names = ["doc_id", "links", "root"]

    def judged(rows, across):
        ids = np.array([r[0] for r in rows], np.int64)
        weight = np.array([r[1] for r in rows], np.int64)
        block = np.array([r[2] for r in rows])
        linked = links_of([r[3] for r in rows], n, threshold.numerator, threshold.denominator)
        if across:  # told by the task: one of its two blocks may be empty
            linked &= block[:, None] != block[None, :]
        links = linked @ weight
        hit = np.flatnonzero(links)
        return ids[hit], links[hit], ids[_roots(linked)[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []

        def flush():
            parts = [np.concatenate(x) for x in zip(*out)]
            out.clear()
            return pa.record_batch([pa.array(x.astype(np.int64)) for x in parts], names=names)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j"))))
            texts = batch.column("text").cast(pa.large_binary())
            ids, weight, block = (batch.column(c).to_pylist() for c in ("doc_id", "copies", "block"))
            for k, key in enumerate(keys):
                if key != group:
                    if len(rows) > 1:
                        out.append(judged(rows, group[1] != group[2]))
                    group, rows = key, []
                rows.append((ids[k], weight[k], block[k], texts[k].as_py() or b""))
            if sum(len(x[0]) for x in out) > 1000:
                yield flush()
        if len(rows) > 1:
            out.append(judged(rows, group[1] != group[2]))
        if out:
            yield flush()

    return run


def similarity_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per document id: doc_id, class_id, n_links, copy_id.

    ``class_id`` is the smallest document of its near-duplicate group, ``copy_id`` the smallest document with the same
    words, and ``n_links`` the number of other rows with similarity ``threshold`` or more, copies included. A text
    without words (null, empty, spaces) has no n-grams, no links, and is its own class. Rows without an id are left
    out, for nothing could name them. Rows that repeat an id and its text count as copies of each other; the id comes
    once. Of rows that repeat an id with other texts only those with the smallest text hash are compared. Other columns are
    not looked at.
    """
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    known = written(source.mapInArrow(_signatures(n, bands, rows), "doc_id long, text_hash long, key1 long, key2 long, size long, bands array<long>"), "signatures")
    # a row of each id: that of the smallest text hash, with the number of rows that have it
    row = known.groupBy("doc_id", "text_hash").agg(*[F.min(c).alias(c) for c in ("key1", "key2", "size")], F.count(F.lit(1)).alias("rows"))
    row = row.groupBy("doc_id").agg(*[F.min_by(c, "text_hash").alias(c) for c in ("key1", "key2", "size", "rows")], F.min("text_hash").alias("text_hash"))
    row = written(row, "rows_of_ids")
    classes = row.groupBy("key1", "key2").agg(F.min("doc_id").alias("copy_id"), F.sum("rows").alias("copies"), F.max("size").alias("size"))
    # written, so that the join has two plain exchanges and a class of very many copies can be split
    classes = written(classes, "classes")
    member = written(row.select("doc_id", "text_hash", "key1", "key2").join(classes, ["key1", "key2"]).select("doc_id", "text_hash", "copy_id", "copies", "size"), "members")
    first = member.where("doc_id = copy_id").select("doc_id", "text_hash", "copies", "size")
    bucket = written(known.join(first.select("doc_id", "text_hash"), ["doc_id", "text_hash"]).select("doc_id", F.explode("bands").alias("bucket")).distinct(), "buckets")
    hubs = bucket.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    stars = bucket.join(hubs, "bucket").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    label = components(stars)
    label = label.join(first.withColumnRenamed("doc_id", "node"), "node")  # of each candidate
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int")
    placed = (
        label.join(label.groupBy("label").agg(blocks.alias("n_blocks")), "label")
        .select(F.col("node").alias("doc_id"), "text_hash", F.col("label").alias("component"), "copies", "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"))
    )
    tasks = (
        source.join(placed, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
        .select("doc_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "copies", "block", "text")
    )
    keys = ["component", "i", "j"]
    checked = written(
        tasks.repartition(*keys).sortWithinPartitions(*keys, "doc_id")
        .mapInArrow(_verify(n, Fraction(threshold).limit_denominator(10**6)), "doc_id long, links long, root long"),
        "verified",
    )
    links = checked.groupBy("doc_id").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    linked = links.join(groups, F.col("doc_id") == F.col("node")).select(F.col("doc_id").alias("copy_id"), "links", "label")
    found = member.join(linked, "copy_id", "left").select(
        "doc_id", F.coalesce("label", "copy_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copy_id"
    )
    ids = source.select("doc_id").distinct()
    return ids.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id; its columns are untouched.

    Rows without an id stay, as nothing is known of them. Of rows that repeat an id one stays, by the hash of its text and
    then of its other columns (maps aside), so every run keeps the same.
    """
    kept = similarity_groups(docs, id_col, text_col, **options).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id"))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = whole(docs, id=F.col(id_col).cast("long"), text_hash=F.xxhash64(text_col), row_hash=F.xxhash64(*plain))
    named = rows.join(kept, F.col("id") == F.col("kept_id"))
    again = Window.partitionBy("id").orderBy("text_hash", "row_hash")
    one = named.withColumn("again", F.row_number().over(again)).where("again = 1").select("row.*")
    return one.unionByName(docs.where(F.col(id_col).isNull()))
