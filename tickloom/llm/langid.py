"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (byte-level, so that every text has a segmentation). Each language has
one probability for each piece; the probability of a word is the sum, over all its segmentations, of the products of
their pieces, which a forward pass over the word gives. A text scores the sum of its words' logarithms.

1. Words of the training rows are counted for each language by one distributed aggregate.
2. Probabilities start equal; each round of expectation-maximisation runs forward and backward over the distinct words of each
   language where they lie, and brings together expected counts of pieces: languages x pieces, whatever the number of rows.
3. Texts are scored where they lie: distinct words of a batch once for all languages, by columns of equal place.

Words are runs of letters and marks in lower case; a longer run than ``MAX_BYTES`` is cut. Nothing else of a text is looked at.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

ROUNDS = 3
#: Share of each distribution spread evenly over all pieces; keeps a word of ``MAX_BYTES`` above the smallest double.
FLOOR = 1e-3
MAX_BYTES = 32
#: The model holds languages x pieces numbers in each task; more labels than this are refused, not cut.
MAX_LANGUAGES = 512
UNDETERMINED = "und"
CHUNK_BYTES = 8 << 20
_CELLS = 1 << 16


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file (lines of base64 and a number) that lower-case words can hold: an optional space, then no other ASCII than a-z."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    fits = lambda p: bool(p) and all(97 <= c <= 122 or c >= 128 for c in (p[1:] if p[:1] == b" " else p))
    single = {bytes([c]) for c in (32, *range(97, 123), *range(128, 256))}
    return sorted({p for p in pieces if fits(p) and len(p) <= MAX_BYTES + 1} | single)


class Pieces:
    """The vocabulary as a trie in arrays: ``child[node, class of byte]`` and ``piece[node]``, both -1 where there is none."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        used = sorted({c for p in pieces for c in p})
        self.of_byte = np.zeros(256, np.intp)  # class 0 has no children
        self.of_byte[used] = np.arange(1, len(used) + 1)
        nodes, piece = {b"": 0}, [-1]
        for i, p in enumerate(pieces):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(piece)
                    piece.append(-1)
            piece[nodes[p]] = i
        self.piece = np.array(piece, np.int32)
        self.child = np.full((len(piece), len(used) + 1), -1, np.int32)
        for text, node in nodes.items():
            if text:
                self.child[nodes[text[:-1]], self.of_byte[text[-1]]] = node


_tries: dict[int, tuple[list[bytes], Pieces]] = {}


def trie(pieces: list[bytes]) -> Pieces:
    """The trie of ``pieces``, built once in each worker."""
    key = hash(tuple(pieces))
    if key not in _tries or _tries[key][0] != pieces:
        _tries.clear()
        _tries[key] = (pieces, Pieces(pieces))
    return _tries[key][1]


def _columns(words: pa.Array, at: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(classes, sizes): row per word with a space before it, byte classes in columns, 0 beyond its end."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(words), int(sizes.max(initial=0)) + 1), np.intp)
    out[:, 0] = at.of_byte[32]
    row = np.repeat(np.arange(len(words)), sizes)
    column = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes) + 1
    out[row, column] = at.of_byte[data[offsets[0] : offsets[-1]]]
    return out, sizes + 1


def _edges(classes: np.ndarray, sizes: np.ndarray, at: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, pieces): the rows whose columns start..end are a piece; starts ascend."""
    for start in range(classes.shape[1]):
        rows = np.flatnonzero(sizes > start)
        node = np.zeros(len(rows), np.intp)
        for end in range(start + 1, classes.shape[1] + 1):
            node = at.child[node, classes[rows, end - 1]]
            alive = node >= 0
            if not alive.all():
                rows, node = rows[alive], node[alive]
            if not len(rows):
                break
            piece = at.piece[node]
            hit = piece >= 0
            if hit.any():
                yield start, end, rows[hit], piece[hit]


def word_scores(words: pa.Array, at: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-probability of each word (rows) in each language (columns); ``p`` is pieces x languages."""
    out = np.empty((len(words), p.shape[1]))
    step = max(64, _CELLS // p.shape[1])
    for i in range(0, len(words), step):
        classes, sizes = _columns(words.slice(i, step), at)
        forward = np.zeros((classes.shape[1] + 1, len(sizes), p.shape[1]))
        forward[0] = 1
        for start, end, rows, piece in _edges(classes, sizes, at):
            forward[end, rows] += forward[start, rows] * p[piece]
        out[i : i + step] = np.log(forward[sizes, np.arange(len(sizes))])
    return out


def expected_counts(words: pa.Array, weight: np.ndarray, at: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected number of times that each piece is used in the segmentations of the words; ``p`` is that of one language."""
    out = np.zeros(at.n)
    for i in range(0, len(words), _CELLS):
        classes, sizes = _columns(words.slice(i, _CELLS), at)
        every = np.arange(len(sizes))
        forward = np.zeros((classes.shape[1] + 1, len(sizes)))
        forward[0] = 1
        edges = []
        for start, end, rows, piece in _edges(classes, sizes, at):
            forward[end, rows] += forward[start, rows] * p[piece]
            edges.append((start, end, rows, piece))
        backward = np.zeros_like(forward)
        backward[sizes, every] = weight[i : i + _CELLS] / forward[sizes, every]
        for start, end, rows, piece in reversed(edges):
            through = p[piece] * backward[end, rows]
            backward[start, rows] += through
            out += np.bincount(piece, through * forward[start, rows], at.n)
    return out


_kinds: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark, 0 neither."""
    if not _kinds:
        of = {"L": 2, "M": 1}
        _kinds.append(np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000))
    return _kinds[0]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, doc, has_letter): lower-case words of all texts in order, the text each is in, and whether a text has a letter."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _letters()
    kind = np.where(data < 128, kinds[np.minimum(data, 127)], 0)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & (0x3F >> more)
        for k in (1, 2, 3):
            has = more >= k
            point[has] = point[has] << 6 | data[lead[has] + k] & 0x3F
        found = kinds[point]
        kind[lead] = found
        for k in (1, 2, 3):
            has = more >= k
            kind[lead[has] + k] = found[has]
    inside = kind > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = last - first
    doc = np.searchsorted(offsets, first, "right") - 1
    has_letter = np.zeros(len(low), bool)
    if len(first):
        has_letter[doc[np.maximum.reduceat(kind, first) == 2]] = True
    parts = -(-size // MAX_BYTES)
    if len(parts) and parts.max() > 1:
        doc, whole, nth = np.repeat(doc, parts), np.repeat(size, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(whole - nth * MAX_BYTES, MAX_BYTES)
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))]), doc, has_letter


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``CHUNK_BYTES`` of text each; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            words, doc, _ = split_words(part.column("text"))
            if not len(words):
                continue
            found, langs = words.dictionary_encode(), part.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)[doc] * len(found.dictionary) + found.indices.to_numpy()
            code, n = np.unique(code, return_counts=True)
            lang, word = np.divmod(code, len(found.dictionary))
            columns = [langs.dictionary.take(pa.array(lang)), found.dictionary.take(pa.array(word)), pa.array(n.astype(np.int64))]
            yield pa.record_batch(columns, names=["lang", "word", "n"])


def _expect(pieces: list[bytes], langs: list[str], p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mass = trie(pieces), np.zeros((len(langs), len(pieces)))
        for batch in batches:
            of = pc.index_in(batch.column("lang"), pa.array(langs)).to_numpy()
            for i in np.unique(of):
                own = batch.filter(pa.array(of == i))
                words = pa.concat_arrays([own.column("word").cast(pa.binary())])
                mass[i] += expected_counts(words, own.column("n").to_numpy().astype(float), at, p[:, i])
        lang, piece = np.nonzero(mass)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(mass[lang, piece])], names=["lang", "piece", "mass"])

    return run


class Model:
    """Pieces, languages, probabilities (pieces x languages) and log-priors."""

    def __init__(self, pieces: list[bytes], langs: list[str], p: np.ndarray, prior: np.ndarray):
        self.pieces, self.langs, self.p, self.prior = pieces, langs, p, prior


def fit(docs: DataFrame, pieces: list[bytes], text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, floor: float = FLOOR) -> Model:
    """A model of all rows of ``docs`` with a language; null and empty texts count for the priors only. No rows give no languages."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    counts = labelled.mapInArrow(_count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word_counts")
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    langs = sorted(rows)
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds if langs else 0):
        told = counts.mapInArrow(_expect(pieces, langs, p), "lang int, piece int, mass double").groupBy("lang", "piece").agg(F.sum("mass").alias("mass")).toArrow()
        mass = np.zeros_like(p)
        mass[told["piece"].to_numpy(), told["lang"].to_numpy()] = told["mass"].to_numpy()
        p = (1 - floor) * mass / np.maximum(mass.sum(0), 1e-300) + floor / len(pieces)
    return Model(pieces, langs, p, np.log([rows[x] for x in langs]) - np.log(max(1, sum(rows.values()))))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names = trie(model.pieces), np.array([*model.langs, UNDETERMINED], object)
        for batch in batches:
            for part in _slices(batch):
                words, doc, known = split_words(part.column("text"))
                known &= len(model.langs) > 0
                best, score = np.full(len(known), len(model.langs)), np.zeros(len(known))
                if known.any():
                    found = words.dictionary_encode()
                    each, of = word_scores(found.dictionary, at, model.p), found.indices.to_numpy()
                    total = np.stack([np.bincount(doc, each[of, i], len(known)) for i in range(each.shape[1])], 1) + model.prior
                    share = np.exp(total - total.max(1, keepdims=True))
                    share /= share.sum(1, keepdims=True)
                    best[known] = share.argmax(1)[known]
                    score[known] = share.max(1)[known]
                yield pa.record_batch([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, repeated rows and rows without an id too.

    ``score`` is the posterior of the predicted language. Null texts and texts without a letter are ``und`` with score 0, as
    are all texts if the model has no language; between equal scores the first language by name wins.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text leaves 2 modulo 4. A row without an id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted_languages(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out and have an id, told for all rows."""
    learn = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    model = fit(learn, vocabulary(path), text_col, lang_col, **options)
    return identify(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
