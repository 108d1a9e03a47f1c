"""Quality classifier from weak labels: heuristics vote, expectation-maximisation weighs them, a hashed linear model scores.

1. Eight heuristic labellers look at every document and vote junk, good, or abstain. A document's votes are one of
   3^8 patterns, so all the corpus says about the labellers is a table of pattern counts of bounded size.
2. EM over that table (the model of Dawid and Skene, with good text and several kinds of junk as classes) estimates
   how each labeller votes on each class, and gives each pattern its probability of being good.
3. Those posteriors are the soft labels of a logistic model over hashed character trigrams and word-shape pairs. It is
   fitted on a bounded sample (``TRAINING_ROWS``), in one task, and then scores every document in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import Words, chunks

#: Documented bound of the rows the linear model is fitted on; labels and label model use all rows.
TRAINING_ROWS = 6000
TRIGRAMS = 1 << 15
SHAPES = 8
FEATURES = TRIGRAMS + SHAPES * SHAPES
EPOCHS = 200
RATE = 1.0
LABELLERS = ("symbols", "lone_symbols", "capitals", "exclamations", "stutter", "variety", "plain_words", "sentences")
ABSTAIN, GOOD, JUNK = 0, 1, 2
PATTERNS = 3 ** len(LABELLERS)

_kind = np.zeros(256, np.uint8)
_kind[list(b"#*$%&|<>^~=_{}[]\\@+")] = 1
_kind[list(range(65, 91))] = 2
_kind[list(range(97, 123))] = 3


def _per(values: np.ndarray, words: Words) -> np.ndarray:
    """Sums of one value per word over each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[words.first[1:]] - total[words.first[:-1]]


class Page:
    """Character and word facts of a run of texts."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.begin = self.ends - np.diff(self.ends, prepend=0)
        self.words = w = Words(texts)
        kind = _kind[self.buf]
        per_word = lambda hit: np.add.reduceat(hit, w.starts, dtype=np.int64)[: len(w.starts)] if len(w.starts) else np.zeros(0, np.int64)
        # what lies between two words is white space, which is none of these
        self.symbols, self.upper, self.lower, self.bangs = (per_word(x) for x in (kind == 1, kind == 2, kind == 3, self.buf == ord("!")))
        self.length = w.ends - w.starts
        self.again = np.zeros(len(w.hash), bool)
        self.again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        last = self.buf[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
        self.stop = last == ord(".")

    def votes(self) -> np.ndarray:
        """One row of votes per text; a text of under five words gets abstentions only."""
        w = self.words
        n = np.maximum(w.counts, 1).astype(np.float64)
        size = np.maximum(_per(self.length, w), 1)
        letters = _per(self.upper + self.lower, w)
        order = np.lexsort((w.hash, w.doc))
        new = np.ones(len(order), bool)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
        distinct = np.bincount(w.doc[order][new], minlength=w.n_texts) / n
        seen = w.counts >= 5
        symbols = _per(self.symbols, w) / size
        lone = _per(self.symbols == self.length, w) / n
        caps = _per(self.upper, w) / np.maximum(letters, 1)
        bangs = _per(self.bangs, w) / n
        stutter = _per(self.again, w) / n
        plain = _per((self.symbols == 0) & (self.bangs == 0) & (self.length < 40), w) / n
        stops = _per(self.stop, w)
        choose = lambda junk, good: np.where(junk, JUNK, np.where(good, GOOD, ABSTAIN))
        out = np.stack(
            [
                choose(symbols > 0.05, symbols < 0.01),
                choose(lone > 0.1, lone == 0),
                np.where(letters < 10, ABSTAIN, choose(caps > 0.5, caps < 0.2)),
                choose(bangs > 0.3, bangs < 0.1),
                choose(stutter > 0.2, stutter < 0.05),
                np.where(w.counts < 20, ABSTAIN, choose(distinct < 0.25, distinct > 0.4)),
                choose(plain < 0.6, plain > 0.9),
                np.where(w.counts < 30, ABSTAIN, choose(stops == 0, (stops > 0) & (stops < n / 3))),
            ],
            axis=1,
        )
        out[~seen] = ABSTAIN
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, text, weight): trigram and shape-pair frequencies before summing equal features."""
        b = self.buf.astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        doc = np.searchsorted(self.ends, np.arange(len(code)), side="right")
        inside = np.arange(len(code)) + 2 < self.ends[doc] - 1
        code, doc = code[inside].astype(np.int64), doc[inside]
        grams = np.bincount(doc, minlength=len(self.ends))
        w = self.words
        shape = self.again * 1 + (self.symbols > 0) * 2 + ((self.upper > 1) & (self.lower == 0)) * 4
        pair = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(w.doc) else np.zeros(0, np.int64)
        shapes = TRIGRAMS + shape[pair] * SHAPES + shape[pair + 1]
        pairs = np.bincount(w.doc[pair], minlength=w.n_texts)
        weight = np.concatenate((1 / grams[doc], 1 / pairs[w.doc[pair]]))
        return np.concatenate((code, shapes)), np.concatenate((doc, w.doc[pair])), weight


@dataclass(frozen=True)
class LabelModel:
    """Latent classes: 0 is good text, class k + 1 the kind of junk that labeller k was written for.

    ``share`` of each class; ``vote[k, c, v]``: how often labeller k, when it does not abstain, votes v on class c.
    """

    share: np.ndarray
    vote: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.share)[None, :] + sum(np.log(self.vote[k][:, votes[:, k]]).T for k in range(len(LABELLERS)))
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.classes(votes)[:, 0]

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each labeller: how often it says junk of junk, and good of good, when it votes."""
        junk = self.share[1:] / self.share[1:].sum()
        return {name: (float(junk @ self.vote[k, 1:, JUNK]), float(self.vote[k, 0, GOOD])) for k, name in enumerate(LABELLERS)}


def unpack(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3**k % 3 for k in range(len(LABELLERS))], axis=1)


def fit_labels(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over distinct vote patterns with their counts.

    Labellers are independent within a class. Junk comes in kinds that only some labellers notice, so each labeller
    starts with a junk class of its own; two classes alone would split the corpus by its commonest kind of junk.
    """
    votes, k = unpack(pattern), len(LABELLERS)
    says = (votes == JUNK).astype(np.float64)
    any_junk = says.sum(axis=1, keepdims=True)
    own = np.where(any_junk > 0, says / np.maximum(any_junk, 1), 1 / k)
    good = np.where(any_junk > 0, 0.05, 0.95)
    at = np.concatenate([good, (1 - good) * own], axis=1)
    for _ in range(rounds):
        weight = at * count[:, None]
        share = (weight.sum(axis=0) + 0.01) / (weight.sum() + 0.01 * (k + 1))
        vote = np.ones((k, k + 1, 3))
        for i in range(k):
            cast = np.stack([((votes[:, i] == v)[:, None] * weight).sum(axis=0) for v in (GOOD, JUNK)], axis=1) + 0.5
            vote[i, :, 1:] = cast / cast.sum(axis=1, keepdims=True)
        model = LabelModel(share, vote)
        new = model.classes(votes) if len(votes) else at
        if np.abs(new - at).max(initial=0) < 1e-9:
            break
        at = new
    return model


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PATTERNS, np.int64)
    for _, texts in chunks(batches):
        total += np.bincount(Page(texts).votes() @ 3 ** np.arange(len(LABELLERS)), minlength=PATTERNS)
    at = np.flatnonzero(total)
    if len(at):
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pattern", "n"])


def label_model(docs: DataFrame, text_col: str = "text") -> LabelModel:
    """Accuracies of the labellers, estimated from the votes on all rows."""
    table = docs.select(F.col(text_col).alias("text")).mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    rows = sorted((r["pattern"], r["n"]) for r in table.collect())  # at most 3^8 rows
    pattern = np.array([p for p, _ in rows], np.int64)
    return fit_labels(pattern, np.array([n for _, n in rows], np.float64))


def _examples(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            page = Page(texts)
            good = model.posterior(page.votes())
            feature, doc, weight = page.features()
            key, at = np.unique(doc * FEATURES + feature, return_inverse=True)
            value = np.bincount(at, weights=weight, minlength=len(key))
            bounds = np.searchsorted(key // FEATURES, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.record_batch(
                [batch.column("key"), pa.array(good), pa.ListArray.from_arrays(bounds, pa.array((key % FEATURES).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32)))],
                names=["key", "good", "feature", "value"],
            )

    return run


def _fit(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            yield pa.record_batch([pa.array([np.zeros(FEATURES + 1).tobytes()], pa.binary())], names=["weights"])
            return
        table = pa.Table.from_batches(got).sort_by([("key", "ascending"), ("good", "ascending")]).combine_chunks()
        good = table["good"].to_numpy()
        feature, value = (table[c].combine_chunks() for c in ("feature", "value"))
        n = feature.value_lengths().to_numpy()
        feature, value = feature.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64)
        row = np.repeat(np.arange(len(good)), n)
        # both kinds of frequencies at a length near 1, and each class with the same weight
        scale = np.where(np.arange(FEATURES) < TRIGRAMS, 5.0, 1.0)
        value *= scale[feature]
        share = float(np.clip(good.mean(), 0.02, 0.98))
        weight = good / (2 * share) + (1 - good) / (2 * (1 - share))
        w, bias = np.zeros(FEATURES), 0.0
        step, before = np.zeros(FEATURES), 0.0
        for _ in range(epochs):
            z = np.clip(np.bincount(row, weights=value * w[feature], minlength=len(good)) + bias, -30, 30)
            err = weight * (1 / (1 + np.exp(-z)) - good) / len(good)
            step = 0.9 * step + np.bincount(feature, weights=value * err[row], minlength=FEATURES) + 1e-5 * w
            before = 0.9 * before + err.sum()
            w, bias = w - RATE * step, bias - RATE * before
        yield pa.record_batch([pa.array([np.append(w * scale, bias).tobytes()], pa.binary())], names=["weights"])

    return run


def linear_scorer(docs: DataFrame, model: LabelModel, id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights of the hashed features, and the bias last; an empty table gives zeros."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    total = docs.count()
    edge = int(min(1.0, 1.2 * training_rows / max(total, 1)) * 2**31)
    sample = docs.select(key.alias("key"), F.col(text_col).alias("text")).where(F.pmod("key", F.lit(2**31)) < edge)
    rows = sample.mapInArrow(_examples(model), "key long, good double, feature array<int>, value array<float>").orderBy("key").limit(training_rows)
    return np.frombuffer(rows.repartition(1).mapInArrow(_fit(EPOCHS), "weights binary").first()["weights"])


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    feature, doc, weight = Page(texts).features()
    return np.bincount(doc, weights=weight * weights[feature], minlength=len(texts)) + weights[-1]


def _score(model: LabelModel, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            votes = Page(texts).votes()
            z = scores(texts, weights)
            kept = (z > 0) | (votes == ABSTAIN).all(axis=1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.posterior(votes)), pa.array(z), pa.array(kept)], names=["doc_id", "posterior", "score", "kept"])

    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, posterior (label model), score (linear model, over 0 is good), kept.

    Null, empty and very short texts (under five words) give the labellers nothing to judge and are kept. Equal texts get
    equal scores. Other columns are not looked at.
    """
    model = label_model(docs, text_col)
    weights = linear_scorer(docs, model, id_col, text_col, training_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model, weights), f"doc_id {docs.schema[id_col].dataType.simpleString()}, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns as they are; no shuffle."""
    model = label_model(docs, text_col)
    weights = linear_scorer(docs, model, id_col, text_col, training_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text_col):
            kept = (scores(texts, weights) > 0) | (Page(texts).votes() == ABSTAIN).all(axis=1)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
