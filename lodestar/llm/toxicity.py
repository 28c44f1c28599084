"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(b + sum of the
weights of its words and their beginnings); the document scores the noisy-or of its sentences, 1 -
prod(1 - p), and only documents carry labels. The gradient of the document's
likelihood reaches each sentence in proportion to its share, so the model
learns which sentences offend and can point at them.

With s the sum of the weights, a sentence of s <= ``TELLING`` has probability zero and
another one 1 - (1 - sigmoid(b + s)) / (1 - sigmoid(b)): sentences without
telling words add nothing, however many. Labels that the words do not explain
go to one leak a document, which takes part in fitting only.

The model is fitted on at most ``SAMPLE`` labelled documents (least hash of id
first) of ``folds.FIT_CHARS`` characters together, all whole, over all features;
an l1 penalty leaves most of them at zero. Scoring runs in Arrow batches with a
broadcast weight vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.folds import FIT_CHARS, held_out, sample_column
from lodestar.llm.rows import packed, row_type, unpacked
from lodestar.llm.tokens import MARKS, Words, codepoints, pieces
from lodestar.session import small_batches

SAMPLE, FEATURE_BITS, THRESHOLD = 8_000, 18, 0.3
#: The bias starts no lower, so that long texts teach too.
LEAST_BIAS = -4.0
#: A word counts as itself and as its first so many bytes.
PREFIXES = (5, 6, 7, 8)
#: Weight of the penalty that keeps most features at zero: of 1, 2 and 5e-4 that of least log loss in three folds of training rows.
L1 = 2e-4
#: Weights of a sentence up to this sum tell nothing, however many such sentences there are.
TELLING = 1.0
CHUNK = 1 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Fitted to one label only: every sentence has the probability of the bias.
    constant: bool = False


class Bags:
    """Word features by sentence by document."""

    def __init__(self, column: pa.Array, bits: int = FEATURE_BITS, named: bool = False):
        w = Words(column, lower=True, breaks=MARKS)
        self.words = w
        hashed = w.features(*PREFIXES)
        self.name = hashed[0].copy() if named else None
        hashed >>= np.uint64(64 - bits)
        self.feature = hashed.view(np.int64)
        size = w.end - w.start
        self.own = [size >= 0, *(size > k for k in PREFIXES)]  # shorter words have no such beginning
        ends = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_ENDS[w.data], out=ends[1:])
        n = len(column)
        doc = np.repeat(np.arange(n), np.diff(w.first))
        part = ends[w.start]
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
        self.head = np.flatnonzero(new)  # first word of each sentence
        self.of = doc[self.head]  # document of each sentence
        self.n = n

    def logits(self, m: Model) -> np.ndarray:
        if not len(self.head):
            return np.zeros(0)
        by_word = np.zeros(self.feature.shape[1], np.float32)
        for f, own in zip(self.feature, self.own, strict=True):
            by_word += np.where(own, m.weights[f], 0)
        return m.bias + np.add.reduceat(by_word, self.head)

    def noisy_or(self, z: np.ndarray, m: Model) -> np.ndarray:
        s = np.logaddexp(0, z)
        if not m.constant:
            s = np.where(z > m.bias + TELLING, s - np.logaddexp(0, m.bias), 0)
        return -np.expm1(-np.bincount(self.of, s, self.n))


def _parts(sizes: np.ndarray, docs: int = 256, size: int = 1 << 18):
    """Ranges of at most ``docs`` texts and about ``size`` bytes (one text at least)."""
    i, held = 0, 0
    for j, n in enumerate(sizes.tolist()):
        if j > i and (j - i == docs or held + n > size):
            yield i, j
            i, held = j, 0
        held += n
    if len(sizes):
        yield i, len(sizes)


def _coded(texts: pa.Array, bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """((words by number, first word of each sentence) of each part, features of each distinct word, document of each sentence).

    A word is held as one number of four bytes, whatever its features; a beginning it does not have is feature 2^bits.
    """
    parts, owners, features = [], [np.zeros(0, np.int32)], [np.zeros((1 + len(PREFIXES), 0), np.int32)]
    every, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # distinct words so far, in order of name
    for i, j in _parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
        bags = Bags(texts.slice(i, j - i), bits, named=True)
        if not len(bags.head):
            continue
        name, first, code = np.unique(bags.name, return_index=True, return_inverse=True)
        at = np.searchsorted(every, name)
        new = (at == len(every)) | (np.append(every, np.uint64(0))[at] != name)
        fresh = np.arange(len(every), len(every) + new.sum(), dtype=np.int32)
        every, number = np.insert(every, at[new], name[new]), np.insert(number, at[new], fresh)
        own = first[new]
        features.append(np.where(np.stack(bags.own)[:, own], bags.feature[:, own], 1 << bits).astype(np.int32))
        parts.append((number[np.searchsorted(every, name)][code], bags.head.astype(np.int32)))
        owners.append((bags.of + i).astype(np.int32))
    return parts, np.concatenate(features, axis=1), np.concatenate(owners)


def train(labels: list[int], texts: list[str] | pa.Array, bits: int = FEATURE_BITS, steps: int = 200, rate: float = 0.1, l1: float = L1) -> Model:
    """Adam with soft thresholding over all features (most get weight zero); without both labels a constant model."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << bits, np.float32), -20.0 if len(y) == 0 or not y.max() else 20.0, True)
    parts, features, of = _coded(pa.array(texts, pa.string()), bits)
    n_s = len(of)
    # weights, bias, and the leak of a document: what the words do not explain, whatever its length
    theta = np.zeros((1 << bits) + 2)
    theta[-2] = max(np.log(y.mean() / max(n_s / len(y), 1)), LEAST_BIAS)
    theta[-1] = np.log(np.expm1(-np.log1p(-y.mean() / 2)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        weights, by_word = np.append(theta[:-2], 0), np.zeros(features.shape[1])
        for f in features:
            by_word += weights[f]
        b, over = theta[-2], np.concatenate([np.zeros(0), *(np.add.reduceat(by_word[code], head) for code, head in parts)])
        # the gate of scoring, raised once there are weights: in the beginning no sentence would pass it
        counts = over > TELLING * min(1.0, 4 * k / steps - 1) if 4 * k > steps else over >= 0
        z = np.where(counts, b + over, b)
        s = np.logaddexp(0, theta[-1]) + np.bincount(of, np.logaddexp(0, z) - np.logaddexp(0, b), len(y))
        to_s = np.where(y > 0, -1 / np.expm1(np.clip(s, 1e-9, 500)), 1.0) / len(y)
        p, p_0 = 1 / (1 + np.exp(-np.clip(z, -500, 500))), 1 / (1 + np.exp(-b))
        g_z = to_s[of] * p * counts
        grad, by_word, at = np.zeros_like(theta), np.zeros(features.shape[1]), 0
        for code, head in parts:
            by_word += np.bincount(code, np.repeat(g_z[at : at + len(head)], np.diff(np.append(head, len(code)))), len(by_word))
            at += len(head)
        for f in features:
            grad[:-2] += np.bincount(f, by_word, (1 << bits) + 1)[:-1]
        grad[-2:] = (to_s[of] * (p - p_0)).sum(), to_s.sum() / (1 + np.exp(-theta[-1]))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        size = rate / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        theta -= size * first / (1 - 0.9**k)
        theta[:-2] = np.sign(theta[:-2]) * np.maximum(np.abs(theta[:-2]) - size[:-2] * l1, 0)
    return Model(theta[:-2].astype(np.float32), float(theta[-2]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, chars: int = FIT_CHARS) -> Model:
    """Learn from at most ``sample`` labelled documents, ``chars`` characters together, whose id is not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id), 4, 2))
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    return train(*sample_column(docs, known, doc_id, text, chars))


def _score(model: Model, where: bool):
    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            bags = Bags(batch.column("text"), int(np.log2(len(model.weights))))
            z = bags.logits(model)
            score = bags.noisy_or(z, model)
            names = batch.schema.names
            cols = [c for c, n in zip(batch.columns, names, strict=True) if n != "text"]
            out = [pa.array(score)]
            if where:
                w, at = bags.words, codepoints(bags.words.data)
                bad = np.flatnonzero(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= THRESHOLD)
                last = np.append(bags.head[1:], len(w.start)) - 1
                base = at[w.offsets]
                spans: list[list[str]] = [[] for _ in range(bags.n)]
                for s in bad.tolist():
                    d = bags.of[s]
                    spans[d].append(f"{at[w.start[bags.head[s]]] - base[d]}:{at[w.end[last[s]]] - base[d]}")
                out.append(pa.array([",".join(x) for x in spans]))
            yield pa.RecordBatch.from_arrays([*cols, *out], [*(n for n in names if n != "text"), "score", *(["sentences"] if where else [])])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, sentences``.

    ``sentences`` lists offending sentences as start:end in code points. Texts
    without words, null included, score 0 and have none; repeated rows each get
    their row; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), 4, 2).alias("held_out"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    s = d.mapInArrow(_score(model, True), f"doc_id {kind}, held_out boolean, score double, sentences string")
    return s.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")


def report(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``fit`` then ``score``.

    Null labels and labels of null ids are not learnt; of labels that repeat an
    id the largest counts; without both labels every document gets the score of
    the one there is (0 without any).
    """
    return score(docs, fit(docs, labels, **params))


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, **params) -> DataFrame:
    """The documents that score below ``threshold``, unchanged, with all their columns.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, text=text, **params)
    rows = packed(docs, text=F.col(text))

    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            bags = Bags(batch.column("text"), int(np.log2(len(model.weights))))
            keep = bags.noisy_or(bags.logits(model), model) < threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], ["row"])

    kept = rows.mapInArrow(run, T.StructType([T.StructField("row", row_type(docs))]))
    return unpacked(kept, docs.columns)
