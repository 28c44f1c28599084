"""Language ID: string kernels, Nystroem landmarks, kernel ridge regression.

The blended-spectrum presence kernel of two texts is, for n = 1 to 4, the
number of byte n-grams present in both over the geometric mean of their
numbers, averaged over n. Landmark texts give each text a short Nystroem
vector; one-versus-rest ridge regression on these vectors is a linear function
of kernel values to landmarks. Since a kernel value is itself an inner product
of presence vectors, landmarks and coefficients fold into one matrix a gram
length, and scoring a batch is a presence matrix times that matrix.

N-grams are told apart by 8 to 13 bits of a hash (all single bytes exactly), so
that rare ones may share a column. Fitted on a sample of all labelled languages,
at most ``PER_LANGUAGE`` texts each and about ``SAMPLE`` in all; the sample's
kernel values are summed up batch by batch. Whole texts are fitted and scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.folds import FIT_CHARS, held_out, sample_texts
from lodestar.llm.tokens import MARKS, pieces, utf8
from lodestar.session import materialise, small_batches

PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE = 300, 20_000, 256, 1e-2
#: Rows picked by hash a language, over what is wanted, before the exact choice.
SPARE = 4
BROADCAST_LANGUAGES = 100_000
BITS = (8, 12, 13, 13)  # of the hash of an n-gram, n = 1 to 4
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
CHUNK, ROWS = 2 << 20, 512
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[MARKS] = 32
_FOLD[48:58] = 32
_FOLD[65:91] += 32
UNKNOWN = "und"


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix: rows are texts, columns hashed n-grams."""
    n = len(offsets) - 1
    out = np.zeros((n, OFFSETS[-1]), np.uint8)
    flat = out.reshape(-1)
    b = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * OFFSETS[-1], np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    code = b.copy()
    for k, bits in enumerate(BITS):
        m = len(b) - k
        if m <= 0:
            break
        if k:
            code = code[:m] * np.uint32(0x01000193) ^ (b[k:] + np.uint32(1))
        inside = np.arange(m) + k < end[:m] if k else slice(None)
        slot = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - bits) if k else code
        flat[row[:m][inside] + OFFSETS[k] + slot] = 1
    return out


def scaled(p: np.ndarray) -> np.ndarray:
    """Presence rows divided so that inner products are kernel values."""
    x = p.astype(np.float32)
    for a, b in zip(OFFSETS[:-1], OFFSETS[1:], strict=True):
        x[:, a:b] /= np.sqrt(np.maximum(x[:, a:b].sum(1, keepdims=True), 1) * len(BITS))
    return x


@dataclass
class Model:
    languages: list[str]
    #: Kernel values to landmarks, then languages; one matrix where that is the smaller.
    weights: tuple[np.ndarray, ...]
    bias: np.ndarray
    sharpness: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = x @ w
        return x + self.bias


def train(labels: list[str], texts: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], (), np.zeros(0), 1.0)
    number = {k: i for i, k in enumerate(languages)}
    truth = np.array([number[v] for v in labels])
    # landmarks take turns among the languages
    order = np.argsort(truth, kind="stable")
    turn = np.empty(len(labels), np.int64)
    size = np.bincount(truth)
    turn[order] = np.arange(len(labels)) - np.repeat(np.cumsum(size) - size, size)
    of_text = lambda part: scaled(presence(*utf8(pa.array(part, pa.string()))))
    mark = of_text([texts[i] for i in np.argsort(turn, kind="stable")[:landmarks]])
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(float))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    # only the texts' short vectors are kept, not their presence
    phi = np.concatenate([(of_text(texts[i : i + ROWS // 4]) @ mark.T).astype(float) @ root for i in range(0, len(texts), ROWS // 4)])
    mean_x, mean_y = phi.mean(0), 2 * size / len(labels) - 1
    w = len(labels) / (len(languages) * size[truth])[:, None]
    c = phi - mean_x
    right = np.stack([2 * (w * c)[truth == k].sum(0) for k in range(len(languages))], 1) - (w * c).T @ np.ones((len(labels), 1)) * (1 + mean_y)
    beta = np.linalg.solve(c.T @ (w * c) + ridge * len(labels) * np.eye(c.shape[1]) / 10, right)
    bias = mean_y - mean_x @ beta
    s = phi @ beta + bias

    def loss(k):
        e = k * s - (k * s).max(1, keepdims=True)
        return -(e[np.arange(len(e)), truth] - np.log(np.exp(e).sum(1))).mean()

    near = (mark.T @ root).astype(np.float32)
    weights = (near, beta.astype(np.float32)) if len(languages) > near.shape[1] else ((near @ beta.astype(np.float32)),)
    return Model(languages, weights, bias, min((0.5, 1, 2, 3, 4, 6, 8, 12), key=loss))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, chars: int = FIT_CHARS) -> Model:
    """Learn from a sample of labelled rows that are not held out, least hash first, ``chars`` characters together.

    Languages are counted, and each gets a bound on the hash of the id below
    which about ``SPARE`` times the wanted texts lie; what passes is small.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id), 4, 2))
    known = known.select(F.col(doc_id).alias("id"), F.col(lang).alias("label"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 31)).alias("h"))
    counts = materialise(known.groupBy(F.col("label").alias("c_label")).agg(F.count("*").alias("c")), "langid-counts")
    languages = counts.count()
    quota = max(1, min(per_language, sample // max(languages, 1)))
    counts = counts.select("c_label", (F.lit(float(quota * SPARE)) / F.col("c") * (1 << 31)).alias("bound"))
    counts = F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts
    picked = known.join(counts, (F.col("label") == F.col("c_label")) & (F.col("h") < F.col("bound"))).select("label", "h", "id").distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    return train(*sample_texts(docs, picked.withColumn("nth", nth).where(F.col("nth") <= quota).groupBy("id").agg(F.min("label").alias("label")), doc_id, text, chars))


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offsets = utf8(column)
    ascii_letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_FOLD[data] != 32) & (data < 128), out=ascii_letters[1:])
    plain = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    langs, best = [], np.zeros(len(column))
    for i in range(0, len(column), ROWS):
        o = offsets[i : i + ROWS + 1]
        if model.languages:
            s = model.margins(scaled(presence(data[o[0] : o[-1]], o - o[0])))
            e = np.exp(model.sharpness * (s - s.max(1, keepdims=True)))
            e /= e.sum(1, keepdims=True)
        for j in range(len(o) - 1):
            letters = plain[i + j] or any(map(str.isalpha, data[o[j] : o[j + 1]].tobytes().decode()))
            if letters and model.languages:
                k = int(np.argmax(e[j]))
                langs.append(model.languages[k])
                best[i + j] = e[j, k]
            else:
                langs.append(UNKNOWN)
    return langs, best


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """Per row ``doc_id, held_out, lang_pred, score``.

    Texts that are null or have no letter are ``und`` with score 0, as are all
    if nothing is labelled; repeated rows each get their row; an empty table
    gives no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, doc_id, text, **params)

    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            langs, best = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), 4, 2).alias("held_out"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
