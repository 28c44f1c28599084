"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Every frequent word (``OWN`` of them, and the end of a text) is a symbol with
vectors of its own; other words share ``BUCKETS`` symbols by a hash of their
last two bytes, and a word then has its smoothed share of its symbol. The
log-bilinear model predicts a symbol from the two before it: their context
vectors, each scaled elementwise, are summed to q, and q meets the output
vectors. Symbols stand in classes of ``SLOTS``, by frequency, so that

    P(symbol | q) = P(class | q) P(slot | class, q),

both softmaxes over matrix products: token log-probabilities are normalised
over the whole vocabulary.

Word counts are Spark aggregates over all training texts. Training is Spark's
too: each task runs over all tokens of its own training texts with
noise-contrastive estimation in numpy (noise drawn for every batch of tokens:
classes by their frequency, slots evenly), starting from common vectors whose
biases are the log frequencies; a Spark aggregate then averages each row of
parameters over the tasks, weighed by how often a task met the row. What is
gathered thus grows with the corpus, while the model's size is fixed.

Scoring looks frequent words up in a broadcast table of at most ``HEAD``
words. The rest, rare by construction, travel as (word, document, times) rows
and are joined with their counts. Words are compared by their bytes throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.folds import held_out
from lodestar.llm.tokens import Words, mix64, pieces, utf8
from lodestar.session import materialise, small_batches

CLASSES, SLOTS, BUCKETS, HEAD, SIZE = 64, 96, 512, 1 << 17, 16
SYMBOLS = CLASSES * SLOTS
OWN = SYMBOLS - BUCKETS - 1
#: Noise classes and noise slots of a batch of ``BATCH`` tokens; the tokens a training task should have at least.
NOISE, NOISE_SLOTS, BATCH, TASK_TOKENS = 24, 4, 8192, 2_000_000
#: How often gradient steps visit a token: each once at least, and more often the fewer tokens there are.
LEAST_VISITS, MOST_VISITS = 1, 40
#: Bytes of text that a task handles at once; its arrays are many times as large.
CHUNK = 2 << 20
END = ""  # no word is empty
ALPHA = 0.1


def _inputs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    out = held_out(F.col(doc_id), 10, 0) | F.col(doc_id).isNull()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("mark"), out.alias("held_out"), t.alias("text"))


def _count(batches):
    for batch in pieces(batches, "text", CHUNK):
        codes, words = Words(batch.column("text"), lower=True).coded()
        n = np.bincount(codes, minlength=len(words))
        yield pa.RecordBatch.from_arrays([words.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows])], ["word", "c"])


def word_counts(inputs: DataFrame) -> DataFrame:
    """``word, c`` over the training texts; the end of a text is the empty word."""
    seen = inputs.where("not held_out").select("text").mapInArrow(_count, "word string, c long")
    return materialise(seen.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


@dataclass
class Vocabulary:
    """Frequent words with their symbols (-1: shared) and log10(c + ALPHA)."""

    words: dict[bytes, int]
    symbol: np.ndarray
    weight: np.ndarray
    end_weight: float

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is frequent, symbol, weight) of distinct words, none of them empty."""
        data, to = utf8(words)
        two = np.diff(to) > 1
        tail = data[to[1:] - 1].astype(np.uint64) | np.where(two, data[to[1:] - 1 - two], 0).astype(np.uint64) << np.uint64(8)
        shared = (OWN + 1 + (mix64(tail) % np.uint64(BUCKETS)).astype(np.int64)).astype(np.int64)
        if not self.words:
            return np.zeros(len(words), bool), shared, np.zeros(len(words))
        found = pc.index_in(words.cast(pa.large_binary()), pa.array(self.words, pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.append(np.fromiter(self.words.values(), np.int64, len(self.words)), -1)[found]
        hit = at >= 0
        return hit, np.where(hit & (self.symbol[at] >= 0), self.symbol[at], shared), np.where(hit, self.weight[at], 0)


#: The number of the symbol that ends a text; symbols below it are words, those above it shared.
STOP = OWN


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """At most ``head`` words, those above the least count that allows it."""
    level = F.floor(F.log2("c") * 16).cast("int")
    total, floor = 0, None
    for r in counts.groupBy(level.alias("l")).count().orderBy(F.desc("l")).collect():  # one row a count level
        total += r["count"]
        if total > head:
            break
        floor = r.l
    rows = counts.where((level >= floor) & (F.col("word") != END)).collect() if floor is not None else []
    ends = counts.where(F.col("word") == END).first()
    rows.sort(key=lambda r: (-r.c, r.word))
    symbol = np.where(np.arange(len(rows)) < OWN, np.arange(len(rows)), -1)
    weight = np.log10(np.array([r.c for r in rows], float) + ALPHA)
    return Vocabulary({r.word.encode(): i for i, r in enumerate(rows)}, symbol, weight, float(np.log10((ends.c if ends else 0) + ALPHA)))


def _place(counts: np.ndarray) -> np.ndarray:
    """Symbol -> its place, class * SLOTS + slot: classes hold symbols of like frequency."""
    place = np.empty(SYMBOLS, np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(SYMBOLS)
    return place


def _sequence(w: Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol before last, last, own, document) of all tokens, ends of texts included.

    Before the first word stands the end of a text, twice.
    """
    n = len(w.first) - 1
    size = np.diff(w.first) + 3
    to = np.cumsum(size)
    line = np.full(int(to[-1]) if n else 0, STOP, np.int64)
    doc = np.repeat(np.arange(n), size)
    inner = np.ones(len(line), bool)
    inner[to - size] = inner[to - size + 1] = inner[to - 1] = False
    line[inner] = symbols
    real = np.ones(len(line), bool)
    real[to - size] = real[to - size + 1] = False
    i = np.flatnonzero(real)
    return line[i - 2], line[i - 1], line[i], doc[i]


@dataclass
class Network:
    """Context vectors of symbols, output vectors of classes and places (last column the bias), scales of the two positions."""

    context: np.ndarray
    classes: np.ndarray
    places: np.ndarray
    scales: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Biases are log frequencies; vectors are small and the same in every task."""
        rng = np.random.default_rng(7)
        by_place = np.empty(SYMBOLS)
        by_place[_place(counts)] = counts + ALPHA
        table = by_place.reshape(CLASSES, SLOTS)
        total = table.sum(1, keepdims=True)
        draw = lambda n, bias: np.column_stack([rng.normal(0, 0.05, (n, SIZE)), bias]).astype(np.float32)
        return cls(rng.normal(0, 0.3, (SYMBOLS, SIZE)).astype(np.float32), draw(CLASSES, np.log(total[:, 0] / total.sum())), draw(SYMBOLS, np.log(table / total).ravel()), np.ones((2, SIZE), np.float32))

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] * self.scales[0] + self.context[two] * self.scales[1]

    def rows(self) -> np.ndarray:
        """All parameters as one matrix of SIZE + 1 columns."""
        wide = lambda x: np.column_stack([x, np.zeros(len(x), np.float32)])
        return np.concatenate([wide(self.context), self.places, self.classes, wide(self.scales)])

    @classmethod
    def of_rows(cls, r: np.ndarray) -> Network:
        a, b, c = SYMBOLS, 2 * SYMBOLS, 2 * SYMBOLS + CLASSES
        return cls(r[:a, :SIZE].copy(), r[b:c].copy(), r[a:b].copy(), r[c:, :SIZE].copy())

    def log_probability(self, one: np.ndarray, two: np.ndarray, place: np.ndarray, block: int = 65_536) -> np.ndarray:
        """Natural log of P(place | the two symbols before), normalised, in batched matrix products."""
        out = np.empty(len(place))
        for i in range(0, len(place), block):
            q, k = self.predicted(one[i : i + block], two[i : i + block]), place[i : i + block] // SLOTS
            q = np.column_stack([q, np.ones(len(q), q.dtype)])  # meets the bias
            for j in range(0, len(q), BATCH):  # fits a core's cache
                out[i + j : i + min(j + BATCH, len(q))] = _log_softmax(q[j : j + BATCH] @ self.classes.T, k[j : j + BATCH])
            order = _order(k)
            bound = np.searchsorted(k[order], np.arange(CLASSES + 1))
            for c in np.flatnonzero(np.diff(bound)).tolist():
                own = order[bound[c] : bound[c + 1]]
                o = self.places[c * SLOTS : (c + 1) * SLOTS]
                out[i + own] += _log_softmax(q[own] @ o.T, place[i + own] % SLOTS)
        return out


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one column; overwrites z."""
    if z.size and z.max() > 60:
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), at]
    return own - np.log(np.exp(z, out=z).sum(1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _order(symbols: np.ndarray) -> np.ndarray:
    """A stable order of numbers below SYMBOLS, by radix."""
    return np.argsort(symbols.astype(np.int16), kind="stable")


class Trainer:
    """Noise-contrastive estimation over batches of tokens, with Adagrad steps a row."""

    def __init__(self, net: Network, counts: np.ndarray, seed: int = 0, rate: float = 0.05):
        self.net, self.rate, self.rng = net, rate, np.random.default_rng(seed)
        by_place = np.empty(SYMBOLS)
        by_place[_place(counts)] = counts + ALPHA
        self.noise = by_place.reshape(CLASSES, SLOTS).sum(1) / by_place.sum()
        self.squares = [np.full(len(x), 1e-6, np.float32) for x in (net.context, net.classes, net.places, net.scales)]
        self.met = [np.zeros(len(x), np.int64) for x in (net.context, net.places, net.classes, net.scales)]

    def _step(self, x: np.ndarray, squares: np.ndarray, rows: np.ndarray, grads: np.ndarray) -> None:
        """Sums gradients by row, then moves each row by its own rate."""
        order = _order(rows)
        head = np.flatnonzero(np.append(True, np.diff(rows[order]) > 0))
        at, g = rows[order][head], np.add.reduceat(grads[order], head)
        squares[at] += (g * g).mean(1)
        x[at] -= self.rate * g / np.sqrt(squares[at])[:, None]

    def learn(self, one: np.ndarray, two: np.ndarray, place: np.ndarray) -> None:
        order = _order(place // SLOTS)
        one, two, place = one[order], two[order], place[order]
        net, n = self.net, len(place)
        k = place // SLOTS
        q = net.predicted(one, two)
        with_one = np.column_stack([q, np.ones(n, np.float32)])  # meets the bias
        d_all = np.zeros_like(with_one)

        def terms(vectors, shift, true):
            """Gradients of one output row a token."""
            weight = (_sigmoid(np.einsum("ij,ij->i", with_one, vectors) - shift) - true)[:, None]
            np.add(d_all, weight * vectors, out=d_all)
            return weight * with_one

        # classes: one true, NOISE drawn by frequency and shared by the batch
        drawn = self.rng.choice(CLASSES, NOISE, p=self.noise)
        shift = np.log(NOISE * self.noise).astype(np.float32)
        own = net.classes[k]
        g_true = terms(own, shift[k], 1)
        o = net.classes[drawn]
        g = _sigmoid(q @ o[:, :-1].T + o[:, -1] - shift[drawn])
        d_all += g @ o
        noise_rows = g.T @ with_one
        head = np.flatnonzero(np.append(True, np.diff(k) > 0))
        class_rows, class_grads = np.append(k[head], drawn), np.concatenate([np.add.reduceat(g_true, head), noise_rows])
        # slots of the true class: one true, NOISE_SLOTS drawn evenly
        slots = self.rng.integers(0, SLOTS, NOISE_SLOTS)
        shift = np.float32(np.log(NOISE_SLOTS / SLOTS))
        own = net.places[place]
        rows, grads = [place], [terms(own, shift, 1)]
        for s in slots.tolist():
            o = net.places[k * SLOTS + s]
            rows.append(k[head] * SLOTS + s)
            grads.append(np.add.reduceat(terms(o, shift, 0), head))
        d_q = d_all[:, :-1]
        r1, r2 = net.context[one], net.context[two]
        self._step(net.context, self.squares[0], np.append(one, two), np.concatenate([d_q * net.scales[0], d_q * net.scales[1]]))
        self._step(net.scales, self.squares[3], np.arange(2), np.stack([(d_q * r1).sum(0), (d_q * r2).sum(0)]))
        self._step(net.classes, self.squares[1], class_rows, class_grads)
        self._step(net.places, self.squares[2], np.concatenate(rows), np.concatenate(grads))
        for met, at in zip(self.met, (np.append(one, two), place, k), strict=False):
            met += np.bincount(at, minlength=len(met))
        self.met[3] += n


def _learn(vocab: Vocabulary, counts: np.ndarray, visits: float):
    """Texts -> the task's parameters: ``row, n, v0 ...`` of the rows that it met n times."""
    place_of, passes = _place(counts), int(np.ceil(visits))

    def run(batches):
        trainer, credit = Trainer(Network.start(counts), counts), 1.0
        for batch in pieces(batches, "text", CHUNK):
            w = Words(batch.column("text"), lower=True)
            codes, words = w.coded()
            one, two, own, _ = _sequence(w, vocab.look_up(words)[1][codes])
            own, size = place_of[own], min(BATCH, len(own) // 16 + 1)
            for i in [*range(0, len(own), size)] * passes:
                credit += visits / passes
                if credit >= 1:
                    credit -= 1
                    trainer.learn(one[i : i + size], two[i : i + size], own[i : i + size])
        n = np.concatenate(trainer.met)
        at = np.flatnonzero(n)
        values = trainer.net.rows()[at].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(v) for v in values.T)], ["row", "n", *(f"v{j}" for j in range(SIZE + 1))])

    return run


def _symbol_sizes(vocab: Vocabulary):
    """Words with counts -> ``symbol, n, v``: tokens and distinct words of each symbol."""

    def run(batches):
        n, v = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in pieces(batches, "word", CHUNK):  # words are looked up many at once
            words, c = batch.column("word"), batch.column("c").to_numpy()
            some = pc.not_equal(words, END)  # the end of a text has no word
            symbol = np.full(len(words), STOP, np.int64)
            symbol[some.to_numpy(zero_copy_only=False)] = vocab.look_up(words.filter(some))[1]
            n += np.bincount(symbol, c, SYMBOLS).astype(np.int64)
            v += np.bincount(symbol, minlength=SYMBOLS)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(v[at])], ["symbol", "n", "v"])

    return run


@dataclass
class Model:
    vocab: Vocabulary
    net: Network
    place: np.ndarray
    share: np.ndarray  # log10 of a shared symbol's denominator; 0 for symbols of their own
    base: float  # log10 of the denominator of the base
    train_tokens: int


def fit(inputs: DataFrame, counts: DataFrame, head: int = HEAD) -> Model:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocab = vocabulary(counts, head)
    sizes = counts.mapInArrow(_symbol_sizes(vocab), "symbol int, n long, v long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # SYMBOLS rows at most
    tokens, share = np.zeros(SYMBOLS), np.full(SYMBOLS, np.log10(ALPHA))
    for r in sizes:
        tokens[r.symbol], share[r.symbol] = r.n, np.log10(r.n + ALPHA * (r.v + 1))
    share[: STOP + 1] = 0
    columns = [f"v{j}" for j in range(SIZE + 1)]
    texts = inputs.where("not held_out").select("text")
    # fewer, larger tasks where partitions are small: a task's parameters have one size
    texts = texts.coalesce(max(n // TASK_TOKENS + 1, inputs.sparkSession.sparkContext.defaultParallelism))
    learnt = texts.mapInArrow(_learn(vocab, tokens, min(MOST_VISITS, max(LEAST_VISITS, TASK_TOKENS / 2 / max(n, 1)))), "row int, n long, " + ", ".join(f"{c} double" for c in columns))
    mean = learnt.groupBy("row").agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in columns]).toArrow()  # one row a row of parameters
    rows = Network.start(tokens).rows()
    if len(mean):
        rows[mean["row"].to_numpy()] = np.column_stack([mean[c].to_numpy() for c in columns]).astype(np.float32)
    return Model(vocab, Network.of_rows(rows), _place(tokens), share, float(np.log10(n + ALPHA * (v + 1))), int(n))


def _score(model: Model):
    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            w = Words(batch.column("text"), lower=True)
            n = batch.num_rows
            codes, words = w.coded()
            frequent, symbols, weight = (x[codes] for x in model.vocab.look_up(words))
            one, two, own, doc = _sequence(w, symbols)
            neural = np.bincount(doc, model.net.log_probability(one, two, model.place[own]) / np.log(10) - model.share[own], n)
            of = np.repeat(np.arange(n), np.diff(w.first))
            known = np.bincount(of[frequent], minlength=n) + 1
            base = np.bincount(of, weight, n) + model.vocab.end_weight
            within = np.bincount(of, np.where(symbols > STOP, weight, 0), n)
            rare = np.flatnonzero(~frequent)
            pair, times = np.unique(of[rare] * max(len(words), 1) + codes[rare], return_counts=True)
            owner, code = pair // max(len(words), 1), pair % max(len(words), 1)
            ids, marks, out = (batch.column(i) for i in range(3))
            rows = pa.StructArray.from_arrays([pa.array((np.diff(w.first) + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(within + neural)], ["n_tokens", "known", "base", "score"])
            yield pa.RecordBatch.from_arrays([ids, marks, out, pa.array([f" {i}.{m}" for i, m in zip(ids.to_pylist(), marks.to_pylist(), strict=True)]), pa.array(np.ones(n, np.int64)), rows], ["doc_id", "mark", "held_out", "word", "times", "stats"])
            every = words.cast(pa.binary()).cast(pa.string())
            for i in range(0, len(pair), 50_000):
                d, c = pa.array(owner[i : i + 50_000]), pa.array(code[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([ids.take(d), marks.take(d), out.take(d), every.take(c), pa.array(times[i : i + 50_000].astype(np.int64)), pa.nulls(len(c), rows.type)], ["doc_id", "mark", "held_out", "word", "times", "stats"])

    return run


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null and empty texts are one end of text. Rows with a null id are scored
    but never learnt from; ``held_out`` is false for them. Repeated rows each
    get their row; an empty table gives no rows.
    """
    inputs = _inputs(docs, doc_id, text)
    counts = word_counts(inputs)
    model = fit(inputs, counts, head)
    kind = inputs.schema["doc_id"].dataType.simpleString()
    rows = inputs.mapInArrow(_score(model), f"doc_id {kind}, mark long, held_out boolean, word string, times long, stats struct<n_tokens: long, known: long, base: double, score: double>")
    c = counts.select(F.col("word").alias("w"), "c")
    joined = rows.join(c, F.col("word") == F.col("w"), "left")
    # stand-ins of documents start with a space, as no word does
    is_doc = F.col("stats").isNotNull()
    weight = F.when(~is_doc, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).otherwise(0.0)
    known = F.when(~is_doc & F.col("c").isNotNull(), F.col("times")).otherwise(0)
    each = joined.groupBy("doc_id", "mark", "held_out").agg(F.count("stats").alias("m"), F.max("stats").alias("s"), F.sum(weight).alias("rare"), F.sum(known).alias("rare_known"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return each.select(
        "doc_id", (F.col("held_out") & F.col("doc_id").isNotNull()).alias("held_out"),
        F.col("s.n_tokens").alias("n_tokens"), (F.col("s.known") + F.col("rare_known") / F.col("m")).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("s.base") + F.col("rare") / F.col("m") - F.col("s.n_tokens") * model.base).alias("base_score"),
        (F.col("s.score") + F.col("rare") / F.col("m")).alias("score"),
    )
