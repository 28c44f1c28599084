"""Secret scan: patterns, and a character convolutional network on every candidate.

Candidates are the matches of the contract's patterns, the values in key-value
positions (8 characters and more, of any alphabet) and long runs of key
characters (20 and more, or 16 that mix letters and digits). The network reads
a candidate and its surroundings, 32 characters before and 16 after: character
vectors with a zone flag, one convolution of width 5, the maximum of each
filter in each zone, and a dense layer. A candidate longer than the inner zone
is read in overlapping windows over its whole length and scores as its best
window.

The network is trained in numpy on labelled findings: seeded secrets of public
key formats and of random values, and seeded look-alikes (identifiers,
versions, paths, ordinary words), both set among the words of a bounded sample
of documents. The sample's own candidates carry no label and are not used.
Findings kept from training calibrate the scores (Platt scaling) and set one
threshold a kind of candidate: the largest that keeps ``RECALL`` of the secrets
of that kind. Pattern spans always stay, with their score; the network adds
spans of kind ``model``.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import pieces
from lodestar.session import small_batches

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Kinds of candidates: the patterns' own, values of keys, and runs.
ASSIGNED, ACCESSED, HEXED, VALUE, RUNNING = range(5)
#: ``key: value``, ``key=value``, ``"key": "value"``.
KEYED = re.compile(r"""(?<!\w)\w[\w.-]{1,40}["']?\x20*(?:=>|:=|[:=])\x20*["']?([^\s"'<>,;:=()\[\]{}][^\s"'<>,;]{7,})""")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
BEFORE, INSIDE, AFTER, STEP = 32, 48, 16, 40
SAMPLE, FINDINGS, RECALL = 256, 6000, 0.97
#: Characters of the sampled texts together.
SAMPLE_CHARS = 4_000_000
DIM, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
CHUNK = 4 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns, sorted."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(n in low for n in NAMES):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _outside(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a to b that no pattern span covers."""
    out = []
    for s, _, e in base:
        if e > a and s < b:
            if s > a:
                out.append((a, s))
            a = max(a, e)
    return [*out, (a, b)] if a < b else out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates (start, kind, end): what pattern spans leave of values and runs, sorted."""
    out = []
    if ":" in text or "=" in text:
        for m in KEYED.finditer(text):
            a, b = m.span(1)
            b -= len(m[1]) - len(m[1].rstrip(".!?)"))
            out += [(s, VALUE, e) for s, e in _outside(a, b, base) if e - s >= 8]
    known = sorted(base + out)
    for m in RUN.finditer(text):
        for s, e in _outside(*m.span(), known):
            run = text[s:e]
            digit, letter = any("0" <= c <= "9" for c in run), any(c.isalpha() for c in run)
            if letter and (e - s >= 20 or (digit and e - s >= 16)):
                out.append((s, RUNNING, e))
    return sorted(out)


_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in string.printable[:95]]] = np.arange(1, 96)


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(character codes of each window, number of its span); 96 is "other", 0 is nothing.

    A span has one window for each ``STEP`` characters, the last ones included.
    """
    rows, owner = [], []
    for k, (a, b) in enumerate(spans):
        before, after = _codes(text[max(0, a - BEFORE) : a]), _codes(text[b : b + AFTER])
        inner = _codes(text[a:b])
        for i in range(0, max(len(inner) - INSIDE, 0) + STEP, STEP):
            part = inner[min(i, max(len(inner) - INSIDE, 0)) :][:INSIDE]
            row = np.zeros(BEFORE + INSIDE + AFTER, np.int64)
            row[BEFORE - len(before) : BEFORE], row[BEFORE : BEFORE + len(part)] = before, part
            row[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = after
            rows.append(row)
            owner.append(k)
    return (np.stack(rows) if rows else np.zeros((0, BEFORE + INSIDE + AFTER), np.int64)), np.array(owner, np.int64)


def _codes(part: str) -> np.ndarray:
    code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CODE[np.minimum(code, 127)], 96)


ZONE = np.repeat(np.arange(3), [BEFORE, INSIDE, AFTER])


@dataclass
class Model:
    p: list[np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [0.5] * 5)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_forward(self.p, x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of windows."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.offset, -60, 60)))

    def score_spans(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Calibrated probability of each span: that of its best window."""
        x, owner = windows(text, spans)
        out = np.zeros(len(spans))
        np.maximum.at(out, owner, self.score(x))
        return out


def _patches(p: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    flag = np.broadcast_to(np.eye(3, dtype=np.float32)[ZONE], (*x.shape, 3))
    e = np.concatenate([p[0][x], flag], 2)
    e = np.pad(e, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
    return np.concatenate([e[:, k : k + x.shape[1]] for k in range(WIDTH)], 2)


def _forward(p: list[np.ndarray], x: np.ndarray):
    _, w, b, w1, b1, w2, b2 = p
    patch = _patches(p, x)
    conv = patch @ w + b
    arg = np.stack([conv[:, ZONE == z].argmax(1) + int(np.flatnonzero(ZONE == z)[0]) for z in range(3)], 1)
    top = np.take_along_axis(conv, arg, 1)
    flat = np.maximum(top, 0).reshape(len(x), -1)
    h = np.maximum(flat @ w1 + b1, 0)
    return h @ w2 + b2, (patch, arg, top, flat, h)


def train(x: np.ndarray, y: np.ndarray, kind: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, recall: float = RECALL, seed: int = 3) -> Model:
    """Adam on the log-loss of three quarters; calibration and a threshold a kind on the rest."""
    rng = np.random.default_rng(seed)
    wide = WIDTH * (DIM + 3)
    shapes = [(97, DIM), (wide, FILTERS), (FILTERS,), (3 * FILTERS, HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    p = [(rng.normal(0, 1 / np.sqrt(s[0]) if i else 0.5, s) if len(s) == 2 or i == 5 else np.zeros(s)).astype(np.float32) for i, s in enumerate(shapes)]
    rest = rng.random(len(x)) < 0.25
    xs, ys = x[~rest], y[~rest].astype(np.float32)
    m1, m2, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for i in range(0, len(order), batch):
            xb, yb = xs[order[i : i + batch]], ys[order[i : i + batch]]
            z, (patch, arg, top, flat, h) = _forward(p, xb)
            dz = (1 / (1 + np.exp(-z)) - yb) / len(yb)
            dh = np.outer(dz, p[5]) * (h > 0)
            dtop = ((dh @ p[3].T).reshape(top.shape)) * (top > 0)
            rows = np.arange(len(xb))[:, None, None]
            picked = patch[rows, arg]  # batch, zone, filter, patch
            dw = np.einsum("bzf,bzfp->pf", dtop, picked)
            dpatch = np.einsum("bzf,pf->bzfp", dtop, p[1]).reshape(*dtop.shape, WIDTH, DIM + 3)[..., :DIM]
            de = np.zeros_like(p[0])
            place = arg[..., None] + np.arange(WIDTH) - WIDTH // 2
            inside = (place >= 0) & (place < xb.shape[1])
            codes = xb[np.arange(len(xb))[:, None, None, None], np.clip(place, 0, xb.shape[1] - 1)]
            np.add.at(de, codes[inside], dpatch[inside])
            grads = [de, dw, dtop.sum((0, 1)), flat.T @ dh, dh.sum(0), h.T @ dz, dz.sum()]
            t += 1
            for k, g in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model = Model(p)
    z, target = model.logit(x[rest]), y[rest].astype(float)
    a, b = 1.0, 0.0
    for _ in range(400):  # Platt scaling by gradient steps
        s = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        a, b = a - 0.05 * float(((s - target) * z).mean()), b - 0.5 * float((s - target).mean())
    model.slope, model.offset = a, b
    score = model.score(x[rest])
    for k in range(5):
        own = np.sort(score[(target > 0) & (kind[rest] == k)])
        model.thresholds[k] = float(own[int((1 - recall) * len(own))]) if len(own) else 1.1
    return model


def _random(r: random.Random, chars: str, n: int) -> str:
    return "".join(r.choice(chars) for _ in range(n))


ALNUM, B64, UPPER = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
#: Public formats of keys, and random values of several alphabets.
SECRETS = (
    lambda r: r.choice(["ghp_", "gho_"]) + _random(r, ALNUM, 36), lambda r: r.choice(["sk_live_", "rk_live_"]) + _random(r, ALNUM, 24),
    lambda r: f"xoxb-{_random(r, string.digits, 11)}-{_random(r, ALNUM, 24)}", lambda r: "AIza" + _random(r, ALNUM + "_-", 35),
    lambda r: _random(r, B64, 40), lambda r: _random(r, B64, r.randint(43, 63)) + "=", lambda r: "eyJ" + _random(r, ALNUM, r.randint(24, 160)),
    lambda r: _random(r, ALNUM, r.randint(20, 48)), lambda r: "ASIA" + _random(r, UPPER, 16), lambda r: _random(r, UPPER, r.randint(24, 40)),
    lambda r: "glpat-" + _random(r, ALNUM, 20), lambda r: _random(r, string.ascii_letters, r.randint(24, 48)), lambda r: _random(r, ALNUM + "-_", r.randint(30, 90)),
)
#: Values that only their key gives away.
SHORT_SECRETS = (
    lambda r: _random(r, ALNUM + "!#$%&*@^", r.randint(8, 16)), lambda r: _random(r, ALNUM, r.randint(8, 18)), lambda r: _random(r, string.ascii_lowercase + string.digits, r.randint(10, 20)),
    lambda r: _random(r, "абвгдежзиклмнопрстуфхцчшэюя0123456789", r.randint(9, 16)), lambda r: _random(r, string.ascii_letters + "äöüéèñß!?#" + string.digits, r.randint(8, 16)),
)
KEYS = ("pwd", "pass", "key", "auth", "credential", "client_key", "access", "private", "login", "pin", "db_pass", "signing", "bearer", "KEY", "PWD")
LABELS = ("see", "file", "id", "version", "build", "title", "name", "host", "note", "path", "url", "time", "ref", "date", "section")


def _look_alike(r: random.Random, word) -> str:
    return r.choice([
        lambda: "-".join(_random(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: "_".join([word(), word(), word(), str(r.randint(1, 99))]),
        lambda: f"{word()}-{r.randint(1, 9)}-{r.randint(0, 30)}-{word()}-{word()}", lambda: f"/{word()}/{word()}/{word()}{r.randint(1, 2030)}/{word()}",
        lambda: f"IMG_{r.randint(2000, 2030)}{r.randint(1000, 1231)}_{r.randint(100000, 235959)}", lambda: f"{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z",
        lambda: f"{word()}{word().title()}{word().title()}{word().title()}{r.randint(1, 99)}", lambda: "=" * r.randint(8, 20) + word() + str(r.randint(1, 9)) + "=" * r.randint(4, 20),
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1990, 2030)}-{r.randint(1, 12)}", lambda: f"{r.randint(1, 9)}x{r.randint(10, 99)}_{word()}_{word()}_{word()}", lambda: f"//{word()}-{word()}/{word()}/{word()}/{r.randint(1, 999)}",
        lambda: word() + word() + word() + word(), lambda: (word() + word() + word()).title(), lambda: r.choice("-=_+") * r.randint(16, 60) + word(), lambda: f"{word()}.{word()}@{word()}.{r.choice(['org', 'com', 'net'])}",
    ])()


def _finding(r: random.Random, word) -> tuple[str, str, int, int]:
    """(text before, candidate, label, kind) of a seeded finding."""
    kind = r.choice([ASSIGNED, ACCESSED, HEXED, VALUE, VALUE, VALUE, RUNNING, RUNNING])
    join = r.choice([" = ", ": ", '="', "=", ": '", '": "', " := "])
    secret = r.random() < 0.5
    if kind == ASSIGNED:
        name = r.choice(NAMES)
        value = r.choice(SECRETS + SHORT_SECRETS[:3])(r) if secret else r.choice([word, lambda: "required", lambda: "changed", lambda: f"{word()}.{word()}", lambda: "......", lambda: f"{word()}_{word()}"])()
        return "", name + join + value, int(secret), kind
    if kind == ACCESSED:
        return f"{word()} ", "AKIA" + (_random(r, UPPER, r.randint(16, 20)) if secret else r.choice([_random(r, "X", 16), "EXAMPLE" * 3, (word() * 6).upper()[:20]])), int(secret), kind
    if kind == HEXED:
        before = f"{r.choice(KEYS)}{join}" if secret else f"{r.choice(['sha', 'commit', 'md5', 'digest', 'checksum', 'etag', 'build', word()])} "
        return before, _random(r, "0123456789abcdef", r.choice([24, 32, 40, 64])) if secret or r.random() < 0.7 else r.choice("0123456789abcdef") * r.randint(24, 40), int(secret), kind
    if kind == VALUE:
        if secret:
            return r.choice(KEYS) + join, r.choice(SHORT_SECRETS + SECRETS)(r), 1, kind
        value = _look_alike(r, word) if r.random() < 0.5 else (word() + word() + word())[: r.randint(8, 14)].ljust(8, "s")
        return r.choice(LABELS + (word(),)) + join, value, 0, kind
    if secret:
        return f"{word()} {r.choice(('', *KEYS))} ", r.choice(SECRETS)(r), 1, kind
    return f"{word()} {r.choice(('', *LABELS))} ", _look_alike(r, word), 0, kind


def labelled_findings(texts: list[str], n: int = FINDINGS, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, labels, kinds) of ``n`` seeded findings set among the texts' words; one window a finding."""
    r = random.Random(seed)
    words = [w for t in texts for w in t.split()[:: max(1, len(t) // 20_000)]] or ["the", "of", "and", "entry", "report"]
    plain = [w for w in (re.sub(r"[^\w]|\d|_", "", w.lower()) for w in words) if len(w) > 1] or ["entry"]
    x, y, kinds = [], [], []
    for _ in range(n):
        before, value, label, kind = _finding(r, lambda: r.choice(plain))
        left = " ".join(r.choice(words) for _ in range(6)) + " " + before
        rows, _ = windows(left + value + r.choice(["", '"', "'", "\n", ". ", ", "]) + " " + r.choice(words), [(len(left), len(left) + len(value))])
        x.append(rows[r.randrange(len(rows))])
        y.append(label)
        kinds.append(kind)
    return np.stack(x), np.array(y), np.array(kinds)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS, findings: int = FINDINGS) -> Model:
    """Train with the texts of at most ``sample`` rows, ``chars`` characters together, as surroundings (least hash first)."""
    row = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.length(F.col(text)).alias("n")).where("n > 0")
    taken, left = {}, chars
    for r in row.select("h", "n").distinct().orderBy("h", "n").limit(sample).collect():
        if r.n <= left:
            taken[r.h, r.n] = None
            left -= r.n
    if taken:
        wanted = docs.sparkSession.createDataFrame(list(taken), "w_h long, w_n int")
        for r in row.join(F.broadcast(wanted), (F.col("h") == F.col("w_h")) & (F.col("n") == F.col("w_n"))).groupBy("h", "n").agg(F.min("t").alias("t")).collect():
            taken[r.h, r.n] = r.t
    return train(*labelled_findings([t for t in taken.values() if t], findings))


def _scan(model: Model):
    limit = np.array(model.thresholds)

    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
            score = [np.zeros(0)] * len(texts)
            for i, (t, b, m) in enumerate(zip(texts, base, more, strict=True)):
                if b or m:
                    score[i] = model.score_spans(t, [(s, e) for s, _, e in b + m])
            found = [[(s, 3, e) for (s, k, e), p in zip(m, p[len(b) :], strict=True) if p >= limit[k]] for b, m, p in zip(base, more, score, strict=True)]
            doubt = [int(sum(p < limit[k] for (_, k, _), p in zip(b, p, strict=False))) for b, p in zip(base, score, strict=True)]
            name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            cols = [batch.column(0)]
            cols += [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3)]
            cols += [pa.array([hashlib.sha256(name(b).encode()).hexdigest() for b in base]), pa.array([name(sorted(b + f)) for b, f in zip(base, found, strict=True)])]
            cols += [pa.array(x, pa.int64()) for x in ([len(f) for f in found], [len(m) for m in more], doubt)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_candidates", "n_doubtful"])

    return run


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, n_candidates, n_doubtful``.

    ``n_candidates`` counts what the network judged beside the pattern spans,
    ``n_model`` what it added, ``n_doubtful`` the pattern spans (kept) that it
    scores below their kind's threshold. Null texts count as empty and have no
    spans; repeated rows each get their row; an empty table gives no rows;
    further columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, doc_id, text, **params)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_scan(model), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_candidates long, n_doubtful long")
