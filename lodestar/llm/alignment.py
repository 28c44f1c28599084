"""Alignment of two tokenizers over the same bytes.

Each text is encoded by a byte-level BPE (A) and by a BPE of pieces (B), the
words between lone spaces once for all their occurrences in a piece of input.
Token numbers repeated over the bytes they own give two arrays of owners. Where a
pair of owners differs from the one before, two tokens begin to overlap; where
both owners change at once, both tokens end: these cuts part the text into
groups. All A and B tokens of a group are linked. How many documents link a
pair of ids is counted over the whole corpus and read back for each document.

Nulls, ties and the like: a null or empty text, or one whose tokens do not
spell its bytes (a piece model may normalise), has no tokens, zeros and an
empty digest; ids are carried as they are, null or repeated ones too, and each
row is a document of its own; of pairs tied for an id's highest count all are
best; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import pieces
from lodestar.session import materialise, small_batches

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that a task handles at once.
CHUNK = 4 << 20
#: Distinct words that a tokenizer is given at once.
GROUP_WORDS = 8192
#: Words that begin or end with a space or the sign that stands for one, or hold such a sign.
_ODD = re.compile("^[\\s▁]|[\\s▁]$|▁")
#: A space between two other characters: neither tokenizer joins what it parts, and both begin a token with it.
_LONE_SPACE = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: Links of one group up to which they are written out pair by pair; larger groups go by distinct ids.
GROUP_LINKS = 1 << 20
#: Pairs in one row of the table of links.
ROW_PAIRS = 1 << 18
#: Distinct pairs up to which their counts are broadcast; beyond, a shuffled join.
BROADCAST_PAIRS = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(parts: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    return [np.concatenate([p[0][k] for p in parts]) for k in (0, 1)], [np.concatenate([p[1][k] for p in parts]) for k in (0, 1)], np.concatenate([p[2] for p in parts])


class Tokenizers:
    """Both tokenizers of a task, made from the bytes of their files, and what each id's bytes are."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = _byte_letters()
        model = json.loads(a)
        special = {t["id"] for t in model["added_tokens"]}
        self.a_bytes = [b""] * (max(max(model["model"]["vocab"].values()), *special, 0) + 1)
        for piece, i in model["model"]["vocab"].items():
            if i not in special:
                self.a_bytes[i] = bytes(letters[c] for c in piece)
        pieces_b = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_b)]
        # texts may be parted before a space if no piece goes on with one
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces_b)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (tuple(np.array([f"{i}{end}" for i in range(len(t))], object) for end in ends) for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))

    def _encoded(self, text: str) -> tuple[list[int], list[int]]:
        # the fast form leaves out places in the text, which the owners' arrays tell anyway
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)

    def _spell(self, ids: tuple[list[int], list[int]], data: bytes) -> bool:
        return all(b"".join(map(of.__getitem__, x)) == data for of, x in zip((self.a_bytes, self.b_bytes), ids, strict=True))

    def _ids(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of plain words by A and B, a space before each, how many each has, and whether they spell it."""
        line = " ".join(words)
        found = self._encoded(line)
        if self._spell(found, b" " + line.encode()):
            ids = [np.array(x, np.int64) for x in found]
            ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)) + 1)
            cut = [np.searchsorted(np.cumsum(size[x]), ends, "right") for size, x in zip((self.a_size, self.b_size), ids, strict=True)]
            return ids, [np.diff(c, prepend=0) for c in cut], np.ones(len(words), bool)
        if len(words) == 1:
            return self._odd(words[0])
        half = len(words) // 2  # one of them is not spelt by its tokens: find out which
        return _joined([self._ids(words[:half]), self._ids(words[half:])])

    def _odd(self, word: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The same of one word of any kind."""
        found = self._encoded(word) if word else ([], [])
        return [np.array(x, np.int64) for x in found], [np.array([len(x)]) for x in found], np.array([self._spell(found, b" " + word.encode())])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and B of a space and each text; none if they do not spell it."""
        words, count = [], []
        for text in texts:
            w = _LONE_SPACE.split(text) if text and self.parted else [text or ""]
            words += w
            count.append(len(w))
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # plain words are encoded many at once, and the odd ones (at the ends of texts, mostly) by themselves
        is_plain = np.fromiter((bool(w) and _ODD.search(w) is None for w in words), bool, len(words))
        order = np.append(np.flatnonzero(is_plain), np.flatnonzero(~is_plain))
        plain = [words[i] for i in order[: is_plain.sum()]]
        groups = [self._ids(plain[i : i + GROUP_WORDS]) for i in range(0, len(plain), GROUP_WORDS)]
        ids, size, spelt = _joined([*groups, *(self._odd(words[i]) for i in order[len(plain) :])])
        first = [np.append(0, np.cumsum(n)) for n in size]
        where = np.argsort(order)
        at = 0
        for n, text in zip(count, texts, strict=True):
            c = where[code[at : at + n]]
            good = bool(text) and spelt[c].all()
            at += n
            out = []
            for x, f, m in zip(ids, first, size, strict=True):
                each = m[c]
                out.append(x[np.repeat(f[c] - (np.cumsum(each) - each), each) + np.arange(each.sum())] if good else x[:0])
            yield tuple(out)


class Alignment:
    """Groups and links of one text, from its byte owners."""

    def __init__(self, t: Tokenizers, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        if not len(a):
            self.a_group = self.b_group = self.n_a = self.n_b = np.zeros(0, np.int64)
            self.overlaps = np.zeros((0, 2), np.int64)
            return
        owner_a, owner_b = np.repeat(np.arange(len(a)), t.a_size[a]), np.repeat(np.arange(len(b)), t.b_size[b])
        new_a, new_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        begins = np.append(0, np.flatnonzero(new_a | new_b) + 1)
        self.overlaps = np.stack([owner_a[begins], owner_b[begins]], 1)
        group = np.append(0, np.cumsum(new_a & new_b))
        self.a_group, self.b_group = group[np.append(0, np.flatnonzero(new_a) + 1)], group[np.append(0, np.flatnonzero(new_b) + 1)]
        self.n_a, self.n_b = np.bincount(self.a_group), np.bincount(self.b_group)

    def written(self, t: Tokenizers) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        if not len(self.a):
            return ""
        out = np.empty(len(self.a) + len(self.b), object)
        end_a, end_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[end_a - 1] = last_b[end_b - 1] = True
        out[np.arange(len(self.a)) + (end_b - self.n_b)[self.a_group]] = np.where(last_a, t.a_text[1][self.a], t.a_text[0][self.a])
        out[np.arange(len(self.b)) + end_a[self.b_group]] = np.where(last_b, t.b_text[1][self.b], t.b_text[0][self.b])
        return "".join(out.tolist())[:-1]

    def links(self, many: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct linked pairs as ``a * many + b``, how often each is linked)."""
        narrow = np.minimum(self.n_a, self.n_b) == 1  # one token overlaps all others of its group
        over = self.overlaps[narrow[self.a_group[self.overlaps[:, 0]]]]
        keys, times = [self.a[over[:, 0]] * many + self.b[over[:, 1]]], [np.ones(len(over), np.int64)]
        size = self.n_a * self.n_b
        first_a, first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        wide = np.flatnonzero(~narrow)
        some = np.zeros(len(size), bool)
        some[wide[size[wide] <= GROUP_LINKS]] = True
        i = np.flatnonzero(some[self.a_group])
        at, room = 0, np.append(0, np.cumsum(self.n_b[self.a_group[i]]))
        while at < len(i):  # as many A tokens at once as have GROUP_LINKS links
            to = max(at + 1, int(np.searchsorted(room, room[at] + GROUP_LINKS, "right")) - 1)
            g, n = self.a_group[i[at:to]], self.n_b[self.a_group[i[at:to]]]
            j = np.arange(n.sum()) + np.repeat(first_b[g] - (np.cumsum(n) - n), n)
            k, c = np.unique(np.repeat(self.a[i[at:to]], n) * many + self.b[j], return_counts=True)
            keys.append(k)
            times.append(c)
            at = to
        for g in wide[size[wide] > GROUP_LINKS]:
            a, n = np.unique(self.a[first_a[g] : first_a[g] + self.n_a[g]], return_counts=True)
            b, m = np.unique(self.b[first_b[g] : first_b[g] + self.n_b[g]], return_counts=True)
            keys.append((a[:, None] * many + b).ravel())
            times.append((n[:, None] * m).ravel())
        keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate(times), len(keys)).astype(np.int64)


_LOADED: dict[str, Tokenizers] = {}


def _tokenizers(files) -> Tokenizers:
    """The tokenizers of these files, made once a Python worker."""
    key = hashlib.md5(b"".join(files.value)).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(*files.value)
    return _LOADED[key]


STATS = "n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string"


def _linked(files):
    def run(batches):
        t = _tokenizers(files)
        many = len(t.b_bytes)
        number = TaskContext.get().partitionId() << 33
        for batch in pieces(batches, "text", CHUNK):
            ids = batch.column("doc_id")
            at, rows, stats, pairs, times = [], [], [], [], []
            for i, found in enumerate(t.encode(batch.column("text").to_pylist())):
                x = Alignment(t, *found)
                k, n = x.links(many)
                digest = hashlib.sha256(x.written(t).encode()).hexdigest() if len(x.a) else ""
                s = {"n_a": len(x.a), "n_b": len(x.b), "n_groups": len(x.n_a), "n_links": int((x.n_a * x.n_b).sum()), "groups_sha256": digest}
                for j in range(0, max(len(k), 1), ROW_PAIRS):
                    at.append(i)
                    rows.append(number)
                    stats.append(None if j else s)
                    pairs.append(k[j : j + ROW_PAIRS])
                    times.append(n[j : j + ROW_PAIRS])
                number += 1
            ends = np.append(0, np.cumsum([len(p) for p in pairs])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate(v)) for v in (pairs, times)]
            kind = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array(rows, pa.int64()), pa.array(stats, kind), *lists], ["doc_id", "row", "stats", "pairs", "times"])

    return run


def _files(spark, a_file: str, b_file: str):
    """Both vocabularies, read once by the driver; a few megabytes, so that no executor needs the paths."""
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A written table ``doc_id, row, stats, pairs, times``: the distinct linked pairs of each row, in one row of it or several."""
    d = _input(docs, doc_id, text)
    kind = d.schema["doc_id"].dataType.simpleString()
    files = _files(docs.sparkSession, a_file, b_file)
    return materialise(d.mapInArrow(_linked(files), f"doc_id {kind}, row long, stats struct<{STATS}>, pairs array<long>, times array<long>"), "alignment")


def pair_counts(linked: DataFrame, many: int) -> DataFrame:
    """``pair, n, best``: in how many documents a pair is linked, and whether that is its A id's highest."""
    n = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    n = materialise(n.select("pair", "n", F.floor(F.col("pair") / many).cast("int").alias("a")), "alignment-counts")
    top = n.groupBy("a").agg(F.max("n").alias("top")).withColumnRenamed("a", "t_a")
    # a row an id of A: no more than its vocabulary, which one broadcast of its file has already proven small
    return n.join(F.broadcast(top), F.col("a") == F.col("t_a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def table(docs: DataFrame, **params) -> DataFrame:
    """``a_id, b_id, documents, best``: the aligned vocabulary, counted over the corpus."""
    many = _vocabulary(params.get("b_file", B_FILE))
    n = pair_counts(links(docs, **params), many)
    return n.select(F.floor(F.col("pair") / many).cast("int").alias("a_id"), (F.col("pair") % many).cast("int").alias("b_id"), F.col("n").alias("documents"), "best")


def _vocabulary(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).vocab_size()


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per row ``doc_id, a_ids, b_ids, a_group, b_group``: the tokens and the number of each one's group."""
    d = _input(docs, doc_id, text)
    files = _files(docs.sparkSession, a_file, b_file)

    def run(batches):
        t = _tokenizers(files)
        for batch in pieces(batches, "text", CHUNK):
            found = [Alignment(t, *x) for x in t.encode(batch.column("text").to_pylist())]
            columns = [pa.array([getattr(x, k).astype(np.int32) for x in found], pa.list_(pa.int32())) for k in ("a", "b", "a_group", "b_group")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "a_ids", "b_ids", "a_group", "b_group"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>")


def report(docs: DataFrame, **params) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    linked = links(docs, **params)
    counts = materialise(pair_counts(linked, _vocabulary(params.get("b_file", B_FILE))), "alignment-best")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    one = F.explode(F.arrays_zip("pairs", "times")).alias("l")
    each = linked.select("row", one).select("row", F.col("l.pairs").alias("p"), F.col("l.times").alias("times"))
    sums = each.join(counts, F.col("p") == F.col("pair")).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rows = linked.where("stats is not null").select("doc_id", F.col("row").alias("r"), "stats.*")
    zero = F.lit(0).cast("long")
    out = rows.join(sums, F.col("r") == F.col("row"), "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
