"""Exact removal of repeated passages by recompression.

Every word gets a global name, half of the XXH3 of its bytes, and so does every
symbol that stands for a pair or a run: the same in every task and document, without
asking anyone. A round splits the
names into two sides by a hash bit and replaces each pair (left, right) by one
new name; symbols that stay alone are then merged with equal neighbours, so
that runs shrink too. A name is a hash of what it replaces, hence the same in
every task and every document: equal passages get equal symbols except near
their ends. Each symbol carries the word range that decided it. A symbol of at
least ``LEAST`` words whose deciding range fits in a window of ``WINDOW`` words
is an anchor of that window wherever the window occurs.

A window is filed under its anchor of least hash (under its own name if it has
none), so neighbouring windows travel together: one record holds the anchor's
name, the place, and 64 bits of verification for each window, made from the
other halves of its words' hashes. Spark groups the records by name; the group
decides, from name, offset and verification bits together, which windows also
start in a document with a smaller id: windows are equal if 128 bits are.

Skew: a task first settles the windows that repeat among its own texts and
sends only those of the least document id, so a passage of a third of all
documents costs one record a task. Records are dealt by hash of the name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import Words, mix64, pieces, utf8, windows
from lodestar.session import small_batches

WINDOW, ROUNDS, LEAST = 13, 4, 3
#: Bytes of text that a task handles at once.
CHUNK = 6 << 20
#: Bytes of text a share of the names, which one task decides in memory.
SHARE = 16 << 20
LAST = np.iinfo(np.int64).max
_FAR = 1 << 28
SENT = "pid int, settled boolean, data binary"
HOMES = "home int, data binary"
MARKS = "id long, mark long, marks binary"
_SEGMENT = np.dtype([("key", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("rel", "u1"), ("n", "u1")])


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, least: int = LEAST, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchors ``(name, start, low, high)`` of the word sequences; low..high decided the symbol."""
    n = len(names)
    name, start = names, np.arange(n, dtype=np.int32)
    end, low, high = start.copy(), start.copy(), start.copy()
    kept: list[tuple[np.ndarray, ...]] = []
    for r in range(rounds):
        m = len(name)
        if m < 2:
            break
        right = (mix64(name, r + 1) >> np.uint64(63)).astype(bool)
        same = doc[1:] == doc[:-1]
        pair = np.zeros(m, bool)
        pair[:-1] = ~right[:-1] & right[1:] & same
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        alone = ~pair & ~second
        before, after = low.copy(), high.copy()
        before[1:] = np.where(same, low[:-1], -_FAR)
        after[:-1] = np.where(same, high[1:], _FAR)
        before[0], after[-1] = -_FAR, _FAR
        i = np.flatnonzero(pair)
        name, end, new_low, new_high = name.copy(), end.copy(), low.copy(), high.copy()
        name[i] = mix64(name[i] * np.uint64(3) + mix64(name[i + 1], 77), r + 101)
        end[i] = end[i + 1]
        new_low[i], new_high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        # that a symbol stays alone, or how far a run of it goes, depends on both neighbours
        new_low[alone] = np.minimum(low[alone], before[alone])
        new_high[alone] = np.maximum(high[alone], after[alone])
        keep = ~second
        name, start, end, low, high, doc, alone = name[keep], start[keep], end[keep], new_low[keep], new_high[keep], doc[keep], alone[keep]
        run = np.zeros(len(name), bool)
        run[1:] = alone[1:] & alone[:-1] & (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
        if run.any():
            head = np.flatnonzero(~run)
            size = np.diff(np.append(head, len(run)))
            low, high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
            end = end[head + size - 1]
            name = np.where(size > 1, mix64(name[head] + mix64(size.astype(np.uint64), 55), r + 201), name[head])
            start, doc, alone = start[head], doc[head], alone[head] & (size == 1)
        good = ~alone & (end - start + 1 >= least) & (high - low < window)
        kept.append((name[good], start[good], low[good], high[good]))
    if not kept:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int32),) * 3
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def choose(anchors: tuple[np.ndarray, ...], n: int, window: int = WINDOW) -> np.ndarray:
    """For each window start the number of its anchor of least hash, or -1."""
    name, _, low, high = anchors
    rank = mix64(name, 9)
    order = np.argsort(rank)[::-1]
    best, at = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.full(n, -1, np.int32)
    spare, low, slack = np.full(n, -1, np.int32), low[order], window - 1 - (high - low)[order]
    for k in range(window):
        fit = (slack >= k) & (low >= k)
        p = low[fit] - k
        if not len(p):
            continue
        spare[p] = order[fit]  # of several the last is written last: the least
        p = np.flatnonzero(spare >= 0)
        a = spare[p]
        spare[p] = -1
        less = (rank[a] < best[p]) | ((rank[a] == best[p]) & (at[p] < 0))
        p, a = p[less], a[less]
        best[p], at[p] = rank[a], a
    return at


def _pack(ids: np.ndarray, marks: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """Ranges of window starts, one entry a range: its document, first start and number."""
    return b"".join(np.ascontiguousarray(x, t).tobytes() for x, t in ((ids, "<i8"), (marks, "<i8"), (first, "<u4"), (count, "<u4")))


def _unpack_marks(packs: list[bytes]) -> list[np.ndarray]:
    parts = []
    for data in packs:
        n, out, at = len(data) // 24, [], 0
        for t in ("<i8", "<i8", "<u4", "<u4"):
            out.append(np.frombuffer(data, t, n, at))
            at += out[-1].nbytes
        parts.append(out)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _ranges(doc: np.ndarray, at: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive window starts (sorted by document and place) as ranges for ``_pack``."""
    if not len(doc):
        return ids[:0], marks[:0], at[:0], at[:0]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    return ids[doc[head]], marks[doc[head]], at[head], np.diff(np.append(head, len(doc)))


def _by_home(ranges: tuple[np.ndarray, ...], parts: int) -> Iterator[tuple[int, bytes]]:
    """One pack for each share of the documents that has any."""
    home = (mix64(ranges[0].view(np.uint64), 8) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(home, kind="stable")
    bound = np.searchsorted(home[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bound)).tolist():
        own = order[bound[k] : bound[k + 1]]
        yield k, _pack(*(x[own] for x in ranges))


def _send(parts: int, window: int):
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
        order = np.argsort(ids, kind="stable")
        batch = batch.take(pa.array(order))
        ids, marks = ids[order], np.asarray(batch.column("mark").to_numpy(zero_copy_only=False), np.int64)
        w = Words(batch.column("text"))
        n = len(w.start)
        if n < window:
            return
        names, others = w.names()
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(w.first))
        valid = np.zeros(n, bool)
        valid[: n - window + 1] = doc[: n - window + 1] == doc[window - 1 :]
        whole, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        whole[: n - window + 1] = windows(names, window)
        check[: n - window + 1] = windows(others, window, 5)
        anchors = recompress(names, doc, window=window)
        anchor = choose(anchors, n, window)
        del names, others

        # windows that repeat here: those of a larger id are settled
        p = np.flatnonzero(valid)
        o = p[np.argsort(whole[p], kind="stable")]  # positions are in order of id
        new = np.append(True, (whole[o[1:]] != whole[o[:-1]]) | (check[o[1:]] != check[o[:-1]]))
        first = ids[doc[o[new]]]
        later = np.zeros(n, bool)
        later[o] = ids[doc[o]] > np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(o))))
        rows: list[tuple] = []
        q = np.flatnonzero(later)
        rows += [(k, True, data) for k, data in _by_home(_ranges(doc[q], q - w.first[doc[q]], ids, marks), parts)]

        p = np.flatnonzero(valid & ~later)
        a = anchor[p]
        key = np.where(a >= 0, anchors[0][a] if len(anchors[0]) else 0, whole[p])
        rel = np.where(a >= 0, (anchors[1][a] if len(anchors[0]) else 0) - p, 255).astype(np.uint8)
        new = np.append(True, (p[1:] != p[:-1] + 1) | (a[1:] != a[:-1]) | (a[1:] < 0) | (doc[p[1:]] != doc[p[:-1]]))[: len(p)]
        head = np.flatnonzero(new)
        seg = np.zeros(len(head), _SEGMENT)
        seg["key"], seg["doc"], seg["rel"] = key[head], doc[p[head]], rel[head]
        seg["at"], seg["n"] = p[head] - w.first[doc[p[head]]], np.diff(np.append(head, len(p)))
        pid = (mix64(seg["key"], 3) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(pid, kind="stable")
        bound = np.searchsorted(pid[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(bound)).tolist():
            own = order[bound[k] : bound[k + 1]]
            s = seg[own]
            used, s["doc"] = np.unique(s["doc"], return_inverse=True)
            at = np.repeat(head[own] - np.append(0, np.cumsum(s["n"][:-1], dtype=np.int64)), s["n"]) + np.arange(int(s["n"].sum()))
            rows.append((k, False, _pack_segments(s, ids[used], marks[used], check[p[at]])))
        for i in range(0, len(rows), 64):
            cols = list(zip(*rows[i : i + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["pid", "settled", "data"])

    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            yield from one(batch)

    return run


_PLACES = [c for c in _SEGMENT.names if c != "key"]


def _pack_segments(s: np.ndarray, ids: np.ndarray, marks: np.ndarray, check: np.ndarray) -> bytes:
    """Sizes; places and documents, as small differences and compressed; then names and checks, which are random."""
    small = [*(s[c] for c in _PLACES if c != "doc"), np.diff(s["doc"].astype(np.int32), prepend=np.int32(0)), np.diff(ids, prepend=np.int64(0)), marks]
    body = pa.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in small), codec="zstd", asbytes=True)
    return b"".join([np.array([len(s), len(ids), len(body)], "<u8").tobytes(), body, np.ascontiguousarray(s["key"]).tobytes(), np.ascontiguousarray(check).tobytes()])


def _unpack(data: pa.Buffer) -> tuple[np.ndarray, ...]:
    """(key, document, first window, place in the name, windows) of each segment, (id, mark) of each document, checks."""
    m, u, size = np.frombuffer(data, "<u8", 3).astype(int)
    kinds = [*((c, _SEGMENT[c], m) for c in _PLACES if c != "doc"), ("doc", np.dtype("<i4"), m), ("ids", np.dtype("<i8"), u), ("marks", np.dtype("<i8"), u)]
    body = pa.decompress(data.slice(24, size), sum(t.itemsize * n for _, t, n in kinds), codec="zstd")
    found, at = {}, 0
    for name, t, n in kinds:
        found[name] = np.frombuffer(body, t, n, at)
        at += t.itemsize * n
    at = 24 + size
    key = np.frombuffer(data, "<u8", m, at)
    return key, np.cumsum(found["doc"], dtype=np.int64).astype(np.uint32), found["at"], found["rel"], found["n"], np.cumsum(found["ids"], dtype=np.int64), found["marks"], np.frombuffer(data, "<u8", -1, at + 8 * m)


def _decide(table: pa.Table) -> pa.Table:
    """The records of a share of the names -> packs of the windows that a smaller id has too.

    Packs that a task settled by itself come along under the share of their documents.
    """
    total = len(table) and table["parts"][0].as_py()
    ranges: list[tuple[np.ndarray, ...]] = []
    settled = [data.as_py() for s, data in zip(table["settled"].to_pylist(), table["data"], strict=True) if s]
    if settled:
        ranges.append(tuple(_unpack_marks(settled)))
    docs, marks, parts, base = [], [], [], 0
    for s, data in zip(table["settled"].to_pylist(), table["data"], strict=True):
        if s:
            continue
        key, doc, at, rel, n, ids, mark, check = _unpack(data.as_buffer())
        parts.append((np.repeat(key, n), np.repeat(doc + np.uint32(base), n), at, rel, n, check))
        docs.append(ids)
        marks.append(mark)
        base += len(ids)
    if parts:
        ids, marks = np.concatenate(docs), np.concatenate(marks)
        n = np.concatenate([x[4] for x in parts]).astype(np.int64)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key, doc, check = (np.concatenate([x[i] for x in parts]) for i in (0, 1, 5))
        at = np.repeat(np.concatenate([x[2] for x in parts]).astype(np.int64), n) + step
        rel = np.repeat(np.concatenate([x[3] for x in parts]).astype(np.int64), n)
        rel = np.where(rel == 255, 255, rel - step).astype(np.uint64)
        key = mix64(key) + mix64(rel, 4)
        tail = check
        del parts, rel, step, check
        key += mix64(tail, 6)  # one sort: rows of one key and one tail are equal in all three
        order = np.argsort(key)
        same = (key[order[1:]] == key[order[:-1]])
        if (same & (tail[order[1:]] != tail[order[:-1]])).any():
            order = np.lexsort((tail, key))
            same = (key[order[1:]] == key[order[:-1]]) & (tail[order[1:]] == tail[order[:-1]])
        head = np.flatnonzero(np.append(True, ~same))
        own = ids[doc[order]]
        least = np.minimum.reduceat(own, head)
        hit = order[own > np.repeat(least, np.diff(np.append(head, len(order))))]
        del key, tail, order, own
        hit = hit[np.lexsort((at[hit], doc[hit]))]
        ranges.append(_ranges(doc[hit], at[hit], ids, marks))
    rows = list(_by_home(tuple(np.concatenate(x) for x in zip(*ranges, strict=True)), total)) if ranges else []
    return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["home", "data"])


def _gather(table: pa.Table) -> pa.Table:
    """Packs of a share of the documents -> one row a document."""
    ids, marks, first, count = _unpack_marks([x.as_py() for x in table["data"]])
    order = np.lexsort((marks, ids))
    ids, marks, pairs = ids[order], marks[order], np.stack([first, count], 1)[order]
    head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))
    data = [pairs[a:b].tobytes() for a, b in zip(head, np.append(head[1:], len(ids)), strict=True)]
    return pa.table([pa.array(ids[head]), pa.array(marks[head]), pa.array(data, pa.binary())], ["id", "mark", "marks"])


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts as ``doc_id, id, mark, text``, marks as ``id, mark, marks``).

    ``marks`` lists packed ranges of window starts (first, count; 32 bits each).
    """
    spark = docs.sparkSession
    small_batches(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    own = F.col(doc_id).try_cast("long")
    # a mark is only needed where an id does not tell a row from others; each pack repeats it
    once = docs.select(own.alias("i")).where("i is not null").groupBy("i").count().where("count > 1").isEmpty()
    mark = F.when(own.isNull() | F.lit(not once), F.xxhash64(t)).otherwise(F.lit(0).cast("long"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(own, F.lit(int(LAST))).alias("id"), mark.alias("mark"), t.alias("text"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(2 * spark.sparkContext.defaultParallelism, size // SHARE)
    sent = d.select(F.col("id").alias("doc_id"), "mark", "text").mapInArrow(_send(parts, window), SENT)
    homes = sent.withColumn("parts", F.lit(parts)).groupBy("pid").applyInArrow(_decide, HOMES)
    return d, homes.groupBy("home").applyInArrow(_gather, MARKS)


def _kept(window: int, texts: bool):
    def run(batches):
        for batch in pieces(batches, "text", CHUNK):
            data, offsets = utf8(batch.column("text"))
            n_words, n_removed, out = [], [], []
            for i, marks in enumerate(batch.column("marks").to_pylist()):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n_words.append(len(words))
                if marks:
                    drop = np.zeros(len(words) + 1, np.int32)
                    for first, count in np.frombuffer(marks, "<u4").reshape(-1, 2).astype(np.int64):
                        drop[first] += 1
                        drop[first + count + window - 1] -= 1
                    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                    words = [words[j] for j in keep]
                n_removed.append(n_words[-1] - len(words))
                joined = b" ".join(words)
                out.append(joined if texts else hashlib.sha256(joined).hexdigest())
            cols = [batch.column(k) for k in range(batch.num_columns - 2)]
            last = pa.array(out, pa.binary()).cast(pa.string()) if texts else pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], [*batch.schema.names[:-2], "n_words", "n_removed", "kept"])

    return run


def _applied(docs: DataFrame, texts: bool, **params) -> DataFrame:
    d, marks = repeated(docs, **params)
    m = marks.select(F.col("id").alias("m_id"), F.col("mark").alias("m_mark"), "marks")
    joined = d.join(m, (F.col("id") == F.col("m_id")) & (F.col("mark") == F.col("m_mark")), "left").select("doc_id", "text", "marks")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_kept(params.get("window", WINDOW), texts), f"doc_id {kind}, n_words long, n_removed long, kept string")


def report(docs: DataFrame, **params) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``window`` words around it also starts in a
    document with a smaller id; windows are judged on the input. Null texts have
    no words; a null id (as is one that is no integer) is larger than any other and never repeats itself; rows
    with equal ids are one document in that they remove nothing from each other, and are told apart by 64 bits
    of a hash of the text; ids keep their type;
    an empty table gives no rows.
    """
    return _applied(docs, False, **params).withColumnRenamed("kept", "kept_sha256")


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the kept words, joined by one space; all else as in ``report``."""
    return _applied(docs, True, **params).withColumnRenamed("kept", "text")


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, unnest(list_transform(range(0, len(w) - 12), lambda i: {'pos': i, 'win': array_to_string(w[i + 1 : i + 13], ' ')})) as p
  from w where len(w) >= 13),
least_doc as (select p.win as win, min(doc_id) as d from win group by 1),
gone as (
  select distinct doc_id, unnest(range(win.p.pos, win.p.pos + 13)) as pos
  from win join least_doc l on l.win = win.p.win where l.d < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from w),
kept as (
  select doc_id, count(*) as k, string_agg(word, ' ' order by pos) as kept
  from words anti join gone using (doc_id, pos) group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""
