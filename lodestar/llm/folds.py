"""Which documents a model may learn from, and bounded labelled samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of all texts of a labelled sample together.
FIT_CHARS = 16_000_000


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have remainder -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def held_out(doc_id: Column, n: int, r: int) -> Column:
    return remainder(doc_id, n) == r


def sample_texts(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int = FIT_CHARS) -> tuple[list, list[str]]:
    """``sample_column`` with the texts as a list."""
    labels, texts = sample_column(docs, labelled, doc_id, text, chars)
    return labels, texts.to_pylist()


def sample_column(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int = FIT_CHARS) -> tuple[list, pa.Array]:
    """(labels, texts) of ``labelled`` (``id, label``: a sample of bounded size), in order of id.

    One text is taken of each id, however many rows repeat it, and texts are
    whole. They are taken in order of the hash of their id as long as they fit
    into ``chars`` characters together; one that does not fit is passed over.
    """
    kind = labelled.schema["id"].dataType.simpleString()
    row = docs.select(F.col(doc_id).try_cast(kind).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    row = row.select("d", "t", F.xxhash64("t").alias("h"), F.length("t").alias("n"))
    sizes = row.join(F.broadcast(labelled), F.col("d") == F.col("id")).groupBy("id").agg(F.min(F.struct("n", "h")).alias("m"), F.first("label").alias("label"))
    taken, left = [], chars
    for r in sizes.select("id", "label", "m.n", "m.h").orderBy(F.xxhash64("id"), "id").collect():  # one row an id of the sample
        if r.n <= left:
            taken.append((r.id, r.h, r.n, r.label))
            left -= r.n
    if not taken:
        return [], pa.array([], pa.string())
    wanted = docs.sparkSession.createDataFrame([x[:3] for x in taken], f"w_id {kind}, w_h long, w_n int")
    found = row.join(F.broadcast(wanted), (F.col("d") == F.col("w_id")) & (F.col("h") == F.col("w_h")) & (F.col("n") == F.col("w_n")))
    # in Arrow batches as tasks give them: neither the driver's JVM nor its Python holds them as objects
    texts = found.groupBy("w_id").agg(F.min("t").alias("t")).toArrow()
    at = {x: i for i, x in enumerate(texts["w_id"].to_pylist())}
    taken.sort(key=lambda x: x[0])
    return [x[3] for x in taken], texts["t"].combine_chunks().take(pa.array([at[x[0]] for x in taken]))
