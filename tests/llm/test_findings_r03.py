"""Cases of the third review, of the training-data operators."""

import numpy as np
import pyarrow as pa

from lodestar.llm import ann, lm_scoring, near_duplicates


def test_recall_counts_every_copy_of_a_query(spark):
    # few distinct queries need few cells, but most queries are copies of one that needs nearly all
    r = np.random.default_rng(5)
    axis = np.eye(8)[0]
    away = lambda n, norm: (-axis + 0.1 * r.normal(size=(n, 8))) * norm
    there = np.concatenate([away(300, np.ldexp(1.0, r.integers(0, 10, (300, 1)))), away(100, 1000.0), (axis + 0.1 * r.normal(size=(30, 8))) * 600])
    asked = np.concatenate([away(400, 1.0), np.repeat(axis[None, :], 1000, 0)])
    x = {2 * i: v for i, v in enumerate(asked)} | {2 * i + 1: v for i, v in enumerate(there)}
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>"), every=2).collect()
    ids, v = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    hit = 0
    for q in range(0, 2800, 2):
        score = np.where(ids == q, -np.inf, v @ x[q])
        near = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit += len(near & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 1400 * 20 and hit >= 0.9 * len(got)


def test_texts_of_a_crowd_similar_only_to_each_other_are_linked(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):  # sixty couples in one crowd: equal shingles, near fingerprints, far from all others
        first = r.bytes(8)
        rows += [(uid, first + bytes(56), [i * 10 + k for k in range(5)]) for uid in (i, 100 + i)]
    df = spark.createDataFrame(rows, "uid long, fp binary, shingles array<long>")
    got = near_duplicates.links(df.select("uid", "fp"), df.select("uid", "shingles"), [(list(range(448, 464)), 0)], 0.8)
    assert sorted((x.u, x.v) for x in got.collect()) == [(100 + i, i) for i in range(60)]


def test_gradient_steps_visit_every_token_of_a_large_corpus():
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(1 + i % 40)) for i in range(400)]
    tokens = sum(len(t.split()) + 1 for t in texts)
    vocab = lm_scoring.Vocabulary({b"w%d" % i: i for i in range(7)}, np.arange(7), np.ones(7), 1.0)
    learn = lm_scoring._learn(vocab, np.ones(lm_scoring.SYMBOLS), lm_scoring.LEAST_VISITS)
    rows = pa.Table.from_batches(list(learn([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))).to_pydict()
    assert dict(zip(rows["row"], rows["n"], strict=True))[max(rows["row"])] >= tokens  # the scales take part in every step
