"""Language-model scores of the third review: words are looked up as arrays, not one by one."""

import numpy as np
import pyarrow as pa

from lodestar.llm import lm_scoring as lm
from lodestar.llm.tokens import Words, mix64


def test_words_are_looked_up_as_arrays():
    known = {b"the": 0, "é".encode(): 2, b"a": 1}
    weight = np.array([3.0, 2.0, 1.0])
    _, words = Words(pa.array(["the a zebra", "é b", None, "zebra the 漢字"])).coded()
    words = words.slice(1)  # an array that does not begin at its buffer's start
    for vocab in (lm.Vocabulary(known, np.array([0, -1, 2]), weight, 0.0), lm.Vocabulary({}, np.zeros(0, int), np.zeros(0), 0.0)):
        hit, symbol, w = vocab.look_up(words)
        for i, x in enumerate(words.to_pylist()):
            at = vocab.words.get(x, -1)
            tail = np.array([x[-1] | (x[-2] << 8 if len(x) > 1 else 0)], np.uint64)
            shared = lm.OWN + 1 + int(mix64(tail)[0] % np.uint64(lm.BUCKETS))
            own = int(vocab.symbol[at]) if at >= 0 else -1
            assert (hit[i], symbol[i], w[i]) == (at >= 0, own if own >= 0 else shared, weight[at] if at >= 0 else 0)


def test_log_probabilities_equal_plain_softmaxes():
    r = np.random.default_rng(1)
    net = lm.Network.start(r.integers(1, 1000, lm.SYMBOLS).astype(float))
    one, two, place = (r.integers(0, lm.SYMBOLS, 300) for _ in range(3))
    got = net.log_probability(one, two, place, block=128)
    for i in range(0, 300, 7):
        q = net.context[one[i]] * net.scales[0] + net.context[two[i]] * net.scales[1]
        k, s = divmod(place[i], lm.SLOTS)
        z = [t[:, :-1].astype(float) @ q + t[:, -1] for t in (net.classes, net.places[k * lm.SLOTS : (k + 1) * lm.SLOTS])]
        want = sum(x[j] - np.log(np.exp(x).sum()) for x, j in zip(z, (k, s), strict=True))
        assert abs(got[i] - want) < 1e-4
