import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corepick.llm import buckets
from tests.llm.test_near import plain_distance


def test_alike_equals_plain_distance():
    rnd = random.Random(12)
    seen = Counter()
    for _ in range(400):
        vocab = list(range(rnd.choice([3, 20, 500])))
        a = rnd.choices(vocab, k=rnd.randrange(1, 90))
        b = a[:]
        for _ in range(rnd.randrange(0, 1 + len(a) // 3)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = rnd.choices(vocab, k=rnd.randrange(2))
        if rnd.random() < 0.2:
            rnd.shuffle(b)
        x, y = (buckets.mix(np.array(v, np.uint64) + np.uint64(5)) for v in (a, b))
        most = buckets.edits_allowed(max(len(a), len(b)), 0.8)
        want = plain_distance(a, b) <= most
        seen[want] += 1
        assert buckets.alike(x, y, 0.8) == want
        both = [np.concatenate([x, y]), np.array([len(a), len(b)])]
        if len(b):
            prints = buckets.Prints(buckets.pa.array(buckets.prints_of(*both), buckets.pa.binary()), both[1], 0.8)
            assert prints.may_be_like(np.array([0]), np.array([1]))[0] or not want  # the filter drops no link
    assert min(seen.values()) > 50


def test_in_common_counts_repeats():
    got = buckets.in_common(np.array([1, 1, 2, 5], np.uint64), np.array([1, 1, 1, 5, 7], np.uint64))
    assert got == 3 and buckets.in_common(np.empty(0, np.uint64), np.array([1], np.uint64)) == 0


def test_unlike_items_of_a_bucket_meet_many_pairs_at_once_and_each_pair_once(monkeypatch):
    rng = np.random.default_rng(5)
    hashes, n = rng.integers(0, 1 << 63, (300, 40)).astype(np.uint64), 300
    fp = pa.array(buckets.prints_of(hashes.ravel(), np.full(n, 40)), pa.binary())
    met = []
    real = buckets.Prints.may_be_like
    monkeypatch.setattr(buckets.Prints, "may_be_like", lambda self, a, b: met.append(list(zip(a.tolist(), b.tolist()))) or real(self, a, b))
    root = buckets.bucket_parts(buckets.Prints(fp, np.full(n, 40), 0.8), np.array([200, 300]))
    assert root.tolist() == list(range(n))
    pairs = [x for some in met[1:] for x in some]
    within = {(i, j) for a, b in ((0, 200), (200, 300)) for i in range(a, b) for j in range(i + 1, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == within
    assert len(met) < 20  # one call for each distance before: 200


def test_the_bound_by_words_in_common_changes_no_answer(monkeypatch):
    rnd, seen = random.Random(3), Counter()
    for _ in range(200):
        a = rnd.choices(range(60), k=rnd.randrange(30, 90))
        b = [x for x in a if rnd.random() > 0.1] + rnd.choices(range(60), k=rnd.randrange(12))
        x, y = (buckets.mix(np.array(v, np.uint64) + np.uint64(5)) for v in (a, b))
        got = []
        for few in (0, 1000):
            monkeypatch.setattr(buckets, "FEW", few)
            got.append(buckets.alike(x, y, 0.8))
        seen[got[0]] += 1
        assert got[0] == got[1]
    assert min(seen.values()) > 20


def test_what_an_item_says_twice_does_not_cancel_out_and_no_link_is_dropped():
    rng, rnd = np.random.default_rng(8), random.Random(8)
    hashes = rng.integers(0, 1 << 63, (2, 200)).astype(np.uint64)
    twice = np.concatenate([hashes[0], hashes[0], hashes[1], hashes[1]])
    prints = buckets.Prints(pa.array(buckets.prints_of(twice, np.array([400, 400])), pa.binary()), np.array([400, 400]), 0.8)
    assert not prints.may_be_like(np.array([0]), np.array([1]))[0]
    for _ in range(300):
        a = rnd.choices(range(rnd.choice([1, 2, 8, 60])), k=rnd.randrange(2, 150))
        b, most = a[:], buckets.edits_allowed(len(a), 0.8)
        for _ in range(rnd.randrange(most + 1)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = rnd.choices(range(70), k=rnd.randrange(2))
        if not b or plain_distance(a, b) > buckets.edits_allowed(max(len(a), len(b)), 0.8):
            continue
        both, sizes = [buckets.mix(np.array(v, np.uint64) + np.uint64(5)) for v in (a, b)], np.array([len(a), len(b)])
        prints = buckets.Prints(pa.array(buckets.prints_of(np.concatenate(both), sizes), pa.binary()), sizes, 0.8)
        assert prints.may_be_like(np.array([0]), np.array([1]))[0]
