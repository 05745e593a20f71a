import random

import numpy as np
import pytest

from corepick.llm import buckets, near
from corepick.llm.groups import connected_groups
from corepick.llm.words import Words


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def edited(rnd, words, n):
    words = words[:]
    for _ in range(n):
        i = rnd.randrange(len(words))
        words[i : i + rnd.randrange(2)] = [f"new{rnd.randrange(10**6)}"]
    return words


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocab, k=40)
    texts = []
    for g in range(12):
        base = rnd.choices(vocab, k=rnd.randrange(100, 200))
        texts.append(" ".join(base))
        texts += [" ".join(edited(rnd, base, rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 9))]
    for _ in range(30):
        texts.append(" ".join([*rnd.choices(vocab, k=50), *passage, *rnd.choices(vocab, k=rnd.randrange(10, 60))]))
    texts += [texts[0], texts[1], None, "", "", "one two", "One, two!", "...", "x " * 9000]
    return texts


def test_keep_one_carries_clashing_columns(spark):
    names = ["tid", "id", "row", "n", "one", "root", "id2", "tid2", "v", "s", "x", "a.b"]
    rows = [(2, "a b c d e f", *names), (1, "a b c d e f", *names), (1, "a b c d e f", *names), (3, None, *names)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names)]))
    assert sorted(map(tuple, near.keep_one(df).collect())) == [rows[1], rows[3]]


def test_classes_equal_brute_force_over_all_pairs(spark, corpus):
    """All texts here are edited lightly enough that every similar pair is connected through shared keys."""
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(corpus)], "doc_id long, text string, class_id string")
    got = {r.doc_id: r for r in near.near_classes(df).collect()}
    words = [near.words_of((t or "").lower()) for t in corpus]
    links = []
    for i in range(len(corpus)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            if (corpus[i] or "") == (corpus[j] or "") or longer and min(len(words[i]), len(words[j])) >= 0.8 * longer and plain_distance(words[i], words[j]) <= 0.2 * longer:
                links.append((i, j))
    want = plain_groups(len(corpus), links)
    assert [got[i].class_id for i in range(len(corpus))] == want
    assert all(got[i].class_size == want.count(want[i]) for i in got)
    kept = near.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({*want}) and kept[0].class_id == "c"


def test_recall_of_candidates_by_edits():
    """Share of pairs with a key in common among texts with 5, 10, 15 and 20 % of words edited."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    for size in (50, 200, 1000):
        for share in (0.05, 0.1, 0.15, 0.2):
            found, pairs = 0, 100
            for _ in range(pairs):
                a = rnd.choices(vocab, k=size)
                b = a[:]
                for i in rnd.sample(range(size), int(share * size)):
                    b[i] = rnd.choice(vocab)
                keys = [set(near.sketch(w.hashes, w.per_text())[0].tolist()) for w in (Words([" ".join(x)]) for x in (a, b))]
                found += bool(keys[0] & keys[1])
            print(size, share, found / pairs)
            assert found >= 0.95 * pairs, (size, share, found)


@pytest.mark.parametrize("kind", ["changed", "mixed"])
def test_recall_of_candidates_by_length(kind):
    """Share of pairs with as many edits as are allowed that have a key in common, from 5 words on."""
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(5000)]
    for size in (5, 7, 10, 15, 19, 20, 21, 24, 25, 26, 30, 40, 5000):
        found, pairs = 0, 20 if size == 5000 else 200
        for _ in range(pairs):
            a = rnd.choices(vocab, k=size)
            b = a[:]
            for i in sorted(rnd.sample(range(size), size // 5), reverse=True):
                new = [rnd.choice(vocab)]
                b[i : i + 1] = new if kind == "changed" else rnd.choice([new, [], [b[i], *new]])
            keys = [set(near.keys_of(w.hashes, w.per_text())[0].tolist()) for w in (Words([" ".join(x)]) for x in (a, b))]
            found += bool(keys[0] & keys[1])
        print(kind, size, found / pairs)
        assert found >= 0.95 * pairs, (size, found / pairs)


def test_short_keys_equal_plain():
    rnd = random.Random(13)
    texts = [rnd.choices("abcdefg", k=rnd.randrange(1, 26)) for _ in range(60)]
    words = Words([" ".join(t) for t in texts])
    lengths = words.per_text()
    keys, counts = near.short_sketch(words.hashes, lengths)
    gram, owner = near.labelled_kmers(words.hashes, lengths, 1)
    ends, seen = counts.cumsum(), {}
    for n in range(len(texts)):
        own, want = gram[owner == n], set()
        for number in range(near.SHORT_KEYS):
            least = sorted(range(len(own)), key=lambda i: int(near.mix(own[i : i + 1] ^ near.mix(np.array([number + 1], np.uint64)))[0]))[: near.SHORT_PICKS]
            want.add(tuple(own[sorted(least)].tolist()))
        got = keys[ends[n] - counts[n] : ends[n]].tolist()
        assert len(got) == len(set(got)) == len(want)
        for text in want:
            seen.setdefault(text, set()).update(got)
    # what has the same words in order has a key in common
    assert all(seen.values())
    both, each = near.keys_of(words.hashes, lengths)
    assert each.tolist() == [int(counts[n]) + (len(near.sketch(words.hashes[owner == n], lengths[n : n + 1])[0]) if lengths[n] >= near.LONG else 0) for n in range(len(texts))]


def test_short_texts_are_grouped(spark):
    rnd = random.Random(14)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(0, 400, 2):
        a = rnd.choices(vocab, k=5 + i % 26)
        b = a[:]
        for j in rnd.sample(range(len(b)), len(b) // 5):
            b[j] = "other"
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i and got[i + 1] in (i, i + 1) for i in range(0, 400, 2))
    assert sum(got[i + 1] == i for i in range(0, 400, 2)) >= 190


def test_keys_beyond_the_broadcast_give_the_same_classes(spark, corpus, monkeypatch):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    want = sorted(map(tuple, near.near_classes(df).collect()))
    monkeypatch.setattr(buckets, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, near.near_classes(df).collect())) == want


def test_sketch_equals_plain():
    rnd = random.Random(6)
    texts = [rnd.choices("abc", k=rnd.randrange(1, 60)) for _ in range(40)]
    words = Words([" ".join(t) for t in texts])
    keys, counts = near.sketch(words.hashes, words.per_text())
    gram, owner = near.labelled_kmers(words.hashes, words.per_text())
    seen, at = {}, 0
    for n, t in enumerate(texts):
        own, times = gram[owner == n].tolist(), {}
        for i, h in enumerate(own):
            kmer = tuple(t[i : i + near.K])
            times[kmer] = times.get(kmer, 0) + 1
            assert seen.setdefault((kmer, times[kmer]), h) == h
        samples = {}
        for h in own:
            samples.setdefault(int(near.mix(np.array([h + 1], np.uint64))[0]) % near.KEYS, []).append(h)
        assert counts[n] == len(samples)
        want = set()
        for number, hs in samples.items():
            key = number
            for h in [h for h in hs if h in sorted(hs)[: near.PICKS]]:
                key = int(near.mix(np.array([(key * 31 + h) % 2**64], np.uint64))[0])
            want.add(key)
        assert set(keys[at : at + counts[n]].tolist()) == want
        at += counts[n]
    assert len(set(seen.values())) == len(seen)


def test_every_candidate_across_groups_is_checked(spark):
    """A chain: the first text of the bucket is like the second only, the third is like the second."""
    rnd = random.Random(9)
    core = [f"c{i}" for i in range(100)]
    chain = [core[:]]
    for s in range(4):
        step = chain[-1][:]
        for i in range(s * 15, s * 15 + 15):
            step[i] = f"s{s}x{i}"
        chain.append(step)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(chain)], "doc_id long, text string")
    assert {r.class_id for r in near.near_classes(df).collect()} == {0}


def test_groups_equal_plain_union(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.v: r.root for r in connected_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_groups(600, [x for x in links if None not in x])
    ends = {v for a, b in links if a is not None and a != b for v in (a, b)}
    assert got == {v: want[v] for v in ends}
    assert connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string, tid string"
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (5, "a b c d e f", "y"), (5, "a b c d e f", "y"), (6, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted((r.doc_id or -1, r.class_id, r.class_size) for r in near.near_classes(df).collect()) == [(-1, 5, 4), (-1, 5, 4), (5, 5, 4), (5, 5, 4), (6, 6, 1)]
    assert sorted((r.doc_id, r.tid) for r in near.keep_one(df).collect()) == [(5, "y"), (6, None)]
    assert near.near_classes(df.limit(0)).count() == 0 and near.keep_one(df.limit(0)).count() == 0
