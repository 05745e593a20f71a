import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corepick.llm import buckets
from corepick.llm import lines as fl
from corepick.llm.words import Words
from tests.llm.test_near import plain_distance, plain_groups


def brute(docs):
    """Kept text of each (id, text), by all pairs of lines."""
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    occ = [(i, n, tuple(re.findall(r"\w+", line.lower()))) for i in order for n, line in enumerate((docs[i][1] or "").split("\n"))]
    occ = [o for o in occ if o[2]]
    bags = [Counter(o[2]) for o in occ]
    links = []
    for a in range(len(occ)):
        for b in range(a):
            x, y = occ[a][2], occ[b][2]
            longer = max(len(x), len(y))
            # words that the other line lacks need an edit each
            if x == y or longer - sum((bags[a] & bags[b]).values()) <= 0.2 * longer and plain_distance(x, y) <= 0.2 * longer:
                links.append((a, b))
    root = plain_groups(len(occ), links)
    gone = {(occ[a][0], occ[a][1]) for a in range(len(occ)) if root[a] != a}
    return [t if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in gone) for i, (_, t) in enumerate(docs)]


def corpus():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 12))) for _ in range(500)]
    base = [rnd.choices(vocab, k=rnd.randrange(5, 80)) for _ in range(25)]
    docs = []
    for d in range(40):
        own = []
        for _ in range(rnd.randrange(6)):
            w = (base[0] if rnd.random() < 0.4 else rnd.choice(base))[:]
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            own.append(rnd.choice([" ".join(w), " ".join(w).upper() + ".", "short line", "", " ".join(rnd.choices(vocab, k=9))]))
        docs.append((d, "\n".join(own)))
    return docs + [(90, None), (91, ""), (92, "y " * 20000 + "\n" + "y " * 20000)]


def test_equals_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, v string").repartition(3)
    want = {i: t for (i, _), t in zip(docs, brute(docs))}
    assert {r.doc_id: r.text for r in fl.dedup_lines(df).collect()} == want


def test_shuffles_and_chunks_give_the_same(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for module, name, value in ((buckets, "BROADCAST_KEYS", 0), (buckets, "CHUNK", 3), (buckets, "TEXTS", 2), (fl, "BROADCAST_ROWS", 0), (fl, "BROADCAST_BYTES", 0)):
        monkeypatch.setattr(module, name, value)
    assert {r.doc_id: r.text for r in fl.dedup_lines(df).collect()} == {i: t for (i, _), t in zip(docs, brute(docs))}


def test_nulls_repeats_and_empty_table(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(None, line, 1), (3, f"{line}\nx", 2), (3, f"{line}\nx", 2), (2, f"{line}!\n{line}", 3)], "doc_id long, text string, goes int")
    got = sorted(fl.dedup_lines(df, removed="removed").collect(), key=str)
    assert sorted(((r.doc_id or 0), r.text, r.goes, tuple(r.removed)) for r in got) == [(0, "", 1, (0,)), (2, f"{line}!", 3, (1,)), (3, "x", 2, (0,)), (3, "x", 2, (0,))]
    assert fl.dedup_lines(df.filter(F.lit(False))).count() == 0


def edit(rnd, words, edits, vocab):
    other = words[:]
    for at in sorted(rnd.sample(range(len(words)), edits), reverse=True):
        other[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [other[at], rnd.choice(vocab)]])
    return other


def test_recall_of_candidates_against_edits_alone():
    """Share of pairs with a key in common, by length and edits: all lines up to SHORT words, more than 99 % of longer ones."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    for size in (5, 8, 12, 16, 17, 20, 25, 40, 60, 90, 120, 300):
        for edits in {size // 5, max(1, size // 10), max(1, size // 20)}:
            pairs = [(a, edit(rnd, a, edits, vocab)) for a in (rnd.choices(vocab, k=size) for _ in range(300))]
            found = 0
            for pair in pairs:
                words = [Words([" ".join(p)]) for p in pair]
                keys = [set(fl.line_keys(w.hashes >> np.uint64(16), w.per_text(), 0.8)[0].tolist()) for w in words]
                found += bool(keys[0] & keys[1])
            assert found == 300 if size <= 16 else found >= 295, (size, edits, found)


def test_like_lines_are_found_by_length(spark):
    """One word in five changed, put in or left out: no group is missed in lines of up to 16 words, hardly one in longer ones."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    docs, n, sizes = [], 0, []
    for size in [*range(5, 40), 60, 90, 120]:
        for _ in range(3):
            words = rnd.choices(vocab, k=size)
            other = edit(rnd, words, size // 5, vocab)
            if plain_distance(words, other) <= max(size, len(other)) // 5:
                docs += [(n, " ".join(words)), (n + 1, " ".join(other))]
                sizes.append(size)
                n += 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in fl.dedup_lines(df).collect()}
    missed = [s for i, s in enumerate(sizes) if got[2 * i + 1]]
    assert len(missed) <= 1 and all(s > 16 for s in missed) and all(got[i] for i in range(0, n, 2))


def test_clashing_columns_stay(spark):
    names = ["v", "k", "t", "n", "row", "goes", "k2", "t2", "root", "one", "line", "stays", "none", "all", "w", "s", "a.b"]
    df = spark.createDataFrame([(1, "a b c d e", *names), (2, "a b c d e\nx", *names)], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names)]))
    got = {r.doc_id: tuple(r) for r in fl.dedup_lines(df).collect()}
    assert got == {1: (1, "a b c d e", *names), 2: (2, "x", *names)}


def test_short_lines_repeat_too(spark):
    df = spark.createDataFrame([(1, "Read more\n{\nHome"), (2, "read more!\n{\nother"), (3, "Home\nread less")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in fl.dedup_lines(df).collect()}
    assert got == {1: "Read more\n{\nHome", 2: "{\nother", 3: "read less"}


def test_words_of_every_document_are_counted(spark):
    """Words beyond a sample of documents or a number of words are ranked too, and the common ones of all documents are told."""
    docs = [(i, " ".join([f"w{i}"] * (1 + i % 7) + ["the"] * 3)) for i in range(60_000)] + [(60_000, None), (60_001, "")]
    ranks = fl.word_ranks(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    places = lambda words: np.array([Words([w]).hashes[0] for w in words]) >> np.uint64(64 - fl.RANK_BITS)
    words = [f"w{i}" for i in range(60_000)]
    want = np.zeros(1 << fl.RANK_BITS, np.int64)
    np.add.at(want, places([*words, "the"]), [*(1 + i % 7 for i in range(60_000)), 180_000])
    assert (np.diff(ranks[np.argsort(want, kind="stable")].astype(int)) >= 0).all()
    assert (ranks[want > 1] > 0).all() and np.flatnonzero(ranks >> 15).tolist() == places(["the"]).tolist()
