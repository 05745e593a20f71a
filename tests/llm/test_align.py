import random

from corepick.llm.align import edits_within


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_equals_the_full_table():
    rnd = random.Random(1)
    for _ in range(20000):
        a = [rnd.choice("abc") for _ in range(rnd.randrange(14))]
        b = a[:]
        for _ in range(rnd.randrange(6)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "b", "c"])
        most, d = rnd.randrange(8), plain(a, b)
        assert edits_within(a, b, most) == (d if d <= most else None), (a, b, most)


def test_long_sequences():
    a = list(range(20000))
    b = a[:500] + [-1, -2] + a[503:19000] + a[19100:]
    assert edits_within(a, b, 4000) == plain(a[490:520], b[490:519]) + 100
