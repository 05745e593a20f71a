import numpy as np

from corepick.llm import words
from corepick.llm.words import BASE, Words, character_values, mix, power_at


def plain(word: str) -> int:
    values, total = character_values(), 0
    for k, c in enumerate(word):
        total += int(values[ord(c)]) * pow(BASE, k, 1 << 64)
    return int(mix(np.array([(total + len(word)) % (1 << 64)], np.uint64))[0])


def test_hashes_do_not_depend_on_where_words_are_cut(monkeypatch):
    texts = ["one two", "", "  ", "a b " * 400 + "x" * 1000 + " end", "y" * 64, "z" * 65 + " " + "w" * 63]
    want = [plain(w) for t in texts for w in t.split()]
    assert Words(texts).hashes.tolist() == want
    words.powers.cache_clear()
    monkeypatch.setattr(words, "CHARS_AT_ONCE", 64)
    try:
        assert Words(texts).hashes.tolist() == want
        places = np.array([0, 1, 63, 64, 65, 1000])
        assert power_at(places).tolist() == [pow(BASE, int(k), 1 << 64) for k in places]
    finally:
        words.powers.cache_clear()


def test_a_very_long_text_needs_no_table_of_its_length():
    text = "some words of a very long text " * 150_000 + "q" * 1_000_000
    got = Words([text])
    assert len(got.hashes) == 7 * 150_000 + 1 and got.hashes[-1] == plain("q" * 1_000_000)
    assert (got.hashes[:7] == [plain(w) for w in "some words of a very long text".split()]).all()
    assert len(words.powers()[0]) == words.CHARS_AT_ONCE + 1


def test_no_texts():
    assert len(Words([]).hashes) == 0 and len(Words(["", " "]).hashes) == 0


def test_code_points_below_256_take_a_byte_each_and_have_the_same_words():
    texts = ["".join(map(chr, range(256))), "Straße À la CARTE\n× ½_µª", "", "end\n"]
    got, wide = Words(texts), Words([*texts, "Ж"])
    assert got.points.itemsize == 1 and wide.points.itemsize == 4
    assert got.points.tolist() == wide.points[: len(got.points)].tolist() and got.hashes.tolist() == wide.hashes[:-1].tolist()
    assert got.per_text().tolist() == wide.per_text()[:-1].tolist()
    assert [x.tolist() for x in got.lines()] == [x[:-1].tolist() for x in wide.lines()]
