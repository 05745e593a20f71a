"""BPE encoding and decoding with a contiguous rank array per short word.

A word is held as two contiguous rows: the ids of its parts (their boundaries lie between neighbours) and the merge rank of
each adjacent pair. One step scans the ranks for the leftmost minimum, deletes that boundary and refreshes the ranks left
and right of it. The new words of some texts take these steps side by side as the rows of numpy matrices; words once met
are kept, ``CACHED`` of them and those met again since (:class:`Kept`). Words of more than ``LONG_WORD`` bytes keep the same state in linked lists and find the
minimum through a heap, which gives the same merges without a quadratic scan.

Nulls: a null text is encoded as the empty one, null ids decode to the empty text. Repeated rows and empty tables need no
care, since one column is added to each row and nothing is shuffled; extra columns stay, whatever their names. Ties: of equal
ranks the leftmost merges first. Very long texts are worked on whole, a slice of texts at a time. Classes of characters come
from Python's Unicode tables; characters that are newer than those may differ from the library (tests go up to U+30000).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.common import fresh, small_batches, table

#: White space in the sense of the tokenizer's patterns: Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same for the patterns of Arrow.
WHITE_RUN = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
LONG_WORD = 256
CACHED = 1 << 15
BYTES_AT_ONCE = 1 << 20
NO_MERGE = np.int32(np.iinfo(np.int32).max)
#: Characters that are neither letters, digits nor white space, without the apostrophe.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(free))
        free += b not in printable
    return out


def unicode_class(major: str) -> str:
    """Ranges of a general category for a bracket of ``re``, from Python's own Unicode tables (characters newer than those differ)."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Kept(dict):
    """Up to ``most`` entries of late (and what one call adds), and the ``most`` before them as long as they are asked for again: rare
    words come and go, and the common ones stay."""

    def __init__(self, most: int):
        self.most, self.before = most, {}

    def __missing__(self, key):
        self[key] = value = self.before[key]
        return value

    def unknown(self, keys: set) -> set:
        return keys.difference(self).difference(self.before)

    def age(self) -> None:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()


class WordBpe:
    """A tokenizer file of the word BPE kind: NFC, lower case, white space dropped, byte alphabet, word-end suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(vocab.items(), self.added.items())}
        self.inner = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        self.final = np.array([vocab[c + suffix] for c in byte_alphabet()], np.int32)
        self.rank, merged = {}, []
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = n
            merged.append(vocab[left + right])
        keys = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
        order = np.argsort(keys)
        #: The same ranks as sorted arrays; the last key is above all others.
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.fromiter(self.rank.values(), np.int32, len(self.rank))[order], NO_MERGE)
        self.merged = np.array(merged, np.int32)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for short, wide in (("\\p{L}", unicode_class("L")), ("\\p{N}", unicode_class("N")), ("\\s", WHITE)):
            pattern = pattern.replace(short, wide)  # in such files all of them stand within brackets
        self.word = re.compile(pattern).findall
        self.chunks = re.compile(f"[^{WHITE}]+").findall
        self.specials = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        #: The ids of chunks and of words, as the bytes of 32-bit numbers.
        self.cache, self.words = Kept(CACHED), {}
        named = [self.tokens.get(i) for i in range(max(self.tokens) + 1)]
        self.names = pa.array(named, pa.string())

    def encode(self, text: str) -> array:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[array]:
        """ids of each text; the words that are new in any of them are merged together."""
        pieces = [self.specials.split(t) if self.specials and any(a in t for a in self.added) else [t] for t in texts]
        chunks = [[self._chunks(p) for p in ps[::2]] for ps in pieces]
        self._learn(self.cache.unknown(set().union(*chain.from_iterable(chunks))))
        out, ids_of = [], self.cache.__getitem__
        for ps, cs in zip(pieces, chunks):
            ids = array("i")
            for k, x in enumerate(cs):
                if k:
                    ids.append(self.added[ps[2 * k - 1]])
                ids.frombytes(b"".join(map(ids_of, x)))
            out.append(ids)
        self._forget()
        return out

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """ids of each text of an array without nulls; what is between white space is looked up once however often it occurs."""
        if any(pc.any(pc.match_substring(texts, a)).as_py() for a in self.added):
            ids = self.encode_many(texts.to_pylist())
            flat = pa.array(np.frombuffer(b"".join(i.tobytes() for i in ids), np.int32))
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat)
        chunks = pc.split_pattern_regex(texts, WHITE_RUN)
        flat = chunks.flatten().dictionary_encode()
        known = flat.dictionary.to_pylist()
        self._learn(self.cache.unknown({*known}))
        known = [self.cache[c] for c in known]
        self._forget()
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = flat.indices.to_numpy()
        start, many = (np.cumsum(size) - size)[at], size[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        place = np.arange(ends[-1]) + np.repeat(start - ends[:-1], many)
        first = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(ends[first], pa.int32()), pa.array(np.frombuffer(b"".join(known), np.int32)[place]))

    def _forget(self) -> None:
        self.cache.age()
        if len(self.words) > CACHED:
            self.words.clear()

    def _chunks(self, text: str) -> list[str]:
        """The parts of a text between white space; Python splits at four control characters more."""
        return self.chunks(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the library does for a file without a decoder; unknown ids give nothing."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def _plain(self, chunks: list[str]) -> list[str]:
        """The chunks normalised, in lower case; all at once, as a line break joins with no character."""
        text = unicodedata.normalize("NFC", "\n".join(chunks))
        return ("".join(c.lower() for c in text) if "Σ" in text else text.lower()).split("\n")

    def _learn(self, chunks: set[str]) -> None:
        if not chunks:
            return
        chunks, words = list(chunks), self.words
        plain = self._plain(chunks)
        # most often letters with punctuation behind, which need no pattern
        body = [c.rstrip(PUNCTUATION) for c in plain]
        split = [((b,) if len(b) == len(c) else (b, c[len(b) :])) if b.isalpha() else self.word(c) for b, c in zip(body, plain)]
        new = list(set().union(*split).difference(words))
        words.update(zip(new, self._merge([w.encode() for w in new])))
        self.cache.update((c, words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])) for c, ws in zip(chunks, split))

    def _merge(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        least = 0
        for most in (8, 12, 16, 24, 48, 96, LONG_WORD):
            at = np.flatnonzero((lengths > least) & (lengths <= most))
            for k in range(0, len(at), 1 << 14):
                some = at[k : k + (1 << 14)].tolist()
                for i, ids in zip(some, self._scanned([words[i] for i in some])):
                    out[i] = ids
            least = most
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[i] = array("i", self._heap(words[i])).tobytes()
        return out

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.ranks[at], NO_MERGE)

    def _scan(self, words: list[bytes]) -> list[tuple[int, ...]]:
        return [tuple(array("i", ids)) for ids in self._scanned(words)]

    def _scanned(self, words: list[bytes]) -> list[bytes]:
        """Words of up to LONG_WORD bytes side by side, a row of part ids and a row of ranks each."""
        count = np.fromiter(map(len, words), np.int64, len(words))
        width = int(count.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        rows = np.arange(len(words))
        parts = self.inner[raw]
        parts[rows, count - 1] = self.final[raw[rows, count - 1]]
        place = np.arange(width)
        ranks = np.full((len(words), width), NO_MERGE, np.int32)
        if width > 1:
            inside = place[1:] < count[:, None]
            ranks[:, :-1][inside] = self._rank_of(parts[:, :-1][inside], parts[:, 1:][inside])
        out = [b""] * len(words)
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NO_MERGE
            if done.any():
                raw = parts[done].tobytes()
                for k, (i, n) in enumerate(zip(rows[done].tolist(), count[done].tolist())):
                    out[i] = raw[4 * width * k : 4 * (width * k + n)]
                if done.all():
                    return out
                going = ~done
                rows, count, parts, ranks, at, least = (x[going] for x in (rows, count, parts, ranks, at, least))
            r = np.arange(len(rows))
            parts[r, at] = self.merged[least]
            # the boundary behind the merged part goes: what follows moves up by one place
            source = np.minimum(place + (place > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, 1)
            ranks = np.take_along_axis(ranks, np.minimum(place + (place >= at[:, None]), width - 1), 1)
            count = count - 1
            before = at > 0
            ranks[r[before], at[before] - 1] = self._rank_of(parts[r[before], at[before] - 1], parts[r[before], at[before]])
            after = at + 1 < count
            ranks[r[after], at[after]] = self._rank_of(parts[r[after], at[after]], parts[r[after], at[after] + 1])
            ranks[r[~after], at[~after]] = NO_MERGE

    def _heap(self, word: bytes) -> list[int]:
        parts = [*self.inner[list(word[:-1])].tolist(), int(self.final[word[-1]])]
        rank, n = self.rank, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        alive = [True] * n
        pair_rank = lambda i: rank.get(parts[i] << 32 | parts[after[i]]) if after[i] < n else None
        heap = [(r, i) for i in range(n - 1) if (r := pair_rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or pair_rank(i) != r:
                continue
            gone = after[i]
            parts[i], alive[gone], after[i] = int(self.merged[r]), False, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (q := pair_rank(j)) is not None:
                    heapq.heappush(heap, (q, j))
        return [p for p, keep in zip(parts, alive) if keep]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, empty for null, in arrays of about BYTES_AT_ONCE bytes."""
    texts = pc.fill_null(texts, "")
    ends, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE)))
        yield texts.slice(start, end - start)
        start = end


_LOADED: dict[str, WordBpe] = {}


class BpeTokenizer:
    """Encodes and decodes columns. ``path`` is read by the driver alone; the file (a few MB) goes to executors as a broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.spec, self.key = spark.sparkContext.broadcast(spec), hashlib.md5(spec.encode()).hexdigest()

    def encode(self, text: Column) -> Column:
        """ids, ``array<int>`` and never null."""
        return F.arrow_udf(self._with(_encoded), "array<int>")(text)

    def round_trip(self, text: Column) -> Column:
        """``struct<ids, decoded>``: the ids and the text decoded from them, in one pass of the worker."""

        def both(bpe: WordBpe, texts: pa.Array) -> pa.Array:
            ids = _encoded(bpe, texts)
            out = pa.StructArray.from_arrays([ids, _decoded(bpe, ids)], ["ids", "decoded"])
            pa.default_memory_pool().release_unused()
            return out

        return F.arrow_udf(self._with(both), "ids array<int>, decoded string")(text)

    def decode(self, ids: Column) -> Column:
        """The decoded text, never null."""
        return F.arrow_udf(self._with(_decoded), "string")(ids)

    def _with(self, work):
        spec, key = self.spec, self.key

        def run(values: pa.Array) -> pa.Array:
            return work(_model(key, spec), values)

        run.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return run


def _encoded(bpe: WordBpe, texts: pa.Array) -> pa.Array:
    done = [bpe.encode_column(some) for some in slices(texts)]
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))


def _decoded(bpe: WordBpe, rows: pa.Array) -> pa.Array:
    ids, ends = rows.flatten(), np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    known = not ids.null_count and (not len(ids) or 0 <= pc.min(ids).as_py() and pc.max(ids).as_py() < len(bpe.names))
    if known and not (names := bpe.names.take(ids)).null_count:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), names), " ")
    ends = ends.tolist()
    return pa.array((bpe.decode(ids.slice(a, b - a).to_pylist()) for a, b in zip([0, *ends], ends)), pa.string())


def _model(key: str, spec) -> WordBpe:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(json.loads(spec.value))
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text") -> DataFrame:
    """``docs`` with the ids of each text and the text decoded from them; columns of the same names are replaced."""
    small_batches(docs.sparkSession)
    both = fresh(docs, "bpe")
    done = docs.withColumn(both, BpeTokenizer(docs.sparkSession, path).round_trip(F.col(text)))
    return done.withColumns({ids: F.col(f"{both}.ids"), decoded: F.col(f"{both}.decoded")}).drop(both)


def op3_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
    return docs.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )
