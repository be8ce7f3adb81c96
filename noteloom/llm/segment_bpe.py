"""BPE encoding and decoding with segment trees over the ranks of adjacent pairs.

The leaves of a word's tree hold the rank of each adjacent pair (and its place, so that ties go
to the left); the root is the next merge. A merge changes three leaves and the nodes above
them, until the root shows that no pair can be merged. Short words, nearly all of a text, are
merged side by side in one array of trees; a long word gets a tree of its own.

Words are what lies between white space, and their ids do not depend on what surrounds them.
A bounded memory of words in each Python worker spares repeated work.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import byte_slices

#: Words up to so many symbols are merged side by side.
SHORT = 64
#: Words remembered per generation in a Python worker; two generations are kept.
REMEMBERED = 150_000
_INFINITE = np.iinfo(np.int64).max
#: What str.split separates at beyond Unicode's white space.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WHITE = r"[\p{White_Space}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge rules, with the symbols' ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.suffix = suffix
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        # A pair named twice has its first rank.
        first = np.unique(keys, return_index=True)
        self.keys, self.ranks = first[0], first[1].astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + suffix] for x in letters]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, infinite where there is no rule."""
        wanted = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _INFINITE)

    def start(self, word: bytes) -> list[int]:
        return [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]] if word else []

    def one(self, word: bytes) -> list[int]:
        """The ids of one word of any length, by a tree in plain lists."""
        symbols = self.start(word)
        n = len(symbols)
        if n < 2:
            return symbols
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        ranks = self.rank(np.array(symbols[:-1]), np.array(symbols[1:]))
        tree = [none] * (2 * size)
        tree[size:size + n - 1] = [int(r) * size + i if r != _INFINITE else none for i, r in enumerate(ranks)]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        table = self.table()

        def put(leaf: int, value: int) -> None:
            i = leaf + size
            tree[i] = value
            i >>= 1
            while i:
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value
                i >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            symbols[at] = int(self.made[rank])
            follow = after[gone]
            after[at], symbols[gone] = follow, -1
            before[follow if follow < n else n] = at
            put(gone, none)
            for i in (at, before[at]):
                if i >= 0:
                    found = table.get(symbols[i] * self.base + symbols[after[i]]) if after[i] < n else None
                    put(i, none if found is None else found * size + i)
        return [s for s in symbols if s >= 0]

    def table(self) -> dict[int, int]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._table

    def many(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each of the words, short ones side by side by the size of their trees."""
        out: list = [None] * len(words)
        sized = sorted(range(len(words)), key=lambda i: (max(1, len(words[i]) - 1)).bit_length())
        for bits, group in groupby(sized, key=lambda i: (max(1, len(words[i]) - 1)).bit_length()):
            places = list(group)
            if 1 << bits > SHORT:
                for i in places:
                    out[i] = np.array(self.one(words[i]), dtype="<u4")
                continue
            for start in range(0, len(places), 16_384):
                part = places[start:start + 16_384]
                for i, ids in zip(part, self._side_by_side([words[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def _side_by_side(self, words: list[bytes]) -> list[np.ndarray]:
        count = np.array([len(w) for w in words])
        n = int(count.max(initial=0))
        if n == 0:
            return [np.zeros(0, dtype="<u4") for _ in words]
        size = 1 << max(0, n - 2).bit_length() if n > 1 else 1
        rows = np.arange(len(words))
        places = np.arange(n + 1)
        inside = places[None, :n] < count[:, None]
        symbols = np.zeros((len(words), n + 1), dtype=np.int64)
        filled = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols[:, :n][inside] = np.array(self.inner)[filled]
        full = count > 0
        tails = np.array([w[-1] for w in words if w], dtype=np.int64)
        symbols[rows[full], count[full] - 1] = np.array(self.last)[tails]
        after = np.broadcast_to(places + 1, (len(words), n + 1)).copy()
        before = np.broadcast_to(places - 1, (len(words), n + 1)).copy()
        tree = np.full((len(words), 2 * size), _INFINITE, dtype=np.int64)
        if n > 1:
            ranks = self.rank(symbols[:, :n - 1], symbols[:, 1:n])
            pair = (places[None, 1:n] < count[:, None]) & (ranks != _INFINITE)
            leaves = tree[:, size:size + n - 1]
            leaves[pair] = (ranks * size + places[None, :n - 1])[pair]
            level = size
            while level > 1:
                half = level // 2
                tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
                level = half
        alive = np.zeros((len(words), n + 1), dtype=bool)
        alive[:, :n] = inside

        def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            i = leaf + size
            tree[r, i] = value
            while size > 1 and i[0] > 1:
                i >>= 1
                tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

        active = rows
        while True:
            active = active[tree[active, 1] != _INFINITE]
            if not len(active):
                break
            rank, at = np.divmod(tree[active, 1], size)
            gone = after[active, at]
            follow = after[active, gone]
            symbols[active, at] = self.made[rank]
            alive[active, gone] = False
            after[active, at] = follow
            before[active, follow] = at
            # The removed symbol's pair; it has no leaf if it was the last one.
            leaf = gone < size
            put_rows = active[leaf]
            if len(put_rows):
                put(put_rows, gone[leaf], np.full(len(put_rows), _INFINITE))
            for i in (at, before[active, at]):
                has = i >= 0
                r, j = active[has], i[has]
                if len(r):
                    k = after[r, j]
                    found = np.where(k < count[r], self.rank(symbols[r, j], symbols[r, np.minimum(k, n)]), _INFINITE)
                    put(r, j, np.where(found == _INFINITE, found, (found % _INFINITE) * size + j))
        kept = symbols[alive].astype("<u4")
        return np.split(kept, np.cumsum(alive.sum(axis=1))[:-1])


class WordCodec:
    """The codec of a tokenizer file with lower-casing, dropped white space and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._check(spec, model)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._young: dict[str, tuple[bytes, bytes]] = {}
        self._old: dict[str, tuple[bytes, bytes]] = {}

    @staticmethod
    def _check(spec: dict, model: dict) -> None:
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this codec reads byte-level BPE files with NFC, white space and lower case rules only")

    def _lower(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # Letter by letter: the whole-word rule for a final sigma is not part of the format.
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def pieces(self, word: str) -> list[bytes | int]:
        """What the merges work on: byte strings, and ids of special tokens."""
        parts = self._special.split(word) if self._special and "<" in word else [word]
        out: list[bytes | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [p.encode("utf-8", "surrogatepass") for p in self._pieces.findall(self._lower(part))]
        return out

    def words(self, text: str) -> list[str]:
        if any(c in text for c in _SEPARATORS):
            return [w for w in regex.split(_WHITE, text) if w]
        return text.split()

    def remember(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and decoded bytes of all the words."""
        known = {}
        new = []
        for w in words:
            found = self._young.get(w) or self._old.get(w)
            if found is None:
                new.append(w)
            else:
                known[w] = found
        pieces = [self.pieces(w) for w in new]
        flat = {p for ps in pieces for p in ps if isinstance(p, bytes)}
        order = sorted(flat)
        ids = {p: x.tolist() for p, x in zip(order, self.merges.many(order), strict=True)}
        for w, ps in zip(new, pieces, strict=True):
            all_ids = [i for p in ps for i in (ids[p] if isinstance(p, bytes) else (p,))]
            known[w] = struct.pack(f"<{len(all_ids)}I", *all_ids), self.decode(all_ids).encode("utf-8", "surrogatepass")
        for w in known:
            if len(w) <= SHORT:
                if len(self._young) >= REMEMBERED:
                    self._old, self._young = self._young, {}
                self._young[w] = known[w]
        return known

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        known = self.remember(set(words))
        joined = b"".join([known[w][0] for w in words])
        return list(struct.unpack(f"<{len(joined) // 4}I", joined))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])


@cache
def codec(path: str) -> WordCodec:
    """One codec per file and Python worker."""
    return WordCodec(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Token ids of every whole text and the text that they decode to.

    Returns doc_id, n_tokens, and ids (array of int) and decoded, or with ``digests`` the
    SHA-256 of the ids as little-endian 32-bit numbers and of the decoded text in UTF-8. A null
    text is treated as empty and has no tokens; repeated rows give repeated results; other
    columns are not looked at. There is no shuffle: each text is encoded where it is read.
    """
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = f"{docs.schema[id_col].name} {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, {tail}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                split = [coder.words(t or "") for t in part.column("text").to_pylist()]
                known = coder.remember({w for words in split for w in words})
                ids = [b"".join([known[w][0] for w in words]) for words in split]
                plain = [b" ".join([x for w in words if (x := known[w][1])]) for words in split]
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    last = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, plain)]
                else:
                    last = [
                        pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                        pa.array([x.decode("utf-8", "surrogatepass") for x in plain], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, *last], ["id", "n_tokens", "a", "b"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        encode, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, "
        + ("a string, b string" if digests else "a array<int>, b string"))
    names = [s.split(" ")[0] for s in schema.split(", ")]
    return found.toDF(*names)
