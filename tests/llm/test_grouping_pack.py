import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noteloom.llm.grouping_pack import ByteCodec, best_plan, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(counts, capacity, found):
    placed, sequences = found
    inside, ranks = defaultdict(list), defaultdict(list)
    for p in placed:
        ranks[p.length].append((p.first, p.count))
        for k in range(p.count):
            inside[p.sequence + k].append((p.offset, p.length))
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(inside) == set(range(sequences))
    for length, number in counts.items():
        at = 0
        for first, count in sorted(ranks[length]):
            assert first == at
            at += count
        assert at == number
    return sequences


def test_plans_are_complete_and_tight():
    rng = random.Random(1)
    for _ in range(80):
        capacity = rng.choice([10, 64, 100])
        counts = {n: rng.choice([1, 5, 100]) for n in range(1, capacity + 1) if rng.random() < 0.5}
        for share in (1 / 8, 1 / 3, 1 / 2):
            check(counts, capacity, plan(counts, capacity, groups=8, small_share=share))
    mixed = {n: rng.randint(0, 60) for n in range(1, 1025)}
    total = sum(n * c for n, c in mixed.items())
    assert check({n: c for n, c in mixed.items() if c}, 1024, best_plan(mixed, 1024)) <= 1.01 * total / 1024 + 2
    assert check({341: 500, 342: 1000, 683: 500}, 1024, best_plan({341: 500, 342: 1000, 683: 500}, 1024)) <= 1010
    assert best_plan({}, 1024) == ([], 0)


def test_ids_are_the_library_s():
    library, codec = Tokenizer.from_file(PATH), ByteCodec(PATH)
    rng = random.Random(5)
    letters = "aabc  \n\n\t'sté日😀\x85\xa0\x1c\x1d\x1f 　12!?<|"
    texts = ["", "<|endoftext|>", " a <|endoftext|> b\n\n <|endoftext|>", "a" * 3000]
    for text in texts + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1000)]:
        assert np.frombuffer(codec.ids(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [8, 64])
def test_packed_table(spark, capacity):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = [None, "", "same text here", "same text here"] + [" ".join(rng.choice(["the", "xyzzy", "1"]) for _ in range(rng.randint(0, 90))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, rank int")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(df, PATH, capacity=capacity).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in [*enumerate(texts), (None, "no id")]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        found = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found))) and all(r.length == capacity for r in found[1:])
        assert sum(r.length for r in found) == len(ids) and len(found) == -(-len(ids) // capacity)
        for r in found:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(r.doc_id for rows in pieces.values() for r in rows)[0] == 1
    assert pack(df.limit(0), PATH).count() == 0
