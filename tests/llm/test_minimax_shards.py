import random
import zlib
from collections import defaultdict

from noteloom.llm.minimax_shards import shard_documents, smallest_capacity


def smallest_by_trial(weights, shards):
    def fits(capacity):
        used, held = 1, 0
        for w in weights:
            if held + w > capacity:
                used, held = used + 1, 0
            held += w
        return used <= shards

    capacity = max(max(weights), -(-sum(weights) // shards))
    while not fits(capacity):
        capacity += 1
    return capacity


def test_capacity_is_the_smallest_from_coarse_summaries():
    rng = random.Random(1)
    for _ in range(150):
        weights = [rng.randint(1, rng.choice([5, 100, 3000])) for _ in range(rng.randint(1, 150))]
        shards, cells = rng.randint(1, 12), rng.choice([2, 5, 16])
        sums = [sum(weights[:i + 1]) for i in range(len(weights))]

        def summarise(stretches):
            out, each = [], max(2, cells // len(stretches))
            for a, b in stretches:
                found = defaultdict(list)
                for s in sums:
                    if a < s < b:
                        found[(s - a) // max(1, -(-(b - a) // each))].append(s)
                out += [(min(v), max(v), len(v)) for v in found.values()]
            return out

        capacity, ends = smallest_capacity(sums[-1], max(weights), shards, summarise)
        assert capacity == smallest_by_trial(weights, shards)
        assert ends[-1] == sums[-1] and all(e in sums for e in ends)
        assert all(b - a <= capacity for a, b in zip([0, *ends], ends, strict=False))


def test_shards_of_odd_rows(spark):
    texts = [None, "", "a", "a", "é" * 50] + [f"text {i} " * (i % 9) for i in range(300)] + ["copy " * 40] * 200
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "no id")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, shard string, size int")
    got = shard_documents(df, shards=6, cells=8).collect()
    assert len(got) == len(rows)
    by_text, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    text_of = dict(rows)
    for r in got:
        text = text_of[r.doc_id]
        assert r.size == len((text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text or "").encode())
        by_text[text].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = sum(r.size for r in got if text_of[r.doc_id] == "copy " * 40)
    rest = sorted(v for v in sizes.values() if v != copies)
    assert len(rest) == 5 and rest[-1] < 1.2 * rest[0]
    assert shard_documents(df.limit(0)).count() == 0
