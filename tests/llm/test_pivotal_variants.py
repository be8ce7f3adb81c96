import random
import re
import zlib
from collections import Counter

import pytest

from noteloom.llm import pivotal_variants
from noteloom.llm.pivotal_variants import count_words, group_variants, letter_bits, near_pairs, prefix_places, spelling_variants


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return rows


def plain_words(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def random_words(n, letters, seed, lengths=(7, 10)):
    """Words and edits of them, so that many are near."""
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(*lengths)))
        for _ in range(rng.randint(0, 4)):
            words[word] = rng.choice([2, 3, 20, 21, 30, 250, 3000, 40_000])
            i, c = rng.randrange(len(word)), rng.choice(letters)
            word = rng.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]])
            if len(word) < 7:
                break
    return words


@pytest.mark.parametrize("letters,lengths", [("ab", (7, 9)), ("a", (7, 40)), ("abé", (7, 12)), ("abcdefghijklmnopqrstuvwxyzéßÿ", (7, 11)), ("aaaab", (10, 30))])
def test_groups_equal_those_of_all_pairs(spark, letters, lengths):
    counts = random_words(400 if len(letters) > 1 else 30, letters, 7, lengths)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert {tuple(r) for r in group_variants(words).collect()} == plain_groups(counts)


def test_pairs_stay_whole_when_keys_are_split_into_parts(spark, monkeypatch):
    monkeypatch.setattr(pivotal_variants, "PART_ROWS", 3)
    counts = random_words(500, "abc", 11)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = [(r.word, r.n, r.near, r.near_n) for r in near_pairs(words).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(w, counts[w], v, counts[v]) for w in counts for v in counts if one_edit(w, v)}


def test_prefix_holds_three_bigrams_with_a_disjoint_pair():
    rng = random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 30)))
        grams = sorted({word[i : i + 2] for i in range(len(word) - 1)})
        rng.shuffle(grams)
        last, places, pivots = prefix_places(word, {g: i for i, g in enumerate(grams)})
        assert set(pivots) <= set(places) and len(places) <= 2 + pivotal_variants.REPEATS
        assert max(pivots) - min(pivots) >= 2
        assert all(grams.index(word[p : p + 2]) <= last for p in places)
        other = list(word)
        other[rng.randrange(len(word))] = rng.choice("abc")
        assert (letter_bits(word) ^ letter_bits("".join(other))).bit_count() <= 2
        assert (letter_bits(word) ^ letter_bits(word + "a")).bit_count() <= 1


def test_chains_of_forms_end_at_the_root(spark):
    counts = {"a" * 7 + "bcdefgh"[: i] + "z" * (7 - i): 10**i for i in range(8)}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {tuple(r) for r in group_variants(words).collect()}
    assert got == plain_groups(counts)
    assert {r[2] for r in got} == {max(counts, key=counts.get)}


def test_words_of_odd_texts(spark):
    texts = [
        (1, "Wortlaut wortlaut WORTLAUT, Wörtläut ÄÖÜäöüß ÄÖÜäöüß"), (1, "Wortlaut"), (2, None), (3, ""), (None, "nullnull nullnull"),
        (4, "Kelvinelvin ſsssssss × ÷ a÷b÷c÷d÷e a÷b÷c÷d÷e"), (5, "x" * 300_000 + " " + "x" * 300_000 + " " + "x" * 299_999 + " " + "x" * 299_999),
        (6, "wortlaute " * 50_000 + "zweimal! zweimal?")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, n string")
    assert {r.word: r.n for r in count_words(docs).collect() if r.n > 1} == plain_words(texts)
    assert {tuple(r) for r in spelling_variants(docs).collect()} == plain_groups(plain_words(texts))
    assert spelling_variants(docs.limit(0)).count() == 0


def test_query_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in spelling_variants(same).collect()} == plain_groups(plain_words(rows))
