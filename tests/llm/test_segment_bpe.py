import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noteloom.llm.segment_bpe import WordCodec, encode_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    letters = "aabcdeéßÜΣ'<|>012 \n\t  \x1cэ日本😀́"
    return [
        "", " ", "a", "Hello  wörld's 123 <|endoftext|>foo <|StartOfText|> 😀é ..!?　 áb ΑΣ Σας İx", "I'll don't 'S it's",
        "<|startoftext|><|endoftext|>", "ab" * 100 + " " + "xyz" * 500, "z" * 5000,
    ] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)]


def test_equal_to_the_library(library):
    codec = WordCodec(PATH)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tables(spark, library):
    texts = [*odd_texts()[:60], None, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 2)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in encode_texts(df, PATH, digests=True).collect()}
    plain = {r.doc_id: r for r in encode_texts(df, PATH).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and plain[i].ids == ids and plain[i].decoded == back
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert got[None].n_tokens == 1
    assert encode_texts(df.limit(0), PATH).count() == 0
