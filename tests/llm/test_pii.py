import hashlib
import random
import re

import pyarrow as pa
import pytest

from noteloom.llm.pii import Span, detect, find_pii, find_spans, luhn, mask_pii, masked, whole_spans, worth_a_look

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append(Span(m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        letters = rng.choice(["a@.b_-é", "0123.25 ", "0 1-23+().", "a@.0+ "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert detect(text) == plain(text), text
        if plain(text):
            assert worth_a_look(pa.array([text])) == [True], text


DISGUISED = {
    "mail john dot doe at example dot com now": ("email", "john dot doe at example dot com"),
    "x (at) y.example.com": ("email", "x (at) y.example.com"),
    "to bob[at]mail[dot]example[dot]org": ("email", "bob[at]mail[dot]example[dot]org"),
    "plus one two three four five six seven eight nine zero one": ("phone", "plus one two three four five six seven eight nine zero one"),
    "é ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    "jоhn@exаmple.com": ("email", "jоhn@exаmple.com"),
    "ip one two seven dot zero dot zero dot one": ("ip", "one two seven dot zero dot zero dot one"),
    "+1 (803) five five five 5351 at": ("phone", "+1 (803) five five five 5351"),
}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises_map_back_to_the_source(text):
    _, spans = find_spans(text)
    assert [(str(s).split(":")[0], text[s.start:s.end]) for s in spans] == [DISGUISED[text]]
    assert worth_a_look(pa.array([text])) == [True]


def test_prose_is_left_alone():
    for text in ("see you at example.com", "one dot at a time", "at home plus two", "Он дома", ""):
        assert find_spans(text) == ([], []) and masked(text) == text


def test_base_spans_stay_and_nothing_overlaps_them():
    base, spans = find_spans("a​b@c.d and x (at) y.org")
    assert set(base) < set(spans) and len(spans) == 2


def test_long_runs_are_linear():
    find_spans("1" * 300_000 + " " + "a" * 300_000 + "@" + " " * 300_000 + "[" * 300_000)


def test_tables(spark):
    texts = ["a@b.cd 10.0.0.1", None, "", "same@x.yz", "same@x.yz", "plain"]
    df = spark.createDataFrame([(i, t, "u", 99) for i, t in enumerate(texts)] + [(None, "q@r.st", "u", None)], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in find_pii(df).collect()}
    assert (got[0].n_email, got[0].n_ip, got[0].spans) == (1, 1, "email:0:6,ip:7:15")
    assert got[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].n_email == 1 and len(got) == 7
    out = {r.doc_id: r for r in mask_pii(df).collect()}
    assert out[0].text == "[EMAIL] [IP]" and out[0].n_chars == 12 and out[0].spans == "u"
    assert out[1].text is None and out[5].text == "plain" and out[5].n_chars == 99
    assert mask_pii(df).columns == df.columns and mask_pii(df.limit(0)).count() == 0


PARTLY = {
    "to jоhn.smith@example.com now": ("email:3:25,email:5:25", "to [EMAIL] now"),
    "to jo\u200bhn@example.com now": ("email:3:20,email:6:20", "to [EMAIL] now"),
    "to user@mail.example dot com now": ("email:3:20,email:3:28", "to [EMAIL] now"),
    "to bob [at] 10.0.0.1 now": ("email:3:20,ip:12:20", "to [EMAIL] now"),
    "to a@b.cd or x (at) y.org": ("email:3:9,email:13:25", "to [EMAIL] or [EMAIL]"),
}


@pytest.mark.parametrize("text", PARTLY)
def test_partly_disguised_identifiers_are_whole(spark, text):
    base, spans = whole_spans(text)
    assert (",".join(map(str, spans)), masked(text)) == PARTLY[text]
    assert set(base) <= set(spans)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert find_pii(df).first().spans == PARTLY[text][0] and mask_pii(df).first().text == PARTLY[text][1]


def test_letters_that_only_ignoring_case_makes_equal():
    for word in ("ſix", "SİX", "fıve", "ſeven", "nİne", "eİght"):
        assert whole_spans(f"write to me@x.org, {word} copies")[0] == [Span(9, 0, 17)]
        assert len(whole_spans(f"plus one two three four {word} seven eight nine zero one")[1]) == 1
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x250) if chr(c).casefold() != chr(c) or chr(c).isalpha()] + list("ſKİı @.-+0[](){}")
    for _ in range(3000):
        parts = [rng.choice(["six", "dot", "at", "plus", "one", "[at]"]) for _ in range(6)]
        text = " ".join("".join(c if rng.random() < 0.8 else rng.choice(letters) for c in p) for p in parts)
        whole_spans(text)
        masked(text)


def test_numbers_of_any_length():
    zeros = "1.2.3." + "0" * 5000 + "1"
    assert [str(s) for s in whole_spans(f"ip {zeros} end")[0]] == [f"ip:3:{3 + len(zeros)}"]
    assert whole_spans("1.2.3." + "9" * 5000)[0] == []
    assert masked(f"ip {zeros} end") == "ip [IP] end"
