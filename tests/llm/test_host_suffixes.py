import random
import re
import time

import pytest

from noteloom.llm.host_suffixes import _RAW, extract, main_text, read_page, tags

PAGES = {
    "": "",
    "plain &amp; text": "plain & text",
    "<p>a<b>b</b>c  d<br>e</p><p>f": "abc d e f",
    "<nav>menu<article>real <aside>side</aside>text</article><footer>f": "real text",
    "<article><p>x</p><div class='comments'><div>c1</div>c2</div><p>y</p></article>": "x y",
    '<div class="ad">ad</div><main>m <form>f<input></form> n</main>': "m n",
    "<body class='has-sidebar'><div class=\"has-sidebar\"><p>t1</p></div><div id=sidebar>s</div>t2</body>": "t1 t2",
    '<script>var t="</p>"; <article>no</script><article>yes &lt;b&gt; a &#233;&nbsp;b</article>': "yes <b> a é b",
    "<article>a <span class='ad'>AD</span> b <div hidden>h</div>c</article>": "a b c",
    "a<!-- x --> b <unclosed 'x <p>z": "a b z",
    "<article><header>h</header>t<footer>f</footer></article><section class=comments><article>reader</article></section>": "t",
    "<article>t<article class='comment'>reader<p>x</article> u</article>": "t u",
    "<nav>m<ul><li>x</ul><main>body</main>": "body",
    "<title>t</title><style>p{}</style><p>one</p><noscript>js</noscript>": "one",
}


@pytest.mark.parametrize("source", PAGES)
def test_main_text(source):
    assert main_text(read_page(source), set()) == PAGES[source]


@pytest.mark.parametrize("piece", [
    "<a title='", "<", "<div class=ad>", "<script>", "&amp", "<script ", "<div ", "<a title=", "<a title=\"", "<a \">\"", "<a '>'\"", "<!", "<x", "a<b'"])
def test_long_malformed_markup_is_linear(piece):
    took = []
    for n in (100_000, 800_000):
        began = time.perf_counter()
        read_page(piece * (n // len(piece)))
        took.append(time.perf_counter() - began)
    assert took[1] < 20 and took[1] < 40 * max(took[0], 0.02)


def test_tags_equal_one_pattern():
    plain = re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
        r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.DOTALL | re.IGNORECASE)
    parts = ["<", ">", "'", '"', "/", "!", "--", " ", "a", "<p", "<div x=", "</", "<Script", "</script", "<!--", "-->", "<![cdata[", "]]>", "<?", "head", "=", "\n", "x-y", "<svg>"]
    rng = random.Random(8)
    for _ in range(20_000):
        source = "".join(rng.choices(parts, k=rng.randrange(16)))
        want = [(m.start(), m.end(), (m["name"] or "").lower(), bool(m["close"]), m["attributes"] or "", m["raw"] is not None) for m in plain.finditer(source)]
        assert [tuple(t) for t in tags(source)] == want, source


def test_repeats_leave_a_main_element_too(spark):
    menu = "welcome to our great site with all the news today"
    rows = [(i, "http://h.x/", f"<main><p>{menu}</p><p>unique{i} story number{i}</p></main>") for i in range(4)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in got.collect()} == {f"unique{i} story number{i}" for i in range(4)}


def test_repeats_of_a_host(spark):
    menu = "welcome to our great site with all the news today"
    foot = "copyright by the great site owners all rights are reserved"
    rows = [(i, f"http://h.x/{i}", f"<div>{menu}</div><p>unique{i} story number{i} tells this{i} and that{i}</p><div>{foot}</div>") for i in range(5)]
    shared = "<article>" + " ".join(f"passage{k}" for k in range(60)) + "</article>"
    rows += [(10 + i, f"http://h.x/a{i}", f"<nav>{menu}</nav>{shared}<p>{i}</p>") for i in range(5)]
    rows += [(20, "http://other.x/", f"<div>{menu}</div>"), (30, None, None), (None, "http://h.x/", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in extract(df).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, set()).add((r.text, r.n_repeated))
    for i in range(5):
        assert got[i] == {(f"unique{i} story number{i} tells this{i} and that{i}", 20)}
        assert got[10 + i] == {(" ".join(f"passage{k}" for k in range(60)), 10)}  # repeated articles stay whole
    assert got[20] == {(menu, 0)} and got[30] == got[None] == {("", 0)}
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0


def test_given_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = sources[r.page_id].split("<article>")[1].split("</article>")[0]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r.text == " ".join(html.unescape(plain).split())


def test_longest_repeat_decides_with_articles(spark):
    menu = "welcome to our great site with all the news today"
    story = [f"w{k}" for k in range(50)]
    advert = " ".join(story[20:30])
    rows = [(i, "http://h.x/", f"<div>{menu}</div><article><p>{' '.join(story)}</p><p>art{i}</p></article>") for i in range(4)]
    rows += [(10 + i, "http://h.x/", f"<div>{menu}</div><p>{' '.join(story)}</p><p>print{i}</p>") for i in range(3)]
    rows += [(20 + i, "http://h.x/", f"<div>{menu}</div><p>{advert}</p><article>other{i}</article>") for i in range(6)]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):  # the story is in more articles than outside, its advert is not; the menu is never in one
        assert got[10 + i].text == " ".join(story) + f" print{i}" and got[10 + i].n_repeated == 60
    for i in range(4):
        assert got[i].text == " ".join(story) + f" art{i}"
        assert got[i].n_repeated == 10
    for i in range(6):
        assert (got[20 + i].text, got[20 + i].n_repeated) == (f"other{i}", 20)


def plain_extract(pages, n, min_pages):
    """(text, tokens in repeats outside the article) by id: all heads of n, 2n, 4n, … tokens, counted in tables."""
    read, counts = [], {}
    for page_id, host, segments in pages:
        content, at = repr(segments), 0
        for inside, tokens in segments:
            for length in (n << d for d in range(8)):
                for k in range(len(tokens) - length + 1):
                    head = (host, *tokens[k:k + length])
                    counts.setdefault(head, (set(), set()))[inside].add(content)
                    read.append((page_id, at + k, length, head))
            at += len(tokens)
    best = {}
    for page_id, start, length, head in read:
        outside, inside = counts[head]
        if len(outside | inside) >= min_pages:
            for k in range(start, start + length):
                longest, content = best.get((page_id, k), (0, False))
                here = len(outside) <= len(inside)
                if length >= longest:
                    best[page_id, k] = (length, here or (content and length == longest))
    for page_id, _, segments in pages:
        places = [(inside, t) for inside, tokens in segments for t in tokens]
        if any(inside for inside, _ in places):
            text = " ".join(t for inside, t in places if inside)
        else:
            text = " ".join(t for k, (_, t) in enumerate(places) if best.get((page_id, k), (0, True))[1])
        yield page_id, (text, sum(not inside and (page_id, k) in best for k, (inside, _) in enumerate(places)))


@pytest.mark.parametrize("min_tokens", [1, 3, 4])
def test_repeats_equal_plain_counting(spark, min_tokens):
    rng = random.Random(min_tokens)
    phrases = [[rng.choice("abcde") + rng.choice("xyz") for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    pages = []
    for page_id in range(150):
        segments = []
        for inside in ((False,), (False, True), (True,), (False, True, False))[rng.randrange(4)]:
            tokens = [t for _ in range(rng.randrange(1, 4)) for t in (rng.choice(phrases) if rng.random() < 0.7 else [f"u{rng.randrange(10**6)}"])]
            segments.append((inside, tokens))
        pages.append((page_id, rng.choice(["h.x", "i.x"]), segments))
    pages += [(1000 + page_id, host, segments) for page_id, host, segments in pages[:5]]  # copies count once
    rows = [(i, f"http://{host}/{i}", "".join(f"<article>{' '.join(t)}</article>" if a else f"<p>{' '.join(t)}</p>" for a, t in s)) for i, host, s in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: (r.text, r.n_repeated) for r in extract(df, min_tokens=min_tokens).collect()}
    assert got == dict(plain_extract(pages, min_tokens, 3))


def test_many_pages_without_tokens_and_a_long_page(spark):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(i, "http://h.x/", "<p></p>" if i % 2 else None) for i in range(20)] + [(100 + i, "http://h.x/", f"<p>{long}</p><p>end{i}</p>") for i in range(3)]
    got = {r.page_id: (r.text, r.n_repeated) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("", 0) for i in range(20)} | {100 + i: (f"end{i}", 30_000) for i in range(3)}
