"""Sentence spans, binary rows, main text and URL filters against plain versions."""

import re

import numpy as np
import pytest

from statflow.llm import binpack, html, spans, urls
from statflow.llm.queries import vocabulary


def _plain_dedup(docs, longest=6):
    """docs: (order, text) in order of first occurrence. What is left and how many sentences went, by the
    definition: every run of two or more (here up to ``longest``) sentences, repeats but the first removed."""
    cut = [[s for s in spans.sentences(t or "")] for _, t in docs]
    seen = {}
    for d, parts in enumerate(cut):
        real = [i for i, p in enumerate(parts) if p.split()]
        for x in range(len(real)):
            for y in range(x + 1, min(x + longest, len(real))):
                key = tuple(" ".join(parts[i].lower().split()) for i in real[x : y + 1])
                seen.setdefault(key, []).append((d, real[x], real[y]))
    gone = [set() for _ in docs]
    for at in seen.values():
        for d, i, j in sorted(at)[1:]:
            gone[d] |= set(range(i, j + 1))
    return [None if t is None else "".join(s for k, s in enumerate(parts) if k not in g) for (_, t), parts, g in zip(docs, cut, gone, strict=True)], [len(g) for g in gone]


@pytest.mark.parametrize("share", [100_000, 2])
def test_remove_repeats(spark, sf_dir, share, monkeypatch):
    monkeypatch.setattr(spans, "SHARE", share)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    passage = "One two three, four five six seven. Eight nine ten! " + " ".join(f"w{i}" for i in range(60)) + ". And so it ends, it is said."
    odd = [None, "", "\n \n", "....", "x" * 9000, "word " * 3000, f"Lead in here. {passage} Out.", f"Other start: {passage}\nNext", "é. È! " * 40, "a. b. c. " * 50, "\x85. \u3000! a\xa0b. c."]
    docs += [(10**6 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(None, passage, 1)], "doc_id long, text string, h int").repartition(5)
    left, gone = _plain_dedup([*docs, (None, passage)])
    rows = spans.remove_repeats(df).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + 1
    assert {d: r["text"] for d, r in got.items()} == {d: t for (d, _), t in zip([*docs, (None, None)], left, strict=True)}
    assert {d: r["n_removed"] for d, r in got.items()} == {d: n for (d, _), n in zip([*docs, (None, None)], gone, strict=True)}
    assert "w30" in got[10**6 + 6]["text"] and "w30" not in got[10**6 + 7]["text"] and "it is said" not in got[10**6 + 7]["text"] and got[None]["n_removed"] > 4
    assert spans.remove_repeats(df.limit(0)).count() == 0


def test_short_repeats_go(spark):
    docs = spark.createDataFrame([(i, "All rights reserved. Terms apply here.") for i in range(5)] + [(9, "Alone it stands.")] * 2, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in spans.remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 2), (2, 2), (3, 2), (4, 2), (9, 0), (9, 0)]


def test_removals_belong_to_rows(spark):
    """Rows that share an id keep what is theirs; identical rows are copies."""
    lent = " ".join(f"Lent {i} is here." for i in range(10))
    own = " ".join(f"Own {i} is not there." for i in range(10))
    rows = [(1, lent), (2, lent), (2, own), (3, own + " More."), (4, "P q r. S t u."), (4, "P q r. S t u."), (5, "K l. M n."), (5, "K l. M n. O p."), (None, "K l. M n.")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r["doc_id"] or 99, r["text"], r["n_removed"]) for r in spans.remove_repeats(df).collect())
        assert got[:3] == [(1, lent, 0), (2, "", 10), (2, own, 0)] and got[3][1] == "More."
        assert got[4:6] == [(4, "", 2), (4, "P q r. S t u.", 0)] and got[-1] == (99, "", 2)
        assert sorted(x[2] for x in got[6:8]) == [0, 2]


@pytest.mark.parametrize("text", ["", "a", "a. b", " \n x, y; z: w. ", "no marks " * 70, "\n\n a." * 5, "!!! ??? ..."])
def test_sentences_are_the_text(text):
    assert "".join(spans.sentences(text)) == text


def test_long_sentences_are_cut_alike_wherever_they_begin():
    words = [f"w{i}" for i in range(200)]
    a, b = spans.sentences(" ".join(words)), spans.sentences(" ".join(["other", *words[30:]]))
    assert len(a) > 10 and a[-8:] == b[-8:] and min(len(p.split()) for p in a) > 4


def test_binary_rows(spark, sf_dir):
    import public_tokenizers

    from statflow.llm.tokens import rank_encoding

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    odd = [None, "", "x", "<|endoftext|>", "ab " * 5000, "\U0001f600é"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = binpack.pack_rows(docs.repartition(2), ranks, pattern, 512, shard=50_000).collect()
    parts, total = {}, 0
    for r in rows:
        ids, pos, cuts = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["segments"]
        assert len(ids) == len(pos) == 512 and cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= 512 and len(cuts) == len(r["doc_ids"]) + 1
        for d, k, a, b in zip(r["doc_ids"], r["pieces"], cuts[:-1], cuts[1:], strict=True):
            assert pos[a:b].tolist() == list(range(b - a)) and b > a
            parts.setdefault(d, {})[k] = ids[a:b]
        total += cuts[-1]
    encode = rank_encoding(ranks, pattern).encode_ordinary
    assert set(parts) == set(texts)
    for d, t in texts.items():
        whole = np.concatenate([parts[d][k] for k in range(len(parts[d]))]).tolist()
        assert whole == [*encode(t or ""), binpack.END]
    assert len(rows) <= total / 512 * 1.05 + 4
    assert binpack.pack_rows(docs.limit(0), ranks, pattern).count() == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(5)
    for capacity in (7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 300).tolist()
        plain = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in plain if r >= lengths[i]]
            if fits:
                plain.remove(min(fits))
                plain.append(min(fits) - lengths[i])
            else:
                plain.append(capacity - lengths[i])
        rows = binpack.best_fit(lengths, capacity)
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(plain)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var x = "<p>no</p>";</script></head><body class="home no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap7"><div class="ad">Buy <b>now</b></div><article class="post-12"><header><h2>Head&shy;line &lt;1&gt;</h2></header><p>First  <b>bold <i>para</i>
graph</b><br><p class="lead">Sec<ins class="adsbygoogle">Buy <ins>it</ins></ins>ond<img class="ad"> &eacute;&#233;&nbsp;x<p>Third with <a href="#">a link</a>.<div class="share">Share me</div><!-- <p>hidden</p> --><ul><li>one<li>two</ul>
<form><input><p>Mail us</p></form><p class="advert">Ad<p>La<span class="ad-slot">unclosed<p>Last 1 < 2</article>
<section class="comments"><p>A reader wrote a rather long comment that goes on and on and on, longer than any paragraph there is, really, and then some more of it.</p></section>
<aside><p>Side</p></aside></div><footer>&copy; me</footer></body></html>"""
TEXT = "Head­line <1>\nFirst bold para graph\nSecond éé x\nThird with a link.\none\ntwo\nLa\nLast 1 < 2"


def test_page():
    page = html.Page(PAGE)
    best = page.path[page.best()]
    assert best.endswith("article.post-#") and html.extract(PAGE, best) == html.extract(PAGE, None) == html.extract(PAGE, "no>such") == TEXT


@pytest.mark.parametrize(
    "part,kept",
    [
        ('<section id="discussion"><p>We found it</p></section>', "We found it"), ('<div class="entry-header"><h1>Title</h1></div>', "Title"), ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<h2 id="comments">On comments</h2>', "On comments"), ('<div class="search-results-analysis">We analyse</div>', "We analyse"), ('<p>The <span class="form">form</span> of it</p>', "The form of it"),
        ("<header><h1>Headline</h1></header>", "Headline"), ('<div class="advertising-history">Long ago</div>', "Long ago"), ('<div class="related"><p>A case like this, see <a href="/x">there</a>.</p></div>', "A case like this, see there."),
        ('<div class="related"><a href="/x">More</a> <a href="/y">and more</a></div>', ""), ('<div class="share">Share</div>', ""), ('<div class="ad_slot-3">Buy</div>', ""), ('<section class="comments-area"><p>First!</p></section>', ""),
        ('<div id="comment-list">First!</div>', ""), ('<div class="cookie-notice">We use cookies</div>', ""), ('<p class="notice">Note</p>', ""), ('<div class="sidebar-left">Side</div>', ""), ('<div role="complementary">Side</div>', ""),
    ],
)
def test_names_inside_content(part, kept):
    """In an article and in a winning container alike."""
    want = "\n".join(x for x in ("Some text that is long enough.", kept, "The end.") if x)
    body = f"<p>Some text that is long enough.</p>{part}<p>The end.</p>"
    assert html.extract(f"<body><nav>Menu</nav><article>{body}</article><footer>f</footer></body>", None) == want
    if "<header>" not in part:
        assert html.extract(f"<body><div id=menu>Menu</div><div class='story'>{body}</div></body>", "body>div.story") == want


def test_two_templates_on_one_host(spark):
    """The lesser template keeps its article, though the winner's path holds a teaser on it."""
    one = "<body><div class='content'><p>{}</p></div></body>"
    article = "<body><main><article><p>{}</p></article></main><div class='content'><p>Teaser</p></div></body>"
    plain = "<body><div class='content'><p>Teaser</p></div><div class='text-7'><p>{}</p></div></body>"
    pages = [(i, one.format("first " * 30)) for i in range(12)] + [(20, article.format("second " * 30))] + [(30 + i, plain.format("third " * 30)) for i in range(4)]
    df = spark.createDataFrame([(i, "http://h.example/a", p) for i, p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == {i: (w * 30).strip() for i, w in [*((i, "first ") for i in range(12)), (20, "second "), *((30 + i, "third ") for i in range(4))]}


@pytest.mark.parametrize(
    "page,text",
    [
        ("a<!-- b", "a"), ("a<!-- b > c", "a"), ("<p>a</p>b<script>c", "b"), ("<p>a<script>x > y", "a"), ("a < b > c", "a < b > c"), ("<p>x</p> 1 <2", "1 <2"), ("<div>" * 5000 + "deep", "deep"), ('<a "' * 50000, None),
        ("<" * 50000, None), ("<!-- " * 20000, ""), ("<script>" * 20000, ""), ("<p>a " * 30000, "\n".join("a" * 30000)), ("<b" * 30000 + ">", ""), ("<i class=ad>x</i>y", "y"),
    ],
)
def test_odd_pages_in_linear_time(page, text):
    import time

    began = time.process_time()
    got = html.extract(page, None)
    assert (text is None or text in (got, got.split("\n")[-1])) and time.process_time() - began < 5


def test_consensus_helps(spark):
    """A page whose best container misleads is read by the path that its host agrees on."""
    good = "<body><div class='story'><p>{}</p></div><div class='x'><p>{}</p></div></body>"
    pages = [(i, "http://h.example/a", good.format("story " * 30, "box")) for i in range(5)] + [(9, "https://H.example:80/b", good.format("tale", "box " * 50))]
    pages += [(20, None, good.format("a a", "b b b")), (21, "http://h.example", None), (22, "junk", ""), (23, "http://k.example", "plain <b>text"), (24, "http://h.example", "<p>" * 5000 + "<div>" * 300 + "deep"), (9, "https://H.example:80/b", good.format("tale", "box " * 50))]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, path string")
    rows = html.main_text(df).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(pages) and got[9] == "tale" and got[0] == ("story " * 30).strip() and got[20] == "b b b" and got[21] == got[22] == "" and got[23] == "plain text" and got[24] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and html.main_text(df.limit(0)).count() == 0


def test_pages_give_their_articles(spark, sf_dir):
    import html as h

    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in df.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(h.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body))
        want[r["page_id"]] = "\n".join(x for x in blocks if x)
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == want


ENTRIES = [
    ("domain", "example.com", "block", "add", 10), ("domain", "Example.com", "block", "remove", 20), ("domain", "example.com", "block", "add", 30),
    ("host", "ok.example.com", "allow", "add", 15), ("prefix", "ok.example.com/bad/", "block", "add", 18), ("host", "same.org", "block", "add", 5), ("host", "same.org", "allow", "add", 5),
    ("host", "same.org", "block", "remove", 5), ("domain", None, "block", "add", 1), ("host", "x.org", "block", "add", None), ("domain", "example.com", "block", "add", 10), ("odd", "a", "block", "add", 1),
]
CASES = [
    ("http://www.example.com/a", 9, None, True), ("http://www.example.com/a", 10, "domain:example.com", False), ("http://www.example.com", 19, "domain:example.com", False),
    ("http://www.example.com/a", 20, None, True), ("HTTP://U:p@WWW.example.com.:80/a?b#c", 31, "domain:example.com", False), ("https://ok.example.com/", 14, "domain:example.com", False),
    ("https://ok.example.com/", 16, "host:ok.example.com", True), ("https://ok.example.com/bad/x", 18, "prefix:ok.example.com/bad", False), ("https://ok.example.com/badly", 19, "host:ok.example.com", True),
    ("http://same.org/", 7, "host:same.org", False), (None, 7, None, True), ("nonsense", 7, None, True), ("http://www.example.com/a", None, None, True), ("http://example.com/" + "a/" * 300, 12, "domain:example.com", False),
]


@pytest.mark.parametrize("limit", [None, 0])
def test_url_filters(spark, monkeypatch, limit):
    if limit is not None:
        import statflow.plans.lookup as lookup

        monkeypatch.setattr(lookup.join_lookup, "__defaults__", ("left", limit))
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, rule string, action string, at int")
    rows = [(i, u, t, i) for i, (u, t, _, _) in enumerate(CASES)]
    captures = spark.createDataFrame(rows + rows[:2], "page_id long, url string, fetched_at int, key int")
    got = urls.judge(captures, entries).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r["matched"], r["kept"]) == CASES[r["page_id"]][2:], r
    assert urls.judge(captures, entries.limit(0)).where("kept").count() == len(rows) + 2 and urls.judge(captures.limit(0), entries).count() == 0
