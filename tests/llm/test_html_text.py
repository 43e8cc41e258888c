import random
from collections import defaultdict

import pytest

from corpusloom.llm import html_text as H
from corpusloom.llm.common import read

CASES = [
    ("<p>a<b>b</b>&nbsp;c<p>d", [("-", "ab c"), ("-", "d")]),
    ('<div class="cookie-notice">x</div><main><header><h1>T</h1></header><p>x &lt;b&gt; y</p><div id="comments"><p>c</p></div></main><footer>f', [("+", "T"), ("+", "x <b> y")]),
    ("<article><p>one</p><aside>no</aside><p>two<form><p>z</p></form>three</article>", [("+", "one"), ("+", "two"), ("?", "three")]),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>1 < 2 & 3</article>", [("?", "a"), ("?", "b"), ("+", "c"), ("+", "d"), ("+", "1 < 2 & 3")]),
    ("<!-- x", []),
    ("", []),
    ('<script>if (a<b) "</article>"</script><article>t<script>x</script>u</article>', [("?", "tu")]),
    ("plain text", [("-", "plain text")]),
    ('<article><h1>a &am</h1><div class=ad>buy</div><p>b<br>c</p><section class="reader-comments"><p>hi</section><p>d &amp &#233;&#x1F600;</article>', [("+", "a &am"), ("+", "b c"), ("+", "d & é\U0001f600")]),
    ("<head><title>t</title><style>p{}</style></head><body><nav><ul><li>m</ul></nav><div role=banner>x</div><p hidden>y<p>z", [("-", "z")]),
    ("<article><p>un<i>clo<b>sed</article><div class=sidebar>s</div>", [("+", "unclosed")]),
    ("<ARTICLE><P>A\n\t B</P></ARTICLE>", [("+", "A B")]),
    # reader comments, related pages and parts around the text, wherever they stand
    ('<article><p>t</p></article><article class="comment"><p>first!</p></article>', [("+", "t")]),
    ('<article><p>t</p><div class="post-comments"><p>c</p></div></article>', [("+", "t")]),
    ('<article><p>t</p><section class="related-content"><p>r</p></section></article>', [("+", "t")]),
    ('<article><header><h1><a href="/">Title</a></h1><p>By X</p> | share</header><p>t</p><footer><p>tags</p></footer></article>', [("+", "Title"), ("+", "t")]),
    ('<article><p class="social">a</p><p id="share">b</p></article>', [("+", "a"), ("+", "b")]),
    ('<div class="social">x</div><div class="comment-content">c</div><div class="post-content"><p>t</p></div>', [("-", "t")]),
    ('<div class="page-with-sidebar"><div class="sidebar">s</div><p>t</p></div>', [("-", "t")]),
]


@pytest.mark.parametrize("page,want", CASES)
def test_blocks(page, want):
    assert H.blocks(page) == want


def test_suffix_array():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        sa, _ = H.suffix_array(s)
        rest = [s[p:].tolist() for p in sa]
        assert rest == sorted(rest)


@pytest.mark.parametrize("seed", range(20))
def test_repeats_against_brute_force(seed):
    r = random.Random(seed)
    least = r.randint(1, 4)
    pages = [[[r.randint(0, 3) for _ in range(r.randint(0, 12))] for _ in range(r.randint(0, 3))] for _ in range(5)]
    ids = [r.randint(0, 3) for _ in pages]
    where = defaultdict(set)
    for p, page in enumerate(pages):
        for b in page:
            for k in range(len(b) - least + 1):
                where[tuple(b[k : k + least])].add(ids[p])
    want = [[len({x for k in range(len(b) - least + 1) if len(where[tuple(b[k : k + least])]) > 1 for x in range(k, k + least)}) for b in page] for page in pages]
    assert H.repeated(pages, ids, least) == want


def test_repeats_leave_pages_without_an_article(spark):
    menu = "home news about contact imprint privacy terms help jobs press"
    rows = [(i, f"http://H.example/{i}", f"<div>{menu}</div><div>own words of page {i} and more of its own text x{i}</div>") for i in range(5)] + [(9, "http://other.example/", f"<div>{menu}</div>"), (10, None, "<article>only</article>"), (11, "no url", None), (9, "http://other.example/", f"<div>{menu}</div>")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"own words of page {i} and more of its own text x{i}"
    assert got[9] == menu and got[10] == "only" and got[11] == ""


def test_query(spark, data):
    import html
    import re

    pages = {r.page_id: r.html for r in read(spark, data, "pages").collect()}
    got = {r.page_id: r for r in H.op10_html_text(spark, data).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        article = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert got[i].text == "\n".join(x for x in parts if x) and got[i].n_chars == len(got[i].text)


def test_empty_table_and_long_page(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert H.extract(none).count() == 0
    body = " ".join(f"w{i}" for i in range(60000))
    one = spark.createDataFrame([(1, "http://a/", f"<article><p>{body}</p></article>", 3)], "page_id long, url string, html string, text int")
    assert H.extract(one).first().text == body


def test_repeats_of_the_whole_host(spark):
    """Boilerplate on few of a large host's pages, and shards that change nothing."""
    notice = "this notice stands on a few pages of a large host only"
    rows = [(i, f"http://h.example/{i}", f"<p>{' '.join(f'w{i}x{k}' for k in range(20))}</p>" + f"<p>{notice}</p>" * (i % 60 == 0)) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got, whole = ({r.page_id: (r.text, r.repeated_tokens) for r in H.extract(pages, per_shard=n).collect()} for n in (4, 1000))
    assert got == whole and len(got) == 600
    for i, (text, n) in got.items():
        assert text == " ".join(f"w{i}x{k}" for k in range(20)) and n == len(notice.split()) * (i % 60 == 0)


def test_runs_across_short_blocks(spark):
    """A menu of short items is cut although no item has eight tokens."""
    menu = "".join(f"<li>{x}</li>" for x in ("Home", "About us", "News", "Contact", "Privacy", "Terms of use", "Help"))
    rows = [(i, f"http://h.example/{i}", f"<ul>{menu}</ul><p>{' '.join(f'w{i}x{k}' for k in range(9))}</p>") for i in range(6)]
    for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), per_shard=2).collect():
        assert r.text == " ".join(f"w{r.page_id}x{k}" for k in range(9)) and r.repeated_tokens == 10


def test_copies_without_an_article_stay(spark):
    """Equal pages are one body, and what two bodies share is no boilerplate; a menu on more of them is."""
    menu = "home news about contact imprint privacy terms help jobs press"
    body = "a text without an article element that two pages of the host hold word for word"
    bodies = [body] * 4 + [body + " and a bit more"] + [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(3)]
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><p>{b}</p>") for i, b in enumerate(bodies)] + [(8 + i, "http://two.example/", f"<p>{body}</p>") for i in range(2)]
    for n in (1, 64):
        got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), per_shard=n).collect()}
        assert [got[i].text for i in range(8)] == bodies and got[8].text == got[9].text == body
        assert [got[i].repeated_tokens for i in (0, 8, 9)] == [26, 16, 16]


def test_open_blocks_of_an_article(spark):
    """Repeats decide lists and bare text of an article; its paragraphs stay, however often they stand on the host."""
    share = "<ul>" + "".join(f"<li>{x}</li>" for x in ("Share this", "on one network", "on another network", "by mail today")) + "</ul>"
    passage = "a passage that the author repeats on every page of this host, word for word, as a summary"
    rows = [(i, f"http://h.example/{i}", f"<article><h1>page {i}</h1>{share}<p>{passage}</p><ul><li>own point number {i} of the page, said once only</li></ul></article>") for i in range(500)]
    rows += [(1000 + i, "http://few.example/", f"<article>{share}<p>text {i}</p></article>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for n in (16, 1000):
        got = {r.page_id: r.text for r in H.extract(pages, per_shard=n).collect()}
        for i in range(500):
            assert got[i] == f"page {i}\n{passage}\nown point number {i} of the page, said once only"
        assert got[1000].startswith("Share this\non one network") and got[1000].endswith("text 0")


def test_a_run_on_three_pages_of_a_large_host(spark):
    """Two pages may quote each other; what three bodies of 500 share goes, wherever they are dealt."""
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    two, three = "these nine words stand on two pages of five hundred", "these eleven words here stand on three pages of five hundred"
    rows = [(i, f"http://h.example/{i}", f"<p>{own(i)}</p>" + f"<p>{two}</p>" * (i in (7, 400)) + f"<p>{three}</p>" * (i in (9, 250, 499))) for i in range(500)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(t == own(i) + f"\n{two}" * (i in (7, 400)) for i, t in got.items())


def test_many_equal_rows(spark):
    """Equal rows are dealt apart and are one page in counts."""
    menu = "home news about contact imprint privacy terms help jobs press"
    rows = [(1, "http://h.example/1", f"<div>{menu}</div>")] * 300 + [(None, None, f"<div>{menu}</div>")] * 100
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), per_shard=16)
    assert {(r.page_id, r.text, r.repeated_tokens) for r in got.collect()} == {(1, menu, 0), (None, menu, 0)} and got.count() == 400


def test_paragraphs_go_through_the_repeats_of_the_host(spark):
    """Pages of paragraphs only are in the suffix array of their host, in one shard or many; their paragraphs stay."""
    passage = "these ten words of an author stand on several pages"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"http://h.example/{i}", f"<nav>menu</nav><article><p>{own(i)}</p>" + f"<p>{passage}</p>" * (i % 7 == 0) + "</article>") for i in range(60)]
    rows += [(100, "http://other.example/", f"<article><p>{passage}</p></article>"), (101, "http://h.example/x", f"<article>{passage}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for n in (4, 1000):
        got = {r.page_id: (r.text, r.repeated_tokens) for r in H.extract(pages, per_shard=n).collect()}
        assert all(got[i] == (own(i) + f"\n{passage}" * (i % 7 == 0), 10 * (i % 7 == 0)) for i in range(60))
        assert got[100] == got[101] == (passage, 0)


def test_work_of_a_shard(monkeypatch):
    """A shard's words are hashed together, not one by one, and the suffix array of eight tokens takes two sorts."""
    import zlib

    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    texts = [" ".join(f"w{r.randint(0, 9999)}" for _ in range(200)) for _ in range(40)]
    calls = {"digest": 0, "argsort": 0}

    def counted(name, f):
        def call(*a, **k):
            calls[name] += 1
            return f(*a, **k)

        return call

    monkeypatch.setattr(H, "digest", counted("digest", H.digest))
    streams = H._Streams(pa.table({"blocks": [zlib.compress(f"-{t}".encode()) for t in texts], "salt": [1] * 40, "shard": [1] * 40, "parts": [2] * 40}))
    assert calls["digest"] <= 2 * len(texts)
    monkeypatch.setattr(np, "argsort", counted("argsort", np.argsort))
    sa, _ = H.suffix_array(streams.tokens, 8)
    assert calls["argsort"] <= 2
    runs = [streams.tokens[p : p + 8].tolist() for p in sa]
    assert runs == sorted(runs)


def test_a_shard_without_words(spark):
    """Shards of a large host whose pages are all empty."""
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", None) for i in range(12)] + [(20, "http://h.example/x", "<p>one</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.repeated_tokens) for r in H.extract(pages, per_shard=2).collect()}
    assert got == {**{i: ("", 0) for i in range(12)}, 20: ("one", 0)}


def test_word_hashes():
    import pyarrow as pa

    words = sorted({a * n + b for a in ("a", "b", "é", "日本", "\u0000", "x" * 90) for n in range(5) for b in ("", "a", "ab", "ba", "\U0001f600")})
    got = H.word_hashes(pa.array(words, pa.large_string())).tolist()
    assert len(set(got)) == len(words)
    assert H.word_hashes(pa.array(words, pa.large_string())[3:50]).tolist() == got[3:50]
    assert [int(H.word_hashes(pa.array([w], pa.large_string()))[0]) for w in words] == got
    assert len(H.word_hashes(pa.array([], pa.large_string()))) == 0


@pytest.mark.parametrize("seed", range(20))
def test_boilerplate_against_brute_force(seed):
    """Runs across the blocks of a page, on enough ids and bodies, here or in other shards."""
    import numpy as np

    r = random.Random(seed)
    least, words = r.randint(1, 4), r.choice((2, 3, 9))
    pages = [[[r.randrange(words) for _ in range(r.randint(0, 5))] for _ in range(r.randint(0, 4))] for _ in range(9)]
    ids, bodies = ([r.randint(0, 4) for _ in pages] for _ in range(2))
    streams = [[x for b in page for x in b] for page in pages]
    tokens = [x for s in streams for x in s]
    known = {(0,) * least: (True, False), (1,) * least: (True, True)}
    where, covered = defaultdict(set), []
    for p, s in enumerate(streams):
        for k in range(len(s) - least + 1):
            where[tuple(s[k : k + least])].add((ids[p], bodies[p]))
    for rule in (lambda run: len({i for i, _ in where[run]}) > 1 or known.get(run, (0, 0))[0], lambda run: min(len({x[j] for x in where[run]}) for j in (0, 1)) >= H.BODIES or known.get(run, (0, 0))[1]):
        out = []
        for page, s in zip(pages, streams, strict=True):
            hit, at = {x for k in range(len(s) - least + 1) if rule(tuple(s[k : k + least])) for x in range(k, k + least)}, 0
            for b in page:
                out.append(len(hit & set(range(at, at + len(b)))))
                at += len(b)
        covered.append(out)

    def elsewhere(at):
        found = [known.get(tuple(tokens[a : a + least]), (False, False)) for a in at.tolist()]
        return np.array([f[0] for f in found], bool), np.array([f[1] for f in found], bool)

    sizes, owner = [len(b) for page in pages for b in page], [p for p, page in enumerate(pages) for _ in page]
    got = H.coverage(np.array(tokens, np.int64), np.array(sizes, np.int64), np.array(owner, np.int64), np.array(ids), least, elsewhere, np.array(bodies))
    assert [x.tolist() for x in got] == covered


def test_keys_among_others():
    import numpy as np

    r = np.random.default_rng(2)
    for n, m in ((0, 5), (5, 0), (1, 1), (3000, 700)):
        keys, some = (r.integers(0, 2000, k).astype(np.uint64) << np.uint64(11) for k in (n, m))
        assert H._among(keys, some).tolist() == np.isin(keys, some).tolist()
        assert H._twice(keys).tolist() == [int((keys == k).sum()) > 1 for k in keys]
