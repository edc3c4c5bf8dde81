import os
import time
from html.parser import HTMLParser

import pytest

from opslog.llm import pages

ROWS = "page_id long, url string, html string, text string"

CASES = [
    ("<article><h1>A &amp; B</h1><p><b>One\n  two.<br><p>Th<i>r</i>ee&nbsp;&lt;x&gt;</p></article><footer>no</footer>",
     "A & B One two. Three <x>"),
    ("<title>t</title><style>p{}</style><script>var t='</p>';</script><nav>m</nav><!-- c --><div class=\"ad\">x</div>"
     "<article>text &am &amp cut</article>", "text &am & cut"),
    ("<main><header>h</header><p>keep<aside>s</aside> on</p><form>f<input></form></main><p>out", "keep on"),
    ("<article><p>a<p class='notice'>b<p>c<ul><li>d<li class=ads>e<li>f</ul><section id='comments'>g</section></article>", "a c d f"),
    ("<article>1</article><article>2<article>3</article></article>", "1 2 3"),
    ("<div role='navigation'>n</div><div hidden>h</div><div style='display: none'>s</div><p>body a<b>b</b>c", "body abc"),
    ("<p>a < b <3 & c</p><script>never closed <p>x", "a < b <3 & c"),
    ("plain text &eacute;&#233;&#x1F600;", "plain text éé😀"),
    ("<article>cut <p>here <a href=\"x", "cut here"),
    # an element that marks words is no part of the page, an article of comments is no article
    ("<article><p>press <span class=\"search\">find</span> or <code class='menu'>m</code></p></article><article class='comment'>c</article>",
     "press find or m"),
    ("<article><header><h1>Title</h1><p>by me</p><nav><h2>n</h2></nav></header><p>x</p></article><header><h1>Site</h1></header>",
     "Title x"),
    ("<main><article class='teaser'>t</article><p>main</p></main>", "main"),
    ("<body><article class='teaser'>t</article><article class='card'>u</article><p>open", "t u"),
    ("<article class='post with-sidebar'>kept</article>", "kept"),
    ("<head><meta charset=x><body><p>t", "t"), ("<head><title>x</title><p>t", "t"),
    ("<article><p class='notice'>a<br>b<script>s</script>c<p>d</article>", "d"),
    ("<article><b>one<div>two</b> three</div> four</article>", "one two three four"),
    ("<article><table><tr><td>a<td class=ad>b<tr><td>c</table></article>", "a c"),
    ("<article>a<!-->b<!--->c<!-- x --!>d<?php x ?>e</ y>f<a title='>'>g</a></article>", "abcdefg"),
    ("<article>a<a href=\"x>b</a>c</article>", "abc"),
    ("", ""), (None, ""), ("<html></html>", ""), ("<article></article><p>t", "t"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_text_of_a_page(source, want):
    assert pages.read(source or "").text() == want


@pytest.mark.parametrize("source", [
    "<a '", "<a ", "<!", "<a b=\"", "<!--", "</", "</x>", "<b><br>", "<p><b>", "<li><div>", "<td>", "<div><li></li>", "&", "&#",
    "<a b = ", "<title>", "<dd><b>", "<", "<a =", "<table><tr><td>"])
def test_broken_pages_take_linear_time(source):
    """A megabyte of each, alone and under many open elements."""
    for start in ("", "<div>" * 50_000, "<b>" * 50_000):
        begun = time.process_time()
        pages.read(start + source * (1_000_000 // len(source)) + "</p></i></article>" * 20_000)
        assert time.process_time() - begun < 30


class Plain(HTMLParser):
    """The text of articles by another parser, for whole pages without broken nesting."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.words = [], [], []

    def end_block(self):
        if "".join(self.words).split():
            self.blocks.append(" ".join("".join(self.words).split()))
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag not in pages.INLINE:
            self.end_block()
        if tag not in pages.VOID:
            self.open.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag not in pages.INLINE:
            self.end_block()
        while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        names = [t for t, _ in self.open]
        aside = {"nav", "aside", "form", "script", "style", "footer", "header"} & set(names)
        marked = any(set(c.split()) & pages.ASIDE_WORDS for t, c in self.open)
        if "article" in names and not aside and not marked:
            self.words.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_given_pages_by_another_parser(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in pages.main_text(given).collect()}
    assert len(found) == given.count()
    for row in given.collect():
        plain = Plain()
        plain.feed(row.html)
        plain.close()
        plain.end_block()
        assert found[row.page_id] == " ".join(plain.blocks)


def test_edge_rows(spark):
    rows = [(i, f"http://alone{i}.example/x", s, "x") for i, (s, _) in enumerate(CASES[:8])]
    long = "<article>" + "<p>w x</p>" * 50_000 + "</article>"
    rows += [(100, None, "<p>no host", "x"), (101, "::", None, "x"), (101, "::", None, "x"), (None, "http://h/", "<p>a", "x"),
             (102, "http://h/", long, "x")]
    found = pages.main_text(spark.createDataFrame(rows, ROWS)).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r for r in found}
    for i, (_, want) in enumerate(CASES[:8]):
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert (got[100].text, got[101].text, got[None].text, got[102].n_chars) == ("no host", "", "a", 4 * 50_000 - 1)
    assert pages.main_text(spark.createDataFrame([], ROWS)).count() == 0


def brute(rows, run):
    """Words outside articles that no run repeated on two pages of a host covers."""
    streams = {i: (host, pages.read(source).stream) for i, host, source in rows}
    seen = {}
    for i, (host, s) in streams.items():
        for p in range(len(s) - run + 1):
            seen.setdefault((host, tuple(s[p:p + run])), set()).add(i)
    return {i: {p for p in range(len(s) - run + 1) if len(seen[host, tuple(s[p:p + run])]) > 1}
            for i, (host, s) in streams.items()}


def test_repeated_runs_of_a_host(spark):
    import random

    rng = random.Random(4)
    shared = [" ".join(f"s{rng.randrange(50)}" for _ in range(rng.randint(3, 25))) for _ in range(5)]
    rows = []
    for i in range(120):
        host = rng.choice("aaab")
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"u{i}x{rng.randrange(9)}" for _ in range(rng.randint(1, 12)))
                 for _ in range(rng.randint(1, 6))]
        rows.append((i, host, "".join(f"<div>{p}</div>" for p in parts)))
    rows += [(200 + i, "c", f"<div>{shared[0]}</div><p>same same</p>") for i in range(50)]
    frame = spark.createDataFrame([(i, f"https://{h}.example:80/p?q", s, "") for i, h, s in rows], ROWS)
    cover = brute(rows, 8)
    want = {i: pages.read(s).text({p + k for p in cover[i] for k in range(8)}) for i, _, s in rows}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = {r.page_id: r.text for r in pages.main_text(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == want
    assert any(w != pages.read(s).text() for (i, _, s), w in zip(rows, want.values()))


def shown(rows, run=8):
    """Texts of pages whose articles are plain paragraphs, by counting paragraphs on the pages of a host."""
    hosts = {}
    for i, host, parts in rows:
        hosts.setdefault(host, {})[i] = parts

    def rest(host, parts, frame):
        own = [p for p in parts if (host, p) not in frame]
        return own if 2 * len(" ".join(own).split()) > len(" ".join(parts).split()) else parts

    frame = {(h, p) for h, on in hosts.items() for ps in on.values() for p in ps if len(p.split()) >= run}
    for of in (lambda h, ps, p: p in ps, lambda h, ps, p: p in ps and p not in rest(h, ps, first)):
        first = frame
        frame = {(h, p) for h, p in first if sum(of(h, ps, p) for ps in hosts[h].values()) >= max(3, len(hosts[h]) / 2)}
    return {i: " ".join(rest(host, parts, frame)) for i, host, parts in rows}


@pytest.mark.parametrize("element", ["article", "main"])
def test_blocks_that_a_host_carries(spark, element):
    import random

    rng = random.Random(7)
    shared = [" ".join(f"s{k}x{j}" for j in range(n)) for k, n in enumerate([7, 8, 9, 12, 8, 20])]
    rows = []
    for i in range(300):
        host = rng.choice("aaaaabbc")
        parts = [p for k, p in enumerate(shared) if rng.random() < (0.9, 0.9, 0.6, 0.4, 0.05, 0.5)[k]]
        parts += [" ".join(f"u{i}x{rng.randrange(99)}" for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))] or ["x"]
        rng.shuffle(parts)
        rows.append((i, host, parts))
    rows += [(400 + i, "d", shared) for i in range(4)]                                       # copies
    rows += [(410 + i, "e", [*shared, f"own {i} of these"]) for i in range(4)]               # near copies
    # two copies, and a page that has much besides: half of the pages show the text, but it is nobody's frame
    rows += [(415 + i, "i", [*shared[:4], *([" ".join(f"w{j}" for j in range(60))] if i == 2 else [])]) for i in range(3)]
    rows += [(420 + i, "f", [shared[3], " ".join(f"v{i}x{j}" for j in range(30))]) for i in range(2)]  # too few pages
    rows += [(430, "g", [shared[3], "w " * 29 + "w"]), (431, "g", [shared[3]])]
    given = [(i, f"http://{h}.example/{i}", f"<nav>{shared[5]}</nav><{element}>" + "".join(f"<p>{p}</p>" for p in ps) + f"</{element}>", "")
             for i, h, ps in rows]
    given += [given[-2]] * 5  # rows that come again are no further pages
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(given, ROWS)
        found = pages.main_text(frame).collect()
        broad = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = pages.main_text(frame).collect()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broad)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) == len(given) and sorted(found) == sorted(joined)
    want = shown(rows)
    assert {r.page_id: r.text for r in found} == want
    gone = [i for i, _, ps in rows if want[i] != " ".join(ps)]
    assert len(gone) > 100 and all(i < 400 for i in gone)


def test_suffix_ranks_by_sorting():
    import numpy as np

    rng = np.random.default_rng(2)
    for n, run in ((0, 3), (2, 3), (3, 3), (90, 1), (90, 2), (90, 5), (200, 8)):
        tokens = rng.integers(0, 3, n).astype(np.uint32)
        cut = [tuple(tokens[i:i + run]) for i in range(n - run + 1)]
        places = {c: k for k, c in enumerate(sorted(set(cut)))}
        assert pages.suffix_ranks(tokens, run).tolist() == [places[c] for c in cut]


def framed(rows, run=8):
    """Texts of pages whose articles are plain paragraphs, by counting runs of words on the pages of a host."""
    hosts = {}
    for i, host, parts in rows:
        hosts.setdefault(host, {})[i] = [p.split() for p in parts]

    def cover(parts, frame):
        return [{q + k for q in range(len(p)) if tuple(p[q:q + run]) in frame for k in range(run)} for p in parts]

    def own(parts, frame):
        return 2 * sum(map(len, cover(parts, frame))) < sum(map(len, parts))

    want = {}
    for on in hosts.values():
        frame = {tuple(p[q:q + run]) for ps in on.values() for p in ps for q in range(len(p) - run + 1)}
        shows = {i: {tuple(p[q:q + run]) for p in ps for q in range(len(p) - run + 1)} for i, ps in on.items()}
        often = {r for r in frame if sum(r in s for s in shows.values()) >= max(3, len(on) / 2)}
        frame = {r for r in often if sum(r in s and own(on[i], often) for i, s in shows.items()) >= max(3, len(on) / 2)}
        for i, ps in on.items():
            gone = cover(ps, frame) if own(ps, frame) else [()] * len(ps)
            want[i] = " ".join(w for p, off in zip(ps, gone) for k, w in enumerate(p) if k not in off)
    return want


@pytest.mark.parametrize("words", [1 << 18, 200])
def test_runs_within_blocks_that_a_host_carries(spark, monkeypatch, words):
    import random

    monkeypatch.setattr(pages, "GROUP_WORDS", words)  # the smaller one deals hosts into many groups
    rng = random.Random(11)
    shared = [" ".join(f"s{k}x{j}" for j in range(n)) for k, n in enumerate([7, 8, 14, 11, 9])]
    rows = []
    for i in range(240):
        parts = []
        for k, p in enumerate(shared):
            if rng.random() < (0.9, 0.9, 0.7, 0.3, 0.55)[k]:  # in a block, at its begin, within it or at its end
                ahead, after = (" ".join(f"u{i}x{rng.randrange(99)}" for _ in range(rng.randint(0, 9))) for _ in "ab")
                parts.append(f"{ahead} {p} {after}".strip())
        parts += [" ".join(f"u{i}x{rng.randrange(99)}" for _ in range(rng.randint(1, 50)))]
        rng.shuffle(parts)
        rows.append((i, rng.choice("aaaabbc"), parts))
    rows += [(300 + i, "d", [f"{shared[2]} and {shared[3]}"]) for i in range(5)]                        # copies
    rows += [(310 + i, "e", [f"here {shared[2]} " + " ".join(f"v{i}x{j}" for j in range(30))]) for i in range(2)]  # too few
    rows += [(320 + i, "f", [f"n{i} {shared[1]} " + " ".join(f"v{i}x{j}" for j in range(30))]) for i in range(4)]
    given = [(i, f"http://{h}.example/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>", "") for i, h, ps in rows]
    given += [given[-1]] * 3  # rows that come again are no further pages
    found = pages.main_text(spark.createDataFrame(given, ROWS)).collect()
    want = framed(rows)
    assert len(found) == len(given) and {r.page_id: r.text for r in found} == want
    assert sum(want[i] != " ".join(ps) for i, _, ps in rows) > 100 and want[300] == rows[240][2][0] and want[310] == rows[245][2][0]
    assert want[320] == "n0 " + " ".join(f"v0x{j}" for j in range(30))
