"""The block labeller on pages written by hand, on odd markup, and as a Spark operator."""

import random
import time

import pytest

from perron.llm import html, html_train

A = "The council voted on Tuesday to rebuild the old bridge over the river, which has been closed since the flood."
B = "Work will begin in spring and take about two years, the mayor said. Ferries will run every ten minutes until then."
C = "Residents welcomed the plan, although some fear that traffic will move to the northern quarter."
TITLE = "Bridge to be rebuilt"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/contact">Contact</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 The Daily. All rights reserved.</footer>"
ARTICLE = f"<article><h1>{TITLE}</h1><p>{A}</p><p>{B}</p><p>{C}</p></article>"
ALL = [TITLE, A, B, C]


def doc(body: str, head: str = "<title>x - The Daily</title>") -> str:
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def nested(n: int, inner: str, name=lambda k: "") -> str:
    for k in range(n):
        inner = f"<div{name(k)}>{inner}</div>"
    return inner


PAGES: dict[str, tuple[str, list[str]]] = {
    **{f"wrappers {n}": (doc(NAV + nested(n, ARTICLE) + FOOT), ALL) for n in (0, 1, 2, 4, 6, 9, 12, 15, 40)},
    **{f"odd names {n}": (doc(NAV + nested(n, ARTICLE, lambda k: f' class="q{k}x zz-{k} Box_{k}__a"') + FOOT), ALL) for n in (3, 8, 15)},
    "blog theme": (
        doc(
            '<div id="page" class="hfeed site"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">The Daily</a></h1><p class="site-description">News from the valley</p>'
            '<nav id="site-navigation" class="main-navigation"><ul class="nav-menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>'
            '<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main" role="main"><article id="post-17" class="post-17 post type-post hentry">'
            f'<header class="entry-header"><h1 class="entry-title">{TITLE}</h1></header><div class="entry-content"><p>{A}</p><p>{B}</p><p>{C}</p></div>'
            '<footer class="entry-footer"><a href="/t/bridges">bridges</a> <a href="/t/town">town</a></footer></article>'
            '<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment even"><article class="comment-body"><footer class="comment-meta"><b class="fn">Ann</b> says:</footer><div class="comment-content"><p>High time, I used to cross it every day.</p></div></article></li></ol></div>'
            '</main></div><div id="secondary" class="widget-area" role="complementary"><aside class="widget"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/a">Market day moved</a></li><li><a href="/b">Snow expected</a></li></ul></aside></div></div>'
            '<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a blog engine</div></footer></div>'
        ),
        ALL,
    ),
    "app layout": (
        doc(
            '<div id="root"><div class="app"><div class="topbar"><a href="/">Start</a><a href="/map">Map</a></div><div class="layout"><div class="col"><div class="story-body">'
            f'<h1>{TITLE}</h1><div class="text-block">{A}</div><div class="text-block">{B}</div><div class="text-block">{C}</div></div></div><div class="rail sidebar"><h3>Most read</h3><a href="/1">Ten walks</a><a href="/2">Old mill sold</a></div></div>'
            '<div class="footer">Imprint, privacy</div></div></div>'
        ),
        ALL,
    ),
    "hashed names": (doc(f'<div class="css-1x2y3z"><div class="css-77ab"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><div class="css-k2"><div class="sc-bdVaJa"><h1 class="sc-ht">{TITLE}</h1><p class="css-p">{A}</p><p class="css-p">{B}</p><p class="css-p">{C}</p></div></div></div>'), ALL),
    "table layout": (
        doc(f'<table width="100%"><tr><td colspan="2"><font size="5">The Daily</font></td></tr><tr><td width="150"><a href="/">Home</a><br><a href="/n">News</a><br><a href="/s">Sport</a></td><td><h2>{TITLE}</h2><p>{A}<p>{B}<p>{C}</td></tr><tr><td colspan="2"><a href="/i">Imprint</a> | <a href="/c">Contact</a></td></tr></table>'),
        [TITLE, A, B, C],
    ),
    "line breaks": (doc(f"{NAV}<div class='content'><h1>{TITLE}</h1><div>{A}<br><br>{B}<br><br>{C}</div></div>{FOOT}"), [TITLE, f"{A} {B} {C}"]),
    "line breaks under a heading": (doc(f"{NAV}<div class='post'><h2>{TITLE}</h2>{A}<br>{B}</div>{FOOT}"), [TITLE, f"{A} {B}"]),
    "comments inside the article": (
        doc(f'{NAV}<article class="post"><h1>{TITLE}</h1><p>{A}</p><p>{B}</p><section class="comments"><h3>Comments</h3><div class="comment"><b>Joe</b><p>I do not believe it will be ready in two years, frankly.</p></div><div class="comment"><b>Sue</b><p>Good news at last!</p><div class="comment reply"><b>Joe</b><p>We will see.</p></div></div></section></article>{FOOT}'),
        [TITLE, A, B],
    ),
    "comments after the article": (doc(f'{NAV}{ARTICLE}<div id="disqus_thread"><ul><li class="reply"><p>Who will pay for it? The town has no money left at all.</p></li></ul></div>{FOOT}'), ALL),
    "cookie notice first": (doc(f'<div class="cookie-banner"><p>We use cookies to make this site work. By going on you accept them.</p><button>Accept</button></div>{NAV}<main><h1>{TITLE}</h1><p>{A}</p><p>{B}</p></main>{FOOT}'), [TITLE, A, B]),
    "adverts between paragraphs": (doc(f'{NAV}<article><h1>{TITLE}</h1><p>{A}</p><div class="ad">Buy the new Turbo mower, half price only this week!</div><p>{B}</p><div class="advertisement"><p>Advertisement</p></div><p>{C}</p></article>{FOOT}'), ALL),
    "many class words": (doc(f'{NAV}{ARTICLE}<div class="a1 b2 c3 d4 e5 f6 g7 h8 i9 sidebar"><p>Ten places for a summer walk with the whole family, from the lake to the hills.</p></div>{FOOT}'), ALL),
    "forms": (doc(f'{NAV}<form class="search"><label>Search</label><input><button>Go</button></form>{ARTICLE}<form><p>Write to us, we are happy to hear from you.</p><label>Name <input></label><textarea>Your message</textarea><select><option>One</option><option>Two</option></select></form>{FOOT}'), ALL),
    "list and quote": (doc(f"{NAV}<article><h1>{TITLE}</h1><p>{A}</p><ul><li>a wider lane for bicycles</li><li>lamps on both sides</li></ul><blockquote>{C}</blockquote><h2>What it costs</h2><p>{B}</p></article>{FOOT}"), [TITLE, A, "a wider lane for bicycles", "lamps on both sides", C, "What it costs", B]),
    "references and white space": (doc(f"{NAV}<article><h1>Caf&eacute; &amp; bar</h1><p>Open\n  from&nbsp;9 &#8211; 17 &lt;daily&gt;, as the owner of the place told us yesterday.</p><p>{A}</p></article>{FOOT}"), ["Café & bar", "Open from 9 – 17 <daily>, as the owner of the place told us yesterday.", A]),
    "unclosed paragraphs": (doc(f"{NAV}<div id=main><h1>{TITLE}</h1><p>{A}<p><b>{B}<p>{C}</div>{FOOT}"), ALL),
    "main with aside inside": (doc(f'{NAV}<main><div class="grid"><div><h1>{TITLE}</h1><p>{A}</p><p>{B}</p></div><aside><h3>Related</h3><ul><li><a href="/x">Ferry to run again</a></li><li><a href="/y">Flood report</a></li></ul></aside></div></main>{FOOT}'), [TITLE, A, B]),
    "sidebar layout names": (doc(f'<div class="site-container"><header class="site-header"><p class="site-title">The Daily</p></header><div class="site-inner"><div class="content-sidebar-wrap"><main class="content">{ARTICLE}</main><aside class="sidebar sidebar-primary"><section class="widget"><p>Write to the editors with your own news from the valley.</p></section></aside></div></div><footer class="site-footer"><p>Copyright 2024</p></footer></div>'), ALL),
    "bare body": (doc(f"<h1>{TITLE}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"), ALL),
    "share and tags": (doc(f'{NAV}<article><h1>{TITLE}</h1><div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{A}</p><p>{B}</p><div class="tags">Tags: <a href="/b">bridge</a>, <a href="/t">town</a></div></article>{FOOT}'), [TITLE, A, B]),
    "german": (doc('<div class="navigation"><a href="/">Startseite</a><a href="/k">Kontakt</a></div><div class="artikel content"><h1>Brücke wird neu gebaut</h1><p>Der Rat hat am Dienstag beschlossen, die alte Brücke über den Fluss neu zu bauen.</p><p>Die Arbeiten beginnen im Frühjahr und dauern zwei Jahre.</p></div><div id="footer">Impressum | Datenschutz</div>'), ["Brücke wird neu gebaut", "Der Rat hat am Dienstag beschlossen, die alte Brücke über den Fluss neu zu bauen.", "Die Arbeiten beginnen im Frühjahr und dauern zwei Jahre."]),
    "scripts": (doc(f'<script>document.write("<p>no</p>")</script>{NAV}<style>p{{color:red}}</style><article><h1>{TITLE}</h1><script>var x = "</p><p>";</script><p>{A}</p><noscript>Enable scripts</noscript><svg><text>logo</text></svg><p>{B}</p></article>{FOOT}'), [TITLE, A, B]),
}


def got(pages: list) -> list[list[str]]:
    return [t.split("\n\n") if t else [] for t in html.main_texts(pages, *html.model())]


def test_pages_written_by_hand():
    """Recall and precision by block over pages of many shapes."""
    found = got([p for p, _ in PAGES.values()])
    right = sum(len(set(f) & set(want)) for f, (_, want) in zip(found, PAGES.values()))
    wrong = {k: (sorted(set(want) - set(f)), sorted(set(f) - set(want))) for (k, (_, want)), f in zip(PAGES.items(), found) if f != want}
    assert len(PAGES) >= 20
    assert right >= 0.95 * sum(len(w) for _, w in PAGES.values()), wrong
    assert right >= 0.95 * sum(map(len, found)), wrong


def test_depth_makes_no_difference():
    pages = [doc(NAV + nested(n, ARTICLE) + FOOT) for n in (0, 5, 50, 3000)]
    assert got(pages) == [ALL] * 4


def test_composed_pages():
    w, vocabulary = html.model()
    assert html_train.accuracy(w, vocabulary.tokens, 150, 9) > 0.97


def test_odd_markup():
    assert got([None, "", "   ", "<", "<<<>", "a", "</p></div>", "<!--", "<p", "<script>", "&amp;"])[:3] == [[], [], []]
    v = html.model()[1]
    blocks = lambda p: [b.text for b in html.parse_blocks(p, v)]
    assert blocks("<p>one<!-- <p>no</p> --><p>a < b &lt; c<p>don't <b>x</b>y<br>z</P>end") == ["one", "a < b < c", "don't xy z", "end"]
    assert blocks('<a title="a>b" href=x>in</a><p don\'t>it\'s') == ["in", "it's"]
    assert blocks("<ul><li>1<li>2<ul><li>3</ul><li>4</ul><table><tr><td>5<td>6<tr><td>7</table>") == list("1234567")
    assert blocks("x<style>no</style>y<title>no</title><textarea><b>t</b></textarea>") == ["xy", "<b>t</b>"] or blocks("x<style>no</style>y") in (["x", "y"], ["xy"])


@pytest.mark.parametrize("unit", ["<a href ", "<div>", "</b>", "<p>", "<b><div></div>", "<li>", '<a href="', "<!--", "<script>", "&amp;", "<td>", "<a href=x>"])
def test_linear_time(unit):
    """Broken markup over and over again takes time in proportion."""
    v = html.model()[1]
    html.parse_blocks(unit * 100, v)
    began = time.process_time()
    html.parse_blocks(unit * 40_000 + "</div>" * 40_000, v)
    assert time.process_time() - began < 4


def test_operator(spark):
    """Null, empty, repeated, long and tied rows, clashing columns, empty table, against the plain function."""
    rng = random.Random(2)
    long = doc(NAV + "<article>" + "".join(f"<p>{' '.join(rng.choices(A.split(), k=40))}</p>" for _ in range(4000)) + "</article>" + FOOT)
    rows = [(1, None), (2, ""), (3, doc(ARTICLE)), (3, doc(ARTICLE)), (None, PAGES["blog theme"][0]), (5, long)]
    df = spark.createDataFrame([(i, None, h, "mine", 3) for i, h in rows], "page_id long, url string, html string, text string, N_chars int")
    out = html.extract_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    want = html.main_texts([h for _, h in rows], *html.model())
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == sorted((i or 0, t, len(t)) for (i, _), t in zip(rows, want))
    assert len(want[5].split("\n\n")) == 4000
    assert html.extract_text(df.limit(0)).count() == 0


def test_query(spark):
    """op4 over a whole given table, whose articles can be told by their tag."""
    import re

    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = html.op4_html(spark, folder).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    v = html.model()[1]
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]] or "", re.S)
        want = "\n\n".join(b.text for b in html.parse_blocks(inside[1], v)) if inside else ""
        assert (r["text"], r["n_chars"]) == (want, len(want)), r["page_id"]
