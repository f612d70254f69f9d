"""Main text of pages in layouts written by hand, none of which the training generator makes; and the parser's cost."""

import itertools
import random
import time

import numpy as np
import pytest
from trailmark.llm import html_extract

A = "The river rose by two metres during the night, and by the morning the lower streets of the old town were under water."
B = "Nobody was hurt, the mayor said at noon, but some forty families had to leave their homes and were taken to the school."
C = "Engineers expect the level to fall again by Friday, provided that the rain in the hills does not start once more."
D = "What remains is mud, and the question why the wall that was promised ten years ago has never been built."

PAGES = {
    "blog": f"""<!doctype html><html><body class="single postid-12 wp"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Valley Notes</a></p><p>News from here</p></div>
      <nav id="site-navigation"><ul id="primary-menu"><li><a href="/">Home</a></li><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav></header>
      <div id="content" class="site-content"><main id="main"><article id="post-12" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">Water in the streets</h1></header>
      <div class="entry-content"><p>{A}</p><p>{B}</p><p>{C}</p></div></article></main></div>
      <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">A walk</a></li><li><a href="/2">Bread</a></li></ul></section></aside>
      <footer id="colophon"><div class="site-info">Proudly powered by engines</div></footer></div></body></html>""",
    "plain": f"""<html><head><title>x</title></head><body><h1>Water in the streets</h1><p>{A}</p><p>{B}</p><p>{C}<p>{D}<hr><address>Copyright 2001 by the valley press</address></body></html>""",
    "hashed": f"""<html><body><div class="r-1a2b"><div class="x9f3"><a href="/">Start</a> <a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div><div class="k-77q"><div class="zz81"><h1 class="t-55">Water in the streets</h1></div>
      <div class="p0a"><p class="q1">{A}</p><p class="q1">{B}</p><p class="q1">{C}</p></div></div><div class="f-0c"><a href="/t">Terms</a> <a href="/p">Privacy</a> <span>&copy; 2023 Valley Press</span></div></div></body></html>""",
    "table": f"""<html><body bgcolor=white><table width=100%><tr><td colspan=2><img src=logo.gif><a href="/">Valley Press</a></td></tr><tr><td width=120 valign=top><a href="/1">News</a><br><a href="/2">Sport</a><br><a href="/3">Weather</a><br><a href="/4">Letters</a></td>
      <td valign=top><h2>Water in the streets</h2><p>{A}</p><p>{B}</p><p>{C}</p></td></tr><tr><td colspan=2 align=center>Copyright 1999 Valley Press. All rights reserved.</td></tr></table></body></html>""",
    "responses": f"""<html><body><header><a href="/">Valley</a><nav><a href="/a">A</a><a href="/b">B</a></nav></header><main><h1>Water in the streets</h1><p>{A}</p><p>{B}</p><p>{C}</p></main>
      <section class="responses"><h3>3 responses</h3><ul><li><b>Ann</b> <time>2 May</time><p>So sorry to hear that, stay safe all of you.</p></li><li><b>Ben</b> <time>2 May</time><p>We saw it from the bridge, never been that high.</p></li><li><b>Cy</b> <time>3 May</time><p>And who pays for all this?</p></li></ul></section>
      <footer><p>Copyright 2020 Valley</p></footer></body></html>""",
    "headline-apart": f"""<html><body><div class="top-bar"><a href="/">Valley</a></div><div class="hero"><h1>Water in the streets</h1></div><div class="columns"><div class="story-body"><p>{A}</p><p>{B}</p><p>{C}</p></div>
      <div class="sidebar"><h4>Most read</h4><ol><li><a href="/1">One thing</a></li><li><a href="/2">Another thing</a></li><li><a href="/3">A third</a></li></ol></div></div><div class="footer">All rights reserved</div></body></html>""",
    "consent": f"""<html><body><div id="cookie-banner" role="dialog"><p>We use cookies to make this site better. By going on you agree.</p><button>Fine</button></div><div class="wrapper"><div role="main"><h1>Water in the streets</h1><p>{A}</p>
      <div class="advertisement"><p>Buy our new boots, dry feet for everyone, now at half the price.</p></div><p>{B}</p><p>{C}</p></div></div><div role="contentinfo" class="footer-links"><a href="/i">Imprint</a> <a href="/p">Privacy</a></div></body></html>""",
}
#: Articles that are lists, links, tables, single words or terms; each with the passages of its article.
LINK = f"""<p><a href="/1">{A}</a></p><p><a href="/2">{B}</a></p><p><a href="/3">{C}</a></p>"""
MENU = """<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>"""
OTHERS = {
    "list": (f"""<html><body><header>{MENU}</header><main><article><h1>Three places</h1><ol><li><h3>North</h3>{A}</li><li><h3>East</h3>{B}</li><li><h3>South</h3>{C}</li></ol></article></main><footer><p>Copyright 2020 Valley</p></footer></body></html>""", ("Three places", "North", A, "East", B, "South", C)),
    "links": (f"""<html><body>{MENU}<article><h1>Read on</h1>{LINK}</article><footer><a href="/i">Imprint</a></footer></body></html>""", ("Read on", A, B, C)),
    "word": ("<html><body><article><p>Yes.</p></article></body></html>", ("Yes.",)),
    "steps": (f"""<html><body><div class="header">{MENU}</div><div class="post-content"><h1>How to dry a cellar</h1><ul><li><p>{A}</p></li><li><p>{B}</p></li><li><p>{C}</p></li></ul></div><div class="footer">Copyright 2020 Valley</div></body></html>""", ("How to dry", A, B, C)),
    "terms": (f"""<html><body>{MENU}<main><h1>Words of the flood</h1><dl><dt>Crest</dt><dd>{A}</dd><dt>Levee</dt><dd>{B}</dd></dl></main><footer>All rights reserved</footer></body></html>""", ("Crest", A, "Levee", B)),
    "cards": (f"""<html><body>{MENU}<div class="article-body"><h1>Four views</h1><div><section><h2>Ann</h2><p>{A}</p></section><section><h2>Ben</h2><p>{B}</p></section><section><h2>Cy</h2><p>{C}</p></section></div></div><div class="footer">Copyright 2020</div></body></html>""", ("Four views", "Ann", A, "Ben", B, "Cy", C)),
    "figures": (f"""<html><body>{MENU}<article><h1>Levels</h1><p>{A}</p><table><tr><th>Day</th><th>Metres</th></tr><tr><td>Monday</td><td>4.2</td></tr><tr><td>Tuesday</td><td>6.1</td></tr></table><p>{B}</p></article><footer>Copyright 2020 Valley</footer></body></html>""", ("Levels", A, "Monday", "6.1", B)),
    "quotes": (f"""<html><body>{MENU}<main><article><h1>Voices</h1><blockquote><p>{A}</p></blockquote><blockquote><p>{B}</p></blockquote><p>{C}</p></article></main><aside class="related"><h3>Most read</h3><ul><li><a href="/1">A walk</a></li></ul></aside></body></html>""", ("Voices", A, B, C)),
}
UNWANTED = ("Copyright", "rights reserved", "sorry to hear", "from the bridge", "who pays", "cookies", "boots", "Most read", "Recent posts", "Sport", "Imprint", "Terms", "powered by")


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layout(name):
    (got,) = html_extract.extract([PAGES[name]], html_extract.model())
    assert all(x in got for x in (A, B, C)), got
    assert "Water in the streets" in got, got
    assert not [x for x in UNWANTED if x in got], got


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_other_layout(name):
    page, wanted = OTHERS[name]
    (got,) = html_extract.extract([page], html_extract.model())
    assert all(x in got for x in wanted), got
    assert not [x for x in (*UNWANTED, "Home") if x in got and x not in " ".join(wanted)], got


def test_decoding_is_the_likeliest_assignment():
    """Against all assignments of small trees in which no open node lies under a shut one."""
    rng = random.Random(8)
    for _ in range(200):
        tree = html_extract.Tree()
        tree.add("html", -1, "")
        for i in range(1, rng.randint(1, 9)):
            tree.add(rng.choice(["div", "p", "p", "svg"]), rng.randrange(i), "")
        n = len(tree.tag)
        odds = np.array([rng.gauss(0, 2) for _ in range(n)])
        score = lambda o: sum(-np.logaddexp(0, -odds[i]) if o[i] else -np.logaddexp(0, odds[i]) for i in range(1, n))  # noqa: B023, E731
        sound = lambda o: o[0] and all(not o[i] or (o[tree.parent[i]] and tree.tag[i] != "svg") for i in range(1, n))  # noqa: B023, E731
        best = max((o for o in itertools.product([True, False], repeat=n) if sound(o)), key=score)
        got = html_extract.decode(tree, odds).tolist()
        assert sound(got) and abs(score(got) - score(best)) < 1e-9


def test_empty_table_and_other_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>Yes.</p></article>", "t", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.main_texts(spark, rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("Yes.", 4)]
    assert html_extract.main_texts(spark, rows.limit(0)).count() == 0


def test_markup_left_open_is_read_in_one_pass():
    for piece in ("<a ", "<div ", "<title>", "<!--", "<script>", "</script ", "<a '\">", "<p x=\"", "<", "</b", "<ul><li><b>", "<div></b>", "<p><button><div>"):
        page = piece * ((1 << 20) // len(piece) if "><" not in piece else 30_000)
        began = time.perf_counter()
        html_extract.parse(page)
        html_extract.parse("<p>x</p>" + page + " y")
        assert time.perf_counter() - began < 2.5, piece


def test_quotes_and_ends():
    text = lambda p: html_extract.main_text(t := html_extract.parse(p), [True] * len(t.tag))
    assert text('<p title="a > b">x</p><p title=\'">\'>y</p>') == "x y"
    assert text('<p title="a>x</p><p>y</p>') == "x y"  # a quote without a partner does not swallow the page
    assert text("<p>x<i y") == "x<i y" and text("a<!-- <p>b") == "a" and text("<script>a</script >b<style>c") == "b"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a b c d"
