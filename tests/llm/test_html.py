import random
import time

import pytest

from ledgerline.llm import html as H


def test_held_out_accuracy():
    r = random.Random(1234)
    right = total = 0
    for _ in range(300):
        page, labels = H.labelled_page(r)
        right += sum(a == b for a, b in zip(H.trained().label(page), labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_labelling():
    r = random.Random(5)
    model = H.trained()

    def score(page, labels):
        s = sum(sum(model.weights.get(f, 0) for f in fs) for fs, y in zip(H.features(page), labels) if y)
        return s + sum(model.moves[a][b] for a, b in zip(labels, labels[1:]))

    for _ in range(10):
        page = H.labelled_page(r)[0][:9]
        best = max(score(page, [n >> k & 1 for k in range(len(page))]) for n in range(1 << len(page)))
        assert score(page, [int(x) for x in model.label(page)]) == pytest.approx(best)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<p>b <b>c</b>d<br>e</p>", ["a", "b cd e"]),
        ("x&amp;y &lt;p&gt; &#65;&#x42; &am &copy", ["x&y <p> AB &am ©"]),
        ("<script>var t='</p>';</script>a<!-- <p>no -->b<style>p{}</style>", ["ab"]),
        ('<div title="a>b">t</div><ul><li>1<li>2</ul><table><tr><td>x<td>y<tr><td>z</table>', ["t", "1", "2", "x", "y", "z"]),
        ("<div \n'broken>q</div>", ["q"]),
        ("  \n<p>\t&nbsp;a\n  b&#10;</p>", ["a b"]),
        ("<textarea>no</textarea><title>no</title><svg><text>no</text></svg>yes<script>open", ["yes"]),
        ("<html><head><meta charset=utf-8><title>no</title><script>no</script><body><p>yes", ["yes"]),
        ("<html><head>\n<title>no</title>\n<link rel=x>yes<p>more", ["yes", "more"]),
        ("<head><title>no</title><div>a</div><span>b</span>", ["a", "b"]),
        ("<head><svg><text>no</text></svg>yes", ["yes"]),
        ("<div><p>a<svg><text>no</text><p>b</div>", ["a", "b"]),
        ("<ul><li>a<object>no<li>b<p>c<video>no<p>d<select><option>no<div>no</select>e</ul>", ["a", "b", "c", "d", "e"]),
        ("<article><svg viewBox='0 0 1 1'/>a<p>b<svg><path d=x /><title/>no</svg>c<math/>d</p></article>", ["a", "b cd".replace(" ", "")]),
        ("<p>a<svg><text>no<p>b</p>c", ["a", "b", "c"]),
        ("<svg><foreignObject><div>no</div></foreignObject><text>no</text></svg>yes", ["yes"]),
        ("<template><p>no<template>no</template>no</template><noscript><p>no</noscript>yes", ["yes"]),
        ("a<!-->b<!--->c<!-- no --!>d<!x>e<?php no ?>f<!-- no", ["abcdef"]),
        ("a < b <3 <p class='x>c</p>d<", ["a < b <3", "c", "d<"]),
        ("<ul><li><div>a<li>b<ul><li>c</ul>d<li>e", ["a", "b", "c", "d", "e"]),
        ("</p>a</div></nav>b", ["a", "b"]),
        ("", []),
        ("<", ["<"]),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in H.blocks(page)] == want


def test_tag_ends_against_plain():
    """The first > outside of quotes, or else the first one, found anew for each tag."""
    r = random.Random(8)

    def plain(page, at):
        quote = None
        for i in range(at, len(page)):
            if quote:
                quote = None if page[i] == quote else quote
            elif page[i] == ">":
                return i + 1
            elif page[i] in "\"'":
                quote = page[i]
        return page.index(">", at) + 1

    for _ in range(3000):
        page = "".join(r.choice("<a \"'>=") for _ in range(r.randint(1, 40))) + ">"
        tags, at = H._Tags(page), 0
        while (start := page.find("<a", at)) >= 0:
            name = H._TAG.match(page, start).end()
            at = tags.at(start)[0]
            assert at == plain(page, name), page


@pytest.mark.parametrize(
    "part,n",
    [("<div>", 200_000), ("<a ", 200_000), ("<a \">\" ", 100_000), ("<a '>\"", 100_000), ("<!", 200_000), ("<!--", 200_000), ("<ul><li>", 100_000), ("<svg><p>", 100_000), ("<p><svg>", 100_000), ("<svg>", 200_000), ("</div>x", 100_000), ("<td><p>x", 60_000), ("<", 200_000), ("<a<", 200_000), ("<title", 100_000), ("&amp", 200_000), ("<div class='", 50_000)],
)
def test_large_broken_pages_take_linear_time(part, n):
    took = []
    for k in (n // 4, n):
        page = part * k + "<p>The end of it.</p>"
        began = time.process_time()
        H.main_text(page, H.trained())
        took.append(time.process_time() - began)
    assert took[1] < 12 and took[1] < 12 * took[0] + 0.5  # four times the page; 16 times the time would be quadratic


#: Pages laid out by hand as blogs, newspapers, manuals and old pages are; the model has not seen them.
LAYOUTS = {}
LAYOUTS['wp']='''<!doctype html><html><head><title>t</title><body class="post-template single"><div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">My Blog</a></p><p class="site-description">Just another site</p></div><nav id="site-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article class="post type-post"><header class="entry-header"><h1 class="entry-title">How to bake bread at home</h1><div class="entry-meta">Posted on <a href=x>May 3, 2020</a> by <a href=y>admin</a></div></header>
<div class="entry-content"><p>Bread is simple. You need flour, water, salt and some patience, and nothing else at all.</p><div class="ad-container"><a href="#">Buy our new flour today!</a></div><h2>Ingredients</h2><ul><li>500 g flour</li><li>350 g water</li><li>10 g salt</li></ul><p>Mix all of it and wait for a day. Then bake it in a hot oven until the crust is dark.</p><blockquote><p>Good bread needs time.</p></blockquote></div>
<footer class="entry-footer">Tagged <a href=z>bread</a></footer></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on bread</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>Great recipe, I tried it yesterday and it worked.</p></div></li></ol><form class="comment-form"><label>Name</label><button>Post Comment</button></form></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href=q>Older post about cakes</a></li></ul></section></aside><footer id="colophon" class="site-footer">Proudly powered by software. &copy; 2020</footer></div></body></html>'''
LAYOUTS['plain']='''<html><body><table><tr><td><a href=1>Home</a><br><a href=2>Papers</a><br><a href=3>Links</a></td><td><h1>On the growth of plants</h1><p>Plants grow toward the light. This has been known for a very long time, and yet the cause was found late.</p><p>Darwin studied it with his son. They covered the tips of young plants and saw that they no longer bent.</p></td></tr></table><hr><p>Copyright 1999 by the author. All rights reserved.</p></body></html>'''
LAYOUTS['news']='''<body><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><div class="topbar"><ul class="menu"><li><a href=1>World</a><li><a href=2>Sport</a></ul></div><div class="story-body"><h1>Mayor opens new bridge</h1><div class="byline">By Jane Roe</div><p>The mayor opened the new bridge on Monday in front of a large crowd of people.</p><aside class="related"><h3>Related stories</h3><ul><li><a href=3>Old bridge closed</a></li></ul></aside><p>It took four years to build, two more than planned, and cost twice as much as the city had hoped.</p><div class="newsletter"><form><p>Sign up for our newsletter</p><input><button>Go</button></form></div><p>Residents were pleased.</p><div class="social-share"><a href=4>Tweet</a><a href=5>Share</a></div></div><div class="reader-comments"><div class="comment"><p>What a waste of money this is, if you ask me.</p></div></div><div id="footer"><p>Contact us | Terms of use</p></div></body>'''
LAYOUTS['divs']='''<div><div>Site name</div><div><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></div></div><div><h1>A page with no classes</h1><div>It has a long first paragraph in a plain div, which goes on for a while, as texts do.</div><div>And a second one, which is also in a div, and says something else about the matter.</div><pre>code = 1</pre></div><div>&copy; 2021 Someone. All rights reserved.</div>'''
LAYOUTS['docs']='''<body><nav class="toc"><a href=#a>Install</a><a href=#b>Use</a></nav><main><section><h2>Install</h2><p>Run the installer and follow what it says.</p><pre>pip install x</pre></section><section><h2>Use</h2><p>Call <code>run()</code> with a path. It returns the number of lines.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>Says more.</td></tr></table></section></main><footer>Built with docs</footer></body>'''
MAIN = {'wp': ['How to bake bread at home',
        'Bread is simple. You need flour, water, salt and some patience, and nothing else at all.',
        'Ingredients',
        '500 g flour',
        '350 g water',
        '10 g salt',
        'Mix all of it and wait for a day. Then bake it in a hot oven until the crust is dark.',
        'Good bread needs time.'],
 'plain': ['On the growth of plants',
           'Plants grow toward the light. This has been known for a very long time, and yet the cause was found late.',
           'Darwin studied it with his son. They covered the tips of young plants and saw that they no longer bent.'],
 'news': ['Mayor opens new bridge',
          'The mayor opened the new bridge on Monday in front of a large crowd of people.',
          'It took four years to build, two more than planned, and cost twice as much as the city had hoped.',
          'Residents were pleased.'],
 'divs': ['A page with no classes',
          'It has a long first paragraph in a plain div, which goes on for a while, as texts do.',
          'And a second one, which is also in a div, and says something else about the matter.',
          'code = 1'],
 'docs': ['Install',
          'Run the installer and follow what it says.',
          'pip install x',
          'Use',
          'Call run() with a path. It returns the number of lines.',
          'Option',
          'Meaning',
          '-v',
          'Says more.']}


@pytest.mark.parametrize("kind", LAYOUTS)
def test_layouts_by_hand(kind):
    assert H.main_text(LAYOUTS[kind], H.trained()).split("\n\n") == MAIN[kind]


_TEXT = ("A title of it", "The first paragraph of this page says something, and it goes on for a while.", "A second one follows, which is about as long as the first and ends here.")
_ARTICLE = f"<article><h1>{_TEXT[0]}</h1><p>{_TEXT[1]}</p><p>{_TEXT[2]}</p></article>"
_NAV, _FOOT = '<nav><ul><li><a href=/>Home</a></li><li><a href=/x>About</a></li></ul></nav>', "<footer><p>&copy; 2020 Someone</p></footer>"
_TALK = "<p>I liked this a lot, thanks for it.</p><p>So did I, please write more.</p>"


@pytest.mark.parametrize(
    "page",
    [
        *(f'<body class="{c}">{a}{_ARTICLE}{b}</body>' for c in ("single comments-open", "header-fixed sidebar-right", "has-sidebar nav-open ads") for a, b in (("", ""), (_NAV, _FOOT))),
        *(f"{a}{_ARTICLE.replace('<article>', '<article class="post comment-open">')}{b}" for a, b in (("", ""), (_NAV, _FOOT))),
        f'<form id="aspnetForm">{_NAV}<div class="content">{_ARTICLE.replace("article", "div")}</div>{_FOOT}</form>',
        f'<div id="wrapper" class="has-sidebar">{_NAV}{_ARTICLE}<aside class="sidebar"><h3>More</h3><p>Another page that you may want to read.</p></aside></div>',
        _ARTICLE.replace("</article>", f'<section id="responses"><h2>Two responses</h2>{_TALK}</section></article>'),
        f'{_NAV}{_ARTICLE}<section id="feedback"><h2>Feedback</h2>{_TALK}</section>{_FOOT}',
    ],
)
def test_names_of_what_holds_the_page_tell_nothing_of_its_parts(page):
    assert H.main_text(page, H.trained()).split("\n\n") == [*_TEXT]


@pytest.mark.parametrize("texts", [_TEXT[1:2], _TEXT[1:], _TEXT])
def test_a_few_paragraphs_are_a_page(texts):
    for around in ("{}", "<body>{}</body>", "<div>{}</div>"):
        assert H.main_text(around.format("".join(f"<p>{t}</p>" for t in texts)), H.trained()).split("\n\n") == [*texts]


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract(pages).collect():
        page = texts[r.page_id]
        inner = page[page.index("<article>") : page.index("</article>")]
        assert r.text == "\n\n".join(b.text for b in H.blocks(inner)) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<article><p>Long enough to be the text of a page, surely.</p></article>"), (2, "u", "<nav><a href=x>Home</a></nav>")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "page_id")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 45]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
