"""Pages written by hand, of layouts that the page maker does not make: site templates as they are met on the web."""

import pytest

from touchline.llm import html_blocks, html_extract

TEXTS = (
    (
        "The old bridge opens again",
        "After four years of work the stone bridge over the river was opened to walkers on Saturday morning.",
        "Its arches had been closed since the flood, when two of the pillars sank by nearly a foot.",
        "“We kept every stone that could be kept,” said the engineer in charge, who had numbered them by hand.",
        "Cars will have to use the road to the north until spring, when the second lane is to be paved.",
        "The town expects some two thousand visitors a week during summer.",
    ),
    (
        "Le marché retrouve sa place",
        "Depuis mercredi, les maraîchers sont revenus sous la halle que la ville a fait restaurer pendant deux ans.",
        "La charpente, qui date du dix-septième siècle, a été démontée pièce par pièce avant d'être traitée.",
        "Une trentaine de commerçants y vendent désormais leurs légumes, leurs fromages et leur pain.",
        "Les travaux ont coûté un peu moins que prévu, assure la mairie.",
    ),
    (
        "How bees find their way home",
        "A bee that leaves the hive for the first time turns around and looks at the entrance for a few seconds.",
        "It then flies in arcs that grow wider, and seems to learn the skyline, the position of the sun and the smell of the hive.",
        "Researchers moved forty hives by night to see which of these mattered most.",
        "Most bees came back within an hour, which nobody on the team had expected.",
        "When clouds covered the sky, the share fell to one half.",
        "The results will be published in the autumn.",
    ),
)


def p(text, tag="p"):
    return "".join(f"<{tag}>{x}</{tag}>\n" for x in text[1:])


LAYOUTS = {
    "blog": lambda t: f"""<html><head><title>{t[0]} | My weblog</title></head><body class="single single-post postid-77"><div id="page"><div id="header" role="banner"><h1 id="blog-title"><a href="/">My weblog</a></h1>
        <div class="description">Notes on this and that</div></div><div id="access"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></div>
        <div id="main"><div id="content" role="main"><div id="post-77" class="hentry post"><h2 class="entry-title">{t[0]}</h2><div class="entry-content">{p(t)}
        <div class="sharedaddy sd-sharing-enabled"><h3 class="sd-title">Share this:</h3><div class="sd-content"><ul><li class="share-twitter"><a href="#">Twitter</a></li><li class="share-facebook"><a href="#">Facebook</a></li></ul></div></div></div></div>
        <div id="nav-below" class="navigation"><div class="nav-previous"><a href="#">&larr; An older post</a></div></div>
        <div id="comments"><h3 id="comments-title">2 thoughts on this post</h3><ol class="commentlist"><li class="comment"><div class="comment-author"><cite>Ann</cite> says:</div><p>Thanks for this, I enjoyed it.</p></li></ol>
        <div id="respond"><h3>Leave a Reply</h3><form><p>Your email address will not be published.</p><label>Name</label><input></form></div></div></div></div>
        <div id="primary" class="widget-area"><ul><li class="widget widget_recent_entries"><h3>Recent Posts</h3><ul><li><a href="#">One more post</a></li></ul></li></ul></div>
        <div id="footer"><div id="colophon"><a href="#">Proudly powered by a blog engine.</a></div></div></div></body></html>""",
    "opaque": lambda t: f"""<!doctype html><html lang=en><body><div class="css-1a2b3c"><header class="css-9f8e7d"><a href="/">The Daily</a><nav class="css-77aa"><ul><li><a href=/w>World</a></li><li><a href=/b>Business</a></li><li><a href=/s>Science</a></li></ul></nav></header>
        <main class="css-0k0k"><article class="css-5d5d"><h1 class="css-t1">{t[0]}</h1><section class="css-body">{p(t)}</section></article><section class="css-r3"><h2>Related articles</h2><ul><li><a href=#>A first story to read next</a></li><li><a href=#>A second one</a></li></ul></section></main>
        <footer class="css-ft"><p>&copy; 2024 The Daily. All rights reserved.</p><ul><li><a href=#>Privacy</a></li><li><a href=#>Terms</a></li></ul></footer></div></body></html>""",
    "tables": lambda t: f"""<HTML><BODY BGCOLOR=white><TABLE WIDTH=100% BORDER=0><TR><TD VALIGN=top WIDTH=120><A HREF=a.html>Home</A><BR><A HREF=b.html>Archive</A><BR><A HREF=c.html>Links</A></TD>
        <TD VALIGN=top><H1>{t[0]}</H1>{p(t)}</TD></TR></TABLE><HR><CENTER>Copyright 1999 A. Writer. All rights reserved.</CENTER></BODY></HTML>""",
    "bare": lambda t: f"<html><body><h1>{t[0]}</h1>{p(t)}<div>Copyright 2024 Acme News. All rights reserved.</div></body></html>",
    "essay": lambda t: f"""<body><div class="metabar u-clearfix"><a href=/ class=logo>Essays</a><a href=/in class="button">Sign in</a></div><main><article class="post-article"><section class="section"><h1 class="graf graf--title">{t[0]}</h1>
        {p(t).replace('<p>', '<p class="graf graf--p">')}</section></article></main><div class="post-actions share"><a href=#>Share on Twitter</a></div><footer class="u-foot"><p>Follow us for more stories.</p></footer></body>""",
    "manual": lambda t: f"""<body><div class="related" role="navigation"><h3>Navigation</h3><ul><li><a href="genindex.html">index</a></li><li><a href="next.html">next</a> |</li></ul></div><div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main">
        <section id="s"><h1>{t[0]}</h1>{p(t)}</section></div></div></div><div class="sphinxsidebar" role="navigation"><h4>Previous topic</h4><p class="topless"><a href="#">Install</a></p><h3>Quick search</h3><form><input></form></div></div>
        <div class="footer" role="contentinfo">&copy; Copyright 2023, The Team. Last updated on May 3.</div></body>""",
    "wiki": lambda t: f"""<body class="mediawiki"><div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">{t[0]}</h1><div id="bodyContent"><div id="mw-content-text"><div class="mw-parser-output">{p(t)}</div></div></div></div>
        <div id="mw-navigation"><h2>Navigation menu</h2><div id="p-personal" class="portlet"><ul><li><a href=#>Log in</a></li><li><a href=#>Create account</a></li></ul></div><div id="p-search"><form><input></form></div></div>
        <div id="footer" role="contentinfo"><ul id="footer-info"><li>This page was last edited in May.</li></ul><ul id="footer-places"><li><a href=#>Privacy policy</a></li><li><a href=#>Disclaimers</a></li></ul></div></body>""",
    "columns": lambda t: f"""<body><nav class="navbar navbar-expand-lg"><a class="navbar-brand" href=/>Widgets Inc</a><ul class="navbar-nav"><li class="nav-item"><a href=#>Products</a></li><li class="nav-item"><a href=#>Pricing</a></li></ul></nav>
        <div class="container"><div class="row"><div class="col-md-8"><h1>{t[0]}</h1>{p(t)}</div><div class="col-md-4"><div class="card widget"><h5>Recent posts</h5><ul><li><a href=#>What is new</a></li><li><a href=#>Our team</a></li></ul></div>
        <div class="card newsletter"><h5>Newsletter</h5><form><input name=email><button>Subscribe</button></form></div></div></div></div><footer class="py-5 bg-dark"><div class="container"><p>Copyright &copy; Widgets Inc 2022</p></div></footer></body>""",
    "agency": lambda t: f"""<body><section class="usa-banner"><header><p>An official website of the town</p></header></section><header role="banner"><a href=/>Town of Exampleton</a></header><nav><ul><li><a href=#>Services</a></li><li><a href=#>News</a></li></ul></nav>
        <main id="main-content"><h1>{t[0]}</h1>{p(t)}</main><form class="feedback"><p>Was this page helpful?</p><button>Yes</button><button>No</button></form><footer><p>Contact us | Accessibility | Privacy policy</p></footer></body>""",
    "paper": lambda t: f"""<body><div class="consent-banner"><p>Wir verwenden Cookies. Mit der Nutzung stimmen Sie zu.</p><button>Akzeptieren</button></div><nav><ul><li><a href=#>Politik</a></li><li><a href=#>Sport</a></li></ul></nav>
        <article><h1>{t[0]}</h1>{p(t[:3])}<div class="ad-slot">Anzeige</div>{p(t[2:])}</article><section class="related"><h3>Weitere Artikel</h3><ul><li><a href=#>Ein anderer Bericht</a></li></ul></section>
        <section id="kommentare" class="comments"><h3>Kommentare</h3><ul><li><p>Sehr guter Artikel, danke!</p></li></ul></section><footer><p>© 2024 Verlag. Alle Rechte vorbehalten. Impressum</p></footer></body>""",
}


@pytest.fixture(scope="module")
def found():
    model = html_extract.trained()
    return {(name, k): html_extract.main_texts([page(t)], model)[0].split("\n\n") for name, page in LAYOUTS.items() for k, t in enumerate(TEXTS)}


def test_blocks_of_pages_of_other_layouts(found):
    right = wrong = lost = 0
    report = []
    for (name, k), got in found.items():
        want = list(TEXTS[k])
        right += sum(b in want for b in got)
        wrong += sum(b not in want for b in got)
        lost += sum(b not in got for b in want)
        report += [(name, k, "extra", b) for b in got if b not in want] + [(name, k, "lost", b) for b in want if b not in got]
    assert 2 * right / (2 * right + wrong + lost) >= 0.97, report


@pytest.mark.parametrize("layout, words", [("bare", "Copyright"), ("blog", "Share this:"), ("blog", "Twitter"), ("tables", "Copyright")])
def test_no_closing_line_and_no_row_of_links(found, layout, words):
    assert not any(words in b for k in range(len(TEXTS)) for b in found[layout, k])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Text <script async src=https://cdn.example.com/>var tracking = 1;</script> more text</p>", ["Text more text"]),
        ('<p>A</p><script src="a.js"/>let x = "<p>no</p>";</script><p>B</p>', ["A", "B"]),
        ("<style media=all/>p {}</style ><p>A</p>", ["A"]),
        ("<p>A</p><svg><text>no</text><svg><text>no</text></svg><text>neither</text></svg><p>B</p>", ["A", "B"]),
        ("<p>A <svg class=i/> B <math/> C</p>", ["A B C"]),
        ("<template><p>no</p><template>x</template><p>no</p></template><p>A</p>", ["A"]),
        ("<p>A</p><svg><p>all in it", ["A"]),
        ("<textarea>a <textarea> b</textarea><p>A</p>", ["A"]),
    ],
)
def test_skipped_elements_end_where_the_standard_says(html, want):
    assert [b.text for b in html_blocks.parse(html)] == want


def test_a_slash_closes_no_block():
    path = html_blocks.parse("<article data-url=/post/1/><p>A</p></article><p>B</p>")
    assert [[p.tag for p in above(b.path)] for b in path] == [["p", "article"], ["p"]]


def above(path):
    while path is not None:
        yield path
        path = path.above
