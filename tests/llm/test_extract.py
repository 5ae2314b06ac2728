from itertools import product

import numpy as np

from sheetspark.llm import extract
from sheetspark.llm.dom import Page


def test_parser():
    page = Page('<body><p class="a b" id=c>one<p>two &amp; <b>x</b>y<br>z</div><script>"<p>no"</script><li>1<li>2<!-- <p> -->3 < 4')
    assert page.tags == ["#root", "body", "p", "p", "b", "li", "li"] and page.marks[2] == "a b c"
    assert page.parents == [-1, 0, 1, 1, 3, 3, 3]
    assert "".join(t for _, t, _ in page.texts) == "onetwo & xyz123 < 4"
    Page("<div>" * 20_000 + "</span>" * 20_000 + "</div>" * 20_000)
    for broken in ("<", "<a", '<a href="x', "<!--", "</", "<script>x", None, ""):
        Page(broken)


def test_marginals_against_all_states():
    rng = np.random.default_rng(3)
    pages = [Page("<div><p>a b.<a>c</a></p><ul><li>d</ul></div><nav>e</nav>"), Page("<p>x"), Page("")]
    weights, pair = rng.normal(size=len(extract.NAMES)), rng.normal(size=(len(extract.EDGES), 2, 2))
    forest = extract.Forest(pages)
    got, both = forest.marginals(weights, pair)
    for page, start in zip(pages, forest.starts):
        rows, edges, _ = extract.features(page)
        n, total, ones, pairs = len(rows), 0.0, np.zeros(len(rows)), np.zeros((len(rows), 2, 2))
        for state in product((0, 1), repeat=n):
            score = sum(weights[rows[i]].sum() * state[i] for i in range(n)) + sum(pair[edges[i], state[page.parents[i]], state[i]] for i in range(1, n))
            total += np.exp(score)
            ones += np.exp(score) * np.array(state)
            for i in range(1, n):
                pairs[i, state[page.parents[i]], state[i]] += np.exp(score)
        assert np.allclose(got[start : start + n], ones / total)
        assert np.allclose(both[start + 1 : start + n], pairs[1:] / total)


def test_held_out_pages():
    weights, right, n = extract.model(), 0, 0
    for source in extract.labelled_pages(seed=71, n=120):
        page, y = extract.gold(source)
        content = extract.Forest([page]).marginals(*weights)[0] >= 0.5
        for at, text, _ in page.texts:
            if text.strip():
                n, right = n + 1, right + (content[at] == y[at])
    assert right >= 0.98 * n


def test_table(spark):
    article = "<article><h1>A  title</h1><p>One&nbsp;para &lt;here&gt;. It is <b>bo</b>ld.<p>Second\n para, quite a few words of it.</article>"
    sides = '<nav><ul><li><a href="/">home</a></li></ul></nav><div class="ad">Buy now.</div>', "<footer>&copy; me &middot; All rights.</footer>"
    rows = [(1, "u", sides[0] + article + sides[1]), (2, None, None), (None, "v", ""), (3, "w", "<script>x()"), (1, "u", sides[0] + article + sides[1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = extract.extract(df).collect()
    want = "A title One para <here>. It is bold. Second para, quite a few words of it."
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", want, len(want))] * 2 + [("2", "", 0), ("None", "", 0), ("3", "", 0)])
    assert extract.extract(df.limit(0)).count() == 0
    long = "<article><p>" + "word and. " * 200_000 + "</p></article>"
    assert extract.main_texts([long], extract.model()) == [("word and. " * 200_000).strip()]


def test_nothing_else_is_dropped():
    wrap = "<body><article>{}</article></body>".format
    long = "A sentence that is long enough to be read as an article. Another follows it here."
    cases = {
        f'<p>{long}</p><svg class="i" /><p>Second part. {long}</p>': f"{long} Second part. {long}",
        f'<p>{long}</p><svg><path d="M0"/><path d="M1"></svg><p>B. {long}</p>': f"{long} B. {long}",
        f'<p>{long} <a href=foo">link text</a> goes on.</p>': f"{long} link text goes on.",
        f"<p data-x=it's>{long}</p><p>It's there. {long}</p>": f"{long} It's there. {long}",
        f"<p>{long}</p><object data=x><p>B. {long}</p>": f"{long} B. {long}",
        f"<p>{long} where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>": f"{long} where x=1 holds.",
        f"<p>{long}</p><noscript><p>B. {long}</p>": f"{long} B. {long}",
        f'<p data-class="ad" aria-hidden="false" data-role=nav>{long}</p>': long,
        f'<p title="a > b">{long}</p><p title="open>B. {long}</p>': f"{long} B. {long}",
    }
    for source, want in cases.items():
        assert extract.main_texts([wrap(source)], extract.model()) == [want], source


def test_brute_force_texts():
    """The text of small pages from the sum over all states instead of messages."""
    weights, pair = extract.model()
    for source in ("<nav><a href=x>home</a></nav><article><p>One sentence here. And more of it.</p></article>", "<div class=ad>Buy.</div><div><p>Some words of prose, not many.</p><p>Two. Three.</p></div>", "<p>x"):
        page = Page(source)
        rows, edges, _ = extract.features(page)
        total, ones = 0.0, np.zeros(len(rows))
        for state in product((0, 1), repeat=len(rows)):
            score = np.exp(sum(weights[rows[i]].sum() * state[i] for i in range(len(rows))) + sum(pair[edges[i], state[page.parents[i]], state[i]] for i in range(1, len(rows))))
            total, ones = total + score, ones + score * np.array(state)
        want = " ".join(" ".join((" " if broken else "") + (t if ones[at] / total >= 0.5 else "") for at, t, broken in page.texts).split())
        assert extract.main_texts([source], (weights, pair))[0].split() == want.split()


#: Layouts written by hand, unlike those the model is trained on: page and main text.
HAND_MADE = [
    ("""<html><body class="home blog"><div id="page" class="hfeed site"><header id="masthead"><div class="site-branding"><p class="site-title"><a href="/">The Garden Log</a></p></div>
    <nav id="site-navigation"><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav></header>
    <div id="content" class="site-content"><main id="main"><article id="post-12" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">Pruning roses in March</h1></header>
    <div class="entry-content"><p>Roses want a hard cut before the sap rises. I start with the dead wood.</p><p>Then every crossing shoot goes, and the <a href="/r">old canes</a> too.</p></div></article>
    <div id="comments" class="comments-area"><h2>2 thoughts on this</h2><ol class="comment-list"><li><p>Thanks, this helped me a lot.</p></li></ol></div></main></div>
    <footer id="colophon"><div class="site-info">Proudly made by hand. All rights reserved.</div></footer></div></body></html>""",
     "Pruning roses in March Roses want a hard cut before the sap rises. I start with the dead wood. Then every crossing shoot goes, and the old canes too."),
    ("""<html><body><table width="100%"><tr><td colspan="2"><a href="/">Home</a> | <a href="/news">News</a> | <a href="/map">Map</a></td></tr><tr><td class="menu" width="150"><a href="/1">Weather</a><br><a href="/2">Tides</a><br><a href="/3">Ports</a></td>
    <td><h2>Ferry timetable changes</h2><p>From May the first boat leaves at six. The council said that demand had grown on weekday mornings.</p><p>Tickets stay valid until the end of June. Season passes are not affected.</p></td></tr>
    <tr><td colspan="2"><font size="1">Copyright the harbour office. Contact us.</font></td></tr></table></body></html>""",
     "Ferry timetable changes From May the first boat leaves at six. The council said that demand had grown on weekday mornings. Tickets stay valid until the end of June. Season passes are not affected."),
    ("""<html><body><div class="topnav"><a href="/">Docs</a><a href="/api">API</a></div><div class="layout"><div class="toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li></ul></div>
    <div class="documentation" role="main"><h1>Installing the tool</h1><p>Download the archive and unpack it anywhere. No other package is needed.</p><pre>tool --version</pre><h2>First steps</h2><p>Run it in an empty folder. It writes a small file with defaults there.</p></div></div>
    <div class="footer">Built with care. Last updated in spring.</div></body></html>""",
     "Installing the tool Download the archive and unpack it anywhere. No other package is needed. tool --version First steps Run it in an empty folder. It writes a small file with defaults there."),
    ("""<html><body><div class="cookie-bar">We use cookies to make this site better. <button>Accept</button></div><div class="hdr"><img src="l.png"><ul class="nav"><li><a href="/s">Sport</a></li><li><a href="/p">Politics</a></li></ul></div>
    <section class="story"><h1>Bridge closed after storm</h1><div class="byline">By A. Writer</div><p>The old bridge was shut on Sunday night. Engineers found a crack in the second pier.</p><div class="ad-slot">Advertisement. Buy a new car today.</div><p>Repairs will take until autumn, the mayor told reporters. Drivers should use the northern road.</p>
    <ul><li>Buses stop at the station.</li><li>Walkers may cross by day.</li></ul></section><div class="related-links"><h3>More on this</h3><ul><li><a href="/x">Storm damage in pictures</a></li></ul></div></body></html>""",
     "Bridge closed after storm The old bridge was shut on Sunday night. Engineers found a crack in the second pier. Repairs will take until autumn, the mayor told reporters. Drivers should use the northern road. Buses stop at the station. Walkers may cross by day."),
    ("""<html><body><div><div><div><h3>Bread without kneading</h3><div>Mix flour, water and salt in the evening. Leave the bowl covered on the table.</div><div>In the morning fold the dough twice and bake it hot. Let it cool before you cut it.</div></div></div></div>
    <form action="/subscribe"><label>Your email</label><input><button>Send me recipes</button></form><div class="tags"><a href="/t/1">bread</a> <a href="/t/2">easy</a></div></body></html>""",
     "Bread without kneading Mix flour, water and salt in the evening. Leave the bowl covered on the table. In the morning fold the dough twice and bake it hot. Let it cool before you cut it."),
    ("""<html><body><nav><a href="/">Forum</a></nav><main><h1>How do I fix a squeaking door?</h1><blockquote>My kitchen door squeaks every time. What should I try first?</blockquote><p>Lift the hinge pin and grease it. If the noise stays, the frame has moved.</p><details><summary>Longer answer</summary><p>Check the screws one by one. Loose ones let the door sag.</p></details></main><aside><p>Join our newsletter for weekly tips.</p></aside></body></html>""",
     "How do I fix a squeaking door? My kitchen door squeaks every time. What should I try first? Lift the hinge pin and grease it. If the noise stays, the frame has moved. Longer answer Check the screws one by one. Loose ones let the door sag."),
]


def test_hand_made_layouts():
    from collections import Counter

    got = extract.main_texts([page for page, _ in HAND_MADE], extract.model())
    both = sum(sum((Counter(g.split()) & Counter(w.split())).values()) for g, (_, w) in zip(got, HAND_MADE))
    kept, wanted = sum(len(g.split()) for g in got), sum(len(w.split()) for _, w in HAND_MADE)
    print(f"words of hand-made layouts: precision {both / kept:.3f}, recall {both / wanted:.3f}")
    for g, (_, w) in zip(got, HAND_MADE):
        print(g == w, (Counter(g.split()) - Counter(w.split())), (Counter(w.split()) - Counter(g.split())))
    assert both > 0.9 * kept and both > 0.9 * wanted
