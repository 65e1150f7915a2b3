"""Pages written by hand after the habits of common site software, each with its main text. Nothing of them is generated."""

A = "The river rises in the northern hills, where three small streams meet below an old stone bridge."
B = "For most of the year it is shallow. In spring, however, the snow melts and the water reaches the meadows."
C = "Two mills stood here until 1911; one of them is a museum today, open from May to October."
D = "Visitors come by train. The station, built of red brick, lies ten minutes from the village square."
E_ = "Researchers have counted forty kinds of birds, among them the kingfisher, which nests in the banks."

CASES = {
    "blog": (
        f"""<!doctype html><html><head><title>River | My Blog</title><meta charset=utf-8></head><body class="home wp-singular">
<div id="masthead" class="site-branding"><a href="/">My Blog</a><span class="tagline">walks and rivers</span></div>
<div class="primary-nav-wrap"><ul id="mainnav"><li><a href="/a">Home</a></li><li><a href="/b">About me</a></li><li><a href="/c">Archive</a></li></ul></div>
<div class="hentry"><h1 class="hd">Along the river</h1><div class="the-words"><p>{A}</p><p>{B}</p><h2>The mills</h2><p>{C}</p><ul><li>Open daily</li><li>Free entry</li></ul></div></div>
<div id="respond-box"><h3>Leave a reply</h3><form><label>Your name</label><input><textarea>text</textarea><button>Post</button></form></div>
<div class="site-info">Powered by things. All rights reserved.</div></body></html>""",
        ["Along the river", A, B, "The mills", C, "Open daily", "Free entry"],
    ),
    "wiki": (
        f"""<html><body><div class="vector-menu"><ul><li><a href=1>Read</a><li><a href=2>Edit</a><li><a href=3>History</a></ul></div>
<div id="bodyContent"><h1>Blue River</h1><div class="mw-parser-output"><p>{A} Its length is <math><mi>l</mi><mo>=</mo><mn>34</mn></math> miles.</p><table><tr><th>Length</th><td>34 miles</td></tr></table><p>{E_}</p><h2>History</h2><p>{C}</p></div></div>
<div class="vector-sidebar-pane"><ul><li><a href=4>Main page</a><li><a href=5>Random page</a><li><a href=6>Help</a></ul></div>
<div class="footer-places"><ul><li><a href=7>Privacy</a><li><a href=8>Contact</a></ul></div></body></html>""",
        ["Blue River", f"{A} Its length is l=34 miles.", "Length", "34 miles", E_, "History", C],
    ),
    "news": (
        f"""<html><body><header role=banner><a href=/>The Daily</a><nav><a href=/w>World</a><a href=/s>Sport</a></nav></header>
<main><div class="story-body__inner"><h1>River floods meadows</h1><p class="lede">{B}</p><div class="c-adslot"><p>Buy two, get one. Only this week.</p></div><p>{D}</p><blockquote><p>{E_}</p></blockquote><p>{C}</p></div></main>
<aside><h3>Most read</h3><ol><li><a href=/1>One story</a></li><li><a href=/2>Another story</a></li></ol></aside>
<footer><p>Copyright The Daily. Terms apply.</p></footer></body></html>""",
        ["River floods meadows", B, D, E_, C],
    ),
    "comments": (
        f"""<html><body><div id=hd><a href=/>Forum</a></div><article><h1>A walk</h1><p>{A}</p><p>{D}</p></article>
<section class="user-comments"><h2>3 comments</h2><div class=comment-body><p>I was there last year, it is lovely. Thank you for this.</p></div><div class=comment-body><p>Which train did you take? The one at nine was late again.</p></div></section>
<div id=ft>Imprint, terms and so on.</div></body></html>""",
        ["A walk", A, D],
    ),
    "german": (
        f"""<html lang=de><body><div class="kopfzeile"><ul><li><a href=/>Start</a><li><a href=/k>Karte</a><li><a href=/i>Impressum</a></ul></div>
<article class="beitrag"><h1>Der Fluss</h1><p>{B}</p><p>{C}</p><figure><img src=x><figcaption>Die alte Mühle.</figcaption></figure><p>{D}</p></article>
<div class="cookie-hinweis"><p>Wir verwenden Cookies. Bitte stimmen Sie zu.</p></div><footer class="fusszeile">Alle Rechte vorbehalten.</footer></body></html>""",
        ["Der Fluss", B, C, "Die alte Mühle.", D],
    ),
    "table layout": (
        f"""<html><body><table width=100%><tr><td colspan=2 class=logo><img src=l><a href=/>Home</a> | <a href=/m>Map</a> | <a href=/l>Links</a></td></tr>
<tr><td class=leftnav><a href=1>Rivers</a><br><a href=2>Lakes</a><br><a href=3>Hills</a></td><td class=maintext><h1>The river</h1><p>{A}<p>{B}<p>{E_}</td></tr><tr><td colspan=2 class=copyright>Copyright 1999, me.</td></tr></table></body></html>""",
        ["The river", A, B, E_],
    ),
    "docs": (
        f"""<html><body><div class="topbar"><form><input placeholder=Search><button>Go</button></form></div><div class="layout"><div class="toc-tree"><ul><li><a href=#a>Start</a></li><li><a href=#b>Usage</a></li></ul></div>
<div role="main" class="document"><section><h1>Usage</h1><p>{A}</p><pre>make river --all</pre><p>{C}</p><dl><dt>all</dt><dd>{D}</dd></dl></section></div></div><div class="pager-links"><a href=p>Previous</a><a href=n>Next</a></div></body></html>""",
        ["Usage", A, "make river --all", C, "all", D],
    ),
    "bare": (
        f"""<html><body><h1>Notes</h1><p>{A}</p><p>{B}</p><hr><p>{C}</p></body></html>""",
        ["Notes", A, B, C],
    ),
    "shop blog": (
        f"""<html><body><div class="announcement-bar">Free shipping over 50. <a href=/s>Shop now</a></div><nav class=drawer><a href=/1>New</a><a href=/2>Sale</a></nav>
<main id=MainContent><article class=article-template><h1>Why rivers</h1><div class=rte><p>{E_}</p><p>{B}</p><object data=v.swf>{D}</object><p>{A}</p></div></article>
<div class="newsletter-signup"><h4>Join our list</h4><p>Get ten percent off your first order.</p><form><input type=email><button>Join</button></form></div></main>
<footer><ul><li><a href=/f>FAQ</a></li><li><a href=/r>Returns</a></li></ul><small>2024 Shop</small></footer></body></html>""",
        ["Why rivers", E_, B, D, A],
    ),
    "no class": (
        f"""<html><body><div><a href=/>Site</a> <a href=/a>About</a> <a href=/b>Blog</a> <a href=/c>Shop</a></div><div><h1>Mills</h1><p>{C}</p><p>{A}</p><p>{E_}</p></div><div><a href=/x>Terms</a> <a href=/y>Privacy</a></div></body></html>""",
        ["Mills", C, A, E_],
    ),
}
