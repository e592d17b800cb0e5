"""Hand-made pages of common layouts, as (page, the blocks that are its main text). No labelled page looks like them."""

A = "The council voted on Tuesday to repair the old bridge, which has been closed to lorries since the spring floods."
B = "Engineers expect the work to take nine months. Until then, drivers must use the ferry at Holm or the long road through the hills."
C = "“We could not wait any longer,” said the mayor, who had asked for money twice before."
D = "Local shops welcomed the plan, although some fear that noise will keep visitors away during the summer."
T = "Old bridge to be repaired"
LINKS = "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(("Home", "World", "Sport", "Culture", "Weather")))

LAYOUTS = [
    (f'<html><body><div class="menu"><a href="/">Home</a> <a href="/news">News</a></div><div class="story-x"><p>{A}</p><p>{B}</p></div><div class="comments"><p>I do not agree with this at all.</p><p>Neither do I, to be honest with you.</p></div></body></html>', [A, B]),
    (f'<!doctype html><title>{T}</title><header><a href="/">The Daily Holm</a></header><nav><ul>{LINKS}</ul></nav><main><article><h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p></article></main><aside><h2>Most read</h2><ul>{LINKS}</ul></aside><footer>© 2024 The Daily Holm</footer>', [T, A, B, C]),
    (f'<body id="home" class="single"><div id="wrap"><div id="topbar"><ul>{LINKS}</ul></div><div id="primary"><div class="hentry"><h2>{T}</h2><div class="txt"><p>{A}</p><p>{B}</p><p>{D}</p></div></div><div id="respond"><h3>Comments</h3><ol class="commentlist"><li>Good news at last, and about time too.</li></ol></div></div><div id="secondary"><ul>{LINKS}</ul></div><div id="colophon">Copyright Holm Media, all rights reserved</div></div>', [T, A, B, D]),
    (f'<html><body><table><tr><td colspan=2><a href="/">Index</a> | <a href="/2">Archive</a> | <a href="/3">Mail</a></td></tr><tr><td width=120><a href="/a">Towns</a><br><a href="/b">Roads</a><br><a href="/c">Rivers</a></td><td><font size=5>{T}</font><p>{A}<p>{B}<p>{C}</td></tr></table><center>© 1999 Holm Online</center>', [T, A, B, C]),
    (f'<body><div class="g1"><div class="g2"><a href="/">Start</a><a href="/x">Topics</a><a href="/y">Authors</a></div><div class="g3"><div class="g4">{A}</div><div class="g4">{B}</div><div class="g4">{C}</div><div class="g4">{D}</div></div><div class="g5"><a href="/t">Terms</a> <a href="/p">Privacy</a></div></div>', [A, B, C, D]),
    (f"<h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p><ul>{LINKS}</ul>", [T, A, B, C, D]),
    (f'<body><div class="cookie-banner">We use cookies to improve this site. <button>Accept</button></div><div class="page"><section><h1>{T}</h1><p>{A}</p><p>{B}</p><div class="ad-slot">Buy two pairs of boots and get a third one free!</div><p>{D}</p></section><div class="newsletter"><p>Subscribe to our letter.</p><form><input><button>Send</button></form></div></div><footer><a href="/a">About</a> <a href="/b">Imprint</a></footer>', [T, A, B, D]),
    (f'<div role="navigation"><a href="#">Guide</a> <a href="#">Reference</a></div><div role="main"><h1>Setting up</h1><p>{B}</p><pre>make all; make install</pre><p>{A}</p><ul><li>First check that the tide is low, then cross.</li><li>Keep to the marked path at all times.</li></ul></div><div role="contentinfo">Built with care. © Holm</div>', ["Setting up", B, "make all; make install", A, "First check that the tide is low, then cross.", "Keep to the marked path at all times."]),
]
