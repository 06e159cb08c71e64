"""Labelled pages for training: parts that are a page's main text and parts that are not, put together by a rule."""

from __future__ import annotations

#: Parts outside the main text.
OUTSIDE = """\
<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></nav>
<header><a href=/>The Harbour Gazette</a> <span>Monday edition</span></header>
<header class="site-header"><h1>Garden notes</h1><p>Everything that grows</p></header>
<footer>&copy; Harbour office. All rights reserved.</footer>
<footer class="site-footer"><p>Published weekly by the parish.</p><a href=i>Imprint</a></footer>
<aside><h3>Most read</h3><ul><li><a href=1>Ferry prices rise</a></li><li><a href=2>The long winter</a></li></ul></aside>
<aside class="sidebar"><p>About the author: she has kept bees for many years.</p></aside>
<div class="sidebar"><h4>Archive</h4><a href=a>March</a> <a href=b>April</a></div>
<div class="ad">Buy two lamps and get the third for half the price</div>
<div class="ads"><a href=x>New kitchens from the maker</a></div>
<div class="advert">Winter tyres, fitted while you wait</div>
<div class="advertisement"><p>Advertisement</p><p>Holidays by the lake at early prices</p></div>
<div id="advertising">Your notice could stand here</div>
<div class="sponsored promoted">Presented by the savings bank: loans for builders</div>
<section class="promo"><h2>Our offer</h2><p>Read four weeks for nothing and end whenever you like.</p></section>
<div class="banner">Summer sale begins on Friday</div>
<div id="cookie-consent"><p>This site uses cookies. By reading on you agree to their use.</p><button>Accept</button></div>
<div class="cookie-notice gdpr">We store small files on your computer to count visits.</div>
<p class="cookies notice">Cookies help us to run this page.</p>
<div class="newsletter signup">Get the best stories by mail every week <form><input name=m><button>Send</button></form></div>
<div class="newsletter-box">Our letter comes out on Sundays. Sign up today.</div>
<div class="subscribe">Subscribe now and read everything</div>
<div class="social"><a href=f>Follow</a> <a href=t>Tweet</a></div>
<div class="share">Pass it on <a href=s>by mail</a></div>
<div class="share-links">Share <a href=1>here</a> <a href=2>there</a></div>
<ul class="share"><li><a href=s>Share this page</a></li><li>Send by mail</li></ul>
<div class="sharing-buttons social">Share: mail, print, copy the address</div>
<ol class="breadcrumb"><li><a href=/>Start</a></li><li>Nature</li></ol>
<div class="breadcrumbs">You are here: Start / Garden / Trees</div>
<div class="pagination"><a href=1>1</a> <a href=2>2</a> <a href=3>3</a></div>
<div class="pager">Page 2 of 7</div>
<div class="related"><h3>Related stories</h3><article><a href=1>When the river froze</a></article><article><a href=2>The last miller</a></article></div>
<section class="recommended"><p>You might like these as well</p><a href=r>The quiet valley</a></section>
<section id="comments"><h3>Comments</h3><p>A fine piece, I remember that winter well and the frost on the panes.</p><p>You forgot the eastern gate, which was torn down later.</p></section>
<div class="comment-list comments"><div class="comment"><b>Tom</b> I can't agree with the second half of it at all.</div></div>
<article class="comment"><p>My grandfather told it otherwise, and he was there.</p></article>
<div class="replies"><div class="reply comment">Thank you, that was just what I was looking for.</div></div>
<div id="disqus_thread" class="disqus comments">Join the talk below</div>
<div class="login">Sign in <a href=l>Forgotten your word?</a></div>
<div class="search"><form><input name=q></form>Find in all pages</div>
<div class="toolbar">Larger text, smaller text, print</div>
<div class="widget"><h4>Weather</h4><p>Twelve degrees and rain</p></div>
<div class="menu"><a href=1>Shop</a> <a href=2>Basket</a> <a href=3>Help</a></div>
<div class="topbar masthead">The Valley Post since 1871</div>
<ul class="navigation navbar"><li><a href=1>Sport</a></li><li><a href=2>Culture</a></li></ul>
<div id="nav"><a href=1>Index</a> <a href=2>Up</a> <a href=3>Next</a></div>
<div id="header">Letters and papers</div>
<div id="footer">Printed in the old mill. <a href=p>Privacy</a></div>
<div class="copyright">Copyright 2014 the publishers</div>
<p class="copyright">All pictures belong to their makers.</p>
<p class="disclaimer">No advice on this page is binding, and prices may have changed since.</p>
<div class="alert notification">Trains are late today because of a fallen tree.</div>
<div class="notice">The reading room is closed on Thursday.</div>
<div class="modal popup">Before you leave: a gift for you</div>
<div role="dialog" class="popup">Tell us what you think of this page</div>
<div role="banner">County library</div>
<div role="navigation"><a href=1>Catalogue</a> <a href=2>Hours</a></div>
<div><a href=1>Front page</a> | <a href=2>Sport</a> | <a href=3>Weather</a> | <a href=4>Culture</a></div>
<div><a href=5>Log in</a> <a href=6>Register</a></div>
<table><tr><td><a href=a>Index</a></td><td><a href=b>Up</a></td><td><a href=c>Next</a></td></tr></table>
<div><a href=7>More recipes</a><br><a href=8>Most read</a><br><a href=9>Editor's choice</a></div>
<div><span>Monday</span><span>12 degrees</span></div>
<div>Subscribe to our newsletter</div>
<div>Copyright 2019 Valley Press</div>
<div>We use cookies on this site</div>
<p>Follow us</p>
<div><div>Share</div><div>Print</div><div>Save</div></div>
<ul><li><a href=4>Newer</a></li><li><a href=5>Older</a></li></ul>
<div><span>Tags</span> <a href=6>river</a> <a href=7>stone</a></div>
""".splitlines()

#: Parts of main texts. The first six begin one; a header is part of it inside an article only.
INSIDE = """\
<h1>Tide tables for the north shore</h1><p>The spring tide reaches the quay shortly after noon and turns within the hour.</p>
<header><h1>Why the bridge was moved</h1><p>When the river shifted its bed the old bridge stood in a meadow, useful to cows alone.</p></header>
<p>Bread made with a slow dough keeps for a week, and its crust stays firm in a cool room.</p>
<h2>On the grinding of lenses</h2><p>A lens is ground with sand of three degrees, the coarsest first, and polished with rouge upon pitch.</p>
<header class="entry-header"><h1 class="entry-title">Which woods to burn</h1></header><p>Dry wood burns hot and leaves little ash; wet wood smokes, and tars the flue within a winter.</p>
<div>Sources on the old canal disagree about the length of the upper reach by a quarter of a mile.</div>
<p>Small boats should leave the harbour <b>before ten</b>, when the bar is still covered, and not come back until evening.</p>
<p>Fishing from the pier is allowed<br>at all hours,<br>also<br>at night.</p>
<p>Mix flour, water and salt in the evening; fold it twice, an hour apart, and leave it until morning.</p>
<ul><li>Bake it hot for the first ten minutes.</li><li>Then let the oven fall to a gentle heat.</li></ul>
<p>The tool must be wetted often, or it scratches; see <a href=d>the plate</a> for how it is held.</p>
<blockquote>He who hurries the last stage<br>begins again from the first.</blockquote>
<div>The parish took it down stone by stone, numbered each, and set it up again half a mile to the east, where it stands now.</div>
<p>Two stones are missing. Nobody has said who has them.</p>
<table><tr><th>Wood</th><th>Weight</th><th>Years</th></tr><tr><td>Oak</td><td>720</td><td>2</td></tr><tr><td>Ash</td><td>690</td><td>1</td></tr></table>
<table><caption>Hours of light</caption><tr><td>March</td><td>11</td><td>55</td></tr><tr><td>April</td><td>13</td><td>48</td></tr><tr><td>May</td><td>15</td><td>22</td></tr><tr><td>June</td><td>16</td><td>19</td></tr><tr><td>July</td><td>15</td><td>51</td></tr></table>
<table><tr><th>Reach</th><td>From the weir to the second lock</td></tr><tr><th>Depth</th><td>Four feet in a dry year</td></tr></table>
<p>Weights are those of a stacked metre, see <a href=4>the method</a> and <a href=5>the earlier count</a>, after the years given.</p>
<dl><dt>Seasoned</dt><dd>Dried under a roof, open to the wind.</dd><dt>Green</dt><dd>Felled this year.</dd></dl>
<p class="share-price">The share closed a little lower, at nine marks, after the board had spoken of a poor summer.</p>
<p class="lead">Nobody had thought that the ice would carry a loaded cart, and in the end it did not.</p>
<section><h3>How it is stored</h3><p>Store it off the ground, under a roof, with the bark upwards and a hand's breadth between the rows.</p></section>
<ol><li>Survey of the upper reach, with <a href=5>plates</a>, printed for the company.</li><li>Toll books of the lower lock, <a href=6>second volume</a>, in the county archive.</li></ol>
<figure><img src=f.png><figcaption>The lock in the year of the flood, seen from the mill.</figcaption></figure>
<pre>cut at two hands, split at four,
stack by the month</pre>
<p>In damp weather the pitch grows too hard and wants warming before the glass is laid on it again.</p>
<div class="text"><p>What remains is a wall of six courses, and the socket in which the beam of the gate once turned.</p></div>
<p id="alert-system">A bell on the eastern tower warned the lower town, and a lantern by night; both were kept by the miller.</p>
<h4>What it weighs</h4><p>Seven hundredweight when wet, and a little under five after two summers in the shed.</p>
<h3>After the flood</h3><p>The lower town was built again on piles, two streets further up, and the old quay was left to the herons.</p>
""".splitlines()

#: What stands around a main text: before it, and after it.
AROUND = (
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<div>", "</div>"),
    ('<div class="content">', "</div>"),
    ('<div id="page" class="with-sidebar"><article>', "</article></div>"),
    ("", ""),
    ('<div class="layout has-banner"><main><div class="post">', "</div></main></div>"),
    ('<div class="menu-open sticky-header"><div class="topbar-fixed"><article class="post">', "</article></div></div>"),
    ('<div id="main" class="widget-area no-ads toolbar-hidden"><article>', "</article></div>"),
    ('<section class="body footer-below nav-left">', "</section>"),
)


def labelled_pages(pages: int = 60) -> list[str]:
    """Pages in which [[ and ]] stand around each stretch of main text; their parts differ from page to page by a rule."""
    out, rest = [], INSIDE[6:]
    for k in range(pages):
        before, after = AROUND[k % len(AROUND)]
        outside = [OUTSIDE[(7 * k + 11 * i) % len(OUTSIDE)] for i in range(5)]
        first = INSIDE[k % 6]
        if first.startswith("<header") and "<article" not in before:
            first = first.replace("<header>", "").replace('<header class="entry-header">', "").replace("</header>", "")
        inside = [first, *(rest[(5 * k + 4 * i) % len(rest)] for i in range(3 + k % 5)), rest[2 * (k % 2)]]
        middle = OUTSIDE[(3 * k + 5) % len(OUTSIDE)]
        if k % 3 == 0 and "=" in middle.partition(">")[0]:
            inside.insert(2, f"]]{middle}[[")
        text = f"[[{before}{''.join(inside)}{after}]]"
        out.append(f"<html><head><title>A page</title></head><body>{outside[0]}{outside[1]}{text}{''.join(outside[2:])}</body></html>")
    return out
