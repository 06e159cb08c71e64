"""Hand-labelled layouts: main text stands between [[ and ]]. Most words of the first six stand in `labelled_pages` as well."""

LABELLED = (
    """<html><head><title>Tide tables</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></nav><article>[[<h1>Tide tables for the north shore</h1><p>The spring tide reaches the quay shortly after noon and turns within the hour.</p><p>Small boats should leave the harbour <b>before ten</b>, when the bar is still covered, and not come back until evening.</p><p>Fishing from the pier is allowed<br>at all hours,<br>also<br>at night.</p>]]</article><footer>&copy; Harbour office. All rights reserved.</footer></body></html>""",
    """<html><body><div><a href=1>Front page</a> | <a href=2>Sport</a> | <a href=3>Weather</a> | <a href=4>Culture</a></div><div><a href=5>Log in</a> <a href=6>Register</a></div><div>[[<p>Bread made with a slow dough keeps for a week, and its crust stays firm in a cool room.</p><p>Mix flour, water and salt in the evening; fold it twice, an hour apart, and leave it until morning.</p><ul><li>Bake it hot for the first ten minutes.</li><li>Then let the oven fall to a gentle heat.</li></ul><p>A loaf is done when it sounds hollow.</p>]]</div><div><a href=7>More recipes</a><br><a href=8>Most read</a><br><a href=9>Editor's choice</a></div><div><a href=10>Imprint</a> <a href=11>Privacy</a></div></body></html>""",
    """<html><body><table><tr><td><a href=a>Index</a></td><td><a href=b>Up</a></td><td><a href=c>Next</a></td></tr></table><h2>[[On the grinding of lenses</h2><p>A lens is ground with sand of three degrees, the coarsest first, and polished with rouge upon pitch.</p><p>The tool must be wetted often, or it scratches; see <a href=d>the plate</a> for how it is held.</p><blockquote>He who hurries the last stage<br>begins again from the first.</blockquote><p>In damp weather the pitch grows too hard and wants warming.</p>]]<hr><table><tr><td><a href=e>Previous</a></td><td><a href=f>Contents</a></td></tr></table><ul><li><a href=g>About</a></li><li><a href=h>Terms</a></li></ul></body></html>""",
    """<html><body><div><ul><li><a href=1>Shop</a></li><li><a href=2>Basket</a></li><li><a href=3>Help</a></li></ul></div><div><span>Monday</span><span>12 degrees</span></div><main>[[<h1>Why the bridge was moved</h1><div>When the river shifted its bed the old bridge stood in a meadow, useful to cows alone.</div><div>The parish took it down stone by stone, numbered each, and set it up again half a mile to the east, where it stands now.</div><p>Two stones are missing. Nobody has said who has them.</p>]]</main><div><ul><li><a href=4>Newer</a></li><li><a href=5>Older</a></li></ul></div><div><span>Tags</span> <a href=6>river</a> <a href=7>stone</a></div></body></html>""",
    """<html><body><div><a href=1>Start</a> | <a href=2>Shop</a> | <a href=3>Account</a></div><div>[[<h1>Which woods to burn</h1><p>Dry wood burns hot and leaves little ash; wet wood smokes, and tars the flue within a winter.</p><table><tr><th>Wood</th><th>Weight</th><th>Years</th></tr><tr><td>Oak</td><td>720</td><td>2</td></tr><tr><td>Ash</td><td>690</td><td>1</td></tr><tr><td>Birch</td><td>650</td><td>1</td></tr><tr><td>Pine</td><td>510</td><td>1</td></tr><tr><td>Beech</td><td>710</td><td>2</td></tr></table><p>Weights are those of a stacked metre, see <a href=4>the method</a> and <a href=5>the earlier count</a>, after the years given.</p><dl><dt>Seasoned</dt><dd>Dried under a roof, open to the wind.</dd><dt>Green</dt><dd>Felled this year.</dd></dl><p>Store it off the ground.</p>]]</div><div><a href=6>Next page</a> <a href=7>Imprint</a></div></body></html>""",
    """<html><body><ul><li><a href=1>Home</a></li><li><a href=2>Archive</a></li></ul><main>[[<h1>Sources on the old canal</h1><p>The <a href=3>first survey</a> and the <a href=4>toll books</a> disagree about the length of the upper reach by a quarter of a mile.</p><ol><li>Survey of the upper reach, with <a href=5>plates</a>, printed for the company.</li><li>Toll books of the lower lock, <a href=6>second volume</a>, in the county archive.</li></ol><p>Both are kept in the county town.</p>]]</main><div><a href=7>Older posts</a> <a href=8>Privacy</a></div></body></html>""",
    """<html><body><div><a href=/>Home</a> | <a href=/b>Blog</a> | <a href=/c>Contact</a></div><div><div><h1>[[How the mill was saved</h1></div><div>For forty years nobody had turned the wheel, and the race was dry from May until the autumn rains.</div><div>Then the school bought it for one crown, and the pupils dug the channel out again by hand.</div><div>It grinds rye on Saturdays.]]</div></div><div>Subscribe to our newsletter today</div><div>Copyright 2020 Mill Society</div><div>This page uses cookies</div></body></html>""",
    """<html><body><header><div class="logo">The Evening Mail</div></header><article><header>[[<h1>Ferry runs aground</h1><p class="byline">By our own reporter in the harbour</p></header><p>The evening ferry ran onto the northern bar in thick fog, and was pulled free with the next tide.</p>]]<div class="share-bar"><a href=1>Share</a> <a href=2>Print</a></div>[[<p class="share-price">Shares in the line fell by a tenth before noon.</p><p>Nobody was hurt.</p>]]<footer>Filed under: shipping</footer></article><div class="related-stories">More about ferries and fog</div></body></html>""",
    """<html><body class="has-sidebar"><div id="sidebar"><h4>Archive</h4><ul><li><a href=1>June</a></li><li><a href=2>July</a></li></ul><p>Written at the kitchen table by a retired pilot.</p></div><div id="content"><div class="post">[[<h2>Landing on grass</h2><p>A grass strip is softer than it looks and shorter than the map says, so come in slowly and look twice.</p><p>Cows have the right of way.</p>]]</div><div id="comments"><p>I once landed there in a storm and would not do it again.</p></div></div></body></html>""",
    """<html><body><nav class="main-menu"><a href=1>Tests</a><a href=2>Prices</a></nav><main>[[<h1>Three kettles compared</h1><p>We boiled a litre in each of them twenty times, and wrote down the minutes and the noise.</p><table><tr><th>Kettle</th><th>Minutes</th></tr><tr><td>Steel</td><td>4</td></tr><tr><td>Glass</td><td>5</td></tr></table>]]<aside class="ad-slot">Our partner sells kettles too</aside>[[<p>The steel one wins, though it whistles.</p>]]</main><div class="cookie-banner"><p>We value your privacy and store only what we must.</p></div></body></html>""",
    """<html><body><div class="wrapper nav-left footer-dark"><div>[[<p>Salt was once carried over this pass on the backs of men, forty pounds to each, in two days and a night.</p><p>The hut at the top kept a fire for them, and a bell that was rung in snow.</p><p>Both are still there.</p>]]</div></div><div class="footer">Alpine club, section east</div></body></html>""",
    """<html><body><ul class="breadcrumbs"><li><a href=/>Start</a></li><li>Letters</li></ul><section>[[<h3>To the editor</h3><p>Your map of the old canal leaves out the second lock, which my father kept for thirty years.</p><blockquote>It stood where the petrol station is now.</blockquote><p>Please put it back.</p>]]</section><div class="pagination"><a href=2>Next letter</a></div><form>Write to us <input></form></body></html>""",
    """<html><body><div><div><div>[[<p>Plain pages still exist: one column of words, written by somebody who had something to say and no time for ornament.</p>One more thought stands here without any element around it, as such pages do it, and goes on for a while.<br><br>And another after two breaks.]]</div></div></div><hr><div><a href=mail>Mail me</a></div></body></html>""",
)
