"""Hand-labelled web pages of layouts that the trainer's generator doesn't put together: blocks of the article begin with "!"."""

PAGES = {
    "entry-content": '<html><body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><article><header><h1>!Storm closes the harbour</h1><p class=byline>!By Anna Reed</p></header><div class="entry-content"><p>!The harbour was closed on Tuesday after a storm, the port said. Ships waited outside for hours.</p><p>!Fishermen spent the day mending nets and hoped for calmer weather by the weekend.</p></div></article><footer><p>© 2021 Harbour Post. All rights reserved.</p></footer></body></html>',
    "wiki": '<html><body><div id="mw-head"><ul><li><a href=/m>Main page</a></li><li><a href=/r>Random</a></li></ul></div><div class="mw-body" id="content"><h1 id="firstHeading">!Heather</h1><div class="mw-parser-output"><p>!Heather is a low shrub that grows on acid soils in open places. It flowers late in summer.</p><h2>!Uses</h2><p>!Brooms were made of it, and bees gather its nectar, which gives a dark honey.</p><ul><li>!Thatching of roofs in the north.</li><li>!Dyeing of wool.</li></ul></div></div><div id="footer">© contributors of the project.</div></body></html>',
    "hentry": '<body><div class="site"><div class="navigation"><a href="/">Home</a> <a href="/blog">Blog</a> <a href="/me">Me</a></div><div class="hentry"><h2 class="entry-title"><a href="/p">!Baking rye bread at home</a></h2><div class="entry-content"><p>!I have baked bread for years, and rye took me the longest to learn.</p><p>!The dough is sticky, so wet your hands before you shape it. Let it rise overnight.</p></div></div></div><div>© 2018 The Baker</div></body>',
    "divs": '<body><div><a href=1>News</a> | <a href=2>Sports</a> | <a href=3>Weather</a></div><div><h1>!Council votes on the bridge</h1><div>!The town council voted on Monday to repair the old bridge, which has been closed since spring.</div><div>!Work is to begin in May and will take four months, the mayor said after the meeting.</div></div><div>© 2020 The Town Times</div></body>',
    "main-div-div": '<body><header><a href="/">Logo</a></header><main><div><div><h1>!A walk along the coast</h1><p>!We started early, when the fog still lay over the fields and the road was empty.</p><p>!By noon the sun was out. We had lunch on the rocks and watched the gulls.</p><p>!It was dark when we came home.</p></div></div></main><aside><h3>Most read</h3><ul><li><a href=a>Ten hills</a></li><li><a href=b>Five lakes</a></li></ul></aside><footer>© walkers</footer></body>',
    "css-modules": '<body><div class="_3xK9"><nav class="_aB12"><ul><li><a href=/>Start</a></li><li><a href=/x>Tech</a></li><li><a href=/y>Life</a></li></ul></nav></div><div class="_9Zq1"><section class="_pp0"><h1 class="_t1">!Why old phones last longer</h1><p class="_p">!Batteries that can be changed keep a phone alive for years. New models glue them in.</p><p class="_p">!Repair shops say that most broken phones need a battery, a screen, or a plug.</p></section></div><footer class="_f"><a href=/i>Imprint</a> <a href=/p>Privacy</a></footer></body>',
    "aside-in-article": "<body><nav><a href=1>One</a> <a href=2>Two</a></nav><article><h1>!Rain at last</h1><p>!After nine dry weeks rain fell on the valley, and farmers stood in the fields to feel it.</p><aside><p>Subscribe to our newsletter</p></aside><p>!The river rose by a hand's breadth overnight, the water office reported.</p></article><footer>© valley news</footer></body>",
    "section-list": '<body><header><nav><ul><li><a href=/>Home</a></li><li><a href=/c>Courses</a></li></ul></nav></header><main><article class="lesson"><header><h1>!How to tie a bowline</h1></header><section><p>!The bowline makes a loop that holds under load and is easy to undo.</p><ol><li>!Make a small loop in the rope.</li><li>!Bring the end up through the loop.</li><li>!Pass it round behind the rope and back down.</li></ol></section><footer><a href=t>knots</a>, <a href=u>ropes</a></footer></article></main><footer><p>© Sailing school</p></footer></body>',
    "german-blog": '<body><div id="kopf"><ul><li><a href="/">Startseite</a></li><li><a href="/ueber">Über mich</a></li></ul></div><div id="inhalt"><div class="beitrag"><h1>!Ein Garten im Winter</h1><p>!Im Winter ruht der Garten, doch zu tun gibt es genug. Werkzeug will gepflegt sein.</p><p>!Ich schneide die Obstbäume an frostfreien Tagen, am liebsten im Februar.</p></div></div><div id="fuss">© 2017 Mein Garten</div></body>',
    "story-divs": '<body><nav><ul><li><a href=/>Front</a><li><a href=/w>World</a></ul></nav><div class="story-wrap"><div class="story-head"><h1>!Museum buys a lost painting</h1><div class="meta">!Maria Lind, 4 May</div></div><div class="story-text"><p>!The painting had hung in a farmhouse kitchen for sixty years before anyone looked at it twice.</p><blockquote><p>!We knew at once, said the curator.</p></blockquote><p>!It will be shown from June on.</p></div></div><footer><p>About us</p><p>© The Front</p></footer></body>',
    "table-menu": '<body><table><tr><td><a href=1>Index</a></td><td><a href=2>Archive</a></td><td><a href=3>Mail</a></td></tr></table><h1>!Notes on beekeeping</h1><p>!Keep the hive dry and out of the wind. Bees mind damp more than cold.</p><p>!In spring look for brood in the middle combs, and leave them food until the fruit trees bloom.</p><p>© 1999 K. Moor</p></body>',
    "cookie-news": '<body><div class="cookie-consent"><p>We use cookies to improve this site.</p></div><nav><ul><li><a href=/>Home</a></li></ul></nav><main id="page"><article class="c-article"><h1>!Trains run late again</h1><div class="c-article__body"><p>!Commuters waited up to an hour on Thursday morning as a signal failed near the river.</p><p>!The railway has promised to replace the signals by autumn.</p></div></article></main><section class="comments"><h3>Comments</h3><div class="comment"><p>I was late for work because of this.</p></div></section><footer>© Rail Times</footer></body>',
}
