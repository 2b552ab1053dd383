"""Labelled pages from which the block classifier of ``html_text`` is fitted: invented pages of common layouts, labelled by hand.

A block that is main text starts with ``MARK``. All other blocks are boilerplate.
"""

from __future__ import annotations

MARK = "+"

PAGES = (
    # A news page with landmarks.
    """<body><header><div class="logo">The Morning Post</div><nav><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<main><article><h1>+Bridge reopens after two years</h1><p>+The bridge over the river was opened again on Monday, two years after a flood had carried part of it away.</p><p>+Hundreds came.</p>
<p>+"We have waited long for this day," said the mayor, who was the first to walk across.</p><div class="ad"><p>Fly to the islands from 49 a head. Book now.</p></div><h2>+What comes next</h2>
<p>+A second lane is planned for the spring, when the ground has dried and the new beams have been delivered.</p><ul><li>+Work starts in March.</li><li>+It ends in June, if the weather holds.</li></ul></article></main>
<aside><h3>Most read</h3><ul><li><a href="/1">Storm on the coast</a></li><li><a href="/2">Ten recipes for autumn</a></li></ul></aside><footer><p>Copyright 2021 The Morning Post. All rights reserved.</p><a href="/p">Privacy policy</a></footer></body>""",
    # A journal of plain div elements, told by classes.
    """<div id="page"><div class="site-header"><a href="/">A gardener's journal</a><p class="tagline">Notes from a small plot by the sea.</p></div><div id="content"><div class="post"><h2>+Sowing beans</h2><p>+Beans like warm ground, so I wait until the middle of May before I put them out.</p>
<p>+Not earlier.</p><p>+Last year I lost a whole row to a late frost, and had to start again with seeds from my neighbour.</p><p>+This is what I do now:</p><ol><li>+soak the seeds for a night</li><li>+dig a row as deep as a finger</li><li>+water it well before sowing</li></ol></div>
<div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div><div id="comments"><h3>Comments</h3><div class="comment"><p>Thank you for this, I will try it with my own beans next year and tell you how it went.</p></div><div class="comment"><p>Same here!</p></div></div></div>
<div id="sidebar"><h4>Archive</h4><a href="/5">May</a> <a href="/6">June</a><p>I live by the sea and write about plants. Subscribe to hear of new posts.</p></div><div id="footer">Powered by a small machine in my kitchen.</div></div>""",
    # Nothing but tables, as old pages have it.
    """<table><tr><td><a href="a.htm">Start</a><br><a href="b.htm">Pictures</a><br><a href="c.htm">Guest book</a></td><td><h1>+The history of our mill</h1><p>+The mill was built in 1742 by two brothers who had come down from the hills to try their luck with wool.</p>
<p>+It burned twice.</p><p>+After the second fire the town bought the ground, and for forty years nothing stood there but a wall and a few trees, until the railway came and with it new owners.</p></td></tr><tr><td>Last changed on 3 March 1999</td></tr></table>""",
    # No class, no landmark.
    """<div><a href="/">Front</a> <a href="/about">About us</a> <a href="/contact">Contact</a></div><div><h1>+How glass is made</h1><p>+Sand, soda and lime are melted together at more than a thousand degrees, and the melt is drawn, blown or poured while it is still soft.</p><p>+Why lime?</p><p>+Without it the glass would dissolve in water, slowly but surely, as the glass of some old windows has done.</p>
<p>+Colours come from metals, a pinch of which is enough for a whole pot of melt.</p></div><div><a href="/next">Next: How paper is made</a></div><div>2014 Works and Crafts, 12 Mill Lane</div>""",
    # An article with its own header and footer, and a notice.
    """<div class="cookie-banner" role="dialog"><p>We use cookies to make this site work better for you. By going on you agree to that.</p><button>Accept</button></div><div class="wrapper has-sidebar"><article><header class="entry-header"><h1>+A walk along the wall</h1></header><div class="entry-content"><p>+The wall runs for eighty miles from one sea to the other, over crags and through fields of sheep.</p>
<figure><img src="w.jpg"><figcaption>+The wall in winter.</figcaption></figure><blockquote>+Nobody had told us about the wind.</blockquote><p>+We started in the east, since the guide says that the light is better in that direction, and were wet to the skin after an hour.</p></div><section class="related-posts"><h3>You may also like</h3><a href="/x">Five days on the canal</a></section></article>
<div class="newsletter"><form><label>Your address</label><input><p>One letter a month, no more. You can leave the list whenever you like.</p></form></div></div><div class="site-footer"><ul><li><a href="/t">Terms of use</a></li><li><a href="/i">Imprint</a></li></ul></div>""",
    # A page of documentation.
    """<div class="topbar"><a href="/">Docs</a><a href="/api">Reference</a></div><div class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li></ul></div><div class="body" role="main"><h1>+Configure the server</h1><p>+The server reads its settings from a file when it starts. Changes take effect after a restart.</p><pre>+port = 8080</pre><p>+Ports below 1024 need more rights.</p><h3>+Logging</h3><dl><dt>+level</dt><dd>+How much is written. The default is to write warnings and errors only.</dd></dl>
<table><tr><th>+Name</th><th>+Meaning</th></tr><tr><td>+quiet</td><td>+nothing is written</td></tr></table></div><div class="pager"><a href="/p">Previous: Install</a><a href="/n">Next: Update</a></div><div class="feedback">Was this page helpful? Tell us what is missing.</div>""",
    # A long thread of readers below a short text.
    """<nav class="breadcrumbs"><a href="/">Home</a> / <a href="/film">Film</a></nav><section class="story"><h1>+A film without words</h1><p>+For ninety minutes nobody speaks, and yet there is more to hear in this film than in most others of the year.</p><p>+See it on a large screen.</p></section><section class="discussion"><p>12 comments</p><article class="comment"><p>I saw it twice and found something new each time, above all in the scenes by the harbour.</p></article><article class="comment"><p>It was far too long for me, and I left before the end of it.</p></article><article class="comment"><p>Where can it be seen in the north?</p></article><a href="/login">Log in to reply</a></section>""",
    # A shop's advice page, full of adverts.
    """<div class="promo">Free delivery this week on all orders above 30. Do not miss it.</div><div class="main-content"><h1>+How to choose a bicycle</h1><div class="ad-slot">Sponsored: the best lights of the year at half the price, for three days only.</div><p>+The size of the frame matters more than anything else, and no saddle makes up for a frame that is too large.</p><p>+Stand over it.</p><div class="widget"><h4>Popular products</h4><a href="/1">City bike</a> 499</div><p>+If there is a hand's width between you and the frame, it fits.</p><p>+For long tours a steel frame is heavier, but it can be mended by any smith on the way.</p></div><div class="popup"><p>Ten percent off your first order if you sign up today with your address.</p></div><div>Tel. 555 0101</div>""",
    # A text whose container has words that elsewhere mark what is around a text.
    """<div class="menu"><a href="/">Start</a><a href="/all">All stories</a></div><div class="popular-science"><h1>+Why the sky is blue</h1><p>+Light from the sun holds all colours, and the air scatters the blue part of it more than the red part.</p><p>+At dusk it is the other way round, as the light has to come a longer way through the air and little blue is left of it.</p><p>+So the sky turns red.</p></div><div class="legal">No part of this may be copied without leave.</div>""",
    # Short lines: a poem.
    """<ul class="nav"><li><a href="/a">Poems</a></li><li><a href="/b">Poets</a></li></ul><div class="text"><h2>+The harbour</h2><p>+The boats are in,</p><p>+the nets are dry,</p><p>+a lamp is lit</p><p>+and none know why.</p></div><div class="meta">Posted by M. on 4 May</div><div class="tagcloud"><a href="/s">sea</a> <a href="/h">home</a></div>""",
    # A recipe.
    """<div id="masthead"><a href="/">Kitchen</a><form role="search"><input>Search</form></div><div id="main"><h1>+Onion soup</h1><p>+A soup for cold days, made in less than an hour from what is in the house.</p><h2>+What you need</h2><ul><li>+6 onions</li><li>+butter</li><li>+a litre of broth</li><li>+old bread</li></ul><h2>+How it is done</h2><p>+Cut the onions into rings and let them turn brown in the butter. This takes time and cannot be hurried.</p><p>+Add the broth.</p></div><div class="sidebar"><h3>Seasonal</h3><ul><li><a href="/p">Pumpkin pie</a></li><li><a href="/k">Kale stew</a></li></ul><p>Our new book is out now. Order it here and have it signed by the cook.</p></div>""",
    # Links inside a text, and a licence line that belongs to it.
    """<header><h2>Free library</h2></header><div class="article-body"><p>+The <a href="/l">lighthouse</a> was the work of <a href="/e">an engineer</a> who had never seen the <a href="/s">sea</a> before he was thirty.</p><p>+See also <a href="/r">the report of 1851</a>.</p><p>+This text may be used by all under a free licence.</p></div><footer><p>&copy; 2019 Free library. Pages are checked by readers, and errors can be sent to the office.</p></footer>""",
    # Short adverts and footers of words without a sentence's form, around an article.
    """<nav><ul><li><a href="/one">one</a></li><li><a href="/two">two</a></li><li><a href="/three">three</a></li></ul></nav><div class="ad">Cheap shoes and boots for all.</div><article><h1>+Letters from the north</h1><p>+<b>It had snowed all night and the road was gone.</b></p><p>+We waited for the plough. It came at noon and we drove behind it until the pass, where the sun was out and the snow had begun to melt.</p><p>+Then home</p></article><div class="ad">A house by the lake is for sale. See it this week and make an offer by Friday.</div><footer>&copy; example.com &middot; We write about the north and what grows there.</footer>""",
    # Paragraphs without a full stop, and notices with one.
    """<div><p>Welcome back!</p><p>You are not logged in.</p></div><div><h2>+Minutes of the meeting in May</h2><p>+present were the chair, both secretaries and eleven members, two of them by telephone from the coast where they had been held up by the storm</p><p>+accounts read and found in order</p><p>+the roof is to be mended before winter, for which the chair will ask three firms for an offer and bring them to the next meeting</p></div><div><p>Page 1 of 3.</p><p>Made by hand in 2009.</p></div>""",
    # A diary: undivided text between breaks, and a column of links with words around them.
    """<div class="box">Search this site:</div><div class="day"><h3>+Tuesday</h3>+Rain again, and nothing to do but to read and to mend the nets, which we did until four in the afternoon when the light went<br><p>+Later it cleared</p><p>+From the hill we saw the ferry come in two hours late with all her lamps on</p></div><div class="box"><p>More days: <a href="/m">Monday</a>, <a href="/s">Sunday</a>.</p><p>Write to me!</p></div>""",
    # A page in another language, and one without spaces.
    """<div id="kopf"><a href="/">Startseite</a> <a href="/k">Kontakt</a></div><div id="inhalt"><h1>+Das alte Rathaus</h1><p>+Das Rathaus wurde im Jahr 1604 gebaut und steht noch heute, obwohl der Fluss schon dreimal bis zur Treppe kam.</p><p>+Der Turm ist jünger.</p><p>+Wer hinauf will, fragt im Laden gegenüber nach dem Schlüssel.</p></div><div id="fuss">Stand: Mai 2012</div>""",
    """<div><a href="/">首页</a><a href="/n">新闻</a></div><div><h1>+古桥的历史</h1><p>+这座桥建于明代，距今已有六百多年的历史，至今仍有许多游客前来参观，在桥上可以看到整条河流和两岸的老房子。</p><p>+每年春天，当地人都会在桥边举行庙会。</p></div><div>联系我们</div>""",
)
