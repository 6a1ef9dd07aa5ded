"""Pages written and labelled by hand in the styles of different kinds of sites: the HTML, and the blocks of its main text."""

PAGES = [
    (  # a news site without semantic elements
        """<html><body><div id="masthead"><a href="/">The Daily Courier</a></div><table class="navtable"><tr><td><a href="/w">World</a></td><td><a href="/s">Sport</a></td><td><a href="/m">Money</a></td></tr></table>
        <div class="story-body"><h1>Bridge reopens after two years of repairs</h1><div class="byline">By Maria Holt</div><p>The old iron bridge over the Tame opened to traffic on Monday morning, two years after cracks were found in its northern pier.</p>
        <p>Engineers replaced forty metres of deck and strengthened the foundations with concrete, the council said in a statement on its web site.</p><div class="advertisement">Buy one mattress, get one free this weekend only</div><p>Shops along the quay hope that visitors will now return.</p></div>
        <div class="rightcol"><h3>Most read</h3><ul><li><a href="/1">Ten things to do in June</a></li><li><a href="/2">Why the river turned green</a></li></ul></div><div id="footer">Copyright Daily Courier. <a href="/t">Terms</a> <a href="/p">Privacy</a></div></body></html>""",
        ["Bridge reopens after two years of repairs", "By Maria Holt", "The old iron bridge over the Tame opened to traffic on Monday morning, two years after cracks were found in its northern pier.", "Engineers replaced forty metres of deck and strengthened the foundations with concrete, the council said in a statement on its web site.", "Shops along the quay hope that visitors will now return."],
    ),
    (  # a blog with widgets and reader comments
        """<html><head><title>Baking notes</title></head><body class="single"><header class="site-header"><h2><a href="/">Baking notes</a></h2><nav class="main-navigation"><ul><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li></ul></nav></header>
        <main><article class="post"><header><h1>A slower sourdough</h1></header><div class="entry-content"><p>I have been making the same loaf for a decade, and this winter I decided to let it rest for three days instead of one.</p><h2>What changed</h2><p>The crumb became more open, and the crust took on a deep brown colour that I had never seen in my oven before.</p>
        <ul><li>Mix the flour and the water and leave them alone for an hour.</li><li>Fold the dough every thirty minutes.</li></ul></div><div class="sharedaddy"><ul><li><a href="/f">Share</a></li><li><a href="/t">Tweet</a></li></ul></div></article></main>
        <section id="comments"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><p>Lovely, I tried it on Sunday and my family ate all of it.</p></li><li class="comment"><p>How warm is your kitchen?</p></li></ol><form class="comment-form"><label>Leave a reply</label><textarea></textarea><button>Post</button></form></section>
        <aside class="widget-area"><section class="widget"><h3>Archive</h3><ul><li><a href="/5">May</a></li><li><a href="/4">April</a></li></ul></section></aside><footer class="site-footer"><p>Powered by flour</p></footer></body></html>""",
        ["A slower sourdough", "I have been making the same loaf for a decade, and this winter I decided to let it rest for three days instead of one.", "What changed", "The crumb became more open, and the crust took on a deep brown colour that I had never seen in my oven before.", "Mix the flour and the water and leave them alone for an hour.", "Fold the dough every thirty minutes."],
    ),
    (  # documentation with a menu at the side
        """<html><body><div class="sidebar"><ul><li><a href="a">Install</a></li><li><a href="b">Configure</a></li><li><a href="c">Deploy</a></li></ul></div><div role="main" class="content"><h1>Configure the server</h1><p>The server reads its settings from a file in the home directory of the user that starts it.</p>
        <pre>port = 8080
        workers = 4</pre><p>Values that are not set keep their defaults, which the table below lists with their meaning.</p><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>port</td><td>where to listen</td></tr></table></div><div class="footer"><p>Built from the manual, last updated in May</p></div></body></html>""",
        ["Configure the server", "The server reads its settings from a file in the home directory of the user that starts it.", "port = 8080 workers = 4", "Values that are not set keep their defaults, which the table below lists with their meaning.", "Name", "Meaning", "port", "where to listen"],
    ),
    (  # a notice, a form and an article in plain divs
        """<body><div class="cookie-banner"><p>We use cookies to make this site better. By going on you agree.</p><button>Fine</button></div><div class="topbar"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><div class="article-text"><h1>Minutes of the spring meeting</h1>
        <p>The chair opened the meeting at seven and welcomed four new members of the society.</p><p>The treasurer reported a small surplus, most of which came from the sale of seedlings in April.</p></div><form class="newsletter"><p>Subscribe to our letter</p><input><button>Send</button></form><div class="copyright"><p>All rights reserved by the society since 1987</p></div></body>""",
        ["Minutes of the spring meeting", "The chair opened the meeting at seven and welcomed four new members of the society.", "The treasurer reported a small surplus, most of which came from the sale of seedlings in April."],
    ),
    (  # an encyclopaedia entry
        """<html><body><div id="content"><h1>Common kestrel</h1><div class="notice">This page needs more sources.</div><p>The common kestrel is a bird of prey of the falcon family, widespread in Europe, Asia and Africa.</p><h2>Description</h2><p>Kestrels measure about thirty-four centimetres from head to tail and hover in the air while they look for voles.</p>
        <blockquote><p>I caught this morning morning's minion.</p></blockquote><h2>Diet</h2><p>They eat almost exclusively mouse-sized mammals, but also insects and small birds.</p></div><div id="navigation"><h3>Tools</h3><ul><li><a href="x">What links here</a></li><li><a href="y">Cite this page</a></li></ul></div><div id="footer"><ul><li>Text is available under a free licence</li></ul></div></body></html>""",
        ["Common kestrel", "The common kestrel is a bird of prey of the falcon family, widespread in Europe, Asia and Africa.", "Description", "Kestrels measure about thirty-four centimetres from head to tail and hover in the air while they look for voles.", "I caught this morning morning's minion.", "Diet", "They eat almost exclusively mouse-sized mammals, but also insects and small birds."],
    ),
    (  # a product review with related links inside the article
        """<html><body><nav><a href="/">Home</a> <a href="/r">Reviews</a></nav><article><h1>The new kettle, tested</h1><p>We boiled four hundred litres of water over two weeks to find out whether the price is fair.</p><aside class="related"><h4>Related</h4><ul><li><a href="/k">Best kettles of the year</a></li></ul></aside>
        <p>It is quiet, it pours well, and the lid stays cool, but the cord is too short for most kitchens.</p><figure><img src="k.jpg"><figcaption>The kettle on our test bench</figcaption></figure><p>We would buy it again.</p></article><footer><p>About us, contact, imprint</p></footer></body></html>""",
        ["The new kettle, tested", "We boiled four hundred litres of water over two weeks to find out whether the price is fair.", "It is quiet, it pours well, and the lid stays cool, but the cord is too short for most kitchens.", "The kettle on our test bench", "We would buy it again."],
    ),
    (  # a page of layout tables
        """<html><body><table width="100%"><tr><td class="menu"><a href="1">Start</a><br><a href="2">Contact</a></td><td class="main"><h1>History of the mill</h1><p>The mill was built in 1643 by two brothers from the valley, who ground rye for the villages around.</p><p>It burned twice, and the present wheel dates from the year in which the railway came.</p></td></tr></table><div class="bottom"><p>Made with care by the local history group</p></div></body></html>""",
        ["History of the mill", "The mill was built in 1643 by two brothers from the valley, who ground rye for the villages around.", "It burned twice, and the present wheel dates from the year in which the railway came."],
    ),
    (  # a magazine with a sponsored block and a login form
        """<html><body><header><div class="logo">Harbour</div><form class="login"><label>Name</label><input><button>Log in</button></form></header><main><section class="story"><h1>Letters from the lighthouse</h1><p>For eleven years the keeper wrote one letter a week to a sister whom she never met again.</p><div class="sponsored"><p>This season's raincoats are here. Order by Friday.</p></div><p>The letters were found in a biscuit tin last autumn, and they tell of storms, of bread, and of the patience of gulls.</p></section></main><div class="responses"><div class="comment"><p>Ann</p><p>My grandfather knew her.</p></div></div><footer>Harbour magazine, a quarterly</footer></body></html>""",
        ["Letters from the lighthouse", "For eleven years the keeper wrote one letter a week to a sister whom she never met again.", "The letters were found in a biscuit tin last autumn, and they tell of storms, of bread, and of the patience of gulls."],
    ),
]
