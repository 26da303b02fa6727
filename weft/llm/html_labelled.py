"""The labelled table of html_extract: small pages written for training, and pages made by
rule. Elements with data-keep hold article text, but for elements with data-drop inside
them; all other text is to be left out."""

from __future__ import annotations

import numpy as np

#: Pages made by rule: how many, and the seed of their numbers.
MADE_PAGES, SEED = 400, 5

LABELLED_PAGES = [
    """<html><head><title>Rivers</title><style>p{color:red}</style></head><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav>
    <article data-keep><h1>How rivers move</h1><p>A river carries sand and gravel from the hills to the plain, and drops it where the water slows.</p>
    <p>Over many years the bends wander across the valley.</p><p>Floods cut new ways.</p></article>
    <footer>Copyright 2019 The River Pages. All rights reserved.</footer></body></html>""",
    """<body><header><a href=/>The Daily Loaf</a><p>Bread news since 1990</p></header><div class="ad"><p>Buy our new oven now and save a third of the price until Sunday evening.</p></div>
    <article data-keep><h1>Rye</h1><p>Rye.</p><p>Rye flour takes up more water than wheat flour does, so the dough stays sticky.</p></article>
    <aside><h2>More</h2><ul><li><a href=/1>Spelt</a></li><li><a href=/2>Oats and barley for beginners</a></li></ul></aside><footer><a href=/c>Contact</a></footer></body>""",
    """<body><ul class="menu"><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul>
    <div><h2 data-keep>The old mill</h2></div><div data-keep><p>The mill stood by the brook for three hundred years before the storm took its roof and most of the upper floor.</p>
    <p>Its wheel was made of oak and turned day and night in the spring.</p></div><div><p>Share this</p></div>
    <div><a href=/x>About us</a> | <a href=/y>Terms of use</a> | <a href=/z>Privacy</a></div></body>""",
    """<body><div id="cookie-notice"><p>We use cookies to give you the best experience on our site. By going on you agree to this.</p><button>OK</button></div>
    <main data-keep><h1>Glass</h1><p>Sand, soda and lime melt at a great heat and cool to a clear solid.</p><p>Colour comes from metals.</p></main>
    <section class="comments"><h3>2 comments</h3><p>I never knew that glass could be made with such simple things, thank you for writing.</p><p>Nice.</p></section></body>""",
    """<body><div class="sidebar"><p>Weather today: sunny with a light wind from the west and no rain before the evening.</p></div>
    <div class="post-content" data-keep><p>Bees dance to tell the others where the flowers are.</p><p>The angle of the dance gives the way, and its length how far to fly.</p>
    <blockquote>They never lie.</blockquote></div><form><label>Your mail</label><p>Sign up for our letter and get one story each week.</p></form></body>""",
    """<body><p><a href=/>Start</a> <a href=/n>New</a> <a href=/o>Old</a></p>
    <p data-keep>Snow falls when the air is cold all the way down to the ground, and each flake grows in its own way.</p>
    <p data-keep>Rain starts as snow.</p>
    <p data-keep>In the warm layer below the clouds the flakes melt, and what reaches us is water; <a href=/hail>hail</a> is another matter and grows in storms.</p>
    <p><a href=/1>Next page</a> <a href=/2>Last page</a></p><p>Imprint</p></body>""",
    """<body><div role="navigation"><span><a href=/q>Questions</a></span></div><article data-keep><header><h1>Clay pots</h1></header>
    <p>A pot is turned, dried and fired.</p><ul><li>Turn it</li><li>Dry it</li><li>Fire it</li></ul><table><tr><td>Heat</td><td>900</td></tr></table></article>
    <div class="related"><h3>Related</h3><p><a href=/a>Bricks and tiles of the north</a></p><p>Tiles keep out the rain for a hundred years if they are laid well.</p></div></body>""",
    """<body><div class="newsletter-signup"><p>Get the best stories in your inbox every Monday morning, free of charge.</p></div>
    <div><div data-keep><h1>Salt</h1><p>Salt was once worth its weight in silver, and whole towns lived from the trade along the white roads.</p></div></div>
    <div id="disqus_thread"><p>Great story, my grandfather used to carry salt over the pass in winter.</p></div>
    <div id="footer"><p>Made with care in the mountains by a small team of writers and editors.</p></div></body>""",
    """<body><div><a href=/1>Sports</a></div><div><a href=/2>Culture and arts</a></div><div><a href=/3>Money</a></div>
    <div data-keep>The harbour was full of ships that morning, and the crew could hardly find a place to land the nets and the barrels.</div>
    <div data-keep>Nobody spoke.</div>
    <div data-keep>At noon the bell rang twice and the market opened, as it had every day since the old captain came home.</div>
    <div>Log in</div><div><a href=/4>Help</a></div></body>""",
    """<body><article data-keep><h1>Fog</h1><p><b>Fog is a cloud that touches the ground.<br><p>It forms at night.</p></article><div class="promo">Our book on clouds is out now in all good shops, with many maps and pictures.</div>
    <footer>&copy; Weather House &middot; We love rain and snow. Come in.</footer></body>""",
    """<body><nav>All pages of this site are listed here by name</nav><article data-keep><p>Stop.</p></article><footer>The long footer of this page tells who made it and where they live today.</footer></body>""",
    """<body><div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/t>Trees</a> &gt; Oak</div><div class="article-body" data-keep><h2>Oak</h2><p>Oak.</p><p>An oak can live for a thousand years.</p></div>
    <div class="share-buttons">Share on all networks</div><div class="legal">All texts are free to use if you name the writers of this page.</div></body>""",
    """<body><div class="ad">Try the new lamp that never needs a battery, lights up the whole garden and costs less than a dinner for two. Order today and we send you a second lamp free of charge.</div>
    <article data-keep><h1>Light</h1><p>Light travels in straight lines until something bends it, such as glass or water or the edge of a narrow slit.</p><p>Shadows prove it.</p></article>
    <footer>&copy; The Lamp Post &middot; We have been writing about light for more than twenty years from our small house by the sea. Write to us at any time, we are glad of each letter.</footer></body>""",
    """<body><aside><p>The writer of these pages has lived in four towns, keeps two cats and has a garden where nothing ever grows as it should, though the neighbours are kind enough not to mention it.</p></aside>
    <article data-keep><h1>Wind</h1><p>Wind is air on its way from high pressure to low.</p></article>
    <footer>All texts and pictures on these pages belong to their makers and must not be copied without leave from the office. The office is open from nine to five on working days.</footer></body>""",
    """<body><main><article><div data-keep><h1>Iron</h1><p>Iron comes from the earth as red stone and must be freed from it with fire and coal before it can be worked.</p><p>Steel is iron with a little carbon.</p></div>
    <div class="comments"><p>My father was a smith all his life and he always said that the fire must sing before you put the iron in, I still remember the sound of it in the evening.</p><p>Does anyone know where to buy good coal these days, the shop in our town closed last year and the next one is far away?</p></div>
    <aside class="promo"><p>Read more stories of old crafts in our yearly book, which has more than two hundred pages and many drawings made by the people who still work in these trades.</p></aside></article></main></body>""",
    """<body><div class="cookie-consent"><p>This site and its partners store small files on your device to count visits, to remember your choices and to show you offers that may be of use to you. You can change your mind at any time in the settings.</p></div>
    <div class="entry" data-keep><p>Milk.</p><p>Milk turns sour when tiny beings eat its sugar and leave acid behind, which makes the white parts clot.</p><p>Cheese begins there.</p></div>
    <div class="sidebar"><p>Most read this week: how to bake bread without an oven, what to do with old milk, why cheese has holes and whether you may eat the rind of it or not.</p></div></body>""",
    """<body><header><p>Welcome to the pages of the hill village, where the school, the mill and the choir tell what goes on from week to week, in spring as well as in the dark of winter.</p></header>
    <article data-keep><header><h1>The choir</h1><p>A story in three short parts, told by the people who were there that evening and have not forgotten it.</p></header><p>They sang.</p><p>Nobody had heard the song before, yet all of them knew how it went on, and the old priest wept.</p>
    <footer></footer></article><form><p>Tell us what you think of this story and leave your name and mail so that we can write back to you as soon as one of us finds the time.</p></form></body>""",
    """<body><div class="banner"><p>Only until Friday: all seats on all trains to the coast for half the price, with free tea and a window place for everyone who books before noon on the day of travel.</p></div>
    <article data-keep><p>Trains run on rails.</p><p>The first of them were drawn by horses.</p></article>
    <footer>&copy; Rail Friends &middot; Short. Long footers like this one name every helper, every sponsor and every town that gave money or time to the museum in the last ten years.</footer></body>""",
    """<body><article data-keep><h1>Ice</h1><p>Ice floats.</p><p>Water is heaviest a little above the point where it freezes, so lakes freeze from the top and fish live on below.</p></article>
    <section id="reader-responses"><p>Thank you for this, I had wondered about the fish in our pond every winter since I was a child and nobody could ever tell me why they did not die.</p></section>
    <div class="popup"><p>Before you go, would you like to get a note from us when the next story about water, ice and snow is ready for you to read?</p></div></body>""",
]


def _words(rng: np.random.Generator, n: int) -> str:
    return " ".join("w" * int(k) for k in rng.integers(2, 9, n))


def _links(rng: np.random.Generator, n: int, most: int = 3) -> list[str]:
    return [f"<a href=/{k}>{_words(rng, int(rng.integers(1, most + 1)))}</a>" for k in range(n)]


def _paragraph(rng: np.random.Generator, least: int = 1) -> str:
    """An article's paragraph: long as a rule, a few words at times, with some words linked."""
    n = max(least, int(rng.integers(1, 8)) if rng.random() < 0.25 else int(rng.integers(8, 120)))
    linked = int(n * rng.random() * 0.3) if rng.random() < 0.3 else 0
    return _words(rng, n - linked) + (f" <a href=/x>{_words(rng, linked)}</a>" if linked else "")


def _made_page(rng: np.random.Generator) -> str:
    """Lists of links, an article, and what stands around it. On half of the pages all is plain
    div and p, so that words and links have to tell; on the rest containers have names."""
    plain, out = rng.random() < 0.5, []

    def put(content: str, tag: str, attrs: str = "") -> None:
        out.append(f"<div>{content}</div>" if plain else f"<{tag}{attrs}>{content}</{tag}>")

    def link_list(tag: str, attrs: str = "") -> None:
        items = _links(rng, int(rng.integers(2, 9)))
        style = rng.integers(3)
        put("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style == 0 else " | ".join(items) if style == 1 else "".join(f"<p>{x}</p>" for x in items), tag, attrs)

    if rng.random() < 0.8:
        link_list("nav")
    if rng.random() < 0.3:
        put(f"<p>{_words(rng, int(rng.integers(1, 5)))}</p>" + "".join(f"<p>{x}</p>" for x in _links(rng, 3)), "header")
    if not plain and rng.random() < 0.6:
        put(_words(rng, int(rng.integers(3, 60))), "div", rng.choice([' class="ad"', ' class="cookie-notice"', ' class="sidebar"']))
    body = [f"<h1>{_words(rng, int(rng.integers(1, 12)))}</h1>"] if rng.random() < 0.8 else []
    body += [f"<p>{_paragraph(rng, 8 if plain and k == 0 else 1)}</p>" for k in range(int(rng.integers(1, 9)))]
    if rng.random() < 0.35:  # lists of links inside the article are none of it
        links = "".join(f"<li>{x}</li>" for x in _links(rng, int(rng.integers(2, 6)), 9))
        body.insert(int(rng.integers(1, len(body) + 1)), f"<ul data-drop>{links}</ul>")
    if rng.random() < 0.2:  # a heading that is a link to its own place belongs to it
        body.insert(int(rng.integers(0, len(body))), f"<h2><a href=#x>{_words(rng, int(rng.integers(1, 6)))}</a></h2>")
    tag, attrs = ("div", ' class="layout has-sidebar"') if rng.random() < 0.2 else ("div", "")
    inner = ("div", "") if plain else [("article", ""), ("main", ""), ("div", ' class="post-content"')][int(rng.integers(3))]
    out.append(f"<{tag}{attrs}><{inner[0]}{inner[1]} data-keep>{''.join(body)}</{inner[0]}></{tag}>")
    if not plain and rng.random() < 0.5:
        put("".join(f"<p>{_words(rng, int(rng.integers(2, 50)))}</p>" for _ in range(int(rng.integers(1, 4)))), "section", ' class="comments"')
    if rng.random() < 0.4:
        link_list("div", ' class="related"')
    if not plain and rng.random() < 0.9:
        put(f"&copy; {_words(rng, int(rng.integers(2, 50)))}", "footer")
    elif plain and rng.random() < 0.9:
        put(" &middot; ".join([_words(rng, int(rng.integers(1, 4))), *_links(rng, int(rng.integers(2, 5)))]), "footer")
    return f"<body>{''.join(out)}</body>"


def labelled_pages(made: int = MADE_PAGES, seed: int = SEED) -> list[str]:
    """The written pages and the made ones."""
    rng = np.random.default_rng(seed)
    return LABELLED_PAGES + [_made_page(rng) for _ in range(made)]
