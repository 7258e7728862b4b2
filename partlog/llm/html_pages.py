"""Labelled pages that the HTML extraction is trained on.

Each line of a page is one element or tag of its body; a leading ``+`` marks the elements
whose whole content is main text, ``-`` those that are not, and lines without a mark are
mere containers.  The pages were written for this library.  ``LAYOUTS`` are page layouts
with slots, which ``labelled_pages`` fills with boilerplate and article bodies.
"""

from __future__ import annotations

from itertools import product

MENUS = (
    "<nav><ul>-<li><a>Home</a></li>-<li><a>World news</a></li>-<li><a>Sport</a></li></ul></nav>",
    "<div class='menu'><ul>-<li><a>Start</a></li>-<li><a>Themen</a></li></ul></div>",
    "<nav class='navbar'>-<a>Inicio</a>-<a>Blog</a>-<span>Menu</span></nav>",
    "<ul id='breadcrumb'>-<li><a>Accueil</a></li>-<li>Archives</li></ul>",
)
HEADERS = (
    "<header>-<a class='logo'>The Daily</a>-<p>News since 1999</p></header>",
    "<div id='header'>-<h1>My Site</h1>-<p>A site about things and other things.</p></div>",
    "<header>-<h1>Paper</h1>-<p>The oldest paper of the region, with news about all that happens"
    " in town and country, since the year in which the bridge was built.</p></header>",
    "<header role='banner'>-<div>Site name</div><nav>-<a>About</a></nav></header>",
    "",
)
FOOTERS = (
    "<footer>-&copy; example.com &middot; All rights reserved, no text may be copied.</footer>",
    "<div class='footer'>-<p>Copyright 2020 by the authors of this site.</p>-<a>Imprint</a></div>",
    "<footer>-<p>This site is made by people who like what they do. We are not responsible for"
    " what other sites say, and we do not sell what you tell us to anybody.</p></footer>",
    "<footer>-<p>Contact us</p><ul>-<li><a>Terms</a></li>-<li><a>Privacy</a></li></ul></footer>",
    "",
)
ASIDES = (
    "<aside>-<h3>Related</h3><ul>-<li><a>Ten more stories</a></li>-<li><a>Read this</a></li></ul>"
    "-<p>A teaser text in the sidebar that is about as long as a paragraph may be.</p></aside>",
    "<div class='sidebar'>-<h4>Popular</h4>-<p>Another story that people liked to read.</p>"
    "<ul>-<li><a>Link</a></li></ul></div>",
    "<aside>-<p>About the author: she has written about towns and rivers for twenty years, and"
    " lives in a small house near the sea with two cats and a dog.</p></aside>",
    "<div class='widget related-posts'>-<h3>More</h3>-<a>See also</a>-<p>Short teaser</p></div>",
    "",
)
NOTICES = (
    "<div class='ad'>-Buy the best shoes for less money today. Only this week, and only in our"
    " shop, you get two pairs for the price of one, so come soon and bring a friend.</div>",
    "<div class='advert'>-<p>A car for you.</p>-<p>It is fast and safe, and it takes you to any"
    " place that you want to see, at a price that will make you smile for years.</p></div>",
    "<div class='ad'>-Cheap flights to the sun.</div>",
    "<div class='cookie-notice'>-<p>We use cookies to improve your experience on our site. By"
    " going on you agree.</p>-<button>Accept</button></div>",
    "<div id='banner-ad' class='sponsored'>-<p>Sponsored: a loan that you will love.</p></div>",
    "<div class='newsletter popup'>-<h3>Sign up</h3>-<p>Get all the news by mail.</p></div>",
    "<div class='alert notice'>-<p>Please enable scripts. This page needs them for its menus, its"
    " pictures and its maps, and it will not look right without them.</p></div>"
    "<div class='ads'>-Ad</div>",
    "<div class='share social'>-<a>Share</a>-<a>Tweet</a>-<span>12 shares</span></div>",
)
FORMS = (
    "<form>-<label>Search</label>-<input>-<button>Go</button>-<p>Type a word</p></form>",
    "<form>-<p>To order, please tell us your name and your address, and we will send you all that"
    " you need within a week, or you get your money back.</p>-<input>-<button>Send</button></form>",
    "<form class='login'>-<label>Name</label>-<select>-<option>One</option></select>"
    "-<textarea>Your text</textarea></form>",
    "",
)
COMMENTS = (
    "<section id='comments'>-<h2>Comments</h2><div class='comment'>-<b>Ann</b>-<p>I do not agree"
    " with this at all, and here is a long reason why I do not.</p></div></section>",
    "<div class='comment-list'><ul><li class='comment'>-<p>Great text!</p></li><li"
    " class='comment'>-<p>Thanks for sharing this with all of us readers.</p></li></ul></div>",
    "<div class='comments'><div>-<p>When I was young, we had none of this, and still we were happy"
    " with what there was, so I do not see why it matters that much now.</p></div></div>",
    "<ol class='replies'><li>-<p>First reply</p></li><li>-<p>A second reply, longer.</p></li></ol>",
    "",
)
LONG = (
    "+<p>This paragraph is a long one, as most of them are in an article: it goes on for a while,"
    " says a thing or two about the matter, and does not end before its line is full.</p>"
    "+<p>The next one does the same, with other words, and adds a number, 42, and a name or two,"
    " so that nobody can say that there was nothing in it that was worth to be read.</p>"
    "+<p>It <a>links</a> to <a>another page</a>, to <em>a book</em> and, with <strong>some</strong>"
    " weight, to <code>code</code>, as people do who want to be <i>understood</i>.</p>"
    "<ul>+<li>One point of a list, in some words</li>+<li>Two</li>+<li>Three words only</li></ul>"
    "+<p>See <a>here</a>.</p>+<p><a>A link that is a line of its own</a></p>"
)
BODIES = (
    "+<h1>A title of the article</h1>+<p>A first paragraph of some length that says what all of"
    " this is about, in a few words.</p>+<p>Short one.</p>" + LONG + "+<p>And <b>one</b> more, with"
    " <a>a link</a> in the middle of its text.</p>",
    "+<h1>Title</h1>+<p><b>Lead text in bold type, which tells the story in brief.</b></p>"
    "+<h2>Part</h2>" + LONG + "+<p>Text of this part.</p><ul>+<li>First point</li>+<li>Second point of the"
    " list</li></ul>+<blockquote>Somebody said so.</blockquote>+<p>End.</p>",
    "+<h2>Head</h2>+<p>Text, text and more text, until the line is full.</p>" + LONG + "<table><tr>+<td>1</td>"
    "+<td>Two</td></tr></table>+<pre>code = 1</pre><figure>+<figcaption>What it shows</figcaption>"
    "</figure><div>+<p>A paragraph inside of a box.</p></div>",
    "+<p>Yes.</p>+<p>No.</p><ul>+<li>Eggs</li>+<li>Milk, bread</li>+<li>A bag of flour</li></ul>"
    "<ol>+<li>Mix it all</li>+<li>Bake it for an hour or so</li></ol>+<h3>Notes</h3>" + LONG + "+<p>Hm.</p>",
    "+Bare text without a paragraph.+<br>+More of it after a break, and then it ends."
    "+<span>A span of text</span>" + LONG + LONG + "+<p>Yes.</p><section>+<h3>Deep</h3>+<p>Text in a section.</p>"
    "</section>",
)
LAYOUTS = (
    "{menu}{notice}<article>{body}</article>{footer}",
    "{header}{menu}<main><article>{body}</article>{aside}</main>{comments}{footer}",
    "{header}<div id='content'>{notice}<div class='post'>{body}</div>{comments}</div>{aside}{footer}",
    "<div class='wrapper'>{header}{menu}{form}<div class='article-body'>{body}</div>{footer}</div>",
    "{notice}{header}<main>{body}{form}</main>{aside}{footer}",
    "<article>{body}{notice}{comments}</article>{menu}{footer}",
    "<section>{body}</section>{aside}{form}{footer}",
    "{header}{menu}<article>{aside}{body}{form}</article>{footer}{notice}",
)


def labelled_pages() -> list[str]:
    """Pages with marks: each layout with each body, boilerplate taken in turn."""
    pages = []
    for k, (layout, body) in enumerate(product(LAYOUTS, BODIES)):
        for turn in range(4):
            n = 5 * k + turn
            pages.append(
                layout.format(
                    body=body,
                    menu=MENUS[n % len(MENUS)],
                    header=HEADERS[n // 2 % len(HEADERS)],
                    footer=FOOTERS[n // 3 % len(FOOTERS)],
                    aside=ASIDES[n // 2 % len(ASIDES)],
                    notice=NOTICES[n % len(NOTICES)],
                    form=FORMS[n % len(FORMS)],
                    comments=COMMENTS[n % len(COMMENTS)],
                )
            )
    return pages
