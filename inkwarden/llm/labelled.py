"""Pages labelled by hand: a block of the article begins with a plus sign, every other block does not.

They are invented, in the manner of common layouts: named and unnamed divisions,
semantic elements, tables, and pages whose parts bear no telling name.
"""

PAGES = (
    """<html><body><div id="top"><a href="/">The Harbour Post</a></div><ul class="l1"><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Weather and tides</a></li></ul>
<div class="c-8"><h1>+Ferry returns after three months in dock</h1><p class="by"><a href="/u/12">By M. Lindgren</a></p><p>+The island ferry left the yard on Tuesday with a new engine and fresh paint, and made its first crossing in fog.</p>
<p>+About forty passengers waited on the quay.</p><p>+Some had brought flags.</p><h2>+A winter of small boats</h2><p>+Since November the mail had come by fishing boat, weather allowing, and the school had twice been closed because its teacher could not cross.</p>
<p>+The council paid for the repair out of its <a href="/budget">reserve for roads</a>, which the island does not have many of.</p></div>
<div class="c-4"><h3>Most read</h3><ul><li><a href="/1">Seal found in garden pond</a></li><li><a href="/2">Bakery to open on Sundays</a></li></ul><p>Get the week's stories by mail every Friday morning.</p></div>
<div class="end"><p>Harbour Post, Quay 4. All rights reserved. <a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></p></div></body></html>""",
    """<html><body><nav><a href="/">Home</a> <a href="/recipes">Recipes</a> <a href="/about">About</a></nav><main><article><header><h1>+Barley soup with roots</h1></header><p>+Serves four.</p><p>+Wash the barley until the water runs clear, then let it stand for an hour while you peel the carrots, the parsnips and one small turnip.</p>
<ul><li>+200 g barley</li><li>+three carrots</li><li>+one litre of stock</li></ul><p>+Cook everything slowly.</p><blockquote>+My grandmother left the lid off, and so do I.</blockquote><p>+It keeps for two days and is better on the second.</p></article>
<section class="responses"><h2>14 comments</h2><div class="comment"><p>Made this last night with leeks instead of turnip and the children asked for more, thank you!</p></div><div class="comment"><p>Too much barley for me.</p></div></section></main><footer><p>Written in a cold kitchen.</p></footer></body></html>""",
    """<html><body><table><tr><td><a href="x1">Index</a></td><td><a href="x2">Volume II</a></td><td><a href="x3">Search</a></td></tr></table><table><tr><td>+On the keeping of bees in towns</td></tr><tr><td>+A roof will do as well as a field, provided that the hives face away from the street and that water stands near them all summer.</td></tr>
<tr><td>+The first year gives little honey, and the beginner should leave all of it to the bees, however hard that may be in August.</td></tr><tr><td>+In the second year one learns to wait.</td></tr></table><table><tr><td>Last changed in May. <a href="mailto:w">Write to the keeper of this page</a></td></tr></table></body></html>""",
    """<html><body class="has-sidebar"><div class="site-header"><p>Notes from the observatory</p></div><div class="cookie-banner"><p>This site keeps a small file on your machine so that it knows you again. By reading on you agree to that.</p></div>
<div class="article-comments-enabled entry"><h1>+A comet for early risers</h1><p>+Before dawn, low in the east, a faint smudge may be found this week with ordinary field glasses.</p><p>+Look on Thursday.</p><p>+It will not return for about eleven thousand years, so that a short night seems a fair price for seeing it once.</p><div class="ad-slot"><p>Telescopes at half price until Sunday.</p></div><p>+Clouds are forecast for Friday.</p></div>
<div class="sidebar"><h3>About</h3><p>The observatory stands on a hill above the town and is open to visitors on clear Saturdays from October to March.</p><ul><li><a href="/v">Visit us</a></li><li><a href="/j">Join</a></li></ul></div>
<div class="site-footer"><p>&copy; the friends of the observatory</p></div></body></html>""",
    """<html><body><div><div><a href="/">Start</a></div><div><a href="/p">Products</a></div><div><a href="/s">Support</a></div></div><div><div><h2>+How to change the filter</h2><p>+Switch the machine off and wait until the lamp is dark.</p><ol><li>+Open the cover on the left.</li><li>+Turn the filter against the clock and pull it out.</li><li>+Push the new one in until it clicks.</li></ol>
<p>+If the lamp blinks red afterwards, the filter is not straight; take it out and begin again with the second step.</p><p>+See also <a href="/oil">how to change the oil</a>.</p></div><div><p><a href="/f1">Filters</a> <a href="/f2">Lamps</a> <a href="/f3">Covers</a></p></div></div>
<form><p>Was this page of help? Tell us what we could do better in your own words.</p><p>Send</p></form><div><p>Prices include tax. <a href="/t">Terms</a> <a href="/c">Contact</a> <a href="/l">Language</a></p></div></body></html>""",
    """<html><body><header><div>City Library</div><form><p>Search the catalogue</p></form></header><div role="navigation"><ul><li><a href="/1">Opening hours</a></li><li><a href="/2">Events</a></li></ul></div><div role="main"><h1>+Reading room closed for painting</h1><p>+The large reading room stays closed until the ninth of the month.</p><p>+Newspapers lie out in the hall, and the small room upstairs has twelve more desks than usual; please leave coats and bags downstairs.</p></div>
<aside><p>New in June: an exhibition of maps of the river from four centuries, with a talk by the surveyor on the opening evening.</p></aside><div class="share-buttons"><a href="/fb">Share</a> <a href="/tw">Post</a></div><footer><ul><li><a href="/p">Press</a></li><li><a href="/j">Jobs</a></li></ul><p>City Library, Market Street 2, open from ten to seven on every day but Monday.</p></footer></body></html>""",
    """<html><body><div class="wrap"><div class="bar"><a href="/login">Log in</a> | <a href="/new">New topics</a></div><div class="story"><p>+We walked from the station in the rain, past the closed shops, and nobody said anything until the bridge.</p><p>+"There," said Ann.</p><p>+The river had come up over the steps in the night and taken the two green benches with it.</p><p>+Nothing else was missing.</p></div>
<div class="replies"><p>I remember those benches, my father painted them when I was about six years old and we lived by the mill.</p><p>Lovely.</p></div><div class="related"><p>You may also like:</p><ul><li><a href="/q">The mill race</a></li><li><a href="/r">Night train to the coast</a></li></ul></div></div></body></html>""",
    """<html><body><p><a href="1.html">back</a> <a href="3.html">next</a></p><h1>+Chapter two</h1><p>+The letter had lain under the door since morning.</p><p>+He read it standing, then once more by the window, and put it into the stove without a word, where it took a long while to burn because the paper was damp.</p><p>+No one asked.</p><p><a href="1.html">back</a> <a href="index.html">contents</a> <a href="3.html">next</a></p></body></html>""",
)


def labelled(page: str) -> tuple[str, list[bool]]:
    """The page without its signs, and whether each of its blocks had one; blocks as ``html_text.blocks`` finds them."""
    from inkwarden.llm.html_text import blocks

    labels = [b.text.startswith("+") for b in blocks(page)]
    return page.replace(">+", ">"), labels
