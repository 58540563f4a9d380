"""Only an attribute of that very name hides an element."""

import pytest

from inkwarden.llm import html_text


@pytest.mark.parametrize(
    ("attributes", "hidden"),
    [
        ('data-title="Hidden gems"', False),
        ('data-hidden="false"', False),
        ('title="the hidden river"', False),
        ("title='a style=display:none b' id=x", False),
        ('title="the hidden river', False),
        ("aria-hidden=false", False),
        ("href=/a/hidden/b", False),
        ("hidden", True),
        ('class="a"HIDDEN', True),
        ('data-x="hidden" hidden="until-found"', True),
        ('aria-hidden = "true"', True),
        ("style='color:red; display : none'", True),
    ],
)
def test_hidden(attributes, hidden):
    assert html_text._places("article", attributes)[1] is hidden


def test_page_with_a_hidden_word():
    page = '<article data-title="Hidden gems"><p title="the hidden river">Some text of it.</p></article>'
    assert html_text.main_text(page, html_text.trained()) == "Some text of it."


def test_class_of_a_state_says_nothing():
    tree = html_text.trained()
    page = "<div class='article-comments-enabled content'><p>The river rose in the night and took two benches with it.</p><p>Nothing else.</p></div>"
    assert html_text.main_text(page, tree) == "The river rose in the night and took two benches with it.\n\nNothing else."


def test_unclosed_hidden_elements_are_read_in_linear_time():
    import time

    times = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert len(html_text.blocks("<p hidden>text " * n + "<select>x" * n)) > n // 2
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0] + 0.5


#: Labelled by hand like the training pages, in layouts that are not among them.
HELD_OUT = (
    """<html><body><div class="l-page"><div class="l-top"><a href="/">Valley Walks</a><a href="/map">Map</a><a href="/huts">Huts</a></div><div class="l-body"><h1>+The long way to the upper lake</h1><p>+Start at the church and follow the stream until the second bridge, where the path leaves the road.</p><p>+It is steep.</p><p>+After the last farm there is no water before the hut, so fill every bottle that you have.</p><ul><li>+Four hours up, three down</li><li>+Good boots</li></ul><p>+The hut is open from June.</p></div>
<div class="l-extra"><p><a href="/w1">Walk 1</a></p><p><a href="/w2">Walk 2</a></p><p><a href="/w3">All walks of the valley</a></p></div><div class="l-end"><a href="/legal">Legal</a> <a href="/mail">Mail us</a></div></div></body></html>""",
    """<html><body><header><nav><ul><li><a href="/n">News</a></li><li><a href="/o">Opinion</a></li></ul></nav></header><article><h1>+Bridge to stay one lane</h1><p>+The old bridge will not be widened, the county said on Monday.</p><aside class="promo"><p>Read all of our stories for one coin a week, and stop whenever you like.</p></aside><p>+Lorries must take the road by the quarry instead.</p><p>+"We counted them," the engineer said, "and there are eleven a day, of which nine could go round without losing more than five minutes."</p><footer><p><a href="/t/bridge">bridge</a> <a href="/t/roads">roads</a></p></footer></article>
<section id="comments"><p>Eleven a day is eleven too many for those of us who sleep above the street, as I have written here before.</p><p>Agreed.</p></section><footer><p>Published by the county press, all days but Sunday.</p></footer></body></html>""",
    """<html><body><div><a href="/a">A</a> <a href="/b">B</a> <a href="/c">C</a></div><h1>+A short history of the tin whistle</h1><p>+Cheap, loud and hard to lose, the whistle came to every fair in the country.</p><p>+Boys bought it.</p><p>+By the end of the century a maker in the north sold a million of them every year, most to people who could not read a note of music.</p><p><a href="/next">Next page</a> <a href="/prev">Page before</a></p></body></html>""",
)


def test_tree_on_hand_labelled_pages_that_it_has_not_seen():
    from inkwarden.llm.labelled import PAGES, labelled

    tree, right, n = html_text.trained(), 0, 0
    for page in HELD_OUT:
        assert page not in PAGES
        plain, labels = labelled(page)
        found = html_text.blocks(plain)
        right += sum(html_text.judge(tree, r) == y for r, y in zip(html_text.matrix(found).tolist(), labels, strict=True))
        n += len(labels)
    assert n > 28 and right / n >= 0.9


def test_links_and_words_lead_the_tree():
    tree = html_text.trained()
    assert html_text.FEATURES[tree.feature] in ("words", "link", "prev_words", "prev_link", "next_words", "next_link")
