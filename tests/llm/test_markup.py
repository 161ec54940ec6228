"""The markup pass on broken pages: no exception, linear time, nothing dropped but what is markup."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seine.llm import html_text
from seine.llm.markup import events

PARTS = ["<", ">", "/", "a", "p", "script", "!", "--", "[", "]", "&", "amp;", '"', "'", "=", " ", "x", "<p>", "</p>", "<!--", "-->", "<div>", "</div>", "\n", "?", "<a href='x'>", "é", "\x00", "<title>", "<textarea>", "<![CDATA[", "\ud800"]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=60))
@settings(max_examples=600, deadline=None)
def test_any_string_is_a_page(page):
    for kind, value, attributes in events(page):
        assert kind in ("text", "start", "empty", "end") and isinstance(value, str) and (attributes is None) == (kind in ("text", "end"))
    html_text.main_text(page, html_text.fit())


@given(st.lists(st.text("ab c&", min_size=1, max_size=8), max_size=6))
@settings(max_examples=200, deadline=None)
def test_text_between_tags_stays(texts):
    page = "".join(f"<p class='x'>{t.replace('&', '&amp;')}</p>" for t in texts)
    assert [v for k, v, _ in events(page) if k == "text"] == texts


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>a</p><![x b ]><p>c</p>", ["a", "c"]),
        ("<p>a</p><![foo[", ["a"]),
        ("<p>1 <![ 2", ["1"]),
        ("<p>1 <![ 2<p>3</p>", ["1 3"]),
        ("<p>a<!-- x --!>b", ["ab"]),
        ("a<!-->b<!--->c<!-- d", ["abc"]),
        ("a < b and c > d <3", ["a < b and c > d <3"]),
        ("<p title='it's'>yes</p><p>no", ["yes", "no"]),
        ('<p title="a > b">yes</p>', ["yes"]),
        ('<p title="never closed>yes</p><p>no</p>', ["yes", "no"]),
        ("one<br/>two<p/>three", ["one", "two", "three"]),
        ("<script>if (a < b) '</p>'</script>x<style>p > a {}</style>", ["x"]),
        ("<SCRIPT>x</Script >y</ >z<//>", ["yz"]),
        ("<p>a</p x='>'>b", ["a", "b"]),
        ("one <b", ["one"]),
        ("one <b two<p>three</p>", ["one three"]),
        ("&lt;p&gt; &#39;x&#39; &amp;amp;", ["<p> 'x' &amp;"]),
        ("", []),
    ],
)
def test_broken_markup(page, expected):
    assert [b.text for b in html_text.blocks(page)] == expected


def test_attributes():
    assert list(events("<A HREF=x y Z='1 &amp; 2' w=\"3\"v=/>")) == [("start", "a", [("href", "x"), ("y", None), ("z", "1 & 2"), ("w", "3"), ("v", "/")])]
    assert list(events("<br/>")) == [("empty", "br", [])]


UNCLOSED = ["<a ", "<br ", "<p a=", '<p title="', "<!--", "<![x b ]>", "<!", "</a ", '<a x=">"', "<p a='", "<script", "<script>", "</", '<p title="x>', "<div><p>", "&", "&#", "<a x='\"", "<a href=x ' ", "<?", "<p ======", "<!-->", "<title>", "<x" + " " * 50]


@pytest.mark.parametrize("part", UNCLOSED)
def test_time_is_linear(part):
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        html_text.blocks(part * n + "<p>end</p>")
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.5
