"""Text of formulas, drawings, options and form fields, which browsers show."""

import pytest

from cairn.llm import html_text
from cairn.llm.html_text import rendered


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b", "a x=2 b"),
        ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><path d='m'/><text>up</text><g><text>down</text></g></svg><p>b", "up\ndown\n\nb"),
        ("<svg><defs/><title/><text>up</text></svg>x<svg/>y", "up\nxy"),
        ("<desc>a</desc> <text>b</text>", "a b"),
        ("<select><option>one<optgroup label=more><option>two</select>", "one\nmore\ntwo"),
        ("<datalist><option>one</datalist>x", "x"),
        ("n: <textarea>\na &lt;b>\n  c</textarea>", "n: a <b>\n  c"),
        ("<textarea hidden>a</textarea><select style='display:none'><option>b</select>c", "c"),
    ],
)
def test_visible_tags(source, text):
    assert rendered(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e<td>f</table>", "a  b  c\n      d\n   e  f"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>wide cell<td>x</table>", "a  b\nwide cell  x"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
        ("<div style='display:none'>a<b style='visibility:visible'>b</b></div>d", "d"),
        ("<p style='color:red;visibility:visible'>x", "x"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
    ],
)
def test_grids_and_visibility(source, text):
    assert html_text.rendered(source) == text


@pytest.mark.parametrize("pattern", ["<div>", "<p><table><td><div>", "<b>", "<ul><li>", "<svg><g>", "<table><tr><td>", "</p>", "<li>"])
def test_deep_pages_take_time_in_proportion(pattern):
    import time

    began = time.process_time()
    html_text.tree("<p><table><tr><td>" + pattern * 100_000 + "x")
    assert time.process_time() - began < 8


class Model:
    """A random well-formed page with the words that it shows, told from the model and not from the page."""

    def __init__(self, seed):
        import random

        self.rng, self.n, self.words = random.Random(seed), 0, []

    def word(self, shown):
        self.n += 1
        if shown:
            self.words.append(f"w{self.n}")
        return f"w{self.n}"

    def part(self, depth, shown, displayed=True):
        rng = self.rng
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["text", "text", "block", "inline", "list", "table", "none", "hidden", "visible", "script"]) if depth else "text"
            see = shown and displayed
            inside = lambda s=shown, d=displayed: self.part(depth - 1, s, d)
            if kind == "text":
                out.append(" " + self.word(see) + rng.choice([" ", "\n", "<!-- x -->", "<br>"]))
            elif kind == "block":
                tag = rng.choice(["div", "section", "blockquote", "article", "h2"])
                out.append(f"<{tag}>{inside()}</{tag}>")
            elif kind == "inline":
                tag = rng.choice(["b", "i", "span", "a"])
                out.append(f"<{tag} title='a > b'>{inside()}</{tag}>")
            elif kind == "list":
                out.append("<ul>" + "".join(f"<li>{inside()}</li>" for _ in range(2)) + "</ul>")
            elif kind == "table":
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.word(see)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind == "none":
                out.append(f"<div {rng.choice(['hidden', 'style="display: none"'])}>{inside(shown, False)}</div>")
            elif kind == "hidden":
                out.append(f"<span style='visibility:hidden'>{inside(False)}</span>")
            elif kind == "visible":
                out.append(f"<span style='visibility:visible'>{inside(True)}</span>")
            else:
                out.append(f"<script>{self.word(False)} < '<b>'</script>")
        return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_random_pages_show_their_words(seed):
    m = Model(seed)
    page = f"<!DOCTYPE html><html><head><title>no</title></head><body>{m.part(4, True)}</body></html>"
    assert [w for w in html_text.rendered(page).split() if w not in ("-", "•")] == m.words


def test_pages_against_a_plain_parser(spark, sf):
    """All words outside hidden elements, in order, by the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden, self.open = [], 0, []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag not in html_text.VOID:
                gone = tag in html_text.HIDDEN or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")
                self.open.append((tag, gone))
                self.hidden += gone

        def handle_endtag(self, tag):
            while any(t == tag for t, _ in self.open):
                t, gone = self.open.pop()
                self.hidden -= gone
                if t == tag:
                    break

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    for r in spark.read.parquet(f"{sf}/pages.parquet").where("html is not null").collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        got = html_text.rendered(r.html).split()
        assert set(plain.words) <= set(got), r.page_id
