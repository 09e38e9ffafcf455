"""X1's tree rules: what browsers make of faulty markup, by hand."""

import random
import time

import pytest

from placeweave.operators.elements import flatten_page


def tree(html):
    """The body's (or the whole) tree as nested markup."""
    text, rows, _, error = flatten_page(html)
    assert error is None
    below = {}
    for r in rows:
        below.setdefault(r[1], []).append(r)

    def show(r):
        out, at = [], r[6]
        for k in below.get(r[0], []):
            out += [text[at:k[6]].decode(), show(k)]
            at = k[7]
        return f"<{r[4]}>{''.join(out)}{text[at:r[7]].decode()}</{r[4]}>"
    return show(rows[0])


def body(html):
    whole = tree(html)
    assert whole.startswith("<html><head></head><body>") and whole.endswith("</body></html>")
    return whole[len("<html><head></head><body>"):-len("</body></html>")]


@pytest.mark.parametrize("html,want", [
    ("", "<html><head></head><body></body></html>"),
    ("<title>t</title><meta><p>q", "<html><head><title>t</title><meta></meta></head><body><p>q</p></body></html>"),
    ("<html><head><title>x</title></head> <body>y</body></html> z", "<html><head><title>x</title></head> <body>y z</body></html>"),
    ("<head></head><link><p>x", "<html><head><link></link></head><body><p>x</p></body></html>"),
    ("<noscript><img></noscript>x", "<html><head><noscript><img></img></noscript></head><body>x</body></html>"),
    ("  <!-- c -->  a", "<html><head></head><body>a</body></html>"),
])
def test_html_head_and_body_are_implied(html, want):
    assert tree(html) == want


@pytest.mark.parametrize("html,want", [
    ("<a></a><div>Cafe</div>", "<a></a><div>Cafe</div>"),
    ("<p>a<p>b<div>c", "<p>a</p><p>b</p><div>c</div>"),
    ("</p>x</br>y", "<p></p>x<br></br>y"),
    ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<button>a<button>b", "<button>a</button><button>b</button>"),
    ("<form><form>x</form>y</form>", "<form>x</form>y"),
    ("<span><div></span>text</div>u", "<span><div>text</div>u</span>"),
    ("<select><option>a<option>b<optgroup><option>c</select>d",
     "<select><option>a</option><option>b</option><optgroup><option>c</option></optgroup></select>d"),
    ("<div><svg><g/><text>t</text></svg>u</div>", "<div><svg><g></g><text>t</text></svg>u</div>"),
    ("<svg><path/><path/><p>q", "<svg><path></path><path></path></svg><p>q</p>"),
])
def test_implied_ends_and_foreign_content(html, want):
    assert body(html) == want


@pytest.mark.parametrize("html,want", [
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
    ("<table><td>1", "<table><tbody><tr><td>1</td></tr></tbody></table>"),
    ("<table><caption>c<td>d</table>", "<table><caption>c</caption><tbody><tr><td>d</td></tr></tbody></table>"),
    ("<table><col><tbody><tr><td>x", "<table><colgroup><col></col></colgroup><tbody><tr><td>x</td></tr></tbody></table>"),
    ("<td>x</td><tr>y", "xy"),
    ("<table>x<b>y<tr><td>z</table>w", "x<b>y</b><table><tbody><tr><td>z</td></tr></tbody></table><b>w</b>"),
    ("<table><div><td>a</div>b", "<div></div><table><tbody><tr><td>ab</td></tr></tbody></table>"),
    ("<table><table>x", "<table></table>x<table></table>"),
    ("<b>1<table>2<td>3</table>4", "<b>12<table><tbody><tr><td>3</td></tr></tbody></table>4</b>"),
    ("<table><tr><td><table><tr><td>i</table>o</table>",
     "<table><tbody><tr><td><table><tbody><tr><td>i</td></tr></tbody></table>o</td></tr></tbody></table>"),
])
def test_tables_get_their_parts_and_give_up_the_rest(html, want):
    assert body(html) == want


@pytest.mark.parametrize("html,want", [
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b><p>a</b>b</p>c", "<b></b><p><b>a</b>b</p>c"),
    ("<a>1<div>2</a>3</div>4", "<a>1</a><div><a>2</a>3</div>4"),
    ("<a>x<a>y", "<a>x</a><a>y</a>"),
    ("<p><b>x</p><p>y", "<p><b>x</b></p><p><b>y</b></p>"),
    ("<table><a><tr><td>q</a></table>r", "<a></a><table><tbody><tr><td>q</td></tr></tbody></table><a>r</a>"),
])
def test_misnested_formatting_is_split(html, want):
    assert body(html) == want


TAGS = "a b i p div table tr td th tbody li ul dl dd dt svg path form select option h1 h2 button span head body html title " \
       "template caption col colgroup noscript math".split()


def test_any_tag_soup_gives_a_tree():
    rng = random.Random(1)
    tokens = [f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS] + ["x", " ", "<br>", "<img/>", "<g/>", "<!-- -->"]
    for _ in range(4000):
        html = "".join(rng.choices(tokens, k=rng.randrange(1, 40)))
        text, rows, nodes, error = flatten_page(html)
        assert error is None, html
        assert [r[4] for r in rows if r[4] in ("html", "head", "body")] == ["html", "head", "body"], html
        for r in rows:
            assert r[1] < r[0] <= r[3] and r[6] <= r[7] <= len(text)
            if r[1] >= 0:
                up = rows[r[1]]
                assert up[3] >= r[3] and up[2] == r[2] - 1 and up[6] <= r[6] and r[7] <= up[7]
        assert all(a[1] <= b[0] for a, b in zip(nodes, nodes[1:]))
        assert text.count(b"x") == html.count("x")              # no text is lost


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<p>", "<a>", "<a><div>", "<b><p>", "<td>", "<li>", "<svg>", "<table><td>", "<table>x",
                                  "<i><b>", "<p><table><td><div>", "<font><div></font>", "x<b></table>"])
def test_time_is_linear(unit):
    def took(n):
        t = time.process_time()
        flatten_page(unit * (n // len(unit)))
        return time.process_time() - t
    assert took(200_000) < max(40 * took(20_000), 8)
    assert max(r[2] for r in flatten_page(unit * 3000)[1]) < 520
