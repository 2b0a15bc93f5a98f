import random
import re
import time

import pytest

from tidemark.llm import html_text

CASES = {
    "<p>One<p>Two <b>bold</b>\n  words": "One\n\nTwo bold words",
    "a<br>b<div>c</div>d": "a\nb\nc\nd",
    "<ul><li>x<li>y<ul><li>z</ul></ul>w": "- x\n- y\n  - z\n\nw",
    "<ol start=4><li>a<li value=9>b<li>c</ol>": "4. a\n9. b\n10. c",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>e": "a    | bbb\ncccc | d\n\ne",
    "<table><thead><tr><th>H</th></tr><tbody><tr><td>1<table><tr><td>in<td>ner</table></td></tr></table>": "H\n1 in ner",
    "<pre>  keep\n   this</pre>": "  keep\n   this",
    "<head><title>T</title><style>p{}</style></head><body>seen<script>if (a<b) '</p>'</script>": "seen",
    "<div hidden>no</div><p style='color:red; DISPLAY : none'>no<b>no</b></p><p style=\"visibility:hidden\">no</p>yes": "yes",
    "x &amp; y &lt;b&gt; &eacute;": "x & y <b> é",
    "<!-- <p>no</p> -->a<!doctype html>b<?php x ?>c": "abc",
    "a < b and c > d": "a < b and c > d",
    "<p title='a>b'>t</p>": "t",
    "<dl><dt>T<dd>D<dt>U</dl>": "T\n  D\nU",
    "</p></div></b>text": "text",
    "<select><option>a<option>b</select>": "a\nb",
    "<textarea><b>raw</b></textarea>": "<b>raw</b>",
    "<script>never closed <p>no": "",
    "<dialog>no</dialog>a<dialog id=d open>yes</dialog><dialog title='open'>no</dialog>": "a\nyes",
    "<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp>字<rp>(<rt>ji<rp>)</ruby> x": "漢kan字ji x",
    "<noembed><p>no</noembed>a<details><summary>s</summary>d</details>": "a\ns\nd",
    "": "",
}


SPANS = {
    "<table><tr><td>a<td colspan=2>wide one<tr><td>b<td>c<td>d</table>": "a | wide one\nb | c | d",
    "<table><tr><td rowspan=2>tall<td>x<tr><td>y<tr><td>z<td>w</table>": "tall | x\n     | y\nz    | w",
    "<table><tr><td colspan=2 rowspan=2>both<td>1<tr><td>2<tr><td>3<td>4<td>5</table>": "both  | 1\n  |   | 2\n3 | 4 | 5",
    "<table><tr><td rowspan=0>all<td>1<tr><td>2<tr><td>3</table>": "all | 1\n    | 2\n    | 3",
    "<table><tr><td colspan=9>head<tr><td>1<td>2</table>": "head\n1 | 2",
    "<table><tr><td colspan=999>far<td>too<tr><td>1<td>long</table>": "far | too\n1 | long",
    "<table><tr><td>a<td><tr><td rowspan=2><tr><td>b</table>": "a |\n  | b",
}


@pytest.mark.parametrize("page", SPANS)
def test_spanning_cells(page):
    assert html_text.render(page) == SPANS[page]


@pytest.mark.parametrize(
    "unit", ["<a b=\"", "<a b='", "<a<a", "<a \"<b '", "<", "</", "<!", "<!--", "<a b=\">\" ", "<div><p>x", "<td colspan=999>x", "<tr><td rowspan=999>x", "<td rowspan=64>x<tr>", "<ul><li>x", "<b><i><p>", "<script>", "<svg><g>", "<table><tr><td>", "</p>", "<a x" + " " * 99, "&amp", "<math><mi><p>", "<li><b>", "<dd>", "<select><option>"]
)
def test_work_is_linear(unit):
    """Megabytes of one unit take seconds, alone, behind others and before an end."""
    begun = time.perf_counter()
    n = 500_000 // len(unit)
    for page in (unit * n, "<ul><li>" + unit * n + "</li>", unit * n + "\">'>", unit * (n // 2) + "<li>" * 20000 + "<p>" * 20000):
        html_text.render(page)
    assert time.perf_counter() - begun < 30


def test_deep_lists_within_others_are_linear():
    begun = time.perf_counter()
    html_text.render("<li>" + "<b>" * 30000 + "<ul>" + "<b>" * 30000 + "<li>" * 30000)
    assert time.perf_counter() - begun < 10


FOREIGN = {
    "<body><svg class=\"i\"/><p>text</p>after</body>": "text\n\nafter",
    "a <math/>b": "a b",
    "a <svg viewBox='0 0 1 1'><title/><path d='M0'/><style/></svg>b<p>c": "a b\n\nc",
    "Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be": "Let x=1 be",
    "<math><semantics><mi>x</mi><annotation>\\x</annotation><annotation-xml encoding='text/html'><p>no</p></annotation-xml></semantics><mphantom><mi>y</mi></mphantom></math>": "x",
    "a<math display='block'><mi>x</mi></math>b": "a\nx\nb",
    "<svg><title>no</title>no<defs><text>no</text></defs><g><text x=1>one <tspan>two</tspan></text><text>three</text></g></svg>four": "one two\nthree\nfour",
    "<svg><text display='none'>no</text><text style='display:none'>no</text><text>yes</text></svg>": "yes",
    "<svg><foreignObject><p>in<p>side</foreignObject></svg>out": "in\n\nside\n\nout",
    "<svg class=i/><g><p>text</p>": "text",
    "<svg><text><![CDATA[a > b &amp;]]></text></svg>c": "a > b &amp;\nc",
    "<svg><style>a{}</style><text>t</text></svg>": "t",
    "<table><tr><td><svg/>a<td><math><mi>x</mi></math></table>": "a | x",
    "<template><svg><text>no</text></svg></template>x": "x",
}


@pytest.mark.parametrize("page", FOREIGN)
def test_foreign_content(page):
    assert html_text.render(page) == FOREIGN[page]


def test_foreign_pages_end():
    for page in ("<svg>" * 20000 + "x", "<svg/>" * 20000 + "x", "<svg><text><![CDATA[" * 5000, "<svg><g " + "a=" * 20000 + '"/>x', "<math><mi>" * 5000 + "x"):
        html_text.render(page)


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert html_text.render(page) == CASES[page]


def test_deep_and_broken_pages_end():
    for page in ("<div>" * 20000 + "x", "<table><tr><td>" * 300 + "x", "<" * 20000, "<p title=\"" * 5000, "</b>" * 20000 + "x", "<b>" * 3000 + "</i>" * 3000 + "x", "<ul><li>" * 500 + "x"):
        html_text.render(page)
    assert "x" in html_text.render("<div>" * 20000 + "x")


def test_table_rows(spark):
    rows = [(1, "u", "<p>a"), (None, None, None), (2, "u", ""), (2, "u", "<p>a"), (3, "u", "y" * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars", "2 AS h")
    got = sorted(html_text.extract(df).collect(), key=repr)
    assert len(got) == 5 and [r["n_chars"] for r in got if r["page_id"] == 3] == [300000]
    assert {(r["page_id"], r["text"]) for r in got if r["page_id"] != 3} == {(1, "a"), (None, ""), (2, ""), (2, "a")}
    assert html_text.extract(df.limit(0)).collect() == []


# A plain tree and a recursive layout, to hold the single pass against.


def grow(rnd, depth=0, inside=""):
    """A random list of nodes: text, or (tag, attributes, children)."""
    out = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.choice(["text", "text", "b", "p", "div", "br", "list", "table", "hidden", "blockquote"])
        if kind == "text" or depth > 3:
            out.append(rnd.choice(["", " "]) + " ".join(rnd.choice(["alpha", "b", "cee", "é", "&lt;"]) for _ in range(rnd.randint(1, 3))) + rnd.choice(["", " ", "\n"]))
        elif kind in ("b", "div", "blockquote") or kind == "p" and inside != "p":
            out.append((kind, "", grow(rnd, depth + 1, "p" if kind == "p" or kind == "b" and inside == "p" else "")) if kind != "p" else ("p", "", [rnd.choice([" one", "two ", "three"])]))
        elif kind == "br":
            out.append(("br", "", []))
        elif kind == "list":
            out.append((rnd.choice(["ul", "ol"]), "", [("li", "", grow(rnd, depth + 1)) for _ in range(rnd.randint(1, 3))]))
        elif kind == "table" and inside != "cell":
            cell = lambda: ("td", rnd.choice(["", "", " colspan=2", " rowspan=2"]), [rnd.choice(["x", "long cell", "", "m n"])])
            out.append(("table", "", [("tr", "", [cell() for _ in range(rnd.randint(1, 3))]) for _ in range(rnd.randint(1, 3))]))
        elif kind == "hidden":
            out.append(("span", " hidden", ["no"]))
    return out


def source(nodes):
    return "".join(n if isinstance(n, str) else f"<{n[0]}{n[1]}>" + ("" if n[0] == "br" else source(n[2]) + f"</{n[0]}>") for n in nodes)


def table_lines(rows):
    """By a full grid of cells."""
    grid, out = {}, []
    for y, (_, _, cells) in enumerate(rows):
        x = 0
        for _, attributes, (text,) in cells:
            while (y, x) in grid:
                x += 1
            w, h = (2 if f"{k}span" in attributes else 1 for k in ("col", "row"))
            for dy in range(h):
                for dx in range(w):
                    grid.setdefault((y + dy, x + dx), (text, x, y, w))
            x += w
    starts = sorted({c[1] for c in grid.values()})
    width = {x: max([min(len(c[0]), 40) for c in grid.values() if c[1] == x and sum(x <= s < x + c[3] for s in starts) == 1], default=0) for x in starts}
    for y in range(len(rows)):
        fields, own = [], {c[1]: c for (row, _), c in grid.items() if row == y and c[2] == y}
        if not any(c[0] for c in own.values()):
            continue
        skip = -1
        for x in [x for x in starts if x <= max(own)]:
            if x in own:
                text, _, _, w = own[x]
                covered = [s for s in starts if x <= s < x + w]
                fields.append(text.ljust(sum(width[s] for s in covered) + 3 * (len(covered) - 1)))
                skip = x + w
            elif x >= skip:
                fields.append(" " * width[x])
        out.append(" | ".join(fields).rstrip())
    return out


def plain(nodes):
    lines, state = [], {"line": "", "gap": False, "mark": "", "indent": 0}

    def emit(keep=False):
        if state["line"].strip() or keep:
            if state["gap"] and lines:
                lines.append("")
            lines.append("  " * state["indent"] + state["mark"] + re.sub(" +", " ", state["line"]).strip())
            state["gap"], state["mark"] = False, ""
        state["line"] = ""

    def walk(nodes, lists):
        for n in nodes:
            if isinstance(n, str):
                state["line"] += n.replace("\n", " ").replace("&lt;", "<")
                continue
            tag, attributes, children = n
            if tag == "br":
                emit(keep=True)
            elif tag == "b":
                walk(children, lists)
            elif tag == "table":
                emit()
                made = table_lines(children)
                state["gap"] = True
                for line in made:
                    state["line"] = line.replace(" ", "\0")
                    emit()
                    lines[-1] = lines[-1].replace("\0", " ")
                state["gap"] = True
            elif "hidden" not in attributes:
                before = state["indent"]
                apart = tag in ("p", "blockquote") or tag in ("ul", "ol") and not lists
                emit()
                state["gap"] = state["gap"] or apart
                if tag in ("ul", "ol") and lists or tag == "blockquote":
                    state["indent"] += 1
                for k, child in enumerate(children, 1):
                    if tag in ("ul", "ol"):
                        emit()
                        state["mark"] = f"{k}. " if tag == "ol" else "- "
                        walk(child[2], [*lists, tag])
                        emit()
                        state["mark"] = ""
                    else:
                        walk([child], lists)
                emit()
                state["gap"], state["indent"] = state["gap"] or apart, before

    walk(nodes, [])
    emit()
    text = "\n".join(line.rstrip() for line in lines)
    return re.sub("\n{3,}", "\n\n", text).strip("\n")


@pytest.mark.parametrize("seed", range(8))
def test_random_pages_equal_a_recursive_layout(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        tree = grow(rnd)
        assert html_text.render(source(tree)) == plain(tree), source(tree)
