import pytest

from meterstone.llm.html_layout import extract, visible_text

CASES = {
    "<p>One<p>Two <b>bold</b>text": "One\n\nTwo boldtext",
    "a<div>b</div>c": "a\nb\nc",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>": "- a\n- b\n\n  3. x\n  4. y",
    "<table><tr><th>Name<th>N<tr><td>foo<td>1<tr><td>longer<td>22</table>": "Name    N\nfoo     1\nlonger  22",
    "<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>": "wide cell     z\na          b  c",
    "x<script>var a = '</p>';</script>y<style>p{}</style>z": "xyz",
    "<div style='display: none'>no</div><p hidden>no<p aria-hidden=true>no<p>yes": "yes",
    "<pre>\n a  b\n  c</pre>": " a  b\n  c",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "&lt;x&gt; &amp; &eacute;&nbsp;!": "<x> & é\xa0!",
    "<!-- no --><title>T</title>text": "text",
    "<blockquote>said<p>more</blockquote>": "  said\n\n  more",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "a < b and c > d": "a < b and c > d",
    "<img alt='a picture'> here": "a picture here",
    "one  \n two": "one two",
    "<td>loose</td>text": "loosetext",
    "</p>x</div></div>": "x",
    "<select><option>first<option>no</select> after": "first after",
    "<select multiple><option>no</select>after": "after",
    "<select><option hidden>no<option>shown</select> after": "shown after",
    "<input type=password value=secret><input type=CHECKBOX value=on><input type=radio value=1>x": "x",
    "<input type=color value=#fff><input type=range value=5><input type=file value=f><input type=hidden value=h>x": "x",
    "<input type=image alt=Go value=no> <input type=submit value=Send> <input value=text>": "Go Send text",
    "<details><summary>More</summary>body<p>text</details>x": "More\nx",
    "<details open><summary>More</summary>body</details>x": "More\nbody\nx",
    "<details>no</details>x": "x",
    "<div style='visibility:hidden'>no<b>no</b><i style='visibility: visible'>yes</i><img alt=no></div>": "yes",
    "<div style='visibility:collapse'>no<select><option>no</select><p style='visibility:inherit'>no</div>x": "x",
    "<p style=\"background:url(display:none.png)\">shown": "shown",
    "<p style=\"content:';display:none'\">shown": "shown",
    "<p style='display:none;display:block'>shown": "shown",
    "<p style='display:none!important;display:block'>no<p>x": "x",
    "<p style='color:red; DISPLAY : None'>no<p>x": "x",
    "<a href='x' title=\"a > b\">link</a>": "link",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert extract(html)[1] == CASES[html]


def test_title():
    assert extract("<html><head><title>A &amp;\n B</title></head><p>x")[0] == "A & B"
    assert extract("<p>x")[0] is None


@pytest.mark.parametrize(
    "html",
    ["<div>" * 50_000 + "deep", "<" * 20_000, "<a " * 20_000, "<table><tr><td>" * 400 + "x", "<li>" * 5000, "<!--", "<td colspan=" + "9" * 5000 + ">x", "<b" + "\x00" * 9, "&#xD800;&#0;"],
)
def test_broken_pages_render(html):
    title, text = extract(html)
    assert title is None and text.encode().decode() == text
    assert "deep" not in html or "deep" in text


def test_frames(spark):
    rows = spark.createDataFrame(
        [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None), (2, "", "")], "page_id long, html string, text string"
    )
    out = visible_text(rows)
    assert out.columns == ["page_id", "html", "text", "page"]
    assert sorted(r.page.text for r in out.collect()) == ["", "", "a", "a"]
    assert visible_text(rows.where("false")).collect() == []
