"""Text that browsers show: between cells, under spanning cells, in forms and dialogs."""

import pytest

from meterstone.llm.html_layout import extract

CASES = {
    "<table><tbody><tr>Total<td>5</td></tr></tbody></table>": "Total\n5",
    "<table><tr>Total<td>5</td></tr></table>": "Total\n5",
    "<table><tbody><tr><form><td>Name</td><td>Ann</td></form></tr></tbody></table>": "Name  Ann",
    "<table><form><tr><td>Name</td><td>Ann</td></tr><tr><td>Rank</td><td>1</td></tr></form></table>": "Name  Ann\nRank  1",
    "<table><thead><tr><div>note</div><th>A</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>": "note\nA\n1",
    "<table><tbody><tr><form hidden><td>no</td></form><td>yes</td></tr></tbody></table>": "yes",
    "<table><tr><td rowspan=2>left<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>": "left  b  c\n      d  e\nf     g  h",
    "<table><tbody><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>": "a  b  c\nd     e\nf  g",
    "<textarea>a &amp; b\nc</textarea>": "a & b\nc",
    "x <select><option>no<option selected>two<option>no</select> y": "x two y",
    "<select multiple><optgroup><option selected>a<option selected>b</select>": "a b",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<pre>a <select><option>no<option selected>b</select></pre>": "a b",
}


@pytest.mark.parametrize("html", CASES)
def test_shown(html):
    assert extract(html)[1] == CASES[html]


def test_deep_markup_keeps_what_is_shown():
    html = "<div>" * 300 + "<select><option>no<option selected>two</select> <textarea>typed</textarea>"
    text = extract(html)[1]
    assert "two" in text and "typed" in text and "no" not in text
