from __future__ import annotations

from wareflow.llm import warc


def test_a_stray_less_than_is_text():
    cases = {
        "<p>if 3 < 5 then stop</p><p>a whole paragraph</p><p>more <b>x</b></p>": "if 3 < 5 then stop\na whole paragraph\nmore x",
        "<p>a <3 b <= c << d </3 e</p><p>f": "a <3 b <= c << d </3 e\nf",
        "x <": "x <",
        '<p title="a > b">one <img alt=\'c > <br> d\'>two</p>three': "one two\nthree",
        '<a href="x>one</a><br/>two': "one\ntwo",
        "<!DOCTYPE html><?xml v?><P>one<BR>t<i>w</i>o</ p></p>": "one\ntwo</ p>",
        "<p class=it's>one</p><p>it's</p>": "one\nit's",
    }
    assert {source: warc.plain_text(source) for source in cases} == cases
