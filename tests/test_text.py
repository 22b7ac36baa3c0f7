import re
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as TX

WILD = ["ﬁre “x” ‘y’ – — … ″", " a   b\x1cc\x85 d​e ", "İstanbul", "", " ", None, "dance! c++ a.b", "ＡＢＣ １２", "line\none\n\ntwo", "Ὀδυσσεύς", "क़ é"]


def brute_prepare(t):
    if t is None:
        return None
    t = unicodedata.normalize("NFKC", t)
    for a, b in zip(TX.QUOTES, TX.PLAIN):
        t = t.replace(a, b)
    return " ".join(t.split()).lower()


def test_normalize_and_prepare_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(WILD)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", TX.prepare_text(F.col("t")).alias("p"), TX.normalize_text(F.col("t"), False).alias("n"), F.size(TX.tokens(TX.prepare_text(F.col("t")))).alias("k")).collect()}
    for i, t in enumerate(WILD):
        assert got[i]["p"] == brute_prepare(t) == TX.prepare(t)
        assert got[i]["n"] == (None if t is None else unicodedata.normalize("NFKC", t))
        assert t is None or got[i]["k"] == len(brute_prepare(t).split())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_prepare_equals_definition(t):
    assert TX.prepare(t) == brute_prepare(t)


def test_highlight():
    assert TX.highlight("The  Art of art, heart", "art") == "The  <mark>Art</mark> of <mark>art</mark>, heart"
    assert TX.highlight("ﬁre and water", "fire and") == "<mark>ﬁre and</mark> water"
    assert TX.highlight("a.b axb", "a.b") == "<mark>a.b</mark> axb"
    assert TX.highlight("dance! now", "dance!") == "dance! now"  # a mark needs a word character behind the query's '!'
    assert TX.highlight("", "x") == "" and TX.highlight("x", " ") == "x"
    assert TX.highlight("… river", "river", parity=True) != TX.highlight("… river", "river")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc .'", max_size=60), st.text(alphabet="abc.", min_size=1, max_size=4))
def test_highlight_on_plain_text(t, q):
    flat = " ".join(t.split())
    assert TX.highlight(flat, q) == re.sub(r"\b" + re.escape(q.strip()) + r"\b", lambda m: f"<mark>{m.group()}</mark>", flat)
    assert TX.highlight(flat, q).replace("<mark>", "").replace("</mark>", "") == flat


def test_highlight_legacy(spark):
    df = spark.createDataFrame([("C++ and c++ heart Art",)], "t string")
    assert df.select(TX.highlight_plain(F.col("t"), "c++")).first()[0] == "<mark>C++</mark> and <mark>c++</mark> heart Art"
    assert df.select(TX.highlight_plain(F.col("t"), "art")).first()[0] == "C++ and c++ he<mark>art</mark> <mark>Art</mark>"


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("a & b", "a &amp; b"), ("1 < 2 > 0", "1 &lt; 2 &gt; 0"), ("<b>bold</b>", "bold"), ("x<br/>y<br>z", "x<br>y<br>z"), ("<mark class='q'>a", "<mark>a</mark>"), ("<script>alert(1)</script>", "alert(1)"), ("a<!-- no -->b", "ab"), ("</mark>x", "x"), (None, None), ("plain", "plain"),
    ],
)
def test_sanitize(raw, clean):
    assert TX.sanitize(raw) == clean


def brute_lines(text, query):
    lines, words = text.split("\n"), brute_prepare(query).split()
    hits = [i for i, x in enumerate(lines) if any(w in brute_prepare(x) for w in words)]
    if not hits:
        found = TX.highlight(text[:500], query)
    else:
        a, b = max(0, hits[0] - 5), min(len(lines), hits[-1] + 6)
        found = "\n".join(TX.highlight(x, query) for x in lines[a:b])
        if len(found) < 200:
            found = "\n".join(TX.highlight(x, query) for x in lines[max(0, a - 5) : min(len(lines), b + 5)])
    return TX.sanitize(found.replace("\n", "<br/>"))[:500]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the light of day", "x < y", "river", "a long line that has nothing in it at all", ""]), min_size=1, max_size=40))
def test_snippet_lines(lines):
    text = "\n".join(lines)
    assert TX.snippet_lines(text, "light river") == brute_lines(text, "light river")
    assert len(TX.snippet_lines(text, "light")) <= 500


def test_other_snippets(spark):
    text = "\n".join(f" line {i} " for i in range(30))
    assert TX.snippet_first_line(text, "line 15").count("<br>") == 9 + 10  # too short, so five more on each side
    assert TX.snippet_first_line("nothing here", "zzz") == "nothing here"
    assert TX.snippet_sentences("One. Two has it. Three! Four? Five. Six.", "two has") == "One. <mark>Two has</mark> it. Three! Four? Five. Six."
    assert all(f(None, "x") is None for f in TX.SNIPPETS.values())
    df = spark.createDataFrame([("the river\nruns",), (None,)], "t string")
    assert [r[0] for r in df.select(TX.snippet(F.col("t"), "river")).collect()] == ["the <mark>river</mark><br>runs", None]
    assert isinstance(pd.Series([1]), pd.Series)


def test_built_in_and_python_forms_agree(spark):
    """T20 and T22 in the JVM give what the definitions give, whatever the text."""
    rows = ["", "of the", "OF  the\tend", "rooftop of them", "of\nthe", "of the—of the", "x of the’s", "of_the of the_", "ﬁne of the", "ｏｆ ｔｈｅ", "a < b of the", "of the é of thé", "of the" + "\u0301", "of\xa0the",
            "\n".join(f"line {i} of the day" if i in (7, 30) else f"line {i}" for i in range(50)), "\n".join("words" for _ in range(40)), "head\n\n\nof the", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    for query in ("of the", "“of", "line 7", "the", "(", "é"):
        got = {r["i"]: (r["h"], r["s"]) for r in df.select("i", TX.highlighted(F.col("t"), query).alias("h"), TX.snippet(F.col("t"), query).alias("s")).collect()}
        for i, t in enumerate(rows):
            assert got[i] == ((None, None) if t is None else (TX.highlight(t, query), TX.snippet_lines(t, query))), (query, t)
