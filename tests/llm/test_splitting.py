import pytest
from hypothesis import example, given, settings, strategies as st

from leafmill.llm.splitting import cut_points, split_oversized, structure


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n-1é你́‍", min_size=1, max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    ends = cut_points(text, limit, overlap)
    begin = 0
    for k, end in enumerate(ends):
        assert end > begin or len(ends) == 1
        assert end - (max(0, begin - overlap) if k else 0) <= limit
        begin = end
    assert ends[-1] == len(text)


def test_cuts_fall_on_strong_boundaries():
    text = "A heading\n\n" + "One sentence here. " * 8 + "\n\n" + "Another paragraph follows. " * 6
    ends = cut_points(text, 180, 20)
    assert all(text[e - 1].isspace() for e in ends[:-1])
    assert all(text[: e].rstrip().endswith(".") for e in ends[:-1])


def test_rows(spark):
    long = "x" * 3000
    items = spark.createDataFrame([(1, "short", 3, 0), (2, None, None, 0), (3, long, 7, 0), (3, long, 7, 0), (4, "", 1, 0), (None, long, None, 0)], "idx bigint, snippet string, page_number int, piece_no int")
    got = split_oversized(items, "snippet", ["idx", "page_number"]).collect()
    assert {r["idx"] for r in got} == {3, None}
    one = sorted((r["piece_no"], r["piece"], r["page_number"]) for r in got if r["idx"] == 3)[::2]
    assert "".join(p if k == 0 else p[150:] for k, p, _ in one) == long
    assert {p for *_, p in one} == {7}
    assert split_oversized(items.filter("idx = 99"), "snippet", ["idx"]).collect() == []


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        cut_points("abc", 5, 5)


def pieces(text, limit=300, overlap=40):
    ends = cut_points(text, limit, overlap)
    for begin, end in zip([0, *ends], ends):
        assert 0 < end - begin and end - max(0, begin - overlap) * (begin > 0) <= limit
    assert ends[-1] == len(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


WORDS = "the river carries light beyond mountain village garden silent knowledge".split()


@st.composite
def documents(draw):
    """Headings, paragraphs, nested lists and markup in any order, with the lengths to make cuts fall anywhere."""
    out = []
    for _ in range(draw(st.integers(1, 12))):
        kind = draw(st.sampled_from(["#", "##", "CAPS", "chapter", "p", "list", "html", "colon"]))
        n = draw(st.integers(1, 60))
        body = " ".join(WORDS[(n + i) % 10] + ("." if i % 7 == 6 else "") for i in range(n))
        out.append({"#": f"# {body[:30]}", "##": f"## {body[:20]}", "CAPS": body[:25].upper(), "chapter": f"Chapter {n}", "p": body + ".", "colon": body[:40].strip(". ") + ":",
                    "list": "\n".join(f"{'  ' * (i % 3)}- {body[: 10 + 9 * i]}" for i in range(6)), "html": f"<h2>{body[:20]}</h2><ul><li>{body}<li>{body[:50]}</ul><p>{body}"}[kind])
    return draw(st.sampled_from(["\n", "\n\n"])).join(out)


@settings(max_examples=300, deadline=None, derandomize=True)
@example('- river\n  - river\n    - river\n- river\n  - river\n    - river\n# river\n# river\n# river\nbeyond mountain village garden:\n## carries light\n# river\n# river', 120, 48)
@given(documents(), st.integers(120, 500), st.integers(0, 60))
def test_structured_documents(text, limit, overlap):
    pieces(text, limit, overlap)
    ends = cut_points(text, limit, overlap)
    for end in ends[:-1]:
        last, then = text[:end].rstrip().rsplit("\n", 1)[-1], text[end:].lstrip()
        # Only a row of headings may part, and a heading of more than half a piece stand alone.
        if len(last) + 2 <= (limit - overlap) // 2:
            assert not last.startswith("#") or then.startswith(("#", "<h", "Chapter")) or then.split("\n", 1)[0].isupper(), last
            assert not last.rstrip().endswith("</h2>") or then.startswith(("#", "<h", "Chapter")), last


def test_headings_stay_with_their_sections():
    text = "# Part one\n\n" + "A sentence of the body. " * 11 + "\n\n# Part two\n\n" + "Another sentence here. " * 12 + "\n\n## Below\n\n" + "The end of it. " * 5
    got = pieces(text)
    assert not any(p.rstrip().rsplit("\n", 1)[-1].startswith("#") for p in got)
    assert any(p.startswith("# Part two") for p in got) and any("## Below\n\nThe end" in p for p in got)


def test_sections_are_merged_before_they_are_parted():
    text = "# A\n\n" + "x" * 100 + "\n\n# B\n\n" + "y" * 100 + "\n\n# C\n\n" + "z" * 100
    assert [p[2] for p in pieces(text, 260, 20)] == ["A", "C"]


def test_entries_that_fit_are_not_cut():
    text = "The things to bring:\n" + "".join(f"- entry number {i} {'word ' * (5 + 7 * (i % 4))}\n  - below it {'more ' * 6}\n" for i in range(12))
    got = pieces(text)
    assert all(p.startswith(("- entry", "The things")) or p.startswith("  - below") for p in got)
    assert got[0].startswith("The things to bring:\n- entry number 0")
    page = "<h1>Title</h1><ul>" + "".join(f"<li>entry {i} {'word ' * (9 + 5 * (i % 3))}</li>" for i in range(20)) + "</ul><p>After it."
    got = pieces(page)
    assert all(p.count("<li>") == p.count("</li>") for p in got) and got[0].startswith("<h1>Title</h1><ul><li>")
    assert any("<p>After it." in p for p in got)


def test_markup_that_is_not_closed():
    assert [c.name for c in structure("<ul><li>a<li>b</ul><p>c<p>d").children] == ["ul", "p", "p"]
    assert "".join(pieces("<div><p>" + "word " * 200 + "</section><li>" + "x" * 500)) == "<div><p>" + "word " * 200 + "</section><li>" + "x" * 500
