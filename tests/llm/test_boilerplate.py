import re
from collections import defaultdict

from leafmill.llm import _graph, boilerplate as B

NOTICE = "Reproduced for private study from the reading room at Vask"
CREDIT = "Scanned and proofed by volunteers of the letter hall, all"


def letters(line):
    return "".join(c for c in line.lower() if c.isalpha())


def brute(rows, least=8):
    where = defaultdict(set)
    for i, title, text in rows:
        if i is not None and title is not None and text is not None:
            for line in text.split("\n"):
                if len(letters(line)) >= 30:
                    where[title, letters(line)].add(i)
    return {(i, k) for i, title, text in rows if i is not None and title is not None and text is not None for k, line in enumerate(text.split("\n")) if len(where[title, letters(line)]) >= least and len(letters(line)) >= 30}


def rows():
    found = [(i, "Book", f"Body line number {'abc'[i % 3] * (i + 30)}\n{NOTICE.upper() if i % 2 else '* ' + NOTICE + ' [2]'}\n{CREDIT}\nend") for i in range(9)]
    found += [(100 + i, "Other", NOTICE + "\nx") for i in range(7)]
    return [*found, (200, None, NOTICE), (201, "Book", None), (202, "Book", ""), (None, "Book", NOTICE), (3, "Book", found[3][2])]


def test_found_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows()], "idx bigint, book_title string, snippet string, source string, line_no int")
    got = {tuple(r) for r in B.repeated_lines(docs, "idx", "book_title", "snippet").select("idx", "line_no").collect()}
    assert got == brute(rows()) and len(got) == 18


def test_lines_that_follow_each_other_are_one_block_and_are_removed(spark):
    docs = spark.createDataFrame(rows(), "idx bigint, book_title string, snippet string")
    hits = B.repeated_lines(docs, "idx", "book_title", "snippet").collect()
    assert len({r["block"] for r in hits}) == 1 and {r["support"] for r in hits} == {9}
    clean = B.remove_repeated_lines(docs, "idx", "book_title", "snippet").collect()
    assert len(clean) == len(rows())
    assert all(not re.search("(?i)reproduced|scanned", r["snippet"] or "") for r in clean if r["book_title"] == "Book" and r["idx"] is not None)
    assert [r["snippet"] for r in clean if r["idx"] == 201] == [None]


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_LINES", 0)
    docs = spark.createDataFrame(rows(), "idx bigint, book_title string, snippet string")
    assert {tuple(r) for r in B.repeated_lines(docs, "idx", "book_title", "snippet").select("idx", "line_no").collect()} == brute(rows())


def test_blocks(spark):
    docs = spark.createDataFrame(rows(), "idx bigint, book_title string, snippet string")
    got = B.boilerplate_blocks(docs, "idx", "book_title", "snippet").collect()
    assert [(r["book_title"], r["n_lines"], r["support"]) for r in got] == [("Book", 18, 9)]


def test_empty(spark):
    docs = spark.createDataFrame([], "idx bigint, book_title string, snippet string")
    assert B.repeated_lines(docs, "idx", "book_title", "snippet").collect() == []
    assert B.remove_repeated_lines(docs, "idx", "book_title", "snippet").collect() == []


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23)]
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20}
    assert dict(map(tuple, _graph.connected_components(frame).collect())) == want
    monkeypatch.setattr(_graph, "ONE_TASK_EDGES", 0)
    assert dict(map(tuple, _graph.connected_components(frame).collect())) == want
