import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import paths as P
from leafmill.operators import chunking as C, dimensions as D, filters as FI, ranking as R, search as S, vectors as V
from leafmill.plans import api, ingest
from leafmill.sources import readers, sinks


def windows(words, size, overlap):
    return [" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap)]


@pytest.mark.parametrize("size,overlap", [(10, 2), (5, 0), (7, 6)])
def test_chunk_words(spark, size, overlap):
    docs = [(n, " \n".join(f"w{i}" for i in range(n))) for n in (0, 1, 4, 8, 9, 10, 11, 18, 40)] + [(99, None)]
    got: dict = {}
    for r in C.chunk_words(spark.createDataFrame(docs, "i int, t string"), "t", ["i"], size, overlap).collect():
        got.setdefault(r["i"], {})[r["chunk_no"]] = r["chunk"]
    for n, t in docs:
        want = windows((t or "").split(), size, overlap)
        assert [got.get(n, {}).get(k) for k in range(len(want))] == want and len(got.get(n, {})) == len(want)


def test_chunk_limits(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    with pytest.raises(ValueError):
        C.chunk_words(df, "t", [], 5, 5)
    assert C.chunk_words(df, "t", [], 2, 5).collect() == []


CHAPTERS = [
    # A text before any heading is the introduction; a title line right below a heading belongs to its title and to its body.
    ("opening words\nChapter I\nThe Beginning\nit began", [("Introduction", "opening words"), ("Chapter I - The Beginning", "The Beginning it began")]),
    # Of two headings in a row the upper has no body and goes.
    ("PART 2 Now\nBOOK II\nsome words", [("BOOK II - some words", "some words")]),
    # Lines of digits are page numbers: no body, and no title.
    ("ALL CAPS\n12\nthe body\n7", [("ALL CAPS", "the body")]),
    # An empty line below a heading leaves its title alone.
    ("Chapter 3 of it\n\nfirst\n  second line ", [("Chapter 3 of it", "first second line")]),
    # 'Chapter' alone and one capital alone are no headings.
    ("Chapter\nA\nend", [("Introduction", "Chapter A end")]),
    ("BOOK I\nwords\nBOOK II", [("BOOK I - words", "words")]),
    ("  THE SEA  \nbelow", [("THE SEA - below", "below")]),
    ("", []), ("\n\n", []), ("PART 1\n4", []), ("just text", [("Introduction", "just text")]),
]


def test_chapters(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CHAPTERS)], "i int, t string")
    got: dict = {}
    for r in C.chapter_chunks(docs, "i", "t", 50, 2).orderBy("i", "chunk_no").collect():
        got.setdefault(r["i"], []).append((r["title"], r["chunk"]))
    for i, (text, want) in enumerate(CHAPTERS):
        assert got.get(i, []) == want, text


def test_chapter_properties(spark):
    random.seed(3)
    pool = ["Chapter I", "The Beginning", "PART 2 Now", "BOOK II", "ALL CAPS", "12", "", "some words here", "  indented line ", "Chapter", "A"]
    docs = [(i, "\n".join(random.choices(pool, k=random.randrange(1, 15)))) for i in range(120)]
    got: dict = {i: [] for i, _ in docs}
    for r in C.chapter_chunks(spark.createDataFrame(docs, "i int, t string"), "i", "t", 1000, 0).orderBy("i", "chunk_no").collect():
        got[r["i"]].append((r["title"], r["chunk"]))
    headings = {"Chapter I", "PART 2 Now", "BOOK II", "ALL CAPS"}
    for i, t in docs:
        # All body lines come out once and in order; every title is a heading of the text, or the introduction.
        body = " ".join(x for x in t.split("\n") if x.strip() not in headings | {"12"})
        assert " ".join(c for _, c in got[i]).split() == body.split()
        assert all(title == "Introduction" or title.split(" - ")[0] in headings & set(t.split("\n")) for title, _ in got[i])


def test_pages(spark):
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("g", 1, None)], "file string, page_number int, text string")
    assert {r["file"]: r["text"] for r in C.concat_pages(df, "file").collect()} == {"f": "ab", "g": ""}
    assert {r["file"]: r["pages"] for r in C.collect_pages(df, "file").collect()}["f"] == {1: "a", 2: "b"}
    spans = spark.sql("SELECT array(named_struct('text', 'BIG', 'size', 15.0D), named_struct('text', 'Big', 'size', 15.0D), named_struct('text', 'SMALL', 'size', 9.0D)) AS s, array(14.0D, 15.0D) AS z")
    assert spans.select(C.heading_by_size(F.col("s")), C.heading_by_mean_size(F.col("z"))).first()[:] == (["BIG"], True)


CHUNKS = [
    (0, "The ancient river runs.", "CWSA", 5, 3), (1, "River of the ancient, the dance,", "CWM", 9, None), (2, "An ancient river there.", "CWM", 9, 1), (3, "the river is ancient", None, None, 2), (4, None, "CWSA", 1, 1), (5, "", "CWSA", 1, 1), (6, "nothing of note in this one", "CWSA", 7, 1), (7, "tiny", "CWM", 99, 1),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, s, g, p, n, "a" if i % 2 else None, f"t{i}", None, f"x/{i}.pdf", None) for i, s, g, p, n in CHUNKS]
    return spark.createDataFrame(rows, "idx bigint, snippet string, `group` string, priority int, page_number int, author string, book_title string, chapter_name string, file_path string, pdf_url string")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [math.cos(i / 3), math.sin(i / 3)]) for i in range(8)] + [(50, [1.0, 0.0]), (51, None), (52, [0.0, 0.0])]
    return spark.createDataFrame(rows, "idx bigint, embedding array<float>")


def ids(df):
    return [r["idx"] for r in df.collect()]


def test_lexical(chunks):
    assert sorted(ids(S.exact_match(chunks, "the  ANCIENT river"))) == [0]
    assert sorted(ids(S.all_words_match(chunks, "the ancient river"))) == [0, 3]  # 'ancient,' is another token
    assert sorted(ids(S.all_words_match(chunks, "the ancient river", substrings=True))) == [0, 1, 2, 3]
    assert sorted(ids(S.all_words_match(chunks, "the ancient river", exclude=S.exact_match(chunks, "the ancient river")))) == [3]
    assert ids(S.exact_match(chunks, "tiny")) == [7] and ids(S.exact_match(chunks, "tiny", min_snippet=100)) == []
    assert "<mark>" in S.exact_match(chunks, "tiny").first()["snippet"]
    assert sorted(ids(S.exact_match(chunks, "ancient", {"group": "CWM", "author": ""}))) == [1, 2]
    assert ids(FI.apply_filters(chunks, {"no such column": "x"})) == []
    assert ids(FI.raw_positions(chunks, "snippet", "River")) == [1] and ids(FI.path_contains(chunks, "/6")) == [6]


def test_defaults(chunks):
    row = S.exact_match(chunks, "river is").first()
    assert (row["author"], row["group"], row["chapter_name"], row["page_number"], row["priority"], row["pdf_url"]) == ("a", "Unknown", "N/A", "2", 0, "")


def test_vectors(vectors):
    q = [1.0, 0.0]
    assert ids(V.knn(vectors, q, 3)) == [0, 50, 1]
    assert ids(V.knn(vectors, q, 2, "l2")) == [0, 50]
    assert V.knn(vectors, q, 100).count() == 10
    got = {r["idx"]: r["u"] for r in vectors.select("idx", V.normalized(F.col("embedding")).alias("u")).collect()}
    assert got[52] == [0.0, 0.0] and got[51] is None
    assert V.distance_stats(vectors, q).first()["max_score"] == pytest.approx(1.0)
    many = V.knn_many(vectors, vectors.filter("idx in (0, 3)").select(F.col("idx").alias("query_id"), F.col("embedding").alias("query_vector")), 2).collect()
    assert len(many) == 4 and {(r["query_id"], r["rank"], r["idx"]) for r in many} >= {(0, 1, 0), (0, 2, 50), (3, 1, 3)}
    assert np.linalg.norm(V.query_embedding("some words")) == pytest.approx(1) and V.hash_embedding("") == [0.0] * V.DIMENSION
    with pytest.raises(ValueError):
        V.knn(vectors, q, 0)
    with pytest.raises(KeyError):
        V.stored_vector(vectors, 51)


def test_hybrid(chunks, vectors):
    q = [1.0, 0.0]
    got = S.search(chunks, vectors, S.Request("the ancient river", 5), q).collect()
    assert [(r["idx"], r["category_priority"]) for r in got] == [(0, 1), (3, 3), (1, 4), (2, 4), (6, 4)]  # 7 is too short
    assert not {r["idx"] for r in got} & {50, 4, 5}
    promoted = S.search(chunks, vectors, S.Request("the ancient river", 5), q, promote=True).collect()
    assert [(r["idx"], r["category_priority"]) for r in promoted][:2] == [(0, 1), (3, 2)]
    near = S.search(chunks, vectors, S.Request("the ancient river", 2, "semantic"), q).collect()
    assert [r["priority"] for r in near] == [9, 5] and [r["category_priority"] for r in near] == [4, 4]
    assert S.search(chunks, vectors, S.Request("x", 2, "fuzzy"), q).collect() == []
    assert [r["category_priority"] for r in S.search(chunks, vectors, S.Request("ancient", 9, "exact"), q).collect()] == [1] * 4
    few = S.semantic_match(chunks, vectors, "x", q, 1, {"group": "CWM"}, 0).collect()
    assert len(few) <= 1
    assert len(S.semantic_match(chunks, vectors, "x", q, 1, {"group": "CWM"}, 0, overfetch=None).collect()) == 3
    plan = S.search(chunks, vectors, S.Request("the ancient river", 5), q)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_variants(chunks, vectors):
    q = [1.0, 0.0]
    assert [r["idx"] for r in S.legacy_search(chunks, vectors, "ancient", q, 3).collect()] != []
    assert S.quota_search(chunks, vectors, "ancient river", q, 4).count() == 4
    both = ids(S.union_search(chunks, vectors, "ancient", q, 8))
    assert len(both) > len(set(both))
    assert R.pager_window(1, 9) == [1, 2, 3, 4, 5] and R.pager_window(9, 9) == [5, 6, 7, 8, 9] and R.pager_window(5, 9) == [3, 4, 5, 6, 7] and R.pager_window(2, 3) == [1, 2, 3]
    assert R.page_count(11, 10) == 2


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": "  "}, {"query": "x", "top_k": "0"}, {"query": "x", "top_k": "-1"}, {"query": "x", "top_k": "x"}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        api.parse_request(bad)


def test_good_request():
    r = api.parse_request({"query": "x", "author": "", "group": "CWM", "search_type": None})
    assert (r.top_k, r.search_type, r.filters) == (100, "all", {"group": "CWM"})
    assert api.toggle_mode("exact", "exact") == "all" and api.toggle_mode("all", "exact") == "exact"


def test_books(spark, data):
    books = spark.createDataFrame([("1.pdf", "B", "z", "CWM", 3), ("2.pdf", "A", "y", "Zeta", 4), ("3.pdf", "B", None, "CWSA", None), ("4.pdf", "C", "y", "Annex", 1)], "pdf_filename string, book_title string, author string, `group` string, priority int")
    assert [r["group"] for r in D.facet_groups(books).collect()] == ["CWSA", "CWM", "Annex", "Zeta"]
    assert [r["book_title"] for r in D.titles_flat(books).collect()] == ["B", "B", "C", "A"]
    row = D.facets(books).first()
    assert row["authors"] == ["y", "z"] and row["groups"] == ["CWSA", "CWM", "Annex", "Zeta"] and row["titles_by_group"]["CWM"] == ["B"]
    found = D.lookup_books(spark.createDataFrame([("a/b/1.pdf",), ("x/3.pdf",), ("none.pdf",), (None,)], "file_path string"), books)
    assert {(r["file_path"], r["author"], r["priority"]) for r in found.collect()} == {("a/b/1.pdf", "z", 3), ("x/3.pdf", "Unknown", 999), ("none.pdf", "Unknown", 999), (None, "Unknown", 999)}
    made = D.books_from_files(spark.createDataFrame([("r/disciples/03-04CollectedPlays.pdf",), ("r/x/x_y-it's.pdf",), ("r/x/no.txt",)], "path string"))
    assert {(r["book_title"], r["group"], r["author"]) for r in made.collect()} == {("04Collected Plays", "Disciples", "Disciples"), ("X Y It'S", "CWSA", "X")}


def test_paths(spark):
    df = spark.createDataFrame([("/r/a b/c.pdf", "https://h/x y.pdf#page=12", 12)], "p string, u string, n int")
    row = df.select(P.page_url("https://h/", "/r", F.col("p"), F.col("n")), P.url_without_page(F.col("u")), P.url_page(F.col("u")), P.url_page(F.col("p")), P.encode_uri(F.col("u")), P.viewer_link(F.col("p"), F.col("n"), F.lit("a b&c"))).first()
    assert row[:] == ("https://h/a b/c.pdf#page=12", "https://h/x y.pdf", 12, 1, "https://h/x%20y.pdf#page=12", "viewer.html?file=%2Fr%2Fa%20b%2Fc.pdf#page=12&search=a%20b%26c")


def test_files_to_index_and_back(spark, tmp_path):
    (tmp_path / "in" / "CWM").mkdir(parents=True)
    (tmp_path / "in" / "CWM" / "1.pdf").write_text("A TITLE\nfirst page words\fsecond page", encoding="utf-8")
    (tmp_path / "in" / "2.PDF").write_bytes(b"only page \xff")
    (tmp_path / "in" / "n.txt").write_text("Chapter I\nwords of the chap-\nter here", encoding="utf-8")
    files = readers.pdf_files(spark, str(tmp_path / "in"))
    assert files.count() == 2 and readers.pdf_files(spark, str(tmp_path / "in"), any_case=False).count() == 1
    assert readers.pdf_file(spark, str(tmp_path / "in"), "CWM/1.pdf").count() == 1
    pages = readers.pages(files, readers.plain_pages)
    books = spark.createDataFrame([("1.pdf", "One", "me", "CWM", 1)], "pdf_filename string, book_title string, author string, `group` string, priority int")
    made = ingest.chunks_from_pages(pages, books, "https://h", f"file:{tmp_path}/in", 2, 1)
    assert sinks.write_index(made, str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r["idx"] for r in back.collect()) == list(range(back.count()))
    assert {r["chapter_name"] for r in back.filter("book_title = 'One' and page_number = 1").collect()} == {"A TITLE"}
    assert not sinks.write_index(made.filter("idx < 0"), str(tmp_path / "none"))
    texts = ingest.chunks_from_texts(readers.text_files(spark, str(tmp_path / "in")), "https://h", f"file://{tmp_path}/in")
    assert [(r["snippet"], r["chapter_name"], r["page_number"]) for r in texts.collect()] == [("words of the chapter here", "Chapter I - words of the chapter here", 1)]
    sinks.write_paths(back, str(tmp_path / "paths"))
    assert len((spark.read.text(str(tmp_path / "paths"))).collect()) == back.count()
    (tmp_path / "m.json").write_text('[{"snippet": "a", "page_number": 3}, {"snippet": null, "group": "g"}]', encoding="utf-8")
    assert [(r["idx"], r["snippet"], r["group"]) for r in readers.json_chunks(spark, str(tmp_path / "m.json")).collect()] == [(0, "a", None), (1, None, "g")]
    (tmp_path / "b.json").write_text('{"1.pdf": {"book_title": "One", "tags": ["x"], "year": 1990}}', encoding="utf-8")
    assert readers.json_books(spark, str(tmp_path / "b.json")).first()["tags"] == ["x"]
    with pytest.raises(FileNotFoundError):
        readers.EngineConfig.from_environment({"FAISS_INDEX_PATH": "/nowhere"})
    with pytest.raises(ValueError):
        readers.pdf_file(spark, "/tmp", "../etc/passwd")


def test_ids_without_one_task(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int").repartition(5)
    got = ingest.with_ids(df, ["a", "b"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(200)) and [(r["a"], r["b"]) for r in got] == sorted((i % 7, i) for i in range(200))


def test_ids_are_dense_and_repeatable_at_size(spark, tmp_path):
    n = 400_000
    df = spark.range(n).select(F.xxhash64("id").alias("key"), (F.col("id") % 3).alias("third"), F.sha2(F.col("id").cast("string"), 512).alias("payload"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    seen = []
    for k in range(2):
        path = str(tmp_path / f"ids{k}")
        ingest.with_ids(df, ["third"]).write.parquet(path)  # a third of all rows has one key
        got = spark.read.parquet(path)
        assert got.agg(F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()[:] == (n, n, 0, n - 1)
        seen.append(got.agg(F.sum(F.xxhash64("idx", "key").cast("decimal(38,0)"))).first()[0])
    assert seen[0] == seen[1]


def test_merged_pages(spark):
    one = spark.createDataFrame([(2, "b"), (1, "a")], "page_number int, text string")
    two = spark.createDataFrame([(1, "c"), (5, "d")], "page_number int, text string")
    got = C.merge_pages(one, two).orderBy("page_number").collect()
    assert [(r["page_number"], r["text"]) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert C.merge_pages(one.filter("page_number > 9")).collect() == []


def test_broken_files_are_counted_and_logged(spark, tmp_path):
    def extract(content):
        yield 1, content.decode("utf-8"), []
        if b"broken" in content:
            raise RuntimeError("no second page")

    files = spark.createDataFrame([("a", b"broken"), ("b", b"fine"), ("c", b"\xff"), ("d", None)], "path string, content binary")
    failed = spark.sparkContext.accumulator(0)
    got = readers.pages(files, extract, failed).collect()
    assert sorted((r["path"], r["text"]) for r in got) == [("a", "broken"), ("b", "fine")] and failed.value == 3


def test_written_texts_books_and_page_maps(spark, tmp_path):
    """K3, K4, K5, Q16, Q17."""
    pages = spark.createDataFrame([("/in/lib/x/a.pdf", 2, "two\ufb01", ["H"]), ("/in/lib/x/a.pdf", 1, "one", None), ("/in/lib/y/a.pdf", 1, "", [])], "path string, page_number int, text string, headings array<string>")
    texts = ingest.page_texts(pages, "/in/lib")
    assert sorted((r["file"], r["page_number"], r["text"]) for r in texts.collect()) == [("x/a.pdf", 1, "one"), ("x/a.pdf", 2, "twofi"), ("y/a.pdf", 1, "")]
    sinks.write_page_maps(texts, str(tmp_path / "maps"))
    assert {r["file"]: r["pages"].asDict() for r in spark.read.json(str(tmp_path / "maps")).collect()}["x/a.pdf"] == {"1": "one", "2": "twofi"}
    whole = C.concat_pages(texts, "file", separator="\n")
    sinks.write_texts(whole, str(tmp_path / "texts"))
    back = spark.read.format("text").option("wholetext", True).load(str(tmp_path / "texts")).collect()
    assert {r["file"]: r["value"].strip() for r in back} == {"x/a.pdf": "one\ntwofi"}  # an empty text is left out
    books = D.books_from_files(pages.select("path"), folders={"x": ("G", "about x")})
    sinks.write_books(books, str(tmp_path / "books"))
    assert {(r["pdf_filename"], r["group"], r["description"], r["priority"]) for r in spark.read.json(str(tmp_path / "books")).collect()} == {("a.pdf", "CWSA", "", 99)}  # the last path wins
    vectors = ingest.vectors_from_texts(spark.createDataFrame([("b.txt", "some words"), ("a.txt", ""), ("c.txt", None)], "path string, text string")).orderBy("idx").collect()
    assert [(r["idx"], r["file_path"]) for r in vectors] == [(0, "a.txt"), (1, "b.txt"), (2, "c.txt")]
    assert set(vectors[0]["embedding"]) == {0.0} and sum(x * x for x in vectors[1]["embedding"]) == pytest.approx(1) and vectors[2]["embedding"] is None


def test_response_envelope(chunks, vectors):
    import json

    got = api.get_response(chunks, vectors, {"query": "ancient river", "top_k": "3"}, [1.0, 0.0]).collect()
    assert len(got) == 1
    rows = json.loads(got[0]["json"])["results"]
    assert len(rows) == 3 and [r["category_priority"] for r in rows] == sorted(r["category_priority"] for r in rows) and "idx" not in rows[0]
    assert json.loads(api.get_response(chunks, vectors, {"query": "nowhere", "search_type": "exact"}).first()["json"]) == {"results": []}


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("sent", [True, False])
def test_many_queries_equal_brute_force(spark, metric, sent, monkeypatch):
    random = np.random.default_rng(4)
    v = random.integers(-3, 4, (300, 4)).astype(float)  # small whole numbers make many ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0]), (None, [1.0] * 4), (902, [float("nan")] * 4)]
    stored = spark.createDataFrame(rows, "idx bigint, embedding array<double>")
    asked = stored.filter("idx < 20 OR idx > 899").selectExpr("idx AS query_id", "embedding AS query_vector")
    if not sent:
        monkeypatch.setattr(V, "QUERY_BYTES", 0)
        monkeypatch.setattr(V, "BLOCK", 50)
    got = sorted((r["query_id"], r["rank"], r["idx"], r["score"]) for r in V.knn_many(stored, asked, 7, metric).collect())
    want = []
    for q in range(20):
        score = v @ v[q] if metric == "ip" else ((v - v[q]) ** 2).sum(axis=1)
        order = sorted(range(300), key=lambda i: (score[i] if metric == "l2" else -score[i], i))[:7]
        want += [(q, rank, i, float(score[i])) for rank, i in enumerate(order, 1)]
    assert got == want
    with pytest.raises(ValueError):
        V.knn_many(stored, asked, 0)


def test_first_vector(vectors):
    assert V.first_vector(vectors.filter("idx > 50").unionByName(vectors.filter("idx = 3").withColumn("idx", F.lit(5000).cast("bigint")))) == pytest.approx([math.cos(1), math.sin(1)])
    with pytest.raises(ValueError):
        V.first_vector(vectors.filter("idx > 50"))
    with pytest.raises(ValueError):
        V.array_literal([float("nan")])


def test_streaming(spark, tmp_path):
    from leafmill.streaming import requests as RS

    rows = spark.sql("SELECT CAST(id % 3 AS BIGINT) AS request_id, 'q' AS query, 1 AS top_k, 'all' AS search_type, '' AS author, '' AS `group`, '' AS book_title, timestamp_ntz'2024-03-01 00:10:00' AS requested_at, timestamp_ntz'2024-03-01 00:10:00' AS received_at FROM range(6)")
    rows.write.parquet(str(tmp_path / "in" / "requests.parquet"))
    got = RS.run_once(RS.hourly_counts(RS.request_stream(spark, str(tmp_path / "in"), "*.parquet")), str(tmp_path / "hourly"), "complete", str(tmp_path / "cp")).collect()
    assert [(r["search_type"], r["n"]) for r in got] == [("all", 3)]
    RS.append_chunks(RS.request_stream(spark, str(tmp_path / "in"), "*.parquet"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_hourly_totals_keep_late_rows(spark, tmp_path):
    from leafmill.streaming import requests as RS

    def run(*rows):
        log = spark.createDataFrame(rows, "request_id bigint, search_type string, requested_at string")
        log.withColumn("requested_at", F.col("requested_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = RS.request_stream(spark, str(tmp_path / "in"), "*")
        got = RS.run_once(RS.hourly_totals(stream), str(tmp_path / "totals"), "complete", str(tmp_path / "cp")).collect()
        return {(str(r["hour"])[5:13], r["search_type"]): r["n"] for r in got}

    assert run((1, "all", "2024-03-01 00:10:00"), (2, "all", "2024-03-20 05:00:00")) == {("03-01 00", "all"): 1, ("03-20 05", "all"): 1}
    assert run((1, "all", "2024-03-01 00:10:00"), (3, "all", "2024-03-01 00:20:00")) == {("03-01 00", "all"): 2, ("03-20 05", "all"): 1}
