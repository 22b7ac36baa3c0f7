from leafmill.llm import lookalikes as L

SCHEMA = "idx bigint, snippet string, book_title string, field string, value string"
CLEAN = [
    "plain words, “quoted” – and — dashed ‐ done", "tab\tand\nline\r\n", "это слова целиком", "ψυχανία φωτερά", "中文，标点！？「好」", "日本語。", "می‌رود خانه‌ها", "सत्‌य क्‍ष", "র‍্য", "👩‍🌾 🙏🏽", "śamāra ñ é", "բարեւ և", "ภาษาไทย น้ำ", "हिन्दी बड़ा", "", "x½…™",
]
DIRTY = {
    "ｗｏｒｄ": "word", "ﬁne oﬀer": "fine offer", "１７７": "177", "café": "caf\xe9", "dāṛk": "dāṛk", "a​b": "ab", "fe\xadar": "fear", "so ft": "so ft", "in the\xa0way": "in the way",
    "cross‌ing": "crossing", "﻿start": "start", "vаst": "vast", "Τhe": "The", "сyber": "cyber", "anϲient": "ancient", "очeнь": "очень", "moοn": "moon", "nօt": "not", "ｔhе": "the",
    "th e": "th e", "ｃａｆé": "caf\xe9",
}


def frame(spark):
    rows = [(i, t, None, "clash", "clash") for i, t in enumerate(CLEAN)]
    rows += [(100 + i, t, "Title", "clash", "clash") for i, t in enumerate(DIRTY)]
    rows += [(500, None, "Τitle", None, None), (None, "ﬁ", None, None, None), (500, None, "Τitle", None, None), (501, "word " * 20_000, "ok", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_found(spark):
    got = {tuple(r) for r in L.changed_values(frame(spark), ["snippet", "book_title"], "idx").collect()}
    assert got == {(100 + i, "snippet") for i in range(len(DIRTY))} | {(500, "book_title"), (None, "snippet")}


def test_one_form(spark):
    got = {r["idx"]: r["snippet"] for r in L.unify(frame(spark), ["snippet", "book_title"], ["idx"]).collect()}
    assert {t: got[i] for i, t in enumerate(CLEAN)} == {t: t for t in CLEAN}
    assert {t: got[100 + i] for i, t in enumerate(DIRTY)} == DIRTY
    assert got[500] is None and len(got[501]) == 100_000


def test_rewriting_twice_changes_nothing(spark):
    rewrite = L.Rewriter({})
    for t in [*CLEAN, *DIRTY]:
        assert rewrite(rewrite(t)) == rewrite(t)


def test_classes_are_transitive():
    c = L.look_alikes()
    assert c.find("ａ") == c.find("а") == c.find("α") == c.find("a") and c.find("ﬁ") == c.find("fi")


def test_empty(spark):
    assert L.changed_values(frame(spark).filter("idx = -1"), ["snippet"], "idx").collect() == []
    assert L.unify(frame(spark).filter("idx = -1"), ["snippet"], ["idx"]).collect() == []


def test_the_filter_leaves_no_changed_value_out(spark):
    """Every string that the automaton rewrites, alone and inside a word, is found; so is every value that unify changes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rewriter = L.Rewriter({})
    pattern = rewriter.suspect()
    keys = sorted(key for key, _ in rewriter.automaton.items())
    texts = [t for key in keys for t in (key, f"wo{key}rd", f"αβ{key}", f"да{key} x", f"{key}ա")]
    hit = pc.match_substring_regex(pa.array(texts), pattern).to_pylist()
    missed = [t for t, h in zip(texts, hit) if not h and rewriter(t) != t]
    assert missed == []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["\u1fbb", "\u1fc9 alone", "\u03f2", "\u03f9αβ", "plain", "α\u0301", "Å"])], "idx bigint, snippet string")
    changed = {r["idx"] for r in rows.join(L.unify(rows, ["snippet"], ["idx"]).withColumnRenamed("snippet", "form"), "idx").filter("form <> snippet").collect()}
    assert {r["idx"] for r in L.changed_values(rows, ["snippet"], "idx").collect()} == changed and len(changed) >= 4


def test_the_filter_on_whole_tables(spark, data):
    docs = spark.read.parquet(f"{data}/metadata.parquet").select("idx", "snippet")
    form = L.unify(docs, ["snippet"], ["idx"]).withColumnRenamed("snippet", "form")
    changed = {r["idx"] for r in docs.join(form, "idx").filter("form <> snippet").collect()}
    assert {r["idx"] for r in L.changed_values(docs, ["snippet"], "idx").collect()} == changed
