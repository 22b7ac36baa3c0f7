import pytest

from leafmill.llm import truncation as C

ENDED = [
    "It is done.", "Is it?", "Yes!”", "He said “it.”", "Nun „ja“!", "Ναι, εδώ;", "यह है।", "完了。", "آیا؟", "a, b, etc.", "(See No. 4, where it ends.)", "It ends here (cf. ch. 9).", "Text. [18]", "Text.\n(to be continued)", "Done.\n\n* * *", "Done.\n— Morlusk, letter 40",
    "Done.\nAdravane reading room, shelf 39", "Done.\n\nEND OF THE CLEAR PART 21", "Done.\nHere ends the book of the noon 12", "1. A ... 7\n— end of contents —", "1. The Wide Vessel .... 71", "Verse line.\n\n— Omeya Volanti", "Well done. 🪔", "Done. \n\n", "What is it?!", "In vol. 2, p. 57, it ends.",
]
CUT = ["It is do", "It is the", "It is the ", "It is the...", "It waits …", "Many a will, e.g.", "In vol. 8, p.", "Asked Mr.", "By T. D.", "The rest &am", "The re�", "and the shore,", "wei-", "He said, “it ends.", "(See No. 40, where it ends.", "about 42.3", "Q: Many a farmer, e.g. V\n", "Done.\n\nThe star", "完了。然后", "यह है। और", "13. The Perfect Spring of Dr"]


@pytest.mark.parametrize("text", ENDED)
def test_ended(text):
    assert C.ending(text.rstrip(C.BLANKS)) in ("ended", "open")


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert C.ending(text.rstrip(C.BLANKS)) == "cut"


FILL = "Ein Satz, der endet. " * 40


def test_quotes_and_brackets_that_open_far_before_the_end(spark):
    texts = {1: (f"Er sagte: „{FILL}Nun ja.“ Dann ging er.", False), 2: (f"He said: “{FILL}It ends.", True), 3: (f"It ends (see {FILL}there.", True), 4: (f"Done.\n({FILL.replace('.', ',')} to be continued)", False), 5: (f"A bracket ( in a paragraph.\n\n{FILL}", False)}
    docs = spark.createDataFrame([(i, t, "free", "c", 0) for i, (t, _) in texts.items()], "doc_id bigint, text string, source string, state string, chars int")
    assert {r["doc_id"]: r["is_cut"] for r in C.truncated(docs).collect()} == {i: cut for i, (_, cut) in texts.items()}
    report = C.truncation_report(docs).first()
    assert (report["n_docs"], report["n_cut"]) == (5, 2)


def test_long_runs_of_one_sign():
    for text in ("_" * 200_000 + "a", "word " + " " * 200_000 + "x", "(" * 100_000 + "\n" * 100_000 + "a", "." * 200_000 + "1a"):
        assert C.ending(text) == "cut"


SCHEMA = "doc_id bigint, text string, source string, state string, chars int"


def rows():
    found = [(i, ("word " * 60)[:255], "capped", "clash", 0) for i in range(30)]
    found += [(100 + i, "A sentence that ends. " * (3 + i % 40), "free", "clash", 0) for i in range(200)]
    signed = "A line of verse.\n— Omeya Volanti"
    found += [(400 + i, signed.rjust(255, "x"), "capped", "c", 0) for i in range(3)] + [(500, signed, "free", "c", 0)]
    return [*found, (600, None, "free", None, None), (601, "", None, None, None), (602, "—", "free", None, None), (603, "cut of", None, None, None), (603, "cut of", None, None, None), (None, "cut of", "free", None, None), (604, "long " * 40_000, "free", None, None)]


def test_spikes_and_report(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert {(r["source"], r["unit"], r["length"]) for r in C.length_spikes(docs, "source", "text").collect()} >= {("capped", "characters", 255), ("capped", "bytes", 255)}
    got = {(r["doc_id"], r["source"]) for r in C.truncated(docs).filter("is_cut").collect()}
    assert {i for i, s in got if s == "capped"} == set(range(30)) | {400, 401, 402}  # a name that stops at the limit of the field
    assert {i for i, s in got if s != "capped"} == {603, None, 604}
    report = {r["source"]: r for r in C.truncation_report(docs).collect()}
    assert (report["capped"]["n_docs"], report["capped"]["n_cut"], report["capped"]["cut_share"]) == (33, 33, 1.0)
    assert (report[None]["n_docs"], report[None]["n_cut"]) == (3, 2)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert C.truncated(docs).collect() == [] and C.truncation_report(docs).collect() == []


@pytest.mark.parametrize("filler", [0, 50, 399, 400, 500, 20_000])
def test_endings_do_not_depend_on_length(filler):
    """The same end is judged alike however far back its quotation, bracket or paragraph begins."""
    body = ("word " * (filler // 5)).strip()
    assert C.ending(f"He said (and {body} then he went.") == "cut"
    assert C.ending(f"He said (and {body}) then he went.") == "ended"
    assert C.ending(f"He said “and {body} then he went.") == "cut"
    assert C.ending(f"Er sagte „und {body} dann ging er.“") == "ended"
    assert C.ending(f"It was {body} as in vol.") == "cut"
