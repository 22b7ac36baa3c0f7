import pytest

from leafmill.llm.sentences import sentence_ends, split_sentences


def cut(text, language=None):
    out, begin = [], 0
    for end in sentence_ends(text, language):
        out.append(text[begin:end].strip())
        begin = end
    return out


CASES = [
    (["In vol. 22, p. 491, Dr. Ash met Mr. T. D. Vask (cf. ch. 31).", "He left at 7.11 p.m. in May.", "Then, etc.", "It ended."], " "),
    (["“Who calls?” asked St. Parthil beside the door.", "“The star builds.”", "“It does!”", "(See No. 40, where it ends.)", "Good?!"], " "),
    (["The seeker waits ... then the light goes on.", "About 3.27 of it; e.g. Ossark, i.e. the town."], "\n"),
    (["Das sagt z. B. der Bote, Nr. 4 bzw. Dr. Ahn, d. h. er.", "Nun „ja“.", "Gut!"], " "),
    (["Она сказала «да нет» и т. д. потом.", "Стр. 5, см. т. е. тут.", "Да!"], " "),
    (["Το φως είναι εδώ;", "Ναι, π.χ. σελ. 4 εδώ.", "Καλά!"], " "),
    (["यह पृ. 127 है और डॉ. राम है।", "वह है॥", "क्या?"], " "),
    (["আমি পৃ. 4 দেখি।", "হ্যাঁ!"], " "),
    (["这是3.14的光。", "他说「好的人」走了！", "是吗？"], ""),
    (["これは本です。", "「光の道」があるか？"], ""),
    (["این ص. 220 است.", "آیا؟", "بله!"], " "),
    (["ሰላም ቁ. 4 ነው።", "እንዴት፧"], " "),
    (["բարեւ էջ. 251 լավ։", "«բառ» այստեղ։"], " "),
    (["ပထမ၊ဒုတိယ။", "တတိယ။"], ""),
    (["ภาษาไทย98.3ดี", "วันนี้ดี"], " "),
    (["The lesson ended.", "It is the sky."], ""),
    (["A heading", "Then a paragraph. "], "\n\n"),
]


@pytest.mark.parametrize("parts,glue", CASES)
def test_languages(parts, glue):
    assert cut(glue.join(parts)) == [p.strip() for p in parts]


def test_edges(spark):
    assert sentence_ends(None) == [] and sentence_ends("") == [] and sentence_ends(" \n ") == []
    assert cut("no end at all") == ["no end at all"]
    assert len(sentence_ends("word " * 50_000)) == 1 and len(sentence_ends("a. " * 2 + "Xy. " * 20_000)) >= 20_000
    docs = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "y"), (3, "", "z"), (1, "One. Two.", "x"), (None, "Q.", None)], "idx bigint, snippet string, sentence_no string")
    got = split_sentences(docs, "snippet", ["idx"]).collect()
    assert sorted((r["idx"] or 0, r["sentence_no"], r["begin_pos"], r["end_pos"], r["sentence"]) for r in got) == sorted([(1, 0, 0, 4, "One."), (1, 1, 5, 9, "Two.")] * 2 + [(0, 0, 0, 2, "Q.")])
    assert split_sentences(docs.filter("idx = 9"), "snippet", ["idx"]).collect() == []


@pytest.mark.parametrize("language,parts", [
    ("en", ["I said no.", "She left."]), ("English", ["This is art.", "It lives."]), ("en", ["He ate a fig.", "Then he slept."]), ("en", ["He hit col.", "She ran."]),
    (None, ["I said no.", "See No. 4 and Fig. 12 of it."]), ("en", ["Col. Vask and Gen. Ash met St. Parthil.", "They left."]), ("en-GB", ["Cf. ch. 4 and art. 7, sec. xii.", "Done."]),
    ("de", ["Siehe Bd. 4 und Nr. 7 von Hr. Ahn.", "Gut."]), ("fr", ["Voir M. Ahn et Mme. Vask, p. ex. ici.", "Bien."]), ("de", ["Er kam bzw. Sie kam."]), ("en", ["He came bzw.", "She came."]),
    ("ru", ["Это и др. люди, Dr. Ash и т. д. там.", "Да."]), ("xx", ["Unknown here.", "Yes."]),
])
def test_shortened_words_belong_to_a_language(language, parts):
    assert cut(" ".join(parts), language) == parts


def test_long_words_and_many_quotes_are_seen_whole():
    word = "Donaudampfschifffahrtsgesellschaftskapitaen" * 3
    assert cut(f"Das sagt {word}. Dann geht er.", "de") == [f"Das sagt {word}.", "Dann geht er."]
    assert cut("He asks why? " + "“" * 20 + "then he goes.") == ["He asks why? " + "“" * 20 + "then he goes."]


def test_language_is_guessed_by_script_and_words():
    from leafmill.llm.sentences import guess_language, language_code

    assert [guess_language(t) for t in ("Это всё", "यह है", "the end of it", "le fils et la mère", "der Hund und die Katze", "", "123", "这是")] == ["ru", "hi", "en", "fr", "de", "en", "en", "en"]
    assert [language_code(x) for x in ("English", "de_AT", "Bengali, Sanskrit", "", None, "Klingon")] == ["en", "de", "bn", None, None, None]


def test_language_column(spark):
    docs = spark.createDataFrame([(1, "Er kam bzw. Sie kam.", "de", "x"), (2, "Er kam bzw. Sie kam.", "en", "y"), (3, "He said no. She left.", None, "z")], "idx int, snippet string, __language string, sentence string")
    got = split_sentences(docs, "snippet", ["idx"], language=docs["__language"]).groupBy("idx").count().collect()
    assert {r["idx"]: r["count"] for r in got} == {1: 1, 2: 2, 3: 2}
