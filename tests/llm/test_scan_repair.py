import random

import numpy as np
from hypothesis import given, settings, strategies as st

from leafmill.llm import scan_repair as R
from leafmill.llm.boosting import BoostedTrees

WORDS = "the river carries light beyond mountain village garden silent knowledge stranger weightless window shadow patience question harvest remember traveller surface".split()
SCHEMA = "idx bigint, snippet string, chapter_name string, id string, kind string, word string"


def corpus():
    random.seed(5)
    rows = [(i, " ".join(random.choices(WORDS, k=60)).capitalize() + ".", None, "c", "c", "c") for i in range(120)]
    rows += [(900 + i, "a half-light fell on the self-knowledge of half-light and self-knowledge.", "", "c", "c", "c") for i in range(3)]
    dirty = {
        1000: ("The river carries know-\nledge beyond the half-\nlight of the garden.", None, {"hyphen"}),
        1001: ("the river carries sha¬ dow beyond the garden now", None, {"hyphen"}),
        1002: ("The rivcr carries 5ilent light beyond the moiintain garden.", None, {"misread"}),
        1003: ("THE SILENT GARDEN\n\nThe river carries light beyond\nthe village.", "The Silent Garden", {"header"}),
        1004: ("xii | the si1ent garden\nThe river carries light\nbeyond the village.", "Part I: The Deep | The Silent Garden", {"header", "page_number", "misread"}),
        1005: ("The river carries light\n— 47 —\nbeyond the village.", None, {"page_number"}),
        1006: ("The river carries light\nbeyond the half-\nlight of the garden.", "The Silent Garden", set()),
        1007: ("iver carries light beyond the gard", "x", set()),
        1008: ("The river carries know-\nThe Silent Garden 12\nledge beyond it.", "The Silent Garden", {"hyphen", "header", "page_number"}),
    }
    rows += [(i, s, c, "c", "c", "c") for i, (s, c, _) in dirty.items()]
    rows += [(2000, None, "x", None, None, None), (2001, "", None, None, None, None), (None, "The rivcr carries light.", None, None, None, None), (2002, "z" * 30_000, None, "c", "c", "c")]
    return rows, dirty


def test_kinds_and_repair(spark):
    rows, dirty = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in R.noise_kinds(docs, "idx", "snippet", "chapter_name").collect():
        got.setdefault(r["idx"], set()).add(r["kind"])
    assert {i: got.get(i, set()) for i in dirty} == {i: k for i, (_, _, k) in dirty.items()}
    assert got[None] == {"misread"} and not set(range(120)) & set(got)
    text = {r["idx"]: r["snippet"] for r in R.repair(docs, "idx", "snippet", "chapter_name").collect()}
    assert len(text) == len(rows)
    assert text[1000] == "The river carries knowledge beyond the half-light of the garden."
    assert text[1002] == "The river carries silent light beyond the mountain garden."
    assert text[1004] == "The river carries light beyond the village."
    assert text[1008] == "The river carries knowledge beyond it."
    assert text[2000] is None and text[2001] == ""


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert R.noise_kinds(docs, "idx", "snippet", "chapter_name").collect() == []


#: Misreadings of no list, in words that a corpus shows often enough.
UNLISTED = [("k", "lc"), ("g", "q"), ("o", "e"), ("p", "þ"), ("д", "л"), ("é", "6"), ("ш", "ii")]


def test_held_out_words_and_unlisted_exchanges():
    """The trees accept held-out words misread by exchanges that the corpus shows, listed or not, and little else."""
    random.seed(2)
    frequent = [("".join(random.choices("abcdefghiklmnoprstuw", k=random.randrange(4, 11))), random.randrange(50, 5000)) for _ in range(900)]
    listed = [(read, printed, float(R.SEEN)) for printed, read in R.CONFUSIONS]
    unlisted = [(read, printed, 9.0) for printed, read in UNLISTED[:3]]
    model = R.train(frequent[:600], listed + unlisted)

    def share(pairs, seen):
        rows = [R.features(w, 1, c, m, *R.exchange(w, c), seen) for w, c, m in pairs if R.exchange(w, c)]
        return (model.predict(np.array(rows)) >= R.ACCEPT).mean()

    def misread(exchanges):
        return [(w[:k] + read + w[k + len(printed) :], w, m) for w, m in frequent[600:] for read, printed, _ in exchanges for k in range(len(w)) if w[k : k + len(printed)] == printed]

    assert share(misread(listed), 6.0) > 0.95 and share(misread(unlisted), 7.0) > 0.95
    assert share(misread([("x", "a", 0), ("z", "t", 0), ("xz", "n", 0), ("j", "ri", 0)]), 2.0) < 0.03


def test_exchanges_are_learned_from_the_corpus(spark):
    """Misreadings of no list, of accented letters, of other scripts and in very long words are corrected once six words show
    their exchange; an exchange of one or two words is not."""
    random.seed(9)
    stems = lambda letters, mark, n: ["".join(random.choices(letters, k=5)) + mark + "".join(random.choices(letters, k=4)) for _ in range(n)]
    rows, want = [], {}
    for printed, read, letters in (("k", "lc", "abdefhimnoprstu"), ("g", "q", "abdefhimnoprstu"), ("д", "л", "абвезинорст"), ("é", "6", "abdefhimnoprstu"), ("ç", "q", "abdefhimnoprstu")):
        for w in stems(letters, printed, 8):
            rows.append((w, 400))
            want[w.replace(printed, read)] = w
    long = "abdefhimno" * 9 + "k" + "prst" * 5
    rows.append((long, 400))
    want[long.replace("k", "lc")] = long
    lone = stems("abdefhimnoprstu", "w", 2)
    rows += [(w, 400) for w in lone]
    rare = [(w, 2) for w in want] + [(w.replace("w", "y"), 2) for w in lone] + [("zz\u200bz", 1), ("w@s", 1), ("was", 900), ("f0", 1), ("fo", 900), ("", 3)]
    counts = spark.createDataFrame(rows + rare, "word string, n bigint")
    got = {r["word"]: r["correction"] for r in R.corrections(counts).collect()}
    assert {w: got.get(w) for w in want} == want
    assert not [w for w in lone if w.replace("w", "y") in got] and got["w@s"] == "was" and got["f0"] == "fo"
    assert R.corrections(counts.filter("n < 0")).collect() == []


def test_what_is_no_misreading():
    for word, candidate in (("travéller", "traveller"), ("Inner", "inner"), ("n\u0435ver", "never"), ("ｔhe", "the"), ("ne\u0301ar", "near"), ("seeds", "seed"), ("see", "seed"), ("1990", "199o"), ("holding", "holder")):
        assert R.exchange(word, candidate) is None, word
    assert R.exchange("drurn", "drum") == ("rn", "m", False) and R.exchange("cvcr", "ever") == ("c", "e", True) and R.exchange("seccd", "seeed") == ("c", "e", True)


def test_the_bounds_of_likeness_change_no_answer():
    """Every line is judged as by the classifier on its features, whatever its length."""
    random.seed(3)
    titles = ["The Silent Garden", "The River of Light", "Inner Mountain", "Grace", "Das Märchen vom Fluß"]
    alike = R.train_furniture(titles, [" ".join(random.choices(WORDS, k=6)) for _ in range(100)])
    lines = [" ".join(random.choices(WORDS, k=k)) for k in (1, 2, 3, 4, 9, 40) for _ in range(30)]
    for title in titles:
        for _ in range(150):
            line = title
            for _ in range(random.randrange(0, 9)):
                right, wrong = random.choice(R.CONFUSIONS)
                k = random.randrange(len(line))
                line = line.replace(right, wrong, 1) if random.random() < 0.5 else line[:k] + line[k + 1 :] or "x"
            lines.append(line)
    yes = 0
    for title in titles:
        for line in lines:
            want = bool(alike.model.predict(np.array([R.line_features(line, title)]))[0] >= R.ACCEPT) if R._letters(line)[1] else False
            assert alike(line, title) == want, (line, title)
            yes += want
    assert yes > 300
    assert R.furniture("Gracc", ["Grace"], alike)[0] and R.furniture("Grcce", ["Grace"], alike)[0] and R.furniture("Inncr Lifc", ["Inner Life"], alike)[0]
    assert R.furniture("The river carries", ["Grace", "Inner Life"], alike) == (False, False)
    assert R.furniture("-" * 30 + " 47 " + "-" * 30, [], alike) == (False, True)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert R._in_order(a, b) == best[-1][-1]


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = BoostedTrees(rounds=80).fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.9
