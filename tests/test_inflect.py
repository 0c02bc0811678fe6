"""Inflected words against a list of all forms."""

import random

from gridline.operators import inflect as I
from gridline.operators import ocrtext as O

ENDINGS = [(1, ""), (1, "а"), (1, "ами"), (1, "ы"), (2, "ка"), (2, "ками"), (2, "ки"), (2, "ок"), (3, None)]
STEMS = [("резц", 1, "резец"), ("держав", 2, "державка"), ("Винт", 1, "винт"), ("держав", 1, "держава"), (None, 1, "x"), ("резцам", 9, "none")]


def relations(spark):
    return spark.createDataFrame(STEMS, "stem string, class int, lemma string"), spark.createDataFrame(ENDINGS, "class int, ending string")


def plain(word):
    found = [(-len(e), lemma, c, e) for s, c, lemma in STEMS if s for k, e in ENDINGS if k == c and e is not None and (s + e).lower() == word.lower()]
    return min(found)[1:] if found else None


def test_analyses_are_those_of_all_forms(spark):
    stems, endings = relations(spark)
    rng = random.Random(2)
    words = [s + e for s, _, _ in STEMS if s for _, e in ENDINGS if e is not None] + ["ВИНТАМИ", "", "а", None, "Державка", "державкa"]
    words += ["".join(rng.choice("держвакиы") for _ in range(rng.randint(1, 9))) for _ in range(100)]
    frame = spark.createDataFrame([(w,) for w in words + words], "word string").repartition(3)
    got = {r["word"]: (r["lemma"], r["class"], r["ending"]) for r in I.analysed(frame, stems, endings).collect()}
    assert got == {w: plain(w) for w in words if w is not None and plain(w)}
    left = [r["word"] for r in I.unknown(frame, stems, endings).collect()]
    assert sorted(left) == sorted({w for w in words if w is not None and not plain(w)})
    forms = {r["word"] for r in I.word_forms(stems, endings).collect()}
    assert all((w.lower() in forms) == bool(plain(w)) for w in words if w)


def test_no_paradigms_and_no_words(spark):
    stems, endings = relations(spark)
    words = spark.createDataFrame([("винт",)], "word string")
    assert I.analysed(words.limit(0), stems, endings).collect() == [] == I.analysed(words, stems.limit(0), endings).collect() == I.analysed(words, stems, endings.limit(0)).collect()


def test_lexicons_grow_by_forms(spark):
    stems, endings = relations(spark)
    lexicon = spark.createDataFrame([("Резца", 3), ("сверло", 7)], "word string, ord long")
    rows = I.with_forms(lexicon, stems, endings).collect()
    forms = {(s + e).lower() for s, c, _ in STEMS if s for k, e in ENDINGS if k == c and e is not None}
    assert sorted(r["word"] for r in rows) == sorted(forms | {"резца", "сверло"}) and len({r["ord"] for r in rows}) == len(rows)
    assert {r["word"]: r["ord"] for r in rows if r["ord"] <= 7} == {"резца": 3, "сверло": 7}


def test_inflected_words_are_known_to_the_repair(spark):
    stems, endings = relations(spark)
    cells = spark.createDataFrame([(1, "державками"), (2, "держвками"), (3, "винтми 5шт")], "id int, text string")
    without = {r["id"]: r["text"] for r in O.repaired(cells, ["id"]).collect()}
    got = {r["id"]: r["text"] for r in O.repaired(cells, ["id"], paradigms=(stems, endings)).collect()}
    assert got == {1: "державками", 2: "державка", 3: "винтами 5 шт."}  # domain terms come first
    assert without[1] == "державка" and without[3] != got[3]
