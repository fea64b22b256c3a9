import random

from passagery.llm.reading import fit_formula, formula_grade, reading_levels, train, words

LEVELS = {
    1: "cat dog run sit red big hat sun".split(), 2: "garden window people simple morning little".split(), 3: "system process network results service".split(),
    4: "calibration distributed consistency retention availability".split(), 5: "epistemological heteroscedastic commensurability parameterisation".split(),
}


def doc(rng, level, n=12):
    size = {1: 5, 2: 9, 3: 14, 4: 20, 5: 30}[level]
    return " ".join(" ".join(rng.choice(LEVELS[level]) for _ in range(size)).capitalize() + "." for _ in range(n // 2))


def test_formula_rises_with_level():
    rng = random.Random(1)
    grades = [formula_grade(doc(rng, k)) for k in range(1, 6)]
    assert grades == sorted(grades) and formula_grade("") == 0.0
    a, b = fit_formula(grades, [1, 2, 3, 4, 5])
    assert b > 0 and fit_formula([], []) == (0.2, 0.28)


def test_names_markup_and_code_are_not_read():
    assert words("<p>Use `x` in **cache-weaver_1**</p>\n```\ncode here\n``` KEY_ONE CamelCase &amp; don't") == ["use", "x", "in", "don't"]


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, doc(rng, 1 + i % 5), "en", 0) for i in range(200)]
    rows += [(900, None, "en", 0), (901, "", "en", 0), (None, "cat", "en", 0), (902, doc(rng, 5, 4000), None, 0), (3, rows[3][1], "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, reading_level int")
    labels = [(i, 1 + i % 5, "g1") for i in range(0, 50)] + [(2, 2, "g2"), (None, 3, "g1"), (5, None, "g1"), (6, 9, "g1"), (77777, 1, "g1")]
    graded = spark.createDataFrame(labels, "doc_id long, reading_level int, grader string")
    got = reading_levels(docs, train(docs, graded)).collect()
    level = {r["doc_id"]: r["reading_level"] for r in got}
    assert sum(level[i] == 1 + i % 5 for i in range(50, 200)) >= 0.9 * 150
    assert 900 not in level and 901 in level and level[902] == 5 and None not in level
    alone = reading_levels(docs, train(docs, graded.limit(0)))  # without grades the formula seeds the models
    assert alone.where("doc_id % 5 = 4 AND doc_id < 200").where("reading_level = 5").count() >= 35
    assert reading_levels(docs.limit(0), train(docs.limit(0), graded)).count() == 0
