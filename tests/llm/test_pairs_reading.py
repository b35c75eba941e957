import random

import numpy as np

from tidewell.llm.pairs import defective_answers
from tidewell.llm.reading import boosted, grader_of, measure, reading_levels

ANSWERS = "answer_id long, question string, clue string, recalled string, rationale string, probe string, answer string, defect_type string"
NAMES = ("Trobex", "Malind", "Korsun", "Plavent", "Quessel", "Bramot")


def answer_rows(rng, n):
    """(rows, defects): sound answers from a few patterns and known defects among them."""
    sound = (
        lambda a, k: f"The sale of {a} for ${k} million would remove the main risk.", lambda a, k: f"Orders at {a} rose {k} percent, but the debt is due soon.",
        lambda a, k: f"Fleet of {k} vessels and the {a} charter signed last year.", lambda a, k: f"The firm could not comply with a rule, and {a} notes followed in 20{k % 90 + 10}.",
        lambda a, k: f"Margins fell at the {a} plant because freight costs rose {k} percent.")
    rows, bad = [], {}
    for i in range(n):
        a, k = rng.choice(NAMES), rng.randrange(2, 99)
        q = f"What is the reason for your view on item R{i:05d} of {rng.choice(NAMES)}?"
        text = rng.choice(sound)(a, k)
        kind = rng.choice(("identification", "recall", "cutoff"))
        r = rng.random()
        if r < 0.03:
            text, bad[i] = rng.choice(("", None, "n/a", "  ", "TBD", "​")), "empty"
        elif r < 0.06:
            text, bad[i] = rng.choice((q, f'"{q}"', q.lower())), "copy"
        elif r < 0.09:
            text, bad[i] = rng.choice(("I'm sorry, but I cannot answer this question.", "As an AI language model, I am unable to give financial advice.", "Unfortunately I am not able to help with that.")), "refusal"
        elif r < 0.12:
            text, bad[i] = rng.choice(("Der Vorstand rechnet für das Jahr mit einer Erholung der Nachfrage.", "La société prévoit une reprise lente de la demande dans le pays.", "新たな資金調達がなければ株価は低迷する。")), "language"
        elif r < 0.15:
            text, bad[i] = text[:rng.randrange(12, len(text) - 8)].rstrip() + "qu", "truncated"
        elif r < 0.2:
            text = text.rstrip(".")
        field = {"identification": 2, "recall": 3, "cutoff": 4}[kind]
        row = [i, q, None, None, None, kind, "clash", "clash"]
        row[field] = text
        rows.append(tuple(row))
    return rows, bad


def test_defects_are_found(spark):
    rows, bad = answer_rows(random.Random(4), 1500)
    special = [(9001, "Q?", None, "nothing", None, "recall", "", ""), (9002, "Q?", None, "None.", None, "recall", "", ""), (9003, "Q?", "none", None, None, "identification", "", ""),
               (9004, None, None, None, None, None, "", ""), (9005, "Q?", None, None, "word " * 20_000, "cutoff", "", ""), (None, "Q?", None, None, None, "recall", "", "")]
    df = spark.createDataFrame(rows + rows[:50] + special, ANSWERS)
    found = [tuple(r) for r in defective_answers(df).collect()]
    got = dict(found)
    assert len(got) == len(found)
    assert got.pop(9003) == "empty" and got.pop(9004) == "empty" and 9001 not in got and 9002 not in got
    got.pop(9005, None)
    for kind in ("empty", "copy", "refusal", "language", "truncated"):
        want, have = {i for i, k in bad.items() if k == kind}, {i for i, k in got.items() if k == kind}
        assert len(want & have) >= 0.8 * len(want), (kind, len(want), len(have))
        assert len(want & have) >= 0.8 * len(have), (kind, len(want), len(have))


def test_no_answers(spark):
    assert defective_answers(spark.createDataFrame([], ANSWERS)).count() == 0


EASY = ("The cup is red.", "You can call us.", "It cost two dollars.", "No one was hurt.", "Put it away now.")
HARD = ("Notwithstanding the foregoing, counterparties to the subordination agreement interposed jurisdictional objections.", "Immunogenicity assessments, stratified by baseline seropositivity, demonstrated noninferiority within a prespecified margin.",
        "Crystallization of the contingent consideration occasioned reclassification from accumulated comprehensive income.")


def documents(rng, n):
    rows = []
    for i in range(n):
        level = rng.randrange(1, 6)
        parts = [rng.choice(HARD if rng.random() < (level - 1) / 4 else EASY) for _ in range(20)]
        rows.append((i, " ".join(parts), rng.choice(("a", "b", "c")), "1", float(level)))
    return rows


def test_levels_on_held_out_documents(spark):
    rng = random.Random(8)
    rows = documents(rng, 400)
    docs = spark.createDataFrame(rows + [(900, None, "a", "1", 0.0), (901, "", None, None, 0.0), (902, "!?", "a", None, 0.0), (903, "The cup is red. " * 20_000, "a", None, 0.0), (904, "Der Vorstand rechnet nicht mit einer Erholung und die Nachfrage ist gering.", "a", None, 0.0)], "doc_id long, text string, source string, cik string, y double")
    labels = [(i, rater, max(1, min(5, round(y + bias + rng.choice((0, 0, 0, 1, -1)))))) for i, _, _, _, y in rows[:250] for rater, bias in (("r1", 0), ("r2", 0.4))] + [(1, None, 3), (2, "r1", None), (None, "r1", 2), (77_777, "r1", 2)]
    marks = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    graded = reading_levels(docs, marks).collect()
    assert {r["english"] for r in graded if r["doc_id"] < 900} == {True} and [r["english"] for r in graded if r["doc_id"] == 904] == [False]
    out = {r["doc_id"]: (r["grade"], r["level"]) for r in graded}
    assert len(out) == 405 and out[900] == out[901] == out[902] == (None, None) and out[903][1] <= 2
    error = np.mean([abs(out[i][0] - y) for i, _, _, _, y in rows[250:]])
    assert error < 0.7
    grader = grader_of(docs, marks)
    report = grader.report
    assert set(grader.lines) == {"a", "b", "c", None} and sum(grader.graded.values()) == 250
    assert set(report) == {"a", "b", "c", "all"} and report["all"] < 0.8


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "Some text.", "a", None)], "doc_id long, text string, source string, cik string")
    marks = spark.createDataFrame([], "doc_id long, rater string, reading_level int")
    assert [tuple(r) for r in reading_levels(docs, marks).collect()] == [(1, "a", None, None, None, None)]
    assert reading_levels(docs.limit(0), marks).count() == 0


def test_measure_and_trees():
    assert measure("...") is None and np.isfinite(measure("One. Two three? Four!")).all() and measure("a" * 200_000).shape == measure("b c").shape
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = 2.0 * (x[:, 0] > 0) + x[:, 1]
    trees = boosted(x[:600], y[:600])
    assert np.corrcoef(trees.predict(x[600:]), y[600:])[0, 1] > 0.93
