import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastenlake.llm import decontaminate as dc

ITEM = "Yesterday Maria bought 12 kg of ripe apples and gave 5 kg of them to Peter because Maria liked Peter. How many kg were left for Maria?"
OTHER = "Gestern kaufte jemand sehr viele reife Birnen auf dem grossen alten Markt in der Stadt."


def plain(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) for _ in range(n))


def rows():
    rng = random.Random(1)
    changed = ITEM.replace("Maria", "Julia").replace("Peter", "Oskar").replace("12", "40").replace("5 kg", "7 kg")
    mixed = ITEM.replace("Maria liked Peter", "Oskar liked Julia").replace("for Maria", "for Anton").replace("gave 5", "gave 12")
    return [
        (1, plain(rng, 40) + ". " + ITEM + " " + plain(rng, 40)),
        (2, plain(rng, 10) + ". " + changed),
        (3, plain(rng, 10) + ". " + mixed),
        (4, plain(rng, 300)),
        (5, None),
        (6, ""),
        (7, ITEM[:50]),
        (8, OTHER.upper().replace(" ", "  ,")),
        (None, OTHER),
        (1, plain(rng, 5) + ". " + ITEM),
        (9, "a b. " + ITEM + " c d. " + changed + OTHER),
    ]


BENCH = [(10, ITEM), (11, OTHER), (12, "Too short"), (13, None), (14, "1 2 3 4 5 6 7 8")]


@pytest.mark.parametrize("most", [dc.BROADCAST_WINDOWS, -1])
def test_finds_verbatim_and_reparameterised_items(spark, most):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({"item_id": F.lit("x"), "coverage": F.lit("y")})
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in dc.contaminated(docs, bench, most).collect()}
    assert got == {(1, 10, False), (2, 10, True), (8, 11, False), (None, 11, False), (9, 10, False), (9, 11, False)}
    left = dc.decontaminate(docs, bench, most)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6, 7]
    assert dc.contaminated(docs.limit(0), bench, most).collect() == [] == dc.contaminated(docs, bench.limit(0), most).collect()


def brute_forms(text):
    """The three forms as (symbols, values), from the docstring; a form equal to the plain one is None."""
    marked, last = [], "."
    for t in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+|[.!?:\n]", text or ""):
        if t not in ".!?:\n":
            low = t.lower()
            number, unit, cap = t[0].isdigit(), low in dc.UNITS, len(t) > 1 and t[0].isupper() and t[1:].islower()
            marked.append((low, "#" if number else "u" if unit and last[0].isdigit() else "", cap and not unit, last in ".!?:\n", low in dc.COMMON))
        last = t
    plain_form = [(k or low, low if k else None) for low, k, *_ in marked]
    out = []
    for inside in (True, None, False):
        name = [cap and inside is not None and (not begins if inside else not common) for _, _, cap, begins, common in marked]
        form = [("N", low) if is_name else x for (low, *_), x, is_name in zip(marked, plain_form, name, strict=True)]
        out.append(form if inside is None or any(name) else None)
    return out, [low for low, *_ in marked]


def brute_contains(doc, item):
    (doc_forms, doc_values), (item_forms, item_values) = brute_forms(doc), brute_forms(item)
    best = (0.0, 0, False)
    symbols = lambda form, i: tuple(s for s, _ in form[i : i + 5])
    says = lambda form, i: len(form) >= i + 5 and sum(v is None for _, v in form[i : i + 5]) >= 3
    if not any(says(f, q) for f in item_forms if f for q in range(len(f))):
        n = len(item_values)
        return (1.0, 1, False) if n >= 3 and any(doc_values[p : p + n] == item_values for p in range(len(doc_values))) else best
    for d, f in zip(doc_forms, item_forms, strict=True):
        if not d or not f:
            continue
        kinds = {symbols(f, q) for q in range(len(f)) if says(f, q)}
        lines = {}
        for q in range(len(f)):
            for p in range(len(d)):
                if says(f, q) and says(d, p) and symbols(f, q) == symbols(d, p):
                    lines.setdefault(p - q, []).append(q)
        for anchor in lines:
            slots = lambda line, q: [*dict.fromkeys((s, v, d[i + line][1]) for i, (s, v) in enumerate(f) if q <= i < q + 5 and v is not None)]  # noqa: B023, E731
            votes = []
            for q in lines[anchor]:
                votes += slots(anchor, q)
            bound = []
            for x in sorted(dict.fromkeys(votes), key=lambda x: (-votes.count(x), x[1] != x[2])):
                if not any(x[0] == y[0] and (x[1] == y[1] or x[2] == y[2]) for y in bound):
                    bound.append(x)
            covered, changed = set(), False
            for line in sorted((x for x in lines if abs(x - anchor) <= len(f)), key=lambda x: (x != anchor, -len(lines[x]), abs(x - anchor), x)):
                for q in lines[line]:
                    own = slots(line, q)
                    clash = any(x[0] == y[0] and (x[1] == y[1]) != (x[2] == y[2]) for x in own for y in bound + own)
                    if symbols(f, q) not in covered and not clash:
                        bound += own
                        covered.add(symbols(f, q))
                        changed |= any(x[1] != x[2] for x in own)
            best = max(best, (len(covered) / len(kinds), len(kinds), changed), key=lambda x: (x[0], not x[2]))
    return best


PARTS = ["{a} has {x} red apples and gives {y} to {b}.", "Then {b} sells {y} kg of plums for {x} dollars to {a}.", "How many apples does {a} have now?", "The {x} boxes hold {x} pears and {y} nuts each.", "who knows {a}?", "{x} {y} {x}", "{a} {b} {a} {b} {x} {x}"]
NAMES = ["Tom", "Mia", "Ken", "Sara", "Hugo"]


def told(rng, parts, mixed=0.0):
    pick = lambda: dict(zip("abxy", [*rng.sample(NAMES, 2), *map(str, rng.sample(range(2, 9), 2))], strict=True))
    own = pick()
    return " ".join(p.format(**(pick() if rng.random() < mixed else own)) for p in parts)


def test_both_ways_agree_with_brute_force(spark):
    rng = random.Random(2)
    chosen = [[rng.choice(PARTS) for _ in range(rng.randrange(1, 5))] for _ in range(24)]
    bench = [(i, told(rng, c, 0.2)) for i, c in enumerate(chosen)] + [(90, "Who wrote Hamlet?"), (91, "12 + 7 ="), (92, ""), (93, "1 2 3 4")]
    docs = []
    for i in range(90):
        inner = [told(rng, rng.choice(chosen), rng.choice([0, 0.3])) if rng.random() < 0.6 else rng.choice(bench)[1] for _ in range(rng.randrange(1, 4))]
        words = (plain(rng, 9) + ". " + rng.choice(["", " Add "]).join(inner) + " " + plain(rng, 9)).split(" ")
        for _ in range(rng.randrange(0, 3)):  # partial frames: words go or come
            words.insert(rng.randrange(len(words)), rng.choice(["extra", "9"])) if rng.random() < 0.5 else words.pop(rng.randrange(len(words)))
        docs.append((i % 80, " ".join(words)))
    want = sorted((d, k, *f) for d, t in docs for k, b in bench if (f := brute_contains(t, b))[0] >= dc.COVERAGE)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert len(want) > 80 and {x[4] for x in want} == {True, False} and any(x[2] < 1 for x in want) and {x[1] for x in want} & {90, 93}
    assert sorted(map(tuple, dc.contaminated(a, b).collect())) == want == sorted(map(tuple, dc.contaminated(a, b, -1).collect()))
    assert sorted(r[0] for r in dc.unsearchable(b).collect()) == [91, 92]


SALT = "Add 12 grams of salt then mix the 12 grams with water and pour 12 grams into the bowl before the 12 grams dissolve"


def test_verbatim_items_behind_another_place_of_the_same_frame():
    for item, text in ((SALT, "Add 40 grams of salt then stop. " + SALT), (ITEM, "Yesterday Julia bought 40 kg of ripe apples. " + ITEM)):
        assert dc.Finder([(1, item)])(text)[0][:2] == (1, 1.0) and not dc.Finder([(1, item)])(text)[0][3]
        assert brute_contains(text, item)[::2] == (1.0, False)


@pytest.mark.parametrize("most", [dc.BROADCAST_WINDOWS, -1])
def test_rows_of_one_doc_id_are_judged_apart(spark, most):
    rows = [(None, ITEM, 1), (None, "all clean here", 2), (5, "x. " + ITEM, 3), (5, "clean as well", 4), (6, "tell me: who wrote Hamlet?", 5), (6, "who wrote Othello?", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumns({"own": F.lit(1), "h": F.lit(2)})
    bench = spark.createDataFrame([(1, ITEM), (2, "Who wrote Hamlet?")], "item_id long, text string")
    left = dc.decontaminate(docs, bench, most)
    assert left.columns == docs.columns and sorted(r["row"] for r in left.collect()) == [2, 4, 6]


def test_a_very_long_text():
    rng = random.Random(4)
    text = plain(rng, 60_000) + ". " + ITEM + " " + plain(rng, 60_000) + " " + "12 kg of ripe apples and " * 20_000
    assert dc.Finder([(1, ITEM), (2, OTHER), (3, "12 kg of ripe apples and " * 300)])(text)[0][:2] == (1, 1.0)


RENAMED = [
    ("Tom has 12 apples. Tom gives 5 apples to Sara. How many apples does Tom have left?", [("Tom", "Mia"), ("Sara", "Ken"), ("12", "30"), ("5", "7")]),
    ("Anna buys 3 red pens at the shop. Peter buys 4 blue pens there too. Anna then gives 2 pens to Peter. Peter loses 1 of them at school. How many pens does Peter have now?", [("Anna", "Clara"), ("Peter", "Hugo"), ("3", "9"), ("4", "8")]),
]


@pytest.mark.parametrize("most", [dc.BROADCAST_WINDOWS, -1])
def test_finds_items_whose_sentence_initial_subjects_are_renamed(spark, most):
    rng, docs = random.Random(3), []
    for k, (text, swaps) in enumerate(RENAMED):
        changed = text
        for a, b in swaps:
            changed = changed.replace(a, b)
        mixed = changed.replace(f" to {swaps[1][1]}", f" to {swaps[0][1]}")  # one name for two: another story
        docs += [(10 * k, plain(rng, 30) + ". " + changed), (10 * k + 1, "Question " + changed), (10 * k + 2, text.lower()), (10 * k + 3, plain(rng, 9) + ". " + mixed), (10 * k + 4, plain(rng, 60))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, t) for k, (t, _) in enumerate(RENAMED)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in dc.contaminated(a, b, most).collect()}
    assert {g for g in got if g[0] % 10 != 3} == {(10 * k + i, k, i < 2) for k in range(2) for i in range(3)}
    assert (3, 0, True) not in got


def test_common_words_that_begin_sentences_stay_words():
    two = dc.templates("How many pears are there in the box. Tom counts them all day long.")
    assert two[0] is None and two[2] is not None and np.count_nonzero(two[2].slots) == 1
