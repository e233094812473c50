from __future__ import annotations

import random

import pyarrow as pa
import pytest

from verdure.llm.decontamination import Templates, contaminated_documents, decontaminate

ITEM = "Anna Smith has 12 apples and gives 5 apples to Bob, who walks 3.5 km home before Anna Smith counts the 12 apples again."


def codes(text):
    return Templates(pa.array([text]))


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("he saw 5 km of road", "He saw 1,200 miles of road!", True),
        ("he saw 5km of road", "he saw 7 miles of road", True),
        ("he saw 5 of road", "he saw seven of road", True),
        ("he saw 5 of road", "he saw 5 km of road", False),
        ("then Anna Maria left", "then Bob left", True),
        ("then Anna left", "then she left", False),
        ("it ended. Anna left", "it ended. Bob left", False),
        ("a -- b", "a b", True),
        ("(a) \"b\"", "a b", True),
        ("sah Ärzte an", "sah Bob an", True),
    ],
)
def test_templates(a, b, same):
    assert (codes(a).codes.tolist() == codes(b).codes.tolist()) is same


def test_template_of_nothing():
    t = Templates(pa.array(["", None, " -- \n", "a"]))
    assert t.first.tolist() == [0, 0, 0, 0, 1]
    assert len(Templates(pa.array([], pa.string())).codes) == 0


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.changed) for r in df.collect())


def test_re_parameterised_questions(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choices([f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"], k=n))
    other = "Carla Jones has 40 apples and gives 7 apples to Dan, who walks 9 miles home before Carla Jones counts the 40 apples again."
    mixed = "Carla Jones has 40 apples and gives 7 apples to Dan, who walks 9 miles home before Eve Miller counts the 41 apples again."
    rows = [
        (1, noise(50) + " " + ITEM + " " + noise(50)),
        (2, noise(30) + ".\n" + other + noise(9)),
        (3, noise(30) + ". " + mixed),
        (4, noise(400)),
        (5, ITEM.upper()),
        (6, None), (7, ""), (8, "short one here now ok"), (8, "short one here now ok"), (None, ITEM), (9, ITEM + "x" * 100_000 + noise(20_000)),
        (10, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (11, "21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36"),
        (12, " ".join(ITEM.split()[:6])), (13, noise(20) + " " + ITEM.title() + " " + noise(9)), (14, noise(9) + " is TOO, short? " + noise(9)),
    ]
    items = [(7, ITEM), (9, ITEM), (20, "Short one here now ok."), (21, "too short"), (22, None), (23, ""), (None, ITEM), (24, rows[-5][1]), (25, "noise")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, held_digest int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = found(contaminated_documents(docs, benchmark))
    assert got == [(-1, 7, 0), (1, 7, 0), (2, 7, 5), (3, 7, 5), (5, 7, 0), (8, 20, 0), (8, 20, 0), (9, 7, 0), (10, 24, 0), (13, 7, 0), (14, 21, 0)]
    left = decontaminate(docs, benchmark)
    assert sorted(r.doc_id for r in left.collect()) == [4, 6, 7, 11, 12]
    assert left.columns == docs.columns
    assert contaminated_documents(docs.limit(0), benchmark).count() == 0
    assert decontaminate(docs, benchmark.limit(0)).count() == len(rows)


CHANGES = {
    "verbatim": lambda t, rng: t,
    "upper": lambda t, rng: t.upper(),
    "title": lambda t, rng: t.title(),
    "one number": lambda t, rng: " ".join(w if i != last_number(t) else "13" for i, w in enumerate(t.split())),
    "half": lambda t, rng: " ".join(w if i < 0.6 * len(t.split()) else "other" for i, w in enumerate(t.split())),
    "punctuated": lambda t, rng: ", ".join(t.split()),
}


def last_number(text):
    return max((i for i, w in enumerate(text.split()) if w.isdigit()), default=-1)


def test_every_copied_item_is_found_and_nothing_else(spark):
    """Short and long items, copied word for word, in other case, with one slot in conflict, and half of them."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "eé", "Io", "u.", "ei", "o")] + ["12", "12", "7"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 37, 50])))) for i in range(60)]
    plain = [w.upper() + "x" for w in words]
    rows, planted = [], set()
    for d in range(420):
        text = rng.choices(plain, k=rng.choice([0, 20, 200]))
        if d % 3 == 0:
            item, change = items[d // 3 % 60], rng.choice(list(CHANGES))
            n = len(item[1].split())
            # half of a short item is not enough of it, and a short item must stand word for word
            if change in ("half", "one number") and n < 20:
                change = "verbatim"
            text[len(text) // 2 : len(text) // 2] = CHANGES[change](item[1], rng).split(" ")
            planted.add((d, item[0], change))
        rows.append((d, rng.choice([" ", "\n"]).join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = contaminated_documents(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in df}
    assert [p for p in planted if p[:2] not in got] == []
    # what else is found is a short item inside a planted one, or a piece of one
    assert {d for d, _ in got} <= {d for d, _, _ in planted}


@pytest.mark.parametrize(
    "copy, changed",
    [
        ("Tom buys 5 red apples at the old market and then he walks 5 km back to the small house.", 0),
        ("Tom buys 7 red apples at the old market and then he walks 9 km back to the small house.", 1),
        ("Tom buys 5 red apples at the old market and then he walks 9 miles back to the small house.", 1),
        ("TOM BUYS 7 RED APPLES AT THE OLD MARKET AND THEN HE WALKS 9 KM BACK TO THE SMALL HOUSE.", 1),
    ],
)
def test_roles_that_share_a_value(spark, copy, changed):
    """Two roles of one value that are given different ones are cut into two consistent runs."""
    item = "Tom buys 5 red apples at the old market and then he walks 5 km back to the small house."
    docs = spark.createDataFrame([(1, f"some words before. {copy} And some after it.")], "doc_id long, text string")
    got = contaminated_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]
    assert got[0].changed >= changed


def test_number_words_and_units_of_four_languages():
    for a, b in [
        ("sie lief 5 Stunden dahin", "sie lief 12 Tage dahin"), ("il y a deux pommes", "il y a 7 pommes"),
        ("vio tres casas", "vio 9 casas"), ("elle dort 8 heures ici", "elle dort 3 jours ici"),
    ]:
        assert Templates(pa.array([a]), "folded").codes.tolist() == Templates(pa.array([b]), "folded").codes.tolist()


def test_a_small_bitmap_lets_all_held_values_through(spark):
    from verdure.llm.bitmaps import may_hold

    held = spark.range(500).selectExpr("md5(cast(cast(id as string) as binary)) as digest")
    every = spark.range(20_000).selectExpr("id", "md5(cast(cast(id as string) as binary)) as digest")
    for bits in (6, 12, 20):
        passed = {r.id for r in every.where(may_hold(held, "digest", bits)).collect()}
        assert passed >= set(range(500)) and (bits < 20 or len(passed) < 600)
    assert every.where(may_hold(held.limit(0), "digest")).count() == 0


def test_work_arrays_are_bounded():
    import tracemalloc

    from verdure.llm.decontamination import _FORMS, _template_slices

    batch = pa.record_batch({"text": [" ".join(f"Word{i % 97} w{i % 13}." for i in range(500)) + f" {n}" for n in range(1200)]})
    assert batch.nbytes > 6_000_000
    tracemalloc.start()
    seen = sum(len(forms["folded"].windows(8)[2]) for part, forms in _template_slices(batch, _FORMS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = Templates(batch.column("text"), "folded")
    assert seen == len(whole.windows(8)[2]) and peak < 250_000_000
