import random

from citeloom.llm.decontaminate import drop_contaminated, find_contaminated, item_templates

ITEM = "Yesterday the shop of Alice sold 12 apples and 5 km of rope, so Alice earned $40 before the evening came."
OTHER = ITEM.replace("Alice", "Robert").replace("12", "730").replace("5 km", "9km").replace("$40", "$99")
MIXED = ITEM.replace("of Alice", "of Robert")  # one slot with two values
CLEAN = "Completely different words stand in this text and none of them was taken from any item of the benchmark at all."


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, items):
    return {r.doc_id: r for r in find_contaminated(docs, items).collect()}


def test_verbatim_reparameterised_and_clean(spark, make_docs):
    filler = "Some words before it. " * 40
    docs = make_docs([(1, filler + ITEM + " " + filler), (2, CLEAN), (3, filler + OTHER), (4, ITEM.lower()), (5, None), (6, ""), (7, MIXED), (8, filler * 300 + ITEM), (1, CLEAN), (9, ITEM + " " + ITEM)])
    got = found(docs, bench(spark, [(70, ITEM), (71, "Wholly unrelated benchmark words that no document of this small table ever holds."), (72, None), (73, "")]))
    assert set(got) == {1, 3, 4, 8, 9}
    assert got[3].item_id == 70 and list(got[3].item_ids) == [70] and got[1].coverage == 1.0
    kept = drop_contaminated(docs, bench(spark, [(70, ITEM)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7] and kept.columns == docs.columns


def test_slot_consistency(spark, make_docs):
    item = "Then Alice met Bob and Alice gave Bob the book while Alice went with Bob to the river where Alice left Bob alone."
    swapped = item.replace("Alice", "Carol").replace("Bob", "David")
    merged = item.replace("Bob", "Alice")
    got = found(make_docs([(1, swapped), (2, merged)]), bench(spark, [(1, item)]))
    assert set(got) == {1}


def test_templates_shared_by_items_and_ties(spark, make_docs):
    items = bench(spark, [(i, ITEM.replace("12", str(i))) for i in range(5, 45)] + [(3, ITEM)] * 3)
    got = found(make_docs([(1, OTHER), (2, CLEAN)]), items)
    assert set(got) == {1} and got[1].item_id == 3 and list(got[1].item_ids) == [3]


def test_short_texts_and_empty_tables(spark, make_docs):
    docs = make_docs([(1, "The Answer here."), (2, "In a text the answer here is part."), (None, ITEM)])
    items = bench(spark, [(1, "the answer here"), (2, "5 7 9"), (3, ITEM), (4, "the text")])
    assert set(found(docs, items)) == {1, 2, None}
    assert found(docs.where("false"), items) == {} and found(docs, items.where("false")) == {}
    longer = make_docs([(1, CLEAN + " Someone asked: Who wrote Hamlet? " + CLEAN), (2, CLEAN + " 5 7 9"), (3, CLEAN + " the text " + CLEAN), (4, "The text."), (5, "5 7 8 is not it")])
    got = found(longer, bench(spark, [(1, "who wrote Hamlet"), (2, "5 7 9"), (4, "the text")]))
    assert {d: list(r.item_ids) for d, r in got.items()} == {1: [1], 2: [2], 4: [4]}


def test_bare_windows_count(spark, make_docs):
    """An item made mostly of numbers is not found by its few windows with words."""
    item = "Compute the sum 12 34 56 78 90 21 43 65 87 98 76 54 32 10"
    got = found(make_docs([(1, "Compute the sum 1 2 3 and then go home."), (2, CLEAN + " " + item + " " + CLEAN), (3, item.replace("56", "57"))]), bench(spark, [(1, item)]))
    assert {d: r.coverage for d, r in got.items()} == {2: 1.0}


def test_brute_force_on_plain_words(spark, make_docs):
    """Texts without names and numbers: a document holds an item if it has four fifths of its five-word windows."""
    rng = random.Random(9)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.choice('xyz')}w"
    items = [(i, [word() for _ in range(rng.choice([3, 4, 5, 6, 12, 30]))]) for i in range(25)]
    docs = []
    for d in range(120):
        part = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2])):
            part[rng.randrange(len(part))] = word()
        docs.append((d, [word() for _ in range(rng.randrange(30))] + part + [word() for _ in range(rng.randrange(30))]))
    grams = lambda ws, n: [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]
    want = {}
    for d, ws in docs:
        for i, item in items:
            n = min(5, len(item))
            held = set(grams(ws, n)) if len(item) >= 3 else set()
            hit = [g in held for g in grams(item, n)]
            if sum(hit) >= 0.8 * len(hit):
                want.setdefault(d, []).append(i)
    got = found(make_docs([(d, " ".join(ws)) for d, ws in docs]), bench(spark, [(i, " ".join(ws)) for i, ws in items]))
    assert {d: list(r.item_ids) for d, r in got.items()} == want and 30 < len(want) < 120


def test_one_conflict_costs_its_own_windows_only(spark, make_docs):
    starts = "The river runs past the old mill and on to the sea beyond the hills of home. The miller grinds corn there every morning while children play near water and dogs sleep under trees until late evening."
    names = "In that long summer our neighbour Anna carried fresh bread across the wide market square each morning and later in the cold winter months Anna sold warm soup near the station to people who waited there."
    docs = make_docs([(1, starts.replace("The miller", "A miller")), (2, names.replace("neighbour Anna", "neighbour Maria")), (3, names.replace("Anna", "Maria")), (4, CLEAN)])
    got = found(docs, bench(spark, [(1, starts), (2, names)]))
    assert {d: r.item_id for d, r in got.items()} == {1: 1, 2: 2, 3: 2}
    assert got[3].coverage == 1.0 and 0.8 <= got[2].coverage < 1.0


def test_items_of_numbers_and_members_of_templates(spark, make_docs):
    sums = "Compute 12 34 56 78 90"
    docs = make_docs([(1, "Some words before. " + sums + " and some words after."), (2, sums.replace("34", "35")), (3, "compute: 12 34 56 78 90"), (4, "3 km 7"), (5, "3 km 8"), (6, CLEAN), (7, "12 34 56 78 90")])
    items = bench(spark, [(1, sums), (2, "3 km 7"), (3, "Compute 1 2 3 4 5"), (10, ITEM), (11, OTHER), (12, ITEM)])
    assert {d: list(r.item_ids) for d, r in found(docs, items).items()} == {1: [1], 3: [1], 4: [2]}
    assert {r.item_id: r.template_id for r in item_templates(items).collect()} == {1: 1, 2: 2, 3: 3, 10: 10, 11: 10, 12: 10}
