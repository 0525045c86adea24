import re

from pitmill.llm.decontamination import MIN_PLAIN, contaminated

ITEM = "A train leaves Boston at 9 and travels 120 km before lunch while another train leaves Denver and travels 80 km in the same time."


def pairs(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string, hash long, n int, slots string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contaminated(d, b).collect()}


def test_templates(spark):
    def change(text, **by):
        for a, b in by.items():
            text = re.sub(rf"\b{a.strip('_')}\b", b, text)
        return text

    docs = [
        (1, "Before. " + ITEM + " After this."),
        (2, change(ITEM, Boston="Paris", Denver="Lyon", _9="7", _120="340", _80="95")),
        (3, change(ITEM, Boston="Paris", Denver="Paris", _120="80", _9="80")),  # values fell together
        (4, ITEM.upper()),
        (5, "A train leaves on time and nothing else of this is alike, whatever one may think of it."),
        (6, None),
        (7, ""),
        (8, "... !! ---"),
        (9, "\n".join(ITEM.split())),
        (10, "word " * 20000 + ITEM),
        (None, ITEM),
    ]
    docs = [(k, t, 1, 2, "x") for k, t in docs] + [(1, "Before. " + ITEM + " After this.", 1, 2, "x")]
    got = pairs(spark, docs, [(70, ITEM), (71, "Short item here."), (72, None), (73, "")])
    assert {k for k, _ in got} >= {1, 2, 3, 10} and not {k for k, _ in got} & {5, 6, 7, 8}
    assert got[3, 70].weight == 0.5 and got[2, 70].weight == 1
    assert got[1, 70].coverage == 1 and got[1, 70].n_changed_slots == 0
    assert got[2, 70].coverage == 1 and got[2, 70].n_changed_slots == 5


def test_short_item_and_empty_tables(spark):
    assert set(pairs(spark, [(1, "It is a short item here, truly.", 0, 0, "")], [(5, "A short item here.")])) == {(1, 5)}
    assert pairs(spark, [], [(5, "a b c")]) == {} == pairs(spark, [(1, "a b c", 0, 0, "")], [])


def test_exact_windows_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    bench = [(k, " ".join(word() for _ in range(rng.randint(3, 30)))) for k in range(20)]
    docs = []
    for k in range(60):
        item = rng.choice(bench)[1].split()
        a = rng.randrange(len(item))
        part = item[a : a + rng.randint(1, 30)] if k % 2 else item
        docs.append((k, " ".join([word() for _ in range(rng.randint(0, 40))] + part + [word() for _ in range(5)]), 0, 0, ""))
    want = set()
    for d, text, *_ in docs:
        w = text.split()
        for i, item in bench:
            x = item.split()
            if len(x) < MIN_PLAIN and w != x:
                continue
            size = min(8, len(x))
            diagonals = {}
            for p in range(len(w) - size + 1):
                for q in range(len(x) - size + 1):
                    if w[p : p + size] == x[q : q + size]:
                        diagonals.setdefault(p - q, set()).update(range(q, q + size))
            near = []
            for d_, c in sorted(diagonals.items()):
                near.append((d_, c | near[-1][1] if near and d_ - near[-1][0] <= 8 else c))
            if any(len(c) / len(x) >= 0.5 or len(c) >= 30 for c in [*diagonals.values(), *(c for _, c in near)]):
                want.add((d, i))
    assert set(pairs(spark, docs, bench)) == want


def test_case_line_breaks_and_longer_names(spark):
    item = "Anna met Berta near Calais while Dora saw Emil at Florence and then Greta left with Hugo for Izmir."
    rows = [(1, item.upper()), (2, item.lower()), (3, "\n".join(item.split())), (4, ITEM.upper()), (9, "\n".join(ITEM.split()))]
    rows += [(5, ITEM.replace("Boston", "New York").replace("120", "1 200").replace("Denver", "San Jose")), (6, "Nothing of this kind is said here at all, by anyone in any place.")]
    got = pairs(spark, [(k, t, 0, 0, "") for k, t in rows], [(70, ITEM), (71, item)])
    assert set(got) == {(1, 71), (2, 71), (3, 71), (4, 70), (9, 70), (5, 70)}
    assert got[5, 70].coverage == 1 and got[5, 70].n_changed_slots == 3


def test_values_that_fall_together_and_words_put_in(spark):
    item = "Yesterday Tom buys 3 apples and 4 pears at the shop for his sister."
    rows = [(1, item.replace("3", "7").replace("4", "7")), (2, item.replace("3", "5").replace("4", "9")), (3, item.replace("3 apples", "3 apples").replace("4", "3"))]
    long = " ".join(f"word{chr(97 + k)}{chr(97 + k // 7)}" for k in range(20))
    parts = long.split()
    rows += [(4, " ".join([*parts[:10], "indeed", *parts[10:]])), (5, " ".join([*parts[:8], *(f"other{k}x" for k in "abcdefghijklm"), *parts[12:]]))]
    got = pairs(spark, [(k, t, 0, 0, "") for k, t in rows], [(70, item), (71, long)])
    assert set(got) >= {(1, 70), (2, 70), (3, 70), (4, 71)} and (5, 71) not in got
    assert got[2, 70].weight == 1 and got[1, 70].weight < 1 and got[4, 71].coverage == 1 and got[4, 71].n_diagonals == 2


def test_rows_that_share_an_id_are_not_mixed(spark):
    words = ITEM.split()
    rows = [(1, " ".join(words[:9])), (1, " ".join(["x"] * 9 + words[9:17])), (2, ITEM), (2, None)]
    assert set(pairs(spark, [(k, t, 0, 0, "") for k, t in rows], [(70, ITEM)])) == {(2, 70)}


def test_slots_that_contradict_each_other(spark):
    item = "Today Anna gives 3 red apples to Berta before Anna takes 5 pears and Berta counts 3 of them again for Anna."
    rows = [(1, item.replace("Anna", "Dora").replace("3", "8")), (2, item.replace("gives 3", "gives 4").replace("counts 3", "counts 9").replace("Berta before", "Carla before").replace("for Anna", "for Emma"))]
    assert set(pairs(spark, [(k, t, 0, 0, "") for k, t in rows], [(70, item)])) == {(1, 70)}


def test_short_items_fit_only_themselves(spark):
    bench = [(1, "42"), (2, "in Rome"), (3, "Yes"), (4, "3 + 4 = 7"), (5, "Anna and Berta 5 km")]
    rows = [(1, "I bought 7 apples at the market"), (2, "We met in Paris yesterday"), (3, "the answer is yes"), (4, "8 + 9 = 17 km"), (5, "Yes, in Rome 42 times"), (6, "then Carla and Dora 9 km away")]
    rows += [(11, "42"), (12, "in rome."), (13, "YES!"), (14, "yes yes")]
    got = set(pairs(spark, [(k, t, 0, 0, "") for k, t in rows], bench))
    assert got == {(11, 1), (12, 2), (13, 3)}


def test_a_window_that_a_third_of_the_documents_hold(spark):
    rows = [(k, f"start {k} " + ITEM.replace("120", str(200 + k))) for k in range(300)] + [(1000 + k, f"quite another text number {k} about nothing at all") for k in range(600)]
    got = pairs(spark, [(k, t, 0, 0, "") for k, t in rows], [(70, ITEM), (71, ITEM.replace("Boston", "Lima")), (72, "5")])
    assert set(got) == {(k, i) for k in range(300) for i in (70, 71)}
