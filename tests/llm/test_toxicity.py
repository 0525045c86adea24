import random

import numpy as np

from pitmill.llm.toxicity import FEATURES, Lexicon, errors_allowed, features, fit_logistic, score, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_levenshtein():
    terms = {"idiot": True, "disgusting": True, "scum": True, "moron": True, "lostra": False, "vequ": False}
    lexicon, rng = Lexicon(terms), random.Random(2)
    words = [*terms, "idoit", "1diot", "idiots", "disgustng", "dsgusing", "scam", "", "lostr", "lostraun", "lostruun", "vequille", "vaquille"]
    for _ in range(3000):
        w = list(rng.choice(list(terms)) + rng.choice(["", "un", "s"]))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w)) : rng.randrange(len(w)) + rng.randint(0, 1)] = rng.choice(["", "a", "d", "o", "st"])
            w = w or ["x"]
        words.append("".join(w))
    for w in words:
        costs = []
        for t, whole in terms.items():
            d = distance(w, t) if whole else min(distance(w[:n], t) for n in range(len(w) + 1))
            if d <= errors_allowed(t, whole):
                costs.append(d)
        got = lexicon.find(w)
        assert (got[1] if got else None) == (min(costs) if costs else None), (w, got, costs)


def test_quotation_is_told_from_abuse():
    lexicon = Lexicon({"idiot": True})
    aimed, quoted = features("You are an idiot today", lexicon), features('He wrote "what an idiot" there', lexicon)
    assert aimed[0] > 0 == aimed[3] and quoted[3] > 0 == quoted[0]
    long = "x" * 9 + " and so on" * 60
    for text in [f'"{long} idiot {long}" he', f"„{long} idiot“ sagte", f"« {long} « a » idiot » b", f'a "b" “{long} idiot {long}” c', f"‘don’t» {long}", f'a "{long} idiot']:
        got = features(text, lexicon)
        assert (got[3] > 0 == got[0]) == ("idiot" in text), text
    for text in [f'"{long}" idiot {long}', f'"{long}\nidiot {long}', f"isn’t ”a” idiot {long}", f"« {long} » idiot » b"]:
        got = features(text, lexicon)
        assert got[0] > 0 == got[3], text
    assert features(None, lexicon) == features("", lexicon) == features("calm words", lexicon) == [0.0] * FEATURES


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8)))
    rows = []
    for k in range(900):
        words = [word() for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "badterm", "vilething", "nastyw0rd"]))
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    lexicon, theta = train(docs, labels)
    assert {"badterm", "vilething"} <= set(lexicon.terms) and lexicon.find("nastyw0rd") and not lexicon.find("nastier")
    got = score(docs, (lexicon, theta)).toPandas()
    held = got[got.held_out]
    truth = np.array([rows[k][2] for k in held.doc_id])
    assert (truth == held.predicted).mean() > 0.97


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score(docs, train(docs, none)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert score(docs.limit(0), (Lexicon({}), fit_logistic(np.empty((0, FEATURES)), np.empty(0)))).collect() == []


def test_ties_at_the_threshold(spark):
    docs = spark.createDataFrame([(1, "calm"), (2, "idiot")], "doc_id long, text string")
    theta = np.zeros(FEATURES + 1)
    assert [r.predicted for r in score(docs, (Lexicon({"idiot": True}), theta)).collect()] == [1, 1]


def test_score_equals_brute_force(spark):
    """Every term by plain edit distance over the whole text, and the context by hand."""
    rng, terms = random.Random(8), {"idiot": True, "lostra": False, "scum": True}
    lexicon, theta = Lexicon(terms), np.array([0.9, 0.4, 0.5, -0.7, -0.2, 0.3, 0.1, -1.2])
    words = ["you", "said", "calm", "idiot", "idoit", "lostraun", "lostru", "scum", "scam", "tree", "are", "wrote"]
    rows = [(k, "\n".join(" ".join(rng.choice(words) if rng.random() < 0.9 else f'"{rng.choice(words)} {rng.choice(words)}"' for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4)))) for k in range(80)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), (lexicon, theta)).collect()}
    reporting, address = {"said", "wrote"}, {"you", "are"}
    for key, text in rows:
        every, inside = [], []
        for line in text.split("\n"):
            for part, quoted in [(p, k % 2 == 1) for k, p in enumerate(line.split('"'))]:
                every += part.split()
                inside += [quoted] * len(part.split())
        sums, seen = [0.0] * 6, set()
        for k, w in enumerate(every):
            costs = [(d, t) for t, whole in terms.items() if (d := distance(w, t) if whole else min(distance(w[:n], t) for n in range(len(w) + 1))) <= errors_allowed(t, whole)]
            if not costs:
                continue
            errors, term = min(costs)
            around = set(every[max(0, k - 6) : k] + every[k + 1 : k + 7])
            quoted = inside[k] or bool(around & reporting)
            if errors:
                sums[4 if quoted else 2] += 1
            else:
                sums[3 if quoted else 0] += 1
                sums[1] += bool(not quoted and around & address)
                seen.add(term)
        exact = sums[0] + sums[3]
        sums[5] = len(seen)
        x = np.append(np.log1p(sums), np.log1p(100 * exact / len(every)) if every else 0.0)
        assert abs(got[key] - 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1])))) < 1e-9, text
