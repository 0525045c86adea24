import random
import re

import numpy as np

from pitmill.llm.common import span_hashes
from pitmill.llm.span_dedup import CUT, MAX_WORDS, MIN_WORDS, PAIR, PIECE_WORDS, RUN, dedup_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(w):
    return re.sub("[A-Z]", lambda m: m.group().lower(), w)


def chosen(w):
    raw = np.frombuffer(lower(w).encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) % CUT == 0


def split(text):
    words = list(WORD.finditer(text))
    opens = []
    for k, w in enumerate(words):
        before = words[k - 1].group() if k else "."
        gap = text[words[k - 1].end() : w.start()] if k else ""
        opens.append(k == 0 or bool(re.search(r"[.!?][\"')\]]?$", before) or re.search(r"[\n\x0b\f\r]", gap)))
    first = [k for k, o in enumerate(opens) if o] + [len(words)]
    starts = [k for a, b in zip(first, first[1:]) for k in range(a, b) if k == a or b - a > MAX_WORDS and chosen(words[k - 1].group())]
    long = {k for a, b in zip(first, first[1:]) for k in range(a, b) if b - a > MAX_WORDS}
    starts = [k for a, b in zip(starts, [*starts[1:], len(words)]) for k in (range(a, b, PIECE_WORDS) if a in long else [a])]
    bounds = [0, *(words[k].start() for k in starts[1:]), len(text)]
    groups = [[w.group() for w in words[a:b]] for a, b in zip(starts, [*starts[1:], len(words)])]
    return [(text[a:b], [lower(w) for w in g], k in long) for a, b, g, k in zip(bounds, bounds[1:], groups, starts)] if words else []


def brute_force(rows):
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        parts = split(text or "")
        gone = set()
        count = lambda a, b: sum(len(w) for _, w, _ in parts[a:b])
        for k in range(len(parts)):
            if parts[k][2]:
                end = k + RUN
                while end < len(parts) and count(k, end) < MIN_WORDS:
                    end += 1
                ends = [end] if all(p for _, _, p in parts[k:end]) and count(k, end) >= MIN_WORDS else []
            else:
                ends = [k + RUN] + [k + PAIR] * (count(k, k + PAIR) >= MIN_WORDS)
                ends = [e for e in ends if not any(p for _, _, p in parts[k:e])]
            for end in ends:
                words = [tuple(w) for _, w, _ in parts[k:end]]
                if end <= len(parts) and seen.setdefault(tuple(words), (key, k)) != (key, k):
                    gone |= set(range(k, end))
        out[key] = text if not gone else "".join(t for k, (t, _, _) in enumerate(parts) if k not in gone)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    bank = [" ".join(rng.choice(["Ab", "cd", "efg", "h", "ijkl"]) + str(rng.randrange(30)) for _ in range(rng.choice([rng.randint(1, 40), 130]))) + rng.choice([". ", "!\n", "?) ", "\n\n", " "]) for _ in range(60)]
    rows = [(k, "".join(rng.choice(bank) if rng.random() < 0.5 else "".join(bank[i : i + 5]) for i in [rng.randrange(55) for _ in range(rng.randint(0, 8))])) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, rows[3][1].upper()), (104, "one two. " * 3000), (105, "OH!! " * 500), (106, "Oh!! " * 20), (107, "As " * 200)]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, run int").repartition(4)
    got = {r.doc_id: r.text for r in dedup_spans(df).collect()}
    assert got == brute_force(rows)


def test_empty_nulls_and_repeated_rows(spark):
    text = "a b c d e f. g h i j k l. m n o p q r. s t u v."
    assert dedup_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in dedup_spans(rows).collect())
    assert got == [(0, "", 4), (1, "", 4), (1, text, 0), (2, "", 0)]


def test_a_sentence_stays_whole_at_every_length(spark):
    for n in (16, 17, 60):
        words = lambda c: " ".join(f"{c}{i}" for i in range(n)) + ". "
        two, one = words("p") + words("q"), words("r")
        rows = [(1, f"Before here. {two}After. "), (2, f"Other start. {two}End of it. "), (3, f"Third one. {one}Go. "), (4, f"Fourth one. {one}Stop. ")]
        got = {r.doc_id: (r.text, r.n_removed) for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: (rows[0][1], 0), 2: ("Other start. End of it. ", 2), 3: (rows[2][1], 0), 4: (rows[3][1], 0)}


def test_runs_of_short_sentences(spark):
    text = "Yes. No. Ok. Fine."
    rows = [(1, f"{text} Something else here. {text}"), (2, f"Before it. {text} After it."), (3, "Yes. No."), (4, "Ok. Fine. Yes. No. Sure.")]
    got = {r.doc_id: r.text for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)
    assert (got[1], got[2], got[3]) == (f"{text} Something else here. ", "Before it. After it.", "Yes. No.")


def test_passage_of_51_words_in_text_without_punctuation(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    rows, passages = [], []
    for k in range(60):
        passages.append(words(51))
        rows += [(key, " ".join(words(rng.randint(40, 90)) + passages[k] + words(rng.randint(40, 90)))) for key in (k, 1000 + k)]
    got = {r.doc_id: r for r in dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_removed == 0 for k in range(60))
    left = [len(set(got[1000 + k].text.split()) & set(passages[k])) for k in range(60)]
    assert all(got[1000 + k].n_removed >= 3 for k in range(60)) and max(left) <= 39


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(2)
    text = lambda n: "".join(" ".join(f"q{rng.randrange(10**6)}" for _ in range(6)) + ". " for _ in range(n))
    a, b, c, own = text(4), text(5), text(4), [text(n) for n in (3, 9, 1, 6, 2, 8)]
    rows = [(1, a), (5, own[0] + a), (5, own[1] + b), (5, own[2]), (5, own[1]), (7, b + own[3]), (None, own[4] + c), (None, own[5] + c + a), (None, c), (None, "short.")]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, i int").coalesce(1)
    got = [(r.text, r.n_removed) for r in sorted(dedup_spans(df).collect(), key=lambda r: r.i)]
    assert got == [(a, 0), (own[0], 4), (own[1] + b, 0), (own[2], 0), ("", 9), (own[3], 5), (own[4] + c, 0), (own[5], 8), ("", 4), ("short.", 0)]
