import random

from scanloom.llm import leaks

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def search(text, items, **kw):
    return leaks.Index(items, kw.get("window", 13), kw.get("edits", 2)).search(text)


def test_exact_and_near():
    w = ITEM.split()
    assert search("zz " + " ".join(w[1:14]) + " yy", [(1, ITEM)]) == {1: 0}
    assert search(" ".join(w[:12]), [(1, ITEM)]) == {1: 1}
    assert search(" ".join([*w[:5], "x", *w[6:13]]), [(1, ITEM)]) == {1: 1}
    assert search(" ".join([*w[:4], *w[5:13], "q"]), [(1, ITEM)])[1] <= 2
    assert search("nothing here", [(1, ITEM)]) == {}
    assert search(ITEM.upper().replace(" ", " -- "), [(1, ITEM)]) == {1: 0}


def test_short_items():
    assert search("so yes indeed", [(1, "Yes!"), (2, "yes indeed"), (3, "indeed yes"), (4, ""), (5, None), (6, "...")]) == {1: 0, 2: 0}
    assert search("we saw remote printers in the hall", [(1, "remote code execution")]) == search("learn sql today", [(1, "sql injection")]) == {}
    assert search("a wholly new plan for the winter", [(1, "a whole new plan for"), (2, "an old plan")]) == {1: 1}


def brute_leaks(text, item, window, edits):
    """Least edit distance of any passage to any run of words, by the full table."""
    t, w = leaks.words_of(text), leaks.words_of(item)
    m = min(len(w), window)
    best = None
    for start in range(len(w) - m + 1) if w else ():
        p = w[start : start + m]
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        d = min(row)
        if d <= min(edits, m // 5) and (best is None or d < best):
            best = d
    return best


def test_near_cases_against_brute_force():
    rng = random.Random(5)
    words = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 18)))) for n in range(25)]
    index = leaks.Index(items, 13, 2)
    for _ in range(80):
        doc = [rng.choice(words) for _ in range(rng.randint(0, 20))]
        src = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(src))
            src[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            src = src or ["w0"]
        doc[2:2] = src
        text = " ".join(doc)
        want = {i: d for i, t in items if (d := brute_leaks(text, t, 13, 2)) is not None}
        assert index.search(text) == want


def test_distance_against_dynamic_programme():
    rng = random.Random(3)
    for _ in range(300):
        p, t = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))], [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for x in t:
            new = [0]
            for i, y in enumerate(p, 1):
                new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != y)))
            row = new
            best = min(best, row[-1])
        assert leaks.best_distance(leaks.column_masks(p), len(p), t, len(p)) == best


def test_exact_cases_against_brute_force():
    rng = random.Random(9)
    words = [f"w{n}" for n in range(12)]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))) for n in range(30)]
    index = leaks.Index(items, 5, 1)
    for _ in range(60):
        doc = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            src = rng.choice(items)[1].split()
            doc[3:3] = src[: rng.randint(1, 8)]
        text = " ".join(doc)
        want = set()
        for i, t in items:
            w = t.split()
            m = min(5, len(w))
            if any(f" {' '.join(w[k : k + m])} " in f" {text} " for k in range(len(w) - m + 1)):
                want.add(i)
        assert {i for i, d in index.search(text).items() if d == 0} == want


def test_frames(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "x " * 50_000 + ITEM)], "doc_id long, text string").selectExpr("*", "0 as item_id")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "")], "item_id long, text string")
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == {(1, 10, 0), (4, 10, 0)}
    blocks = leaks.leaks(docs, items.unionByName(spark.createDataFrame([(13, "one two three")], items.schema)), block_chars=20)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.where("edits = 0").collect()} == {(1, 10), (4, 10), (1, 13), (4, 13)}
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0
