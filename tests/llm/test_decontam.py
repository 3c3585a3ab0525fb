import itertools
import random
import re

from tidemill.llm import decontam


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, cls string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, h string")
    return sorted(((r.doc_id, r.item_id, r.equal) for r in decontam.contaminated(d, b).collect()), key=repr)


def brute(docs, items):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    best = {}
    for (d, x), (i, y) in itertools.product(docs, items):
        a, b = tok(x), tok(y)
        if len(b) < 8:
            continue
        need = 13 if len(b) >= 16 else len(b) - len(b) * 3 // 16
        for at in range(-len(b), len(a)):
            same = [0 <= at + k < len(a) and a[at + k] == w for k, w in enumerate(b)]
            if any(sum(same[k : k + 16]) >= need for k in range(len(b))):
                best[d, i] = max(best.get((d, i), 0), sum(same))
    return sorted(((d, i, n) for (d, i), n in best.items()), key=repr)


def test_substitutions_and_edges(spark):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([16, 20, 40, 12, 9, 8, 7, 3, 0])] + [(20, None), (21, ""), (None, "n1 n2 n3 n4 n5 n6 n7 n8 n9 n10")]
    items += [(30, items[1][1]), (31, items[1][1].upper())]
    docs = [(1, None), (2, ""), (3, "v1"), (None, items[2][1])]
    for k in range(60):
        body = [rng.choice(vocab) for _ in range(30)]
        w = items[k % 9][1].split()
        for _ in range(k % 5):
            if len(w) >= 16:  # below that, the masks promise only unchanged copies
                w[rng.randrange(len(w))] = "changed"
        docs.append((100 + k, " ".join(body + w).replace("v1 ", "V1, ")))
    docs.append((100, docs[4][1]))
    assert run(spark, docs, items) == brute(docs, items)


def test_masks_find_every_window_with_three_substitutions():
    for gone in itertools.combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.EQUAL):
        assert any(all(c == "0" or p + i not in gone for i, c in enumerate(m)) for m in decontam.MASKS for p in range(decontam.WINDOW - len(m) + 1))


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    items = [(1, " ".join(f"a{i}" for i in range(20)))]
    docs = [(1, "x " + items[0][1] + " y"), (2, "nothing here of it")]
    sent = run(spark, docs, items)
    monkeypatch.setattr(decontam, "SEND_ROWS", 0)
    assert run(spark, docs, items) == sent == [(1, 1, 20)]


def test_clean_and_empty(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(20)), 5), (2, "fine", 6), (None, None, 7)], "doc_id long, text string, at int")
    items = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(20)))], "item_id long, text string")
    assert sorted(r.at for r in decontam.clean(docs, items).collect()) == [6, 7]
    assert decontam.clean(docs, items.limit(0)).count() == 3
    assert decontam.contaminated(docs.limit(0), items).count() == 0


def test_masks_of_short_items_find_every_allowed_pattern():
    for n in range(decontam.LEAST, decontam.WINDOW):
        masks = [m for m, low, high in decontam.SIZED if low <= n <= high]
        for gone in itertools.combinations(range(n), n * 3 // 16):
            assert any(all(c == "0" or p + i not in gone for i, c in enumerate(m)) for m in masks for p in range(n - len(m) + 1)), (n, gone)


def test_short_items_with_changes_and_word_for_word(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 16)]
    docs = []
    for n, text in items:
        for gone in itertools.combinations(range(n), n * 3 // 16 if n >= 8 else 0):
            docs.append((len(docs), "before " + " ".join("changed" if k in gone else w for k, w in enumerate(text.split())) + " after"))
        docs.append((len(docs), " ".join(text.split()[1:])))  # at the start of a document, without the first token
    assert run(spark, docs, items) == brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    short = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(d, b, 1).collect() if r.item_id < 8)
    assert short == sorted((i, n) for i, t in docs for n, x in items[:7] if f" {x} " in f" {t} ")
    assert {r.doc_id for r in decontam.clean(d, b.where("item_id < 8")).collect()} == {i for i, _ in docs} - {i for i, _ in short}


def test_rows_that_share_an_id_or_have_none(spark):
    leak = " ".join(f"a{i}" for i in range(20))
    docs = spark.createDataFrame([(None, leak, 1), (None, "fine", 2), (5, "before " + leak, 3), (5, "clean text of the same id", 4), (6, leak, 5), (6, leak, 6)], "doc_id long, text string, at int")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted(r.at for r in decontam.clean(docs, bench).collect()) == [2, 4]
    assert sorted(((r.doc_id, r.place) for r in decontam.contaminated(docs, bench).collect()), key=repr) == [(5, 1), (6, 0), (None, 0)]


def test_a_common_word_in_a_long_text(spark):
    """A one-token item at thousands of places, and an item that hangs over either end of the text."""
    words = ["the" if i % 4 == 0 else f"w{i}" for i in range(20000)]
    tail = [f"q{i}" for i in range(16)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(tail[2:] + ["x"] * 40)), (3, " ".join(["x"] * 40 + tail[:14]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the"), (8, " ".join(tail))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.place, r.equal) for r in decontam.contaminated(docs, items, 1).collect()}
    assert got == {(1, 7): (0, 1), (2, 8): (-2, 14), (3, 8): (40, 14)}
    plan = decontam._pairs(docs, items, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1  # the hits are written: what is left reads each text once
