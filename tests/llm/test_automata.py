"""The suffix automata: many windows of one word, items without id, parts built apart."""

import random
import time

from strandline.llm import decontaminate as D


def test_one_word_item_is_linear():
    took = []
    for n in (4000, 64_000):
        began = time.time()
        a = D.Automaton([("x", [b"a"] * n)], 10)
        took.append(time.time() - began)
        assert a.scan([b"a"] * 12 + [b"b"] * 3 + [b"a"] * 9) == ([[0, 12]], {0}, 12)
    assert took[1] < 80 * max(took[0], 0.01)


def test_windows_against_plain():
    rng = random.Random(4)
    for _ in range(60):
        words = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        items = [(str(i), [rng.choice(words) for _ in range(rng.randint(1, 30))]) for i in range(rng.randint(1, 6))]
        a = D.Automaton(items, 5)
        doc = [rng.choice([*words, b"z"] if rng.random() < 0.5 else words) for _ in range(60)]
        hit, who = set(), set()
        for k, (_, w) in enumerate(items):
            n = min(5, len(w))
            for j in range(len(w) - n + 1):
                for i in range(len(doc) - n + 1):
                    if doc[i : i + n] == w[j : j + n]:
                        hit |= set(range(i, i + n))
                        who.add(k)
        spans, got, _ = a.scan(doc)
        assert {x for s, e in spans for x in range(s, e)} == hit and got == who


def test_items_without_id(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text), (2, text + " " + text), (3, "none of them")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, text), ("None", "nine ten eleven"), ("7", None)], "item_id string, text string")
    for chars in (1000, 10):
        got = {r.doc_id: (len(r.hit_spans), r.hit_items) for r in D.find_hits(docs, items, chars=chars).collect()}
        assert got == {1: (1, ["None"]), 2: (1, ["None"]), 3: (0, [])}
    assert D.find_hits(docs, items.filter("item_id IS NULL")).filter("size(hit_spans) > 0 AND size(hit_items) = 0").count() == 2


def test_parts_are_bounded_whatever_the_items(spark):
    """Ten thousand equal rows are one, a long item is cut, and no part outgrows its bound."""
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(20_000))
    rows = [("same", "equal text of some ten words that repeats over and over")] * 10_000 + [("long", long)] + [(str(i), f"short item {i}") for i in range(50)]
    items = spark.createDataFrame(rows, "item_id string, text string")
    chars = 5000
    sizes = [sum(D.opened(str(k), packed).len) for k, (packed, _) in enumerate(D.automata(items, chars=chars))]
    assert 15 < len(sizes) < 60
    words = [p for _, p in D.cut_item(long.encode().split(), chars, 10)]
    assert all(sum(len(w) + 1 for w in p) < chars + 20 for p in words) and sum(len(p) - 9 for p in words) == 20_000 - 9
    assert all(a[-9:] == b[:9] for a, b in zip(words, words[1:]))
    assert [p for _, p in D.cut_item([b"a", b"b"], 1, 10)] == [[b"a", b"b"]] and [p for _, p in D.cut_item([], 5, 10)] == [[]]


def test_turns_against_one_automaton(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(9)}"
    items = spark.createDataFrame([(str(i), " ".join(word() for _ in range(rng.choice([2, 4, 30, 90])))) for i in range(40)] + [("0", None)], "item_id string, text string")
    texts = [" ".join(word() for _ in range(rng.randrange(200))) for _ in range(60)] + [None, "", "?!", "Äé V1 v2"]
    docs = spark.createDataFrame([(i, t, "own", 5) for i, t in enumerate(texts)] + [(3, texts[3], "twin", 5)], "doc_id bigint, text string, row string, n_words int")
    key = lambda r: (r.doc_id, r.row)
    shown = lambda r: (r.n_words, [tuple(s) for s in r.hit_spans], r.hit_items, r.text)
    one = {key(r): shown(r) for r in D.find_hits(docs, items, window=5).collect()}
    many = {key(r): shown(r) for r in D.find_hits(docs, items, window=5, chars=200).collect()}
    assert one == many and len(one) == 65 and any(x[2] for x in one.values())
    assert D.find_hits(docs.limit(0), items, window=5, chars=200).count() == 0
