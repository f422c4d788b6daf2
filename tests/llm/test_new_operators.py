"""Operators 11, 12 and 13 against plain versions: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import fingerprints, interactions, manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(seed=3, n=150):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "beta", "Gamma", "DELTA", "x", "pneumonoultramicroscopic", "é😀ü", "#tag", "a\tb"])
    rows = []
    for i in range(n):
        text = r.choice([None, "", "  \n ", " ".join(word() for _ in range(r.choice([1, 3, 8, 40, 300]))), "same text of many", "z" * 500])
        rows.append((i, text, r.choice(["en", "en", "en", "de", "", None]), r.choice(["s1", None]), None if text is None else len(text)))
    rows += [(7, rows[7][1], rows[7][2], rows[7][3], rows[7][4])] * 3 + [(None, "no id", "en", "s", 5)] * 4 + [(None, "No Id either", None, None, None), (9, "other text of nine", "fr", "s", 3)]
    r.shuffle(rows)
    return rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- operator 11 ---------------------------------------------------------------------------------------------------


def leaf(row, lowered=False):
    doc_id, text, lang, source, n_chars = row
    if lowered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes, fan=8):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def climb(at, tree, start, fan=8):
    proof, now = [], start
    for nodes in tree[:-1]:
        run = nodes[at - at % fan : at - at % fan + fan]
        left, right = run[: at % fan], run[at % fan + 1 :]
        proof += left + right
        now, at = h(*left, now, *right), at // fan
    return proof, now


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            p1, sub = climb(i, trees[g], leaf(r, hit))
            p2, root = climb(k, top, sub)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*p1, *p2), root, root == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("rows", [documents(), documents()[:1], [(i, f"T{i}", "en", "s", 2) for i in range(65)], [(i, "t", f"l{i:03d}", None, None) for i in range(70)]])
def test_manifest(spark, monkeypatch, rows):
    # small levels too go through the shuffled lookups
    monkeypatch.setattr(manifest, "BROADCAST_NODES", 3)
    docs = spark.createDataFrame([(*r, 1, "c", "d") for r in rows], DOCS + ", tree int, at string, siblings string").repartition(3)
    out = manifest.manifest(manifest.leaves_of(docs), "lang", ["doc_id"])
    got = out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(manifest.leaves_of(spark.createDataFrame([], DOCS)), "lang", ["doc_id"]).count() == 0


# --- operator 12 ---------------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    import re

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts.setdefault(r[1] or "", []).append(r[0])
    docs = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = words(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and min(texts[t]) < doc_id,
        }
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {d[0] for d in docs}:
        some = [d for d in docs if d[0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = some
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                before = [d for d in some if d[1][f] and any(d[1][x] for x in order[:k])]
                left = [d for d in left if not d[1][f]]
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in some)
                shapley[f] += len(gone)
                steps.append([part, order, k + 1, len(left), len(gone), len(before), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)])
        out += [tuple([*s, shapley[s[1][s[2] - 1]]]) for s in steps]
    return sorted(out)


def test_interactions(spark):
    rows = documents(5)
    r = random.Random(1)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)] + [(8, 1, 0), (8, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, "m") for x in rows], DOCS + ", mask int, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = interactions.audit(interactions.judged(docs, marks), "part", "mask", "ABCDE", ["good", "toxic"])
    assert sorted(tuple(x) for x in out.collect()) == plain_audit(rows, labels)
    assert interactions.audit(interactions.judged(docs.limit(0), marks), "part", "mask", "ABCDE", ["good", "toxic"]).count() == 0


def test_spectrum_of_many_copies(spark):
    """A part with most of the rows, and marks that are null."""
    rows = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "hot").alias("p"), (F.col("id") % 8).cast("int").alias("m"), F.when(F.col("id") % 3 > 0, F.col("id") % 2 == 0).alias("good"))
    w = interactions.spectrum(rows, "p", "m", 3, ["good"])
    got = {r.p: (r.a, r.g) for r in w.select("p", interactions.cells(F.col("w_all"), 3).alias("a"), interactions.cells(F.col("w_good"), 3).alias("g")).collect()}
    for p in ("hot", None):
        mine = [i for i in range(5000) if (i % 10 > 0) == (p == "hot")]
        assert got[p] == ([sum(i % 8 == m for i in mine) for m in range(8)], [sum(i % 8 == m and i % 3 > 0 and i % 2 == 0 for i in mine) for m in range(8)])


# --- operator 13 ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=fingerprints.GRAM, w=fingerprints.WINDOW):
    import re

    values = [int(hashlib.md5(p.encode()).hexdigest()[:7], 16) for p in re.findall(r"[^\x20\x09-\x0D]{1,8}", text)]
    if not values:
        return []
    grams = []
    for i in range(max(len(values) - k + 1, 1)):
        x = 0
        for v in (values[i : i + k] + [0] * k)[:k]:
            x = (x * fingerprints.BASE + v) % fingerprints.PRIME
        grams.append(x)
    chosen = set()
    for i in range(max(len(grams) - w + 1, 1)):
        some = grams[i : i + w]
        chosen.add(i + max(j for j, g in enumerate(some) if g == min(some)))
    return [(grams[i], i) for i in sorted(chosen)]


def plain_compared(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    out = []
    for i, (doc_id, text, *_) in enumerate(order):
        t, n = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = (plain_fingerprint(x) for x in (t, e, n))
        show = lambda f: ",".join(f"{g:08x}:{p}" for g, p in f)
        of = lambda f: {g for g, _ in f}
        out.append((doc_id, len(t), h(e), show(a), show(b), like(of(a), of(b)), like(of(a), of(c))))
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints(spark, parts):
    rows = [r for r in documents(8) if r[0] not in (None, 7, 9)] + [(None, "x y z " * 40, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "f") for r in rows], DOCS + ", hash int, f string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        assert sorted(str(tuple(r)) for r in fingerprints.compared(docs).collect()) == plain_compared(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_next_of_repeated_keys_and_rows(spark):
    rows = [(None, "a")] * 40 + [(None, "b")] * 30 + [(1, "c")] * 50 + [(1, "d"), (2, "e")]
    out = fingerprints.with_next(spark.createDataFrame(rows, "id int, body string").repartition(5), "id", "body").collect()
    assert len(out) == len(rows)
    pairs = [(r.id, r.text, r.next_text) for r in out]
    # a row's copies follow each other, and one of them is followed by the next text
    assert sorted(r[2] for r in pairs) == sorted(t for _, t in rows)
    ends = {(i, t): n for i, t, n in pairs if n != t}
    assert len(ends) == 5 and ends[2, "e"] in "ab" and sum(n != t for _, t, n in pairs) == 5
    one = fingerprints.compared(spark.createDataFrame([(5, "only one here")], "doc_id int, text string")).first()
    assert one.near_next == 1.0
    assert fingerprints.compared(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_shared_runs_share_a_hash(spark):
    """The guarantee: GRAM + WINDOW - 1 shared pieces give a shared hash; very long texts take time in proportion."""
    r = random.Random(2)
    shared = [f"s{i}" for i in range(fingerprints.GRAM + fingerprints.WINDOW - 1)]
    texts = [" ".join([f"{k}n{r.randrange(9999)}" for _ in range(r.randrange(30))] + shared + [f"{k}m{r.randrange(9999)}" for _ in range(r.randrange(30))]) for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "w " * 300_000)], "i int, t string")
    got = {x.i: set(x.h) for x in df.select("i", fingerprints.hashes(fingerprints.fingerprint(F.col("t"))).alias("h")).collect()}
    assert all(got[a] & got[b] for a in range(40) for b in range(40)) and len(got[99]) == 1


def test_no_python_on_the_native_path(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
    plan = fingerprints.compared(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sql_of_the_new_operators(spark, tmp_path):
    rows = [(i, *r[1:]) for i, r in enumerate(documents(6, 60))]
    con = duckdb.connect()
    for name, kind, data in (("documents", DOCS, rows), ("labels", "doc_id bigint, quality int, toxic int", [(i, i % 2, i % 3 == 0) for i in range(0, 60, 3)])):
        data = [tuple(int(v) if isinstance(v, bool) else v for v in r) for r in data]
        spark.createDataFrame(data, kind).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query, sql in ((manifest.op11_manifest, manifest.OP11_SQL), (interactions.op12_interactions, interactions.OP12_SQL), (fingerprints.op13_fingerprints, fingerprints.OP13_SQL)):
        got = query(spark, str(tmp_path))
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(str(tuple(r)) for r in got.select(want.columns).collect()) == sorted(map(str, want.fetchall()))
