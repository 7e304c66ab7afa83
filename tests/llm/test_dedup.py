"""Substring, line and near-duplicate removal against brute force, with nulls, empty and repeated rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bramble.llm import jaccard_join as J
from bramble.llm import suffix_dedup as S
from bramble.llm.line_dedup import drop_lines


def covered(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(gone)
    return out


def noisy(rng, n_docs, size, alphabet="abcd"):
    make = lambda n: "".join(rng.choices(alphabet, k=n))
    shared = [make(rng.randint(20, 60)) for _ in range(4)]
    docs = ["".join(rng.choice([make(rng.randint(0, size)), rng.choice(shared)]) for _ in range(rng.randint(0, 6))) for _ in range(n_docs)]
    return docs + rng.choices(docs, k=n_docs // 4)


def test_suffix_array():
    rng = random.Random(6)
    for _ in range(40):
        data = "".join(rng.choices("ab", k=rng.randint(1, 200))).encode()
        order = S.refine(np.frombuffer(data, np.uint8), len(data) + 1)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        ends = np.full(len(data), len(data))
        got = S.common_prefixes(np.frombuffer(data, np.uint8), order, ends, len(data))
        want = [0] + [next((k for k in range(len(data)) if data[a + k : a + k + 1] != data[b + k : b + k + 1] or a + k >= len(data) or b + k >= len(data)), 0) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
        assert got.tolist() == want


@pytest.mark.parametrize("split", [4000, 2])
def test_substrings(spark, monkeypatch, split):
    monkeypatch.setattr(S, "RUNS_A_SHARD", split)
    rng = random.Random(7)
    texts = [*noisy(rng, 60, 30), "é" * 30 + "x", "y" + "é" * 30, "a" * 100, "", None]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(200, "same row, twice over", "k")] * 2, "doc_id long, text string, spans string").repartition(3)
    got = {r["doc_id"]: r for r in S.remove_repeats(docs, 16, 6).collect()}
    data = [(t or "").encode() for t in texts] + [b"same row, twice over"] * 2
    for i, (t, gone) in enumerate(zip(data[:-1], covered(data, 16)[:-1], strict=True)):
        r = got[i if i < len(texts) else 200]
        assert (r["n_bytes"], r["n_removed"]) == (len(t), len(gone)), i
        assert bytes(r["kept"]) == bytes(b for k, b in enumerate(t) if k not in gone)
        assert r["n_spans"] == sum(k - 1 not in gone for k in gone)
    assert S.remove_repeats(docs.limit(0), 16, 6).count() == 0


def test_passages(spark):
    rng = random.Random(11)
    shared = [" ".join(rng.choices("ab Cd ef gh i jk".split(), k=rng.randint(5, 12))) for _ in range(3)]
    texts = [" \n".join(rng.choice([shared[rng.randrange(3)], f"own{rng.randint(0, 99)} x{i}", "Ab cd"]) for _ in range(rng.randint(0, 5))) for i in range(80)] + ["a a a a a a a", None, "", shared[0].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_repeated_words"] for r in S.remove_repeats(docs, 400, 64, passage=5, passage_gram=2).collect()}
    words = [tuple((t or "").lower().split()) for t in texts]
    assert got == {i: len(gone) for i, gone in enumerate(covered(words, 5))} and sum(got.values()) > 100


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_lines(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choices("ab cd ef gh ij kl".split(), k=rng.randint(1, 9))) for _ in range(25)]

    def changed(line):
        w = line.split()
        i = rng.randrange(len(w))
        return " ".join(rng.choice([w[:i] + w[i + 1 :], w[:i] + ["new"] + w[i:], w[:i] + ["zz"] + w[i + 1 :], w]))

    docs = [(i, "\n".join(rng.choice([x := rng.choice(base), changed(x), x.upper() + " "]) for _ in range(rng.randint(0, 6))), "g") for i in range(60)]
    docs += [(100, None, "g"), (101, "", "g"), (102, "\n\n", "g"), (102, "\n\n", "g"), (103, " ".join(f"w{k}" for k in range(3000)), "g"), (104, " ".join(f"w{k}" if k != 1500 else "other" for k in range(3000)), "g")]
    docs += [(105, "ab cd ef gh ij kl ab ab ab\nfirst text of this id", "g"), (105, "other text of this id\nnot this line\nFirst text of THIS id", "g"), (None, "ab", "g"), (None, "ab", "g")]
    df = spark.createDataFrame(docs, "doc_id long, text string, gone string").repartition(3)
    twin = {r["text"]: r["twin"] for r in df.selectExpr("text", "xxhash64(text) as twin").collect()}
    lines = [((d, twin[text], p), t.lower().split()) for d, text, _ in docs if text is not None and d is not None for p, t in enumerate(text.split("\n"))]
    gone = {at for at, w in lines if w and any(b < at and (v == w or min(len(v), len(w)) >= 6 and near(v, w)) for b, v in lines)}
    got = drop_lines(df)
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "n_removed"]
    want = sorted(((d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, twin[t], p) not in gone), 0 if t is None else t.count("\n") + 1) for d, t, _ in docs), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"]) for r in got.collect()), key=repr) == want
    assert (104, twin[docs[-5][1]], 0) in gone and drop_lines(df.limit(0)).count() == 0


def test_every_line(spark):
    han = "今天天气很好我们去公园散步吧大家"
    docs = [
        (1, "Menu\nshort line here\n\nmenu \none two three four five six\n" + han),
        (2, "Short  line here\nshort line there\n\none two three four five seven\n" + han.replace("公", "花")),
        (3, han + "\n今天很好\n今天天好"),
        (4, "今天很好\nเมนู\nเมนู"),
        (5, None),
        (6, ""),
        (7, "---\n---\n \n "),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in drop_lines(df).collect()}
    assert got == {
        1: ("Menu\nshort line here\n\none two three four five six\n" + han, 1),
        2: ("short line there\n", 3),
        3: ("今天很好\n今天天好", 1),
        4: ("เมนู", 2),
        5: (None, 0),
        6: ("", 0),
        7: ("---\n \n ", 1),
    }
    stage = pytest.importorskip("corpus_pipeline").line_dedup
    assert {r["doc_id"]: r["text"] for r in stage(spark, df, "").collect()} == {k: t for k, (t, _) in got.items()}


def sets(text, k):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_signatures_lose_no_link():
    rng = np.random.default_rng(9)
    for percent in (80, 85):
        for size in [*range(1, 40), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            for _ in range(6):  # the largest difference that still is similar
                lose = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
                b = np.delete(a, rng.choice(len(a), lose, replace=False))
                while True:
                    more = np.unique(np.append(b, rng.integers(0, 1 << 63, 1).astype(np.uint64)))
                    if not J.similar(a, more, percent):
                        break
                    b = more
                if J.similar(a, b, percent):
                    assert set(J.signatures([a], percent)[0]) & set(J.signatures([b], percent)[0]), (percent, size)
                    apart = np.bitwise_count(np.bitwise_xor(*J.sketches([a, b])).view(np.uint64)).sum()
                    assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(10)
    base = [[str(rng.randint(0, 400)) for _ in range(rng.randint(1, 80))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = str(rng.randint(0, 999))
        rows.append((i, " ".join(w), "c"))
    rows += [(200, None, "c"), (201, "", "c"), (202, " \n", "c"), (203, rows[3][1], "c"), (203, rows[3][1], "c"), (None, rows[3][1], "c"), (None, "no id of its own", "c")]
    rows += [(204, rows[5][1], "c"), (204, rows[6][1] + " more", "c"), (204, "a text of that id that is like no other", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.link_documents(df, 4, 85).collect()), key=repr)
    own = [sets(t, 4) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    label = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            label[find(i)] = min(d, label.get(find(i), d))
    assert got == sorted(((d, len(own[i]), label.get(find(i))) for i, (d, _, _) in enumerate(rows)), key=repr)
    kept = J.keep_first(df, 4, 85)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = [find(rows.index((d, t, "c"))) for d, t in left]
    assert len(set(groups)) == len(groups) == len({find(i) for i in range(len(rows))})  # one row of each component
    assert all(d == label.get(g) for (d, _), g in zip(left, groups, strict=True))
    assert J.link_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "sig_bits"), [(64, 48), (3, 6), (1, 48)])
def test_nodes_of_one_key(spark, monkeypatch, bits, sig_bits):
    """Signatures are shuffled as two longs; different sets with the same key lose no link, nor do those that share signatures by chance."""
    monkeypatch.setattr(J, "KEY_BITS", bits)
    monkeypatch.setattr(J, "SIG_BITS", sig_bits)
    rng = random.Random(13)
    base = [[str(rng.randint(0, 400)) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = str(rng.randint(0, 999))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = J._signature_rows(df.select("text"), 4, 85, False)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint"]
    keys = {r["key"] for r in found.select("key").collect()}
    own = {i: sets(t, 4) for i, t in rows}
    nodes = J._sets(df.select("doc_id", F.xxhash64("text").alias("twin"), "text"), 4, False).select(J._key().alias("key"))
    assert keys == {r["key"] for r in nodes.collect()} and len(keys) <= 2**bits
    label = {i: i for i in own}
    for _ in own:
        label = {i: min(label[j] for j in own if 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])) for i in own}
    got = {r["doc_id"]: r["component_id"] for r in J.link_documents(df, 4, 85).collect()}
    assert got == label and 6 <= len(set(label.values())) < 60
