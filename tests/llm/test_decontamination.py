import hashlib
import random

from bramble.llm.common import alnum_words
from bramble.llm.decontamination import SuffixAutomaton, decontaminate, scan_documents

WINDOW = 8


def brute(text, items):
    words = alnum_words(text)
    hit, found = set(), set()
    for item, t in items:
        w = alnum_words(t)
        k = min(WINDOW, len(w))
        for i in range(len(w) - k + 1) if k else ():
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for trial in range(120):
        vocab = "abc"[: rng.randint(1, 3)]
        text = lambda n: " ".join(rng.choices(vocab, k=rng.randint(0, n)))  # noqa: E731, B023
        items = [(str(i), text(14)) for i in range(rng.randint(0, 5))] + [("n", None)]
        auto = SuffixAutomaton(items)
        doc = text(40)
        runs, found = auto.scan(alnum_words(doc))
        hit, names = brute(doc, items)
        assert {i for a, b in runs for i in range(a, b)} == hit, trial
        assert found == names
        assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))


def frames(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, f"before, {passage.upper()}! after it all", 0, "x"), (2, None, 0, "x"), (3, "", 0, "y"), (4, passage, 0, None), (4, passage, 0, None), (5, "clean words only", 1, "z"), (6, "red Fox runs", 1, "z"), (None, "Q " + passage, 2, "k")],
        "doc_id int, text string, runs int, item_id string",
    )
    bench = spark.createDataFrame([("a", passage), ("a", passage), ("b", "fox runs"), ("c", None), ("d", "..."), (None, "clean words only")], "item_id string, text string")
    return docs, bench


def test_operator_and_blocks(spark):
    docs, bench = frames(spark)
    for size in (1 << 20, 40):
        got = {(r["doc_id"]): (r["n_words"], [(x["start"], x["stop"]) for x in r["runs"]], r["items"]) for r in scan_documents(docs, bench, block_bytes=size).collect()}
        assert got[1] == (14, [(1, 11)], ["a"]) and got[2] == got[3] == (0, [], [])
        assert got[4] == (10, [(0, 10)], ["a"]) and got[5] == (3, [], []) and got[6] == (3, [(1, 3)], ["b"]) and got[None] == (11, [(1, 11)], ["a"])


def test_removal(spark):
    docs, bench = frames(spark)
    out = decontaminate(docs, bench, max_coverage=0.8)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "before, ! after it all", 2: None, 3: "", 5: "clean words only", 6: "red "}
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 8


def test_blocks_change_nothing(spark):
    w = [f"w{k}" for k in range(60)]
    text = " ".join(w)
    # Over half is covered by two items together; two items overlap; rows without an id, or with one id, of equal length.
    docs = spark.createDataFrame(
        [(1, text, 0, "a"), (2, " ".join(w[:14] + [f"x{k}" for k in range(40)]), 0, "a"), (None, "p " + " ".join(w[:9]), 1, "b"), (None, "p q " + " ".join(w[30:38]), 1, "c"), (None, "a b c d e f g h i j", 1, "d")]
        + [(3, "y " + " ".join(w[30:39]), 2, "e"), (3, "z " + " ".join(w[:9]), 2, "f"), (4, None, 0, "g"), (4, None, 0, "g")],
        "doc_id int, text string, runs int, row string",
    )
    bench = spark.createDataFrame([(f"i{k}", " ".join(w[a:b])) for k, (a, b) in enumerate([(0, 10), (5, 14), (30, 46), (0, 9), (28, 40)])], "item_id string, text string")
    for call in (lambda size: scan_documents(docs, bench, block_bytes=size), lambda size: decontaminate(docs, bench, block_bytes=size), lambda size: decontaminate(docs, bench, max_coverage=0.95, block_bytes=size)):
        one, many = (sorted(map(repr, call(size).collect())) for size in (1 << 20, 40))
        assert one == many
    kept = decontaminate(docs, bench, block_bytes=40)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[2] == " ".join(f"x{k}" for k in range(40))


def test_every_row_comes_out_once(spark):
    passage = " ".join(f"w{k}" for k in range(10))
    rows = [(4, passage), (4, passage), (7, "aa " + passage), (7, passage + " bb"), (8, passage + " " + "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    bench = spark.createDataFrame([("a", passage), ("b", "other words " * 6)], "item_id string, text string")
    for size in (1 << 20, 60, 20):
        got = sorted((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["items"]) for r in scan_documents(docs, bench, block_bytes=size).collect())
        assert got == [(4, 10, [(0, 10)], ["a"]), (4, 10, [(0, 10)], ["a"]), (7, 11, [(0, 10)], ["a"]), (7, 11, [(1, 11)], ["a"]), (8, 200_010, [(0, 10)], ["a"])]


def test_memory_of_an_automaton():
    import tracemalloc

    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(20_000)]
    items = [(str(i), " ".join(rng.choices(vocab, k=200))) for i in range(500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    auto = SuffixAutomaton(items)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 25 * size and auto.scan(items[7][1].encode().split())[1] == {"7"}


def test_empty_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
