"""SimHash groups and decontamination against brute force, with the awkward cases."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from loomgraph.llm import decontam, simhash

DOCS = "doc_id long, text string, fp string, n_words int"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_print(text):
    words = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(docs):
    prints = [plain_print(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if x == old else x for x in group]
    least = {k: min(d for (d, _), x in zip(docs, group) if x == k) for k in set(group)}
    return sorted((d, f"{p:016x}", least[k]) for (d, _), p, k in zip(docs, prints, group))


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeéñ"), rng.integers(1, 6)))
    docs = []
    for _ in range(60):
        docs.append(" ".join(word() for _ in range(int(rng.integers(1, 300)))))
    for k in range(30):  # near copies by one changed word, and exact ones
        parts = docs[k].split(" ")
        parts[int(rng.integers(len(parts)))] = word()
        docs += [" ".join(parts), docs[k]]
    docs += ["", None, " \t\x0b", "\xa0", "A\x1cB", "One Two", "one two", "one\ntwo\n"] + ["same"] * 5
    docs.append(" ".join(word() for _ in range(30000)))
    return list(enumerate(docs))


def test_groups_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], DOCS)
    got = sorted(map(tuple, simhash.simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == plain_groups(docs)


def test_links_are_all_pairs_within_four_bits(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    prints = {b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for b in base for _ in range(12)} | {0, 15, 31, 2**63, (0xF << 60)}
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in prints)
    want = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    got = sorted(map(tuple, simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()))
    assert got == want and len(want) > 50
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 5)


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 105), (101, 105)], "a long, b long")
    got = dict(map(tuple, simhash.components(edges).collect()))
    assert {got[i] for i in range(71)} == {0} and {got[i] for i in (100, 101, 105)} == {100}
    assert simhash.components(edges.limit(0)).count() == 0


def test_dropping_keeps_one_of_each_group_and_rows_without_id(spark):
    long = "a b c d e f g h i j k l"
    df = spark.createDataFrame([(5, long, "x", 1), (3, long, "y", 2), (3, long, "z", 3), (None, long, "q", 4), (7, "other words stand here alone", None, None)], DOCS)
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["3", "7", "None"]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return ITEM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abÉü0"), rng.integers(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(12)] + [(20, None), (21, ""), (22, "..!"), (23, "ab"), (24, "ab"), (25, "AB ab aB ab ab ab"), (10, "zz yy xx ww")]
    docs = []
    for k in range(60):
        body = text(int(rng.integers(0, 400)))
        if k % 2:
            piece = (items[k % 12][1] or "").split(" ")
            cut = int(rng.integers(0, 3))
            body += "! " + ", ".join(piece[cut:]).upper() + ". " + text(int(rng.integers(0, 100)))
        docs.append((k, body))
    docs += [(100, None), (101, ""), (102, items[0][1] + " " + items[0][1]), (103, "zz yy xx ww vv"), (104, "x " * 40000 + (items[1][1] or "")), (105, "K " + "ab" * 3)]
    df, bench = spark.createDataFrame([(i, t, "c", 0) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hash int")
    found = decontam.contamination(df, bench)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in found.collect())
    want = plain_hits(docs, items)
    assert got == want and 5 < sum(r[5] for r in want) < len(want)
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not r[5] for r in want)


def test_contamination_of_empty_tables(spark):
    df, bench = spark.createDataFrame([(1, "a b", "c", 0)], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontam.contamination(df, bench.limit(0)).collect()] == [(2, 0, 0)]
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert decontam.decontaminate(df, bench).count() == 0


def test_rows_without_ids_or_with_repeated_ones_are_judged_one_by_one(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    clean = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, item), (1, clean), (None, item), (None, clean), (None, clean), (1, item), (None, None), (2, "")]
    bench = spark.createDataFrame([(5, item), (6, item), (6, "x " + item), (None, clean + " and more words")], "item_id long, text string")
    found = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in found.collect()), key=str)
    assert got == sorted([(1, 13, 13, 2, "5,6", True)] * 2 + [(1, 13, 13, 0, "", True), (None, 13, 13, 2, "5,6", True)] + [(None, 13, 13, 0, "", True)] * 2 + [(None, 0, 0, 0, "", False), (2, 0, 0, 0, "", False)], key=str)
    bench = bench.filter("item_id < 6")
    df = spark.createDataFrame([(i, t, str(k), 0) for k, (i, t) in enumerate(rows)], DOCS)
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r.fp for r in left.collect()) == ["1", "3", "4", "6", "7"]


def test_maps_of_any_size_find_all(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(rng.choice(list("abcdefgh"), 20))) for i in range(300)]
    docs = [(i, t + " " + " ".join(rng.choice(list("abcdefgh"), 30))) for i, t in items[:40]]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [r[:4] for r in plain_hits(docs, items)]
    for most in (6, 27):  # a full map, and a wide one
        monkeypatch.setattr(decontam, "LEAST_BITS", 6)
        monkeypatch.setattr(decontam, "MOST_BITS", most)
        assert sorted(tuple(r)[:4] for r in decontam.contamination(df, bench).collect()) == want


def test_dropping_judges_texts_that_share_an_id(spark):
    long, other = "a b c d e f g h i j k l", "other words stand here all alone in this one"
    df = spark.createDataFrame([("b", long, "1", 1), ("b", other, "2", 1), ("a", long + " m", "3", 1), ("b", other, "4", 1), ("c", other, "5", 1), ("c", None, "6", 1), ("c", "", "7", 1)], DOCS.replace("doc_id long", "doc_id string"))
    left = sorted((r.doc_id, r.text or "") for r in simhash.drop_near_duplicates(df).collect())
    near = bin(plain_print(long) ^ plain_print(long + " m")).count("1") <= 4
    assert left == sorted([("a", long + " m"), ("b", other), ("c", "")] + ([] if near else [("b", long)]))


def test_unfinished_components_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(edges, most=1)


def test_columns_that_clash_come_back_as_they_were(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    schema = "doc_id long, text string, _key string, _digest string, row int, n int, first boolean, hits string, words string, fp long"
    df = spark.createDataFrame([(1, item, "k1", "d1", 1, 1, False, "h", "w", 5), (2, "some other words of a text", "k2", "d2", 2, 2, True, "h", "w", 6), (3, "some other words of a text", "k3", "d3", 3, 3, True, "h", "w", 7)], schema)
    rows = {r.doc_id: tuple(r) for r in df.collect()}
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    for left, want in ((decontam.decontaminate(df, bench), [2, 3]), (simhash.drop_near_duplicates(df), [1, 2])):
        assert left.columns == df.columns and sorted(map(tuple, left.collect())) == [rows[i] for i in want]
