"""Near-dedup against all pairs, with near copies, chains, copies and hot buckets."""

import random
from collections import defaultdict

import pytest

from brindle.llm import minhash

from .helpers import ODD, clashing, documents, prose, shingles


def components(pairs, percent=85):
    """Components by brute force over all pairs."""
    sets = defaultdict(list)
    for doc, text in pairs:
        sets[doc].append(shingles(text))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                a0, b0 = root(a), root(b)
                parent[max(a0, b0)] = min(a0, b0)
    return {d: root(d) for d in ids}


def edited(text, n, seed):
    draw = random.Random(seed)
    found = text.split()
    for _ in range(n):
        found[draw.randrange(len(found))] = f"e{draw.randrange(10**6)}"
    return " ".join(found)


def family(seed, copies, most, length=200):
    base = prose(seed, length, 10**6)
    return [base] + [edited(base, random.Random(seed * 1000 + k).randrange(most + 1), seed * 1000 + k) for k in range(copies)]


def check(spark, texts, **parameters):
    found = minhash.near_duplicates(documents(spark, texts), **parameters).collect()
    want = components(list(enumerate(texts)), parameters.get("percent", 85))
    assert len(found) == len(texts)
    for r in found:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]]))


def test_families_copies_and_odd_texts(spark):
    texts = [*family(1, 25, 8), *family(2, 10, 3), *([prose(3, 40)] * 15), *ODD, "a b", "A  b", "b a", "a b c d e", "a b c d e f", *(prose(k, 80) for k in range(40))]
    random.Random(5).shuffle(texts)
    check(spark, texts)
    check(spark, texts, percent=80)


@pytest.mark.parametrize("chunk", [2, 5])
def test_large_buckets_lose_no_link(spark, chunk):
    """Families in which most pairs are alike but not linked, through every way that large buckets take."""
    check(spark, [*family(7, 45, 14, 150), *family(8, 30, 25, 150), *(prose(k, 60) for k in range(20))], chunk=chunk, rows=2 if chunk == 2 else 5)


def test_unlinked_documents_of_one_frame_do_not_meet(spark, monkeypatch):
    """Thousands of pages that share most words, though too few, and a bucket: no block has two of them, and none is lost."""
    frame, n = " ".join(f"c{k}" for k in range(120)), 3000
    texts = [f"{frame} " + " ".join(f"u{k}x{j}" for j in range(40)) for k in range(n)]
    texts += [edited(texts[k], 2, k) for k in range(0, 40, 4)]
    met = []
    alike = minhash._alike

    def counted(sets, members, percent):
        met.append((members.count(), alike(sets, members, percent).count()))
        return alike(sets, members, percent)

    monkeypatch.setattr(minhash, "_alike", counted)
    monkeypatch.setattr(minhash, "MOST_COPIES", 2)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert found == {k: k if k < n else 4 * (k - n) for k in range(n + 10)}
    (members, rows) = met[0]
    assert members > n and rows < 0.05 * members


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_size_classes_and_prefixes_keep_links(spark, percent):
    """Nested texts, whose sizes are as far apart as a link allows, in large buckets."""
    base = prose(11, 400, 10**6).split()
    texts = [" ".join(base[: 404 - k]) for k in range(0, 90, 3)] + [" ".join(base[: 404 - k]) + " tail" for k in range(0, 90, 7)]
    check(spark, [*texts, *(prose(k, 60) for k in range(5))], percent=percent, chunk=2, rows=2)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, None), (1, "a b c d e f g"), (1, "x y z u v w q"), (2, "X Y Z U V W Q"), (3, "a b c d e f g"), (3, "a b c d e f g")], "doc_id bigint, text string")
    found = minhash.near_duplicates(clashing(docs, "kept", "band", "component", "size")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found) == [("1", "1", True)] * 2 + [("2", "1", False)] + [("3", "1", False)] * 2 + [("None", "None", True)] * 2
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None", "None"]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 200), (300, 200)], "left bigint, right bigint")
    found = {r["node"]: r["component"] for r in minhash.connected_components(links).collect()}
    assert found == {**{k: 1 for k in range(1, 61)}, 100: 100, 200: 100, 300: 100}


def test_enough_permutations():
    for percent in (80, 85, 95):
        for rows in (2, 5, 10):
            bands = 2 * minhash.permutations_for(percent, rows) // rows
            assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS * 1.01
