"""SimHash fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest_rows import ODD, prose

from placeweave.llm import components, simhash


def plain_fingerprint(text, shingle=3):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, distance=3):
    """[(id, fp)] → smallest id that chains of links reach, per row."""
    left, out = set(range(len(pairs))), [None] * len(pairs)
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            a = queue.pop()
            group.add(a)
            near = {b for b in left if bin(pairs[a][1] ^ pairs[b][1]).count("1") <= distance}
            left -= near
            queue += near
        ids = [pairs[a][0] for a in group if pairs[a][0] is not None]
        for a in group:
            out[a] = min(ids, default=None)
    return out


def near_copies(n, seed=5):
    rng = random.Random(seed)
    base = prose("en", "base", 400).split()
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["river", "stone", "cloud"])
        docs.append((i, " ".join(words)))
    return docs + [(1000 + i, prose("de", i, 60)) for i in range(20)]


def test_fingerprints():
    for _, t in ODD + [(0, "A b"), (0, "One TWO\x1cthree four É é"), (0, "a b c " * 9000)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("large", [simhash.LARGE_GROUP, 2])
def test_components_match_brute_force(make_docs, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)         # 2: nearly all groups are split by the fine blocks
    docs = near_copies(70)
    rows = simhash.near_duplicates(make_docs(docs)).collect()
    pairs = [(i, plain_fingerprint(t)) for i, t in docs]
    want = {i: c for (i, _), c in zip(pairs, plain_components(pairs))}
    assert {r["doc_id"]: r["fp"] % 2 ** 64 for r in rows} == dict(pairs)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert 1 < len(set(want.values())) < len(docs)
    kept = {r["doc_id"] for r in simhash.one_of_each(make_docs(docs)).collect()}
    assert kept == set(want.values())


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(0)
    values = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 14, (400, 4)).astype(np.uint64), axis=1))
    edges = simhash._forest(values, 2)
    assert len(edges) < len(values)
    group = plain_components(list(enumerate(int(v) for v in values)), 2)
    label = {int(v): int(v) for v in values}
    for _ in values:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert len({tuple(x) for x in zip(group, (label[int(v)] for v in values))}) == len(set(group)) == len(set(label.values()))


def test_masks_leave_bounded_groups():
    for mask in simhash.block_masks(3):
        for fine in simhash.fine_masks(mask, 3):
            assert fine & mask == mask and 2 ** (64 - bin(fine).count("1")) <= 4096


def test_odd_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    pairs = [(i, plain_fingerprint(t)) for i, t in ODD]
    want = sorted(((i, f, c) for (i, f), c in zip(pairs, plain_components(pairs))), key=str)
    assert sorted(((r["doc_id"], r["fp"] % 2 ** 64, r["component_id"]) for r in rows), key=str) == want
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # of each group of linked rows the one with the smallest id, null last
    left, keep = [(i, f, t) for (i, f), (_, t) in zip(pairs, ODD)], []
    while left:
        group, more = [], [left.pop(0)]
        while more:
            group += more
            more = [x for x in left if any(bin(x[1] ^ g[1]).count("1") <= 3 for g in more)]
            left = [x for x in left if x not in more]
        keep.append(min(((i, t) for i, _, t in group), key=lambda x: (x[0] is None, x[0])))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(keep, key=str)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_an_id_with_texts_in_two_components_keeps_both(make_docs, odd_docs):
    one, two = prose("en", 8, 90), prose("de", 88, 80)
    docs = [(5, one), (9, one), (5, two), (7, two), (5, two), (None, "a b c"), (None, "a b c")]
    kept = simhash.one_of_each(make_docs(docs)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(5, one), (5, two), (None, "a b c")], key=str)
    assert {r["text"] for r in simhash.one_of_each(odd_docs).collect() if r["doc_id"] == 8} == {one, two}


def test_connected_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(7, 7)]
    rng.shuffle(edges)
    got = {(r["u"], r["v"]) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {(x, m) for x, m in low.items() if x != m}
