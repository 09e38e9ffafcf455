"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from conftest_rows import prose

from placeweave.llm import packed, substring, suffixdedup


def brute(sequences, width):
    """{row: removed positions} for [(id, sequence)]; a window is lost if a
    smaller id has it."""
    least = {}
    for i, s in sequences:
        for a in range(len(s) - width + 1):
            w = s[a:a + width] if isinstance(s, bytes) else tuple(s[a:a + width])
            if i is not None:
                least[w] = min(least.get(w, i), i)
    out = []
    for i, s in sequences:
        gone = set()
        for a in range(len(s) - width + 1):
            w = s[a:a + width] if isinstance(s, bytes) else tuple(s[a:a + width])
            if i is not None and least[w] < i:
                gone.update(range(a, a + width))
        out.append(gone)
    return out


def corpus(seed, letters, n_docs, passage, unit=""):
    rng = random.Random(seed)
    pool = [[rng.choice(letters) for _ in range(rng.randrange(passage // 2, passage * 2))] for _ in range(4)]
    docs = []
    for i in range(n_docs):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            part = list(rng.choice(pool)) if rng.random() < .6 else [rng.choice(letters) for _ in range(rng.randrange(1, passage))]
            if rng.random() < .3 and part:
                part[rng.randrange(len(part))] = rng.choice(letters)
            parts += part
        docs.append((rng.randrange(n_docs), unit.join(parts)))
    return docs


def check_words(df_rows, docs, window):
    want = {}
    for (i, text), gone in zip(docs, brute([(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs], window)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.setdefault((i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)), []).append(1)
    got = {}
    for r in df_rows:
        got.setdefault((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]), []).append(1)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert got == want


def check_bytes(df_rows, docs, width):
    want, got = [], []
    data = [(i, (t or "").encode()) for i, t in docs]
    for (i, b), gone in zip(data, brute(data, width)):
        spans = sum(1 for p in gone if p - 1 not in gone)
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        want.append((str(i), len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    for r in df_rows:
        got.append((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
    assert sorted(got) == sorted(want)


def test_words_match_brute_force(make_docs):
    docs = corpus(1, ["a", "b", "c", "Ü", "dd"], 60, 20, " ") + [(3, None), (4, ""), (5, " \n"), (None, "a b c d a b c d")]
    check_words(substring.remove_repeats(make_docs(docs), window=7).collect(), docs, 7)


def test_words_of_production_window(make_docs):
    docs = corpus(2, [f"w{i}" for i in range(500)], 30, 80, " ")
    check_words(substring.remove_repeats(make_docs(docs)).collect(), docs, 50)


def test_bytes_match_brute_force(make_docs):
    docs = corpus(3, list("abé") + ["zz"], 60, 40) + [(3, None), (4, ""), (6, "a" * 90), (2, "a" * 70 + "b"), (1, "a" * 40 + "A" * 30), (None, "a" * 60)]
    check_bytes(suffixdedup.remove_repeats(make_docs(docs), width=16).collect(), docs, 16)


def test_bytes_of_production_width(make_docs):
    docs = corpus(4, [chr(c) for c in range(97, 123)], 40, 120)
    check_bytes(suffixdedup.remove_repeats(make_docs(docs, 5)).collect(), docs, 50)


def test_a_hot_anchor_is_split(make_docs, monkeypatch):
    """One passage in many documents, each time amid other text: without the
    split all of its anchor's segments meet in one sort."""
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(300)
    docs = [(i, noise(60) + passage + noise(60)) for i in range(120)] + [(500 + i, "ab" * (100 + i)) for i in range(4)]
    monkeypatch.setattr(suffixdedup, "HOT_BYTES", 4000)
    asked, real = [], suffixdedup.written

    def spy(df, name):
        out = real(df, name)
        if name == "suffix-met":
            asked.extend(packed.unpack(bytes(r["data"]))[4] for r in out.where(f"kind = {suffixdedup.REQUEST}").collect())
        return out
    monkeypatch.setattr(suffixdedup, "written", spy)
    check_bytes(suffixdedup.remove_repeats(make_docs(docs, 4)).collect(), docs, 50)
    per_anchor = np.unique(np.concatenate(asked), return_counts=True)[1] if asked else np.zeros(1, int)
    assert per_anchor.max() * 50 <= 4000


def test_odd_documents(odd_docs, no_docs):
    from conftest_rows import ODD
    check_words(substring.remove_repeats(odd_docs).collect(), ODD, 50)
    small = [(i, t) for i, t in ODD if len(t or "") < 10_000]
    rows = suffixdedup.remove_repeats(odd_docs).collect()
    check_bytes([r for r in rows if r["n_bytes"] < 10_000], small, 50)
    assert [r["n_removed"] for r in rows if r["n_bytes"] >= 10_000] == [0]
    assert substring.remove_repeats(no_docs).collect() == [] == suffixdedup.remove_repeats(no_docs).collect()


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_sort(seed):
    rng = np.random.default_rng(seed)
    width, n = 16, 3000
    text = rng.integers(97, 97 + 1 + seed % 4 * 2, n).astype(np.uint8)       # also one letter only
    text[500:900] = text[100:500]
    text[2000:2100] = 97
    padded = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    wanted = np.zeros(len(padded), bool)
    wanted[rng.integers(0, n - width, 1200)] = True
    order = suffixdedup.two_stage_sort(padded, wanted, width)
    raw = padded.tobytes()
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    keys = [raw[i:i + width] for i in order]
    assert keys == sorted(keys)
    same = suffixdedup.equal_neighbours(padded, order, width)
    assert same.tolist() == [a == b for a, b in zip(keys, keys[1:])]


def test_packing():
    rng = np.random.default_rng(0)
    cols = [rng.integers(0, 250, 999).astype(t) for t in (np.uint64, np.int64, np.int32, np.uint16, np.uint8)]
    back = packed.unpack(packed.pack(*cols))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(cols, back))
    assert [len(x) for x in packed.unpack(packed.pack(*(c[:0] for c in cols)))] == [0] * 5


def test_rolling_hash_names_equal_windows():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 500).astype(np.uint64)
    roll = packed.Rolling()
    h = roll.windows(roll.sums(values), 6)
    seen = {}
    for i in range(495):
        key = values[i:i + 6].tobytes()
        assert seen.setdefault(key, h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def test_index_keeps_the_smallest_document_of_a_block():
    low = np.array([5, 7, 5, 5, 7, 9], np.uint32)
    doc = np.array([3, 8, 2, 2, 9, 1], np.int64)
    assert substring._of_least(low, doc).tolist() == [1, 2, 3, 5]


def test_one_id_with_very_many_texts(spark, make_docs):
    """Texts of one id are numbered without meeting in one row."""
    texts = [prose("en", i, 5) + f" {i}" for i in range(300)]
    docs = make_docs([(1, t) for t in texts] + [(2, texts[0]), (3, "x"), (3, "x")], 6)
    rows = packed.number_rows(docs).collect()
    assert sorted(r["twin"] for r in rows if r["doc_id"] == 1) == list(range(1, 301))
    assert {r["twin"] for r in rows if r["doc_id"] != 1} == {0}
    again = {(r["doc_id"], r["text"]): r["twin"] for r in packed.number_rows(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["text"]): r["twin"] for r in rows}
