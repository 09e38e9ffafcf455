"""Filter audit, line dedup and source divergence against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_rows import ODD, prose

from placeweave.llm import bloom, divergence, filteraudit, linededup

LABELS = "doc_id long, quality int, toxic int"


def odd_parts(odd_docs):
    return [(r["doc_id"], r["text"] or "", r["lang"] or "", r["source"] or "") for r in odd_docs.collect()]


# -- filter audit ------------------------------------------------------------

def plain_failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" * (len(words) < 100)
    out += "B" * (100 * len(set(words)) < 80 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    return out + "D" * bool(re.search(r"[#$%&*|]", text))


def plain_audit(docs, labels):
    """docs: (id, text, part); every order walked document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    failed = [(p, plain_failures(t) + "E" * (i is not None and first[t] < i), i) for i, t, p in docs]
    rows = {}
    for part in {p for _, _, p in docs}:
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            here = [(f, i) for p, f, i in failed if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                hit = [(f, i) for f, i in here if x in f]
                here = [(f, i) for f, i in here if x not in f]
                rows[part, "".join(order), step] = [
                    len(here), len(hit), sum(x in f for f, _ in gone), sum(f == x for p, f, _ in failed if p == part),
                    sum(i in good for _, i in hit if i is not None), sum(i in toxic for _, i in hit if i is not None)]
                total[x] += len(hit)
                gone += hit
        for (p, order, step), r in rows.items():
            if p == part:
                r.append(total[order[step - 1]])
    return rows


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]):
            [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_filter_audit_against_every_order(spark):
    rng = random.Random(5)
    texts = []
    for i in range(120):
        t = prose("en", i, rng.choice([20, 99, 100, 140])) if rng.random() < .4 else " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(130))
        t = t.upper() if rng.random() < .2 else t
        texts.append(t + " #" * (rng.random() < .3))
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", ""])) for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(i, t, p) for i, t, p in docs], "doc_id long, text string, lang string").repartition(5)
    got = audited(filteraudit.audit(df, spark.createDataFrame(labels, LABELS)))
    assert got == plain_audit(docs, labels) and len(got) == 3 * 600


def test_filter_audit_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 1), (None, 1, 1)], LABELS)
    docs = [(i, t, lang) for i, t, lang, _ in odd_parts(odd_docs)]
    assert audited(filteraudit.audit(odd_docs, labels)) == plain_audit(docs, [(7, 1, 1), (8, 0, 1)])
    assert filteraudit.audit(no_docs, labels).count() == 0
    assert audited(filteraudit.audit(odd_docs, labels.limit(0))) == plain_audit(docs, [])


def test_positional_counts_carry(monkeypatch):
    monkeypatch.setattr(filteraudit, "_CHUNK", 100)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2 ** 32, 5000, dtype=np.uint64).astype(np.uint32)
    times = rng.integers(1, 40, 5000)
    count = filteraudit.PositionalCount()
    for a in range(0, 5000, 77):
        count.add(words[a:a + 77], times[a:a + 77])
    want = [int(times[(words >> np.uint32(b)) & 1 == 1].sum()) for b in range(32)]
    assert count.total().tolist() == want
    assert filteraudit.PositionalCount().total().tolist() == [0] * 32


def test_survival_words_are_the_truth_table():
    word = filteraudit.survival_words()
    for failed in range(32):
        assert [int(word[failed]) >> s & 1 for s in range(32)] == [int(not s & failed) for s in range(32)]


# -- lines -------------------------------------------------------------------

def plain_lines(docs, min_chars=20, min_documents=3):
    def key(line):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return re.sub("[A-Z]", lambda m: m[0].lower(), k)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_documents or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def dropped(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=str)


def line_texts(n=200):
    rng = random.Random(8)
    common = ["All rights reserved by the owner", "  all RIGHTS reserved by the OWNER\t", "äöüßäöüßäöüßäöüßäöüß", "äöüßäöüßäöüßäöüßäöü",
              "x" * 19, "x" * 20, " " + "X" * 20 + "\r", "İstanbul ÄÖÜ is written so", "istanbul äöü is written so", "日本語の行はここにあります。これは二十文字だ"]
    docs = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < .4 else prose("en", rng.randrange(400), rng.choice([3, 6, 9])) for _ in range(rng.randrange(9))]
        docs.append((i % (n - 20), "\n".join(lines) + "\n" * rng.randrange(3)))     # 20 ids have two texts
    return docs


@pytest.mark.parametrize("block_bits", [20, 6])
def test_lines_against_brute_force(make_docs, monkeypatch, block_bits):
    """Also with a filter so small that it suspects nearly everything."""
    if block_bits < 20:
        monkeypatch.setattr(bloom, "MAX_BITS", bloom.BLOCK)
        monkeypatch.setattr(bloom.Filter, "has", lambda self, h: np.ones(len(h), bool))
    docs = line_texts()
    got = dropped(linededup.drop_lines(make_docs(docs, 6)))
    assert got == plain_lines(docs) and sum(r[2] for r in got) > 100


def test_lines_of_odd_documents(odd_docs, no_docs, make_docs):
    assert dropped(linededup.drop_lines(odd_docs)) == plain_lines(ODD)
    assert linededup.drop_lines(no_docs).count() == 0
    docs = [(None, "one line that is long enough"), (1, "one line that is long enough"), (1, "one line that is long enough"),
            (2, "One line that is long enough\nx"), (3, None), (4, "")]
    assert dropped(linededup.drop_lines(make_docs(docs))) == plain_lines(docs)      # two documents hold it: ids count once
    docs.append((5, "\n one line that is long ENOUGH \nend"))
    got = dropped(linededup.drop_lines(make_docs(docs)))
    assert got == plain_lines(docs) and sum(r[2] for r in got) == 3


def test_only_suspected_repeats_are_shuffled(spark, make_docs, tmp_path):
    """Lines that occur once do not pass the twice-seen filter."""
    docs = [(i, "\n".join(f"line {i} {j} that nobody else has in any text" for j in range(50))) for i in range(200)]
    docs += [(1000 + i, "the one line that ten documents have in common") for i in range(10)]
    data = make_docs(docs, 4).selectExpr("doc_id", "cast(text as binary) data")
    n = bloom.blocks_for(10_010)
    seen = bloom.collected(data.select("data").mapInArrow(linededup._see(n, 20), bloom.SEEN), twice=True)
    sent = spark.sparkContext.broadcast(seen)
    found = data.mapInArrow(linededup._suspect(sent, n, 20), "high long, low long, doc_id long")
    assert 10 <= found.count() < 10 + 500
    assert {r["doc_id"] for r in found.collect()} >= {1000 + i for i in range(10)}


def test_bloom_pair_forgets_nothing(spark):
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2 ** 63, 4000).astype(np.uint64)
    tasks = [np.unique(rng.choice(pool, 1500)) for _ in range(4)]
    n_blocks = bloom.blocks_for(100_000)
    rows = [tuple(r.values()) for h in tasks for r in bloom.seen_batch(h, h[:3], n_blocks).to_pylist()]
    seen = spark.createDataFrame(rows, bloom.SEEN)
    h, n = np.unique(np.concatenate([*tasks, *(t[:3] for t in tasks)]), return_counts=True)
    twice, once = (bloom.Filter(bloom.collected(seen, x), n_blocks) for x in (True, False))
    assert twice.has(h[n > 1]).all() and once.has(h).all()
    assert twice.has(h[n == 1]).mean() < 0.1 and once.has(rng.integers(0, 2 ** 63, 4000).astype(np.uint64)).mean() < 0.1
    assert bloom.blocks_for(0) == 1 and bloom.blocks_for(10 ** 15) * bloom.BLOCK == bloom.MAX_BITS


# -- divergence --------------------------------------------------------------

def plain_divergence(docs, min_documents=3, top=200):
    """docs: (text, lang, source)"""
    found = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))), lang, s)
             for t, lang, s in docs]
    out = set()
    for lang in {x[1] for x in docs}:
        df = Counter(t for c, x, _ in found if x == lang for t in c)
        kept = {t for t, n in df.items() if n >= min_documents}
        groups = sorted({s for _, x, s in docs if x == lang})
        count = {s: Counter() for s in groups}
        for c, x, s in found:
            if x == lang:
                count[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for a in groups:
            pairs = [(sum((share(count[a], t) - share(count[b], t)) ** 2 // share(count[b], t) for t in kept), b) for b in groups if b != a]
            terms = [((share(count[a], t) - share(whole, t)) ** 2 // share(whole, t), t) for t in kept
                     if count[a][t] and share(count[a], t) > share(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (v, x) in enumerate(sorted(items, key=lambda y: (-y[0], y[1].encode()))[:most], 1):
                    out.add((lang, a, part, x, v, rank))
    return out


def diverging(df):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def divergence_docs(n=240):
    rng = random.Random(11)
    extra = ["prefix", "prefixed", "pre", "prefixes", "ÜBER", "über", "naïve", "語", "語彙", "don't", "a1b", "_x_"]
    return [(" ".join([prose("en", i, 30), *rng.choices(extra, k=6), f"rare{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" * 3]) if i % 17 else None,
             rng.choice(["en", "de"]), f"s{min(rng.randrange(9), 5)}") for i in range(n)] + [("zq", "xx", "a"), (None, "xx", "b"), ("!", "xx", "c")]


@pytest.mark.parametrize("first_level,top,chunk", [(4, 200, 32 << 20), (1, 5, 2000)])
def test_divergence_against_brute_force(spark, monkeypatch, first_level, top, chunk):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
    docs = divergence_docs()
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    want = plain_divergence([(t or "", x, s) for t, x, s in docs], top=top)
    got = diverging(divergence.audit(df, first_level=first_level, top=top))
    assert got == want
    assert {r for r in got if r[0] == "xx"} == {("xx", a, "pair", b, 0, k) for a, bs in (("a", "bc"), ("b", "ac"), ("c", "ab")) for k, b in enumerate(bs, 1)}


def test_divergence_of_odd_documents(odd_docs, no_docs):
    docs = [(t, lang, s) for _, t, lang, s in odd_parts(odd_docs)]
    assert diverging(divergence.audit(odd_docs)) == plain_divergence(docs)
    assert diverging(divergence.audit(odd_docs, min_documents=1)) == plain_divergence(docs, 1)
    assert divergence.audit(no_docs).count() == 0


def test_iceberg_discards_rare_prefixes(spark):
    docs = [(f"common{'' if i % 2 else 'est'} {hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans('0123456789', 'ghijklmnop'))}", "en", "s")
            for i in range(60)]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    tables, _ = divergence.kept_terms(df)
    terms = [t for r in tables.collect() for t in divergence._expanded(bytes(r["terms"]))]
    assert sorted(terms) == [b"common", b"commonest"]


def test_shares_are_exact_beyond_64_bits():
    big = np.array([9_300_000_000, 12_000_000_000_000], np.int64)
    assert divergence.shares(big, 10 ** 14, 7).tolist() == [1 + 10 ** 9 * (int(c) + 1) // (10 ** 14 + 7) for c in big]
