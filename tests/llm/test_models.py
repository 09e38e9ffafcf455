"""Language, toxicity, benchmark and quality operators."""

import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_rows import ODD, prose
from pyspark.sql import functions as F

from placeweave.llm import decontam, langid, ngrams, packed, quality, toxicity
from placeweave.llm.common import held_out, mix64

SF = "/root/testdata/sf0.01"


# -- language ----------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    from placeweave.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op1_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if not r["rejected"]]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_documents(odd_docs, no_docs):
    samples = langid.fit(odd_docs)
    assert set(samples) == {"en", "de", "fr"} - ({"fr"} if "fr" not in samples else set())
    out = langid.predict(odd_docs, samples)
    assert out.columns[-3:] == ["lang_pred", "score", "rejected"] and out.count() == len(ODD)
    for r in out.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (r["lang_pred"] in samples or not letters)
    assert langid.fit(no_docs) == {}
    assert {r["lang_pred"] for r in langid.predict(odd_docs, {}).collect()} == {"und"}
    assert langid.predict(no_docs, samples).count() == 0


def test_language_samples_are_different_texts(make_docs):
    from placeweave.llm.common import md5_long
    texts = [prose("en", i, 90) for i in range(80)]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[0]) for i in range(200)])
    for order in (None, md5_long(F.col("text")), F.when(F.col("text") == texts[0], -2 ** 63).otherwise(F.xxhash64("text"))):
        got = langid.fit(docs, order=order)["en"]
        assert len(got) == len(set(got)) == langid.SAMPLE_ROWS
        assert all(len(piece) == langid.SAMPLE_CHARS or piece in texts for piece in got)
    assert got[0] in texts[0]


def test_language_samples_start_anywhere(make_docs):
    """Pieces are cut at hashed places, not from the start of the texts."""
    texts = {prose("en", i, 400) for i in range(20)}
    got = langid.fit(make_docs(list(enumerate(texts))))["en"]
    places = [next(t.index(piece) for t in texts if piece in t) for piece in got]
    assert len(got) == 20 and {len(piece) for piece in got} == {langid.SAMPLE_CHARS}
    assert len(set(places)) > 10 and max(places) > 400


def test_language_query_against_a_plain_classifier(spark):
    """The whole query on a table: samples picked and texts encoded one by one."""
    import zlib

    import zstandard

    from placeweave.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("h", F.xxhash64("text")).withColumn("at", F.xxhash64("text", F.lit(1))).collect()

    def plain(text):
        return b" ".join(re.sub(r"[^A-Za-z\x80-\U0010ffff]+", " ", text.lower()).encode().split())
    pieces = {}
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"]:
            start = r["at"] % max(len(r["text"]) - langid.SAMPLE_CHARS + 1, 1)
            piece = r["text"][start:start + langid.SAMPLE_CHARS]
            if any(c.isalpha() for c in piece):
                known = pieces.setdefault(r["lang"], {})
                known[piece] = min(known.get(piece, r["h"]), r["h"])
    coders = {}
    for lang, known in sorted(pieces.items()):
        first = sorted((h, x) for x, h in known.items())[:langid.SAMPLE_ROWS]
        p = zstandard.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=16,
                                                strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
        d = zstandard.ZstdCompressionDict(b" ".join(plain(x) for _, x in first), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders[lang] = zstandard.ZstdCompressor(compression_params=p, dict_data=d)
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        out = got[r["doc_id"]]
        assert out["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert out["lang_pred"] == "und"
            continue
        data = plain(r["text"])
        sizes = {lang: sum(len(c.compress(data[i:i + langid.PIECE])) for i in range(0, len(data), langid.PIECE)) for lang, c in coders.items()}
        assert sizes[out["lang_pred"]] == min(sizes.values())
        second = sorted(sizes.values())[1]
        assert out["rejected"] == ((second - min(sizes.values())) / second < langid.MIN_MARGIN)


def test_language_margin():
    by = langid.encoders({k: [prose(k, i, 200) for i in range(3)] for k in ("en", "de", "fr")})
    for k in by:
        lang, score, rejected = langid.classify(prose(k, 77, 60), by)
        assert (lang, rejected) == (k, False) and score > 0.9
    assert langid.classify("xq", by)[2]                                    # a tie is no clear win
    assert langid.classify("xq", by)[0] == "de"                            # ties: the first in order
    assert langid.classify(prose("fr", 5, 40_000), by)[0] == "fr"


# -- toxicity ----------------------------------------------------------------

def toxic_corpus(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose("en", i, 60).split(), rng.random() < .3
        if bad:
            for w in rng.sample(["scum", "moron", "loser"], 2):
                words.insert(rng.randrange(len(words)), rng.choice([w, w + ",", w.upper()]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_toxicity_learns_outside_the_held_out_rows(spark):
    docs, labels, truth = toxic_corpus(spark)
    model = toxicity.fit(docs, labels, ~held_out(3, 1))
    rows = toxicity.score(docs.withColumn("held", held_out(3, 1)), model).where("held").collect()
    said = [(r["score"] >= toxicity.THRESHOLD, bool(truth[r["doc_id"]])) for r in rows]
    assert len(said) > 120
    assert np.mean([s for s, t in said if t]) > 0.95 and np.mean([s for s, t in said if not t]) < 0.02
    again = toxicity.fit(docs.repartition(7), labels, ~held_out(3, 1))
    assert all((a == b).all() for a, b in zip(model, again))               # order of the input does not matter
    assert len(model[0]) < 2000                                            # L1 keeps it sparse
    # labels of the held-out third change nothing
    flipped = labels.withColumn("toxic", F.when(held_out(3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert all((a == b).all() for a, b in zip(model, toxicity.fit(docs, flipped, ~held_out(3, 1))))
    clean = {r["doc_id"] for r in toxicity.clean(docs, model).collect()}
    assert clean == {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < toxicity.THRESHOLD}


def test_toxicity_query_against_plain_ftrl(spark):
    """The whole query on a table: one number after the other, in dictionaries."""
    import zlib

    from placeweave.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("order", F.xxhash64("doc_id", "text")).collect()
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            labels[r["doc_id"]] = max(labels.get(r["doc_id"], 0), r["toxic"])
    rows = sorted((r["order"], labels[r["doc_id"]], r["text"]) for r in docs if r["doc_id"] in labels)
    assert 20 < len(rows) < toxicity.MAX_TRAINING_ROWS
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == toxicity.DIM else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    def score(at):
        return 1 / (1 + math.exp(-min(max(sum(map(weight, at)), -35), 35)))
    for _ in range(toxicity.EPOCHS):
        for _, label, text in rows:
            at = [*toxicity.features(text).tolist(), toxicity.DIM]
            old = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-min(max(sum(old.values()), -35), 35))) - label
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * old[i]
                n[i] += g * g
    got = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want = score([*toxicity.features(r["text"]).tolist(), toxicity.DIM])
        out = got[r["doc_id"]]
        assert out["score"] == pytest.approx(want, abs=1e-6) and out["predicted"] == int(out["score"] >= toxicity.THRESHOLD)
        assert out["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    out = toxicity.score(odd_docs, model)
    assert sorted(out.columns) == sorted(odd_docs.columns)                # score is replaced
    scores = [r["score"] for r in out.collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    empty = {r["score"] for r in out.collect() if not (r["text"] or "").strip()}
    assert len(empty) == 1                                                # the bias alone
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.5}
    assert toxicity.score(no_docs, model).count() == 0 == toxicity.clean(no_docs, model).count()
    assert toxicity.clean(odd_docs, none).columns == odd_docs.columns


def test_toxicity_sample_bounds_rows_and_coordinates(spark, monkeypatch):
    """An id on very many rows does not widen the sample."""
    docs = spark.createDataFrame([(1, prose("en", i, 30)) for i in range(500)] + [(2, "scum and moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    seen = spark.sparkContext.accumulator(0)

    def counting(batches, train=toxicity._train):
        batches = list(batches)
        seen.add(sum(b.num_rows for b in batches))
        yield from train(iter(batches))
    monkeypatch.setattr(toxicity, "_train", counting)
    toxicity.fit(docs, labels, max_rows=2)
    assert seen.value == 2
    batch = next(toxicity._extract(iter([__import__("pyarrow").RecordBatch.from_pydict(
        {"order": [1, 2], "label": [1, 1], "text": ["scum scum", prose("en", 3, 50)]})])))
    monkeypatch.undo()
    monkeypatch.setattr(toxicity, "MAX_TRAINING_FEATURES", 4)
    some = list(toxicity._train(iter([batch])))[0]
    few = list(toxicity._train(iter([batch.slice(0, 1)])))[0]
    assert some.equals(few)                                                # the second row is over the bound


def test_ftrl_updates_by_hand():
    m = toxicity.Ftrl()
    m.learn(np.array([5]), 1)                                              # p = 0.5, gradient -0.5
    assert m.z[5] == m.z[toxicity.DIM] == -0.5 and m.n[5] == 0.25
    w = m.weights(np.array([5, toxicity.DIM]))
    assert w[0] == 0.0                                                     # thinned out by L1
    assert w[1] == pytest.approx(0.5 / ((toxicity.BETA + 0.5) / toxicity.ALPHA + toxicity.L2))


# -- benchmark leaks ---------------------------------------------------------

def best_distance(item, text):
    """Smallest edit distance of the item to any stretch of text (by rows)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        prev, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (a != b))
    return min(row)


def test_myers_matches_the_table():
    rng = random.Random(0)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        got, end = decontam.myers(decontam.masks(item), len(item), text)
        assert got == best_distance(item, text)
        assert best_distance(item[::-1], text[:end][::-1]) <= got if got < len(item) else True


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = "q"
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, "z")
    return "".join(t)


def test_edited_items_are_found_and_clean_documents_are_not(spark, make_docs):
    rng = random.Random(4)
    items = [(k, prose("fr", f"i{k}", 40)) for k in range(6)]
    docs, want = [], set()
    for i in range(60):
        k = rng.randrange(6)
        text = prose("en", f"d{i}", 50)
        if i % 2:
            leak = edited(rng, items[k][1], rng.randrange(0, int(len(items[k][1]) * .05) + 1))
            if i % 3 == 0:
                leak = leak.upper().replace(" ", "\n ")
            text = f"{text} {leak} {prose('en', f'e{i}', 20)}"
            want.add((i, k))
        docs.append((i, text))
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.matches(make_docs(docs), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    folded = {k: decontam.fold(t) for k, t in items}
    texts = {i: decontam.fold(t) for i, t in docs}
    for r in rows:
        assert r["distance"] == best_distance(folded[r["item_id"]], texts[r["doc_id"]])
    kept = decontam.clean(make_docs(docs), table)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if i % 2 == 0}


def test_blocks_of_items_give_the_same(spark, make_docs, monkeypatch):
    docs = make_docs([(1, "x " + prose("de", 1, 30)), (2, prose("de", 2, 30)), (3, "none of it")])
    items = spark.createDataFrame([(k, prose("de", k, 30)) for k in range(4)] + [(9, None), (8, ""), (None, "x")],
                                  "item_id long, text string")
    whole = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.matches(docs, items).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.matches(docs, items).collect()), key=str) == whole
    assert whole == [(1, 1, 0), (1, None, 0), (2, 2, 0)]
    assert [r["doc_id"] for r in decontam.clean(docs, items).collect()] == [3]


def test_leaks_in_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, prose("en", 1, 120)), (1, prose("en", 1, 120))], "item_id long, text string")
    rows = decontam.matches(odd_docs, items).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "7", "7", "None"] * 2)
    kept = decontam.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD) - 4
    assert decontam.matches(no_docs, items).count() == 0 == decontam.clean(no_docs, items).count()
    assert decontam.clean(odd_docs, items.limit(0)).count() == len(ODD)
    nameless = spark.createDataFrame([(None, prose("de", 2, 130)), (None, None), (3, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.matches(odd_docs, nameless).collect()] == [(2, None)]
    assert 2 not in {r["doc_id"] for r in decontam.clean(odd_docs, nameless).collect()}


# -- quality -----------------------------------------------------------------

def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_figures():
    rng = random.Random(2)
    texts = [t or "" for _, t in ODD] + ["a\nb\na\n\n \n a\na", "x y z x y z x y", "é" * 5 + " #*$%&|<> \x1c\x85 ok"]
    texts += ["".join(rng.choice("ab é\n#|\t") for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    for t in texts:
        assert quality.base_figures(t.encode()) == plain_figures(t)


def plain_costs(docs):
    """docs: (key, text) → key: (words, nats), from the formulas, one document
    after the other, its own occurrences left out."""
    def context(word):
        return xxhash.xxh3_64_intdigest(word) >> 64 - ngrams.CONTEXT_BITS

    def discounts(values):
        ones = [sum(v == i for v in values) for i in range(1, 5)]
        y = ones[0] / max(ones[0] + 2 * ones[1], 1)
        cut = [i + 1 - (i + 2) * y * ones[i + 1] / ones[i] if ones[i] else (i + 1) / 2 for i in range(3)]
        cut = [min(max(c, .05), i + .95) for i, c in enumerate(cut)]
        return lambda v: cut[min(v, 3) - 1] if v else 0.0
    own = []
    for key, text in docs:
        words = (text or "").encode().lower().split()
        own.append((key, len(words), Counter(zip(map(context, [b"", *words]), words))))
    counts = sum((c for _, _, c in own), Counter())
    left, total = Counter(w for _, w in counts), Counter()
    for (ctx, _), n in counts.items():
        total[ctx] += n
    d2, d1 = discounts(counts.values()), discounts(left.values())
    back = Counter()
    for (ctx, _), n in counts.items():
        back[ctx] += d2(n) / total[ctx]
    base = sum(map(d1, left.values())) / max(len(counts), 1) / (len(left) + 1)
    out = {}
    for key, n_words, mine in own:
        nats = 0.0
        for (ctx, w), n in mine.items():
            c = counts[ctx, w] - n
            nats -= n * math.log((c - d2(c)) / total[ctx] + back[ctx] * ((left[w] - d1(left[w])) / len(counts) + base))
        out[key] = n_words, nats
    return out


def lm_docs(n=60):
    rng = random.Random(12)
    docs = [(i, prose(rng.choice(["en", "de"]), i % 40, rng.randrange(1, 90))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "中文 語言 模型 中文 語言 模型"), (n + 3, "乄斞 誵託 樸垢"), (n + 4, "THE Cat\tand the dog"), (n + 5, "x")]


@pytest.mark.parametrize("hot,chunk,parts", [([], 16 << 20, 1), ([b"the", b"und", b"cat"], 300, 5)])
def test_kneser_ney_costs_against_the_formulas(spark, monkeypatch, hot, chunk, parts):
    """Also with hot words dealt out by context, many chunks and buckets."""
    monkeypatch.setattr(ngrams, "hot_words", lambda rows: np.sort(ngrams._hashes(hot)))
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ngrams, "bucket_count", lambda *a, **k: 7 if hot else 1)
    docs = lm_docs()
    rows = spark.createDataFrame([(k, None if t is None else t.encode()) for k, t in docs], "row_key long, data binary").repartition(parts)
    got = {r["row_key"]: (r["words"], r["cost"] / ngrams.PARTS) for r in ngrams.costs(rows).collect()}
    want = plain_costs(docs)
    assert set(got) == set(want)
    for k, (n, nats) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(nats, abs=5e-3 * n + 1e-9)


def test_contexts_are_whole_words(spark):
    """Words whose hashes begin alike are contexts of their own, in sums that
    several buckets send and in costs."""
    found = {}
    for i in range(10 ** 4):
        found.setdefault(xxhash.xxh3_64_intdigest(f"c{i}".encode()) >> 54, []).append(f"c{i}")
    alike = max(found.values(), key=len)[:6]
    docs = [(i, " ".join(f"{a} {'left' if j % 2 else 'right'} t{i} {a} w{j}" for j, a in enumerate(alike))) for i in range(12)]
    chunk = ngrams.Chunk()
    chunk.add(1, docs[0][1].encode())
    h, ctx, _, n = chunk.grams()
    assert set(ctx.tolist()) == set(ngrams._hashes([ngrams.START, *docs[0][1].encode().split()]).astype(np.int64).tolist()) - {
        int(ngrams._hashes([b"w5"])[0])}
    assert n.sum() == 30 and (np.diff(h.astype(object)) >= 0).all()
    rows = spark.createDataFrame([(k, t.encode()) for k, t in docs], "row_key long, data binary").repartition(3)
    got = {r["row_key"]: (r["words"], r["cost"] / ngrams.PARTS) for r in ngrams.costs(rows).collect()}
    counts = Counter()
    for _, t in docs:
        counts.update(zip(["", *t.split()], t.split()))
    total, left = Counter(), Counter(w for _, w in counts)
    for (c, _), k in counts.items():
        total[c] += k

    def discounts(values):
        ones = [sum(v == i for v in values) for i in range(1, 5)]
        y = ones[0] / max(ones[0] + 2 * ones[1], 1)
        cut = [i + 1 - (i + 2) * y * ones[i + 1] / ones[i] if ones[i] else (i + 1) / 2 for i in range(3)]
        return [0.0] + [min(max(c, .05), i + .95) for i, c in enumerate(cut)]
    d2, d1 = discounts(counts.values()), discounts(left.values())
    base = sum(d1[min(v, 3)] for v in left.values()) / len(counts) / (len(left) + 1)
    back = Counter()
    for (c, _), k in counts.items():
        back[c] += d2[min(k, 3)] / total[c]
    for key, t in docs:
        mine, nats = Counter(zip(["", *t.split()], t.split())), 0.0
        for (c, w), k in mine.items():
            k2 = counts[c, w] - k
            low = (left[w] - d1[min(left[w], 3)]) / len(counts) + base
            nats -= k * math.log((k2 - d2[min(k2, 3)]) / total[c] + back[c] * low)
        assert got[key][0] == 30 and got[key][1] == pytest.approx(nats, abs=.15)


def test_grams_of_a_chunk():
    """Every n-gram with its document and count."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(30))) for _ in range(40)]

    def grams():
        chunk = ngrams.Chunk()
        for i, t in enumerate(texts):
            chunk.add(i, t.encode())
        h, ctx, doc, n = chunk.grams()
        return Counter({(a, b, chunk.keys[d]): k for a, b, d, k in zip(h.tolist(), ctx.tolist(), doc.tolist(), n.tolist())})
    want = Counter()
    for i, t in enumerate(texts):
        w = t.encode().split()
        want.update((a, b, i) for a, b in zip(ngrams._hashes(w).tolist(), ngrams._hashes([ngrams.START, *w]).tolist()))
    assert grams() == want


def test_numbered_words_pack_smaller_and_change_nothing(spark, monkeypatch):
    """Rows of n-grams name frequent words by numbers; what is unpacked and all
    costs are those of rows without numbers."""
    rng = random.Random(8)
    texts = [" ".join(f"w{min(int(rng.expovariate(.01)), 900)}" for _ in range(150)) + f" only{i}" for i in range(60)] + ["", "w1"]
    often = [f"w{i}".encode() for i in range(600)]
    numbered = pickle.loads(pickle.dumps(ngrams.Numbers(ngrams._hashes(often).astype(np.int64))))
    sizes, found = [], []
    for num in (ngrams.PLAIN, numbered):
        chunk, size, back = ngrams.Chunk(), 0, Counter()
        for i, t in enumerate(texts):
            chunk.add(i, t.encode())
        h, ctx, doc, n = chunk.grams(num)
        for _, at in packed.split(ngrams.bucket_of(h, ctx, np.empty(0, np.uint64), 5), 5):
            row = dict(zip(("heads", "grams", "docs"), ngrams.packed(h[at], ctx[at], doc[at], n[at], True, num)))
            size += sum(map(len, row.values()))
            words, contexts, _, docs, times, gram = ngrams._part(row, num)
            back.update(dict(zip(zip(words[gram].tolist(), contexts[gram].tolist(), docs.tolist()), times.tolist())))
        assert back == dict(zip(zip(h.tolist(), ctx.tolist(), doc.tolist()), n.tolist()))
        sizes.append(size)
        found.append(Counter({(a, b, chunk.keys[d]): k for (a, b, d), k in back.items()}))
    assert found[0] == found[1] and sizes[1] < .8 * sizes[0]

    monkeypatch.setattr(ngrams, "SAMPLE", 1)
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(ngrams, "bucket_count", lambda *a, **k: 5)
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "row_key long, data binary").repartition(3)
    words = ngrams._hashes([w for w, _ in sorted(Counter(ngrams.words_of(" ".join(texts).encode())).items())]).astype(np.int64).tolist()

    def costs(most):
        monkeypatch.setattr(ngrams, "NUMBERED", most)
        numbers = ngrams.frequent_words(rows).words.tolist()
        assert len(numbers) == min(most, len(words)) and set(numbers) <= set(words)
        return sorted(map(tuple, ngrams.costs(rows).collect()))
    assert costs(0) == costs(40) == costs(1 << 17)
    count = Counter(ngrams.words_of(" ".join(texts).encode()))
    first = [count[w] for x in ngrams.frequent_words(rows).words.tolist() for w in count if ngrams._hashes([w])[0] == x][:30]
    assert first == sorted(count.values(), reverse=True)[:30]


def test_rows_of_grams_are_short_and_whole(monkeypatch):
    """Weights packed apart and words dealt out by range make rows shorter than
    ``pack`` and remainders of hashes; no n-gram of a large vocabulary changes."""
    rng, n = np.random.default_rng(4), 4
    drawn = [np.minimum(rng.zipf(1.2, 400), 1 << 40).tolist() for _ in range(700)]
    texts = [" ".join([f"w{x}" if x < 3000 else f"r{rng.integers(1 << 40)}" for x in d]) for d in drawn]
    chunk, want = ngrams.Chunk(), Counter()
    for i, t in enumerate(texts):
        chunk.add(i, t.encode())
        w = t.encode().split()
        want.update((a, b, i) for a, b in zip(ngrams._hashes(w).tolist(), ngrams._hashes([ngrams.START, *w]).tolist()))
    numbered = ngrams.Numbers(ngrams._hashes([f"w{i}".encode() for i in range(1, 2000)]).astype(np.int64))
    h, ctx, doc, times = chunk.grams(numbered)
    hot = np.sort(ngrams._hashes([b"w1", b"w2"]))
    bucket = ngrams.bucket_of(h, ctx, hot, n)
    assert len(chunk.number) ** 2 > 1 << 31                          # codes of n-grams need 8 bytes
    cold = ~np.isin(h, hot)
    assert (bucket[cold] == [int(x) * n >> ngrams.HASH_BITS for x in h[cold].tolist()]).all()
    assert min(Counter(ngrams.hash_range(np.unique(h), n).tolist()).values()) > .9 * len(np.unique(h)) / n and set(bucket[~cold].tolist()) == set(range(n))

    def rows(bucket):
        size, back = 0, Counter()
        for _, at in packed.split(bucket, n):
            row = dict(zip(("heads", "grams", "docs"), ngrams.packed(h[at], ctx[at], doc[at], times[at], True, numbered)))
            size += sum(map(len, row.values()))
            words, contexts, _, docs, k, gram = ngrams._part(row, numbered)
            back.update({(a, b, chunk.keys[d]): x for a, b, d, x in zip(words[gram].tolist(), contexts[gram].tolist(), docs.tolist(), k.tolist())})
        assert back == want
        return size

    size = rows(bucket)
    monkeypatch.setattr(ngrams, "pack", packed.pack)
    monkeypatch.setattr(ngrams, "unpack", packed.unpack)
    assert size < .96 * rows((mix64(h) % np.uint64(n)).astype(np.int64))


def test_columns_packed_apart():
    """Any columns come back; short ones take one byte more than ``pack``, even
    bytes beside uneven ones less."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 300, 30000):
        for cols in ([rng.integers(0, 1 << 47, n), rng.integers(0, 3, n).astype(np.uint8)], [np.zeros(n, np.int32)],
                     [rng.integers(-9, 9, n), rng.integers(0, 1 << 30, n).astype(np.uint32), rng.integers(0, 999, n).astype(np.uint16)]):
            data = packed.pack_apart(*cols)
            back = packed.unpack_apart(data)
            assert len(data) <= len(packed.pack(*cols)) + 1
            assert [b.dtype for b in back] == [c.dtype for c in cols] and all((a == b).all() and a.shape == b.shape for a, b in zip(cols, back))
    uneven = rng.geometric(.001, 30000).astype(np.uint16)
    assert len(packed.pack_apart(uneven)) < .97 * len(packed.pack(uneven))


def test_contexts_send_what_counts_add_up_to_beyond_the_least():
    """A context whose n-grams count 1 and 2 has nothing beyond; the sums of
    two buckets come back whole."""
    sums = np.array([[1, 1, 0, 0], [4, 2, 1, 0], [12, 1, 1, 2]])
    beyond = sums[:, 0] - sums[:, 1:] @ ngrams.LEAST
    assert beyond.tolist() == [0, 0, 3]
    h, ctx = np.array([5, 5, 6, 7, 8], np.uint64), np.array([1, 2, 2, 2, 2])
    heads, grams, _ = ngrams.packed(np.sort(h), ctx, np.zeros(5, np.int64), np.array([1, 1, 2, 3, 6]), False)
    batch = pa.RecordBatch.from_pylist([{"bucket": b, "heads": heads, "grams": grams, "docs": None} for b in (0, 1)])
    sent = pa.Table.from_batches(ngrams._partial(1, ngrams.PLAIN)([batch]))
    assert [x.tolist() for x in ngrams.PLAIN.unpack(sent.to_pylist()[0]["data"])] == [[1, 2], [0, 3], [1, 1], [0, 1], [0, 2]]
    said = pa.Table.from_batches(ngrams._replies(ngrams.PLAIN)(sent.to_batches())).to_pylist()
    assert [(r["bucket"], [x.tolist() for x in ngrams.unpack(r["data"])]) for r in said] == [
        (b, [[0, 6], [2, 2], [0, 2], [0, 4]]) for b in (0, 1)]


def test_kneser_ney_sums_to_one(spark):
    docs = lm_docs()
    rows = spark.createDataFrame([(k, (t or "").encode()) for k, t in docs], "row_key long, data binary")
    hot = np.empty(0, np.uint64)
    grams = rows.coalesce(1).mapInArrow(ngrams._count(hot, 1, False), ngrams.GRAMS)
    found = {(r["kind"], r["key"]): (r["a"], r["b"], r["c"], r["d"]) for r in grams.mapInArrow(ngrams._statistics(hot), ngrams.STATISTICS).collect()}
    model = ngrams.Model(found, hot)
    b = ngrams.Bucket([ngrams.unpacked(bytes(r["heads"]), bytes(r["grams"])) for r in grams.collect()])
    assert (np.diff(b.h.astype(object)) >= 0).all()                        # sorted arrays
    for ctx in [*np.unique(b.ctx)[::7].tolist(), 777]:
        count = np.zeros(len(b.word), np.int64)
        count[b.word_of[b.ctx == ctx]] = b.count[b.ctx == ctx]
        p = model.probability(count, np.full(len(b.word), ctx), b.types).sum()
        unknown = model.probability(np.array([0]), np.array([ctx]), np.array([0]))[0]
        assert p + unknown == pytest.approx(1.0)


def test_hot_words_and_growth(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SAMPLE", 1)
    monkeypatch.setattr(ngrams, "HOT_SHARE", 8)
    texts = ["the " * 3 + " ".join(f"w{i}x{j}" for j in range(9)) for i in range(30)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "row_key long, data binary").repartition(3)
    assert ngrams.hot_words(rows).tolist() == ngrams._hashes([b"the"]).tolist()
    # what is gathered grows with the corpus, and other scripts are not folded
    none = np.empty(0, np.uint64)

    def grams(df):
        return sum(len(ngrams.unpacked(bytes(r["heads"]), bytes(r["grams"]))[0]) for r in df.coalesce(1).mapInArrow(ngrams._count(none, 1, False), ngrams.GRAMS).collect())
    assert grams(rows) > 2.9 * grams(rows.where("row_key < 10"))
    assert len(set(ngrams._hashes(["中文".encode(), "乄斞".encode(), "語言".encode()]).tolist())) == 3


def test_quality_bands_against_plain_medians(spark):
    """What is kept, from every document's cost, by medians of plain lists."""
    rng = random.Random(13)
    rows = [(i, prose(k or "fr", i, 50 + i % 200), k) for i, k in enumerate(["en", "de", None] * 30)]
    rows += [(200 + i, " ".join("".join(rng.choice("qxzjvwk#%&") for _ in range(5)) for _ in range(90)), "en") for i in range(4)]
    rows += [(300, "x " * 60, "en"), (301, None, "de"), (302, prose("de", 9, 20), "de")]
    got = {r["doc_id"]: r for r in quality.rate(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    mean = {k: nats / n for k, (n, nats) in plain_costs([(i, t) for i, t, _ in rows]).items() if n}

    def lower_median(values):
        return sorted(values)[(len(values) - 1) // 2]
    for lang in ("en", "de", None):
        mine = [i for i, _, x in rows if x == lang]
        bins = {i: math.floor(got[i]["log_perplexity"] / quality.BIN) for i in mine if i in mean}
        mid = lower_median(bins.values())
        dev = max(lower_median([abs(b - mid) for b in bins.values()]) * quality.BIN * 1.4826, quality.DEVIATION_FLOOR)
        for i in mine:
            r = got[i]
            if i not in mean:
                assert r["log_perplexity"] is None and not r["kept"]
                continue
            assert r["log_perplexity"] == pytest.approx(mean[i], abs=5e-3)
            wide = dev * math.sqrt(1 + quality.LENGTH_SCALE / r["n_words"])
            middle = (mid + .5) * quality.BIN
            inside = middle - wide * quality.BAND_BELOW <= r["log_perplexity"] <= middle + wide * quality.BAND_ABOVE
            n, _, _, _, repeats = plain_figures(dict((k, t) for k, t, _ in rows)[i])
            assert r["kept"] == (inside and n >= 50 and 100 * repeats <= 50 * n)
    assert not any(got[200 + i]["kept"] for i in range(4)) and got[0]["kept"]


def test_bands_reject_strange_texts_and_keep_clean_ones(spark):
    rng = random.Random(9)
    rows = [(i, prose(k, i, 50 + i % 300), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000 + i, " ".join("".join(rng.choice("qxzjvwk#%&") for _ in range(6)) for _ in range(200)), "en") for i in range(5)]
    rows += [(2000, prose("en", 1, 49), "en"), (2001, "so it is " * 60, "en"), (2002, prose("de", 3, 200), None)]
    got = {r["doc_id"]: r for r in quality.rate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(180))
    assert not any(got[1000 + i]["kept"] or got[1000 + i]["base_failed"] for i in range(5))
    assert got[2000]["base_failed"] and got[2001]["base_failed"] and got[2002]["kept"]
    assert not got[2000]["kept"] and not got[2001]["kept"]


def test_quality_of_odd_documents(odd_docs, no_docs):
    rows = quality.rate(odd_docs).collect()
    assert sorted((r["n_words"], r["n_repeat_words"]) for r in rows) == sorted(
        (f[0], f[4]) for f in (plain_figures(t or "") for _, t in ODD))
    for r in rows:
        assert r["kept"] is not None and not (r["kept"] and r["base_failed"])
        assert (r["log_perplexity"] is None) == (r["n_words"] == 0)
        assert r["log_perplexity"] is None or math.isfinite(r["log_perplexity"])
    assert quality.rate(no_docs).count() == 0
