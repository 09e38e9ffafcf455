"""Mixing, sharding, URL lists and the pipeline."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from conftest_rows import ODD, prose
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from placeweave.llm import decontam, mixing, sharding, simhash, toxicity, urlfilter

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- mixing ------------------------------------------------------------------

def test_fit_reaches_the_best_sum():
    rng = random.Random(0)
    for _ in range(200):
        lengths = np.array(rng.sample(range(0, 40), rng.randrange(1, 8)))
        counts = np.array([rng.randrange(1, 5) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 10)
        take = mixing.fit(lengths, counts, budget)
        assert ((0 <= take) & (take <= counts)).all()
        sums = {0}
        for s, c in zip(lengths.tolist(), counts.tolist()):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        share = np.minimum(counts, counts * budget // max(int((lengths * counts).sum()), 1))
        base = int((lengths * share).sum())                 # the proportional part stays
        rest = {0}
        for s, c, t in zip(lengths.tolist(), counts.tolist(), share.tolist()):
            rest = {x + s * k for x in rest for k in range(c - t + 1)}
        assert int((lengths * take).sum()) == (max(x for x in rest if x <= budget - base) + base
                                               if budget < (lengths * counts).sum() else (lengths * counts).sum())


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"z": 4, "é": 4, "A": 4, None: 9}, {"x": 7},
                                   {"a": 0, "b": 0}, {f"s{i}": 3 ** i for i in range(9)}])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in rows} == plain_targets(sizes)


def mix_rows(spark, seed=3, n=800):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["b", "c", None])
        rows.append((i, prose("en", 0 if i % 3 else i, 40 if i % 3 else rng.randrange(1, 90)), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("per_slice", [mixing.SLICE, 16])
def test_mix_meets_its_targets(spark, monkeypatch, per_slice):
    monkeypatch.setattr(mixing, "SLICE", per_slice)
    docs = mix_rows(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 800
    want = plain_targets({s: sum(r["size"] for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    for source, target in want.items():
        taken = sum(r["copies"] * r["size"] for r in rows if r["source"] == source)
        assert abs(taken - target) <= 1
        own = {r["copies"] for r in rows if r["source"] == source}
        assert max(own) <= 3 and max(own) - min(own) <= 1
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    if per_slice == mixing.SLICE == 20_000:
        other = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, seed=99).collect()}
        assert other != again and sum(other.values()) == sum(again.values())


def test_mixed_documents_repeat_rows(spark):
    docs = mix_rows(spark)
    docs = docs.unionByName(docs.where("doc_id < 20")).withColumn("copies", docs["doc_id"])
    m = mixing.mix(docs).groupBy("doc_id").sum("copies").collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter({r[0]: r[1] for r in m if r[1]})


def test_mix_of_odd_documents(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(ODD)
    assert all(r["copies"] == 0 for r in rows if r["size"] == 0)
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(no_docs).count() == 0 == mixing.mixed_documents(no_docs).count()


# -- sharding ----------------------------------------------------------------

@pytest.mark.parametrize("n, slots", [(1, 2), (3, 7), (16, 2039), (5, 5)])
def test_table_is_filled_in_turns(n, slots):
    names = tuple(f"s{i}" for i in range(n))
    owner = sharding.fill_table(names, slots)
    counts = Counter(owner)
    assert len(owner) == slots and set(owner) == set(range(n)) and max(counts.values()) - min(counts.values()) <= 1
    orders = []
    for name in names:
        offset, stride = sharding._hash(f"offset:{name}") % slots, (sharding._hash(f"stride:{name}") % (slots - 1) + 1 if slots > 2 else 1)
        orders.append([(offset + j * stride) % slots for j in range(slots)])
    free = set(range(slots))
    for turn in range(slots):
        slot = next(s for s in orders[turn % n] if s in free)
        free.remove(slot)
        assert owner[slot] == turn % n


def test_few_slots_move_when_a_shard_leaves():
    before = sharding.fill_table(sharding.SHARDS, sharding.SLOTS)
    after = sharding.fill_table(sharding.SHARDS[:-1], sharding.SLOTS)
    moved = sum(a != b for a, b in zip(before, after) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.2 * sharding.SLOTS


def test_bad_tables_are_refused():
    for names, slots in (((), 7), (("a", "a"), 7), (("a",), 8), (("a", "b", "c"), 2), (("a",), 1)):
        with pytest.raises(ValueError):
            sharding.fill_table(names, slots)


def test_placement_of_odd_documents(odd_docs, no_docs):
    out = sharding.place(odd_docs)
    assert set(out.columns) == set(odd_docs.columns) and out.count() == len(ODD)
    by_id = {}
    for r in out.collect():
        assert by_id.setdefault(r["doc_id"], (r["slot"], r["shard"], r["shard_name"])) == (r["slot"], r["shard"], r["shard_name"])
        assert r["shard_name"] == sharding.SHARDS[r["shard"]]
    assert "Python" not in plan_of(out) and "Arrow" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
    assert sharding.place(no_docs).count() == 0


# -- URL lists ---------------------------------------------------------------

def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def plain_verdict(host, when, entries):
    labels = host.split(".")
    for i in range(max(1, len(labels) - 1)):
        domain = ".".join(labels[i:])
        active = [e for e in entries if e[0] == domain and e[1] is not None and e[2] is not None and e[1] <= when]
        if active:
            last = max(active, key=lambda e: (e[1], -1 if e[3] is None else e[3], e[2]))
            return domain, last[1], last[2] == "block"
    return None, None, False


def test_verdicts_as_of_the_fetch_day(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "localhost", "x.other.org"]
    entries = [(rng.choice(hosts + ["nowhere.net"]), day(rng.randrange(0, 200)), rng.choice(["block", "allow"]), i) for i in range(60)]
    entries += [("example.com", None, "block", 1), (None, day(1), "block", 2), ("other.org", day(3), None, 3), entries[0]]
    rows = [(i, f"http://{rng.choice(hosts).upper()}:80/p?{i}", day(rng.randrange(-5, 230))) for i in range(300)]
    rows += [(900, None, day(3)), (901, "not a url", day(3)), (902, "http://other.org", None), (903, "ftp://u:p@other.org./x", day(100)),
             (903, "ftp://u:p@other.org./x", day(100)), (None, "http://example.com", day(50))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").selectExpr("*", "'x' as host", "'y' as domain", "1 as month")
    table = spark.createDataFrame(entries, "domain string, day date, action string, entry_id long")
    out = urlfilter.evaluate(captures, table)
    got = sorted(((r["page_id"], r["url"], r["fetched_on"], r["matched_domain"], r["listed_on"], r["blocked"]) for r in out.collect()), key=str)
    want = []
    for i, url, when in rows:
        host = None if url in (None, "not a url") else url.split("://")[1].split("@")[-1].split("/")[0].split(":")[0].lower().rstrip(".")
        want.append((i, url, when, *(plain_verdict(host, when, entries) if host and when else (None, None, False))))
    assert got == sorted(want, key=str)
    assert "Python" not in plan_of(out) and "Arrow" not in plan_of(out)
    assert sorted(out.columns) == sorted(["page_id", "url", "fetched_on", "domain", "month", "host", "matched_domain", "listed_on", "blocked"])
    assert urlfilter.evaluate(captures.limit(0), table).count() == 0
    assert {r["blocked"] for r in urlfilter.evaluate(captures, table.limit(0)).collect()} == {False}


# -- the pipeline ------------------------------------------------------------

def test_pipeline_matches_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(i, decontam.fold(t)) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stage, at = {}, docs
    for name, fn in corpus_pipeline.STAGES:
        at = fn(spark, at, SF).cache()
        stage[name] = at.collect()
        if name != "sharding":
            assert at.columns == docs.columns and at.dtypes == docs.dtypes
    rows = {r["doc_id"]: r for r in docs.collect()}
    dense = toxicity.dense_weights(toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~corpus_pipeline.held_out(3, 1)))
    p = {i: 1 / (1 + np.exp(-(dense[toxicity.features(r["text"])].sum() + dense[-1]))) for i, r in rows.items()}
    left = sorted(i for i in rows if p[i] < toxicity.THRESHOLD)
    assert sorted(r["doc_id"] for r in stage["toxicity"]) == left
    pairs = [(i, plain_fingerprint(rows[i]["text"])) for i in left]
    left = sorted(set(plain_components(pairs)))
    assert sorted(r["doc_id"] for r in stage["simhash_near_dedup"]) == left
    left = [i for i in left if not any(t in decontam.fold(rows[i]["text"]) for _, t in items)]
    clean = sorted(r["doc_id"] for r in stage["benchmark_decontamination"])
    assert set(clean) <= set(left) and len(left) - len(clean) <= 2           # edited leaks, if any
    sizes = Counter()
    for i in clean:
        sizes[rows[i]["source"]] += len(rows[i]["text"].split())
    want = plain_targets(dict(sizes))
    taken = Counter()
    for r in stage["mixing"]:
        assert r == rows[r["doc_id"]]
        taken[r["source"]] += len(r["text"].split())
    for s, target in want.items():
        longest = max(len(rows[i]["text"].split()) for i in clean if rows[i]["source"] == s)
        assert target - longest <= taken[s] <= target + 1
    assert max(Counter(r["doc_id"] for r in stage["mixing"]).values()) <= 3
    table = sharding.fill_table(sharding.SHARDS, sharding.SLOTS)
    assert len(stage["sharding"]) == len(stage["mixing"])
    for r in stage["sharding"]:
        slot = sharding._hash(str(r["doc_id"])) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])


def test_pipeline_runs_as_a_query(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and {"doc_id", "text", "lang", "source", "n_chars", "slot", "shard", "shard_name"} == set(out.columns)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_survive_odd_documents(spark, odd_docs, no_docs):
    base = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "slot", "row_key", "copies")
    for start in (base, base.limit(0)):
        at = start
        for name, fn in corpus_pipeline.STAGES[:-1]:
            at = fn(spark, at, SF)
            assert at.columns == start.columns, name
        corpus_pipeline.place_shards(spark, at, SF).count()


def test_rows_that_differ_in_other_columns_are_chosen_alike(spark):
    """A stage that runs again takes the same rows."""
    rows = [(i // 4, prose("en", i // 4, 40), "en", f"s{i // 4 % 2}", i) for i in range(80)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    takes = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, ddl).repartition(parts)
        takes.append((sorted(map(tuple, mixing.mixed_documents(docs).collect())), sorted(map(tuple, simhash.one_of_each(docs).collect()))))
    assert takes[0] == takes[1] == takes[2]
    assert len({r[0] for r in takes[0][1]}) == len(takes[0][1])
