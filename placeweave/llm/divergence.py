"""Source divergence audit with iceberg prefix refinement.

How much do the sources of a language differ in their words?  Each language
keeps the terms that occur in at least ``MIN_DOCUMENTS`` of its documents.
Nearly all distinct terms of a corpus are rarer than that, so they are found
from the top: byte prefixes of 4, 8, 16, … bytes are counted by distinct
documents, prefixes below the threshold are discarded with all terms under
them, and the rest is extended, until every surviving prefix is a whole term.

* Tasks turn their texts into small vocabularies with (document, term, count)
  triples, written once; every level reads those, not the texts.
* A level counts prefixes by partial and final aggregates.  The survivors go
  to the next level as a Bloom filter of bounded size (see ``bloom``); a
  prefix that only looks alive is met again at the next level, and the last
  counts are exact.
* Counts of kept terms are merged by hash bucket of the term into sparse
  term × source tables.  Totals per group come from these.
* The distance of two sources sums ``floor((p - q)² / q)`` over all kept terms.
  Where a source lacks a term, p is that source's constant, so a bucket adds
  constants for all terms and corrections for the sources that have it: pairs
  are formed only of sources that share a term, inside the bucket's arrays.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm import bloom
from placeweave.llm.common import bucket_count, written
from placeweave.llm.packed import pack, split, unpack

MIN_DOCUMENTS, TOP_TERMS, SCALE = 3, 200, 10 ** 9
#: Length in bytes of the first level's prefixes; each level doubles it.
FIRST_LEVEL = 4
#: Text bytes that make one vocabulary; tokens of one term bucket (about).
CHUNK_BYTES, TOKENS_PER_BUCKET = 32 << 20, 8_000_000
# Terms are runs of ASCII letters and of everything beyond ASCII.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text, A-Z in lower case."""
    return text.translate(_TERMS).split()


def _shrunk(terms: list[bytes]) -> bytes:
    return zstandard.compress(b" ".join(terms), 1)


def _expanded(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split()


class _Language:
    """The documents of one language in one chunk."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__    # a new term gets the next number
        self.sources: dict[str, int] = {}
        self.source: list[int] = []
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, source: str, text: bytes) -> None:
        found = Counter(terms_of(text))
        self.source.append(self.sources.setdefault(source, len(self.sources)))
        self.ids.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int32, len(found)))

    def row(self, lang: str) -> tuple:
        """Terms in byte order; triples by document, then term."""
        terms = sorted(self.number)
        place = np.empty(len(terms), np.int32)
        place[np.fromiter(map(self.number.__getitem__, terms), np.int32, len(terms))] = np.arange(len(terms), dtype=np.int32)
        n = np.array([len(x) for x in self.ids], np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        term, count = place[np.concatenate(self.ids)], np.concatenate(self.counts)
        order = np.lexsort((term, doc))
        doc, term, count = doc[order], term[order], count[order]
        step = np.where(np.r_[True, doc[1:] != doc[:-1]], term, np.diff(term, prepend=np.int32(0))) if len(doc) else term
        return lang, list(self.sources), _shrunk(terms), pack(np.array(self.source, np.int32), n.astype(np.int32)), pack(step.astype(np.int32), count)


CHUNKS = "lang string, sources array<string>, terms binary, docs binary, data binary"
_CHUNKS = pa.schema([("lang", pa.string()), ("sources", pa.list_(pa.string())), ("terms", pa.binary()), ("docs", pa.binary()), ("data", pa.binary())])


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, _Language] = {}
    size = 0

    def flush():
        for lang, x in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(x.row(lang), _CHUNKS)], schema=_CHUNKS)
        by.clear()

    for batch in batches:
        for lang, source, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "data"))):
            by.setdefault(lang, _Language()).add(source, data or b"")
            size += len(data or b"")
            if size >= CHUNK_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Chunk rows taken apart: (lang, sources, terms, source of each document,
    document, term and count of each triple)."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, sources, terms, docs, data = (batch.column(c)[i].as_py() for c in ("lang", "sources", "terms", "docs", "data"))
            source, n = unpack(docs)
            step, count = unpack(data)
            doc = np.repeat(np.arange(len(n)), n)
            run = np.cumsum(step, dtype=np.int64)
            begin = np.cumsum(n) - n
            # steps count from 0 in each document
            base = np.where(n > 0, np.r_[0, run][np.minimum(begin, len(run))], 0)
            yield lang, sources, _expanded(terms), source, doc, run - np.repeat(base, n), count


def _hashes(lang: str, prefixes: list[bytes]) -> np.ndarray:
    head = lang.encode("utf-8", "surrogatepass") + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(head + p) for p in prefixes), np.uint64, len(prefixes))


def _groups(terms: list[bytes], length: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct prefixes of sorted terms, and each term's prefix number."""
    cut = [t[:length] for t in terms]
    new = np.ones(len(cut), bool)
    new[1:] = np.fromiter(map(ne, cut[1:], cut), bool, max(len(cut) - 1, 0))
    return list(compress(cut, new)), np.cumsum(new) - 1


def _alive(lang: str, terms: list[bytes], length: int, seen: bloom.Filter | None) -> np.ndarray:
    """Terms whose prefix the filter of the last level knows."""
    if seen is None or not terms:
        return np.ones(len(terms), bool)
    prefixes, of = _groups(terms, length)
    return seen.has(_hashes(lang, prefixes))[of]


def _level(length: int, sent, n_blocks: int):
    """Chunks → documents per prefix of ``length`` bytes, for the terms whose
    prefix of half that length is alive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Filter(sent.value, n_blocks) if sent else None
        for lang, _, terms, _, doc, term, _ in _chunks(batches):
            alive = _alive(lang, terms, length // 2, seen)
            prefixes, of = _groups(terms, length)
            keep = alive[term]
            d, p = doc[keep], of[term[keep]]
            new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])][:len(d)]
            docs = np.bincount(p[new], minlength=len(prefixes))
            longer = np.zeros(len(prefixes), bool)
            longer[of[alive & (np.fromiter(map(len, terms), np.int64, len(terms)) > length)]] = True
            at = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array([prefixes[i] for i in at], pa.binary()), pa.array(docs[at].astype(np.int64)),
                 pa.array(longer[at])], names=["lang", "prefix", "docs", "longer"])
    return run


def _survivors(n_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            prefix = batch.column("prefix").to_pylist()
            h = np.empty(len(prefix), np.uint64)
            for x in set(lang.tolist()):
                at = np.flatnonzero(lang == x)
                h[at] = _hashes(x, [prefix[i] for i in at])
            yield bloom.seen_batch(h, h[:0], n_blocks)
    return run


def refine(chunks: DataFrame, min_documents: int = MIN_DOCUMENTS, first_level: int = FIRST_LEVEL) -> tuple[dict[int, bytes], int, int]:
    """The kept terms as a filter ``(blocks, number of blocks, length)``: level
    after level, until no surviving prefix has terms longer than itself."""
    spark = chunks.sparkSession
    sent, n_blocks, length = None, 1, first_level
    while True:
        counted = (chunks.mapInArrow(_level(length, sent, n_blocks), "lang string, prefix binary, docs long, longer boolean")
                   .groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"), F.max("longer").alias("longer"))
                   .where(F.col("docs") >= min_documents).select("lang", "prefix", "longer"))
        kept = written(counted, f"terms-{length}")
        n, more = kept.agg(F.count(F.lit(1)), F.max("longer")).first()
        n_blocks = bloom.blocks_for(n)
        blocks = bloom.collected(kept.mapInArrow(_survivors(n_blocks), bloom.SEEN), twice=False)
        if not more:
            return blocks, n_blocks, length
        sent, length = spark.sparkContext.broadcast(blocks), length * 2


PIECES = "bucket int, lang string, sources array<string>, terms binary, docs binary, data binary"
_PIECES = pa.schema([("bucket", pa.int32()), *_CHUNKS])


def _pieces(length: int, sent, n_blocks: int, n: int):
    """Chunks → term × source counts of living terms, by term bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Filter(sent.value, n_blocks)
        for lang, sources, terms, source, doc, term, count in _chunks(batches):
            alive = _alive(lang, terms, length, seen)
            docs = np.bincount(term, minlength=len(terms))
            keep = alive[term]
            key = term[keep] * len(sources) + source[doc[keep]]
            order = np.argsort(key, kind="stable")
            key, total = key[order], count[keep][order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
            total = np.add.reduceat(total, first) if len(first) else total
            t, s = key[first] // len(sources), key[first] % len(sources)
            bucket = (_hashes("", terms) % np.uint64(n)).astype(np.int64)
            rows = []
            for b, at in split(bucket[t], n):
                own, local = np.unique(t[at], return_inverse=True)
                rows.append((b, lang, sources, _shrunk([terms[i] for i in own]), pack(docs[own].astype(np.int64)),
                             pack(local.astype(np.int32), s[at].astype(np.int32), total[at])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
    return run


def _merge(min_documents: int):
    """The pieces of a (bucket, language) → one table of its kept terms, with
    exact numbers of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done():
            number: dict[bytes, int] = {}
            sources: dict[str, int] = {}
            docs, triples = [], []
            for names, blob, n, data in parts:
                ids = np.fromiter((number.setdefault(t, len(number)) for t in _expanded(blob)), np.int64)
                own = np.array([sources.setdefault(x, len(sources)) for x in names], np.int64)
                term, source, count = unpack(data)
                docs.append((ids, unpack(n)[0]))
                triples.append((ids[term], own[source], count))
            total = np.zeros(len(number), np.int64)
            for ids, n in docs:
                total[ids] += n                               # ids of one piece differ
            names = list(number)
            order = sorted(np.flatnonzero(total >= min_documents).tolist(), key=names.__getitem__)
            if not order:
                return None
            place = np.full(len(names), -1, np.int64)
            place[order] = np.arange(len(order))
            term, source, count = (np.concatenate(c) for c in zip(*triples))
            term = place[term]
            term, source, count = term[term >= 0], source[term >= 0], count[term >= 0]
            key = term * len(sources) + source
            by = np.argsort(key, kind="stable")
            key, count = key[by], count[by]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
            count = np.add.reduceat(count, first) if len(first) else count
            t, s = key[first] // len(sources), key[first] % len(sources)
            row = (*at, list(sources), _shrunk([names[i] for i in order]), pack(total[order]),
                   pack(t.astype(np.int32), s.astype(np.int32), count))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _PIECES)], schema=_PIECES)

        for batch in batches:
            for b, lang, *rest in zip(*(batch.column(f.name).to_pylist() for f in _PIECES)):
                if (b, lang) != at:
                    if parts and (table := done()):
                        yield table
                    at, parts = (b, lang), []
                parts.append(rest)
        if parts and (table := done()):
            yield table
    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per group, and kept terms per language (a null source)."""
    for batch in batches:
        rows = []
        for lang, sources, docs, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "sources", "docs", "data"))):
            _, source, count = unpack(data)
            n = np.zeros(len(sources), np.int64)
            np.add.at(n, source, count)
            rows += [(lang, x, int(k)) for x, k in zip(sources, n)] + [(lang, None, len(unpack(docs)[0]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.string(), pa.int64()))],
                                         names=["lang", "source", "n"])


def shares(count: np.ndarray, words: np.ndarray | int, kept: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / (words + kept))``, exactly."""
    if not len(count):
        return np.empty(0, np.int64)
    if int(count.max()) + 1 > (1 << 63) // SCALE - 1:          # Python's integers have no bound
        exact = count.astype(object) + 1
        return (1 + SCALE * exact // (np.asarray(words).astype(object) + kept)).astype(np.int64)
    return 1 + SCALE * (count + 1) // (words + kept)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)² / q)``: p and q stay below 2³⁰ or so, so it fits."""
    return (p - q) ** 2 // q


def pair_sums(term: np.ndarray, source: np.ndarray, count: np.ndarray, n_terms: int, words: np.ndarray, kept: int) -> np.ndarray:
    """``out[a, b]``: the distances of source a from b summed over ``n_terms``
    terms, of which the triples (by term) name the counts that are not zero."""
    n = len(words)
    zero = shares(np.zeros(n, np.int64), words, kept)
    none = distance(zero[:, None], zero[None, :])
    out = none * n_terms
    p = shares(count, words[source], kept)
    begin, end = np.searchsorted(term, np.arange(n_terms), "left"), np.searchsorted(term, np.arange(n_terms), "right")
    for a in range(n):
        mine = np.flatnonzero(source == a)
        if not len(mine):
            continue
        # all other sources as if they lacked the term, and a seen from them
        values, times = np.unique(p[mine], return_counts=True)
        out[a] += ((distance(values[:, None], zero[None, :]) - none[a]) * times[:, None]).sum(0)
        out[:, a] += ((distance(zero[:, None], values[None, :]) - none[:, a:a + 1]) * times[None, :]).sum(1)
        # the sources that do have it
        width = (end - begin)[term[mine]]
        own = np.repeat(mine, width)
        other = np.arange(len(own)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin[term[mine]], width)
        b = source[other]
        more = distance(p[own], p[other]) - distance(p[own], zero[b]) - distance(zero[a], p[other]) + none[a, b]
        np.add.at(out[a], b, more)
    np.fill_diagonal(out, 0)
    return out


def top_terms(term: np.ndarray, source: np.ndarray, count: np.ndarray, n_terms: int, words: np.ndarray, kept: int,
              all_words: int, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each source the terms (largest values, then byte order) that it has
    more of than its language, with their values."""
    whole = np.zeros(n_terms, np.int64)
    np.add.at(whole, term, count)
    q = shares(whole, all_words, kept)[term]
    p = shares(count, words[source], kept)
    value = distance(p, q)
    for a in range(len(words)):
        at = np.flatnonzero((source == a) & (p > q))
        at = at[np.lexsort((term[at], -value[at]))][:top]
        if len(at):
            yield a, term[at], value[at]


PARTIAL = "lang string, source string, part string, item string, value long"


def _audit(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                terms = [t.decode("utf-8", "surrogatepass") for t in _expanded(x["terms"])]
                names = [g["source"] for g in x["groups"]]
                number = {s: i for i, s in enumerate(names)}
                words = np.array([g["words"] for g in x["groups"]], np.int64)
                term, source, count = unpack(x["data"])
                source = np.array([number[s] for s in x["sources"]], np.int64)[source]
                term, kept = term.astype(np.int64), x["kept_terms"]
                sums = pair_sums(term, source, count, len(terms), words, kept)
                a, b = np.nonzero(~np.eye(len(names), dtype=bool))
                rows = [(names[i], "pair", names[j], v) for i, j, v in zip(a.tolist(), b.tolist(), sums[a, b].tolist())]
                for i, t, v in top_terms(term, source, count, len(terms), words, kept, int(words.sum()), top):
                    rows += [(names[i], "term", terms[k], n) for k, n in zip(t.tolist(), v.tolist())]
                if rows:
                    who, part, item, value = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["lang"]] * len(rows)), pa.array(who), pa.array(part), pa.array(item), pa.array(value, pa.int64())],
                        names=["lang", "source", "part", "item", "value"])
    return run


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS,
               first_level: int = FIRST_LEVEL) -> tuple[DataFrame, DataFrame]:
    """``(tables, groups)``: the sparse term × source tables by bucket and
    language, and ``groups(lang, source)`` of all rows."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(docs[f"`{source}`"].cast("string"), F.lit("")).alias("source"),
                       docs[f"`{text}`"].cast("binary").alias("data"))
    groups = written(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("data")).alias("bytes")), "audit-groups")
    size = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    chunks = written(rows.mapInArrow(_collect, CHUNKS), "audit-chunks")
    blocks, n_blocks, length = refine(chunks, min_documents, first_level)
    n = bucket_count(spark, size // 8, TOKENS_PER_BUCKET)
    pieces = chunks.mapInArrow(_pieces(length, spark.sparkContext.broadcast(blocks), n_blocks, n), PIECES)
    tables = (pieces.repartition("bucket", "lang").sortWithinPartitions("bucket", "lang").mapInArrow(_merge(min_documents), PIECES))
    return written(tables, "audit-tables"), groups.select("lang", "source")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS,
          top: int = TOP_TERMS, first_level: int = FIRST_LEVEL) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of ``docs``.

    Part ``pair``: the distance from every other source of the language.  Part
    ``term``: the ``top`` terms that the group has more of than its language.
    Null texts, languages and sources are the empty string.  Every row is a
    document, also a repeated one and one without an id.  Groups without terms
    have pairs; a language that keeps no term has distance 0 for all.  An
    empty table gives no rows; other columns are not read.
    """
    tables, groups = kept_terms(docs, text, lang, source, min_documents, first_level)
    totals = written(tables.mapInArrow(_totals, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n")), "audit-totals")
    words = totals.where("source is not null").withColumnRenamed("n", "words")
    kept = totals.where("source is null").select(F.col("lang").alias("k_lang"), F.col("n").alias("kept_terms"))
    listed = (groups.join(words, ["lang", "source"], "left").groupBy("lang")
              .agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("words", F.lit(0)).cast("long").alias("words")))).alias("groups")))
    listed = written(listed.join(kept, F.col("lang") == F.col("k_lang"), "left").select("lang", "groups", "kept_terms"), "audit-listed")
    # the sources of a language go to each of its buckets by a shuffle of their own
    buckets = tables.select(F.col("bucket").alias("l_bucket"), F.col("lang").alias("b_lang"))
    here = buckets.join(listed, F.col("b_lang") == F.col("lang")).select("l_bucket", F.col("lang").alias("l_lang"), "groups", "kept_terms")
    met = tables.join(here, (F.col("bucket") == F.col("l_bucket")) & (F.col("lang") == F.col("l_lang"))).where("kept_terms > 0")
    found = met.select("lang", "sources", "terms", "data", "groups", "kept_terms").mapInArrow(_audit(top), PARTIAL)
    each = listed.select("lang", F.explode("groups.source").alias("source"), F.col("groups.source").alias("others"))
    pairs = (each.select("lang", "source", F.explode("others").alias("item")).where("item <> source")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    found = written(found, "audit-found")
    sums = (found.where("part = 'pair'").unionByName(pairs).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    # the limit reaches below the shuffle: a task sends ``top`` terms of a group at most
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return sums.withColumn("rank", rank).unionByName(terms).withColumn("rank", F.col("rank").cast("int"))
