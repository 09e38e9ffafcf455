"""A modified Kneser-Ney model of word n-grams over all texts, and every text's
cost under it.

An n-gram is a word after a context, the whole word before it.  Words and
contexts are 48-bit hashes of whole lower-cased words; n-grams, words and
contexts all grow with the corpus and never leave their buckets:

1. Tasks count the n-grams of their texts, with the documents that have them;
   sorted hash arrays go to the bucket of their word.  A bucket knows every
   context of its words, hence exact counts and continuation counts.
2. A context's words lie in many buckets.  Each bucket sends its sums of a
   context to the context's own bucket, which adds them up and answers each
   sender in the order of its contexts.
3. The bucket of words, read again from the same shuffle, looks each document's
   distinct n-grams up and sends back one sum of costs per document.

Only counts of counts and the continuation counts of hot words meet as a whole.

A document does not vouch for itself: its own occurrences are taken off an
n-gram's count before it is scored.  Costs are whole hundredths of a nat, so sums are
the same in any order.  Very frequent words would make their bucket large;
words that a sample finds to hold over 1 / ``HOT_SHARE`` of all words are dealt
out by context as well, and their continuation counts are added up like the
rest.  The most frequent words of the sample have numbers, which stand for their
hashes in packed rows.  The sample decides where work is done and how rows are
packed, never a result.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import bucket_count, estimate_bytes, mix64
from placeweave.llm.packed import gaps, pack_apart as pack, split, unpack_apart as unpack

HASH_BITS = 48
#: A context keeps all bits of its word.
CONTEXT_BITS = HASH_BITS
START = b""
#: Text that makes one set of n-grams; words of one bucket (about).
CHUNK_BYTES, WORDS_PER_BUCKET = 16 << 20, 1_500_000
#: Buckets of words for each bucket of contexts.
PER_CONTEXT_BUCKET = 4
HOT_SHARE, SAMPLE = 2000, 64
#: Words of the sample that have a number in packed rows, at most.
NUMBERED = 1 << 18
#: What n-grams with a count of 1, of 2, and of 3 and more count at least; only
#: what a context's counts add up to beyond that is sent.
LEAST = np.array([1, 2, 3])
#: Costs are whole parts of a nat.
PARTS = 100
_ODD = np.uint64(0x9E3779B97F4A7C15)
GRAMS = "bucket int, chunk long, heads binary, grams binary, docs binary"
_GRAMS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("heads", pa.binary()), ("grams", pa.binary()), ("docs", pa.binary())])
PARTIAL = "bucket int, origin int, data binary"
_PARTIAL = pa.schema([("bucket", pa.int32()), ("origin", pa.int32()), ("data", pa.binary())])
REPLIES = "bucket int, part int, data binary"
_REPLIES = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
SUMS = "chunk long, kind int, data binary"
_SUMS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64) >> np.uint64(64 - HASH_BITS)


class Chunk:
    """The n-grams of some documents."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.keys: list[int] = []
        self.ids: list[np.ndarray] = []

    def add(self, key: int, data: bytes) -> None:
        words = words_of(data)
        self.keys.append(key)
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))

    def grams(self, numbered: Numbers | None = None) -> tuple[np.ndarray, ...]:
        """Sorted by word, context (both in the order of ``numbered``, without
        numbers by hash) and document: (hash, context, document, count).
        Documents are numbered from the longest: small numbers are frequent
        then, and pack well."""
        longest = sorted(range(len(self.ids)), key=lambda i: -len(self.ids[i]))
        self.keys, self.ids = [self.keys[i] for i in longest], [self.ids[i] for i in longest]
        hashes, rank = np.unique(_hashes([*self.number, START]), return_inverse=True)
        lens = np.array([len(x) for x in self.ids], np.int64)
        if numbered is not None:
            order = numbered.in_order(hashes.astype(np.int64))
            place = np.empty(len(hashes), np.int64)
            place[order] = np.arange(len(hashes))
            hashes, rank = hashes[order], place[rank]
        word = rank.astype(np.int32)[np.concatenate([*self.ids, np.empty(0, np.int32)])]
        code = np.multiply(word, len(hashes), dtype=np.int64)           # the n-gram
        word[1:] = word[:-1].copy()                      # now the contexts
        word[(np.cumsum(lens) - lens)[lens > 0]] = rank[-1]
        code += word
        del word
        grams, docs = None, max(len(lens), 1)
        if len(hashes) ** 2 * docs >= 1 << 63:           # too many for one number with the document
            grams, code = np.unique(code, return_inverse=True)
        code *= docs
        code += np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        code.sort()
        first = _starts(code)
        n = np.diff(first, append=len(code)).astype(np.int32)
        code = code[first]
        del first
        doc = (code % docs).astype(np.int32)
        code //= docs
        code = code if grams is None else grams[code]
        ctx = hashes.astype(np.int64)[code % len(hashes)]
        code //= len(hashes)
        return hashes[code], ctx, doc, n


class Numbers:
    """Numbers of frequent words, the most frequent first.  A word with a number
    takes a byte or two in a packed row, any other its whole hash; what is
    packed and unpacked is the same with any numbers, or none."""

    def __init__(self, words: np.ndarray | tuple = ()) -> None:
        self.words = np.asarray(words, np.int64)
        self.by_hash = np.argsort(self.words)
        self.sorted = self.words[self.by_hash]

    def __reduce__(self):
        return Numbers, (self.words,)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Each hash's number; a hash without one has the next."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.words) - 1)
        return np.where(self.sorted[at] == h, self.by_hash[at], len(self.words))

    def in_order(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes by number, then of those without one by hash."""
        return np.lexsort((h, self.of(h)))

    def pack(self, h: np.ndarray, *columns: np.ndarray) -> bytes:
        """Different hashes in that order, and columns that go with them."""
        number = self.of(h)
        n = int(np.searchsorted(number, len(self.words)))
        first = pack(_narrow(gaps(number[:n])), *(_narrow(c[:n]) for c in columns))
        return len(first).to_bytes(4, "little") + first + pack(gaps(h[n:]), *(_narrow(c[n:]) for c in columns))

    def unpack(self, data: bytes) -> list[np.ndarray]:
        end = 4 + int.from_bytes(data[:4], "little")
        known, rest = unpack(data[4:end]), unpack(data[end:])
        h = np.r_[self.words[np.cumsum(known[0], dtype=np.int64)], np.cumsum(rest[0])]
        return [h, *(np.r_[a.astype(np.int64), b.astype(np.int64)] for a, b in zip(known[1:], rest[1:]))]


#: Without numbers all is in order of hash.
PLAIN = Numbers()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def hash_range(h: np.ndarray, n: int) -> np.ndarray:
    """One of n equal ranges of hashes: those of a range lie close, and pack well."""
    low = np.uint64(HASH_BITS // 2)                  # in two steps, so that any n fits
    h, n = h.astype(np.uint64), np.uint64(n)
    return (((h >> low) * n + (((h & np.uint64((1 << HASH_BITS // 2) - 1)) * n) >> low)) >> low).astype(np.int64)


def bucket_of(h: np.ndarray, ctx: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """A word's bucket; that of a hot word depends on the context too."""
    word = _starts(h)
    each = np.diff(word, append=len(h))
    out = np.repeat(hash_range(h[word], n).astype(np.int32), each)
    at = np.flatnonzero(np.repeat(np.isin(h[word], hot), each))
    spread = mix64(ctx[at].astype(np.uint64) + np.uint64(1))
    out[at] = (mix64(h[at] + spread * _ODD) % np.uint64(n)).astype(np.int32)
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype(next((t for t in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(t).max), np.int64))


def packed_contexts(ctx: np.ndarray, count: np.ndarray, word: np.ndarray, numbered: Numbers) -> bytes:
    """Contexts, word after word (``word``: where each begins), as steps between
    numbers; those without one are numbered on, in a sorted list of them."""
    code = numbered.of(ctx)
    rest = code == len(numbered.words)
    names, at = np.unique(ctx[rest], return_inverse=True)
    code[rest] += at
    step = np.diff(code, prepend=0)
    step[word] = code[word]
    names = pack(gaps(names))
    return len(names).to_bytes(4, "little") + names + pack(_narrow(step), _narrow(count))


def packed(h: np.ndarray, ctx: np.ndarray, doc: np.ndarray, n: np.ndarray, with_docs: bool,
           numbered: Numbers = PLAIN) -> tuple[bytes, bytes, bytes | None]:
    """N-grams in the order of ``Chunk.grams`` as words with their numbers of
    contexts, contexts with their counts (or numbers of documents), and
    documents with their counts."""
    word, gram = _starts(h), _starts(h, ctx)
    first = np.searchsorted(gram, word)
    per_gram = np.diff(np.r_[gram, len(h)])
    count = per_gram if with_docs else np.add.reduceat(n, gram)
    heads = numbered.pack(h[word].astype(np.int64), np.diff(np.r_[first, len(gram)]))
    grams = packed_contexts(ctx[gram], count, first, numbered)
    if not with_docs:
        return heads, grams, None
    step = np.diff(doc, prepend=0)                   # documents as gaps within their n-gram
    step[gram] = doc[gram]
    return heads, grams, pack(_narrow(step), _narrow(n))


def unpacked(heads: bytes, grams: bytes, numbered: Numbers = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, per_word = numbered.unpack(heads)
    end = 4 + int.from_bytes(grams[:4], "little")
    names = np.cumsum(unpack(grams[4:end])[0])
    step, count = unpack(grams[end:])
    run = np.cumsum(step, dtype=np.int64)
    code = run - np.repeat(np.r_[0, run][np.cumsum(per_word) - per_word], per_word)
    known = code < len(numbered.words)
    ctx = np.empty(len(code), np.int64)
    ctx[known], ctx[~known] = numbered.words[code[known]], names[code[~known] - len(numbered.words)]
    return np.repeat(h.astype(np.uint64), per_word), ctx, count.astype(np.int64)


def documents_of(docs: bytes, n_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of n-grams with ``n_docs`` documents each."""
    step, n = unpack(docs)
    run = np.cumsum(step, dtype=np.int64)
    begin = np.cumsum(n_docs) - n_docs
    return run - np.repeat(np.r_[0, run][begin], n_docs), n.astype(np.int64)


def _count(hot: np.ndarray, n: int, with_docs: bool, numbered: Numbers = PLAIN):
    """Texts → n-grams by bucket; with documents also each chunk's row keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, size, chunk = TaskContext.get().partitionId() << 32, 0, 0, Chunk()

        def flush():
            name = first + seq
            h, ctx, doc, times = chunk.grams(numbered)
            rows = []
            for b, at in split(bucket_of(h, ctx, hot, n), n):
                rows.append((b, name, *packed(h[at], ctx[at], doc[at], times[at], with_docs, numbered)))
            if with_docs:
                keys, lens = np.array(chunk.keys, np.int64), np.array([len(x) for x in chunk.ids], np.int64)
                rows.append((name % n, name, None, None, pack(keys, lens)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, _GRAMS)], schema=_GRAMS)

        for batch in batches:
            for key, data in zip(batch.column("row_key"), batch.column("data")):
                key, data = key.as_py(), data.as_py()
                chunk.add(key, data or b"")
                size += len(data or b"") + 64
                if size >= CHUNK_BYTES:
                    yield flush()
                    seq, size, chunk = seq + 1, 0, Chunk()
        if chunk.keys:
            yield flush()
    return run


class Bucket:
    """All n-grams of a bucket: sorted arrays of word hash and context with
    their counts, and how many contexts each word has."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        h, ctx, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ctx, h))
        h, ctx, n = h[order], ctx[order], n[order]
        first = _starts(h, ctx)
        self.h, self.ctx, self.count = h[first], ctx[first], np.add.reduceat(n, first)
        # the row of each part's n-grams in the arrays
        where = np.empty(len(h), np.int64)
        where[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
        self.where = np.split(where, np.cumsum([len(p[0]) for p in parts])[:-1])
        word = _starts(self.h)
        self.types = np.diff(np.r_[word, len(self.h)])
        self.word, self.word_of = self.h[word], np.repeat(np.arange(len(word)), self.types)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts, sorted, and what their n-grams here add up to: counts,
        and n-grams with a count of 1, of 2, and of 3 and more."""
        known, at = np.unique(self.ctx, return_inverse=True)
        sums = np.zeros((len(known), 4), np.int64)
        np.add.at(sums[:, 0], at, self.count)
        np.add.at(sums, (at, np.minimum(self.count, 3)), 1)
        return known, sums


def _part(row: dict, numbered: Numbers = PLAIN) -> tuple[np.ndarray, ...]:
    """A row's n-grams: (hash, context, count), and with documents the
    document, the count and the n-gram of each entry."""
    h, ctx, count = unpacked(row["heads"], row["grams"], numbered)
    if row["docs"] is None:
        return h, ctx, count
    doc, n = documents_of(row["docs"], count)
    return h, ctx, np.add.reduceat(n, np.cumsum(count) - count), doc, n, np.repeat(np.arange(len(h), dtype=np.int32), count)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["bucket"] != row["bucket"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


STATISTICS = "kind string, key long, a long, b long, c long, d long"


def _statistics(hot: np.ndarray, contexts: bool = True, numbered: Numbers = PLAIN):
    """Counts of counts and continuation counts; ``contexts`` adds a row for
    each context of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, types, size = np.zeros(5, np.int64), np.zeros(5, np.int64), np.zeros(2, np.int64)
        spread, names = np.zeros(len(hot), np.int64), [c.split()[0] for c in STATISTICS.split(", ")]
        for rows in _buckets(batches):
            parts = [_part(r, numbered)[:3] for r in rows if r["heads"] is not None]
            if not parts:
                continue
            b = Bucket(parts)
            counts += np.bincount(np.minimum(b.count, 5), minlength=6)[1:]
            at = np.searchsorted(hot, b.word)
            is_hot = hot[np.minimum(at, len(hot) - 1)] == b.word if len(hot) else np.zeros(len(b.word), bool)
            spread[at[is_hot]] += b.types[is_hot]
            types += np.bincount(np.minimum(b.types[~is_hot], 5), minlength=6)[1:]
            size += [len(b.h), int((~is_hot).sum())]
            if contexts:
                known, sums = b.contexts()
                yield pa.RecordBatch.from_arrays([pa.array(["context"] * len(known), pa.string()), pa.array(known),
                                                  *(pa.array(sums[:, k]) for k in range(4))], names=names)
        out = [("counts", 0, *counts[:4]), ("types", 0, *types[:4]), ("size", 0, *size, 0, 0)]
        out += [("hot", i, int(x), 0, 0, 0) for i, x in enumerate(spread)]
        cols = [pa.array([x[i] for x in out]) if i == 0 else pa.array([int(x[i]) for x in out], pa.int64()) for i in range(6)]
        yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _partial(n: int, numbered: Numbers):
    """A bucket's sums of its contexts → the contexts' own buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            parts = [_part(r, numbered)[:3] for r in rows if r["heads"] is not None]
            if not parts:
                continue
            known, sums = Bucket(parts).contexts()
            order = numbered.in_order(known)
            known, sums = known[order], sums[order]
            sums[:, 0] -= sums[:, 1:] @ LEAST
            out = [(to, rows[0]["bucket"], numbered.pack(known[at], *sums[at].T)) for to, at in split(hash_range(known, n), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PARTIAL)], schema=_PARTIAL)
    return run


def _replies(numbered: Numbers):
    """What the contexts of a bucket add up to, for each sender in its order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            parts = [numbered.unpack(r["data"]) for r in rows]
            lens = np.array([len(p[0]) for p in parts])
            known, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.zeros((len(known), 4), np.int64)
            for k in range(4):
                np.add.at(sums[:, k], at, np.concatenate([p[k + 1] for p in parts]))
            out = [(r["origin"], r["bucket"], pack(*(_narrow(sums[mine, k]) for k in range(4))))
                   for r, mine in zip(rows, np.split(at, np.cumsum(lens)[:-1]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPLIES)], schema=_REPLIES)
    return run


def discounts(ones: list[int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams
    with count 1 to 4 (at index 1 to 3; a count of 0 has none)."""
    y = ones[0] / max(ones[0] + 2 * ones[1], 1)
    cut = [i + 1 - (i + 2) * y * ones[i + 1] / ones[i] if ones[i] else 0.5 * (i + 1) for i in range(3)]
    return np.array([0.0] + [min(max(c, 0.05), i + 0.95) for i, c in enumerate(cut)])


class Model:
    """What is known of the whole corpus, and of the contexts of a bucket."""

    def __init__(self, rows: dict[tuple[str, int], tuple[int, int, int, int]], hot: np.ndarray) -> None:
        self.hot = hot
        self.hot_types = np.array([rows.get(("hot", i), (0,))[0] for i in range(len(hot))], np.int64)
        grams, words = rows.get(("size", 0), (0, 0, 0, 0))[:2]
        found = self.hot_types[self.hot_types > 0]
        ones = [x + int((found == i).sum()) for i, x in enumerate(rows.get(("types", 0), (0,) * 4), 1)]
        self.grams, self.words = grams, words + len(found)
        self.cut, self.low_cut = discounts(list(rows.get(("counts", 0), (0,) * 4))), discounts(ones)
        less = self.low_cut[1] * ones[0] + self.low_cut[2] * ones[1] + self.low_cut[3] * (self.words - ones[0] - ones[1])
        # the lowest order: one word more than are known has an equal share
        self.base = less / max(grams, 1) / (self.words + 1) if grams else 1.0
        known = sorted(key for kind, key in rows if kind == "context")
        self.know(np.array(known, np.int64), np.array([rows[("context", k)] for k in known], np.int64).reshape(-1, 4))

    def know(self, ctx: np.ndarray, sums: np.ndarray) -> None:
        """Sorted contexts with what they add up to."""
        # a context that was never seen leaves everything to the words alone
        self.ctx = np.r_[ctx, np.int64(1) << 62]
        self.total = np.r_[sums[:, 0].astype(np.float64), 1.0]
        self.back = np.r_[sums[:, 1:] @ self.cut[1:] / self.total[:-1], 1.0]

    def word_probability(self, types: np.ndarray) -> np.ndarray:
        """Of a word that follows ``types`` different contexts."""
        return (types - self.low_cut[np.minimum(types, 3)]) / max(self.grams, 1) + self.base

    def probability(self, count: np.ndarray, ctx: np.ndarray, types: np.ndarray) -> np.ndarray:
        """Of a word after a context, from the n-gram's count."""
        at = np.searchsorted(self.ctx, ctx)
        at = np.where(self.ctx[at] == ctx, at, len(self.ctx) - 1)
        return (count - self.cut[np.minimum(count, 3)]) / self.total[at] + self.back[at] * self.word_probability(types)


def _costs(hot: np.ndarray, n: int, numbered: Numbers):
    """A bucket's n-grams with their documents, and what is known of its
    contexts → costs per document, chunk by chunk."""
    def run(grams: pa.Table, known: pa.Table) -> pa.Table:
        rows, said = grams.to_pylist(), {r["part"]: r["data"] for r in known.to_pylist()}
        out = [(r["chunk"], 1, r["docs"]) for r in rows if r["heads"] is None]
        rows = [r for r in rows if r["heads"] is not None]
        parts = [_part(r, numbered) for r in rows]
        if parts:
            b = Bucket([p[:3] for p in parts])
            model = Model({(r["kind"], r["key"]): (r["a"], r["b"], r["c"], r["d"]) for r in json.loads(said[-1])}, hot)
            ctx, sums = b.contexts()
            order = numbered.in_order(ctx)
            for c, at in split(hash_range(ctx[order], n), n):
                sums[order[at]] = np.stack(unpack(said[c]), axis=1)
            sums[:, 0] += sums[:, 1:] @ LEAST
            model.know(ctx, sums)
            types = b.types.copy()
            at = np.searchsorted(model.hot, b.word)
            if len(model.hot):
                is_hot = model.hot[np.minimum(at, len(model.hot) - 1)] == b.word
                types[is_hot] = model.hot_types[at[is_hot]]
            for r, where, (_, ctx, _, doc, n_here, gram) in zip(rows, b.where, parts):
                row = where[gram]
                p = model.probability(b.count[row] - n_here, ctx[gram], types[b.word_of[row]])
                cost = np.rint(-np.log(p) * PARTS).astype(np.int64) * n_here
                of_docs = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(of_docs, doc, cost)
                found = np.flatnonzero(of_docs)
                out.append((r["chunk"], 0, pack(gaps(found).astype(np.int32), of_docs[found])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 3, _SUMS)], schema=_SUMS)
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's row keys, then its sums → cost and words of each row."""
    at, keys, words, sums = None, None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(words), pa.array(sums)], names=["row_key", "words", "cost"])

    for batch in batches:
        for chunk, kind, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "data"))):
            if kind == 1:
                if at is not None:
                    yield done()
                at, (keys, words) = chunk, unpack(data)
                sums = np.zeros(len(keys), np.int64)
            else:
                doc, cost = unpack(data)
                sums[np.cumsum(doc)] += cost
    if at is not None:
        yield done()


def hot_words(rows: DataFrame) -> np.ndarray:
    """Hashes of the words that hold over 1 / HOT_SHARE of a sample's words:
    ``HOT_SHARE`` at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for data in batch.column("data").to_pylist():
                found.update(words_of(data or b""))
        total = sum(found.values())
        often = [(w, n) for w, n in found.items() if n * 2 * HOT_SHARE >= total]     # a word over the bound is so in some task
        h = _hashes([w for w, _ in often]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[h, 0]), pa.array([*(n for _, n in often), total], pa.int64()),
                                          pa.array([False] * len(often) + [True])], names=["h", "n", "whole"])

    sample = rows.where(F.pmod("row_key", F.lit(SAMPLE)) == 0).select("data").mapInArrow(run, "h long, n long, whole boolean")
    added = sample.groupBy("whole", "h").agg(F.sum("n").alias("n"))
    found = added.toArrow().to_pylist()
    total = sum(r["n"] for r in found if r["whole"])
    return np.sort(np.array([r["h"] for r in found if not r["whole"] and r["n"] * HOT_SHARE >= total], np.int64).view(np.uint64))


def frequent_words(rows: DataFrame) -> Numbers:
    """Numbers for the most frequent words of the sample, ``NUMBERED`` at most.
    They decide how rows are packed, never a result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for data in batch.column("data").to_pylist():
                found.update(words_of(data or b""))
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(found).view(np.int64)), pa.array(found.values(), pa.int64())], names=["h", "n"])

    sample = rows.where(F.pmod("row_key", F.lit(SAMPLE)) == 0).select("data").mapInArrow(run, "h long, n long")
    top = sample.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(NUMBERED).select("h").toArrow()
    return Numbers(top.column("h").to_numpy())


def costs(rows: DataFrame) -> DataFrame:
    """``(row_key, words, cost)`` of every row of ``rows(row_key, data)``:
    the hundredths of a nat that its words cost under the model of all rows.  Rows that
    are alike have the same cost; a row without words costs nothing."""
    spark = rows.sparkSession
    hot, numbered = hot_words(rows), frequent_words(rows)
    n = bucket_count(spark, estimate_bytes(rows, "data") // 6, WORDS_PER_BUCKET, each=2)
    n_ctx = -(-n // PER_CONTEXT_BUCKET)
    # one shuffle, read by all three branches
    grams = rows.mapInArrow(_count(hot, n, True, numbered), GRAMS).repartition("bucket")
    in_order = grams.sortWithinPartitions("bucket")
    added = (in_order.mapInArrow(_statistics(hot, False, numbered), STATISTICS).groupBy("kind", "key")
             .agg(*[F.sum(c).alias(c) for c in "abcd"]))
    whole = added.agg(F.to_json(F.collect_list(F.struct("kind", "key", *"abcd"))).cast("binary").alias("data"))
    model = spark.range(n).select(F.col("id").cast("int").alias("bucket"), F.lit(-1).alias("part")).crossJoin(F.broadcast(whole))
    partial = in_order.mapInArrow(_partial(n_ctx, numbered), PARTIAL).repartition("bucket").sortWithinPartitions("bucket")
    known = model.unionByName(partial.mapInArrow(_replies(numbered), REPLIES))
    sums = (grams.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_costs(hot, n_ctx, numbered), SUMS)
            .repartition("chunk").sortWithinPartitions("chunk", F.col("kind").desc()))
    return sums.mapInArrow(_add_up, "row_key long, words long, cost long")
