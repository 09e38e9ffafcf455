"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime
size: it starts at an offset and walks with a stride, both hashed from the
shard's name, and the prime size makes the walk meet every slot once.  Shards
take turns; on its turn a shard claims the first slot of its order that is
still free, until the table is full.  All shards own nearly as many slots, and
adding or removing a shard moves few of them.  Placement is one hash and one
look-up in the broadcast table, whose size is the parameter ``slots``.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm.common import fresh, md5_long

#: Production parameters: 16 shards; a prime of over 100 slots for each.
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
SLOTS = 2039
#: The broadcast table may have so many slots (a row is two integers).
MAX_SLOTS = 1_000_003


def _hash(value: str) -> int:
    return int(md5(value.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: tuple[str, ...], slots: int) -> list[int]:
    """The owner (index into ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names")
    if not _is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from {len(shards)} to {MAX_SLOTS}")
    place = [_hash(f"offset:{name}") % slots for name in shards]
    stride = [_hash(f"stride:{name}") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + stride[i]) % slots
        owner[place[i]] = i
    return owner


def lookup_table(spark: SparkSession, shards: tuple[str, ...], slots: int) -> DataFrame:
    """(slot, shard, shard_name), generated inside the plan from one literal."""
    owners = ",".join(map(str, fill_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    return (spark.range(1)
            .select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
            .select("slot", F.col("owner").cast("int").alias("shard"),
                    F.element_at(names, F.col("owner").cast("int") + 1).alias("shard_name")))


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All columns of ``docs`` plus ``slot``, ``shard`` and ``shard_name``
    (columns of these names in the input are replaced).

    A null key counts as the empty text, so every row is placed; equal keys
    share a shard; an empty table stays empty.  No shuffle.
    """
    spark = docs.sparkSession
    (at,) = fresh(docs, "slot_of_key")
    own = {"slot", "shard", "shard_name"}
    base = docs.select("*", F.pmod(md5_long(F.coalesce(docs[f"`{key}`"].cast("string"), F.lit(""))),
                                   F.lit(slots)).cast("int").alias(at))
    base = base.drop(*[c for c in docs.columns if c.lower() in own])
    look = lookup_table(spark, shards, slots)
    return (base.join(F.broadcast(look), base[at] == look["slot"], "inner")
            .drop(at))
