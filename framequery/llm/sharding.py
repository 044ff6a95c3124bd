"""Shards by jump consistent hashing: no ring table, and a new shard takes only what is its own.

A row's key is a 64-bit number made of its id's text. The key seeds a linear congruential
generator whose draws say at which shard count the row jumps next; the last jump below the
number of shards is its shard (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash
Algorithm"). So the shard depends on id and count alone, and of n + 1 shards only the last one
takes rows, 1 / (n + 1) of each other's. Everything is Spark expressions: the generator's
product modulo 2^64 is kept in three limbs of 22, 22 and 20 bits, whose partial products never
overflow, so ANSI mode holds.

Slots number a shard's rows from 0 without a gap and without one task per shard: rows are
range-partitioned by shard and key and numbered by ``ordered.numbered``; equal rows of one id,
however many, are told apart by a row number, so that a hot id is split too.

Defined cases: null text is empty; a null id is hashed as the text ``null``; rows that repeat an
id share its shard and lie in slots by id, size and checksum; rows equal in all three take
neighbouring slots in any order, which no output column shows; an empty table gives no rows; one
shard takes everything; other columns pass through ``assign``, whose own columns take a suffix
where a name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import let
from ..operators import ordered
from ..plans.runtime import cut, free_name

# Fixed value: the multiplier of the public algorithm's generator.
MULTIPLIER = 2862933555777941757

_LIMB, _TOP = (1 << 22) - 1, (1 << 20) - 1
#: Draws of the first fold. A row that has not come to its shard by then goes through the whole fold, which no key outlasts.
SHORT = 16


def key_of(doc_id: Column) -> Column:
    """The 64-bit key of an id, as 16 hex digits of its text's MD5."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 16)


def _long(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _draw(s: Column) -> list[Column]:
    """The limbs of key * MULTIPLIER + 1 modulo 2^64, lowest first."""
    c = [MULTIPLIER & _LIMB, MULTIPLIER >> 22 & _LIMB, MULTIPLIER >> 44]
    low = s["k0"] * c[0] + 1
    middle = s["k0"] * c[1] + s["k1"] * c[0] + F.shiftright(low, 22)
    top = s["k0"] * c[2] + s["k1"] * c[1] + s["k2"] * c[0] + F.shiftright(middle, 22)
    return [low.bitwiseAND(F.lit(_LIMB)), middle.bitwiseAND(F.lit(_LIMB)), top.bitwiseAND(F.lit(_TOP))]


def jump(key: Column, shards: int) -> Column:
    """Shard, from 0, of a key of 16 hex digits. Expected work: the logarithm of ``shards``, in any case at most ``shards`` draws."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def step(s: Column) -> Column:
        def moved(k: Column) -> Column:
            drawn = F.shiftleft(k["k2"], 11) + F.shiftright(k["k1"], 11)  # the upper 31 bits
            at = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (drawn + 1).cast("double")))
            return F.struct(s["next"].alias("shard"), at.alias("next"), k["k0"].alias("k0"), k["k1"].alias("k1"), k["k2"].alias("k2"))

        k0, k1, k2 = _draw(s)
        return F.when(s["next"] >= shards, s).otherwise(let(F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2")), moved))

    fold = lambda start, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda s, _: step(s))
    high, low = _long(F.substring(key, 1, 8)), _long(F.substring(key, 9, 8))  # 32 bits each
    start = F.struct(
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
        low.bitwiseAND(F.lit(_LIMB)).alias("k0"),
        (F.shiftright(low, 22) + F.shiftleft(high.bitwiseAND(F.lit(0xFFF)), 10)).alias("k1"),
        F.shiftright(high, 12).alias("k2"),
    )
    if shards <= SHORT:
        return fold(start, shards)["shard"].cast("int")
    done = let(fold(start, SHORT), lambda s: F.when(s["next"] >= shards, s["shard"]).otherwise(fold(s, shards)["shard"]))
    return done.cast("int")


def assign(docs: DataFrame, shards: int, doc_id: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``docs`` with the ``shard`` of each row: a projection, nothing moves."""
    return docs.withColumn(free_name(shard, docs.columns), jump(key_of(F.col(doc_id)), shards))


def place(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (with one shard more) of each row; texts are read once and not moved."""
    key, of_text = key_of(F.col(doc_id)), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(of_text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(of_text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
        jump(key, shards).alias("shard"),
        jump(key, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col(c) for c in ("key", "doc_id", "size", "text_crc32", "row")]
    return ordered.numbered(cut(rows), ["shard"], order, "slot").drop("key", "row")


def write_shards(docs: DataFrame, path: str, shards: int, doc_id: str = "doc_id", files: int = 1) -> None:
    """``docs`` as Parquet under ``path``, one folder a shard, of ``files`` files or fewer each.

    A shard's rows are dealt over its files by their key, so a shard of any size is as many tasks' work as it has
    files; only rows of one id can't be dealt apart.
    """
    names = [free_name(c, docs.columns) for c in ("shard", "_file")]
    dealt = docs.withColumns({names[0]: jump(key_of(F.col(doc_id)), shards), names[1]: F.pmod(F.xxhash64(F.col(doc_id)), F.lit(files))})
    dealt.repartition(shards * files, *names).drop(names[1]).write.partitionBy(names[0]).parquet(path)
