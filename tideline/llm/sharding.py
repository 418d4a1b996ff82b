"""Documents to shards by a lookup table that the shards fill in turns.

Every shard has a preference order over the slots of a table of prime size: it starts at an offset
and goes on by a skip, both hashed from its name, and so visits every slot once. The shards take
turns; the one whose turn it is claims the first slot of its order that is still free. All shards
end up with equally many slots, give or take one, and when a shard is added or removed most slots
keep their shard. A document's key is hashed to a slot; the table, whose size is a parameter and
has nothing to do with the data, is broadcast.

The turns are an SQL aggregate over at most shards * slots probes in a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm.hashing import number, row_key

MAX_PROBES = 1 << 24


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """``slot``, ``shard``: who owns each of the ``slots`` slots.

    ``slots`` must be prime and above the number of shards; a hundred times as many keep the shards'
    sizes within about one percent. At most 2^24 probes (shards * slots) are allowed.
    """
    names = list(shards)
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names, and at least one")
    if not _is_prime(slots) or slots <= len(names):
        raise ValueError("slots must be a prime above the number of shards")
    if len(names) * slots > MAX_PROBES:
        raise ValueError(f"{len(names)} shards times {slots} slots are more than {MAX_PROBES} probes")
    orders = spark.range(1).select(F.array(*map(F.lit, names)).alias("names")).select(
        "names",
        F.transform("names", lambda n: (number(F.lit("offset"), n) % slots).cast("int")).alias("offsets"),
        F.transform("names", lambda n: (number(F.lit("skip"), n) % (slots - 1) + 1).cast("int")).alias("skips"),
    )
    n = len(names)
    # turn: claims so far. seen: probes of each shard. taken: a byte per slot. claims: slots in turn order.
    start = f"named_struct('turn', 0, 'seen', array_repeat(0, {n}), 'taken', unhex(repeat('00', {slots})), 'claims', sequence(0, 0))"
    slot = f"cast((offsets[s.turn % {n}] + cast(s.seen[s.turn % {n}] as bigint) * skips[s.turn % {n}]) % {slots} as int)"
    step = f"""transform(array({slot}), a -> transform(array(substring(s.taken, a + 1, 1) = x'00'), free -> named_struct(
        'turn', s.turn + if(free, 1, 0),
        'seen', transform(s.seen, (v, i) -> if(i = s.turn % {n}, v + 1, v)),
        'taken', if(free, overlay(s.taken, x'01', a + 1, 1), s.taken),
        'claims', if(free, concat(s.claims, array(a)), s.claims))))[0][0]"""
    claims = f"aggregate(sequence(1, {n * slots}), {start}, (s, x) -> if(s.turn = {slots}, s, {step}), s -> slice(s.claims, 2, {slots}))"
    return orders.select("names", F.posexplode(F.expr(claims)).alias("turn", "slot")).select(
        "slot", F.element_at("names", (F.col("turn") % n + 1).cast("int")).alias("shard")
    )


def assign(df: DataFrame, table: DataFrame, slots: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``slot`` and ``shard``.

    Rows with equal keys share a shard. A row without a key goes by its text, so that many of them
    do not meet in one shard; without either it goes by the empty text.
    """
    kept = df.drop("slot", "shard")
    placed = kept.withColumn("slot", (number(row_key(key, text)) % slots).cast("int"))
    return placed.join(F.broadcast(table), "slot").select(*kept.columns, "slot", "shard")


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write one folder per shard; a shard's rows come from many tasks, none gathers a shard."""
    df.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
