"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of virtual slots (thousands),
which never changes. A versioned table says which shard each slot belongs to;
rebalancing writes a new version that moves a few slots, so that no record is
ever hashed anew. A slot that holds far more bytes than the mean (repeated or
null ids) is divided into pieces, which the map treats like slots. Per-record
work is a projection; what the rebalancing sees is one row a piece, however
large the corpus is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

SLOTS = 4096
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: A slot is divided from so many times the mean bytes of all slots.
HEAVY = 4


def with_slots(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (bytes) and ``virtual_slot``, from the key alone; rows without a key go by their text."""
    hashed = F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key)))
    return docs.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD,
        "virtual_slot": F.pmod(hashed, F.lit(slots)).cast("int"),
    })


def pieces(weights: dict[int, int], slots: int, heavy: int = HEAVY) -> dict[int, int]:
    """Into how many pieces each heavy slot is divided: as many as mean slots fit into it, ``slots`` more in all at most."""
    total = sum(weights.values())
    return {slot: w * slots // total for slot, w in weights.items() if w * slots > heavy * total}


def piece_totals(placed: DataFrame) -> DataFrame:
    """Bytes and rows of each piece of a slot that has any."""
    return placed.groupBy("virtual_slot", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def even_map(slots: int, shards: int) -> list[int]:
    """Version 1: the slots dealt out in equal runs."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(owner: list[int], weight: list[int], shards: int) -> list[int]:
    """The next version: moves, then swaps, between the fullest and the emptiest shard until neither narrows their gap.

    Each edit brings the two closer, so that edits end; their number depends on
    the number of slots alone.
    """
    owner = list(owner)
    held: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(owner):
        if weight[slot]:
            held[shard].add(slot)
            load[shard] += weight[slot]

    def move(slot: int, to: int) -> None:
        frm = owner[slot]
        held[frm].discard(slot)
        held[to].add(slot)
        load[frm] -= weight[slot]
        load[to] += weight[slot]
        owner[slot] = to

    while True:
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if gap < 2:
            break
        best = min(((abs(2 * weight[s] - gap), s, -1) for s in held[high] if weight[s] < gap), default=None)
        if best is None or best[0] > gap // 8:
            light = sorted((weight[s], s) for s in held[low])
            for a in held[high]:
                # the partner whose weight is nearest to what makes both shards equal
                want = weight[a] - gap / 2
                lo, hi = 0, len(light)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if light[mid][0] < want else (lo, mid)
                for w, b in light[max(0, lo - 1) : lo + 1]:
                    if 0 < weight[a] - w < gap:
                        found = (abs(2 * (weight[a] - w) - gap), a, b)
                        best = found if best is None else min(best, found)
        if best is None:
            break
        _, a, b = best
        move(a, low)
        if b >= 0:
            move(b, high)
    return owner


MAP_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("virtual_slot", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("map_shard", T.IntegerType()),
    T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("first_position", T.LongType()),
])


def map_rows(version: int, owner: list[int], names: list[tuple[int, int]], totals: dict[tuple[int, int], tuple[int, int]], shards: int) -> list[tuple]:
    """Rows of the map; ``first_position``: rows that the shard holds in its earlier pieces."""
    before, rows = [0] * shards, []
    for name, shard in zip(names, owner):
        size, n = totals.get(name, (0, 0))
        rows.append((version, *name, shard, size, n, before[shard]))
        before[shard] += n
    return rows


def write_map(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return stored(spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1), "slot-map")


def balanced_shards(docs: DataFrame, shards: int, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` without text, with ``shard`` and ``slot`` (their place in the shard, gapless from 0), and the versioned map.

    The law is ``bytes``: shards get nearly equal numbers of bytes, as near as
    single rows and the slots allow. Version 1 of the map deals slots out
    evenly, version 2 is that map after rebalancing; both are stored. Null
    texts have no bytes. Rows of the same key share a slot, rows with a null
    key are spread by their text; a slot that grows heavy by such rows is
    divided, row by row, so that repeated and null keys are spread too. An
    empty table gives no rows; more shards than rows leaves shards empty.
    Columns of ``docs`` named as an added one are replaced.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    # One scan of the texts: everything later reads this narrow table, in which each row has its number.
    slotted = stored(with_slots(docs, slots, key, text).withColumn("text_crc32", crc).drop(text).withColumn("__row", F.monotonically_increasing_id()), "slotted")
    weights = {r["virtual_slot"]: r["bytes"] for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    divided = pieces(weights, slots)
    if divided:
        # at most ``slots / HEAVY`` rows
        parts = F.broadcast(spark.createDataFrame(list(divided.items()), "virtual_slot int, parts int"))
        numbered = slotted.join(parts, "virtual_slot", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    else:
        numbered = slotted.withColumn("piece", F.lit(0))
    totals = {(r["virtual_slot"], r["piece"]): (r["bytes"], r["rows"]) for r in piece_totals(numbered).collect()}
    names = [(s, p) for s in range(slots) for p in range(divided.get(s, 1))]
    start = even_map(slots, shards)
    first = [start[s] for s, _ in names]
    second = rebalanced(first, [totals.get(n, (0, 0))[0] for n in names], shards)
    table = write_map(spark, map_rows(1, first, names, totals, shards) + map_rows(2, second, names, totals, shards))
    # one row a piece, 2 * ``slots`` at most
    current = F.broadcast(table.filter("version = 2").select("virtual_slot", "piece", "map_shard", "first_position"))
    within = Window.partitionBy("virtual_slot", "piece").orderBy(F.col(key).asc_nulls_last(), "text_crc32", "size", "__row")
    placed = (
        numbered.withColumn("place", F.row_number().over(within))
        .join(current, ["virtual_slot", "piece"])
        .withColumns({"shard": F.col("map_shard"), "slot": F.col("first_position") + F.col("place") - 1})
        .drop("map_shard", "first_position", "place", "__row")
    )
    return placed, table


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and virtual_slot of every document."""
    placed, _ = balanced_shards(docs.select("doc_id", "text"), shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
