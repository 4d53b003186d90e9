"""Sharding by fixed virtual slots: ids hash into thousands of slots, and a versioned map sends slots to shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots, and how many positions one row of a run of equal rows stands for while it is spread.
SLOTS, CHUNK = 4096, 65536


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of an id: the first 32 bits of its MD5, modulo the slots; a null id goes to slot 0."""
    digest = F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(digest, F.lit(slots)), F.lit(0)).cast("int")


def plan_slots(shards: int, slots: int = SLOTS) -> list[int]:
    """The map that a shard count alone decides: one shard at first, and each further shard takes an equal part of
    every earlier shard's highest slots, into itself only."""
    owned = [list(range(slots))]
    for n in range(2, shards + 1):
        new: list[int] = []
        want = slots // n
        for k, own in enumerate(owned):
            take = min(len(own), want * (k + 1) // (n - 1) - len(new))
            new += own[len(own) - take :]
            del own[len(own) - take :]
        owned.append(sorted(new))
    out = [0] * slots
    for shard, own in enumerate(owned):
        for s in own:
            out[s] = shard
    return out


def rebalance(current: list[int], slot_bytes: dict[int, int], shards: int) -> list[int]:
    """An edited map: slots move, heaviest first that still fits, from the fullest shard to the emptiest while that
    narrows their difference. ``slot_bytes`` has one entry a slot at most."""
    out = list(current)
    load = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for s, k in enumerate(out):
        load[k] += slot_bytes.get(s, 0)
        own[k].append(s)
    for _ in range(len(out)):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        fit = [s for s in own[full] if 0 < slot_bytes.get(s, 0) < gap]
        if not fit:
            break
        s = min(fit, key=lambda s: (abs(gap - 2 * slot_bytes[s]), s))
        own[full].remove(s)
        own[empty].append(s)
        load[full] -= slot_bytes[s]
        load[empty] += slot_bytes[s]
        out[s] = empty
    return out


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """(version, virtual_slot, shard): at most SLOTS rows a version."""
    parts = []
    for version, m in versions.items():
        arr = F.array(*[F.lit(int(s)) for s in m]) if len(m) <= 64 else F.from_json(F.lit(str(list(m))), "array<int>")
        parts.append(spark.range(1).select(F.lit(version).alias("version"), F.posexplode(arr).alias("virtual_slot", "shard")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def store_map(spark: SparkSession, path: str, version: int, m: list[int]) -> None:
    """Write one version of the map under ``path``, a folder of the shared store; a version that exists is an error."""
    map_table(spark, {version: m}).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_maps(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The stored versions of the map, SLOTS entries each."""
    out: dict[int, dict[int, int]] = {}
    for r in spark.read.parquet(path).select("version", "virtual_slot", "shard").collect():
        out.setdefault(r["version"], {})[r["virtual_slot"]] = r["shard"]
    return {v: [m[s] for s in range(len(m))] for v, m in sorted(out.items())}


def store_rebalanced(spark: SparkSession, path: str, docs: DataFrame, shards: int) -> int:
    """Edit the newest stored map by the bytes that ``docs`` have in each slot and store it as the next version, whose
    number is returned."""
    maps = read_maps(spark, path)
    version, slots = max(maps), len(maps[max(maps)])
    load = {r["virtual_slot"]: r["bytes"] for r in slot_bytes(counted(docs, slots)).collect()}  # a row a slot
    store_map(spark, path, version + 1, rebalance(maps[version], load, shards))
    return version + 1


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): size is the text's UTF-8 bytes plus 1; a null text has size 1, crc 0."""
    b = F.col("text").cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(b), F.lit(0)).cast("long").alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
    )


def counted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """sized() rows, equal ones counted as ``n``."""
    return sized(docs, slots).groupBy("doc_id", "size", "text_crc32", "virtual_slot").agg(F.count(F.lit(1)).alias("n"))


def slot_bytes(counted_rows: DataFrame) -> DataFrame:
    """(virtual_slot, rows, bytes) of the slots in use."""
    return counted_rows.groupBy("virtual_slot").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))


def assign(docs: DataFrame, shards: int = 8, path: str | None = None, versions: tuple[int, int] = (1, 2)) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard under the `key` law, as opN's contract lists the columns.

    ``path`` holds a stored map (store_map()), of which ``versions`` name the one in use and the one with a shard more;
    without it the two that the shard count alone decides are taken. ``slot`` counts a shard's rows from 0 without
    gaps, in order of virtual slot and id; ``grown_shard`` is the shard under the second version. Null ids share slot
    0; null texts have size 1 and crc 0; very long texts only count their bytes. Equal rows are counted before they are
    dealt, so an id that repeats without bound stays one row until it is spread in chunks; ties do not arise, for equal
    rows are one. Columns of other names are not read. Empty input gives no rows.
    """
    spark = docs.sparkSession
    rows = counted(docs)
    stored = read_maps(spark, path) if path else {versions[0]: plan_slots(shards), versions[1]: plan_slots(shards + 1)}
    maps = map_table(spark, {1: stored[versions[0]], 2: stored[versions[1]]})
    maps = maps.groupBy("virtual_slot").agg(F.max(F.when(F.col("version") == 1, F.col("shard"))).alias("shard"), F.max(F.when(F.col("version") == 2, F.col("shard"))).alias("grown_shard"))
    used = F.broadcast(maps.join(F.broadcast(slot_bytes(rows)), "virtual_slot", "left"))  # SLOTS rows
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    used = used.withColumn("start", F.coalesce(F.sum(F.coalesce("rows", F.lit(0))).over(before), F.lit(0))).drop("rows")
    upto = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(F.broadcast(used), "virtual_slot")
    chunk = placed.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    each = chunk.withColumn("i", F.explode(F.sequence(F.col("c"), F.least(F.col("c") + CHUNK, F.col("n")) - 1)))
    return each.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("at") + F.col("i")).cast("long").alias("slot"),
        "grown_shard",
        "virtual_slot",
        F.col("bytes").alias("slot_bytes"),
        F.lit(versions[0]).alias("map_version"),
    )
