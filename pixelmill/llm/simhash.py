"""SimHash near-duplicates found through tables of Hamming distances to reference fingerprints (pivots); with a
similarity, also documents whose sets of shingles are that similar, found through MinHash bands and verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util as U

SHINGLE, SEED, RADIUS, HEX = 3, 42, 2, 16
#: Pivots: the zero fingerprint, one for each block of two neighbouring bits, and some at random.
BLOCKS, BANDS, RANDOM_PIVOTS = 32, 6, 24
#: For a similarity: words of a shingle, bands of MinHash values and values of a band (a pair at 0.8 shares no band with
#: probability 3e-6), members up to which a band's pairs are listed, members of a larger band that all others of it are
#: compared with, and bits of the mask that thins out texts.
WORDS, MIN_BANDS, MIN_ROWS, LISTED, HUBS, MASK = 5, 24, 4, 16, 4, 2**22 - 1
BUCKET = 128  # larger buckets of distinct fingerprints go the exact way of linked_through_neighbours()
PIVOTS = np.concatenate(
    [
        np.zeros(1, np.uint64),
        np.uint64(3) << (2 * np.arange(BLOCKS, dtype=np.uint64)),
        np.random.default_rng(SEED).integers(0, 2**64, RANDOM_PIVOTS, dtype=np.uint64),
    ]
)
_FACTOR, _SHIFT = np.random.default_rng(SEED + 1).integers(0, 2**64, (2, MIN_BANDS * MIN_ROWS, 1), dtype=np.uint64) | np.uint64(1)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes (uint64) of the whole text's word shingles, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: 1 - width]
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(start.tolist(), end[width - 1 :].tolist(), strict=True)], np.uint64, len(start))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the whole text's word shingles, repeats included; zero for a null text or one without words."""
    hashes = shingle_hashes(text, SHINGLE)
    n = len(hashes)
    by = hashes.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(by[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


def distances(fp: np.ndarray) -> np.ndarray:
    """Hamming distances (n x pivots, int8) of fingerprints (uint64) to the pivots."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _keys(table: np.ndarray) -> np.ndarray:
    """Bucket keys (n x 15). d(x, 0) and d(x, block) give the number of bits that x has in a block; two fingerprints
    within two bits differ in at most two of the six bands of blocks, so some choice of four bands agrees wholly."""
    ones = (table[:, :1] + 2 - table[:, 1 : 1 + BLOCKS]) // 2
    bands = [ones[:, b].astype(np.int64) @ (3 ** np.arange(len(b))) for b in np.array_split(np.arange(BLOCKS), BANDS)]
    out = []
    for i, used in enumerate(combinations(range(BANDS), BANDS - RADIUS)):
        key = np.zeros(len(table), np.int64)
        for b in used:
            key = key * 3**6 + bands[b]
        out.append(key * 15 + i)
    return np.stack(out, axis=1)


def close_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i, j of distinct fingerprints within RADIUS: pairs whose largest coordinate difference in the pivot
    table is over RADIUS are discarded, one coordinate after another, and survivors are verified."""
    table = distances(fp)
    order = np.argsort(table[:, 1 + BLOCKS], kind="stable")
    first = table[order, 1 + BLOCKS]
    upto = np.searchsorted(first, first + RADIUS, side="right")
    after = upto - np.arange(len(fp)) - 1
    i = np.repeat(np.arange(len(fp)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    i, j = order[i], order[j]
    for p in range(table.shape[1] - 1, -1, -1):
        keep = np.abs(table[i, p] - table[j, p]) <= RADIUS
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """At most n - 1 of the pairs that join what all of them join."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            out.append((a, b))
    return out


def linked_through_neighbours(fps: DataFrame) -> DataFrame:
    """Exact links of fingerprints that crowd in a bucket, in linear size: fingerprints within two bits share a
    neighbour at one bit or less, and all that share one are within two bits, so each links to the smallest of them."""
    near = F.array(F.lit(0).cast("long"), *[F.lit(b if b < 2**63 else b - 2**64).cast("long") for b in (1 << i for i in range(64))])
    at = fps.select("fp", F.explode(near).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("at"))
    low = U.checkpoint(at.groupBy("at").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u <> top").select("at", "u"))
    return at.join(low, "at").where("fp <> u").select("u", F.col("fp").alias("v"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (distinct ``fp``) that chains of links connect."""

    def keyed(batches):
        for pdf in batches:
            fp = pdf.fp.to_numpy(dtype=np.int64)
            yield pd.DataFrame({"key": _keys(distances(fp.view(np.uint64))).ravel(), "fp": np.repeat(fp, 15)})

    keys = U.checkpoint(fps.select("fp").mapInPandas(keyed, "key long, fp long"))
    shared = U.checkpoint(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowd = keys.join(shared, "key")

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def pairs(lists: pd.Series) -> pd.Series:
        out = []
        for x in lists:
            fp = np.asarray(x, dtype=np.int64)
            out.append([{"u": int(fp[a]), "v": int(fp[b])} for a, b in _forest(len(fp), *close_pairs(fp.view(np.uint64)))])
        return pd.Series(out, dtype=object)

    small = crowd.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    found = small.select(F.explode(pairs("fps")).alias("e")).select("e.u", "e.v")
    large = crowd.where(F.col("n") > BUCKET).select("fp").distinct()
    return found.union(linked_through_neighbours(U.checkpoint(large)))


def text_key(text: str) -> int:
    """Signed 64-bit key of a text as it stands."""
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), SEED)
    return x - 2**64 if x >= 2**63 else x


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key (signed 64 bits) for each band of MinHash values of a set of shingles, none for an empty one."""
    if not len(shingles):
        return []
    least = np.full(MIN_BANDS * MIN_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[None, at : at + 4096]
        least = np.minimum(least, ((x ^ (x >> np.uint64(29))) * _FACTOR + _SHIFT).min(axis=1))
    got = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(MIN_BANDS, MIN_ROWS))]
    return np.array(got, np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@F.pandas_udf(T.DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(np.asarray(x), np.asarray(y)) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def shared_by_block(hashes: pd.Series, own: pd.Series) -> pd.Series:
    """Number of hashes that are not ``own`` in each of 64 blocks of hashes."""
    count = lambda x: np.bincount(np.asarray(x, np.int64) & 63, minlength=64).astype(np.int32)
    return pd.Series([count(h) - count(o) for h, o in zip(hashes, own, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType().add("mask", T.IntegerType()).add("root", T.IntegerType()).add("top", T.IntegerType())))
def joined_hubs(masks: pd.Series) -> pd.Series:
    """For the sets of hubs (as bits) that a band's members are linked to, with their numbers: the component of each set,
    0 for none, and the component of most members."""
    out = []
    for band in masks:
        sets, at = [x["mask"] for x in band], {}
        for m in sets:
            part, before = m, -1
            while part != before:
                before = part
                for x in sets:
                    if x & part:
                        part |= x
            at[m] = part
        many: dict[int, int] = {}
        for x in band:
            many[at[x["mask"]]] = many.get(at[x["mask"]], 0) + x["m"]
        top = max(many, key=lambda r: (many[r], r))
        out.append([{"mask": m, "root": at[m], "top": top} for m in sets])
    return pd.Series(out, dtype=object)


def crowd_links(crowd: DataFrame, sets: DataFrame, compared, similarity: float) -> DataFrame:
    """Links that connect the members (key, tid) of each crowded band that chains of similar pairs within the band
    connect; ``sets``: (tid, hashes); ``compared``: (u, v) -> (u, v, s), each pair's similarity.

    The HUBS members that most others meet in bands are compared with all members, and their similarities are a pivot
    table: Jaccard distance is a metric, so two members whose distances to some hub differ by more than a linked pair's
    distance are no link. Members that hubs connect need no comparison with each other; those outside the component
    that holds most of a band are joined with all members that the table leaves and that can have enough shingles in
    common: shingles that no other member has do not count, and of each block of hashes two texts share the lesser
    number at most. Nothing is collected; in a crowd of copies of one text nearly all pairs are linked through a hub or ruled out by their edits.
    """
    weight = crowd.groupBy("tid").agg(F.sum("n").alias("w"))
    order = Window.partitionBy("key").orderBy(F.desc("w"), "tid")
    hubs = crowd.join(weight, "tid").withColumn("k", F.row_number().over(order)).where(F.col("k") <= HUBS)
    hubs = U.checkpoint(hubs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", F.col("tid").alias("hub")))).alias("hubs")))  # HUBS a band
    met = crowd.join(hubs, "key").select("key", "tid", F.explode("hubs").alias("x")).select("key", "tid", "x.k", "x.hub")
    met = U.checkpoint(met.select("key", "tid", "k", F.least("tid", "hub").alias("u"), F.greatest("tid", "hub").alias("v")))
    known = U.checkpoint(compared(met.where("u <> v").select("u", "v").distinct()))
    U.release(crowd.sparkSession)
    linked = known.where(F.col("s") >= similarity).select("u", "v")
    ends = met.join(known, ["u", "v"], "left").withColumn("s", F.when(F.col("u") == F.col("v"), 1.0).otherwise(F.col("s")))
    table = ends.groupBy("key", "tid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("d"),
        F.sum(F.when(F.col("s") >= similarity, F.expr("shiftleft(1, k - 1)")).otherwise(0)).cast("int").alias("mask"),
    )
    table = U.checkpoint(table)
    # members linked to hubs that are linked to each other, if through another member, are of one component
    masks = table.groupBy("key", "mask").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.collect_list(F.struct("mask", "m")).alias("masks"))
    parts = masks.select("key", joined_hubs("masks").alias("p")).where(F.size("p") > 1).select("key", F.explode("p").alias("p"))
    parts = parts.select("key", F.col("p.mask").alias("mask"), F.col("p.root").alias("root"), F.col("p.top").alias("top"))  # 2 ** HUBS rows a band
    table = U.checkpoint(table.join(parts, ["key", "mask"]))
    held = sets.join(table.select("tid").distinct(), "tid", "left_semi")
    own = held.select("tid", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("tid").alias("tid"), F.count(F.lit(1)).alias("c")).where("c = 1")
    size = held.join(own.groupBy("tid").agg(F.collect_list("h").alias("own")), "tid", "left")
    size = size.select("tid", F.size("hashes").alias("n"), shared_by_block("hashes", F.coalesce("own", F.array().cast("array<long>"))).alias("c"))
    # with i common shingles at most, a pair has similarity i / (n + n' - i) at most; members of a band have like sizes
    table = table.join(size, "tid").withColumn("common", F.aggregate("c", F.lit(0), lambda t, e: t + e))
    least = table.groupBy("key").agg(F.min("n").alias("least"))
    table = U.checkpoint(table.join(least, "key").where(F.col("common") * (1 + similarity) >= similarity * (F.col("n") + F.col("least")) - 1e-6))
    x, y = table.where("root <> top OR root = 0").alias("x"), table.alias("y")  # root 0: linked to no hub
    far = F.exists(F.zip_with("x.d", "y.d", lambda a, b: F.abs(a - b)), lambda e: e > 1 - similarity + 1e-9)
    once = ((F.col("y.root") == F.col("y.top")) & (F.col("y.root") != 0)) | (F.col("x.tid") < F.col("y.tid"))
    need = similarity * (F.col("x.n") + F.col("y.n")) / (1 + similarity) - 1e-6
    enough = (F.least("x.common", "y.common") >= need) & (F.aggregate(F.zip_with("x.c", "y.c", lambda a, b: F.least(a, b)), F.lit(0), lambda t, e: t + e) >= need)
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & ((F.col("x.root") != F.col("y.root")) | (F.col("x.root") == 0)) & (F.col("x.tid") != F.col("y.tid")) & once & ~far & enough)
    rest = rest.select(F.least("x.tid", "y.tid").alias("u"), F.greatest("x.tid", "y.tid").alias("v")).distinct()
    return linked.union(compared(U.checkpoint(rest)).where(F.col("s") >= similarity).select("u", "v"))


def similar_texts(docs: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) between text keys that connect the texts of ``docs`` (text) whose shingle sets have ``similarity``
    and share a band; ``keys``: (key, tid) for each band of each text.

    Pairs of bands of LISTED members at most are listed and verified; larger bands go to crowd_links().
    """
    spark = docs.sparkSession
    keys = keys.distinct()
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = U.checkpoint(keys.join(sizes, "key"))

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def listed(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"u": a, "v": b} for a, b in combinations(sorted(map(int, x)), 2)] for x in lists], dtype=object)

    small = shared.where(F.col("n") <= LISTED).groupBy("key").agg(F.collect_list("tid").alias("tids"))
    pairs = U.checkpoint(small.select(F.explode(listed("tids")).alias("e")).select("e.u", "e.v").distinct())
    crowd = shared.where(F.col("n") > LISTED)
    wanted = U.checkpoint(shared.select("tid").distinct())
    bits = np.zeros(MASK + 1, bool)
    bits[wanted.select(F.col("tid").bitwiseAND(F.lit(MASK)).cast("int").alias("b")).distinct().toPandas().b.to_numpy(dtype=np.int64)] = True
    handle = spark.sparkContext.broadcast(np.packbits(bits))

    def picked(batches):
        mask, seen = np.unpackbits(handle.value), set()  # a task sends a text once
        for pdf in batches:
            text = [t for t in pdf.text if t]
            at = {k: t for k, t in zip(map(text_key, text), text, strict=True) if mask[k & MASK] and k not in seen}
            seen.update(at)
            held = [shingle_set(t).view(np.int64) for t in at.values()]
            yield pd.DataFrame({"tid": pd.Series(list(at), dtype="int64"), "hashes": pd.Series(held, dtype=object)})

    sets = docs.select("text").mapInPandas(picked, "tid long, hashes array<long>").join(wanted, "tid", "left_semi")
    sets = U.checkpoint(sets.dropDuplicates(["tid"]))
    U.release(spark)
    a, b = (sets.select(F.col("tid").alias(n), F.col("hashes").alias(f"h{n}")) for n in "uv")

    def compared(some: DataFrame) -> DataFrame:
        return some.join(a, "u").join(b, "v").select("u", "v", alike("hu", "hv").alias("s"))

    few = U.checkpoint(compared(pairs).where(F.col("s") >= similarity).select("u", "v"))
    return few if crowd.isEmpty() else few.union(crowd_links(crowd, sets, compared, similarity))


@F.pandas_udf(T.StructType().add("tid", T.LongType()).add("keys", T.ArrayType(T.LongType())))
def bands_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"tid": [text_key(t or "") for t in text], "keys": [band_keys(shingle_set(t or "")) for t in text]})


def similar_links(docs: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) between the fingerprints of similar_texts()."""
    texts = U.checkpoint(docs.select(fingerprint_of("text").alias("fp"), bands_of("text").alias("b")).select("fp", "b.tid", "b.keys"))
    found = U.checkpoint(similar_texts(docs, texts.select(F.explode("keys").alias("key"), "tid"), similarity).distinct())
    U.release(docs.sparkSession)
    fps = texts.select("tid", "fp").distinct()
    ends = found.join(fps.toDF("u", "fu"), "u").join(fps.toDF("v", "fv"), "v")
    return ends.where("fu <> fv").select(F.col("fu").alias("u"), F.col("fv").alias("v")).distinct()


def members(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``; ``root`` is a fingerprint that names the component."""
    U.small_batches(docs)
    rows = U.checkpoint(docs.select(F.col("doc_id"), fingerprint_of("text").alias("fp")))
    ids = U.checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = links(ids) if similarity is None else links(ids).union(similar_links(docs, similarity))
    member = U.checkpoint(U.connected_components(edges).join(ids.withColumnRenamed("fp", "node"), "node"))
    roots = ids.select(F.col("fp").alias("node"), "low", F.col("fp").alias("root")).join(member.select("root").distinct(), "root", "left_semi")
    least = U.checkpoint(member.unionByName(roots).groupBy("root").agg(F.min("low").alias("component_id")))
    moved = member.unionByName(roots).join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    final = U.checkpoint(ids.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id")))
    return rows.join(final, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Links join fingerprints within RADIUS; with ``similarity`` also texts whose sets of five-word shingles have that
    Jaccard similarity or more.

    component_id is the smallest id that chains of links reach, the row's own included; repeated rows and equal texts
    share a fingerprint and so a component; null and empty texts have fingerprint zero and link like others; rows
    without an id link others but name no component (null where no id is reachable).
    """
    found = members(docs, similarity)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), HEX, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one document, the one with its smallest id.

    Of rows that repeat the kept id in the component one stays; of rows without an id in a component that has none, one
    for each fingerprint stays. An id whose rows have different fingerprints is decided row by row.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    found = U.checkpoint(members(docs.select("doc_id", "text"), similarity))
    named = found.where("doc_id IS NOT NULL")
    more = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.min("fp") != F.max("fp")).alias("mixed")).where("n > 1")
    more = U.checkpoint(more.select("doc_id", "mixed"))
    mixed = more.where("mixed").select("doc_id")
    gone = named.where("doc_id <> component_id").select("doc_id").union(mixed).distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    again = more.where("NOT mixed").select("doc_id")
    if not again.isEmpty():
        w = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
        first = kept.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1")
        kept = kept.join(again, "doc_id", "left_anti").select(*cols).union(first.select(*cols))
    if not mixed.isEmpty():
        w = Window.partitionBy("_root").orderBy(F.col("text").asc_nulls_last())
        at = named.where("doc_id = component_id").join(mixed, "doc_id", "left_semi").select("doc_id", F.col("fp").alias("_fp"), F.col("root").alias("_root")).distinct()
        rows = docs.join(mixed, "doc_id", "left_semi").withColumn("_fp", fingerprint_of("text")).join(at, ["doc_id", "_fp"])
        kept = kept.select(*cols).union(rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*cols))
    bare = found.where("doc_id IS NULL AND component_id IS NULL").select(F.col("fp").alias("_fp")).distinct()
    if not bare.isEmpty():
        null = docs.where(F.col("doc_id").isNull()).withColumn("_fp", fingerprint_of("text"))
        null = null.join(bare, "_fp", "left_semi").dropDuplicates(["_fp"])
        kept = kept.select(*cols).union(null.select(*cols))
    return kept.select(*cols)
