import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.llm import _util as U
from pixelmill.llm import queries, sharding, simhash, topk


def test_top_k_against_brute_force(spark, small):
    got = queries.op1_exact_topk(spark, small).toPandas()
    e = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    v = np.floor(64 * np.stack([np.asarray(x, float) for x in e.embedding])).astype(np.int64)
    ids, s = e.vec_id.to_numpy(), v @ v.T
    for q in np.flatnonzero(ids % 20 == 0):
        want = sorted(((-s[q, j], ids[j]) for j in range(len(ids)) if j != q))[:20]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert [(-a, b) for a, b in zip(mine.score, mine.vec_id)] == [(x, y) for x, y in want]
        assert mine["rank"].tolist() == list(range(1, 21))


def test_top_k_leaves_out_bad_vectors_and_breaks_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 3)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rows = [(i, [0.5, 0.25]) for i in range(0, 45)] + [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (None, [1.0, 1.0]), (0, [0.5, 0.25]), (60, [3e38, 3e38]), (61, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.numbered(topk.quantise(df.selectExpr("*", "1 AS score", "2 AS rank", "'x' AS v")))
    got = topk.exact_topk(v.where("vec_id % 20 = 0"), v, 20).toPandas()
    assert len(got[got.query_id == 0]) == 40 and len(got[got.query_id == 20]) == 20
    one = got[got.query_id == 20].sort_values("rank")
    assert one.vec_id.tolist() == [60, 0, 0] + list(range(1, 18))
    assert one.score.iloc[0] == 2**63 - 1 and one.score.iloc[1] == 32 * 32 + 16 * 16
    assert len(got[got.query_id == 60]) == 20
    few = topk.exact_topk(v.where("vec_id = 20"), v.where("vec_id in (1, 2, 20)"), 20)
    assert few.count() == 2 and topk.exact_topk(v.where("false"), v, 20).count() == 0 == topk.exact_topk(v, v.where("false"), 20).count()


def test_every_row_of_a_repeated_id_is_ranked(spark):
    v = topk.numbered(topk.quantise(spark.createDataFrame([(1, [0.5]), (1, [0.9]), (20, [1.0])], "vec_id long, embedding array<float>")))
    got = [tuple(r) for r in topk.exact_topk(v.where("vec_id % 20 = 0"), v).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 57 * 64), (20, 2, 1, 32 * 64)]


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    n = [sum((xxhash.xxh64_intdigest(s, 42) >> b) & 1 for s in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def components(ids, fps):
    up = {i: i for i in range(len(ids))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                up[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [low.get(root(i)) for i in range(len(ids))]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB cé\t\n", max_size=40))
def test_fingerprint_against_the_definition(t):
    assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = {}
    fps = [plain_fingerprint(r["text"]) if len(r["text"] or "") < 1000 else simhash.fingerprint(r["text"]) for r in rows]
    for r, f, c in zip(rows, fps, components([r["doc_id"] for r in rows], fps)):
        want.setdefault((r["doc_id"], f"{f:016x}", c), 0)
        want[(r["doc_id"], f"{f:016x}", c)] += 1
    got = {}
    for r in simhash.near_duplicates(odd).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_in_crowded_buckets(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 600:
        x = list(fps)[int(rng.integers(0, len(fps)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 4))):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)}
    ids = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in ids]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in U.connected_components(simhash.links(df)).collect()}
    comp = components(list(range(len(ids))), ids)
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(got.get(s, s), set()).add(comp[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(comp))


def test_pivot_bound_keeps_every_close_pair():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, fp ^ np.uint64(5), fp ^ np.uint64(1 << 63), fp ^ np.uint64(7)]))
    i, j = simhash.close_pairs(fp)
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = {(a, b) for a in range(len(fp)) for b in range(a) if d[a, b] <= 2}
    assert {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want
    keys = simhash._keys(simhash.distances(fp))
    assert all(set(keys[a].tolist()) & set(keys[b].tolist()) for a, b in want)


def test_one_document_of_each_group_stays(odd, none):
    got = [(r["doc_id"], r["score"]) for r in simhash.one_of_each(odd).collect()]
    assert sorted((i for i, _ in got if i is not None)) == [1, 2, 5, 6, 7]
    assert len([i for i, _ in got if i is None]) == 1  # the text without an id; the null text repeats document 2
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.one_of_each(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in U.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300)) and len(got) == 499


def test_shards_of_odd_rows(odd, none):
    got = sharding.assign(odd).toPandas()
    rows = odd.toPandas()
    assert len(got) == len(rows)
    want = sorted((str(None if pd.isna(d) else int(d)), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in zip(rows.doc_id, rows.text))
    assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.size, r.text_crc32) for r in got.rename(columns={"size": "size"}).itertuples(index=False)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 8)).all()
    assert got[got.doc_id == 1]["shard"].nunique() == 1
    assert sharding.assign(none).count() == 0


def plain_slot(doc_id):
    return 0 if doc_id is None else int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS


def test_shards_against_a_plain_count(spark, small):
    """Every column of the query over the whole table, by the definition."""
    got = queries.op4_shards(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    one, two = sharding.plan_slots(8), sharding.plan_slots(9)
    load = {}
    rows = []
    for d, t in zip(docs.doc_id, docs.text):
        size, s = len((t or "").encode()) + 1, plain_slot(d)
        load[s] = load.get(s, 0) + size
        rows.append([d, size, zlib.crc32((t or "").encode()), s])
    want, at = set(), [0] * 8
    for d, size, crc, s in sorted(rows, key=lambda r: (r[3], r[0], r[2], r[1])):
        want.add((d, size, crc, "key", one[s], at[one[s]], two[s], s, load[s], 1))
        at[one[s]] += 1
    assert {tuple(r) for r in got.itertuples(index=False)} == want and len(got) == len(want)


def test_stored_maps_are_edited_by_slot_bytes(spark, small, tmp_path):
    docs, path = spark.read.parquet(f"{small}/documents.parquet"), str(tmp_path / "map")
    sharding.store_map(spark, path, 1, sharding.plan_slots(8))
    assert sharding.store_rebalanced(spark, path, docs, 8) == 2
    maps = sharding.read_maps(spark, path)
    assert maps[1] == sharding.plan_slots(8) and maps[2] != maps[1]
    got = sharding.assign(docs, 8, path, (2, 1)).groupBy("shard").sum("size").toPandas()["sum(size)"]
    before = sharding.assign(docs).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert got.max() - got.min() < before.max() - before.min()
    assert sharding.assign(docs, 8, path, (1, 2)).drop("grown_shard", "map_version").exceptAll(sharding.assign(docs).drop("grown_shard", "map_version")).count() == 0


def test_slot_maps_are_even_and_move_only_to_the_new_shard():
    for n in range(1, 40):
        a, b = sharding.plan_slots(n), sharding.plan_slots(n + 1)
        assert all(x == y or y == n for x, y in zip(a, b))
        sizes = [b.count(k) for k in range(n + 1)]
        assert max(sizes) - min(sizes) <= n + 1, (n, sizes)


def test_rebalancing_narrows_bytes():
    rng = np.random.default_rng(0)
    w = {s: int(x) for s, x in enumerate(rng.pareto(1.5, sharding.SLOTS) * 1000)}
    before = sharding.plan_slots(8)
    after = sharding.rebalance(before, w, 8)
    load = lambda m: [sum(w[s] for s in range(sharding.SLOTS) if m[s] == k) for k in range(8)]
    assert max(load(after)) - min(load(after)) < max(load(before)) - min(load(before))
    assert max(load(after)) <= max(max(w.values()), math.ceil(1.01 * sum(w.values()) / 8))


def test_many_equal_rows_are_spread_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    df = spark.range(100).selectExpr("5L AS doc_id", "'a' AS text")
    got = sharding.assign(df).toPandas()
    assert sorted(got.slot) == list(range(100))


def test_edited_copies_of_ordinary_documents_go(spark, monkeypatch):
    rng = np.random.default_rng(6)

    def edited(words, n):
        return [f"e{rng.integers(10**9)}" if i in set(np.linspace(20, len(words) - 20, n, dtype=int).tolist()) else w for i, w in enumerate(words)]

    base = [[f"w{x}" for x in rng.integers(0, 10**6, 300)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join(edited(b, 5)) for b in base] + [" ".join(edited(b, 40)) for b in base]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [simhash.shingle_set(t) for t in texts]
    assert all(simhash.jaccard(sets[i], sets[i + 6]) >= 0.8 > simhash.jaccard(sets[i], sets[i + 12]) for i in range(6))
    want = [*range(6), *range(12, 18), 100, 102]
    for most in (simhash.LISTED, 1):  # pairs listed, or bands verified whole
        monkeypatch.setattr(simhash, "LISTED", most)
        assert sorted(r["doc_id"] for r in simhash.one_of_each(df, 0.8).collect()) == want
    assert simhash.one_of_each(df.where("false"), 0.8).count() == 0


def test_repeated_ids_with_different_texts_lose_no_component(spark):
    a, b, c, d = ("one two three four five six", "red green blue white black grey", "sun moon star sky cloud rain", "salt corn rice bean leaf root")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, d), (9, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (None, 0.8):
        assert sorted(tuple(r) for r in simhash.one_of_each(df, similarity).collect()) == [(3, a), (5, b), (9, d), (9, c)]


def test_crowds_of_copies_are_linked_like_all_pairs(spark, monkeypatch):
    """Copies of one text at many distances, two hubs only: components equal those of all pairs within a band."""
    monkeypatch.setattr(simhash, "LISTED", 3)
    monkeypatch.setattr(simhash, "HUBS", 2)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**62, 400)
    sets = {}
    for i in range(60):
        x = base.copy()
        at = rng.choice(400, int(rng.integers(0, 90)), replace=False)
        x[at] = rng.integers(0, 2**62, len(at))
        sets[i] = np.unique(x)
    crowd = spark.createDataFrame([(k, i, 60 if k else 30) for k in (0, 1) for i in range(60) if k or i % 2], "key long, tid long, n long")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in sets.items()], "t long, h array<long>")
    a, b = (d.select(d.t.alias(n), d.h.alias("h" + n)) for n in "uv")
    asked = []

    def compared(some):
        asked.append(some.count())
        return some.join(a, "u").join(b, "v").select("u", "v", simhash.alike("hu", "hv").alias("s"))

    edges = simhash.crowd_links(crowd, d.toDF("tid", "hashes"), compared, 0.8)
    got = {r["node"]: r["root"] for r in U.connected_components(edges).collect()}
    up = {i: {i} for i in sets}
    for i in sets:
        for j in range(i):
            if simhash.jaccard(sets[i], sets[j]) >= 0.8 and up[i] is not up[j]:
                up[i] |= up[j]
                for k in up[j]:
                    up[k] = up[i]
    assert all(got.get(i, i) == min(up[i]) for i in sets) and len({id(x) for x in up.values()}) > 1
    assert asked[0] < 60 * 3 and asked[1] < 60 * 59 // 4
