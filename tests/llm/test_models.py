import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import _util as U
from pixelmill.llm import langid, lm, queries, quality, toxicity


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m if i is not None else 0


def held_out(spark, small, name, column, modulus, remainder):
    p = queries.QUERIES[name](spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert len(p) == docs and p.score.between(0, 1).all()
    assert (p.held_out == [crc(i, modulus) == remainder for i in p.doc_id]).all()
    assert (p.predicted == (p.score >= 0.7)).all()
    lab = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    return p[p.held_out].merge(lab, on="doc_id")[["predicted", column]]


def test_quality_on_held_out_documents(spark, small):
    h = held_out(spark, small, "op2_quality", "quality", 4, 2)
    assert (h.predicted == h.quality).mean() > 0.9


def test_toxicity_on_held_out_documents(spark, small):
    h = held_out(spark, small, "op5_toxicity", "toxic", 3, 1)
    assert h.predicted[h.toxic == 1].mean() > 0.8 and h.predicted[h.toxic == 0].mean() < 0.03


def test_toxicity_trains_on_whole_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "plain " * 9000 + f"last{i}") for i in range(12)] + [(0, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, (3, 1))
    want = sorted(i for i in range(12) if crc(i, 3) != 1)
    assert sorted(ws[-1] for _, _, ws in rows) == sorted([b"last"] * sum(i > 0 for i in want) + [b"again"] * (0 in want))
    assert all(len(ws) == 9001 for _, _, ws in rows if ws != [b"again"])
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 60_000)
    few = toxicity.training_rows(docs, labels, (3, 1))
    assert {t for _, t, _ in few} == {True, False} and all(sum(t == k and len(ws) > 1 for _, t, ws in few) == 1 for k in (True, False))


def test_language_on_held_out_documents(spark, small):
    p = queries.op8_language(spark, small).toPandas().merge(spark.read.parquet(f"{small}/documents.parquet").toPandas(), on="doc_id")
    h = p[p.held_out]
    assert (h.lang_pred == h.lang).mean() > 0.97 and p.score.between(0, 1).all()


@pytest.mark.parametrize("f", [quality.classify, toxicity.classify])
def test_classifiers_on_odd_rows(odd, none, labels, f):
    got = f(odd, labels)
    assert got.count() == odd.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert f(none, labels).count() == 0
    assert f(odd, labels.where("false")).count() == odd.count()


def test_untrained_classifiers(odd, labels):
    assert {r["score"] for r in quality.classify(odd, labels.where("false")).collect()} == {1.0}
    assert {r["score"] for r in toxicity.classify(odd, labels.where("false")).collect()} == {0.0}


def test_accepted_keeps_columns(odd, labels):
    got = quality.accepted(odd, labels.where("false"))
    assert got.columns == odd.columns and got.count() == odd.count()


def test_statistics_read_whole_texts():
    clean = "some plain words of text. " * 200
    assert quality.doc_stats(clean) != quality.doc_stats(clean + "%%% " * 200)
    assert quality.doc_stats(None) == quality.doc_stats("") == [0.0] * quality.N_STATS


def test_normal_equations_against_a_plain_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_STATS))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, stats array<double>").repartition(5)
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    m = quality.fit(stats, lab)
    use = np.array([crc(i, 4) != 2 for i in range(400)])
    z = quality.features(x[use], m.mean, m.scale)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * use.sum() * np.eye(z.shape[1]), z.T @ y[use])
    assert np.allclose(m.w, want, atol=1e-8) and np.allclose(m.mean, x[use].mean(axis=0))


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, quality.N_STATS)) * 0.5
    z = quality.features(x, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))[:, 1 + quality.N_STATS :]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality.N_STATS * quality.WIDTH**2))).max() < 0.35


def test_isotonic_pools_violators():
    x, y = U.pool_adjacent(np.arange(4.0), np.ones(4), np.array([0.0, 1.0, 0.0, 1.0]))
    assert y.tolist() == [0.0, 0.0, 0.5, 0.5, 1.0, 1.0] and x.tolist() == [0, 0, 1, 2, 3, 3]
    assert U.apply_isotonic((x, y), np.array([-1.0, 1.5, 9.0])).tolist() == [0.0, 0.5, 1.0]


def test_toxic_words_save_bytes_under_their_dictionary():
    rng = np.random.default_rng(0)
    syllables = ["ka", "lo", "mi", "ren", "tos", "ul", "ver", "zan"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(2, 5))))
    plain = [" ".join(word() for _ in range(80)) for _ in range(200)]
    toxic = [" ".join(w if k % 9 else str(rng.choice(["idiotic", "wretched", "loathsome"])) for k, w in enumerate(t.split())) for t in plain[:80]]
    o, t = toxicity.train_dictionaries(*([toxicity.windows(x) for x in side] for side in (toxic, plain[80:])))
    g = toxicity.Gains(o, t)
    high = lambda ws: g(ws)[toxicity.GAINS + 3 :].sum() / len(ws)
    assert high([b"idiotic", b"wretched", b"loathsome"]) == 1
    assert high([w.encode() for x in plain for w in x.split()]) < 0.02
    assert toxicity.train_dictionaries([], []) == (b"".rjust(16), b"")


def test_windows_cover_the_text():
    t = "Ein Wort, noch EINS! " + "x" * 1000
    assert b"".join(toxicity.windows(t)) == b"ein" + b"wort" + b"noch" + b"eins" + b"x" * 1000
    assert toxicity.windows(None) == toxicity.windows("") == []


def tokens(t):
    return (t or "").encode().lower().split() + [b""]


@pytest.mark.parametrize("known", [lm.KNOWN, 200])
def test_base_scores_counts_and_joined_counts(spark, small, known, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", known)
    monkeypatch.setattr(lm.most_frequent, "__defaults__", (known,))
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    p = queries.op6_class_lm(spark, small).toPandas().set_index("doc_id")
    c = Counter()
    for i, t in zip(docs.doc_id, docs.text):
        if crc(i, 10):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in zip(docs.doc_id, docs.text):
        r, ts = p.loc[i], tokens(t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(c[w] > 0 for w in ts), n, crc(i, 10) == 0)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)) < 1e-6
    h = p[p.held_out]
    assert h.score.sum() > h.base_score.sum()


def test_class_model_sums_to_one():
    """Over known words and one unknown word a class, the step from any class has probability 1."""
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 20, (30, 30)).astype(float)
    cls = lm.exchange(pairs, classes=4)
    assert cls.min() >= 0 and cls.max() < 4
    counts = rng.integers(1, 9, 30).astype(float)
    size, kinds = np.bincount(cls, counts, 4), np.bincount(cls, minlength=4)
    one = np.eye(4)[cls]
    moves = one.T @ pairs @ one
    step = (moves + lm.BETA) / (moves.sum(axis=1, keepdims=True) + lm.BETA * 4)
    emit = (counts + lm.ALPHA) / (size + lm.ALPHA * (kinds + 1))[cls]
    unknown = lm.ALPHA / (size + lm.ALPHA * (kinds + 1))
    assert np.allclose([(step[a, cls] * emit).sum() + step[a] @ unknown for a in range(4)], 1)


def test_exchange_against_plain_trials():
    """Every move is the one that a plain count of the likelihood finds best."""
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 30, (24, 24)) * (rng.random((24, 24)) < 0.4).astype(float)

    def value(cls, k):
        one = np.eye(k)[cls]
        t = one.T @ pairs @ one
        return sum((x[x > 0] * np.log(x[x > 0])).sum() * sign for x, sign in ((t, 1), (t.sum(axis=0), -1), (t.sum(axis=1), -1)))

    for k in (2, 5):
        order = np.argsort(-(pairs.sum(axis=0) + pairs.sum(axis=1)), kind="stable")
        cls = np.empty(24, int)
        cls[order] = np.arange(24) % k
        for _ in range(12):
            before = cls.copy()
            for i in order:
                tries = [value(np.where(np.arange(24) == i, b, cls), k) for b in range(k)]
                if max(tries) > tries[cls[i]] + 1e-7:
                    cls[i] = int(np.argmax(tries))
            if (cls == before).all():
                break
        assert lm.exchange(pairs, k, 12).tolist() == cls.tolist()


def test_exchange_finds_planted_classes():
    n = np.zeros((20, 20))
    for i in range(20):
        for j in range(20):
            n[i, j] = 50 if (i % 2) != (j % 2) else 1
    cls = lm.exchange(n, classes=2)
    assert len({(i % 2, int(c)) for i, c in enumerate(cls)}) == 2


@pytest.mark.parametrize("flush", [lm.FLUSH, 300])
def test_every_word_takes_the_class_that_its_neighbours_favour(spark, small, flush, monkeypatch):
    """words of one ending are told apart, however rare."""
    monkeypatch.setattr(lm, "FLUSH", flush)
    train = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 150")
    single = lm.seeds(train)[:60]
    cls = np.random.default_rng(3).integers(0, lm.CLASSES, lm.ITEMS)
    moves = np.random.default_rng(4).integers(0, 50, (lm.CLASSES, lm.CLASSES)).astype(float)
    got = {bytes(r["word"]): (r["c"], r["k"]) for r in lm.vocabulary(train, single, cls, moves).collect()}
    of = {w: cls[i] for i, w in enumerate(single)} | {b"": cls[lm.END]}
    kind = lambda w: int(of.get(w, cls[lm.ending(w)]))
    n, counts = moves + lm.BETA, Counter()
    p = np.log(n / n.sum(axis=1, keepdims=True))
    gain: dict = {}
    for r in train.collect():
        ts = [b"", *tokens(r["text"])]
        counts.update(ts[1:])
        for a, w, b in zip(ts, ts[1:], ts[2:]):
            gain[w] = gain.get(w, 0) + p[kind(a)] + p[:, kind(b)] - np.log(n.sum(axis=0))
    assert {w: c for w, (c, _) in got.items()} == counts
    assert all(k == kind(w) if w in of else gain[w][k] > gain[w].max() - 1e-6 for w, (_, k) in got.items())
    by_ending: dict = {}
    for w, c in counts.items():
        if w not in of and c < 3:
            by_ending.setdefault(lm.ending(w), set()).add(got[w][1])
    assert max(map(len, by_ending.values())) > 1


def test_words_items_and_places_against_plain_ones():
    """The whole-array forms of op 6 give what a loop over words gives, on odd white space, nulls and slices of arrays."""
    texts = ["  A b\x0bC\x0c", None, "", " \t\r\n", "x\x1cY\x85z\xa0\u2003\xc4 \xc9", "... ,;:!? end. ab!? \x00", "one", "\u6c49\u5b57. to a"]
    for got in (pa.chunked_array([texts], pa.string()), pa.chunked_array([texts[:3], [], texts[3:]], pa.string())[1:], pa.chunked_array([[None, ""]], pa.string())):
        plain = [tokens(t)[:-1] for t in got.to_pylist()]
        words, n = lm.words_of(got)
        flat = [w for ws in plain for w in ws]
        assert words.to_pylist() == flat and n.tolist() == [len(ws) for ws in plain]
        assert lm.endings(words).tolist() == [lm.ending(w) for w in flat]
        single = [b"b", b"one", b"..."]
        assert lm.items(words, pa.array(single, pa.binary())).tolist() == [single.index(w) if w in single else lm.ending(w) for w in flat]
        assert lm.items(words, pa.array([], pa.binary())).tolist() == [lm.ending(w) for w in flat]
        ends = [i for ws in ([], *plain) for i in [*ws, None]]
        assert lm.places(n).tolist() == [i for i, w in enumerate(ends) if w is not None]
    batch = pa.record_batch({"text": pa.array(texts)})
    for size in (1, 40, 1 << 20):
        assert [t for part in lm.joined(iter([batch, batch.slice(0, 0), batch]), size) for t in part["text"].to_pylist()] == texts * 2


def test_words_are_counted_as_arrays(spark, small):
    """op6_class_lm was over its seconds a GB: words went one by one through Python and rows in batches of 256."""
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], "64MB")
        docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
        plan = lm.vocabulary(docs, [b"a"], np.zeros(lm.ITEMS, int), np.ones((lm.CLASSES, lm.CLASSES)))._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
        assert lm.score(docs).count() == docs.count()
        assert spark.conf.get(keys[0]) == "10000" and int(spark.conf.get(keys[1]).rstrip("b")) <= 1 << 20
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_language_model_on_odd_rows(odd, none):
    got = lm.score(odd)
    assert got.count() == odd.count() and got.where("score IS NULL OR isnan(score) OR n_tokens < 1").count() == 0
    assert {r["n_tokens"] for r in got.where("doc_id IN (2, 3, 4)").collect()} == {1}
    assert lm.score(none).count() == 0


def test_language_of_odd_rows(odd, none):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd).collect()}
    assert {x[1] for x in got if x[0] in (2, 3, 4)} == {"und"} and all(0 <= x[2] <= 1 for x in got)
    assert langid.identify(none).count() == 0
    untaught = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in untaught.collect()} == {("und", 0.0)}


def test_hashed_grams_do_not_cross_texts():
    a, b = langid.hashed(["abc", "de"]), [langid.hashed(["abc"]), langid.hashed(["de"])]
    assert sorted(a[0].tolist()) == sorted(b[0][0].tolist() + b[1][0].tolist())
    assert langid.hashed([""])[2].tolist() == [0]
