import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pixelmill.llm import decontaminate, mixing, packing, queries, simhash


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_best_fit_decreasing_against_a_plain_search(sizes):
    want, free = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(f, b) for b, f in enumerate(free) if f >= sizes[i] and f > 0]
        if fit:
            f = min(f for f, _ in fit)
            b = next(b for x, b in fit if x == f)
        else:
            b = len(free)
            free.append(64)
            want.append([])
        free[b] -= sizes[i]
        want[b].append(i)
    got = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 64 for b in got)
    assert len(got) == len(want)
    assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in want)


def test_encoder_equals_the_plain_tokenizer():
    e = packing.Encoder.of(packing.VOCABULARY)
    texts = ["a b  c", " lead and trail ", "it's 12 o'clock\nnew line\t tab", "été \U0001f600 你好 " * 9, "word " * 100 + "end", "a  b c " * 20 + "x", "", " "]
    for t in texts * 2:
        assert e(t).tolist() == e.bpe.encode_ordinary(t) and e.decode(e(t)) == t


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 30)
    e = packing.Encoder(packing.VOCABULARY)
    for k in range(20):
        t = " ".join(f"w{k}x{i % (5 + k)}" for i in range(25))
        assert e(t).tolist() == e.bpe.encode_ordinary(t)


def test_a_text_is_encoded_in_one_call(monkeypatch):
    e = packing.Encoder(packing.VOCABULARY)
    text, calls, plain = " ".join(f"w{i}x" for i in range(500)), [], e.bpe.encode_ordinary
    monkeypatch.setattr(e.bpe, "encode_ordinary", lambda t: calls.append(t) or plain(t))
    assert e(text).tolist() == plain(text) and calls == [text]


def test_packing_round_trip(spark, small):
    rows = queries.op7_packed_ids(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert packing.unpack(rows).exceptAll(docs).count() == 0 and docs.exceptAll(packing.unpack(rows)).count() == 0
    p = rows.toPandas()
    assert p.pack_id.is_unique and (p.ids.map(len) == 2 * packing.LENGTH).all()
    assert all(c[0] == 0 and c[-1] == n and (np.diff(c) >= 0).all() and list(r) == sorted(set(a for a, b in zip(c, c[1:]) if b > a)) for c, n, r in zip(p.cu_seqlens, p.n_tokens, p.position_resets))
    assert p.n_tokens.sum() / (len(p) * packing.LENGTH) > 0.97


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, length=64).toPandas()
    seen = {}
    for r in rows.itertuples():
        for d, n, a, b in zip(r.doc_ids, r.doc_tokens, r.cu_seqlens, r.cu_seqlens[1:]):
            seen.setdefault((d, n), 0)
            seen[(d, n)] += b - a
    assert seen[(2, 0)] == 0 and seen[(3, 0)] == 0 and any(d is None for d, _ in seen)
    assert all(got % max(n, 1) == 0 for (_, n), got in seen.items())
    assert packing.pack(none).count() == 0


def test_raking_against_plain_sweeps():
    cells = [(s, lang, t) for s in "ab" for lang in ("en", "de") for t in ("x", "y")]
    tokens = np.arange(1.0, 9.0) * 100
    targets = [{"a": 0.3, "b": 0.7}, {"en": 0.5, "de": 0.5}, {"x": 0.8, "y": 0.2}]
    w = mixing.rake(cells, tokens, targets)
    for m, t in enumerate(targets):
        for k, share in t.items():
            assert sum(w[i] * tokens[i] for i, c in enumerate(cells) if c[m] == k) / tokens.sum() == pytest.approx(share, abs=1e-8)


def test_expected_shares_meet_every_margin_with_cells_at_one():
    rng = np.random.default_rng(0)
    cells = [(s, lang, t) for s in "abcd" for lang in ("en", "de", "fr") for t in "xy"]
    t = rng.integers(1, 1000, len(cells)).astype(float)
    targets = mixing.tempered(cells, t, 0.5)
    for keep in (0.3, 0.8, 1.0):
        w, p, share = mixing.probabilities(cells, t, targets, keep)
        assert (p >= 0).all() and (p <= 1).all() and (p * t).sum() == pytest.approx(share * t.sum(), rel=2e-4) and share <= keep
        for m, target in enumerate(targets):
            for k, v in target.items():
                got = sum(p[i] * t[i] for i, c in enumerate(cells) if c[m] == k) / (p * t).sum()
                assert got == pytest.approx(v / sum(target.values()), abs=1e-3)
    assert share < 1 and (p > 0.999).any()  # the last one had to hold cells at 1 and keep less
    even = [(x,) * 3 for x in "ab"]
    assert np.allclose(mixing.probabilities(even, np.array([4.0, 4.0]), mixing.tempered(even, np.array([4.0, 4.0])), 0.5)[1], 0.5)


def test_mixture_of_documents(spark, small):
    p = queries.op9_mixture(spark, small).toPandas()
    d = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    assert len(p) == len(d)
    n = p.set_index("doc_id").n_tokens
    assert all(n[i] == len(t.encode().split()) for i, t in zip(d.doc_id, d.text))
    assert (p.topic == np.where(p.n_tokens < 200, "note", np.where(p.n_tokens < 1000, "article", "chapter"))).all()
    assert p.groupby(["source", "lang", "topic"])[["weight", "probability"]].nunique().eq(1).all().all()
    expected, seen = (p.probability * p.n_tokens), (p.sampled * p.n_tokens)
    assert abs(expected.sum() - seen.sum()) < 0.05 * p.n_tokens.sum()
    for column in ("source", "lang", "topic"):
        target = p.groupby(column).n_tokens.sum() ** mixing.TEMPER
        weighted = (p.weight * p.n_tokens).groupby(p[column]).sum()
        assert np.allclose(weighted / weighted.sum(), target / target.sum(), atol=1e-6)
        assert np.allclose(expected.groupby(p[column]).sum() / expected.sum(), target / target.sum(), atol=1e-3)


def test_mixture_of_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.where("probability IS NULL OR probability < 0 OR probability > 1").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.sampled(odd).columns == odd.columns
    assert mixing.sampled(odd).where("doc_id IN (2, 3, 4)").count() == 3


def plain_alignment(a, b):
    h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = max(0, h[i - 1][j - 1][0] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j][0] - 1, h[i][j - 1][0] - 1)
            h[i][j] = (s, 0)
            best = max(best, s)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_alignment_score_is_optimal(a, b):
    matched, start, end = decontaminate.align(np.array(a), np.array(b))
    assert plain_alignment(a, b) == plain_alignment(a, b[start:end]) and matched <= min(len(a), end - start)
    if set(a) & set(b):
        assert matched >= 1


ITEM = "which of the seven silver rivers runs below the old northern bridge when winter snow begins to melt in april"


def planted(spark):
    filler = "some other plain sentence about nothing in particular that fills the page with words "
    edited = ITEM.split()
    edited[4], edited[11], edited[17] = "golden", "southern", "fades"
    half = " ".join(ITEM.split()[:9])
    rows = [(1, filler * 30 + ITEM + " " + filler * 30), (2, filler + " ".join(edited).upper() + "! " + filler), (3, filler * 40), (4, filler + half + " " + filler), (5, None), (6, ""), (7, ITEM), (7, ITEM), (None, ITEM)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (None, ITEM), (10, ITEM), (13, "an item that no document of this table ever holds at all in any form")], "item_id long, text string")
    return docs, bench


def test_exact_edited_and_partial_copies(spark):
    docs, bench = planted(spark)
    got = decontaminate.find_leaks(docs, bench).toPandas()
    ids = sorted("none" if d != d else str(int(d)) for d in got.doc_id)
    assert ids == ["1", "2", "7", "7", "none"] and set(got.item_id) == {10}
    two = got[got.doc_id == 2].iloc[0]
    assert two.similarity == pytest.approx(17 / 20) and two.end - two.start == 20
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0 == decontaminate.find_leaks(docs.where("false"), bench).count()


def test_short_items_are_found_as_they_stand(spark):
    short = ["one two", "red green blue", "a b c d e", "p q r s t u v", "k l m n o p q r"]
    bench = spark.createDataFrame(list(enumerate(short)), "item_id long, text string")
    texts = ["x one two y", "One, two!", "x red green y blue red green blue", "a b c d x e a b c d E.", "p q r s t u w", "p q r s t u v", "z k l m n o p q x", "word " * 60000 + "a b c d e", None]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["end"]) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(1, 0, 0, 2), (2, 1, 5, 8), (3, 2, 6, 11), (5, 3, 0, 7), (6, 4, 1, 8), (7, 2, 60000, 60005)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [0, 4, 8]


def test_blocks_of_a_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    docs, bench = planted(spark)
    assert decontaminate.find_leaks(docs, bench).count() == 5


def test_leaks_against_a_plain_search(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    b = spark.read.parquet(f"{small}/benchmark.parquet").toPandas()
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontaminate(spark, small).collect()}
    items = {i: " " + " ".join(decontaminate.words_of(t)) + " " for i, t in zip(b.item_id, b.text)}
    whole = {(i, k) for i, t in zip(d.doc_id, d.text) for x in [" " + " ".join(decontaminate.words_of(t)) + " "] for k, w in items.items() if w in x}
    assert whole <= got and len(got - whole) <= 2 + len(whole) // 5


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == first
        rows[name] = docs.count()
    assert list(rows) == ["quality", "near_duplicates", "decontamination", "mixture"]
    assert rows["quality"] > 800 and rows["quality"] > rows["near_duplicates"] > rows["decontamination"] > rows["mixture"] > 0
    assert simhash.near_duplicates(docs).groupBy("component_id").count().where("count > 1").count() == 0
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0


def test_pipeline_runs_and_handles_an_empty_table(spark, small, none, tmp_path):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and out.where(F.size("doc_ids") < 1).count() == 0
    empty = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
