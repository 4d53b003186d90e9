"""Toxicity by compression distance: zstandard dictionaries trained on ordinary and on toxic text, compressed lengths
of windows under both, thresholds and scores calibrated on labelled rows that trained neither.

A window is one word. In wider ones a match of neighbouring prose swallows the head of a toxic word, or the word's
bytes hide in the rounding of a block; a fixed tail of ordinary content lets the coder look for matches to the end.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

#: Documents of each class that dictionaries are trained on at most, and bytes of their whole texts in each class (a
#: documented bound; documents are taken in order of a hash of their ids while they fit, and calibration uses every
#: labelled row). Parts of the training rows for cross-fitting. Bytes of the dictionaries; what makes a word telling;
#: words whose gains a worker keeps.
TRAIN_DOCS, TRAIN_BYTES, PARTS, ORDINARY_BYTES, TOXIC_BYTES, RECUR, CONTRAST, CACHE = 1500, 16_000_000, 5, 4096, 4096, 4, 20, 200_000
ACCEPT = 0.7
STEADY = 30  # windows added to each document's number, so that short ones do not swing
GAINS = 8  # gains of a window are held to -GAINS..GAINS
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def windows(text: str | None) -> list[bytes]:
    """Words of the whole lower-cased text: runs of ASCII letters and of bytes beyond ASCII, cut every 256 bytes."""
    ws = _WORD.findall((text or "").lower().encode("utf-8", "replace"))
    if any(len(w) > 256 for w in ws):
        ws = [w[i : i + 256] for w in ws for i in range(0, len(w), 256)]
    return ws


def train(samples: list[bytes], size: int) -> bytes:
    """Content of a zstandard dictionary; too few samples to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=max(24, min(64, size // 8)), d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Gains:
    """Bytes that the toxic dictionary saves on a word; both compress with the same parameters, and the toxic one also
    holds the ordinary content, so that prose costs the same under either."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = self._compress(ordinary), self._compress(ordinary + toxic)
        self.tail = b" " + ordinary[len(ordinary) // 2 :][:16].rjust(16)
        self.kept: dict[bytes, int] = {}

    @staticmethod
    def _compress(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """How many of the words have each gain (2 * GAINS + 1 entries)."""
        kept, out = self.kept, np.zeros(2 * GAINS + 1, np.int32)
        if len(kept) > CACHE:
            kept.clear()
        got = list(map(kept.get, words))
        if None in got:
            for i, g in enumerate(got):
                if g is None:
                    w = words[i]
                    g = kept.get(w)
                    if g is None:
                        x = b" " + w + self.tail
                        g = kept[w] = min(GAINS, max(-GAINS, len(self.plain(x)) - len(self.both(x)))) + GAINS
                    got[i] = g
        if got:
            out += np.bincount(got, minlength=2 * GAINS + 1).astype(np.int32)
        return out


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Toxic documents, given as windows, reduced to the words that ordinary ones hardly hold: between RECUR different
    pairs of neighbours at least, so that copies do not count again, and CONTRAST times as often by document as in
    ordinary ones. Toxic documents are mostly ordinary prose, and a dictionary of it would save bytes on any text."""
    around = Counter(w for _, w, _ in {x for ws in toxic for x in zip([b"", *ws], ws, [*ws[1:], b""], strict=False)})
    held, plain = (Counter(w for ws in side for w in set(ws)) for side in (toxic, ordinary))
    m, n = len(toxic) + 1, len(ordinary) + 1
    told = {w for w, c in held.items() if around[w] >= max(RECUR, m // 100) and (c + 0.5) / m >= CONTRAST * (plain[w] + 0.5) / n}
    return [b" " + b"  ".join(x) + b" " for ws in toxic if (x := [w for w in ws if w in told])]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(ordinary content, toxic content) from the windows of documents; the toxic one is empty where no word tells the
    classes apart."""
    base = train([b" ".join(ws) for ws in ordinary], ORDINARY_BYTES)
    samples = telling(toxic, ordinary)
    words = Counter(w for x in samples for w in x.split())
    # every telling word once, the commonest last, where matches cost least, behind what training makes of them all
    whole = b" " + b"  ".join(w for w, _ in sorted(words.items(), key=lambda x: (x[1], x[0])))[-TOXIC_BYTES:] + b" "
    return base.rjust(16), train(samples, TOXIC_BYTES // 2) + whole if samples else b""


@lru_cache(PARTS + 1)
def _gains(ordinary: bytes, toxic: bytes) -> Gains:
    return Gains(ordinary, toxic)


@dataclass
class Model:
    """Dictionaries trained on all training rows, those trained without each part of them (25 kB a pair), the weight of
    each gain, and the isotonic knots; None: nothing learned."""

    whole: tuple[bytes, bytes] = (b"", b"")
    without: tuple[tuple[bytes, bytes], ...] = ()
    weight: np.ndarray | None = None
    knots: tuple | None = None


def part_of(doc_id):
    """Part of the training rows that an id belongs to."""
    return F.pmod(F.xxhash64(doc_id, F.lit(PARTS)), F.lit(PARTS)).cast("int")


def histograms_of(model: Model):
    """Column function: (text, part) -> array<int>, how many windows have each gain under the dictionaries of all
    training rows, then under those without the part; windows are cut once for both."""
    whole, without = model.whole, model.without

    @F.pandas_udf("array<int>")
    def count(text: pd.Series, part: pd.Series) -> pd.Series:
        every, others = _gains(*whole), [_gains(*p) for p in without]
        return pd.Series([np.concatenate([every(ws), others[k](ws)]) for ws, k in zip(map(windows, text), part, strict=True)], dtype=object)

    return count


def training_rows(docs: DataFrame, labels: DataFrame, holdout: tuple[int, int]) -> list[tuple[int, bool, list[bytes]]]:
    """(part, toxic, windows of the whole text) of TRAIN_DOCS and TRAIN_BYTES of each class at most. Repeated ids count
    once, with their smallest text."""
    y = U.single_label(labels, "toxic").where(U.fold(F.col("doc_id"), holdout[0]) != holdout[1])
    rows = y.select("doc_id", (F.col("y") >= 0.5).alias("toxic"), F.xxhash64("doc_id").alias("h"), part_of(F.col("doc_id")).alias("part"))
    first = lambda toxic: rows.where(F.col("toxic") == F.lit(toxic)).orderBy("h", "doc_id").limit(TRAIN_DOCS)
    picked = U.checkpoint(first(True).unionAll(first(False)))
    if picked.isEmpty():
        return []
    # 2 * TRAIN_DOCS rows: a bounded broadcast
    size = docs.where(F.col("text").isNotNull()).select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(picked), "doc_id")
    size = size.groupBy("doc_id", "toxic", "part", "h").agg(F.min("n").alias("n"))
    left, side = {True: TRAIN_BYTES, False: TRAIN_BYTES}, {}
    for r in sorted(size.collect(), key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            side[r["doc_id"]] = (r["part"], r["toxic"], r["n"])
    if not side:
        return []
    texts = docs.where(F.col("doc_id").isin(list(side))).where(F.col("text").isNotNull())
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("n"), "text")).alias("x")).select("doc_id", "x.text")
    return [(*side[r["doc_id"]][:2], windows(r["text"])) for r in sorted(texts.collect(), key=lambda r: r["doc_id"])]


def fit_dictionaries(docs: DataFrame, labels: DataFrame, holdout: tuple[int, int] = (3, 1)) -> Model:
    """Dictionaries from the training rows, and for each part of them from the other parts, so that calibration never
    meets a window that its dictionaries were trained on."""
    rows = training_rows(docs, labels, holdout)
    if len({toxic for _, toxic, _ in rows}) < 2:
        return Model()

    def trained(out: int | None) -> tuple[bytes, bytes]:
        kept = [(toxic, ws) for part, toxic, ws in rows if part != out]
        return train_dictionaries([ws for toxic, ws in kept if toxic], [ws for toxic, ws in kept if not toxic])

    return Model(trained(None), tuple(trained(k) for k in range(PARTS)))


def calibrate(model: Model, hist: DataFrame, labels: DataFrame, holdout: tuple[int, int] = (3, 1)) -> Model:
    """Weights and isotonic knots from every labelled row outside the held-out fold, by the histogram ``c`` that the
    dictionaries without its part give.

    A gain's weight is its log odds among windows of toxic against ordinary documents, one weight for all windows that
    save nothing; a document's raw score is the sum over its windows, scaled by the root of their number.
    """
    y = U.single_label(labels, "toxic").where(U.fold(F.col("doc_id"), holdout[0]) != holdout[1])
    rows = U.checkpoint(hist.where(F.col("doc_id").isNotNull()).join(y, "doc_id").select(F.col("c").alias("h"), (F.col("y") >= 0.5).cast("int").alias("y")))
    n = 2 * GAINS + 1
    sums = {r["y"]: np.array([r[f"g{i}"] for i in range(n)], float) for r in rows.groupBy("y").agg(*[F.sum(F.col("h")[i]).alias(f"g{i}") for i in range(n)]).collect()}
    if len(sums) < 2:
        return model
    odds = []
    for k in (1, 0):
        v = np.concatenate([[sums[k][: GAINS + 1].sum()], sums[k][GAINS + 1 :]]) + 0.5
        odds.append(np.log(v / v.sum()))
    weight = np.maximum.accumulate(odds[0] - odds[1])
    weight = np.concatenate([np.full(GAINS, weight[0]), weight])
    out = Model(model.whole, model.without, weight)

    knots = U.fit_isotonic(rows.select(raw_of(out)("h").alias("raw"), "y"), "raw", "y", 0.05)
    return Model(model.whole, model.without, weight, knots)


def raw_of(model: Model):
    weight = model.weight

    @F.pandas_udf("double")
    def raw(h: pd.Series) -> pd.Series:
        m = np.vstack(h.to_numpy()).astype(float) if len(h) else np.zeros((0, 2 * GAINS + 1))
        return pd.Series(m @ weight / np.sqrt(m.sum(axis=1) + STEADY))

    return raw


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), all windows of whole texts.

    Null and empty texts have no window and the score of such; words of over 256 bytes are windows of 256 each, so very
    long texts are only longer lists; repeated rows each get theirs; ties share a score; other columns of ``docs`` are
    not read, whatever their names; an empty table gives no rows, and without labelled rows of both classes every
    score is 0. Labels, lang, source and doc_id never enter a score.
    """
    U.small_batches(docs)
    held = (U.fold(F.col("doc_id"), 3) == 1).alias("held_out")
    model = fit_dictionaries(docs, labels)
    if model.whole[1]:
        # every row is scored by the dictionaries of all training rows (h) and by those without its own part (c)
        n = 2 * GAINS + 1
        both = docs.select("doc_id", histograms_of(model)("text", F.coalesce(part_of(F.col("doc_id")), F.lit(0))).alias("x"))
        hist = U.checkpoint(both.select("doc_id", F.slice("x", 1, n).alias("h"), F.slice("x", n + 1, n).alias("c")))
        model = calibrate(model, hist, labels)
    if model.knots is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    knots = model.knots

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        return pd.Series(U.apply_isotonic(knots, raw.to_numpy(dtype=float)))

    out = hist.select("doc_id", held, score(raw_of(model)("h")).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
