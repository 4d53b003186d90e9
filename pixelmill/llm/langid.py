"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in sparse numpy batches."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

#: Buckets of hashed n-grams, n-gram sizes up to this, smoothing, characters in a numpy batch, languages learned at most.
BUCKETS, SIZES, ALPHA, BATCH_CHARS, LANGUAGES = 1 << 14, 3, 0.5, 2_000_000, 512


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter's code point, or 32 for what is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, index of its text, letters by text). N-grams are those of lower-cased letters with
    runs of other characters as one space, and never cross from a text to the next."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cut = np.zeros(len(texts), np.int64)
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    x, doc = _letters()[raw], np.repeat(np.arange(len(texts)), size + 1)
    letters = np.bincount(doc[x != 32], minlength=len(texts)) if len(texts) else cut
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[keep].astype(np.uint64), doc[keep]
    codes, owner, h = [], [], np.zeros(len(x), np.uint64)
    for n in range(SIZES):
        if len(x) <= n:
            break
        m = len(x) - n
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + x[n:] + np.uint64(n + 1)
        ok = doc[:m] == doc[n:]
        if n == 0:
            ok &= x != 32
        mixed = h * np.uint64(0xC2B2AE3D27D4EB4F)
        codes.append((mixed >> np.uint64(50)).astype(np.int64)[ok] % BUCKETS)
        owner.append(doc[:m][ok])
    return (np.concatenate(codes), np.concatenate(owner), letters) if codes else (cut[:0], cut[:0], letters)


def _blocks(texts: list[str]):
    """Slices of ``texts`` of about BATCH_CHARS characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_CHARS:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fit(docs: DataFrame, holdout: tuple[int, int] = (4, 2)) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix) from every row with text and lang outside the held-out fold.

    Each partition sums its counts by language, and a distributed step adds them; the matrix is LANGUAGES x BUCKETS
    float32 at most (32 MB); more languages than that are an error.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(U.fold(F.col("doc_id"), holdout[0]) != holdout[1])

    def counted(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % 32  # the same if the task runs again
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, rows_ in pdf.groupby("lang"):
                texts = rows_.text.tolist()
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for s in _blocks(texts):
                    total += np.bincount(hashed(texts[s])[0], minlength=BUCKETS)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "part": part, "m": [x.tobytes() for x in sums.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "part": [0], "m": [sum(np.frombuffer(x, np.int64) for x in pdf.m).tobytes()]})

    kind = "lang string, part int, m binary"
    sums = rows.select("text", "lang").mapInPandas(counted, kind).groupBy("lang", "part").applyInPandas(add, kind).groupBy("lang").applyInPandas(add, kind)
    got = sorted((r["lang"], np.frombuffer(r["m"], np.int64)) for r in sums.limit(LANGUAGES + 1).collect())
    got = [(k, v) for k, v in got if v.any()]
    if len(got) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    n = np.array([v for _, v in got], float).reshape(len(got), BUCKETS) + ALPHA
    return [k for k, _ in got], np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred and score, the posterior of the predicted language tempered by length.

    `und` with score 0 where the text is null or has no letter, or where no language was learned; ties go to the
    language first in order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(logp.T))

    @F.pandas_udf("lang_pred string, score double")
    def best(text: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in text]
        names, scores = [], []
        for s in _blocks(texts):
            part = texts[s]
            h, doc, letters = hashed(part)
            n = np.bincount(doc, minlength=len(part))
            ll = np.zeros((len(part), len(langs)))
            for k in range(len(langs)):
                ll[:, k] = np.bincount(doc, weights=shared.value[h, k], minlength=len(part))
            if langs:
                top = ll.argmax(axis=1)
                p = np.exp((ll - ll.max(axis=1, keepdims=True)) / np.maximum(1.0, n / 64.0)[:, None])
                p = p[np.arange(len(part)), top] / p.sum(axis=1)
            else:
                top, p, letters = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part))
            names += [langs[t] if m else "und" for t, m in zip(top, letters)]
            scores += np.where(letters > 0, p, 0.0).tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores}, columns=["lang_pred", "score"])

    found = docs.select("doc_id", best("text").alias("x"))
    return found.select("doc_id", "x.lang_pred", "x.score")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang); rows of fold 2 of 4 teach
    nothing, repeated rows are each predicted, an empty table gives no rows."""
    U.small_batches(docs)
    langs, logp = fit(docs)
    out = predict(docs, langs, logp)
    return out.select("doc_id", (U.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
