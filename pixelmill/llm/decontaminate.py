"""Benchmark decontamination: rare word n-grams of test items seed matches in documents, and Smith-Waterman alignment
scores each match, so that edited and paraphrased copies are found too."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

#: Words of a seed; items of fewer words than LEAST are found as they stand, without edits, and those of fewer words
#: than SEED only where they are the whole text. A copy with a fifth of its words changed may keep no run of five, but
#: always keeps one of three, so seeds are shorter than five words; the alignment decides at 0.8.
SEED, LEAST, SIMILAR = 3, 8, 0.8
#: A seed is rare if its words' rates make it less likely than this a position; if that leaves an item with less than
#: this share of its seeds, its least likely ones are used. Words of slack around a match.
RARE, SHARE, SLACK = 1e-6, 0.5, 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of benchmark text in one block; each block is sent to the tasks by itself.
BLOCK_BYTES = 2_000_000
#: Different words of a block are fewer than this, so that the numbers of three make one 63-bit code.
WORDS = 1 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment (Smith-Waterman, linear gaps) of two sequences of word
    numbers; start and end are positions in ``text``."""
    m, n = len(item), len(text)
    h = np.zeros((m + 1, n + 1), np.int32)
    gaps = GAP * np.arange(n + 1, dtype=np.int32)
    for i in range(1, m + 1):
        s = np.where(text == item[i - 1], MATCH, MISMATCH)
        best = np.maximum(h[i - 1, 1:] + GAP, h[i - 1, :-1] + s)
        row = np.concatenate([[0], np.maximum(best, 0)])
        # A gap along the text costs GAP a word: a running maximum of row - gaps, plus gaps.
        h[i] = np.maximum.accumulate(row - gaps) + gaps
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    end, matched = int(j), 0
    while h[i, j] > 0:
        same = item[i - 1] == text[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return matched, int(j), end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rates: dict[str, float]):
        self.items = {}
        self.number: dict[str, int] = {}
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.alone: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for k, (item_id, text) in enumerate(items):
            ws = words_of(text)
            if len(ws) < SEED:
                if ws:
                    self.alone[tuple(ws)].append(item_id)
                continue
            x = np.array([self.number.setdefault(w, len(self.number)) for w in ws], np.int64)
            self.items[k] = (item_id, x)
            chance = np.array([np.prod([rates.get(w, 0.0) for w in ws[i : i + SEED]]) for i in range(len(ws) - SEED + 1)])
            order = np.argsort(chance, kind="stable")
            # one seed finds an item that must stand as it is
            used = max(int((chance <= RARE).sum()), int(np.ceil(SHARE * len(chance)))) if len(ws) >= LEAST else 1
            for i in order[:used].tolist():
                self.seeds[self._code(x[i : i + SEED])].append((k, i))
        self.codes = np.array(sorted(self.seeds), np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _code(self, x) -> int:
        c = 0
        for v in x:
            c = c * WORDS + int(v)
        return c

    def __call__(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, end word) of every item found, best place of each."""
        ws = words_of(text)
        if len(ws) < SEED:
            return sorted((item_id, 1.0, 0, len(ws)) for item_id in self.alone.get(tuple(ws), ()))
        get = self.number.get
        x = np.array([get(w, -1) for w in ws], np.int64)
        n = len(x) - SEED + 1
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SEED):
            code = code * WORDS + x[k : k + n]
            known &= x[k : k + n] >= 0
        at = np.flatnonzero(known)
        at = at[self.bits[self._slot(code[at])]]
        hits = defaultdict(list)
        for p in at.tolist():
            for k, i in self.seeds.get(int(code[p]), ()):
                hits[k].append(p - i)
        out = []
        for k, starts in hits.items():
            item_id, item = self.items[k]
            m, best = len(item), None
            if m < LEAST:
                whole = next((s for s in sorted(starts) if 0 <= s <= len(x) - m and (x[s : s + m] == item).all()), None)
                if whole is not None:
                    out.append((item_id, 1.0, whole, whole + m))
                continue
            slack = SLACK + m // 4
            done = -1
            for s in sorted(set(starts)):
                if s <= done:
                    continue
                # Diagonals close to each other share a window.
                lo, hi = max(0, s - slack), min(len(x), s + m + 2 * slack)
                done = s + slack
                need = Counter(item.tolist())
                if sum((need & Counter(x[lo:hi].tolist())).values()) < SIMILAR * m:
                    continue
                matched, a, b = align(item, x[lo:hi])
                if matched >= SIMILAR * m and (best is None or matched > best[0]):
                    best = (matched, lo + a, lo + b)
            if best:
                out.append((item_id, best[0] / m, best[1], best[2]))
        return sorted(out)


def blocks_of(benchmark: DataFrame):
    """Items in blocks of BLOCK_BYTES, read in order of ids, one block at a time; the benchmark is the stated query
    set. Items without id or text take no part; a repeated item counts once."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def word_rates(docs: DataFrame, words: set[str]) -> dict[str, float]:
    """Share that each of ``words`` has among all words of ``docs``."""

    def counted(batches):
        seen, n = Counter(), 0
        for pdf in batches:
            for t in pdf.text:
                ws = words_of(t)
                n += len(ws)
                seen.update(w for w in ws if w in words)
        yield pd.DataFrame({"word": [*seen, ""], "n": [*seen.values(), n]})

    got = {r["word"]: r["n"] for r in docs.select("text").mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.pop("", 0) or 1
    return {w: c / total for w, c in got.items()}


FOUND = "array<struct<item_id:long,similarity:double,start:int,end:int>>"


def leaks_column(docs: DataFrame, benchmark: DataFrame) -> list:
    """One column function a block: text -> leaks found in the whole text. Each task has one block at a time."""
    U.small_batches(docs)
    out = []
    spark = docs.sparkSession
    for block in blocks_of(benchmark):
        rates = word_rates(docs, {w for _, t in block for w in words_of(t)})
        out.append(_finder(spark.sparkContext.broadcast((block, rates))))
    return out


def _finder(shared):
    @F.pandas_udf(FOUND)
    def found(text: pd.Series) -> pd.Series:
        match = _matcher(shared)
        return pd.Series([[dict(zip(("item_id", "similarity", "start", "end"), x, strict=True)) for x in match(t)] for t in text], dtype=object)

    return found.asNondeterministic()


@lru_cache(1)
def _matcher(shared) -> Matcher:
    return Matcher(*shared.value)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, end): every document of ``docs`` (doc_id, text) with every benchmark item
    (item_id, text) of which it holds a copy with SIMILAR of the item's words aligned; start and end count words.

    Items under LEAST words must stand as they are, those under SEED words as the whole text. Repeated rows are each
    reported; null and empty texts hold nothing; very long texts are searched whole; of equally good places of an item
    the first is given; repeated items count once; other columns are not read; an empty table or benchmark gives no rows.
    """
    parts = [docs.select("doc_id", F.explode(f("text")).alias("x")) for f in leaks_column(docs, benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start int, end int")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("doc_id", "x.item_id", "x.similarity", "x.start", "x.end")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns; texts are never shuffled."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for f in leaks_column(docs, benchmark):
        out = out.withColumn("leaks", f("row.text")).where(F.size("leaks") == 0).select("row")
    return out.select("row.*")
