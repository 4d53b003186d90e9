"""Token-id output: documents become token ids, overlong ones are split without loss, pieces are packed best fit
decreasing with a segment tree over free capacities, and rows of a packed id matrix are written as binary."""

from __future__ import annotations

import base64
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util as U

#: Ids in a row of the matrix, rows' worth of ids packed at a time, chunks of text kept with their ids (none), and padding.
LENGTH, GROUP_ROWS, CACHE, PAD = 2048, 2048, 0, 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenizer's public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = T.StructType(
    [
        T.StructField("pack_id", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_offsets", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
    ]
)


class Encoder:
    """Token ids of a text by byte-level BPE. A text is encoded in one call: keeping the ids of frequent chunks costs more
    than it saves where most chunks are new."""

    _made: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), np.uint16)

    def decode(self, ids) -> str:
        return self.bpe.decode(list(map(int, ids)))


class Capacities:
    """Segment tree over free capacities 0..length; a leaf counts the open bins that have this much left."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: dict[int, list[int]] = defaultdict(list)

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        k = self.base + free
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, bin) of the tightest open bin that has ``need`` left, removed from the tree."""
        k = self.base + need
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        free = k - self.base
        while k:
            self.count[k] -= 1
            k >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers; items go in order of falling size (ties: smaller number first), each to the tightest bin."""
    tree, bins = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = (length, len(bins))
            bins.append([])
        free, b = found
        bins[b].append(i)
        if free > sizes[i]:
            tree.add(free - sizes[i], b)
    return bins


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packed rows of all of ``docs`` (doc_id, text); see SCHEMA.

    ``ids`` holds ``length`` little-endian uint16 ids, padded with PAD after ``n_tokens``; ``cu_seqlens`` runs from 0
    through the end of each segment; ``position_resets`` holds the places where positions start again at 0; the other
    lists give each segment's document, the segment's offset in it and the document's number of ids. A document
    without ids (null or empty text) is a segment of no ids, so every row of the input appears. Null ids stay null
    and repeated rows are packed each; ties in size go by order of reading; other columns are not read; an empty table
    gives no rows.
    Tasks pack what they read, in groups of bounded size, so nothing is shuffled.
    """
    U.small_batches(docs)

    def packed(batches):
        from pyspark import TaskContext

        encode, made, base = Encoder.of(vocabulary), 0, TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0

        def flush():
            nonlocal made, held, total
            rows = []
            for segments in best_fit_decreasing([len(x[1]) for x in held], length):
                ids = np.full(length, PAD, np.uint16)
                cu = [0]
                for i in segments:
                    ids[cu[-1] : cu[-1] + len(held[i][1])] = held[i][1]
                    cu.append(cu[-1] + len(held[i][1]))
                rows.append((base + made, ids.tobytes(), cu[-1], cu, sorted({c for c, d in zip(cu, cu[1:]) if d > c}), *([held[i][k] for i in segments] for k in (0, 2, 3))))
                made += 1
            held, total = [], 0
            return pd.DataFrame(rows, columns=SCHEMA.names) if rows else None

        for pdf in batches:
            for doc_id, text in zip(pdf.doc_id.astype(object).where(pdf.doc_id.notna(), None), pdf.text, strict=True):
                ids = encode(text or "")
                for at in range(0, max(len(ids), 1), length):
                    piece = ids[at : at + length]
                    held.append((None if doc_id is None else int(doc_id), piece, at, len(ids)))
                    total += len(piece) + 8
                    if total >= GROUP_ROWS * length:
                        yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInPandas(packed, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed matrix, its cumulative lengths and resets under ``path``, a folder of the shared store."""
    pack(docs, **options).write.parquet(path)


def unpack(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the documents that packed rows hold, for ids that do not repeat (the round trip of tests)."""
    parts = rows.select("ids", "cu_seqlens", F.explode(F.arrays_zip("doc_ids", "doc_offsets", F.sequence(F.lit(0), F.size("doc_ids") - 1).alias("k"))).alias("s"))

    def cut(pdfs):
        for pdf in pdfs:
            out = [np.frombuffer(i, np.uint16)[c[s["k"]] : c[s["k"] + 1]].tobytes() for i, c, s in zip(pdf.ids, pdf.cu_seqlens, pdf.s, strict=True)]
            yield pd.DataFrame({"doc_id": [s["doc_ids"] for s in pdf.s], "at": [s["doc_offsets"] for s in pdf.s], "part": out})

    @F.pandas_udf("string")
    def text(parts: pd.Series) -> pd.Series:
        return pd.Series([Encoder.of(vocabulary).decode(np.frombuffer(b"".join(x["part"] for x in sorted(p, key=lambda x: x["at"])), np.uint16)) for p in parts])

    whole = parts.mapInPandas(cut, "doc_id long, at long, part binary").groupBy("doc_id").agg(F.collect_list(F.struct("at", "part")).alias("p"))
    return whole.select("doc_id", text("p").alias("text"))
