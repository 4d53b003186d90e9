"""Brown class-based bigram model: exchange clustering gives words classes; class transitions and word emissions, both
smoothed, give each text's log probability.

The commonest words and groups of endings are clustered one by one; then every other word takes the class that its own
neighbours in training favour, and transitions are counted anew. Counts and classes cover all words of the training
corpus. Only the KNOWN most frequent words travel to the tasks; the counts and classes of all others meet their
occurrences in a join.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as U

#: Words whose counts are sent to tasks; of them, words that are clustered one by one; groups of other words, by their
#: endings, that are clustered as groups; classes; exchange rounds; smoothing of emissions and transitions. The table of
#: item bigrams has 6.6 million cells at most, 52 MB in a task. FLUSH: bytes of text that a task counts at once; FEW: see seeds().
KNOWN, SINGLE, ENDINGS, CLASSES, ROUNDS, ALPHA, BETA = 150_000, 2048, 511, 64, 6, 0.1, 0.1
ITEMS = SINGLE + ENDINGS + 1  # the last is the end of a text, which also stands before its first word
END = ITEMS - 1
FLUSH, FEW = 32 << 20, 100_000
BLOCK = 1 << 16  # cells of the bigram table in a row that the driver receives


def ending(word: bytes) -> int:
    """Item of a word that is not clustered by itself, by its last letters: its class as a neighbour in the exchange, and
    as long as it has no occurrence in training."""
    return SINGLE + zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % ENDINGS


def joined(batches, size: int):
    """Arrow tables of ``size`` bytes or little more, but for the last and for rows that are longer, made of small batches."""
    held, n = [], 0
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            held.append(batch.slice(i, step))
            n += held[-1].nbytes
            if n >= size:
                out, held, n = pa.Table.from_batches(held), [], 0
                yield out
                del out
    if held:
        yield pa.Table.from_batches(held)
    pa.default_memory_pool().release_unused()  # workers are kept for later stages


def bounds(a: pa.BinaryArray) -> np.ndarray:
    """Offsets of the values of a binary array in its data."""
    return np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset) if len(a) else np.zeros(1, np.int32)


def binary(offsets: np.ndarray, data) -> pa.BinaryArray:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def words_of(texts: pa.ChunkedArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Lower-cased words of all texts, one after another, and their number in each text; a null is an empty text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.combine_chunks(), "")))
    words, n = lists.flatten().cast(pa.binary()), lists.value_lengths().to_numpy(zero_copy_only=False)
    full = np.diff(bounds(words)) > 0  # white space at either end of a text gives an empty word there
    if not full.all():
        words, n = words.filter(pa.array(full)), np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
    return words, n


def endings(words: pa.BinaryArray) -> np.ndarray:
    """ending() of each word."""
    words = pc.ascii_rtrim(words.view(pa.string()), characters=".,;:!?")
    at, crc = bounds(words), np.full(len(words), 0xFFFFFFFF, np.uint32)
    data, size = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(at)
    for j in (3, 2, 1):
        some = np.flatnonzero(size >= j)
        c = crc[some]
        crc[some] = CRC[(c ^ data[at[some + 1] - j]) & 255] ^ (c >> 8)
    return SINGLE + (~crc % ENDINGS).astype(np.int32)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def items(words: pa.BinaryArray, single: pa.BinaryArray) -> np.ndarray:
    """Item of each word."""
    found = pc.index_in(words, value_set=single)
    out = found.fill_null(-1).to_numpy(zero_copy_only=False).copy()
    out[out < 0] = endings(words.filter(found.is_null()))
    return out


def places(n: np.ndarray) -> np.ndarray:
    """Place of each word of texts of ``n`` words in a sequence where an end stands before the first and after each text."""
    out = np.repeat(np.arange(1, len(n) + 1, dtype=np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


def class_table(pairs: np.ndarray, cls: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class bigrams."""
    a, b = np.nonzero(pairs)
    return np.bincount(cls[a] * classes + cls[b], pairs[a, b], classes * classes).reshape(classes, classes)


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item by the exchange algorithm: items start by rank of frequency and move, one at a time, to the
    class that raises the likelihood of class bigrams most, until none moves. ``pairs``: counts (items x items).

    The likelihood is the sum of n log n over class bigrams less that over both margins. Putting an item into class b
    changes row b, column b and their margins alone, so all classes are tried at once over one classes x classes table.
    """
    n, back = len(pairs), np.ascontiguousarray(pairs.T)
    freq = pairs.sum(axis=0, dtype=float) + pairs.sum(axis=1, dtype=float)
    order = np.argsort(-freq, kind="stable")
    cls = np.empty(n, np.int64)
    cls[order] = np.arange(n) % classes
    table = class_table(pairs, cls, classes)

    def nlogn(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(rounds):
        moved = False
        for i in order:
            if not freq[i]:
                break
            a, own = cls[i], float(pairs[i, i])
            to, of = np.bincount(cls, pairs[i], classes), np.bincount(cls, back[i], classes)  # sums in float64
            to[a] -= own
            of[a] -= own
            table[a, :] -= to
            table[:, a] -= of
            table[a, a] -= own
            now, rows, cols = nlogn(table), table.sum(axis=1), table.sum(axis=0)
            row, col = nlogn(table + to) - now, nlogn(table + of[:, None]) - now
            both = table.diagonal() + to + of + own
            gain = row.sum(axis=1) - row.diagonal() + col.sum(axis=0) - col.diagonal() + nlogn(both) - now.diagonal()
            # the item's own count and what runs between it and class b fall on the margins of b as well
            gain -= nlogn(rows + to.sum() + of + own) - nlogn(rows) + nlogn(cols + of.sum() + to + own) - nlogn(cols)
            # margins of the other classes: each gains what it sends to or gets from the item
            others = nlogn(rows + of) - nlogn(rows)
            gain -= others.sum() - others
            others = nlogn(cols + to) - nlogn(cols)
            gain -= others.sum() - others
            b = int(np.argmax(gain))
            if b != a and gain[b] > gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                cls[i], moved = b, True
            b = cls[i]
            table[b, :] += to
            table[:, b] += of
            table[b, b] += own
        if not moved:
            break
    return cls


def seeds(train: DataFrame) -> list[bytes]:
    """The SINGLE commonest words, commonest first. A word's count is summed over the parts (FLUSH bytes of text or
    a task) in which it is at least a FEW-th of the tokens, so it is low by that share of all tokens at most."""

    def counted(batches):
        for t in joined(batches, FLUSH):
            words, _ = words_of(t["text"])
            each = words.dictionary_encode()
            c = np.bincount(each.indices, minlength=len(each.dictionary))
            some = np.flatnonzero(c >= len(words) / FEW)
            yield pa.RecordBatch.from_arrays([each.dictionary.take(pa.array(some)), pa.array(c[some], pa.int64())], ["word", "c"])

    found = train.select("text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return [bytes(r["word"]) for r in found.orderBy(F.desc("c"), "word").limit(SINGLE).collect()]


def preference(moves: np.ndarray) -> np.ndarray:
    """(2 * classes x classes): what the log likelihood of a word's occurrences gains if it is in a class, for each
    occurrence after a class (first half) and before a class (second half); ``moves``: counts of class bigrams."""
    n = moves + BETA
    after = np.log(n / n.sum(axis=1, keepdims=True)) - np.log(n.sum(axis=0))  # the word's share of its class
    return np.concatenate([after, np.log(n / n.sum(axis=1, keepdims=True)).T])


def vocabulary(train: DataFrame, single: list[bytes], cls: np.ndarray, moves: np.ndarray) -> DataFrame:
    """(word binary, c, k) over all of ``train`` (text): counts of all words and their classes; the end of each text is the
    empty word.

    A word of ``single`` has its class in ``cls``. Any other is put into the class that its own neighbours favour most:
    all its occurrences count, with the classes that words and endings had in the exchange, and all words move at once.
    Tasks pass on each word's neighbours as pairs of bytes, or as a table where that is shorter.
    """
    width = 2 * CLASSES
    handle = train.sparkSession.sparkContext.broadcast((pa.array(single, pa.binary()), cls, preference(moves)))

    def counted(batches):
        single, cls, _ = handle.value
        for t in joined(batches, FLUSH):
            words, n = words_of(t["text"])
            each = words.dictionary_encode()
            x, names = each.indices.to_numpy(), each.dictionary
            del words
            item, at, c = items(names, single), places(n), np.bincount(x, minlength=len(names))
            k = np.full(len(x) + len(n) + 1, cls[END], np.uint8)
            k[at] = cls[item].astype(np.uint8)[x]
            rare = np.flatnonzero((item >= SINGLE)[x])
            rare |= x[rare].astype(np.int64) << 32
            rare.sort()  # by word, and in the order of the texts
            order = at[rare & 0xFFFFFFFF]
            del rare
            near = np.stack([k[order - 1], k[order + 1]], axis=1)
            many = np.where(item < SINGLE, 0, c)
            size, ends, raw, last = 2 * many, np.cumsum(many), [], 0
            for i in np.flatnonzero(many > 2 * width):
                two = near[ends[i] - many[i] : ends[i]].astype(np.int64) + (0, CLASSES)
                raw += [near[last : ends[i] - many[i]].tobytes(), np.bincount(two.ravel(), minlength=width).astype(np.uint32).tobytes(), b"T"]
                size[i], last = 4 * width + 1, ends[i]
            raw = b"".join([*raw, near[last:].tobytes()])
            out = pa.RecordBatch.from_arrays([names, pa.array(c, pa.int64()), binary(np.append(0, np.cumsum(size)), raw)], ["word", "c", "near"])
            for i in range(0, len(names), 1 << 16):
                yield out.slice(i, 1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([len(n)], pa.int64()), pa.array([b""], pa.binary())], ["word", "c", "near"])

    def placed(batches):
        single, cls, gain = handle.value
        fixed, kinds = pa.concat_arrays([single, pa.array([b""], pa.binary())]), np.append(cls[: len(single)], cls[END])
        pair = (gain[:CLASSES, None] + gain[None, CLASSES:]).reshape(-1, CLASSES)  # by the classes on both sides
        best = np.argmax(pair, axis=1)
        last: tuple = ()  # the last word so far, which may go on, with its count and what each class gains

        def rows(words, counts, k):
            found = pc.index_in(words, value_set=fixed)
            at = found.fill_null(0).to_numpy(zero_copy_only=False)
            k = np.where(found.is_valid().to_numpy(zero_copy_only=False), kinds[at], k)
            return pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64()), pa.array(k, pa.int32())], ["word", "c", "k"])

        def end():
            return rows(pa.array([last[0]], pa.binary()), [last[1]], np.argmax(last[2][None], axis=1))

        for t in joined(batches, 1 << 20):
            words, near = (t[c].combine_chunks().cast(pa.binary()) for c in ("word", "near"))
            new = np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))
            start, row = np.flatnonzero(new), np.cumsum(new) - 1
            names, total = words.take(pa.array(start)), np.add.reduceat(t["c"].to_numpy(), start)
            size = np.diff(bounds(near))
            full = np.flatnonzero(size % 2)
            small = near.filter(pa.array(size % 2 == 0))
            two = np.frombuffer(small.buffers()[2] or b"", np.uint8)[bounds(small)[0] : bounds(small)[-1]].reshape(-1, 2)
            two = two[:, 0].astype(np.int64) * CLASSES + two[:, 1]
            of = np.repeat(row, np.where(size % 2, 0, size // 2))
            seen = np.bincount(of, minlength=len(start))
            # a word that came with one pair has the class that is best for it; what all others gain is added up
            k, some = np.zeros(len(start), np.int64), seen > 1
            k[of] = best[two]
            some[row[full]] = some[[0, -1]] = True
            value, at = np.zeros((some.sum(), CLASSES)), np.cumsum(some) - 1
            for i in full:
                value[at[row[i]]] += np.frombuffer(near[i].as_py()[:-1], np.uint32) @ gain
            two, of = two[some[of]], at[of[some[of]]]
            for i in range(0, len(of), 1 << 15):
                here = of[i : i + (1 << 15)]
                first = np.flatnonzero(np.diff(here, prepend=-1))
                value[here[first]] += np.add.reduceat(pair[two[i : i + (1 << 15)]], first)
            if last:
                if names[0].as_py() == last[0]:
                    total[0] += last[1]
                    value[0] += last[2]
                else:
                    yield end()
            k[some] = np.argmax(value, axis=1)
            if len(names) > 1:
                yield rows(names[:-1], total[:-1], k[:-1])
            last = names[-1].as_py(), int(total[-1]), value[-1].copy()
        if last:
            yield end()

    parts = train.select("text").mapInArrow(counted, "word binary, c long, near binary")
    return parts.repartition("word").sortWithinPartitions("word").mapInArrow(placed, "word binary, c long, k int")


def most_frequent(vocab: DataFrame, most: int = KNOWN) -> list[tuple[bytes, int, int]]:
    """(word, c, k) of the words whose count reaches the lowest bound that at most ``most`` words reach, commonest first.
    A histogram of counts, exact below 1,000 and logarithmic above, gives the bound, so that no more is collected."""
    c = F.col("c")
    bin_ = F.when(c < 1000, c).otherwise(1000 + F.floor(F.log10(c / 1000.0) * 1000)).cast("int")
    total, least = 0, None
    for r in vocab.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["b"]
    if least is None:
        return []
    rows = vocab.where(bin_ >= least).collect()
    return sorted(((bytes(r["word"]), r["c"], r["k"]) for r in rows), key=lambda x: (-x[1], x[0]))


def item_pairs(train: DataFrame, single: list[bytes]) -> np.ndarray:
    """Counts of item bigrams over all of ``train``; ITEMS x ITEMS at most reach the driver."""

    single = pa.array(single, pa.binary())

    def counted(batches):
        table = np.zeros(ITEMS * ITEMS, np.int64)
        for t in joined(batches, FLUSH // 8):
            words, n = words_of(t["text"])
            x = np.full(len(words) + len(n) + 1, END, np.int32)
            x[places(n)] = items(words, single)
            del words
            np.add.at(table, x[:-1] * ITEMS + x[1:], 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["pair", "n"])

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf.pair.iloc[0]) // BLOCK
        cells = np.zeros(BLOCK, np.float32)
        cells[pdf.pair.to_numpy(dtype=np.int64) - block * BLOCK] = pdf.n
        return pd.DataFrame({"block": [block], "m": [cells.tobytes()]})

    # each pair is one row of a block by now, so a block has BLOCK rows at most; the driver gets a few dozen rows
    sums = train.select("text").mapInArrow(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(-(-ITEMS * ITEMS // BLOCK) * BLOCK, np.float32)
    for r in sums.groupBy(F.floor(F.col("pair") / BLOCK).alias("at")).applyInPandas(packed, "block int, m binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["m"], np.float32)
    return out[: ITEMS * ITEMS].reshape(ITEMS, ITEMS)


def class_moves(rows: DataFrame) -> np.ndarray:
    """Counts of class bigrams over all of ``rows`` (ks: the classes of a text between two ends)."""

    def counted(batches):
        table = np.zeros(CLASSES * CLASSES, np.int64)
        for pdf in batches:
            k, ends = np.frombuffer(b"".join(pdf.ks), np.uint8).astype(np.int64), np.cumsum(pdf.ks.map(len))
            two = np.delete(k[:-1] * CLASSES + k[1:], ends[:-1] - 1)  # the last of a text and the first of the next are no pair
            table += np.bincount(two, minlength=CLASSES * CLASSES)
        at = np.flatnonzero(table)
        yield pd.DataFrame({"pair": at, "n": table[at]})

    out = np.zeros(CLASSES * CLASSES)
    for r in rows.select("ks").mapInPandas(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


@lru_cache(1)
def _tables(handle) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their classes and log10(c + ALPHA), both with a zero behind the last, and the class of each item; built once
    a worker."""
    words, counts, kinds, cls = handle.value
    return words, np.append(kinds, 0).astype(np.uint8), np.append(np.log10(counts + ALPHA), 0), cls


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Learns from the rows outside fold 0 of 10. A null or empty text is its end alone. Unknown words are an event of
    the class of their ending with count 0, so probabilities sum to 1 over known words and one unknown for each class. Repeated
    rows are each scored; very long texts are scored whole; words of equal count are ranked by their bytes; other
    columns of ``docs`` are not read, whatever their names; without training rows every count is 0; an empty table
    gives no rows.
    """
    U.batch_bytes(docs)
    spark = docs.sparkSession
    held = U.fold(F.col("doc_id"), 10) == 0
    train = docs.where(~held)
    single = seeds(train)
    pairs = item_pairs(train, single)
    cls = exchange(pairs)
    vocab = U.checkpoint(vocabulary(train, single, cls, class_table(pairs, cls, CLASSES)))
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in vocab.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        size[r["k"]], kinds[r["k"]] = r["n"], r["v"]
    n_all, v_all = int(size.sum()), int(kinds.sum())
    n_end = next((r["c"] for r in vocab.where("word = X''").collect()), 0)
    kinds[cls[END]] += n_end == 0  # the end of a text is a word of its class like others
    emit = -np.log10(size + ALPHA * (kinds + 1))
    base = -log10(n_all + ALPHA * (v_all + 1))
    end_log = log10(n_end + ALPHA)
    n_known_end = int(n_end > 0)
    top = [x for x in most_frequent(vocab) if x[0]]
    parts = pa.array([w for w, *_ in top], pa.binary()), np.array([c for _, c, _ in top], np.int64), np.array([k for *_, k in top], np.uint8)
    handle = spark.sparkContext.broadcast((*parts, cls))

    def read(batches):
        top, row_cls, row_log, cls = _tables(handle)
        for t in joined(batches, 8 << 20):
            words, n = words_of(t["text"])
            found = pc.index_in(words, value_set=top)
            x, of = found.fill_null(len(top)).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            rest = np.flatnonzero(x == len(top))
            far, some = words.take(pa.array(rest)), np.bincount(of[rest], minlength=len(n))
            kinds = row_cls[x]
            kinds[rest] = cls[endings(far)]  # stays where the word is new
            k = np.full(len(x) + 2 * len(n), cls[END], np.uint8)
            k[np.arange(len(x)) + 2 * of + 1] = kinds
            lists = pa.array(np.append(0, np.cumsum(some)), pa.int32())
            at = pa.array(rest - (np.cumsum(n) - n)[of[rest]] + 1, pa.int64())
            out = {
                "doc_id": t["doc_id"].combine_chunks(),
                "held_out": t["held_out"].combine_chunks(),
                "n_tokens": pa.array(n + 1, pa.int64()),
                "n_known": pa.array(n - some + n_known_end, pa.int64()),
                "logs": pa.array(np.bincount(of, row_log[x], len(n)) + end_log, pa.float64()),
                "ks": binary(np.append(0, np.cumsum(n + 2)), k),
                "words": pa.ListArray.from_arrays(lists, far),
                "at": pa.ListArray.from_arrays(lists, at),
            }
            out = pa.RecordBatch.from_arrays(list(out.values()), list(out))
            for i in range(0, len(n), 256):
                yield out.slice(i, 256)

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, ks binary, words array<binary>, at array<long>"
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(read, kind)
    # Row numbers are stored with the rows, so nothing that is computed again can change them.
    rows = U.checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "at")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.at").alias("at"))
    rare = rare.join(vocab, "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = rare.groupBy("row").agg(
        F.sum(F.log10(c + F.lit(ALPHA))).alias("more"), F.count("c").alias("known"), F.collect_list(F.col("at") * CLASSES + F.col("k")).alias("put")
    )

    @F.pandas_udf("binary")
    def whole(ks: pd.Series, put: pd.Series) -> pd.Series:
        out = []
        for k, p in zip(ks, put, strict=True):
            if p is not None and len(p):
                k, p = np.frombuffer(k, np.uint8).copy(), np.asarray(p, np.int64)
                k[p // CLASSES] = p % CLASSES
                k = k.tobytes()
            out.append(k)
        return pd.Series(out, dtype=object)

    rows = U.checkpoint(
        rows.drop("words", "at").join(more, "row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
            (F.col("logs") + F.coalesce("more", F.lit(0.0))).alias("logs"),
            whole("ks", "put").alias("ks"),
        )
    )
    moves = class_moves(rows.where("NOT held_out"))
    step = np.log10((moves + BETA) / (moves.sum(axis=1, keepdims=True) + BETA * CLASSES))

    @F.pandas_udf("double")
    def steps(ks: pd.Series) -> pd.Series:
        each = (np.frombuffer(k, np.uint8) for k in ks)
        return pd.Series([float(step[k[:-1], k[1:]].sum() + emit[k[1:]].sum()) for k in each], dtype=float)

    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("logs") + steps("ks")).alias("score"),
    )
