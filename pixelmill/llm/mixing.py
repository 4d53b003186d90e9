"""Mixing to target weights: iterative proportional fitting rakes token weights of cells to source, language and topic
marginals, and documents are sampled by calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MARGINS = ("source", "lang", "topic")
#: Raking sweeps at most, where they end early, share of the kept tokens that a margin may be off by after cells were
#: held at probability 1, cells that the driver rakes at most, share of tokens to keep at most, power that tempers
#: natural shares to targets, seed of the sampling.
SWEEPS, TOLERANCE, MISS, CELLS, KEEP, TEMPER, SEED = 200, 1e-10, 1e-4, 200_000, 0.8, 0.7, 17


def tokens_of(text: Column) -> Column:
    """White-space tokens of a text, by the white space of ASCII; none for a null or blank text. Each word becomes one
    letter with the white space around it, so the text is matched once."""
    letters = F.regexp_replace(text, r"[\x09-\x0D\x20]*+[^\x09-\x0D\x20]++[\x09-\x0D\x20]*+", "x")
    return F.coalesce(F.length(F.translate(letters, "\t\n\x0b\x0c\r ", "")), F.lit(0)).cast("long")


def topic_of(tokens: Column) -> Column:
    """The third margin. The corpus carries no topics, and this one is no topic but a document's form by its length:
    note, article or chapter."""
    return F.when(tokens < 200, "note").when(tokens < 1000, "article").otherwise("chapter")


def _margins(cells: list[tuple], tokens: np.ndarray, targets: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each margin: the value of each cell by number, and the target tokens of each value. Shares are taken over
    values in use; a margin without any target keeps what it has."""
    total, out = tokens.sum(), []
    for m, t in enumerate(targets):
        names = sorted({c[m] for c in cells}, key=str)
        at = {v: i for i, v in enumerate(names)}
        k = np.array([at[c[m]] for c in cells])
        have = np.bincount(k, tokens, len(names))
        want = np.array([float(t.get(v, 0.0)) for v in names]) * (have > 0)
        out.append((k, want / want.sum() * total if want.sum() else have))
    return out


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[dict], sweeps: int = SWEEPS, start: np.ndarray | None = None, held: np.ndarray | None = None, of: float = 1.0) -> np.ndarray:
    """Weight of each cell such that weighted tokens meet each margin's target shares of ``of`` times all tokens; margins
    are matched one after another until none is off by more than TOLERANCE. Cells in ``held`` keep their weight, and
    the others are matched to what these leave."""
    total = tokens.sum()
    w = np.ones(len(tokens)) if start is None else start.copy()
    fixed = np.zeros(len(tokens), bool) if held is None else held
    index = [(k, np.maximum(want * of - np.bincount(k, w * tokens * fixed, len(want)), 0.0)) for k, want in _margins(cells, tokens, targets)]
    for _ in range(sweeps):
        worst = 0.0
        for k, want in index:
            now = np.bincount(k, w * tokens * ~fixed, len(want))
            f = np.divide(want, now, out=np.ones_like(want), where=now > 0)
            worst = max(worst, float((np.abs(now - want) * (now > 0)).max(initial=0.0)) / max(total, 1.0))
            w = np.where(fixed, w, w * f[k])
        if worst < TOLERANCE:
            break
    return w


def probabilities(cells: list[tuple], tokens: np.ndarray, targets: list[dict], keep: float = KEEP) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight, probability, share kept) of each cell, expected tokens meeting every margin.

    ``keep`` of all tokens are to stay, and a probability is at most 1. Cells that would pass 1 are held there and the
    others are raked again to what the margins still lack, until none passes. Where that leaves a margin short (its
    documents hold fewer tokens than its target), less is kept: the largest share, to one part in 2**20, for which the
    margins can be met.
    """
    total = tokens.sum()
    free = rake(cells, tokens, targets)

    def fitted(share: float) -> np.ndarray | None:
        held, p = np.zeros(len(tokens), bool), np.minimum(free * share, 1.0)
        for _ in range(len(tokens) + 1):
            p = rake(cells, tokens, targets, start=np.where(held, 1.0, np.maximum(free * share, 1e-300)), held=held, of=share)
            over = ~held & (p > 1 + TOLERANCE)
            if not over.any():
                break
            held |= over
        index = _margins(cells, tokens, targets)
        off = max(np.abs(np.bincount(k, p * tokens, len(w)) - share * w).max() for k, w in index)
        return np.clip(p, 0.0, 1.0) if off <= MISS * share * total else None

    if not total:
        return free, np.ones(len(tokens)), keep
    got = fitted(keep)
    if got is not None:
        return free, got, keep
    low, high = min(keep, 1.0 / max(free.max(), 1.0)), keep  # at low no cell passes 1
    best = np.clip(free * low, 0.0, 1.0)
    for _ in range(20):
        mid = (low + high) / 2
        got = fitted(mid)
        if got is None:
            high = mid
        else:
            low, best = mid, got
    return free, best, low


def tempered(cells: list[tuple], tokens: np.ndarray, power: float = TEMPER) -> list[dict]:
    """Targets: each margin's natural token shares to a power, which lifts small sources, languages and topics."""
    out = []
    for m in range(len(MARGINS)):
        share: dict = {}
        for c, t in zip(cells, tokens, strict=True):
            share[c[m]] = share.get(c[m], 0.0) + float(t)
        out.append({k: v**power for k, v in share.items()})
    return out


def mixed(docs: DataFrame, targets: list[dict] | None = None, keep: float = KEEP) -> DataFrame:
    """row (a struct of the columns of ``docs``), topic, tokens, weight, probability and sampled, a boolean.

    Expected tokens of the sample meet the target shares of all three margins to MISS. Cells are sums, made before any
    shuffle; over CELLS of them are an error, so what reaches the driver and is sent back is bounded. Nulls are a value
    of their own. A row is sampled by a hash of its id and text, so repeated rows share their fate and a lost task
    decides alike again; ties cannot arise, for every row is decided by itself. Rows without tokens have weight 1 and
    always stay; very long texts are one row like others; an empty table gives no rows; the columns of ``docs`` travel
    in a struct, so that their names clash with none.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tokens_of(F.col("text")).alias("tokens"))
    d = d.withColumn("topic", topic_of(F.col("tokens")))
    keys = [F.coalesce(F.col(f"row.{c}"), F.lit("\0null")) for c in ("source", "lang")]
    got = d.groupBy(keys[0].alias("s"), keys[1].alias("l"), F.col("topic").alias("t")).agg(F.sum("tokens").alias("n")).limit(CELLS + 1).collect()
    if len(got) > CELLS:
        raise ValueError(f"more than {CELLS} cells of source, language and topic")
    cells, tokens = [(r["s"], r["l"], r["t"]) for r in got], np.array([float(r["n"]) for r in got])
    w, p, _ = probabilities(cells, tokens, targets or tempered(cells, tokens), keep) if cells else (tokens, tokens, keep)
    rows = [(*c, float(a), float(b)) for c, a, b in zip(cells, w, p, strict=True)]
    table = docs.sparkSession.createDataFrame(rows, "s string, l string, t string, w double, p double")
    out = d.join(F.broadcast(table), (keys[0] == F.col("s")) & (keys[1] == F.col("l")) & (F.col("topic") == F.col("t")), "left")
    u = F.pmod(F.xxhash64(F.col("row.doc_id"), F.coalesce("row.text", F.lit("")), F.lit(SEED)), F.lit(1 << 52)) / float(1 << 52)
    empty = F.col("tokens") == 0
    out = out.withColumn("probability", F.when(empty, 1.0).otherwise(F.coalesce("p", F.lit(1.0))))
    out = out.withColumn("weight", F.when(empty, 1.0).otherwise(F.coalesce("w", F.lit(1.0))))
    return out.withColumn("sampled", u < F.col("probability")).select("row", "topic", "tokens", "weight", "probability", "sampled")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) for every row of ``docs``."""
    m = mixed(docs.select("doc_id", "text", "source", "lang"))
    return m.select("row.doc_id", "row.source", "row.lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "sampled")


def sampled(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mixture samples, with their columns."""
    return mixed(docs).where("sampled").select("row.*")
