"""Near-duplicate documents: an LSH forest over MinHash signatures, links confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import words
from tidegrid.llm.components import connected_components, free_node, led_by_ids, local_roots
from tidegrid.staging import stage

DEEPEST, FEW, MISS = 6, 25, 5e-5


def tree_plan(percent: int) -> tuple[int, int]:
    """Number of trees and their depth, so that a pair exactly at ``percent`` shares no region with odds ``MISS`` at most.

    The deepest trees, up to ``DEEPEST``, of which no more than ``FEW`` are needed.
    """
    if percent <= 0:
        raise ValueError("percent must be positive")
    same = min(percent, 100) / 100
    for depth in range(DEEPEST, 0, -1):
        trees = 1 if same == 1 else math.ceil(math.log(MISS) / math.log1p(-(same**depth)))
        if trees <= FEW:
            break
    return trees, depth


def shingles(texts: pd.Series, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and the borders.

    A shingle is ``width`` consecutive lower-cased words; a text with fewer words has its
    whole sequence as the one shingle, a text without words none.
    """
    w = words.split(texts, lower=True)
    h, first = w.hashes(), w.first
    n = np.diff(first)
    lo, hi = first[:-1], np.where(n >= width, first[1:] - width + 1, first[1:])
    count = np.where(n >= width, hi - lo, 0)
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    few = np.flatnonzero((n > 0) & (n < width))
    value = np.concatenate([words.window_hashes(h, width)[at], words.span_hashes(h, lo[few], first[1:][few])])
    doc = np.concatenate([np.repeat(np.arange(len(n)), count), few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(value: np.ndarray, edge: np.ndarray, rows: int, seed: int = 9) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, one row per set."""
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(edge) - 1, rows), np.uint32)
    start = edge[:-1]
    for k, key in enumerate(keys):
        x = value * key
        x = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(x, start)
    return out


def _describer(values: int):
    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in words.batches(frames):
            value, edge = shingles(frame.text)
            n = np.diff(edge)
            some = np.flatnonzero(n)
            sig = np.zeros((0, values), np.uint32)
            total, cross = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                keep = np.concatenate([edge[some], [len(value)]])
                sig = signatures(value, keep, values)
                total[some] = np.add.reduceat(value, keep[:-1])
                cross[some] = np.bitwise_xor.reduceat(words.mix(value), keep[:-1])
            data = np.full(len(n), None, object)
            data[some] = [s.tobytes() for s in sig]
            yield pd.DataFrame(
                {
                    "id": frame.id.to_numpy(),
                    "th": frame.th.to_numpy(),
                    "n": n.astype(np.int64),
                    "s1": total.view(np.int64),
                    "s2": cross.view(np.int64),
                    "sig": data,
                }
            )

    return describe


def _brancher(trees: int, depth: int):
    def branches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hash of the first ``depth`` values of each tree's order."""
        for frame in frames:
            if frame.empty:
                continue
            sig = np.frombuffer(b"".join(frame.sig), np.uint32).reshape(len(frame), trees, depth).astype(np.uint64)
            key = np.zeros(sig.shape[:2], np.uint64)
            for d in range(depth):
                key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d] + np.uint64(d + 1))
            yield pd.DataFrame({"id": frame.id.to_numpy(), "keys": list(key.view(np.int64))})

    return branches


def _verifier(percent: int):
    keys = ["cluster", "lo", "hi"]

    def linked(value: np.ndarray, edge: np.ndarray, at: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(edge)
        m = len(n)
        if m <= 6:
            i, j = np.triu_indices(m, 1)
            sets = [value[edge[k] : edge[k + 1]] for k in range(m)]
            both = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(i, j, strict=True)])
        else:
            doc = np.repeat(np.arange(m), n)
            order = np.argsort(value, kind="stable")
            v, d = value[order], doc[order]
            _, code, df = np.unique(v, return_inverse=True, return_counts=True)
            shared = df > 1
            column = np.cumsum(shared) - 1
            keep = shared[code]
            code, d = column[code[keep]], d[keep]
            meet = np.zeros((m, m), np.float32)
            step = 8192
            cuts = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0) + step, step))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = np.zeros((m, step), np.float32)
                part[d[a:b], code[a:b] - k * step] = 1
                meet += part @ part.T
            i, j = np.nonzero(np.triu(meet, 1))
            both = np.rint(meet[i, j]).astype(np.int64)
        ok = 100 * both >= percent * (n[i] + n[j] - both)
        if across:
            ok &= at[i] != at[j]
        return i[ok], j[ok]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in words.groups(frames, keys):
            edge = words.borders(frame, keys)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = frame.iloc[a:b]
                value, sets = shingles(part.text)
                i, j = linked(value, sets, part["at"].to_numpy(), part["lo"].iat[0] != part["hi"].iat[0])
                if len(i):
                    root = local_roots(i, j, b - a)
                    inner = np.flatnonzero(root != np.arange(b - a))
                    ids = part.id.to_numpy()
                    yield pd.DataFrame({"a": ids[inner], "b": ids[root[inner]]})

    return verify


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, block_shingles: int = 400_000) -> DataFrame:
    """One row per input row: id, ``th`` (hash of its text), ``n_shingles``, ``component_id``, ``kept``.

    1. Each text gets its set of five-word shingles and a MinHash signature.  Equal sets are
       one class.
    2. The signature is cut into bands (trees), their number and depth following ``percent``.
       Classes that agree in a whole band are a region; every class is tied to its region's
       first.  A pair at ``percent`` shares no region with odds of at most ``MISS``.
    3. What hangs together over all orders is a cluster.  All pairs of a cluster are checked on
       full sets (``100 * intersection >= percent * union``); clusters above
       ``block_shingles`` are cut into blocks, each pair of blocks a group of its own.  A
       group returns a spanning forest of its links.

    Texts that are null or without words have an empty set and link with nothing.  Rows that
    share an id count as one document, rows with a null id if they share the text.  Null ids
    are never preferred; without any id in the component its id is null.  ``kept`` marks the
    rows of the document that leads the component.
    """
    part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    part = part.withColumn("id", F.coalesce("id", free_node(F.col("th"))))
    trees, depth = tree_plan(percent)
    described = part.mapInPandas(_describer(trees * depth), "id long, th long, n long, s1 long, s2 long, sig binary")
    described = stage(described, "shingle-sets")
    filled = described.where("n > 0")
    classes = filled.groupBy("n", "s1", "s2").agg(F.min_by(F.struct("id", "th", "sig"), F.struct("id", "th")).alias("r"))
    classes = stage(classes.select("n", "s1", "s2", "r.id", "r.th", "r.sig"), "shingle-classes")
    branches = classes.select("id", "sig").mapInPandas(_brancher(trees, depth), "id long, keys array<long>")
    branches = stage(branches.select("id", F.posexplode("keys").alias("tree", "key")), "branches")
    regions = branches.groupBy("tree", "key").agg(F.min("id").alias("head"), F.max("id").alias("last"))
    regions = regions.where("head < last").select("tree", "key", "head")
    near = branches.join(regions, ["tree", "key"]).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    cluster = stage(connected_components(near.distinct()).select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    member = classes.select("id", "th", "n").join(cluster, "id")
    weight = cluster.join(classes.select("id", "n"), "id").groupBy("cluster").agg(F.sum("n").alias("weight"))
    weight = weight.select("cluster", F.ceil(F.col("weight") / block_shingles).alias("blocks"))
    member = stage(member.join(weight, "cluster").select("id", "th", "cluster", "blocks"), "cluster-members")
    # texts are shuffled whatever the number of members: a plan that is the same at every size
    sets = part.join(member.hint("merge"), ["id", "th"]).dropDuplicates(["id", "th"])
    sets = sets.withColumn("at", F.pmod(F.xxhash64("id"), "blocks")).withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1)")))
    sets = sets.select("id", "text", "cluster", "at", F.least("at", "o").alias("lo"), F.greatest("at", "o").alias("hi"))
    keys = ["cluster", "lo", "hi"]
    links = sets.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_verifier(percent), "a long, b long")
    same = filled.join(classes.select("n", "s1", "s2", F.col("id").alias("head")), ["n", "s1", "s2"])
    same = stage(same.select("id", "th", "head"), "shingle-copies")
    linked = links.unionByName(same.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    free = F.col("id") == free_node(F.col("th"))
    component = stage(connected_components(linked), "components")
    component = led_by_ids(component, described.select(F.col("id").alias("node"), free.alias("free")))
    out = described.select("id", "th", "n").join(component.withColumnRenamed("node", "id"), "id", "left")
    comp = F.coalesce("component", "id")
    return out.select(
        F.when(~free, F.col("id")).alias(id_col),
        "th",
        F.col("n").alias("n_shingles"),
        F.when(~F.coalesce("idless", free), comp).alias("component_id"),
        (comp == F.col("id")).alias("kept"),
    )
