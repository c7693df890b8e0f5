"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import connected_components, free_node, led_by_ids, local_roots
from tidegrid.llm.vectors import classes, matrix, unit
from tidegrid.llm.words import borders, groups
from tidegrid.staging import stage


def table_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per key and number of tables.

    Random vectors share a key of ``b`` bits with odds 2**-b, so about 16 of ``n`` meet per
    key at ``log2(n / 16)`` bits; as many tables are taken as a pair exactly at the threshold
    needs to meet once with odds ``recall``.
    """
    bits = min(30, max(8, math.ceil(math.log2(max(n, 1) / 16))) if n > 16 else 8)
    same = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def _signer(bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        for frame in frames:
            for dim, part in frame.groupby(frame.vec.str.len()):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                x = unit(matrix(part.vec))
                keys = ((x @ planes[dim] > 0).reshape(len(x), tables, bits) @ weights).astype(np.int32)
                yield pd.DataFrame(
                    {
                        "rep": part.rep.to_numpy(),
                        "cnt": part.cnt.to_numpy(),
                        "dim": np.int32(dim),
                        "vec": [v.tobytes() for v in x],
                        "sig": [k.tobytes() for k in keys],
                        "keys": list(keys),
                    }
                )

    return sign


def _linker(threshold: float):
    keys = ["t", "key", "dim", "lo", "hi"]

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(frames, keys):
            edge = borders(frame, keys)
            rep, cnt, t, at, lo, hi = (frame[c].to_numpy() for c in ("rep", "cnt", "t", "at", "lo", "hi"))
            out: list[pd.DataFrame] = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                x = np.frombuffer(b"".join(frame.vec.iloc[a:b])).reshape(b - a, -1)
                near = x @ x.T >= threshold
                i, j = np.nonzero(np.triu(near, 1))
                if lo[a] != hi[a]:  # two blocks of a hot key: only pairs across
                    across = at[a:b][i] != at[a:b][j]
                    i, j = i[across], j[across]
                if not len(i):
                    continue
                sig = np.frombuffer(b"".join(frame.sig.iloc[a:b]), np.int32).reshape(b - a, -1)[:, : t[a]]
                fresh = ~(sig[i] == sig[j]).any(axis=1) if t[a] else np.ones(len(i), bool)
                i, j = i[fresh], j[fresh]  # a pair counts in the first table where it meets
                if not len(i):
                    continue
                c = cnt[a:b]
                n = np.bincount(i, c[j], b - a) + np.bincount(j, c[i], b - a)
                has = np.flatnonzero(n)
                root = local_roots(i, j, b - a)
                out.append(pd.DataFrame({"rep": rep[a:b][has], "links": n[has].astype(np.int64), "root": rep[a:b][root[has]]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return link


def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    recall: float = 0.99,
    block_rows: int = 512,
    seed: int = 5,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are one class with a count.  Each class is hashed into every table; keys
    that hold more than ``block_rows`` classes are cut into blocks, and each pair of blocks is
    a group of its own.  All pairs of a group are compared exactly, but a group returns one
    row per linked class (partners counted, a local root), never the pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors of
    another length, link with nothing; such a row is its own component.  Rows with a null id
    keep null in ``component_id`` and are kept.  Rows that share an id share a component.
    """
    part = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    found = classes(rows, id_col, vector).withColumn("free", F.col("rep").isNull())
    found = stage(found.withColumn("rep", F.coalesce("rep", free_node(F.col("h")))), "vector-classes")
    bits, tables = table_plan(found.count(), threshold, recall)
    width = max(4, rows.sparkSession.sparkContext.defaultParallelism)
    signed = found.select("rep", "cnt", "vec").repartition(width, "rep").mapInPandas(
        _signer(bits, tables, seed), "rep long, cnt long, dim int, vec binary, sig binary, keys array<int>"
    )
    signed = stage(signed, "vector-keys")
    hot = signed.select(F.posexplode("keys").alias("t", "key"), "dim").groupBy("t", "key", "dim").count()
    hot = hot.where(F.col("count") > block_rows).withColumn("n", F.ceil(F.col("count") / block_rows)).drop("count")
    dealt = signed.select("rep", "cnt", "vec", "sig", F.posexplode("keys").alias("t", "key"), "dim")
    dealt = dealt.join(hot, ["t", "key", "dim"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("rep"), "n")).withColumn("o", F.explode(F.expr("sequence(0L, n - 1)")))
    dealt = dealt.withColumn("lo", F.least("at", "o")).withColumn("hi", F.greatest("at", "o"))
    keys = ["t", "key", "dim", "lo", "hi"]
    links = dealt.repartition(*keys).sortWithinPartitions(*keys)
    links = links.select("rep", "cnt", "vec", "sig", "at", *keys)
    links = stage(links.mapInPandas(_linker(threshold), "rep long, links long, root long"), "vector-links")
    component = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    component = led_by_ids(stage(component, "components"), found.select(F.col("rep").alias("node"), "free"))
    tally = links.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = (
        found.select("h", "vec", "rep", "cnt", "free")
        .join(tally, "rep", "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
    )
    per_class = per_class.select(
        "h",
        "vec",
        (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("component", "rep").alias("c"),
        F.coalesce("idless", "free").alias("idless"),
    )
    out = part.withColumn("h", F.xxhash64("vec")).join(per_class, ["h", "vec"], "left")
    node = F.coalesce("id", F.when(F.col("c").isNotNull(), free_node(F.col("h"))))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("idless"), F.lit(None)).otherwise(F.coalesce("c", "id")).alias("component_id"),
        F.coalesce("c", "id").eqNullSafe(node).alias("kept"),
    )
