"""Nearest neighbours by robust-pruned directed graphs, one per shard, searched by beam."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.vectors import unit, usable
from tidegrid.llm.words import borders, groups
from tidegrid.staging import stage

ROW = "shard long, kind int, id long, members array<long>, vec binary, links binary"


def beam(x: np.ndarray, links: np.ndarray, start: int, q: np.ndarray, width: int, grow: int = 4) -> np.ndarray:
    """Places in ``x`` that beam search keeps for each query, nearest first, -1 where fewer are reachable.

    All queries move in step: each expands its ``grow`` nearest open nodes, looks at their
    links and keeps the best ``width`` nodes seen, until nothing is open.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n + 1), bool)
    seen[:, [start, n]] = True
    ids = np.full((m, width), n, np.int64)
    near = np.full((m, width), -np.inf, np.float32)
    shut = np.ones((m, width), bool)
    ids[:, 0], near[:, 0], shut[:, 0] = start, q @ x[start], False
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    while True:
        live = np.flatnonzero(~shut.all(axis=1))
        if not len(live):
            return np.where(ids == n, -1, ids)
        pick = np.argsort(shut[live], axis=1, kind="stable")[:, :grow]
        r = live[:, None]
        chosen = np.where(shut[r, pick], n, ids[r, pick])
        shut[r, pick] = True
        new = np.where(chosen[:, :, None] < n, links[np.minimum(chosen, n - 1)], n).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[r, new]] = n
        seen[r, new] = True
        score = np.matmul(padded[new], q[live][:, :, None])[:, :, 0]
        score[new == n] = -np.inf
        all_ids = np.concatenate([ids[live], new], axis=1)
        all_near = np.concatenate([near[live], score], axis=1)
        all_shut = np.concatenate([shut[live], new == n], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        at = np.arange(len(live))[:, None]
        ids[live], near[live], shut[live] = all_ids[at, best], all_near[at, best], all_shut[at, best]


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Up to ``degree`` diverse links per node from its candidates (-1: none).

    The nearest candidate is linked; candidates ``c`` with ``slack * d(link, c) <= d(node, c)``
    are dropped, as the link leads there; and so on.
    """
    m = len(own)
    cand = np.where(cand == own[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    vec = x[np.maximum(cand, 0)]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vec, x[own][:, :, None])[:, :, 0]))
    far[cand < 0] = np.inf
    out = np.full((m, degree), -1, np.int64)
    at = np.arange(m)
    for k in range(degree):
        first = far.argmin(axis=1)
        some = np.isfinite(far[at, first])
        if not some.any():
            break
        link = cand[at, first]
        out[some, k] = link[some]
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vec, x[link][:, :, None])[:, :, 0]))
        far[slack * gap <= far] = np.inf
        far[at, first] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int, width: int, slack: float, seed: int, batch: int = 256) -> tuple[np.ndarray, int]:
    """Links (n x degree, padded with the node itself) and the entry node, nearest to the mean."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int((x @ x.mean(axis=0)).argmax())
    if n <= degree + 1:
        links = np.tile(np.arange(n), (n, 1))
        return links, start
    links = rng.integers(0, n, (n, degree))
    for relaxed in (1.0, slack):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            found = beam(x, links, start, x[own], width)
            links[own] = _filled(robust_prune(x, own, np.concatenate([found, links[own]], axis=1), degree, relaxed), own)
            # links back: a node weighs its own links against the nodes that now point to it
            target, source = links[own].ravel(), np.repeat(own, degree)
            true = target != source
            target, source = target[true], source[true]
            rank = np.argsort(target, kind="stable")
            target, source = target[rank], source[rank]
            node, first, count = np.unique(target, return_index=True, return_counts=True)
            slot = np.arange(len(target)) - np.repeat(first, count)
            back = np.full((len(node), degree), -1, np.int64)
            fits = slot < degree
            back[np.repeat(np.arange(len(node)), count)[fits], slot[fits]] = source[fits]
            links[node] = _filled(robust_prune(x, node, np.concatenate([links[node], back], axis=1), degree, relaxed), node)
    return links, start


def _filled(links: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.where(links < 0, own[:, None], links)


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame.vec)).reshape(len(frame), -1)


def _builder(degree: int, width: int, slack: float):
    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(frames, ["shard"]):
            edge = borders(frame, ["shard"])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = frame.iloc[a:b].sort_values("id", ignore_index=True)
                x = unit(_vectors(part)).astype(np.float32)
                links, start = build_graph(x, degree, width, slack, int(part.shard.iat[0]) & 0xFFFF)
                # the entry node comes first in the stored order, the others by id
                order = np.concatenate([[start], np.delete(np.arange(len(x)), start)])
                place = np.argsort(order)
                part = part.iloc[order].assign(links=[r.astype(np.int32).tobytes() for r in place[links[order]]], kind=0)
                part["place"] = np.arange(len(part), dtype=np.int32)
                yield part[["shard", "kind", "place", "id", "members", "vec", "links"]]

    return build


def _searcher(k: int, width: int, batch: int = 256):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        graph: tuple | None = None
        for frame in frames:
            edge = borders(frame, ["shard", "kind"]) if len(frame) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = frame.iloc[a:b]
                if part.kind.iat[0] == 0:
                    if held and held[0].shard.iat[0] != part.shard.iat[0]:
                        held = []
                    held.append(part)
                    graph = None
                    continue
                if not held or held[0].shard.iat[0] != part.shard.iat[0]:
                    continue  # no vectors of this length in the shard
                if graph is None:
                    nodes = pd.concat(held, ignore_index=True)
                    raw = _vectors(nodes)
                    links = np.frombuffer(b"".join(nodes.links), np.int32).reshape(len(nodes), -1).astype(np.int64)
                    graph = (nodes, unit(raw), links)
                nodes, exact, links = graph
                small = exact.astype(np.float32)
                for at in range(0, len(part), batch):
                    some = part.iloc[at : at + batch]
                    q = unit(_vectors(some))
                    found = beam(small, links, 0, q.astype(np.float32), min(width, len(nodes)))
                    row, col = np.nonzero(found >= 0)
                    node = found[row, col]
                    score = (q[row] * exact[node]).sum(axis=1)
                    best = pd.DataFrame({"row": row, "node": node, "score": score}).sort_values(["row", "score"], ascending=[True, False])
                    # ties at the end of the list all stay: equal scores go by id later
                    edge_score = best.groupby("row").score.transform(lambda s: s.iloc[min(k, len(s) - 1)])
                    best = best[best.score >= edge_score]
                    yield pd.DataFrame(
                        {
                            "query_id": some.id.to_numpy()[best.row],
                            "members": nodes.members.to_numpy()[best.node],
                            "score": best.score.to_numpy(),
                        }
                    )

    return search


def build_index(rows: DataFrame, id_col: str, vector: str, k: int, shard_rows: int, degree: int, width: int, slack: float) -> tuple[DataFrame, int]:
    """One row per distinct vector with its links, in shards of about ``shard_rows``; and the number of shards.

    Equal vectors are one node with its ``k + 1`` smallest ids: no others can be among the
    ``k`` nearest of anything.
    """
    part = rows.where(usable(vector) & F.col(id_col).isNotNull())
    part = part.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    part = part.withColumn("h", F.xxhash64("v"))
    part = part.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = part.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("members"))
    nodes = stage(nodes, "vector-nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    shard = F.size("v").cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.element_at("members", 1)), F.lit(shards))
    dealt = nodes.select(shard.alias("shard"), F.element_at("members", 1).alias("id"), "members", "v")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    packed = dealt.mapInPandas(_bytes, "shard long, id long, members array<long>, vec binary")
    kind = "shard long, kind int, place int, id long, members array<long>, vec binary, links binary"
    return stage(packed.mapInPandas(_builder(degree, width, slack), kind), "vector-graph"), shards


def _bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(vec=[np.asarray(v, np.float64).tobytes() for v in frame.v])[["shard", "id", "members", "vec"]]


def nearest(
    rows: DataFrame,
    every: int = 50,
    k: int = 5,
    id_col: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 2048,
    degree: int = 24,
    width: int = 64,
    slack: float = 1.2,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Every shard's graph is searched for every query; queries pass through a shard in batches,
    so a task holds one shard and one batch.  Scores are exact cosines in double precision;
    ties go to the smaller id.  Vectors that are null, empty, zero, or hold null or
    non-finite components, and rows with a null id, take no part; vectors of another length
    are no candidates.  Repeated rows count once.  Fewer candidates give fewer rows.
    """
    graph, shards = build_index(rows, id_col, vector, k, shard_rows, degree, width, slack)
    queries = rows.where(usable(vector) & (F.pmod(F.col(id_col), F.lit(every)) == 0))
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    queries = queries.withColumn("shard", F.size("v").cast("long") * (1 << 32))
    packed = queries.withColumn("members", F.array().cast("array<long>")).select("shard", "id", "members", "v")
    packed = packed.mapInPandas(_bytes, "shard long, id long, members array<long>, vec binary")
    sent = packed.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = sent.select((F.col("shard") + F.col("s")).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("place"), "id", "members", "vec", F.lit(b"").alias("links"))
    both = graph.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "kind", "place")
    found = both.mapInPandas(_searcher(k, width), "query_id long, members array<long>, score double")
    found = found.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
