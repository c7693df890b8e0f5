"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its lower-cased bytes and an end symbol.  Every symbol is a path of binary choices
in a fixed prefix code; contexts of the last three and four bytes and of the word so far
each predict every choice from counts in one hashed table.  A gate (depth in the code, how
many long contexts are known) picks the weights that mix the predictions, and a refinement
table maps the mixed value to what was seen.  Choices depend only on context and symbol, so
equal (contexts, symbol) of a batch are mixed once, and equal pairs of one context and symbol are
counted and looked up once.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import words
from tidegrid.staging import stage

CELLS = 1 << 24
BLOCKS = 256
ORDERS = 3
DEPTHS, KNOWN = 6, 9
GATES = DEPTHS * KNOWN
BUCKETS = 33
STEPS = 1025  # the mixed value is rounded to this many steps for scoring
END = 255
NO_ID = -(1 << 63)
END_TOKEN = np.uint64(0x5EED0FE0D0FDA7A1)
BATCH = 400_000  # characters from which the mixer learns at once
WIDE_BATCH = 1_200_000  # counts and scores don't depend on it; a larger one holds fewer distinct grams for its length
#: Bytes by assumed frequency; the code only has to be a prefix code, this makes it short.
FREQUENT = b" etaoinshrdlcumwfgypbvk\n,.jxqz-'\"0123456789"


def prefix_code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length per symbol, node and choice per symbol and depth, of a Huffman code on assumed frequencies."""
    rank = {b: i for i, b in enumerate(FREQUENT)}
    heap = [(1.0 / (rank.get(s, 60 if s >= 128 else 200) + 2), s, [s]) for s in range(256)]
    heapq.heapify(heap)
    path: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    node = 256
    while len(heap) > 1:
        (p, _, a), (q, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a:
            path[s].append((node, 0))
        for s in b:
            path[s].append((node, 1))
        heapq.heappush(heap, (p + q, node, a + b))
        node += 1
    longest = max(map(len, path))
    nodes, bits = np.zeros((256, longest), np.int64), np.zeros((256, longest), np.int8)
    for s, steps in enumerate(path):
        for d, (n, bit) in enumerate(reversed(steps)):
            nodes[s, d], bits[s, d] = n, bit
    return np.array([len(s) for s in path]), nodes, bits


LENGTH, NODES, BITS = prefix_code()
LEAST = (LENGTH.max() - LENGTH).astype(np.uint8)  # ascending where codes get shorter
NODE_KEYS = np.ascontiguousarray(NODES.T).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Per byte: does a word end after it, and its part in the hashes of words and of grams.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, END])
HEAD = np.arange(1, 257, dtype=np.uint64)
TAIL = HEAD * np.uint64(0xA24BAED4963EE407)


@dataclass
class Order:
    """Distinct (context, symbol) of one kind of context: ``code`` per gram, hashed context and symbol per pair."""

    code: np.ndarray
    context: np.ndarray
    symbol: np.ndarray


@dataclass
class Grams:
    """Distinct (contexts, symbol) of a batch: ``code`` per place, symbol per gram, and the pairs of each context."""

    code: np.ndarray
    symbol: np.ndarray
    edge: np.ndarray
    orders: list[Order]


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each key, in order of appearance, and where each number appears first."""
    code, _ = pd.factorize(key, size_hint=len(key) // 4)
    top = np.maximum.accumulate(code)
    return code, np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])[: len(code)])


def grams(texts: pd.Series) -> Grams:
    raw = [(b"" if t is None else t.encode("utf-8", "surrogatepass")).lower() for t in texts]
    edge = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
    del raw
    n = len(data)
    packed = np.zeros(n, np.uint32)  # the last four bytes of the same text, the nearest lowest
    before = data
    for j in range(4):
        before = np.concatenate([np.zeros(1, np.uint8), before[:-1]])
        before[edge[:-1]] = 0
        packed |= before.astype(np.uint32) << np.uint32(8 * j)
    start = np.flatnonzero(np.concatenate([[True], BLANK[data[:-1]]]))
    size = np.diff(start, append=n)
    prefix = words.powers(np.uint64(0x9E3779B97F4A7C15), n + 1)[:n] * HEAD[data]
    total = np.zeros(n, np.uint64)
    np.cumsum(prefix[:-1], out=total[1:])
    back = words.powers(np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), n + 1)[start]
    prefix = np.subtract(total, np.repeat(total[start], size), out=total)
    prefix *= np.repeat(back, size)
    del before, start, size, back, total
    key = packed * np.uint64(0xD6E8FEB86659FD93)
    key ^= prefix
    key *= np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(31)
    key += TAIL[data]
    code, first = _numbered(key)
    del key
    # longer codes first, so that the grams with a choice at some depth are a slice
    order = np.argsort(LEAST[data[first]], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = first[order]
    symbol, four, word = data[first], packed[first].astype(np.uint64), prefix[first]
    del packed, prefix
    kinds = (four & np.uint64(0xFFFFFF), four, word)
    orders = []
    for i, kind in enumerate(kinds):
        # in order of appearance, so the pairs have longer codes first, too
        own, at = _numbered(kind + (symbol.astype(np.uint64) << np.uint64(32)) if i < 2 else kind + TAIL[symbol])
        orders.append(Order(own, words.mix(kind[at] * np.uint64(8) + np.uint64(i)), symbol[at]))
    return Grams(place[code], symbol, edge, orders)


def deep(symbol: np.ndarray, depth: int) -> int:
    """How many of the symbols, from the first, have a choice at this depth."""
    return bisect.bisect_left(symbol, LENGTH.max() - depth, key=LEAST.__getitem__)


def cells(o: Order, depth: int, n: int) -> np.ndarray:
    """Cell of the choice at this depth for each of the first ``n`` pairs."""
    x = (o.context[:n] ^ NODE_KEYS[depth][o.symbol[:n]]) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).view(np.int64)  # 24 bits: CELLS


def _counter(fold: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of both choices per cell over the texts of a partition."""
        counts = np.zeros((2, CELLS), np.uint32)
        flat, codec = counts.reshape(-1), pa.Codec("zstd", 1)
        for frame in words.batches(frames, most=WIDE_BATCH):
            g = grams(frame.text)
            weight = np.bincount(g.code, minlength=len(g.symbol))
            for o in g.orders:
                own = np.bincount(o.code, weight, len(o.symbol)).astype(np.uint32)
                for depth in range(LENGTH.max()):
                    n = deep(o.symbol, depth)
                    side = BITS[o.symbol[:n], depth].astype(np.int64) * CELLS
                    np.add.at(flat, cells(o, depth, n) + side, own[:n])
        for k, part in enumerate(np.split(counts, BLOCKS, axis=1)):
            if part.any():
                yield pd.DataFrame({"block": [k], "fold": [fold], "data": [codec.compress(part.tobytes(), asbytes=True)]})

    return count


def _totals(block: pd.DataFrame) -> pd.DataFrame:
    """Log odds per cell from the summed counts: of the first share alone, and of all rows."""
    total, codec = np.zeros((2, 2, CELLS // BLOCKS), np.int64), pa.Codec("zstd")
    for fold, data in zip(block.fold, block.data, strict=True):
        total[fold] += np.frombuffer(codec.decompress(data, total[0].size * 4), np.uint32).reshape(2, -1)

    def odds(n: np.ndarray) -> bytes:
        value = np.log((n[1] + 0.15) / (n[0] + 0.15))
        value[(value == 0) & (n.sum(axis=0) > 0)] = 1e-4  # known, but even
        return value.astype(np.float16).tobytes()

    return pd.DataFrame({"block": [block.block.iat[0]], "part": [odds(total[0])], "whole": [odds(total[0] + total[1])]})


@dataclass
class Mixer:
    weights: np.ndarray  # GATES x ORDERS
    refine: np.ndarray  # GATES x BUCKETS probabilities

    @staticmethod
    def fresh() -> Mixer:
        middle = np.linspace(-8, 8, BUCKETS)
        return Mixer(np.full((GATES, ORDERS), 0.35), np.tile(1 / (1 + np.exp(-middle)), (GATES, 1)))


def pair_inputs(g: Grams, table: np.ndarray, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log odds of the pairs with a choice at this depth, and of long contexts: 0 if unknown, 1 if weak, 2 if strong."""
    x = [table[cells(o, depth, deep(o.symbol, depth))].astype(np.float32) for o in g.orders]
    sure = [np.abs(v) for v in x[-2:]]
    return x, [(v > 0).astype(np.int64) + (v > 2) for v in sure]


def inputs(g: Grams, pairs: tuple[list[np.ndarray], list[np.ndarray]], depth: int, rows: np.ndarray | slice) -> tuple[list[np.ndarray], np.ndarray]:
    """Log odds and gate of the grams ``rows``, from those of their pairs."""
    code = [o.code[rows] for o in g.orders]
    x = [v[c] for v, c in zip(pairs[0], code, strict=True)]
    high, low = (k[c] for k, c in zip(pairs[1], code[-2:], strict=True))
    high *= 3
    high += low
    high += min(depth, DEPTHS - 1) * KNOWN
    return x, high


def squash(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -20, 20)))


def log_probability(g: Grams, table: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 probability of every text of the batch."""
    out = np.zeros(len(g.symbol), np.float32)
    weights = mixer.weights.T.astype(np.float32).copy()
    grid = np.linspace(-8, 8, STEPS)
    coarse = np.rint((grid + 8) * (BUCKETS - 1) / 16).astype(np.int64)
    one = np.clip((squash(grid) + mixer.refine[:, coarse]) / 2, 1e-6, 1 - 1e-6)
    value = np.log10(np.stack([1 - one, one])).astype(np.float32).reshape(-1)
    for depth in range(LENGTH.max()):
        n = deep(g.symbol, depth)
        if not n:
            break
        x, at = inputs(g, pair_inputs(g, table, depth), depth, slice(0, n))
        s = weights[0][at]
        s *= x[0]
        for j in range(1, ORDERS):
            x[j] *= weights[j][at]
            s += x[j]
        np.clip(s, -8, 8, out=s)
        s += 8
        s *= (STEPS - 1) / 16
        at += (BITS[:, depth].astype(np.int64) * GATES)[g.symbol[:n]]
        at *= STEPS
        at += np.rint(s, out=s).astype(np.int64)
        out[:n] += value[at]
    return np.add.reduceat(out[g.code].astype(np.float64), g.edge[:-1])


def _learner(table, rate: float = 1.0, share: int = 10_000):
    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Weights learned online over the partition's texts, and what the refinement table saw."""
        odds, mixer = table.value, Mixer.fresh()
        seen = np.zeros(GATES)
        curve = np.full((GATES, ORDERS), 300.0)  # curvature so far: steps get smaller as evidence grows
        hits = np.zeros((2, GATES, BUCKETS))
        for frame in words.batches(frames, most=BATCH):
            g = grams(frame.text)
            weight = np.bincount(g.code, minlength=len(g.symbol)).astype(np.float64)
            order = np.random.default_rng(3).permutation(len(g.symbol))
            pairs = [pair_inputs(g, odds, depth) for depth in range(LENGTH.max())]
            for at in range(0, len(order), share):
                some = order[at : at + share]
                for depth in range(LENGTH.max()):
                    rows = some[LENGTH[g.symbol[some]] > depth]
                    if not len(rows):
                        break
                    x, gate = inputs(g, pairs[depth], depth, rows)
                    x = np.stack(x)
                    s = np.einsum("jn,nj->n", x, mixer.weights[gate])
                    bit, w = BITS[g.symbol[rows], depth], weight[rows]
                    bucket = np.rint((np.clip(s, -8, 8) + 8) * (BUCKETS - 1) / 16).astype(np.int64)
                    for choice in (0, 1):
                        own = bit == choice
                        hits[choice] += np.bincount(gate[own] * BUCKETS + bucket[own], w[own], GATES * BUCKETS).reshape(GATES, BUCKETS)
                    p = squash(s)
                    wrong, bend = (bit - p) * w, p * (1 - p) * w
                    mass = np.bincount(gate, w, GATES)
                    for j in range(ORDERS):
                        slope = np.bincount(gate, wrong * x[j], GATES)
                        curve[:, j] += np.bincount(gate, bend * x[j] ** 2, GATES)
                        mixer.weights[:, j] += rate * slope / curve[:, j]
                    seen += mass
        rows = [(gate, j, mixer.weights[gate, j] * seen[gate], seen[gate]) for gate in range(GATES) for j in range(ORDERS) if seen[gate]]
        rows += [(gate, 100 + k, hits[1, gate, k], hits[:, gate, k].sum()) for gate in range(GATES) for k in range(BUCKETS) if hits[:, gate, k].any()]
        if rows:
            yield pd.DataFrame(rows, columns=["gate", "item", "total", "n"])

    return learn


def collect_mixer(learned: DataFrame) -> Mixer:
    """Averages over all tasks; at most GATES * (ORDERS + BUCKETS) rows."""
    mixer = Mixer.fresh()
    for r in learned.groupBy("gate", "item").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        if r.item < 100:
            mixer.weights[r.gate, r.item] = r.total / r.n
        else:
            prior = mixer.refine[r.gate, r.item - 100]
            mixer.refine[r.gate, r.item - 100] = (r.total + 20 * prior) / (r.n + 20)
    return mixer


def _tokens(block_chars: int):
    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of kind 1: the texts, in blocks; rows of kind 0: every token of a block and its count in training texts."""
        from pyspark import TaskContext

        task, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dictionary() -> pd.DataFrame:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            code, value = pd.factorize(h)
            count = np.bincount(code, n, len(value)).astype(np.int64)
            own = pd.DataFrame({"block": (task << 24) + number, "kind": 0, "h": value.view(np.int64), "n": count})
            return own.assign(id=0, text=None, held=False)

        for frame in words.batches(frames):
            w = words.split(frame.text, lower=True)
            train = ~frame.held.to_numpy()
            doc = np.repeat(np.arange(len(frame)), np.diff(w.first))
            h = np.concatenate([w.hashes(), np.full(len(frame), END_TOKEN)])
            code, value = pd.factorize(h)
            held.append((value, np.bincount(code, np.concatenate([train[doc], train]), len(value))))
            yield frame.assign(block=(task << 24) + number, kind=1, h=0, n=0).drop(columns="fold")
            size += int(frame.text.str.len().fillna(0).sum()) + 1
            if size >= block_chars:
                yield dictionary()
                number, size, held = number + 1, 0, []
        if held:
            yield dictionary()

    return tokens


def _scorer(table, mixer: Mixer, n: int, v: int):
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds = table.value
        held: list[pd.DataFrame] = []
        known: tuple[np.ndarray, np.ndarray] | None = None
        for frame in frames:
            edge = words.borders(frame, ["block", "kind"]) if len(frame) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                part = frame.iloc[a:b]
                if part.kind.iat[0] == 0:
                    if known is not None:
                        held, known = [], None
                    held.append(part[["h", "n"]])
                    continue
                if known is None:
                    all_ = pd.concat(held)
                    h = all_.h.to_numpy(np.int64).view(np.uint64)
                    order = np.argsort(h)
                    known = h[order], all_.n.to_numpy(np.int64)[order]
                for texts in words.batches(iter([part]), most=WIDE_BATCH):
                    w = words.split(texts.text, lower=True)
                    words_of = np.diff(w.first)
                    doc = np.concatenate([np.repeat(np.arange(len(texts)), words_of), np.arange(len(texts))])
                    h = np.concatenate([w.hashes(), np.full(len(texts), END_TOKEN)])
                    code, h = pd.factorize(h)
                    at = np.searchsorted(known[0], h)
                    if (known[0][np.minimum(at, len(known[0]) - 1)] != h).any():
                        raise ValueError("a token of the block is not in its dictionary")
                    c = known[1][at]
                    log = np.log10((c + 1) / (n + (v + 1)))[code]
                    g = grams(texts.text)
                    yield pd.DataFrame(
                        {
                            "id": texts.id.to_numpy(),
                            "held_out": texts.held.to_numpy(),
                            "n_tokens": words_of + 1,
                            "n_known": np.bincount(doc, (c > 0)[code], len(texts)).astype(np.int64),
                            "base_score": np.bincount(doc, log, len(texts)),
                            "score": log_probability(g, odds, mixer),
                            "n_bytes": np.diff(g.edge) - 1,
                        }
                    )

    return score


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_chars: int = 12_000_000) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Learning uses the rows whose crc32(id) mod 7 is not 2.  All of them feed the count table
    (2**24 cells, summed cell block by cell block).  The mixer learns online on those with
    crc32(id) mod 28 = 6, predicted by counts of the others; scores use the counts of all.  What reaches
    the driver or is broadcast is the table of log odds and the mixer, of fixed size.

    Base counts stay distributed: each block of texts lists its tokens once, the lists are summed
    by token, and each block gets its own counts back.  Null texts are empty, that is the end
    token alone; rows with a null id are training rows.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    crc = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7))
    part = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(crc == 2, F.lit(False)).alias("held"),
        F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(28)) == 6, F.lit(False)).cast("int").alias("fold"),
    )
    # a task's counts are as large as the table, so tasks are as many as run at once
    width = 2 * spark.sparkContext.defaultParallelism
    learning = part.where("not held")
    counted = [learning.where(F.col("fold") == k).select("text").coalesce(width).mapInPandas(_counter(k), "block int, fold int, data binary") for k in (0, 1)]
    counted = counted[0].unionByName(counted[1])
    odds = counted.groupBy("block").applyInPandas(_totals, "block int, part binary, whole binary")
    with words.arrow_rows(spark, 500):
        rows = stage(odds, "log-odds").collect()  # BLOCKS rows, 64 MB in all
    empty = bytes(CELLS // BLOCKS * 2)
    by = {r.block: r for r in rows}
    tables = [
        np.frombuffer(b"".join(bytes(by[k][side]) if k in by else empty for k in range(BLOCKS)), np.float16)
        for side in ("part", "whole")
    ]
    first, whole = (spark.sparkContext.broadcast(t) for t in tables)
    del rows, by, tables
    learned = learning.where("fold = 1").select("text").mapInPandas(_learner(first), "gate int, item int, total double, n double")
    with words.arrow_rows(spark, 500):
        mixer = collect_mixer(learned)
    first.unpersist()

    listed = part.mapInPandas(_tokens(block_chars), "id long, text string, held boolean, block long, kind int, h long, n long")
    listed = stage(listed, "token-blocks")
    per_token = Window.partitionBy("h")  # at most one row per block
    tokens = listed.where("kind = 0").select("block", "h", "n")
    tokens = tokens.withColumn("c", F.sum("n").over(per_token)).withColumn("first", F.col("block") == F.min("block").over(per_token))
    tokens = stage(tokens.select("block", "h", "c", "first"), "token-counts")
    size = tokens.where("first").agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1))).first()
    n, v = size[0] or 0, size[1] or 0
    lists = tokens.select("block", F.lit(0).alias("kind"), "h", F.col("c").alias("n"), F.lit(0).cast("long").alias("id"), F.lit(False).alias("held"))
    texts = listed.where("kind = 1").select("block", "kind", "h", "n", "id", "text", "held")
    both = texts.unionByName(lists, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    kind = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    scored = both.mapInPandas(_scorer(whole, mixer, n, v), kind)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * np.log2(10.0) / F.col("n_bytes"))
    return scored.select(
        F.when(F.col("id") > NO_ID, F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte")
    )
