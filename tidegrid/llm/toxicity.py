"""Toxicity by a gapped string-kernel support vector machine over Nyström landmarks.

The unit is a word, letters and digits only, so that ``i.d.i.o.t`` is ``idiot``; runs of three
or more single letters count as one more word.  The kernel compares ordered triples of
letters with up to ``GAP`` letters left out between neighbours, each left-out letter costing a
factor ``DECAY``: inserted or missing letters lower similarity, they do not end it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import words
from tidegrid.staging import stage

GAP, DECAY = 2, 0.6
KEYS = 1 << 18
COST = 3_000
MARK = 63  # start and end of a word

_LETTER = np.zeros(256, np.uint8)  # 0: left out; 1-26 letters, 27 digits, 28-62 bytes beyond ASCII
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_LETTER[48:58] = 27
_LETTER[128:192] = 28 + np.arange(64) % 35


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of some words in one array, and the borders of the words."""
    n = ends - starts
    place = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    code = _LETTER[data[place]]
    owner = np.repeat(np.arange(len(n)), n)[code > 0]
    code, edge = code[code > 0], np.searchsorted(owner, np.arange(len(n) + 1))
    some = np.flatnonzero(np.diff(edge))  # each word gets a mark at both ends, words without letters stay empty
    marked = np.insert(code, np.stack([edge[some], edge[some + 1]], axis=1).ravel(), MARK)
    return marked, edge + 2 * np.searchsorted(some, np.arange(len(n) + 1))


def triples(code: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """``(word, key, weight)`` of all gapped triples, one gap pattern at a time."""
    owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    room = edge[1:][owner] - np.arange(len(code)) if len(code) else np.zeros(0, np.int64)
    wide = code.astype(np.int32)
    for g in range(GAP + 1):
        for h in range(GAP + 1):
            at = np.flatnonzero(room > g + h + 2)
            yield owner[at], wide[at] << 12 | wide[at + g + 1] << 6 | wide[at + g + h + 2], DECAY ** (g + h)


def norms(code: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.zeros(len(edge) - 1)
    for word, _, weight in triples(code, edge):
        total += np.bincount(word, minlength=len(total)) * weight**2
    return np.sqrt(np.maximum(total, 1e-12))


@dataclass
class Model:
    weight: np.ndarray  # per key: the landmarks' triples, weighted by the machine
    bias: float
    head: np.ndarray | None  # logistic weights of a text's features
    base: float  # score where nothing could be learned

    def words(self, code: np.ndarray, edge: np.ndarray) -> np.ndarray:
        value = np.zeros(len(edge) - 1)
        for word, key, weight in triples(code, edge):
            value += np.bincount(word, self.weight[key], len(value)) * weight
        return value / norms(code, edge) + self.bias

    def features(self, texts: pd.Series) -> np.ndarray:
        """Per text: largest word margin, logs of the numbers of positive and of sure words, share of the latter."""
        w = words.split(texts, lower=True)
        w = with_spelled_words(w)
        out = np.zeros((len(w.first) - 1, 4))
        out[:, 0] = -3.0
        if not len(w.starts):
            return out
        code, value = pd.factorize(w.hashes())
        first = np.full(len(value), -1)
        first[code[::-1]] = np.arange(len(code))[::-1]
        margin = self.words(*letters(w.data, w.starts[first], w.ends[first]))[code]
        some = np.flatnonzero(np.diff(w.first))
        out[some, 0] = np.clip(np.maximum.reduceat(margin, w.first[some]), -3, 3)
        hits = np.add.reduceat((margin > 0).astype(np.float64), w.first[some])
        out[some, 1] = np.log1p(hits)
        sure = np.add.reduceat((margin > 0.5).astype(np.float64), w.first[some])
        out[some, 2] = np.log1p(sure)
        out[some, 3] = np.log1p(100 * sure / np.diff(w.first)[some])
        return out

    def score(self, texts: pd.Series) -> np.ndarray:
        if self.head is None:
            return np.full(len(texts), self.base)
        x = self.features(texts)
        return 1 / (1 + np.exp(-(x @ self.head[:-1] + self.head[-1])))


def with_spelled_words(w: words.Words) -> words.Words:
    """Runs of at least three one-letter words are words too, put after the run's own."""
    n = len(w.starts)
    if n < 3:
        return w
    one = (w.ends - w.starts == 1) & (_LETTER[w.data[w.starts]] > 0)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    joins = one[1:] & one[:-1] & (doc[1:] == doc[:-1])
    edge = np.diff(np.concatenate([[0], joins.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_ = b - a >= 2
    a, b = a[long_], b[long_]
    if not len(a):
        return w
    starts, ends = np.insert(w.starts, b + 1, w.starts[a]), np.insert(w.ends, b + 1, w.ends[b])
    return words.Words(w.data, starts, ends, w.first + np.searchsorted(b, w.first, side="left"))


def _statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(word, toxic, group)`` once per text; texts with the same smallest three-word hash are one group."""
    for frame in words.batches(frames):
        w = words.split(frame.text, lower=True)
        h = w.hashes()
        run = words.window_hashes(h, 3)
        doc = np.repeat(np.arange(len(frame)), np.diff(w.first))
        inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
        group = np.zeros(len(frame), np.uint64)
        if len(inside):
            cut = np.flatnonzero(np.diff(doc[inside], prepend=-1))
            group[doc[inside][cut]] = np.minimum.reduceat(run[inside], cut)
        pair = pd.DataFrame({"doc": doc, "h": h, "at": np.arange(len(h))}).drop_duplicates(["doc", "h"])
        data = w.data.tobytes()
        text = [data[s:e].decode("utf-8", "replace") for s, e in zip(w.starts[pair["at"]].tolist(), w.ends[pair["at"]].tolist(), strict=True)]
        yield pd.DataFrame({"word": text, "toxic": frame.toxic.to_numpy()[pair.doc], "grp": group[pair.doc].view(np.int64)})


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(n)
    return letters(np.frombuffer(b"".join(raw), np.uint8), ends - n, ends)


def train_machine(
    positive: list[str], negative: list[str], weights: np.ndarray, landmarks: int, seed: int = 4
) -> tuple[np.ndarray, float]:
    """Kernel machine on words: weights per triple key and the bias.

    Each positive word is shown twice more with a letter put in at random.  Squared hinge loss
    on Nyström features, both classes of equal total weight, by Newton steps.
    """
    rng = np.random.default_rng(seed)

    def disturbed(word: str) -> str:
        at = int(rng.integers(1, max(2, len(word))))
        return word[:at] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + word[at:]

    shown = positive + [disturbed(w) for w in positive for _ in range(2)]
    y = np.concatenate([np.ones(len(shown)), -np.ones(len(negative))])
    # half of the landmarks from each class, evenly over lists that are sorted by weight
    pick = [positive[i] for i in np.unique(np.linspace(0, len(positive) - 1, landmarks // 2).astype(int))]
    pick += [negative[i] for i in np.unique(np.linspace(0, len(negative) - 1, landmarks // 2).astype(int))]
    code, edge = _codes(pick)
    size = norms(code, edge)
    used = np.unique(np.concatenate([key for _, key, _ in triples(code, edge)]))
    column = np.full(KEYS, -1)
    column[used] = np.arange(len(used))
    mark = np.zeros((len(pick), len(used)), np.float32)
    for word, key, weight in triples(code, edge):
        np.add.at(mark, (word, column[key]), weight / size[word])

    def kernel(texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 1000):
            code, edge = _codes(texts[at : at + 1000])
            part = np.zeros((len(edge) - 1, len(used)), np.float32)
            for word, key, weight in triples(code, edge):
                known = column[key] >= 0
                np.add.at(part, (word[known], column[key[known]]), weight)
            out.append(part @ mark.T / norms(code, edge)[:, None])
        return np.concatenate(out)

    value, vector = np.linalg.eigh(mark.astype(np.float64) @ mark.T.astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = np.hstack([kernel(shown + negative) @ root, np.ones((len(y), 1))])
    cost = np.concatenate([np.full(len(shown), 1 / len(shown)), weights / weights.sum()]) * COST
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    v = np.zeros(z.shape[1])
    for _ in range(30):
        on = y * (z @ v) < 1
        step = np.linalg.solve(ridge + (z[on] * cost[on, None]).T @ z[on], (z[on] * cost[on, None]).T @ y[on])
        if np.allclose(step, v, atol=1e-8):
            break
        v = step
    weight = np.zeros(KEYS, np.float32)
    weight[used] = (root @ v[:-1]) @ mark
    return weight, float(v[-1])


def _margins(model: Model):
    def margins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(margin=model.words(*_codes(frame.word.tolist())))

    return margins


def fit_head(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        gradient = z.T @ (y - p) - 0.05 * v
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(v)), gradient)
        v = v + step
        if np.abs(step).max() < 1e-8:
            break
    return v


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 12_000,
    words_per_class: int = 4_000,
    landmarks: int = 768,
    rounds: int = 2,
) -> Model:
    """Learn from at most ``sample`` labelled documents, those with the smallest id hashes.

    One half (by id hash) gives the words: positive are those found in at least four groups of
    toxic texts and in four of five of their groups; negative are words of clean texts, the
    commonest, as many others by hash, and in each further round those nearest to the positive
    side.  At most ``words_per_class`` of a kind reach the driver at once.  The other half fits
    the logistic head.  Without toxic or clean rows, or without
    positive words, every text scores the smoothed share of toxic rows.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = marked.withColumn("o", F.xxhash64("k")).orderBy("o", "k").limit(sample)
    part = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most ``sample`` rows of three numbers
    rows = stage(part.join(F.broadcast(chosen), "k").withColumn("half", F.pmod(F.shiftright("o", 8), F.lit(2))), "labelled")
    count = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, n = count[0] or 0, count[1]
    base = (toxic + 1) / (n + 2)
    found = rows.where("half = 0").select("text", "toxic").mapInPandas(_statistics, "word string, toxic int, grp long")
    per_word = found.distinct().groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    per_word = stage(per_word, "word-statistics")
    positive = per_word.where("t >= 4 and t >= 0.8 * n").orderBy(F.desc("t"), "word").limit(words_per_class)
    clean = per_word.where("t <= 0.3 * n").select("word", "n")
    common = clean.orderBy(F.desc("n"), "word").limit(words_per_class // 2)
    other = clean.orderBy(F.xxhash64("word"), "word").limit(words_per_class // 2)
    yes = [r.word for r in positive.collect()]
    no = {r.word: r.n for r in common.collect() + other.collect()}
    if not yes or not no:
        return Model(np.zeros(KEYS, np.float32), 0.0, None, base)
    model = Model(*train_machine(yes, list(no), np.sqrt(list(no.values())), landmarks), None, base)
    for _ in range(rounds):  # the clean words that look most toxic join the negatives
        hard = clean.mapInPandas(_margins(model), "word string, n long, margin double")
        no |= {r.word: r.n for r in hard.orderBy(F.desc("margin"), "word").limit(words_per_class).collect()}
        model = Model(*train_machine(yes, list(no), np.sqrt(list(no.values())), landmarks), None, base)

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in words.batches(frames):
            x = model.features(frame.text)
            yield pd.DataFrame(x, columns=["a", "b", "c", "d"]).assign(y=frame.toxic.to_numpy())

    seen = rows.where("half = 1").select("text", "toxic").mapInPandas(describe, "a double, b double, c double, d double, y int").toPandas()
    if seen.y.nunique() == 2:
        model.head = fit_head(seen[["a", "b", "c", "d"]].to_numpy(), seen.y.to_numpy(float))
    return model


def scorer(model: Model, text: str) -> Column:
    """Score column of whole texts; null and empty texts score as texts without words."""
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            parts = [model.score(f.text) for f in words.batches(iter([pd.DataFrame({"text": texts})]))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return F.pandas_udf(score, "double")(F.col(text))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) != 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` as struct ``row`` with ``score`` (0 to 1) and ``predicted``.

    Labels whose id has crc32 mod 3 = 1 are held out.  Repeated labels of an id count as toxic if
    one says so; null labels are none.  Every row is scored by its own whole text alone.
    """
    model = fit(docs, training_labels(labels, id_col), id_col, text, label)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("score", scorer(model, f"row.{text}"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
