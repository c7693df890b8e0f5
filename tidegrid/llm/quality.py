"""Quality by positive-unlabelled learning: trusted texts against web text of unknown quality.

Only positive labels are used.  A text is described by shares of hashed letter triples, words and
word shapes and by a few counts.  The share of positives in the web text is estimated first, then
a logistic model minimises the non-negative unbiased risk: the loss of trusted positives as
positives, weighted by that share, plus the loss of web text as negatives less what the positives
in it account for; where that difference falls below zero, the step goes back up on it, so the
model cannot win by calling trusted texts' neighbours negative without bound.
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

TRIPLES, WORDS, SHAPES, COUNTS = 128, 64, 64, 6
SIZE = TRIPLES + WORDS + SHAPES + COUNTS
BINS = 1_000
ROWS = 500  # texts described at once

_FOLD = np.arange(256, dtype=np.uint32)  # letters lower-cased, digits alike, blanks alike
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32
_KIND = np.arange(256, dtype=np.uint32)  # lower-case, upper-case and digits alike, all other bytes as they are
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 97, 65, 48, 97
_PRIME = np.uint32(2654435761)


def _shares(owner: np.ndarray, bin_: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """Square roots of the shares of each bin: texts of any length have length one."""
    n = np.bincount(owner * bins + bin_, minlength=texts * bins).reshape(texts, bins).astype(np.float32)
    return np.sqrt(n / np.maximum(n.sum(axis=1, keepdims=True), 1))


def _top_bits(x: np.ndarray, bins: int) -> np.ndarray:
    return (x * _PRIME >> np.uint32(33 - bins.bit_length())).astype(np.int64)


def _described(texts: pd.Series) -> np.ndarray:
    w = words.split(texts, lower=False)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    size = (w.ends - w.starts).astype(np.int64)
    out = np.zeros((n, SIZE), np.float32)
    if not len(w.starts):
        return out
    # letter triples inside words, with the blank on either side
    folded = np.concatenate([[np.uint32(32)], _FOLD[w.data], [np.uint32(32)]]).astype(np.uint32)
    code = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    letter = np.repeat(w.starts - np.cumsum(size) + size, size) + np.arange(size.sum())
    of = np.repeat(owner, size)
    out[:, :TRIPLES] = _shares(of, _top_bits(code[letter], TRIPLES), n, TRIPLES)
    # words, letters lower-cased
    lowered = words.Words(np.where((w.data >= 65) & (w.data < 91), w.data + 32, w.data).astype(np.uint8), w.starts, w.ends, w.first)
    hashes = lowered.hashes()
    out[:, TRIPLES : TRIPLES + WORDS] = _shares(owner, (hashes >> np.uint64(40)).astype(np.int64) % WORDS, n, WORDS)
    # shapes: the kinds of a word's bytes, runs of one kind once
    kind = _KIND[w.data]
    start = np.zeros(len(w.data), bool)
    start[w.starts] = True
    turn = np.flatnonzero((start | (kind != np.concatenate([[0], kind[:-1]])))[letter])
    runs = words.Words(kind[letter][turn].astype(np.uint8), *_run_borders(turn, size), w.first)
    out[:, TRIPLES + WORDS : SIZE - COUNTS] = _shares(owner, (runs.hashes() >> np.uint64(40)).astype(np.int64) % SHAPES, n, SHAPES)
    count = np.diff(w.first)
    some = np.maximum(count, 1)
    new = np.unique(words.mix(hashes + words.mix(owner.astype(np.uint64))), return_index=True)[1]  # first of each word of a text
    lines = np.bincount(np.repeat(np.arange(n), [0 if t is None else t.count("\n") for t in texts]), minlength=n)
    plain = np.bincount(of, ((kind[letter] == 97) | (kind[letter] == 65)), minlength=n)
    total = np.maximum(np.bincount(of, minlength=n), 1)
    out[:, -COUNTS:] = np.stack(
        [
            np.ones(n) * (count > 0),
            np.log1p(count) / 10,
            np.bincount(owner, size, n) / some / 10,
            np.bincount(owner[new], minlength=n) / some,
            np.where(count > 0, lines, 0) / some,
            plain / total,
        ],
        axis=1,
    )
    return out


def _run_borders(turn: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.searchsorted(turn, np.concatenate([[0], np.cumsum(size)]))
    return edge[:-1], edge[1:]


def describe(texts: pd.Series) -> Iterator[np.ndarray]:
    """Descriptions of whole texts, ``ROWS`` texts and one batch of bytes at a time."""
    for frame in words.batches(iter([pd.DataFrame({"text": texts})])):
        for at in range(0, len(frame), ROWS):
            yield _described(frame.text.iloc[at : at + ROWS])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, steps: int, rate: float) -> np.ndarray:
    """Adam on all rows at once, in single precision."""
    v = np.zeros(SIZE + 1, np.float32)
    first, second = np.zeros_like(v), np.zeros_like(v)
    for t in range(1, steps + 1):
        g = gradient(v)
        first = (0.9 * first + 0.1 * g).astype(np.float32)
        second = (0.999 * second + 0.001 * g * g).astype(np.float32)
        v = v - np.float32(rate) * (first / np.float32(1 - 0.9**t)) / (np.sqrt(second / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return v


def _pull(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.append(weight.astype(np.float32) @ x, weight.sum()).astype(np.float32)


def fit_discriminator(p: np.ndarray, u: np.ndarray, steps: int = 200, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Logistic model of trusted against web text, both sides of equal weight; it only serves to order texts."""

    def gradient(v: np.ndarray) -> np.ndarray:
        up, uu = p @ v[:-1] + v[-1], u @ v[:-1] + v[-1]
        return _pull(p, -_sigmoid(-up) / len(p)) + _pull(u, _sigmoid(uu) / len(u)) + ridge * np.append(v[:-1], 0)

    return _descend(gradient, steps, rate)


def fit_risk(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1_500, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with logistic loss."""

    def gradient(v: np.ndarray) -> np.ndarray:
        zp, zu = p @ v[:-1] + v[-1], u @ v[:-1] + v[-1]
        as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        part = _pull(u, _sigmoid(zu) / len(u)) - prior * _pull(p, _sigmoid(zp) / len(p))
        if as_negative < 0:
            g = -part
        else:
            g = prior * _pull(p, -_sigmoid(-zp) / len(p)) + part
        return g + ridge * np.append(v[:-1], 0)

    return _descend(gradient, steps, rate)


def class_prior(trusted: np.ndarray, web: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in the web text, from counts per score bin of both, neither used to fit the score.

    Above any bin, web text holds at least the share times what trusted text holds there; the bin
    where that bound is tightest, with a margin for the counts' error, gives the estimate."""
    if not trusted.sum() or not web.sum():
        return 0.5
    p, u = np.cumsum(trusted[::-1]) / trusted.sum(), np.cumsum(web[::-1]) / web.sum()
    error = np.sqrt(np.log(4 / delta) / 2 / web.sum()) + np.sqrt(np.log(4 / delta) / 2 / trusted.sum())
    some = p > 0
    at = np.argmin((u[some] + 1.01 * error) / p[some])
    return float(np.clip((u[some] / p[some])[at], 0.01, 0.99))


@dataclass
class Model:
    weight: np.ndarray | None
    prior: float

    def score(self, texts: pd.Series) -> np.ndarray:
        if self.weight is None:
            return np.full(len(texts), self.prior)
        parts = [x @ self.weight[:-1] + self.weight[-1] for x in describe(texts)]
        return _sigmoid(np.concatenate(parts)) if parts else np.zeros(0)


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows, those of smallest ``o``; only about as many are moved."""
    share = min(1.0, 1.2 * most / max(1, rows.count()) + 1e-4)
    low = F.shiftrightunsigned("o", 11) < int(share * 2**53)
    return rows.where(low).dropDuplicates(["o"]).orderBy("o").limit(most)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, trusted: int, web: int) -> DataFrame:
    """``o`` (hash), ``trusted`` and ``x`` (description) of the rows to learn from."""
    good = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("k"))
    good = good.agg(F.min(label).alias("q")).where("q = 1").select("k", F.xxhash64("k").alias("o"))
    part = docs.select(F.col(id_col).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = F.broadcast(_sampled(good, trusted))  # at most ``trusted`` rows of two values
    # one text for each id, whatever the number of rows that share it
    seen = part.join(chosen, "k").groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    plain = part.where(F.pmod(F.crc32("k"), F.lit(5)) != 0).withColumn("o", F.xxhash64("k", "text"))
    both = seen.select(F.xxhash64("k", "text").alias("o"), F.lit(1).alias("trusted"), "text").unionByName(
        _sampled(plain, web).select("o", F.lit(0).alias("trusted"), "text")
    )

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = [row.tobytes() for part in describe(frame.text) for row in part]
            yield pd.DataFrame({"o": frame.o, "trusted": frame.trusted, "x": x})

    return both.mapInPandas(described, "o long, trusted int, x binary")


def _folds(models: list[np.ndarray]):
    """Score bin of each text by the model that has not seen its half."""

    def bins(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, half in parts:
            x = np.concatenate([*describe(texts), np.zeros((0, SIZE), np.float32)])
            z = np.stack([x @ m[:-1] + m[-1] for m in models], axis=1)
            own = z[np.arange(len(x)), 1 - half.to_numpy(np.int64)]
            yield pd.Series((_sigmoid(own) * BINS).astype(np.int64).clip(0, BINS - 1))

    return F.pandas_udf(bins, "long")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    trusted: int = 3_000,
    web: int = 6_000,
) -> Model:
    """Learn from at most ``trusted`` positive labels and ``web`` unlabelled texts, those of smallest hashes.

    Two models, each fitted to one half of both, order the texts of the other half; their bins
    counted over all documents give the class prior.  Ids with both labels are not trusted.
    Without trusted texts every text scores 0.5.
    """
    seen = stage(_sample(docs, labels, id_col, text, label, trusted, web), "quality-sample").toPandas().sort_values(["trusted", "o"])
    x = np.frombuffer(b"".join(seen.x), np.float32).reshape(-1, SIZE)
    is_p = seen.trusted.to_numpy() == 1
    if not is_p.any() or is_p.all():
        return Model(None, 0.5)
    half = seen.o.to_numpy(np.int64) & 1
    if all((is_p & (half == f)).any() and (~is_p & (half == f)).any() for f in (0, 1)):
        models = [fit_discriminator(x[is_p & (half == f)], x[~is_p & (half == f)]) for f in (0, 1)]
        own = np.array([_sigmoid(r @ models[1 - f][:-1] + models[1 - f][-1]) for r, f in zip(x[is_p], half[is_p], strict=True)])
        p = np.bincount((own * BINS).astype(np.int64).clip(0, BINS - 1), minlength=BINS)
        part = docs.select(F.col(id_col).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        part = part.select("text", F.xxhash64("k", "text").bitwiseAND(1).alias("half"))
        counted = part.select(_folds(models)("text", "half").alias("bin")).groupBy("bin").count().toPandas()
        u = np.zeros(BINS, np.int64)
        u[counted["bin"].to_numpy()] = counted["count"].to_numpy()
        prior = class_prior(p, u)
    else:
        prior = 0.5
    return Model(fit_risk(x[is_p], x[~is_p], prior), prior)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0)


def scorer(model: Model, text: str) -> Column:
    """Score column of whole texts; null texts score as empty ones."""

    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(model.score(texts))

    return F.pandas_udf(score, "double")(F.col(text))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3
) -> DataFrame:
    """All columns of ``docs`` as struct ``row`` with ``score`` (0 to 1) and ``predicted``.

    Labels whose id has crc32 mod 5 = 0 are held out, and so are the texts of these ids when
    learning; null labels are none.  Every row is scored by its own whole text alone: texts
    without words alike, repeated rows alike, texts of any length.  An empty table gives no rows, and
    without labels every score is 0.5.
    """
    model = fit(docs, training_labels(labels, id_col), id_col, text, label)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("score", scorer(model, f"row.{text}"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
