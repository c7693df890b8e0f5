"""Repeated passages: documents joined on winnowed anchors, matches extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import words
from tidegrid.staging import stage

NO_ID = (1 << 63) - 1


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` gram hashes the place of its smallest, the leftmost of equals."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, place = grams, np.arange(len(grams))
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = value[:-step], value[step:]
        first = left <= right
        value, place = np.where(first, left, right), np.where(first, place[:-step], place[step:])
        width += step
    return place


class Anchors:
    """Anchors of the texts of one frame and the windows that each stands for."""

    def __init__(self, texts: pd.Series, window: int, gram: int):
        self.words = words.split(texts, lower=False)
        self.hashes = self.words.hashes()
        first = self.words.first
        windows = np.maximum(np.diff(first) - window + 1, 0)
        doc = np.repeat(np.arange(len(windows)), windows)
        shift = first[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]])
        start = np.arange(windows.sum()) + np.repeat(shift, windows)
        grams = words.window_hashes(self.hashes, gram)
        place = winnow(grams, window - gram + 1)[start]
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(start)]]) - 1 if len(at) else at
        self.doc, self.lo, self.hi = doc[at], start[at], (start[last] + window if len(at) else start[at])
        self.anchor = grams[place[at]]
        offset = (place[at] - self.lo).astype(np.uint64)
        self.context = words.mix(words.span_hashes(self.hashes, self.lo, self.hi) + offset)


def _seed(window: int, gram: int):
    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in words.batches(frames):
            a = Anchors(frame.text, window, gram)
            base = a.words.first[a.doc]
            yield pd.DataFrame(
                {
                    "anchor": a.anchor.view(np.int64),
                    "context": a.context.view(np.int64),
                    "id": frame.id.to_numpy()[a.doc],
                    "th": frame.th.to_numpy()[a.doc],
                    "lo": (a.lo - base).astype(np.int32),
                    "hi": (a.hi - base).astype(np.int32),
                }
            )

    return seed


def _extend(window: int):
    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every window around the open anchors of a text, left and right of the anchor."""
        for frame in words.batches(frames):
            w = words.split(frame.text, lower=False)
            whole = words.window_hashes(w.hashes(), window)
            per = frame.spans.str.len().to_numpy()
            doc = np.repeat(np.arange(len(frame)), per)
            spans = [s for row in frame.spans for s in row]
            lo = np.array([s["lo"] for s in spans], np.int64)
            n = np.array([s["hi"] for s in spans], np.int64) - window - lo + 1
            anchor = np.repeat(np.array([s["anchor"] for s in spans], np.int64), n)
            start = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            yield pd.DataFrame(
                {
                    "anchor": anchor,
                    "w": whole[start + w.first[doc]].view(np.int64),
                    "id": frame.id.to_numpy()[doc],
                    "th": frame.th.to_numpy()[doc],
                    "start": start.astype(np.int32),
                }
            )

    return extend


def _cut(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, all_spans in columns:
        w = words.split(texts, lower=False)
        data = w.data.tobytes()
        out = []
        for k, (text, spans) in enumerate(zip(texts, all_spans, strict=True)):
            a, n = w.first[k], int(w.first[k + 1] - w.first[k])
            kept = np.ones(n, bool)
            if spans is not None:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [s["lo"] for s in spans], 1)
                np.add.at(edge, [s["hi"] for s in spans], -1)
                kept = np.cumsum(edge[:-1]) == 0
            rows = np.flatnonzero(kept) + a
            joined = b" ".join([data[s:e] for s, e in zip(w.starts[rows].tolist(), w.ends[rows].tolist(), strict=True)])
            removed = n - len(rows)
            clean = text if removed == 0 else joined.decode("utf-8", "surrogatepass")
            out.append((n, removed, hashlib.sha256(joined).hexdigest(), clean))
        yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "clean"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, gram: int = 20) -> DataFrame:
    """``(id, th, lo, hi)``: word spans of each text that start in a document with a smaller id.

    Every window of ``window`` words has an anchor, its smallest hash of ``gram`` words.  Equal
    windows have equal anchors at equal offsets, so only anchors that occur in two documents
    matter.  Where all the windows that an anchor stands for agree with those of a smaller
    document, the maximal repeat covers them and they go at once; copies of long passages end
    here.  The others are extended word by word: their windows are compared one by one, keyed
    by anchor and window hash (128 bits).  Minima are taken with partial aggregation, never
    pairs of documents.
    """
    part = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    part = part.withColumn("th", F.xxhash64("text"))
    row = "anchor long, context long, id long, th long, lo int, hi int"
    seeds = stage(part.mapInPandas(_seed(window, gram), row), "anchors")
    met = seeds.groupBy("anchor").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.min("context").alias("c1"), F.max("context").alias("c2")
    )
    # written, so that the joins have plain exchanges on both sides and a hot anchor can be split
    met = stage(met.where("low < high").select("anchor", (F.col("c1") < F.col("c2")).alias("mixed")), "anchors-met")
    shared = stage(seeds.join(met, "anchor"), "shared-anchors")
    least = stage(shared.groupBy("anchor", "context").agg(F.min("id").alias("least")), "least-ids")
    shared = stage(shared.join(least, ["anchor", "context"]), "met-anchors")
    whole = shared.where("id > least").select("id", "th", "lo", "hi")
    open_ = shared.where("id = least and mixed").groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("spans"))
    windows = part.join(open_.hint("merge"), ["id", "th"]).mapInPandas(_extend(window), "anchor long, w long, id long, th long, start int")
    windows = stage(windows, "open-windows")
    first = stage(windows.groupBy("anchor", "w").agg(F.min("id").alias("least")), "least-ids")
    met_again = windows.join(first, ["anchor", "w"]).where("id > least")
    return whole.unionByName(met_again.select("id", "th", F.col("start").alias("lo"), (F.col("start") + window).alias("hi")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 50, gram: int = 20) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``cut`` with ``n_words``, ``n_removed``, ``kept_sha256``, ``clean``.

    ``clean`` is the text itself where nothing goes, else the kept words joined by one space.
    Null and empty texts have no words and stay.  A null id counts as larger than all others;
    documents with equal ids never strike each other's words, and repeated rows are treated alike.
    """
    spans = repeated_spans(docs, id_col, text, window, gram).distinct()
    spans = spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    part = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("th"),
    )
    cut = F.pandas_udf(_cut, "n_words long, n_removed long, kept_sha256 string, clean string")
    return part.join(spans.hint("merge"), ["id", "th"], "left").select("row", cut(f"row.{text}", "spans").alias("cut"))
