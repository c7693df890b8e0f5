"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

The queries' terms are counted over all documents first.  Then each task cuts its documents into
shards and turns a shard into lists, one per term: entries by falling impact, what a term adds to
the document's score.  A query reads its lists side by side and looks every document it meets up
in all of its lists, which tells its whole score and its place in each list.  The best position of
a list is the end of the stretch, from the top, of which every place has been seen either way; no
unseen document can get more than the sum of the impacts behind the best positions.  Reading
stops as soon as that is strictly below the k-th score found so far in the task, so equal
scores are still met and can be put in order of their ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import words
from tidegrid.staging import stage

_OTHER = np.ones(256, bool)  # ASCII that is neither letter nor digit ends a term
_OTHER[48:58] = _OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False
NO_ID = np.iinfo(np.int64).max
TASK = 50_000  # documents of a task, about
STEP = 64  # entries read per list before the bound is computed again


def terms(texts: pd.Series) -> words.Words:
    """Runs of letters, digits and bytes beyond ASCII; A-Z are lower-cased."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_OTHER[data].view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    text_ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    return words.Words(data, starts, ends, first)


@dataclass
class Queries:
    """Distinct query texts of a block: terms with repeats, as places in ``vocabulary``."""

    key: np.ndarray  # hash of the text
    vocabulary: np.ndarray  # sorted term hashes
    term: np.ndarray  # distinct terms of each query
    times: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Queries:
        w = terms(rows.text)
        vocabulary, term = np.unique(w.hashes(), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), np.diff(w.first))
        pair, times = np.unique(owner * max(1, len(vocabulary)) + term, return_counts=True)
        owner, term = np.divmod(pair, max(1, len(vocabulary)))
        return cls(rows.key.to_numpy(np.int64), vocabulary, term, times, np.searchsorted(owner, np.arange(len(rows) + 1)))


def _known(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
    hit = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    return place, hit


def _counted(vocabulary: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per document its number of terms and the query terms in it, packed: place and count, 32 bits each."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in words.batches(frames):
            w = terms(frame.text)
            place, hit = _known(w.hashes(), vocabulary)
            owner = np.repeat(np.arange(len(frame)), np.diff(w.first))[hit]
            pair, tf = np.unique(owner << 32 | place[hit], return_counts=True)
            packed = np.stack([pair & 0xFFFFFFFF, tf], axis=1).astype("<u4")
            edge = np.searchsorted(pair >> 32, np.arange(len(frame) + 1))
            held = [packed[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pd.DataFrame({"id": frame["id"], "null_id": frame.null_id, "n": np.diff(w.first), "held": held})

    return count


def _frequencies(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, np.int64)
        for frame in frames:
            held = np.frombuffer(b"".join(frame.held), "<u4")[::2]
            df += np.bincount(held, minlength=size)
        yield pd.DataFrame({"place": np.flatnonzero(df), "df": df[df > 0]})

    return frequencies


@dataclass
class Lists:
    """Impact lists of a shard; ``at[t]:at[t + 1]`` are the entries of term ``t``."""

    at: np.ndarray
    doc: np.ndarray  # by falling impact
    impact: np.ndarray
    key: np.ndarray  # term and document, sorted, for direct access
    place: np.ndarray  # entry of a key
    docs: int

    @classmethod
    def of(cls, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, size: int, docs: int) -> Lists:
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        key = term * docs + doc
        place = np.argsort(key)
        return cls(np.searchsorted(term, np.arange(size + 1)), doc, impact, key[place], place, docs)

    def look_up(self, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every document (row) in the list of every term (column), and if it has one."""
        key = term[None, :] * self.docs + doc[:, None]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.place[at], self.key[at] == key

    def search(self, term: np.ndarray, times: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents met with their scores, and how many entries were read one after the other.

        Whatever is not met scores below the ``k``-th best of these or below ``floor``."""
        first, end = self.at[term], self.at[term + 1]
        term, times, first, end = term[end > first], times[end > first], first[end > first], end[end > first]
        size = end - first
        seen = [np.zeros(n, bool) for n in size]
        best = np.zeros(len(term), np.int64)
        met = np.zeros(self.docs, bool)
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        depth = 0
        while (depth < size).any():
            upto = np.minimum(depth + STEP, size)
            new = np.concatenate([self.doc[a + depth : a + b] for a, b in zip(first, upto, strict=True) if b > depth])
            new = np.unique(new[~met[new]])
            met[new] = True
            if len(new):
                place, has = self.look_up(term, new)
                found.append(new)
                scores.append((np.where(has, self.impact[place], 0) * times).sum(axis=1))
                for j in range(len(term)):  # the lists of one query
                    seen[j][place[has[:, j], j] - first[j]] = True
            depth += STEP
            bound = 0
            for j in range(len(term)):
                rest = seen[j][best[j] :]
                gap = int(rest.argmin()) if len(rest) else 0
                best[j] = size[j] if len(rest) and rest[gap] else best[j] + gap
                if best[j] < size[j]:
                    bound += int(self.impact[first[j] + best[j]]) * int(times[j])
            total = np.concatenate(scores)
            if len(total) >= k:
                floor = max(floor, int(np.partition(total, len(total) - k)[-k]))
            scores = [total]
            if bound < floor:  # strictly: an equal score may win by its id
                break
        return np.concatenate(found), np.concatenate(scores), int(np.minimum(depth, size).sum())


def _shards(frames: Iterator[pd.DataFrame], postings: int) -> Iterator[pd.DataFrame]:
    """Rows gathered to about ``postings`` list entries each."""
    part: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if frame.empty:
            continue
        part.append(frame)
        size += int(frame.held.str.len().sum()) // 8
        if size >= postings:
            yield pd.concat(part, ignore_index=True)
            part, size = [], 0
    if part:
        yield pd.concat(part, ignore_index=True)


def _searched(queries: Queries, weight: np.ndarray, documents: int, length: int, k: int, postings: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[int, np.ndarray] = {}  # per query its best so far: score, rank of ids by null, id
        for frame in _shards(frames, postings):
            held = np.frombuffer(b"".join(frame.held), "<u4").reshape(-1, 2).astype(np.int64)
            doc = np.repeat(np.arange(len(frame)), frame.held.str.len().to_numpy(np.int64) // 8)
            m = 75 + 25 * frame.n.to_numpy(np.int64) * documents // length
            term, tf = held[:, 0], held[:, 1]
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            some = impact > 0
            if not some.any():
                continue
            lists = Lists.of(term[some], doc[some], impact[some], len(weight), len(frame))
            id_, null = frame["id"].to_numpy(np.int64), frame.null_id.to_numpy(bool)
            for q in range(len(queries.key)):
                a, b = queries.first[q], queries.first[q + 1]
                have = top.get(q)
                floor = int(have[-1, 0]) if have is not None and len(have) == k else 0
                met, score, _ = lists.search(queries.term[a:b], queries.times[a:b], floor, k)
                good = score >= max(1, floor)
                rows = np.stack([score[good], null[met[good]], id_[met[good]]], axis=1).astype(np.int64)
                rows = rows if have is None else np.concatenate([have, rows])
                top[q] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]
        for q, rows in top.items():
            yield pd.DataFrame({"key": queries.key[q], "score": rows[:, 0], "null_id": rows[:, 1] > 0, "id": rows[:, 2]})
        words.give_back()

    return search


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    block_bytes: int = 4_000_000,
    postings: int = 1_000_000,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best documents with a score above 0.

    Terms, weights and scores are those of :func:`ranked_by_hand` in the tests: a term's weight
    times a saturated share of its count, whole numbers throughout.  Equal scores go by ascending
    id, null ids last; documents that share an id count one by one.  Items without terms, null texts and empty
    tables give no rows; repeated items are answered one by one, from one search of their text.
    Texts of any length are read whole, a batch of texts at a time.

    Items go to the tasks in blocks of about ``block_bytes`` of distinct text, whatever their number; a
    block holds one text at least.  Shards hold about ``postings`` entries of these terms; the shards of a task
    share the k-th best score so far.
    """
    spark = docs.sparkSession
    part = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(doc_id).isNull().alias("null_id"), F.col(text).alias("text")
    )
    asked = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    asked = stage(asked.withColumn("key", F.xxhash64("text")), "items")
    distinct = asked.groupBy("key", "text").agg(F.octet_length("text").alias("bytes"))
    distinct = stage(distinct, "item-texts")
    size = distinct.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-size // block_bytes)
    answers = spark.createDataFrame([], "key long, score long, null_id boolean, id long")
    with words.arrow_rows(spark, 500):
        for b in range(blocks):
            # bounded: about ``block_bytes`` of text
            queries = Queries.of(distinct.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "text").toPandas())
            found = _answers(part, queries, k, postings)
            answers = answers.unionByName(found) if blocks > 1 else found
    best = Window.partitionBy("key").orderBy(F.desc("score"), "null_id", "id")
    ranked = answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.select("key", "rank", F.when(~F.col("null_id"), F.col("id")).alias("doc_id"), "score")
    return asked.join(ranked, "key").select("item_id", "rank", "doc_id", "score")


def _answers(part: DataFrame, queries: Queries, k: int, postings: int) -> DataFrame:
    """The best of every task for a block of queries, after counting their terms over all documents."""
    rows = part.mapInPandas(_counted(queries.vocabulary), "id long, null_id boolean, n long, held binary")
    rows = stage(rows, "query-terms")
    documents, length = rows.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents or not len(queries.vocabulary):
        return part.sparkSession.createDataFrame([], "key long, score long, null_id boolean, id long")
    df = rows.select("held").mapInPandas(_frequencies(len(queries.vocabulary)), "place long, df long")
    weighed = df.groupBy("place").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    # one number per term of the block
    known = weighed.select("place", w.alias("w")).toPandas()
    weight = np.zeros(len(queries.vocabulary), np.int64)
    weight[known.place.to_numpy()] = known.w.to_numpy()
    # tasks by the number of documents, not by the bytes of the few terms kept
    tasks = max(int(part.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-documents // TASK))
    found = rows.repartition(tasks).mapInPandas(_searched(queries, weight, documents, length, k, postings), "key long, score long, null_id boolean, id long")
    return stage(found, "task-answers")
