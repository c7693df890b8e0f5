"""Packing documents into token windows with their lexical neighbours."""

from __future__ import annotations

import json
import math
import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import words
from tidegrid.staging import stage

END = 1
JOINED = 500  # words encoded as one text
#: Kinds of bytes; plain words are of signs, letters and digits alone: ASCII and À to ÿ without × and ÷.  They are NFC
#: and change by lower case only, a character each.
SIGN, LETTER, DIGIT, OTHER = 1, 2, 3, 4
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[0x80:0xC0] = KIND[0xC3] = LETTER  # À to ÿ are 0xC3 and a byte; after any other first byte it makes the word not plain
KIND = KIND.tobytes()
LOWER = bytes(range(256)).lower()
#: The character that byte-level tokenizers read for each byte; the blank keeps parts apart.
PRINTED = np.array([*range(33, 127), *range(161, 173), *range(174, 256)])
READ_AS = np.zeros(256, "<u4")
READ_AS[PRINTED] = PRINTED
READ_AS[READ_AS == 0] = 256 + np.arange(256 - len(PRINTED))
READ_AS[32] = 32
FIRST = np.array([256**k - 1 for k in range(9)], np.uint64)  # masks of the first k of eight bytes
ODD = np.uint64(0x9E3779B97F4A7C15)
#: The tokenizer whose splitting ``_parts`` repeats on plain words; any other one reads whole words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "id long, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _without_normalizer(model):
    """The same merges for parts that are normalized, split and read as characters already, or None if the tokenizer does
    that otherwise."""
    from tokenizers import Tokenizer, pre_tokenizers

    told = json.loads(model.to_str())
    splitter = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    if (
        (told["normalizer"] or {}).get("normalizers") != NORMALIZERS
        or len(splitter) != 2
        or splitter[0] != {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        or {k: splitter[1].get(k) for k in byte_level} != byte_level
        or any(t["normalized"] or not t["content"].startswith("<|") for t in told["added_tokens"])
    ):
        return None
    signs = [chr(c) for c in READ_AS if c != 32]
    if told["model"].get("end_of_word_suffix") != "</w>" or not {*signs, *(c + "</w>" for c in signs)} <= model.get_vocab().keys():
        return None  # a part may have no id, or end without its mark
    inner = Tokenizer.from_str(model.to_str())
    inner.normalizer = None
    inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return inner


def _looked_up(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(bytearray(data).translate(table), np.uint8)


def _hashes(w: words.Words) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time, which is quicker than ``Words.hashes`` for short ones."""
    eight = np.ndarray(len(w.data), "<u8", np.append(w.data, np.zeros(8, np.uint8)), strides=(1,))
    size = w.ends - w.starts
    out = words.mix((eight[w.starts] & FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * ODD)
    at, long = 8, np.flatnonzero(size > 8)
    while len(long):
        out[long] = words.mix(out[long] * ODD + (eight[w.starts[long] + at] & FIRST[np.minimum(size[long] - at, 8)]))
        at += 8
        long = long[size[long] > at]
    return out


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places ``first[i] .. first[i] + n[i] - 1`` of all i in turn."""
    end = np.cumsum(n)
    out = np.repeat(first - end + n, n)
    out += np.arange(len(out))
    return out


def _parts(w: words.Words) -> tuple[words.Words, np.ndarray]:
    """What is encoded at once, in place of the words: the parts (letters, a digit, signs) of plain words, in lower
    case, and all other words whole and unchanged; and which of them are whole words."""
    kind, low, end = _looked_up(w.data, KIND), _looked_up(w.data, LOWER), len(w.data)
    wide = np.flatnonzero(w.data == 0xC3)
    after = w.data[wide + 1]
    kind[wide[(after == 0x97) | (after == 0xB7)]] = OTHER
    low[wide + 1] += (after < 0x9F).view(np.uint8) << 5
    special = np.flatnonzero(w.data == ord("<"))  # special tokens are found before a word is split
    kind[special[w.data[special + 1] == ord("|")]] = OTHER
    other = np.unique(np.searchsorted(w.starts, np.flatnonzero(kind == OTHER), side="right") - 1)
    at = _ranges(w.starts[other], w.ends[other] - w.starts[other])
    kind[at], low[at] = OTHER, w.data[at]
    border = np.empty(end, bool)
    border[0] = kind[0] != 0
    np.not_equal(kind[1:], kind[:-1], out=border[1:])
    border |= kind == DIGIT
    # 's 't 're 've 'm 'll 'd where a run of signs would begin
    quote = np.flatnonzero((low == ord("'")) & border & (kind == SIGN))
    quote = quote[kind[quote + 1] == LETTER]
    one, two = low[quote + 1], low[np.minimum(quote + 2, end - 1)]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    border[quote[short | long] + 1] = False
    border[np.concatenate([quote[short] + 2, quote[long] + 3])] = True
    edge = np.append(np.flatnonzero(border), end)
    some = np.flatnonzero(kind[edge[:-1]])
    starts = edge[some]
    first = np.searchsorted(starts, np.append(w.starts, end)[w.first])
    return words.Words(low, starts, edge[some + 1], first), kind[starts] == OTHER


class WordTokenizer:
    """Token ids of whole texts, each distinct part of a word encoded once and kept.

    White space never joins or changes tokens of the word BPE, so a text's ids are those of
    its words in turn.  The tokenizer merges inside the parts of a word (letters, a digit, signs): plain words are
    split here and their parts encoded without normalizing them again, other words are encoded whole.
    Known parts and words live in arrays sorted by hash; ``most`` or ``most_parts``, the smaller one, bounds
    them, beyond it the table starts afresh.
    """

    def __init__(self, path: str, most: int = 1_200_000, most_parts: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has more than 65536 ids, they are kept in 16 bits")
        self.inner = _without_normalizer(self.model)
        self.last = np.zeros(1 << 16, bool)  # ids that end a part
        self.last[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.most = min(most, most_parts)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.span = np.zeros(0, np.int64)  # place in ``ids`` and number of ids, in 32 bits each
        self.ids = np.zeros(0, np.uint16)

    @property
    def parts(self) -> list[str]:
        """Texts of what is known, read back from its ids."""
        from tokenizers.decoders import ByteLevel

        held = [self.ids[at : at + n].tolist() for at, n in zip((self.span >> 32).tolist(), (self.span & 0xFFFFFFFF).tolist(), strict=True)]
        return [ByteLevel().decode([self.model.id_to_token(i) for i in ids]).replace("</w>", "") for ids in held]

    def _encode_parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts in one array, and how many each has; many make one text, which is cheaper than one call each."""
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        n = ends - starts + 1  # with the blank after each
        border = np.concatenate([[0], np.cumsum(n)])
        some = data[_ranges(starts, n)]
        some[border[1:] - 1] = 32
        text = READ_AS[some].tobytes().decode("utf-32-le")
        cut = [*border[:-1:JOINED].tolist(), len(text)]
        joined = [text[a : z - 1] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        ids = np.array([i for e in self.inner.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.uint16)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for whole words, which the tokenizer splits itself."""
        ids, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        joined = [" ".join(texts[at : at + JOINED]) for at in range(0, len(texts), JOINED)]
        for k, e in enumerate(self.model.encode_batch(joined, add_special_tokens=False)):
            part = texts[k * JOINED : (k + 1) * JOINED]
            first = np.cumsum([0] + [len(t) + 1 for t in part[:-1]])
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e))
            ids.append(np.array(e.ids, np.uint16))
            counts.append(np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    def _insert(self, place: np.ndarray, known: np.ndarray, span: np.ndarray) -> None:
        """New parts and where their ids are, at their places in the longer table."""
        old = np.ones(len(self.known) + len(place), bool)
        old[place] = False
        for name, values in (("known", known), ("span", span)):
            longer = np.empty(len(old), values.dtype)
            longer[place], longer[old] = values, getattr(self, name)
            setattr(self, name, longer)

    def encode(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the borders of the texts, each text closed by ``END``."""
        w = words.split(texts, lower=False)
        w, whole = _parts(w) if self.inner is not None else (w, np.ones(len(w.starts), bool))
        code, value = pd.factorize(_hashes(w), sort=True)  # looked up in order, which is kinder to the cache
        place = np.searchsorted(self.known, value)
        have = place < len(self.known)
        have[have] = self.known[place[have]] == value[have]
        new = np.flatnonzero(~have)
        if len(new):
            if len(self.known) + len(new) > self.most and len(self.known):
                self._clear()
                new, have, place = np.arange(len(value)), np.zeros(len(value), bool), np.zeros(len(value), np.int64)
            first = np.empty(len(value), np.int64)
            first[code] = np.arange(len(code))  # any of the equal ones
            new = new[np.argsort(whole[first[new]], kind="stable")]  # the parts, then the whole words
            at, parts = first[new], len(new) - np.count_nonzero(whole[first[new]])
            starts, ends = w.starts[at], w.ends[at]
            ids, n = self._encode_parts(w.data, starts[:parts], ends[:parts])
            some = zip(starts[parts:].tolist(), ends[parts:].tolist(), strict=True)
            more, m = self._encode_whole([w.data[s:e].tobytes().decode("utf-8", "replace") for s, e in some])
            n = np.concatenate([n, m])
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, ids, more])
            place = place + np.cumsum(~have) - ~have  # among the old and new ones
            self._insert(place[new], value[new], at << 32 | n)
        span = self.span[place].take(code)
        n = span & 0xFFFFFFFF
        total = np.concatenate([[0], np.cumsum(n)])
        border = total[w.first]
        out = self.ids.take(_ranges(span >> 32, n))
        return np.insert(out, border[1:], END), border + np.arange(len(border))


def tokenizer_of(path: str) -> WordTokenizer:
    """One per worker process and path: its words stay known from task to task.

    Functions reach the workers by value, with a fresh module each, so it is kept at ``sys``."""
    kept = sys.__dict__.setdefault("_word_tokenizers", {})
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


class Bm25:
    """Inverted index over the documents of one shard: for each term the documents that hold it.

    Documents leave the index once they are used: their entries weigh nothing, and are taken out when
    they are half of all.
    """

    def __init__(self, ids: np.ndarray, edge: np.ndarray, k1: float = 1.2, b: float = 0.75):
        n = np.diff(edge)
        self.docs = len(n)
        doc = np.repeat(np.arange(self.docs), n)
        kind = np.uint32 if self.docs <= 1 << 16 else np.int64  # narrow keys sort faster
        pair, tf = np.unique(doc.astype(kind) << kind(16) | ids.astype(kind), return_counts=True)
        doc, term = (pair >> kind(16)).astype(np.int64), (pair & kind(0xFFFF)).astype(np.int64)
        self.asked = [term[a:z] for a, z in zip(*(np.searchsorted(doc, np.arange(self.docs) + k) for k in (0, 1)), strict=True)]
        df = np.bincount(term, minlength=1 << 16)
        idf = np.log1p((self.docs - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[doc] / max(1.0, n.mean())))
        order = np.argsort(term.astype(np.uint16), kind="stable")  # narrow keys sort faster
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        self.entries = np.bincount(doc, minlength=self.docs)
        self._border(term)

    def _border(self, term: np.ndarray) -> None:
        self.term = term
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=1 << 16))])

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first, ties by place; all terms of the seed are its query."""
        if 2 * self.entries[unused].sum() < len(self.doc):
            alive = unused[self.doc]
            self.doc, self.weight = self.doc[alive], self.weight[alive]
            self._border(self.term[alive])
        terms = self.asked[seed]
        terms = terms[terms != END]
        first, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = _ranges(first, n)
        score = np.bincount(self.doc.take(at), self.weight.take(at), minlength=self.docs) * unused
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


def pack_shard(ids: np.ndarray, edge: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of all pieces of one shard.

    The first unused document seeds a window; its best unused neighbours follow until the
    window is full, and the next unused ones if it has too few.  What does not fit goes on in
    the next window, whose seed it is, so only the last sequence of a shard is not full.
    Neighbours are looked for once a window has room for them: a long seed fills many by itself.
    """
    n = np.diff(edge)
    index = Bm25(ids, edge)
    unused = np.ones(len(n), bool)
    pieces, sequence, offset, next_seed = [], 0, 0, 0
    queue: list[int] | None = []  # neighbours of the seed, None before they are asked for
    seed, current, start = -1, -1, 0
    while True:
        if current < 0:
            if queue is None:
                queue = index.ranked(seed, unused).tolist()
            current = next((d for d in queue if unused[d]), -1)
            if current >= 0:
                queue = queue[queue.index(current) + 1 :]
            else:
                while next_seed < len(n) and not unused[next_seed]:
                    next_seed += 1
                if next_seed == len(n):
                    return pieces
                current = next_seed
            start = 0
            unused[current] = False
            if offset == 0:
                seed, queue = current, None
        take = min(window - offset, int(n[current]) - start)
        pieces.append((current, start, take, sequence, offset))
        offset, start = offset + take, start + take
        if offset == window:
            sequence, offset = sequence + 1, 0
        if start == n[current]:
            current = -1
        elif offset == 0:
            seed, queue = current, None


def _tokenised(path: str):
    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in words.batches(frames):
            ids, edge = tokenizer_of(path).encode(frame.text)
            ids = ids.astype("<u2")
            held = [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield frame.drop(columns="text").assign(ids=held)

    return tokens


def _packer(window: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in words.groups(frames, ["shard"]):
            edges = words.borders(frame, ["shard"])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = frame.iloc[a:b].sort_values(["id", "row"], kind="stable")
                ids = np.frombuffer(b"".join(part.ids), "<u2")
                edge = np.concatenate([[0], np.cumsum(part.ids.str.len().to_numpy(np.int64) // 2)])
                pieces = np.array(pack_shard(ids, edge, window), np.int64).reshape(-1, 5)
                doc, start, length, sequence, offset = pieces.T
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[s : s + k]) for s, k in zip((edge[doc] + start).tolist(), length.tolist(), strict=True)]
                yield pd.DataFrame(
                    {
                        "id": part.id.to_numpy()[doc],
                        "row": part.row.to_numpy()[doc],
                        "start": start,
                        "length": length,
                        "ids_crc32": np.array(crc, np.int64),
                        "doc_tokens": np.diff(edge)[doc],
                        "sequence_id": (part.shard.iat[0] << 32) + sequence,
                        "offset": offset,
                    }
                )

    return pack


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per document, ascending."""
    order = np.argsort(h)
    if len(doc) and doc[-1] < 1 << 16:
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]  # narrow keys sort faster
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], doc[fresh]


def _sampler(sample: int):
    def terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The distinct words of each text with the smallest hashes: documents that share words with small hashes sample the same ones."""
        for frame in words.batches(frames):
            w = words.split(frame.text, lower=True)
            doc = np.repeat(np.arange(len(frame)), np.diff(w.first))
            h = w.hashes() >> np.uint64(1)
            # most of a long text's words are too large to be offered; texts that repeat themselves are sorted whole
            share = np.minimum(1.0, 4 * sample / np.maximum(np.diff(w.first), 1))
            keep = h < (share * 2.0**63).astype(np.uint64)[doc]
            some = _distinct(h[keep], doc[keep])
            few = (np.bincount(some[1], minlength=len(frame)) < sample) & (share < 1)
            h, doc = _distinct(h[keep | few[doc]], doc[keep | few[doc]]) if few.any() else some
            h = h.view(np.int64)
            first = np.searchsorted(doc, np.arange(len(frame) + 1))
            held = [h[a : min(a + sample, b)] for a, b in zip(first[:-1], first[1:], strict=True)]
            # the largest hash that the text would still have offered
            limit = [x[-1] if len(x) == sample else np.iinfo(np.int64).max for x in held]
            yield pd.DataFrame({"key": frame.key, "chars": frame.text.str.len() + 1, "top": limit, "terms": held})

    return terms


def deal(part: DataFrame, shard_chars: int, sample: int) -> tuple[DataFrame, int]:
    """``key, shard`` and how many shards: documents whose rarest shared term is the same go together, hot terms in several parts.

    Each document offers a sample of its words.  How many documents hold a term is estimated by
    those that offer it and the share of documents that would offer a term of its hash; a
    term that one document alone offers brings nothing together.  A term is hot if its documents fill more
    than one shard.  Documents that share no term of theirs are not in the table.
    """
    told = stage(part.mapInPandas(_sampler(sample), "key long, chars long, top long, terms array<long>"), "packing-terms")
    total = told.agg(F.sum("chars")).first()[0] or 0  # told with the terms, so texts are not read for it alone
    shards = max(1, math.ceil(total / shard_chars))
    each = told.select("key", F.explode("terms").alias("term"))
    # at most 1024 rows: documents by the leading ten bits of the largest hash they offer
    tops = told.groupBy(F.shiftright("top", 53).cast("int").alias("bin")).count().toPandas()
    offered = np.bincount(tops["bin"], tops["count"], minlength=1024)[::-1].cumsum()[::-1]
    share = part.sparkSession.createDataFrame(pd.DataFrame({"bin": np.arange(1024), "share": offered / max(1, offered[0])}))
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = counted.withColumn("bin", F.shiftright("term", 53).cast("int")).join(F.broadcast(share), "bin")
    # to the nearest power of two: among terms alike in rarity the one of smallest hash is offered by most
    rarity = F.round(F.log2(F.col("n") / F.col("share"))).alias("rarity")
    shared = stage(counted.select("term", rarity), "packing-shared-terms")
    rarest = each.join(shared, "term").groupBy("key").agg(F.min(F.struct("rarity", "term")).alias("m"))
    rarest = stage(rarest.select("key", F.col("m.term").alias("term")), "packing-rarest")
    sizes = told.select("key", "chars").join(rarest, "key")
    hot = sizes.groupBy("term").agg(F.ceil(F.sum("chars") / shard_chars).alias("parts")).where("parts > 1")
    parts = rarest.join(stage(hot, "packing-hot-terms"), "term", "left")
    at = F.xxhash64("term", F.pmod(F.col("key"), F.coalesce("parts", F.lit(1))))
    return stage(parts.select("key", F.pmod(at, F.lit(shards)).cast("int").alias("shard")), "packing-shards"), shards


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    shard_chars: int = 1_500_000,
    sample: int = 32,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Documents go to shards of about ``shard_chars`` characters by content (see ``deal``); each
    shard has its own BM25 index and is packed by itself, so memory is bounded by a shard or
    by its longest document.  ``sequence_id`` is shard * 2**32 + number.  Null and empty texts
    are the end id alone.  Repeated rows are packed once each.  No rows give no pieces.
    """
    part = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = part.withColumn("row", F.xxhash64("text")).withColumn("id", F.coalesce("id", F.lit(-(1 << 63))))
    part = part.withColumn("key", F.xxhash64("id", "row"))
    dealt, shards = deal(part.select("key", "text"), shard_chars, sample)
    # texts are read again and move as ids, two bytes each; only keys and terms have moved so far
    tokens = part.mapInPandas(_tokenised(tokenizer), "id long, row long, key long, ids binary").join(dealt, "key", "left")
    tokens = tokens.select("id", "row", "ids", F.coalesce("shard", F.pmod("key", F.lit(shards)).cast("int")).cast("long").alias("shard"))
    width = max(rows_per_task(shards), 1)
    packed = tokens.repartition(width, "shard").sortWithinPartitions("shard").mapInPandas(_packer(window), PIECES)
    return packed.drop("row").withColumn("id", F.when(F.col("id") > -(1 << 63), F.col("id"))).withColumnRenamed("id", id_col)


def rows_per_task(shards: int, each: int = 8) -> int:
    """Tasks for so many shards: about eight shards each."""
    return math.ceil(shards / each)
