"""Merkle manifest, positive-unlabelled quality and best-position search against plain versions of each."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import best_position, merkle, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns named like the operators' own
CLASH = ", g long, i string, n string, d string, key string, score string, rank string, o long, k string"


def h(text):
    return sha256(text.encode()).hexdigest()


# --- Merkle manifest ----------------------------------------------------------------------
def leaf(r, lower=False):
    text = r[1]
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    values = r[0], r[3], r[2], r[4], text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for part in groups.values():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[k]]) for k in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, name in enumerate(names):
        for place, r in enumerate(groups[name]):
            runs = []
            for tree, at in ((trees[g], place), (top, g)):
                for level in tree[:-1]:
                    run = at // 8 * 8
                    runs.append((level[run:at], level[at + 1 : run + 8]))
                    at //= 8
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, tampered)
            for before, after in runs:
                folded = h("".join([*before, folded, *after]))
            proof = [d for before, after in runs for d in before + after]
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h("".join(proof)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest(docs, **more):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    when = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(docs, changes={"text": lower}, when=when, **more)


def seven(rows):
    names = "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def some_docs():
    rows = [(k, f"Text {k} OF Ünïcode" * (k % 3), "de" if k % 2 else "en", f"s{k % 5}", k * 3) for k in range(700)]
    rows += [(5, "again", "en", None, None), (5, "Again", "en", None, None), (8, "twice", "en", "s", 1), (8, "twice", "en", "s", 1)]
    rows += [(None, "No Id", "en", "s", 2), (None, None, None, None, None), (None, "", None, "", 0), (900, None, "", "s", 0)]
    rows += [(2**62 + 1, "A" * 3_000_000, "long", "s", 1), (-(2**63), "Min", "en", "s", 1)]
    return rows + [(1000 + k, "X", f"lang{k:02}", "s", k) for k in range(70)]


def test_manifest_equals_a_plain_tree(spark):
    rows = some_docs()
    got = manifest(spark.createDataFrame(rows, DOCS), nodes=False)
    assert "proof" not in got.columns
    assert seven(got.collect()) == by_hand(rows)


@pytest.mark.parametrize("tall", [1, 2])
def test_blocks_of_several_rounds(spark, tall):
    """Blocks of 8 and of 64 leaves: up to four rounds up and down, for leaves and for groups."""
    rows = some_docs()
    assert seven(manifest(spark.createDataFrame(rows, DOCS), nodes=False, tall=tall).collect()) == by_hand(rows)


def test_versions_share_all_other_nodes(spark):
    rows = some_docs()
    found = manifest(spark.createDataFrame(rows, DOCS)).cache()
    for r in found.limit(200).collect():
        assert r.version[-1] == r.folded_root and (r.verified == (r.folded_root == r.root))
        assert h("".join(r.proof)) == r.proof_sha256
    own = merkle.copied_nodes(found)
    per_version = {r["id"]: r["count"] for r in own.groupBy("id").count().collect()}
    changed = {r["id"] for r in found.where("not verified").collect()}
    assert set(per_version) == changed
    # 350 leaves are three levels, some 75 groups three more
    assert max(per_version.values()) <= 9
    level0 = {r.digest for r in own.where("level = 0").collect()}
    assert not level0 & {r.leaf for r in found.collect()}


def test_one_leaf_is_its_own_root(spark):
    rows = [(7, "One", "en", "s", 3)]
    (r,) = manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert r.leaf == r.subroot == r.root and r.proof == [] and r.proof_sha256 == h("")


def test_manifest_of_nothing_and_of_clashing_columns(spark):
    assert manifest(spark.createDataFrame([], DOCS)).collect() == []
    rows = some_docs()[:40]
    wide = [(*r, 1, "i", "n", "d", "key", "s", "r", 3, "k") for r in rows]
    assert seven(manifest(spark.createDataFrame(wide, DOCS + CLASH)).collect()) == by_hand(rows)


def test_a_hot_group_of_repeated_rows_spreads(spark):
    rows = [(1, "Same", "en", "s", 4)] * 9000 + [(k, "x", "de", "s", 1) for k in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    assert seven(manifest(docs, nodes=False).collect()) == by_hand(rows)
    tagged = docs.select(F.lit(b"x").alias("key"), F.col("doc_id").alias("_id"), "text")
    numbered = merkle.numbered(tagged, ["_id"]).toPandas()
    assert sorted(numbered.i) == list(range(len(rows))) and set(numbered.n) == {len(rows)}


# --- best-position search -----------------------------------------------------------------
def term_list(text):
    if text is None:
        return []
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked_by_hand(docs, items, k=20):
    held = [(d, Counter(term_list(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    documents, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * documents // length
            score = 0
            for t in term_list(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        scores.sort(key=lambda s: s[:3])
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(scores[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in best_position.search(docs, items, **more).collect()), key=str)


@pytest.mark.parametrize("postings", [200, 1_000_000])
def test_search_equals_full_scoring(spark, postings):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(80)]
    share = 1 / np.arange(1, 81)
    docs = [(int(d), " ".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=share / share.sum()))) for d in range(900)]
    docs += [(None, "w70 w71"), (None, "w70 w71"), (3, "w70 W71 w71"), (2000, None), (2001, ""), (2002, "w79 " * 100_000)]
    docs += [(5000 + d, "w75 w76 w77") for d in range(60)]  # more equal scores than ranks
    items = [(int(q), " ".join(rng.choice(vocabulary, 12))) for q in range(12)]
    items += [(50, "w75 w76"), (50, "w75 w76"), (51, None), (52, ""), (53, "unknown words"), (None, "w1, W1; w70é w70")]
    assert searched(spark, docs, items, postings=postings) == ranked_by_hand(docs, items)


def test_search_in_blocks_of_items(spark):
    docs = [(d, f"a{d % 7} b{d % 11} c") for d in range(200)]
    items = [(q, f"a{q % 7} b{q % 5} c") for q in range(30)]
    assert searched(spark, docs, items, block_bytes=60, k=5) == ranked_by_hand(docs, items, 5)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == [] == searched(spark, [(1, "a")], []) == searched(spark, [(1, "...")], [(1, "a")])


def test_search_ignores_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 1)], "doc_id long, text string, id string, held string, item_id long")
    items = spark.createDataFrame([(9, "a", 4, "k")], "item_id long, text string, doc_id long, key string")
    assert [r.doc_id for r in best_position.search(docs, items).collect()] == [1]


def test_reading_stops_early_and_only_below_the_kth():
    """One list falls off, the other is long: few entries are read; equal scores are all met."""
    n = 5_000
    term = np.repeat([0, 1], n)
    doc = np.concatenate([np.arange(n), np.arange(n)])
    impact = np.concatenate([np.arange(n, 0, -1) * 10, np.full(n, 3)])
    lists = best_position.Lists.of(term, doc, impact, 2, n)
    met, score, read = lists.search(np.array([0, 1]), np.array([1, 1]), 0, 20)
    assert read < n and sorted(score)[-20:] == sorted(impact[:n] + 3)[-20:]
    flat = best_position.Lists.of(term, doc, np.full(2 * n, 7), 2, n)
    met, score, read = flat.search(np.array([0, 1]), np.array([1, 1]), 0, 20)
    assert read == 2 * n and len(met) == n


# --- quality ------------------------------------------------------------------------------
def texts(rng, good, n):
    for _ in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(20, 60)))]
        yield " ".join(words).capitalize() + "." if good else " | ".join(w + "$#"[int(rng.integers(2))] * 3 for w in words)


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, 1) for k, t in enumerate(texts(rng, True, 700))]
    rows += [(1000 + k, t, 0) for k, t in enumerate(texts(rng, False, 300))]
    rows += [(5000, None, None), (5001, "", None), (5002, " \n\t ", None), (None, "Some text.", None), (5003, rows[0][1], None)]
    rows += [(5004, "word " * 400_000, None), (5003, rows[0][1], None)]
    docs = spark.createDataFrame([(*r[:2], "s", 0.5) for r in rows], "doc_id long, text string, row string, score double")
    labels = [(r[0], r[2]) for r in rows if r[2] is not None]
    labels += [(1, 1), (None, 1), (2, None), (3, 0), (77777, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_quality_finds_held_out_texts(graded):
    docs, labels, rows = graded
    scored = {}
    for r in quality.score_quality(docs, labels).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.row.row == "s"
        scored.setdefault(r.row.doc_id, []).append(r.score)
    assert sum(map(len, scored.values())) == len(rows)
    held = [(scored[k][0], q) for k, _, q in rows if q is not None and zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == (q == 1) for s, q in held]) > 0.97
    assert scored[5000] == scored[5001] == scored[5002]
    assert scored[5003][0] == scored[5003][1] and abs(scored[5003][0] - scored[0][0]) < 1e-6


def test_prior_and_risk(graded):
    docs, labels, _ = graded
    model = quality.fit(docs, quality.training_labels(labels))
    assert abs(model.prior - 0.7) < 0.12


def test_prior_from_bins():
    rng = np.random.default_rng(1)
    p = np.bincount(rng.integers(60, 100, 20_000), minlength=100)
    u = np.bincount(np.concatenate([rng.integers(60, 100, 12_000), rng.integers(0, 50, 28_000)]), minlength=100)
    assert abs(quality.class_prior(p, u) - 0.3) < 0.03
    assert quality.class_prior(np.zeros(5, int), u) == 0.5


def test_risk_stays_from_below_zero():
    """Trusted texts hidden among the web text: the model must not call them negative."""
    rng = np.random.default_rng(2)
    p, hidden, other = (rng.normal(0, 0.03, (n, quality.SIZE)).astype(np.float32) for n in (300, 600, 200))
    p[:, 0] += 1
    hidden[:, 0] += 1
    other[:, 0] -= 1
    v = quality.fit_risk(p, np.concatenate([hidden, other]), 0.75)
    good, bad = hidden @ v[:-1] + v[-1], other @ v[:-1] + v[-1]
    assert (good > 0).mean() > 0.9 and (bad < 0).mean() > 0.9


def test_held_out_labels_are_never_learned(spark, graded):
    docs, labels, _ = graded
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.score_quality(docs, x).select("row.doc_id", "score").orderBy("doc_id", "score").collect() for x in (labels, turned))
    assert one == two


def test_quality_without_labels_or_rows(spark, graded):
    docs, labels, _ = graded
    none = labels.where("false")
    assert {r.score for r in quality.score_quality(docs.limit(5), none).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), labels).collect() == []
