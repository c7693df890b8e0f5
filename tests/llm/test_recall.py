"""Share of planted pairs found near the thresholds, and of true neighbours, on fixtures checked by brute force."""

import numpy as np
import pytest

from tests.support import make_session
from tidegrid.llm import embedding_dedup, minhash_forest, vector_graph


@pytest.fixture(scope="module")
def session():
    return make_session()


def test_near_duplicates_at_85_to_90_percent_are_found_and_those_below_are_not(session):
    rng = np.random.default_rng(11)
    rows, linked = [], []
    for i in range(300):
        base = [f"{i}x{j}" for j in rng.permutation(200)]
        changed = int(rng.integers(11, 19))  # the last words, each in a shingle of its own
        copy = [*base[:-changed], *[f"{i}y{j}" for j in range(changed)]]
        shingles = [{tuple(w[a : a + 5]) for a in range(196)} for w in (base, copy)]
        both, either = len(shingles[0] & shingles[1]), len(shingles[0] | shingles[1])
        assert 0.83 < both / either < 0.9
        linked.append(100 * both >= 85 * either)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    assert 50 < sum(linked) < 250
    frame = session.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(frame, percent=85).collect()}
    assert all(got[2 * i] == 2 * i for i in range(300))
    assert [got[2 * i + 1] == 2 * i for i in range(300)] == linked
    assert all(got[2 * i + 1] == 2 * i + 1 for i in range(300) if not linked[i])


def test_vectors_just_above_the_threshold_are_found(session):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((600, 64))
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.89, 0.91, 600)[:, None]
    pairs = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * other])
    frame = session.createDataFrame([(i, v.tolist()) for i, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    near = cosine[:, 0] >= 0.9
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    found = np.array([got[i] == (1, i) and got[i + 600] == (1, i) for i in range(600)])
    assert found[near].mean() >= 0.99
    assert all(got[i] == (0, i) and got[i + 600] == (0, i + 600) for i in np.flatnonzero(~near).tolist())


def test_neighbours_over_several_shards(session):
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((30, 32))
    x = centres[rng.integers(0, 30, 1500)] + 0.6 * rng.standard_normal((1500, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    frame = session.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = vector_graph.nearest(frame, every=50, shard_rows=400).collect()
    hits = 0
    for q in range(0, 1500, 50):
        score = u @ u[q]
        score[q] = -9
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(-score)[:5].tolist()))
    assert len(rows) == 150 and hits >= 0.9 * 150
    assert all(abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12 for r in rows)
