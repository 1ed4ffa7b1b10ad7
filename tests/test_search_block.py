"""A block of queries and chunks against scores worked out pair by pair."""

import numpy as np
import pandas as pd
import pytest

from sitelore import fixed
from sitelore.functions import scoring
from sitelore.operators import retrieve

WORDS = [f"{a}{b}" for a in ("con", "tact", "an", "shop", "über", "x") for b in ("", "er", "tact", "s t", "an")]


def _frames(n_queries: int, n_chunks: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    rng = np.random.default_rng(5)
    pick = lambda least, most: list(rng.choice(WORDS, rng.integers(least, most)))
    flags = rng.integers(0, 2, (4, len(retrieve.FLAGS))).astype(bool)
    kind = rng.integers(0, 4, n_chunks)
    weights = rng.integers(0, 4, (4, len(fixed.INTENTS))) / 4
    chunks = pd.DataFrame(
        {
            "scope": "s|", "chunk_id": [f"c{i:04d}" for i in rng.permutation(n_chunks)], "order": [[int(x), 0] for x in rng.integers(0, 40, n_chunks)],
            "lexical_in": [None if x else [] for x in rng.integers(0, 9, n_chunks)], "embedding": list(rng.normal(size=(n_chunks, 3))),
            "searchable": [" ".join(pick(0, 9)) for _ in range(n_chunks)], "platforms": kind % 3, "quality": kind / 4,
            **{name: [list(weights[(k + j) % 4]) for k in kind] for j, name in enumerate(("signals", "type_weights", "source_scores"))},
            **{name: flags[kind, j] for j, name in enumerate(retrieve.FLAGS)}, "text_key": [f"k{x}" for x in rng.integers(0, n_chunks // 2, n_chunks)],
        }
    )
    intents = rng.integers(0, len(fixed.INTENTS), n_queries)
    queries = pd.DataFrame(
        {
            "qid": [f"q{i}" for i in range(n_queries)], "vector": list(rng.normal(size=(n_queries, 3))), "vector_k": 4, "top_k": 3,
            "terms": [list(dict.fromkeys(pick(0, 6))) for _ in range(n_queries)], "intent_ord": intents,
            "query_platforms": rng.integers(0, 3, n_queries), "query_intent": [fixed.INTENTS[i] for i in intents],
        }
    )
    return queries, chunks


def _by_pairs(q, chunks: pd.DataFrame) -> list[tuple]:
    rows = []
    for c in chunks.itertuples():
        overlap = scoring.ArrayOps.round6(np.float64(sum(t in c.searchable for t in q.terms) / max(1, len(q.terms))))
        scores = scoring.score_pair(
            scoring.Pair(
                intent=q.intent_ord, vector=0.0, overlap=overlap, base=c.signals[q.intent_ord], shares_platform=bool(q.query_platforms & c.platforms),
                any_platform=c.platforms != 0, type_weight=c.type_weights[q.intent_ord], source=c.source_scores[q.intent_ord], quality=c.quality,
                **{name: np.bool_(getattr(c, name)) for name in retrieve.FLAGS},
            ),
            scoring.ArrayOps,
        )
        match, penalty, total = map(float, scores)
        if c.lexical_in is None:
            rows.append((-total, -match, -float(overlap), c.order, c.chunk_id, c.text_key, penalty))
    best, seen = [], set()
    for r in sorted(rows):
        if r[5] not in seen and len(best) < q.top_k + q.vector_k:
            seen.add(r[5])
            best.append((r[4], -r[0], -r[1], -r[2], r[6]))
    return best


@pytest.mark.parametrize("tabled", [1 << 21, 1])
def test_lexical_rows_equal_those_of_single_pairs(monkeypatch, tabled):
    monkeypatch.setattr(retrieve, "TABLED", tabled)
    monkeypatch.setattr(retrieve, "MATCHES", 50)
    monkeypatch.setattr(retrieve, "TERMS", 7)
    queries, chunks = _frames(40, 150)
    found = pd.concat(retrieve._search_block(queries, chunks))
    far = found[~found["near"]]
    for q in queries.itertuples():
        mine = far[far["qid"] == q.qid]
        shown = mine[["chunk_id", "rerank_score", "intent_match", "keyword_overlap", "penalty"]]
        assert [tuple(r) for r in shown.itertuples(index=False)] == _by_pairs(q, chunks)
    assert (found[found["near"]].groupby("qid").size() == 4).all()


def test_scores_are_worked_out_per_kind_of_chunk_not_per_pair(monkeypatch):
    """Every pair of a block once went through the whole formula."""
    queries, chunks = _frames(400, 600)
    done = []
    score_pair = scoring.score_pair

    def counted(pair, ops):
        out = score_pair(pair, ops)
        done.append(np.broadcast(*out).size)
        return out

    monkeypatch.setattr(scoring, "score_pair", counted)
    pd.concat(retrieve._search_block(queries, chunks))
    assert sum(done) < len(queries) * len(chunks) / 10
