"""DartMinHash signatures of weighted sets.

Every element owns a strip of weights for each power of two. Hashed darts land in a strip
in order of rank, the first ones soonest: the gaps between ranks are exponential with the
strip's width, so any element throws the same darts in every set. A set keeps the darts
that land below its element's weight and below a rank at which it has about
`k ln k + 2 k` darts in all, deals them to `k` coordinates and keeps the earliest of each.
Two sets agree in a coordinate with the probability of their weighted Jaccard similarity,
at a cost of about one hash per element and dart instead of `k` per element.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype("float64") + 1.0) * 2.0**-53


def _strips(elements: np.ndarray, weights: np.ndarray):
    """(hash, low end, width, weight) of every strip that an element's weight reaches."""
    low, width, level = 0.0, 1.0, 0
    while len(elements):
        yield mix(elements + np.uint64((level + 1) * int(_A) % 2**64)), low, width, weights
        low, width, level = low + width, (1.0 if level == 0 else 2 * width), level + 1
        more = weights > low
        if not more.any():
            return
        elements, weights = elements[more], weights[more]


def signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """`k` dart names (uint32) for distinct uint64 `elements` (at least one).

    `weights` are positive; None stands for 1 each.
    """
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype="float64")
    limit = (k * np.log(k) + 2 * k) / weights.sum()
    while True:
        ranks, names = [], []
        for strip, low, width, weight in _strips(elements, weights):
            _throw(strip, low, width, weight, limit, ranks, names)
        rank, name = np.concatenate(ranks), np.concatenate(names)
        place = (name % np.uint64(k)).astype("int64")
        order = np.lexsort((name, rank))[::-1]  # the earliest is written last
        out = np.zeros(k, dtype="uint64")
        filled = np.zeros(k, dtype=bool)
        out[place[order]] = name[order]
        filled[place] = True
        if filled.all():
            return (out >> np.uint64(32)).astype("uint32")
        limit *= 2  # darts so far stay what they are


def _throw(strip, low, width, weight, limit, ranks, names):
    """Append ranks and names of the darts of one level of strips up to rank `limit`."""
    per_strip = limit * width
    together = 1 if per_strip < 2 else int(per_strip + 3 * np.sqrt(per_strip) + 2)
    reached, number = np.zeros(len(strip)), 0
    while len(strip):
        counts = np.arange(number, number + together, dtype="uint64")
        dart = mix(strip[:, None] ^ mix((counts + np.uint64(1)) * _B)[None, :])
        rank = reached[:, None] + np.cumsum(-np.log(_uniform(mix(dart + _A))), axis=1) / width
        landed = rank <= limit
        if weight.min() < low + width:
            at = low + width * (1.0 - _uniform(mix(dart + _C)))
            kept = landed & (at < weight[:, None])
        else:
            kept = landed
        ranks.append(rank[kept])
        names.append(dart[kept])
        on = landed[:, -1]
        strip, weight, reached = strip[on], weight[on], rank[on, -1]
        number += together
