"""DartMinHash signatures of weighted sets.

Darts fall on the plane (weight, rank) of each element by a Poisson process that depends on the element's hash alone. The plane
is cut into cells: unit slices of weight by blocks of rank, which double from ``1 / FINE`` to 1 and are of length 1 after that. A
dart counts if its weight is under the element's. Each dart has a coordinate; a coordinate's value is the dart of least rank.
Only darts below a rank bound are thrown, about k ln k + 2k of them whatever the set's size; the bound is doubled until every
coordinate has one. Two sets agree in a coordinate with a probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

from tidewater.llm.textkit import mix

FINE = 64
_SALTS = mix(np.arange(1, 4, dtype=np.uint64))
_UNIT = 2.0**-53


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * _UNIT


def _blocks(bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Where rank blocks begin, and their lengths, up to the bound."""
    edges, edge = [0.0], 1.0 / FINE
    while edges[-1] < bound:
        edges.append(edge)
        edge = edge * 2 if edge < 1 else edge + 1
    edges = np.array(edges)
    return edges[:-1], np.diff(edges)


def _throw(slices: np.ndarray, inside: np.ndarray | None, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, rank) of the darts of all slices with a rank under the bound; ``inside``: how much of each slice counts."""
    begins, sizes = _blocks(bound)
    names = mix(np.arange(len(begins), dtype=np.uint64) + np.uint64(0x51ED27))
    cell = mix((slices[:, None] + names[None, :]).ravel())
    luck = _unit(cell)
    block = np.tile(np.arange(len(begins)), len(slices))
    # The number of darts in a cell is Poisson: dart q is there if luck is over the chance of q or fewer.
    term = np.exp(-sizes)
    reach = term.copy()
    alive = np.flatnonzero(luck > reach[block])
    hashes, ranks, owners, q = [], [], [], 0
    while len(alive):
        at = block[alive]
        dart = mix(cell[alive] + np.uint64(int(_SALTS[0]) * (q + 1) % (1 << 64)))
        rank = begins[at] + sizes[at] * _unit(mix(dart + _SALTS[1]))
        low = rank < bound
        hashes.append(dart[low])
        ranks.append(rank[low])
        owners.append(alive[low] // len(begins))
        q += 1
        term = term * sizes / q
        reach = reach + term
        alive = alive[luck[alive] > reach[at]] if q < 64 else alive[:0]
    dart, rank = np.concatenate([*hashes, slices[:0]]), np.concatenate([*ranks, np.zeros(0)])
    if inside is not None:
        on = _unit(mix(dart + _SALTS[2])) < inside[np.concatenate([*owners, np.zeros(0, np.int64)])]
        dart, rank = dart[on], rank[on]
    return dart, rank


def signature(elements: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k dart hashes for the distinct 64-bit elements; weights are positive, 1 if not given. Needs an element."""
    inside = None
    slices, total = mix(elements), float(len(elements))
    if weights is not None:
        count = np.ceil(weights).astype(np.int64)
        owner = np.repeat(np.arange(len(elements)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        slices = mix(slices[owner] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        inside = np.minimum(weights[owner] - number, 1.0)
        total = float(weights.sum())
    bound = (k * math.log(k) + 2 * k) / total
    while True:
        dart, rank = _throw(slices, inside, bound)
        place = (mix(dart ^ _SALTS[0]) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        found, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        found[place[order]] = dart[order]  # the last, of least rank, stays
        filled[place] = True
        if filled.all():
            return found
        bound *= 2


def bands(signature_: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each ``rows`` coordinates; keys of different bands differ."""
    table = signature_.reshape(-1, rows)
    keys = mix(np.arange(1, len(table) + 1, dtype=np.uint64))
    for column in table.T:
        keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + column)
    return keys.view(np.int64)
