"""Where the moves lead, against a plain walk."""

from __future__ import annotations

import numpy as np

from foliant.operators import moves, vectors


def plain(units, asked):
    """The rule, unit by unit; units are (id, label, vector, visits, loss, uncertainty) in order."""
    out, e = {}, np.array([u[2] for u in units], float)
    norm = np.linalg.norm(e, axis=1, keepdims=True)
    e = np.divide(e, norm, out=np.zeros_like(e), where=norm > 0)
    visits, loss = np.array([u[3] or 0 for u in units]), [u[4] for u in units]
    unsure = np.array([u[5] or 0.0 for u in units])
    few = np.flatnonzero(visits == visits.min())
    for i, u in enumerate(units):
        if u[0] not in asked:
            continue
        score = np.round(e @ e[i], 6)

        def best(mask):
            s = np.where(mask, score, -np.inf)
            s[i] = -np.inf
            return None if np.isneginf(s).all() else int(np.argmax(s))

        related = best(np.ones(len(units), bool))
        known = best(visits > 0)
        to = {
            "next": min(i + 1, len(units) - 1), "previous": max(i - 1, 0), "related": related, "cross_document": best(np.array([x[1] != u[1] for x in units])),
            "high_loss": int(np.argmax([-np.inf if x is None else x for x in loss])) if any(x is not None for x in loss) else int(few[0]),
            "known": known if known is not None else related, "unvisited": int(few[int(np.argmax(unsure[few]))]),
        }
        out |= {(u[0], m): units[t if t is not None else i][0] for m, t in to.items()}
    return out


SCHEMA = "vec_id long, label int, embedding array<float>, visits long, loss double, uncertainty double"


def check(spark, units, asked):
    found = moves.moves(spark.createDataFrame(units, SCHEMA).repartition(3), spark.createDataFrame([(a,) for a in asked], "vec_id long"))
    got = {(r.vec_id, r.move): r.target for r in found.collect()}
    assert got == plain(sorted(u for u in units if u[0] is not None and u[2] is not None), set(asked))


def test_moves(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 9)
    rng = np.random.default_rng(1)
    few = lambda n: [float(x) for x in rng.integers(-1, 2, n)]  # noqa: E731  many ties, and null vectors
    units = [(3 * k, [0, 1, 2, None][k % 4] if k % 4 < 3 else 7, few(3), [None, 0, 1, 2][int(rng.integers(4))], [None, 0.5, 1.5][int(rng.integers(3))], [None, 0.1, 0.2][int(rng.integers(3))]) for k in range(60)]
    check(spark, units, [0, 3, 30, 90, 177])
    check(spark, [(*u[:3], 0, None, None) for u in units[:20]], [0, 57])  # nothing known, nothing visited
    check(spark, [(1, 1, [1.0, 0.0], 3, None, 0.5)], [1])  # alone
    check(spark, [(k, 1, [1.0, 0.0], k, 1.0, None) for k in range(4)], [0, 3])  # one label


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert moves.moves(none, none.select("vec_id")).count() == 0
