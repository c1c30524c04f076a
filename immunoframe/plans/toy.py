"""Two small recombination models, junctions for them from the driver's tables, and the SQL that lists all recombinations."""

from __future__ import annotations

import itertools

import numpy as np

from ..operators.recombination import BASES, Model, Segment

_STEP = np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.5, 0.2, 0.2], [0.25, 0.25, 0.25, 0.25], [0.3, 0.1, 0.1, 0.5]])
_BACK = np.array([[0.1, 0.2, 0.3, 0.4], [0.3, 0.3, 0.2, 0.2], [0.25, 0.15, 0.35, 0.25], [0.5, 0.2, 0.2, 0.1]])
VJ = Model(
    [Segment("V1*01", "TGTGCC", np.array([0.5, 0.3, 0.2])), Segment("V2*01", "TGCA", np.array([0.6, 0.4]))], [Segment("J1*01", "TTTC", np.array([0.7, 0.2, 0.1])), Segment("J2*01", "GGTTC", np.array([0.5, 0.5]))],
    np.array([0.6, 0.4]), np.array([[0.3, 0.7], [0.8, 0.2]]), [np.array([0.4, 0.3, 0.2, 0.1])], [_STEP],
)
_TRIM = np.array([[0.3, 0.1, 0.15], [0.1, 0.1, 0.05], [0.1, 0.1, 0.0]])
VDJ = Model(
    [Segment("V1*01", "TGTGC", np.array([0.5, 0.5])), Segment("V2*01", "TGCA", np.array([0.6, 0.4]))], [Segment("J1*01", "TTTC", np.array([0.7, 0.3])), Segment("J2*01", "GTTC", np.array([0.5, 0.5]))],
    np.array([0.6, 0.4]), np.array([0.3, 0.7]), [np.array([0.4, 0.6]), np.array([0.5, 0.2, 0.3])], [_STEP, _BACK],
    [Segment("D1*01", "GGAT", _TRIM), Segment("D2*01", "CA", np.array([[0.5, 0.2], [0.2, 0.1]]))], np.array([[0.5, 0.5], [0.1, 0.9]]),
)

#: Junctions built from the keys of the line items: pieces of the models' segments with letters between.
JUNCTIONS = """
select distinct concat(substr(case l_orderkey % 3 when 0 then 'TGTGCC' when 1 then 'TGTGC' else 'TGCA' end, 1, cast(2 + l_partkey % 4 as int)), substr('ACGTACG', cast(1 + l_suppkey % 4 as int), cast(l_linenumber % 4 as int)),
  substr(case l_partkey % 3 when 0 then 'TTTC' when 1 then 'GGTTC' else 'GTTC' end, cast(1 + l_orderkey % 3 as int))) as junction_nt from lineitem
"""


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda x: f"'{x}'" if isinstance(x, str) else f"{x:.17g}::double" if isinstance(x, float) else str(x)
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


def _inserts(model: Model, k: int, backward: bool) -> list[tuple]:
    rows = []
    for size, p in enumerate(model.ins[k]):
        for t in itertools.product(range(4), repeat=size):
            order, w = t[::-1] if backward else t, float(p)
            for i, b in enumerate(order):
                w *= float(model.first[k][b] if not i else model.step[k][order[i - 1], b])
            rows.append(("".join(BASES[b] for b in t), w))
    return rows


def space(model: Model) -> str:
    """CTEs that end in ``space(v, j, s, la, lb, p)``: every recombination's genes, sequence, lengths of inserts, and probability."""
    tables = [
        _values("vs", "v, cut, k, p", [(s.name, s.cut, k, float(a * p)) for s, a in zip(model.v, model.p_v, strict=True) for k, p in enumerate(s.trim)]), _values("js", "j, cut, k, p", [(s.name, s.cut, k, float(p)) for s in model.j for k, p in enumerate(s.trim)]),
        _values("ia", "s, p", _inserts(model, 0, False)),
    ]
    left, right = "substr(vs.cut, 1, length(vs.cut) - vs.k)", "substr(js.cut, js.k + 1)"
    if not model.d:
        tables.append(_values("vj", "v, j, p", [(a.name, b.name, float(model.p_j[i, k])) for i, a in enumerate(model.v) for k, b in enumerate(model.j)]))
        tables.append(f"space as (select vs.v, js.j, {left} || ia.s || {right} as s, length(ia.s) as la, vs.p * vj.p * js.p * ia.p as p from vs join vj using (v) join js using (j), ia)")
        return ", ".join(tables)
    tables.append(_values("pj", "j, p", [(s.name, float(p)) for s, p in zip(model.j, model.p_j, strict=True)]))
    tables.append(_values("ds", "j, s, p", [(t.name, s.cut[a : len(s.cut) - b], float(model.p_d[i, k] * s.trim[a, b])) for i, t in enumerate(model.j) for k, s in enumerate(model.d) for a in range(s.trim.shape[0]) for b in range(s.trim.shape[1]) if s.trim[a, b]]))
    tables.append(_values("ib", "s, p", _inserts(model, 1, True)))
    tables.append(f"space as (select vs.v, js.j, {left} || ia.s || ds.s || ib.s || {right} as s, length(ia.s) as la, length(ib.s) as lb, vs.p * pj.p * js.p * ia.p * ds.p * ib.p as p from vs, js join pj using (j) join ds using (j), ia, ib)")
    return ", ".join(tables)


def marginals(model: Model, name: str) -> str:
    """The model's table of marginals as a CTE, from what the operator's rows are made of."""
    rows: list[tuple] = [("v", "", s.name, 1.0, float(p)) for s, p in zip(model.v, model.p_v, strict=True)]
    of_j = model.joint().sum(axis=0)
    if model.d:
        rows += [("j", "", s.name, 1.0, float(p)) for s, p in zip(model.j, model.p_j, strict=True)] + [("d", t.name, s.name, float(w), float(p)) for t, w, q in zip(model.j, of_j, model.p_d, strict=True) for s, p in zip(model.d, q, strict=True)]
        rows += [("d_trim", s.name, f"{a},{b}", float(w), float(p)) for s, w in zip(model.d, of_j @ model.p_d, strict=True) for (a, b), p in np.ndenumerate(s.trim)]
    else:
        rows += [("j", a.name, b.name, float(w), float(p)) for a, w, q in zip(model.v, model.p_v, model.p_j, strict=True) for b, p in zip(model.j, q, strict=True)]
    for kind, segments, ws in (("v_trim", model.v, model.p_v), ("j_trim", model.j, of_j)):
        rows += [(kind, s.name, str(k), float(w), float(p)) for s, w in zip(segments, ws, strict=True) for k, p in enumerate(s.trim)]
    for k, kind in enumerate(("vd_ins", "dj_ins") if model.d else ("vj_ins",)):
        rows += [(kind, "", str(i), 1.0, float(p)) for i, p in enumerate(model.ins[k])]
        rows += [(f"{kind}_step", BASES[a], BASES[b], float(model.first[k][a]), float(p)) for (a, b), p in np.ndenumerate(model.step[k])]
    return _values(name, "event, parent, value, weight, p", rows)
