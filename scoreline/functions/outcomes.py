"""Outcome of a match from one side's point of view.

A score may be NULL. What a NULL score means is not the same in every
report, so each helper takes it as an explicit policy:

* ``null_as="draw"``  — the result label of a win/draw/loss table and the
  winner of a head-to-head fall through to "draw";
* ``null_as="loss"``  — run detection: a match without a score breaks a
  winning run and an unbeaten run;
* points and the won/drawn/lost flags of a league table give 0 for a NULL
  score (no points, and neither won, drawn nor lost).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIN, DRAW, LOSS = "W", "D", "L"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def result(gf, ga, null_as: str = "draw") -> Column:
    """'W' / 'D' / 'L' for a side that scored ``gf`` and conceded ``ga``."""
    gf, ga = _col(gf), _col(ga)
    if null_as == "draw":
        return F.when(gf > ga, WIN).when(gf < ga, LOSS).otherwise(DRAW)
    if null_as == "loss":
        return F.when(gf > ga, WIN).when(gf == ga, DRAW).otherwise(LOSS)
    raise ValueError(f"null_as must be 'draw' or 'loss', not {null_as!r}")


def points(gf, ga, win: int = 3, draw: int = 1, loss: int = 0) -> Column:
    """League points; a NULL score earns ``loss`` points."""
    gf, ga = _col(gf), _col(ga)
    return F.when(gf > ga, F.lit(win)).when(gf == ga, F.lit(draw)).otherwise(F.lit(loss))


def flag(cond: Column) -> Column:
    """1 when ``cond`` is true, else 0 (also when it is NULL)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def won(gf, ga) -> Column:
    return flag(_col(gf) > _col(ga))


def drawn(gf, ga) -> Column:
    return flag(_col(gf) == _col(ga))


def lost(gf, ga) -> Column:
    return flag(_col(gf) < _col(ga))


def in_run(gf, ga, kind: str) -> Column:
    """Does this match extend a run? ``kind`` is 'win' or 'unbeaten'.

    NULL scores never extend a run.
    """
    gf, ga = _col(gf), _col(ga)
    if kind == "win":
        cond = gf > ga
    elif kind == "unbeaten":
        cond = gf >= ga
    else:
        raise ValueError(f"kind must be 'win' or 'unbeaten', not {kind!r}")
    return F.coalesce(cond, F.lit(False))
