"""Ordered rule lists by incremental reduced-error pruning.

Rules are grown one at a time, literal by literal (``feature <= t`` or ``feature > t``, chosen
by FOIL's information gain), on two thirds of the remaining rows, pruned from the end on the
other third by ``(p - n) / (p + n)``, and kept while they are right more often than not there.
Rows that a rule covers are then removed. The result exports to a SQL ``CASE`` expression.
"""

from __future__ import annotations

import numpy as np

Rule = tuple[tuple[str, str, float], ...]


def _mask(x: dict[str, np.ndarray], rule: Rule, n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for f, op, t in rule:
        m &= (x[f] <= t) if op == "<=" else (x[f] > t)
    return m


def _grow(x, y, max_literals: int, max_cuts: int) -> Rule:
    rule: Rule = ()
    m = np.ones(len(y), bool)
    while len(rule) < max_literals:
        p0, n0 = int((m & y).sum()), int((m & ~y).sum())
        if not n0 or not p0:
            break
        base, best, pick = np.log2(p0 / (p0 + n0)), 1e-9, None
        for f, v in x.items():
            values = np.unique(v[m])
            cuts = (values[:-1] + values[1:]) / 2
            if len(cuts) > max_cuts:
                cuts = cuts[np.linspace(0, len(cuts) - 1, max_cuts).astype(int)]
            order = np.sort(v[m & y]), np.sort(v[m & ~y])
            p = np.searchsorted(order[0], cuts, "right")
            n = np.searchsorted(order[1], cuts, "right")
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0)
                if len(gain) and gain.max() > best:
                    k = int(gain.argmax())
                    best, pick = float(gain[k]), (f, op, float(np.round(cuts[k], 4)))
        if pick is None:
            break
        rule += (pick,)
        m = _mask(x, rule, len(y))
    return rule


def induce(
    x: dict[str, np.ndarray], y: np.ndarray, max_rules: int = 20, max_literals: int = 4, max_cuts: int = 200, seed: int = 7
) -> list[Rule]:
    """Rules for the rows with ``y`` true, in order. The same input gives the same rules."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(y), bool)
    while len(rules) < max_rules and (left & y).any():
        grow = left & (rng.random(len(y)) < 2 / 3)
        prune = left & ~grow
        if not (grow & y).any() or not (prune & y).any():
            break
        rule = _grow({f: v[grow] for f, v in x.items()}, y[grow], max_literals, max_cuts)

        def worth(r: Rule) -> float:
            m = _mask(x, r, len(y)) & prune
            p, n = int((m & y).sum()), int((m & ~y).sum())
            return (p - n) / (p + n) if p + n else -1.0

        best = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        if not best or worth(best) <= 0:
            break
        rules.append(best)
        left &= ~_mask(x, best, len(y))
    return rules


def predict(x: dict[str, np.ndarray], rules: list[Rule], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for r in rules:
        out |= _mask(x, r, n)
    return out


def case_sql(rules: list[Rule]) -> str:
    """A CASE expression with the number of the first rule that holds, 0 for none."""
    if not rules:
        return "0"
    when = " ".join(
        f"WHEN {' AND '.join(f'{f} {op} {t!r}D' for f, op, t in r)} THEN {k}" for k, r in enumerate(rules, 1)
    )
    return f"CASE {when} ELSE 0 END"
