"""Ordinary least squares on sums by the sweep operator, as array expressions (M6, M7).

A series is one row: the cross-products over (1, x..., y) as one flat array of m * m numbers. To sweep a feature in
is one ``transform`` of that array, and the same transform sweeps it out again, so a round of backward elimination changes
one feature and inverts nothing. After the sweeps the y column holds the coefficients, the x block the inverse of X'X
and the last entry the residual sum of squares. P-values are the regularised incomplete beta, also as expressions.

Defined cases: a feature that is constant, or that those before it explain exactly, has no coefficient (t and p null) and is
never selected; with no degrees of freedom left the first feature is dropped until there are some; an exact fit has p 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.constants import SIGNIFICANCE_LEVEL

ALIASED = 1e-12       # what the features before a feature leave of its square sum, at most, to leave it out
DEPTH = 400           # terms of the continued fraction
SHIFT = 16            # steps of the gamma ratio's recurrence before its asymptotic series


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _swept(a: str, k: str, m: int) -> str:
    """SQL text: the flat matrix ``a`` with feature ``k`` swept, in or out."""
    d = f"{a}[{k} * {m + 1}]"
    return (f"transform(sequence(0, {m * m - 1}), e -> CASE WHEN e div {m} = {k} AND e % {m} = {k} THEN 1D / {d} "
            f"WHEN e div {m} = {k} THEN {a}[e] / {d} WHEN e % {m} = {k} THEN -{a}[e] / {d} "
            f"ELSE {a}[e] - {a}[(e div {m}) * {m} + {k}] * {a}[{k} * {m} + e % {m}] / {d} END)")


def _gamma_ratio(x: str) -> str:
    """SQL text: gamma(x + 1/2) / gamma(x)."""
    z = f"({x} + {SHIFT})"
    product = f"aggregate(sequence(0, {SHIFT - 1}), 1D, (s, i) -> s * ({x} + i) / ({x} + i + 0.5D))"
    tail = f"(1D - 1D / (8 * {z}) + 1D / (128 * pow({z}, 2)) + 5D / (1024 * pow({z}, 3)) - 21D / (32768 * pow({z}, 4)) - 399D / (262144 * pow({z}, 5)))"
    return f"({product} * sqrt({z}) * {tail})"


def p_value(t: str, dof: str) -> str:
    """SQL text: the two-sided p-value of Student's t; ``t`` and ``dof`` are names."""
    a = f"({dof} / 2D)"
    square = f"({t} * {t} / {dof})"
    x = f"(1D / (1D + {square}))"
    scale = f"(exp(-{a} * log1p({square})) * sqrt({square} / (1D + {square})) * {_gamma_ratio(a)} / sqrt(pi()))"
    low = f"{x} <= ({a} + 1D) / ({a} + 2.5D)"       # else the symmetric form of the fraction
    fraction = _let("u", f"named_struct('a', CASE WHEN {low} THEN {a} ELSE 0.5D END, 'b', CASE WHEN {low} THEN 0.5D ELSE {a} END, "
                         f"'x', CASE WHEN {low} THEN {x} ELSE {square} / (1D + {square}) END)",
                    f"aggregate(sequence({DEPTH}, 1, -1), 1D, (s, j) -> 1D + (CASE WHEN j % 2 = 1 "
                    "THEN -(u.a + j div 2) * (u.a + u.b + j div 2) / ((u.a + 2 * (j div 2)) * (u.a + 2 * (j div 2) + 1)) "
                    "ELSE (j div 2) * (u.b - j div 2) / ((u.a + 2 * (j div 2) - 1) * (u.a + 2 * (j div 2))) END) * u.x / s)")
    return (f"CASE WHEN {t} IS NULL OR {dof} <= 0 THEN CAST(NULL AS DOUBLE) WHEN {t} = 0 THEN 1D WHEN abs({t}) = double('Infinity') THEN 0D "
            f"WHEN {low} THEN {scale} / ({a} * {fraction}) ELSE 1D - {scale} / (0.5D * {fraction}) END")


def _t(k: str, s: str, m: int) -> str:
    """SQL text: the t statistic of the swept feature ``k`` in the state ``s`` (a, kept)."""
    beta, spread = f"{s}.a[{k} * {m} + {m - 1}]", f"({s}.a[{k} * {m + 1}] * {s}.a[{m * m - 1}])"
    return (f"CASE WHEN _n - 1 - size({s}.kept) <= 0 THEN CAST(NULL AS DOUBLE) WHEN {beta} = 0 THEN 0D "
            f"WHEN {spread} <= 0 THEN double('Infinity') ELSE {beta} / sqrt({spread} / (_n - 1 - size({s}.kept))) END")


def matrices(sums: DataFrame, keys: list[str], x: list[str], y: str) -> DataFrame:
    """Of ``series.gram_sums``: keys, ``_n`` and ``_s`` = (a, kept): all features swept in but those left out."""
    names, m = ["", *x, y], len(x) + 2

    def entry(i: int, j: int) -> Column:
        a, b = names[min(i, j)], names[max(i, j)]
        return F.col("n" if not b else f"s_{b}" if not a else f"s_{a}_{b}")
    flat = sums.select(*keys, F.col("n").alias("_n"), F.array(*[entry(i, j) for i in range(m) for j in range(m)]).alias("_a"))
    start = "named_struct('a', _a, 'kept', CAST(array() AS array<int>))"
    step = (f"CASE WHEN s.a[k * {m + 1}] > {ALIASED!r}D * _a[k * {m + 1}] "
            f"THEN named_struct('a', {_swept('s.a', 'k', m)}, 'kept', CASE WHEN k = 0 THEN s.kept ELSE array_append(s.kept, k) END) ELSE s END")
    return flat.select(*keys, "_n", F.expr(f"aggregate(sequence(0, {len(x)}), {start}, (s, k) -> {step})").alias("_s"))


def statistics(sums: DataFrame, keys: list[str], x: list[str], y: str) -> DataFrame:
    """M6: keys, feature, coefficient, t, p of the fit on all features, one row per series and feature."""
    m = len(x) + 2
    each = matrices(sums, keys, x, y).select(*keys, "_n", "_s", F.explode(F.sequence(F.lit(1), F.lit(len(x)))).alias("_k"))
    has = "array_contains(_s.kept, _k)"
    out = each.withColumns({
        "feature": F.get(F.array(*[F.lit(c) for c in x]), F.col("_k") - 1),
        "coefficient": F.expr(f"CASE WHEN {has} THEN _s.a[_k * {m} + {m - 1}] END"),
        "t": F.expr(f"CASE WHEN {has} THEN {_t('_k', '_s', m)} END"),
        "_dof": F.expr("_n - 1 - size(_s.kept)")})
    return out.select(*keys, "feature", "coefficient", "t", F.expr(p_value("t", "_dof")).alias("p"))


def select(sums: DataFrame, keys: list[str], x: list[str], y: str, alpha: float = SIGNIFICANCE_LEVEL) -> DataFrame:
    """M7: keys, selected (names in the order of ``x``) and their p_values: while the feature of the smallest |t| has
    a p-value above ``alpha`` it is swept out."""
    m = len(x) + 2
    dof = "(_n - 1 - size(s.kept))"
    weakest = _let("q", f"transform(s.kept, k -> abs({_t('k', 's', m)}))",
                   "named_struct('t', array_min(q), 'k', s.kept[CAST(coalesce(array_position(q, array_min(q)), 1) - 1 AS INT)])")
    step = _let("w", weakest, _let("v", f"named_struct('t', w.t, 'dof', {dof})",
                f"CASE WHEN coalesce({p_value('v.t', 'v.dof')}, 2D) > {float(alpha)!r}D "
                f"THEN named_struct('a', {_swept('s.a', 'w.k', m)}, 'kept', filter(s.kept, k -> k <> w.k), 'go', true) "
                "ELSE named_struct('a', s.a, 'kept', s.kept, 'go', false) END"))
    start = "named_struct('a', _s.a, 'kept', _s.kept, 'go', true)"
    rounds = f"aggregate(sequence(1, {len(x)}), {start}, (s, r) -> CASE WHEN s.go AND size(s.kept) > 0 THEN {step} ELSE s END)"
    done = matrices(sums, keys, x, y).select(*keys, "_n", F.expr(rounds).alias("_s"))
    names = "array(" + ", ".join("'" + c.replace("'", "\\'") + "'" for c in x) + ")"
    ends = _let("v", f"named_struct('t', {_t('k', '_s', m)}, 'dof', _n - 1 - size(_s.kept))", p_value("v.t", "v.dof"))
    return done.select(*keys, F.expr(f"transform(_s.kept, k -> {names}[k - 1])").alias("selected"),
                       F.expr(f"transform(_s.kept, k -> {ends})").alias("p_values"))
