"""Least squares over groups of any size: mergeable moments, then a rank-revealing solve per group.

A group is reduced to its count, means and centred co-moments by one partial aggregation, so a group with most of the
rows is combined map-side like any other. The solve works on one small row per group and stays in the JVM.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.matrix import cell, dot, inverse, pivoted_sweep, product, times_vector
from panelcast.functions.scalars import is_finite
from panelcast.functions.series import let
from panelcast.functions.shape import settle

#: A factor is dependent when the factors before it explain all but this share of its variance.
LEAST_SHARE = 1e-12


def moments(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Per key: ``n`` complete rows, ``means`` and ``comoments`` (sums of centred products) of the factors and ``y``.

    Rows with a null, NaN or infinity in any of them are left out; keys without a complete row have no result. The
    moments are centred while they are merged, so large means do not cost digits.
    """
    columns = [F.col(f"`{c}`").cast("double") for c in (*xs, y)]
    complete = df
    for c in columns:
        complete = complete.where(is_finite(c))
    n = F.count(F.lit(1))
    pairs = {
        f"c{i}_{j}": F.covar_pop(columns[i], columns[j]) * n for i in range(len(columns)) for j in range(i + 1)
    }
    grouped = complete.groupBy(*keys).agg(
        n.alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[c.alias(name) for name, c in pairs.items()],
    )
    square = F.array(*[
        F.array(*[F.col(f"c{max(i, j)}_{min(i, j)}") for j in range(len(columns))]) for i in range(len(columns))
    ])
    means = F.array(*[F.col(f"m{i}") for i in range(len(columns))])
    return grouped.select(*keys, "n", means.alias("means"), square.alias("comoments"))


def solve(df: DataFrame) -> DataFrame:
    """Add ``beta`` (intercept first), ``gram_inverse`` (of X'X, row by row), ``rank``, ``sse``, ``dof``, ``sigma2``.

    Needs the columns of ``moments``. With dependent or constant factors ``beta`` is the solution of least norm,
    intercept included, and ``gram_inverse`` the pseudo-inverse. ``dof`` is n less the number of coefficients, 1 at
    least, whatever the rank.
    """
    spread = F.expr(
        "transform(comoments, (r, i) -> CASE WHEN get(r, i) > 1e-26D * n * get(means, i) * get(means, i) "
        "THEN sqrt(get(r, i)) ELSE 0D END)"
    )
    df = df.withColumn("_s", spread).withColumn("_p", F.size("means") - 1)
    df = settle(df, ["_s", "_p"])
    scaled = """transform(comoments, (r, i) -> transform(r, (v, j) ->
        CASE WHEN get(_s, i) > 0 AND get(_s, j) > 0 THEN v / (get(_s, i) * get(_s, j)) ELSE 0D END))"""
    df = settle(df.withColumn("_w", F.expr(let(scaled, "cm", pivoted_sweep("cm", "_p", LEAST_SHARE)))), ["_w"])
    used = "array_contains(_w.used, {})"

    def on_basis(column: str, of: str) -> str:
        """Coefficients of a column of the swept matrix on the used factors, in the units of the data."""
        return f"""transform(sequence(0, _p - 1), bi -> CASE WHEN {used.format('bi')}
            THEN {cell('_w.a', 'bi', column)} * get(_s, {of}) / get(_s, bi) ELSE 0D END)"""

    centre = "slice(means, 1, _p)"
    basic = let(on_basis("_p", "_p"), "sl", f"concat(array(get(means, _p) - {dot('sl', centre)}), sl)")
    slopes = f"""transform(sequence(0, _p - 1), bi -> transform(sequence(0, _p - 1), bj ->
        CASE WHEN {used.format('bi')} AND {used.format('bj')}
        THEN {cell('_w.a', 'bi', 'bj')} / (get(_s, bi) * get(_s, bj)) ELSE 0D END))"""
    bordered = f"""concat(array(concat(array(1D / n + {dot('cq', centre)}), transform(cq, q -> -q))),
        transform(ci, (r, i) -> concat(array(-get(cq, i)), r)))"""
    basic_inverse = let(slopes, "ci", let(times_vector("ci", centre), "cq", bordered))
    # One vector per dependent factor: itself less its expression by the intercept and the used factors.
    null_vector = let(
        on_basis("dj", "dj"), "dw",
        f"""concat(array({dot('dw', centre)} - get(means, dj)),
            transform(dw, (w, i) -> CASE WHEN i = dj THEN 1D ELSE -w END))""",
    )
    df = df.withColumns(
        {
            "_b": F.expr(basic),
            "_g": F.expr(basic_inverse),
            "_v": F.expr(f"transform(_w.open, dj -> {null_vector})"),
        }
    )
    df = settle(df, ["_b", "_g", "_v"])
    normal = product("_v", f"transform(sequence(0, _p), xj -> transform(_v, xr -> get(xr, xj)))", "size(_v)")
    df = df.withColumn("_k", F.expr(f"CASE WHEN size(_v) > 0 THEN {let(normal, 'kk', inverse('kk'))} END"))
    df = settle(df, ["_k"])
    # What lies in the directions that do not change the fit is taken away.
    shift = let(
        times_vector("_k", times_vector("_v", "_b")), "tt",
        f"transform(_b, (b, i) -> b - {dot('tt', 'transform(_v, xr -> get(xr, i))')})",
    )
    projector = let(
        product("_k", "_v", "_p + 1"), "kv",
        f"""transform(sequence(0, _p), pi -> transform(sequence(0, _p), pj ->
            CASE WHEN pi = pj THEN 1D ELSE 0D END - {dot('transform(_v, xr -> get(xr, pi))',
                                                        'transform(kv, xr -> get(xr, pj))')}))""",
    )
    projected = let(projector, "pp", product(product("pp", "_g", "_p + 1"), "pp", "_p + 1"))
    sse = f"greatest({cell('_w.a', '_p', '_p')}, 0D) * get(get(comoments, _p), _p)"
    out = df.withColumns(
        {
            "beta": F.expr(f"CASE WHEN size(_v) > 0 THEN {shift} ELSE _b END"),
            "gram_inverse": F.expr(f"flatten(CASE WHEN size(_v) > 0 THEN {projected} ELSE _g END)"),
            "rank": F.expr("1 + size(_w.used)"),
            "sse": F.expr(sse),
            "dof": F.expr("greatest(n - _p - 1, 1)"),
        }
    )
    out = settle(out, ["beta", "gram_inverse", "sse"])
    return out.withColumn("sigma2", F.col("sse") / F.col("dof")).drop(*[f"_{c}" for c in "spwbgvk"])


def fit_groups(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Regression of ``y`` on an intercept and ``xs`` per key: ``keys``, ``n``, ``means``, ``comoments`` and what
    ``solve`` adds."""
    return solve(moments(df, keys, y, xs))


def terms(fitted: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """One row per coefficient: ``term`` (intercept or factor), ``beta``, ``std_error``, with rank and variance."""
    names = F.array(F.lit("intercept"), *[F.lit(x) for x in xs])
    width = len(xs) + 1
    listed = F.transform(
        F.arrays_zip(names.alias("term"), F.col("beta").alias("beta")),
        lambda r, i: F.struct(
            r.term.alias("term"), r.beta.alias("beta"),
            F.sqrt(F.greatest(F.get("gram_inverse", i * (width + 1)), F.lit(0.0)) * F.col("sigma2")).alias("std_error"),
        ),
    )
    return fitted.select(*keys, "n", "rank", "sigma2", F.inline(listed))
