"""Small dense matrices as arrays of rows, in Spark SQL text (see ``series``).

A matrix holds one row and column per factor, so it is small however many rows a group has.
"""

from panelcast.functions.series import let


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (dx, dy) -> dx * dy), 0D, (ds, dv) -> ds + dv)"


def cell(m: str, i: str, j: str) -> str:
    return f"get(get({m}, {i}), {j})"


def transpose(m: str, width: str) -> str:
    """Columns of ``m`` as rows; ``width`` is its number of columns."""
    return f"transform(sequence(0, {width} - 1), tj -> transform({m}, tr -> get(tr, tj)))"


def times_vector(m: str, v: str) -> str:
    return f"transform({m}, mr -> {dot('mr', v)})"


def product(a: str, b: str, width: str) -> str:
    """a b; ``width`` is the number of columns of ``b``."""
    return let(transpose(b, width), "bt", f"transform({a}, ar -> transform(bt, bc -> {dot('ar', 'bc')}))")


def sweep(m: str, k: str) -> str:
    """``m`` after exchanging variable ``k`` (plain names): swept pivots hold the inverse, other columns the
    coefficients of their variable on the swept ones, and the rest what the swept ones leave over."""
    pivot = cell(m, k, k)
    return f"""transform({m}, (wr, wi) -> transform(wr, (wv, wj) -> CASE
        WHEN wi = {k} AND wj = {k} THEN 1D / {pivot}
        WHEN wi = {k} THEN wv / {pivot}
        WHEN wj = {k} THEN -wv / {pivot}
        ELSE wv - get(wr, {k}) * {cell(m, k, 'wj')} / {pivot} END))"""


def inverse(m: str) -> str:
    """Inverse of a positive definite matrix."""
    return f"aggregate(sequence(0, size({m}) - 1), {m}, (im, ik) -> {sweep('im', 'ik')})"


def pivoted_sweep(m: str, n: str, least: float) -> str:
    """STRUCT(a, used, open): the largest remaining diagonal of the first ``n`` variables is swept each time, as in a
    pivoted Cholesky factorisation, while it is above ``least``; ``open`` variables depend on the ``used`` ones."""
    ready = f"filter(st.open, oj -> {cell('st.a', 'oj', 'oj')} > {least!r}D)"
    largest = f"array_max(transform({ready}, oj -> struct({cell('st.a', 'oj', 'oj')} AS v, -oj AS j)))"
    step = f"""CASE WHEN pk IS NULL THEN st ELSE struct({sweep('st.a', 'pk')} AS a,
        array_append(st.used, pk) AS used, array_remove(st.open, pk) AS open) END"""
    start = f"struct({m} AS a, cast(array() AS array<int>) AS used, sequence(0, {n} - 1) AS open)"
    return f"aggregate(sequence(1, {n}), {start}, (st, it) -> {let(f'-({largest}).j', 'pk', step)})"
