"""Ordered-series maths on one array per series, written as Spark SQL expressions.

Every function takes and returns SQL text, so a caller composes one expression and hands it to
``F.expr``. A series holds one value per calendar month: its array is short however large the
data is.
"""


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def known(y: str) -> str:
    """The non-NULL values."""
    return f"filter({y}, v -> v IS NOT NULL)"


def has_gaps(y: str) -> str:
    return f"exists({y}, v -> v IS NULL)"


def mean(y: str) -> str:
    """Mean of an array without NULLs; NULL when it is empty."""
    return let(
        y, "mv",
        "CASE WHEN size(mv) > 0 THEN aggregate(mv, 0D, (s, v) -> s + v) / size(mv) END",
    )


def var_pop(y: str) -> str:
    """Population variance of an array without NULLs, centred first."""
    centred = "aggregate(vv, 0D, (s, v) -> s + (v - vm) * (v - vm)) / size(vv)"
    return let(y, "vv", f"CASE WHEN size(vv) > 0 THEN {let(mean('vv'), 'vm', centred)} END")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> x - y)"


def blank(y: str, mask: str) -> str:
    """NULL where ``mask`` is true."""
    return f"zip_with({y}, {mask}, (v, m) -> CASE WHEN NOT m THEN v END)"


def fill_from(y: str, filler: str) -> str:
    return f"zip_with({y}, {filler}, (v, f) -> coalesce(v, f))"


def interpolate(y: str) -> str:
    """Linear gap fill on position, edges constant; all-NULL stays NULL.

    Only missing positions look for their neighbours, so a complete series costs one pass.
    """
    neighbours = """struct(
        array_max(filter(at, k -> k < i)) AS p, array_min(filter(at, k -> k > i)) AS n)"""
    line = """coalesce(
        get(s, b.p) + (get(s, b.n) - get(s, b.p)) * (i - b.p) / (b.n - b.p),
        get(s, b.p), get(s, b.n))"""
    positions = "filter(sequence(0, size(s) - 1), k -> get(s, k) IS NOT NULL)"
    # Most gaps lie before the first or behind the last value and need no search.
    fill = f"""transform(s, (v, i) -> CASE WHEN v IS NOT NULL THEN v
        WHEN i < ends.first THEN get(s, ends.first) WHEN i > ends.last THEN get(s, ends.last)
        ELSE {let(neighbours, 'b', line)} END)"""
    ends = "struct(get(at, 0) AS first, get(at, size(at) - 1) AS last)"
    return let(y, "s", let(positions, "at", let(ends, "ends", fill)))


def quantile7(v: str, p: float) -> str:
    """Type-7 quantile of a sorted array without NULLs (``v`` must be a plain name)."""
    h = f"((size({v}) - 1) * {p}D)"
    low = f"get({v}, int(floor({h})))"
    high = f"get({v}, least(int(floor({h})) + 1, size({v}) - 1))"
    part = f"({h} - floor({h}))"
    return f"CASE WHEN size({v}) > 0 THEN (1 - {part}) * {low} + {part} * {high} END"


def iqr_fence(resid: str, width: float) -> str:
    """STRUCT(q1, q3, low, high), or NULL when the spread is not positive."""
    quartiles = f"struct({quantile7('rs', 0.25)} AS q1, {quantile7('rs', 0.75)} AS q3)"
    bounds = f"""struct(q.q1 AS q1, q.q3 AS q3,
        q.q1 - {width}D * (q.q3 - q.q1) AS low, q.q3 + {width}D * (q.q3 - q.q1) AS high)"""
    keep = "CASE WHEN f.q3 - f.q1 > 0 AND f.high - f.low > 1e-14D THEN f END"
    return let(
        f"sort_array({known(resid)})", "rs", let(quartiles, "q", let(bounds, "f", keep))
    )


def theil_sen(y: str) -> str:
    """Median-slope line through (1, y1) .. (n, yn); intercept = median(y) - slope * median(t)."""
    slopes = """array_sort(flatten(transform(s, (v, i) -> transform(
        slice(s, i + 2, greatest(size(s) - i - 1, 0)), (w, d) -> (w - v) / (d + 1)))))"""
    offset = f"({quantile7('ordered', 0.5)}) - b * ((size(s) + 1) / 2)"
    line = let(offset, "a", "transform(s, (v, i) -> a + b * (i + 1))")
    with_slope = let(quantile7("slopes", 0.5), "b", line)
    return let(y, "s", let(slopes, "slopes", let("array_sort(s)", "ordered", with_slope)))


def lowess_neighbours(n: str) -> str:
    """Neighbour count: a quarter of short series, a fifth below 100 points, else 15%."""
    frac = f"CASE WHEN {n} < 40 THEN 0.25D WHEN {n} < 100 THEN 0.2D ELSE 0.15D END"
    return f"int(floor({n} * ({frac}) + 1e-10D))"


def lowess(y: str) -> str:
    """Local linear fit with tricube weights on equally spaced points, no robust rounds.

    Neighbours and weights depend on position alone. Values are taken relative to the centre, so
    a point with a single positive weight (its own) reproduces itself exactly.
    """
    window = let(
        "greatest(0, least(size(s) - k, i - int(floor(k / 2))))", "lo",
        """struct(v AS v, lo - i AS first_d, greatest(i - lo, lo + k - 1 - i) AS h,
            slice(s, lo + 1, k) AS near)""",
    )
    cube = "(1 - power(abs(e.first_d + j) / e.h, 3))"
    points = f"""transform(e.near, (v, j) -> struct(
        double(e.first_d + j) AS d, v - e.v AS r,
        CASE WHEN abs(e.first_d + j) < e.h THEN power({cube}, 3) ELSE 0D END AS w))"""
    sums = f"""aggregate({points},
        struct(0D AS w, 0D AS x, 0D AS xx, 0D AS y, 0D AS xy, 0 AS m),
        (a, p) -> struct(a.w + p.w AS w, a.x + p.w * p.d AS x, a.xx + p.w * p.d * p.d AS xx,
            a.y + p.w * p.r AS y, a.xy + p.w * p.d * p.r AS xy,
            a.m + CASE WHEN p.w > 0 THEN 1 ELSE 0 END AS m))"""
    fit = let(
        sums, "t",
        """CASE WHEN t.m <= 1 THEN e.v
            ELSE e.v + (t.xx * t.y - t.x * t.xy) / (t.w * t.xx - t.x * t.x) END""",
    )
    fitted = f"transform(transform(s, (v, i) -> {window}), e -> {fit})"
    return let(y, "s", let(lowess_neighbours("size(s)"), "k", fitted))


def smooth(y: str, season: int) -> str:
    """Robust line for at most one season of points, local linear smoother beyond."""
    return f"CASE WHEN size({y}) <= {season} THEN {theil_sen(y)} ELSE {lowess(y)} END"
