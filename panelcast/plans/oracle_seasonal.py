"""Robust seasonal-trend decomposition in DuckDB SQL, written independently of the array code.

A recursive query carries trend, season and robustness weights of every series as lists; one step
is one inner round. The weights of a local line depend on positions alone and are tables.
"""

#: Fixed values of the published method for monthly data.
PERIOD, SEASONAL, TREND, LOW_PASS, INNER, OUTER = 12, 7, 23, 13, 2, 15


def _weights() -> str:
    """Column ``at``: for every evaluated position x the tricube weights w and their moments a = w (q - x), c = a (q - x)."""
    left = "greatest(0, least(len - least(span, len), x - (span + 1) // 2 + 1))"
    reach = f"""(greatest(x - {left}, {left} + least(span, len) - 1 - x)
        + CASE WHEN span > len THEN (span - len) // 2 ELSE 0 END)::double"""
    near = f"q >= {left} AND q < {left} + least(span, len)"
    weight = f"""CASE WHEN NOT ({near}) OR abs(q - x) > 0.999 * {reach} THEN 0
        WHEN abs(q - x) <= 0.001 * {reach} THEN 1
        ELSE pow(1 - pow(abs(q - x) / {reach}, 3), 3) END"""
    return f"""SELECT len, span, ends, list(struct_pack(w := w, a := a, c := c) ORDER BY x) AS at FROM (
        SELECT len, span, ends, x, list(w::double ORDER BY q) AS w, list((w * (q - x))::double ORDER BY q) AS a,
            list((w * (q - x) * (q - x))::double ORDER BY q) AS c
        FROM (SELECT *, {weight} AS w FROM (SELECT *, unnest(range(0, len)) AS q FROM (
            SELECT *, unnest(range(-ends, len + ends)) AS x FROM {{sizes}}))) GROUP BY ALL) GROUP BY ALL"""


def _line(at: str, robust: str, weighted: str, n: str, ends: int, y: str) -> str:
    """Local line at every position of ``at``; where no weight is left, the value itself."""
    sums = f"""list_transform({at}, lambda p: struct_pack(s := list_dot_product({robust}, p.w),
        m := list_dot_product({robust}, p.a), v := list_dot_product({robust}, p.c),
        y := list_dot_product({weighted}, p.w), z := list_dot_product({weighted}, p.a)))"""
    spread = "(o.v / o.s - (o.m / o.s) * (o.m / o.s))"
    slope = f"""CASE WHEN sqrt(greatest({spread}, 0)) > 0.001 * ({n} - 1)
        THEN (o.z / o.s - o.m / o.s * o.y / o.s) / {spread} ELSE 0 END"""
    return f"""list_transform({sums}, lambda o, k: CASE WHEN o.s > 0
        THEN o.y / o.s - o.m / o.s * {slope} ELSE {y}[k - {ends}] END)"""


def _mean(values: str, width: int, n: str) -> str:
    return f"list_transform(range(1, {n} + 1), lambda t: list_sum({values}[t:t + {width - 1}]) / {width})"


def _times(a: str, b: str, n: str, sign: str = "*") -> str:
    return f"list_transform(range(1, {n} + 1), lambda t: {a}[t] {sign} {b}[t])"


def decomposition(name: str) -> list[tuple[str, str]]:
    """Season and trend of the lists ``y`` of ``<name>_lists`` (b, d, f, n, y; n > 24): ``<name>_parts``."""
    last = INNER * (OUTER + 1)
    miss = "list_transform(range(1, n + 1), lambda t: abs(y[t] - season[t] - trend[t]))"
    six_mad = "(3 * (sorted[n // 2 + 1] + sorted[n - n // 2]))"
    bisquare = f"""list_transform(miss, lambda e: CASE WHEN e <= 0.001 * {six_mad} THEN 1
        WHEN e <= 0.999 * {six_mad} THEN pow(1 - pow(e / {six_mad}, 2), 2) ELSE 0 END::double)"""
    month = f"""list_transform(range(0, {PERIOD}), lambda c: struct_pack(
        v := rest[c + 1:n:{PERIOD}], r := robust[c + 1:n:{PERIOD}],
        g := CASE WHEN c < n % {PERIOD} THEN long_at ELSE short_at END))"""
    weighted = "list_transform(months, lambda u: struct_insert(u, z := list_transform(u.v, lambda e, t: e * u.r[t])))"
    cycles = f"list_transform(months, lambda u: {_line('u.g', 'u.r', 'u.z', 'len(u.v)', 1, 'u.v')})"
    whole = "list_transform(cycles, lambda v: list_transform(v, lambda e, t: coalesce(e, v[greatest(2, least(t, len(v) - 1))])))"
    cycle = f"list_transform(range(0, n + {2 * PERIOD}), lambda t: cycles[t % {PERIOD} + 1][t // {PERIOD} + 1])"
    ones = "list_transform(range(0, n), lambda t: 1.0::double)"
    season = f"list_transform(range(1, n + 1), lambda t: cycle[t + {PERIOD}] - smooth[t])"
    step = f"SELECT * FROM {name}_steps WHERE k < {last}"
    step = f"SELECT *, {miss} AS miss FROM ({step})"
    step = f"SELECT *, list_sort(miss) AS sorted FROM ({step})"
    step = f"""SELECT * EXCLUDE (robust), CASE WHEN k > 0 AND k % {INNER} = 0 THEN {bisquare} ELSE robust END AS robust,
        {_times('y', 'trend', 'n', '-')} AS rest FROM ({step})"""
    step = f"""SELECT x.*, l.at AS long_at, s.at AS short_at, t.at AS trend_at, w.at AS low_at FROM ({step}) x
        JOIN {name}_at l ON l.ends = 1 AND l.len = x.n // {PERIOD} + 1 JOIN {name}_at s ON s.ends = 1 AND s.len = x.n // {PERIOD}
        JOIN {name}_at t ON t.ends = 0 AND t.len = x.n AND t.span = {TREND}
        JOIN {name}_at w ON w.ends = 0 AND w.len = x.n AND w.span = {LOW_PASS}"""
    step = f"SELECT *, {month} AS months FROM ({step})"
    step = f"SELECT * REPLACE ({weighted} AS months) FROM ({step})"
    step = f"SELECT *, {cycles} AS cycles FROM ({step})"
    step = f"SELECT * REPLACE ({whole} AS cycles) FROM ({step})"
    step = f"SELECT *, {cycle} AS cycle FROM ({step})"
    step = f"SELECT *, {_mean('cycle', PERIOD, f'(n + {PERIOD + 1})')} AS once FROM ({step})"
    step = f"SELECT *, {_mean('once', PERIOD, '(n + 2)')} AS twice FROM ({step})"
    step = f"SELECT *, {_mean('twice', 3, 'n')} AS low, {ones} AS ones FROM ({step})"
    step = f"SELECT *, {_line('low_at', 'ones', 'low', 'n', 0, 'low')} AS smooth FROM ({step})"
    step = f"SELECT * EXCLUDE (season, rest), {season} AS season FROM ({step})"
    step = f"SELECT *, {_times('y', 'season', 'n', '-')} AS rest FROM ({step})"
    step = f"SELECT *, {_times('rest', 'robust', 'n')} AS weighted FROM ({step})"
    step = f"""SELECT b, d, f, n, y, k + 1, season, {_line('trend_at', 'robust', 'weighted', 'n', 0, 'rest')}, robust
        FROM ({step})"""
    zeros = "list_transform(range(0, n), lambda t: 0.0::double)"
    return [
        (f"{name}_sizes", f"""SELECT DISTINCT n // {PERIOD} + u AS len, {SEASONAL} AS span, 1 AS ends
            FROM {name}_lists, (VALUES (0), (1)) v(u)
            UNION SELECT n, s, 0 FROM {name}_lists, (VALUES ({TREND}), ({LOW_PASS})) v(s)"""),
        (f"{name}_at", _weights().format(sizes=f"{name}_sizes")),
        (f"{name}_steps", f"""SELECT b, d, f, n, y, 0 AS k, {zeros} AS season, {zeros} AS trend, {ones} AS robust
            FROM {name}_lists UNION ALL {step}"""),
        (f"{name}_parts", f"SELECT b, d, f, n, y, season, trend FROM {name}_steps WHERE k = {last}"),
    ]
