"""Equivalent DuckDB SQL of the registered queries, written independently of the Spark plans.

One chain of common table expressions per (meter grain, windows); every query selects from it.
Short names inside the chain: b building, d delivery point, f fluid, m month, s start, e end,
v value.
"""

from math import exp, lgamma, log, pi, sqrt

from panelcast.plans.oracle_seasonal import decomposition

#: Far below the shown digits, so that exact halves round alike whatever the order of a sum.
NUDGE = {0: 1e-4, 1: 1e-5, 2: 1e-6, 4: 1e-8, 6: 1e-9}

K = "b, d, f"
NAMED = "b AS id_building_primaire, d AS deliverypoint_id_primaire, f AS fluid"
REFS = ["hdd10", "hdd15", "hdd18", "cdd21", "cdd24", "cdd26"]
STANDARD = ("1996-01-01", "1999-12-31", "2000-01-01", "2000-12-31")
MIDSTART = ("1996-01-01", "1999-12-31", "2000-01-15", "2000-06-30")
SHORT = ("1996-01-01", "1997-12-31", "1998-01-01", "1998-12-31")
LATE = ("1996-01-01", "1999-12-31", "2001-06-01", "2002-06-30")


def t_975(dof: int) -> float:
    """97.5% quantile of Student's t: Simpson's rule over the density, inverted by Newton's steps."""
    scale = exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi)

    def density(x: float) -> float:
        return scale * exp(-(dof + 1) / 2 * log(1 + x * x / dof))

    t = 2.0
    for _ in range(60):
        n, h = 4000, t / 4000
        inner = sum((4 if k % 2 else 2) * density(k * h) for k in range(1, n))
        area = h / 3 * (density(0.0) + inner + density(t))
        step = (0.475 - area) / density(t)
        t += max(-t / 2, min(step, t))
        if abs(step) < 1e-13 * t:
            break
    return t


def r(c: str, digits: int = 2) -> str:
    """Rounded like the Spark side; a rounded -0.0 becomes 0.0."""
    shown = f"round({c} + {NUDGE[digits]:.10f}, {digits})"
    return f"CASE WHEN {shown} = 0 THEN 0::double ELSE {shown} END"


def day(c: str, name: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name}"


def month(c: str = "m", name: str = "month_str") -> str:
    return f"strftime({c}, '%Y-%m') AS {name}"


def views(grain: str) -> list[tuple[str, str]]:
    meter = ("concat('PDL_', cast(c_custkey AS varchar))" if grain == "customer" else
             "concat('PDL_', cast(c_nationkey AS varchar), '_', c_mktsegment)")
    by_supplier = """lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey"""
    return [
        ("fx_building", """SELECT concat('B_', cast(r_regionkey AS varchar)) AS b, r_name AS name,
            concat('ST_', cast(r_regionkey AS varchar)) AS station,
            cast(1000 * r_regionkey AS double) AS surface, 10 * r_regionkey AS occupant
            FROM region"""),
        ("fx_deliverypoint", f"""SELECT DISTINCT {meter} AS d,
            concat('B_', cast(n_regionkey AS varchar)) AS b, c_mktsegment AS f, 'kWh' AS unit
            FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
        ("fx_invoice", f"""SELECT o_orderkey AS id, {meter} AS d, cast(o_orderdate AS date) AS s,
            CASE WHEN o_orderkey % 211 = 0 THEN NULL
                ELSE cast(o_orderdate AS date) + cast(o_orderkey % 70 AS int) END AS e,
            CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 0.0
                ELSE o_totalprice END AS v
            FROM orders JOIN customer ON o_custkey = c_custkey"""),
        ("fx_degreedays", f"""SELECT concat('ST_', cast(n_regionkey AS varchar)) AS station,
            strftime(l_shipdate, '%Y-%m') AS ym, ind, basis,
            sum(CASE WHEN ind = 'hdd' THEN greatest(basis - l_quantity, 0)
                ELSE greatest(l_quantity - basis, 0) END) AS value
            FROM {by_supplier}
            CROSS JOIN (VALUES ('hdd', 10), ('hdd', 15), ('hdd', 18), ('cdd', 21), ('cdd', 24),
                ('cdd', 26)) r(ind, basis)
            GROUP BY 1, 2, 3, 4"""),
        ("fx_usage", f"""SELECT concat('B_', cast(n_regionkey AS varchar)) AS b,
            cast(l_shipdate AS date) AS day, concat('fi_', l_returnflag) AS type,
            l_quantity AS value FROM {by_supplier}"""),
    ]


def panel(grain: str, window: tuple[str, str, str, str]) -> list[tuple[str, str]]:
    start_ref, end_ref, start_pred, end_pred = window
    wide = ", ".join(
        f"max(CASE WHEN ind = '{c[:3]}' AND basis = {c[3:]} THEN value END) AS {c}, "
        f"bool_or(ind = '{c[:3]}' AND basis = {c[3:]}) AS has_{c}" for c in REFS
    )
    anchor = " ".join(f"WHEN bool_or(has_{c}) OVER w THEN has_{c}" for c in REFS)
    masked = ", ".join(f"CASE WHEN anchored THEN {c} END AS {c}" for c in REFS)
    return views(grain) + [
        ("params", f"""SELECT b, DATE '{start_ref}' AS start_ref, DATE '{end_ref}' AS end_ref,
            DATE '{start_pred}' AS start_pred, DATE '{end_pred}' AS end_pred FROM fx_building"""),
        ("inv", """SELECT i.id, p.b, p.d, p.f, p.unit, i.s, i.e, i.v,
            date_diff('day', i.s, i.e) + 1 AS dur
            FROM fx_invoice i JOIN fx_deliverypoint p ON i.d = p.d"""),
        ("dedup", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, f, s
            ORDER BY e NULLS LAST, id) AS rn FROM inv) WHERE rn = 1"""),
        ("daily", f"""SELECT id, {K}, date_trunc('month', day) AS m, count(*) AS days FROM (
            SELECT id, {K}, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS day FROM dedup
            WHERE date_trunc('month', s) <> date_trunc('month', e) AND dur > 0 AND v IS NOT NULL)
            GROUP BY ALL"""),
        ("pieces", f"""SELECT id, {K}, s AS s0, s, e, v, dur, false AS pr FROM dedup
            WHERE s IS NULL OR e IS NULL OR date_trunc('month', s) = date_trunc('month', e)
            UNION ALL
            SELECT x.id, x.b, x.d, x.f, x.s, cast(y.m AS date), last_day(y.m),
                x.v * y.days / x.dur, day(last_day(y.m)), true
            FROM dedup x JOIN daily y ON x.id = y.id AND x.d = y.d AND x.f = y.f AND x.b = y.b"""),
        ("monthly", f"""SELECT {K}, min(s) AS s, max(e) AS e, coalesce(sum(v), 0) AS v,
            (array_agg(id ORDER BY s NULLS LAST, pr, s0))[1] AS first_id
            FROM pieces WHERE e IS NOT NULL GROUP BY {K}, date_trunc('month', e)"""),
        ("pred_months", """SELECT b, cast(unnest(generate_series(
            CASE WHEN day(start_pred) = 1 THEN start_pred
                ELSE cast(date_trunc('month', start_pred) + INTERVAL 1 MONTH AS date) END,
            cast(date_trunc('month', end_pred) AS date), INTERVAL 1 MONTH)) AS date) AS m
            FROM params"""),
        ("spine", f"""SELECT {K}, cast(date_trunc('month', s) AS date) AS m FROM monthly
            UNION
            SELECT k.b, k.d, k.f, p.m FROM (SELECT DISTINCT {K} FROM monthly) k
            JOIN pred_months p ON k.b = p.b"""),
        ("by_start", f"""SELECT {K}, cast(date_trunc('month', s) AS date) AS m, min(s) AS s,
            max(e) AS e, sum(v) AS v FROM monthly GROUP BY ALL"""),
        ("weather", f"SELECT station, ym, {wide} FROM fx_degreedays GROUP BY 1, 2"),
        ("anchored", f"""SELECT z.b, z.d, z.f, z.m, coalesce(i.s, z.m) AS s,
            coalesce(i.e, last_day(z.m)) AS e, i.v, w.* EXCLUDE (station, ym),
            CASE {anchor} END AS anchored
            FROM spine z JOIN fx_building g ON z.b = g.b
            LEFT JOIN by_start i ON z.b = i.b AND z.d = i.d AND z.f = i.f AND z.m = i.m
            LEFT JOIN weather w ON w.station = g.station AND w.ym = strftime(z.m, '%Y-%m')
            WINDOW w AS (PARTITION BY z.b, z.d, z.f)"""),
        ("panel", f"""SELECT a.b, a.d, a.f, a.m, a.s, a.e, a.v, {masked},
            coalesce(a.v IS NOT NULL AND a.s >= start_ref AND a.e <= end_ref, false) AS is_train,
            a.m BETWEEN date_trunc('month', start_pred) AND date_trunc('month', end_pred)
                AS is_test
            FROM anchored a JOIN params p ON a.b = p.b"""),
        ("usage_month", """SELECT u.b, cast(date_trunc('month', day) AS date) AS m, type,
            avg(value) AS value FROM fx_usage u JOIN params p ON u.b = p.b
            WHERE day BETWEEN least(start_ref, start_pred) AND greatest(end_ref, end_pred)
            GROUP BY ALL"""),
        ("usage_types", """SELECT b, type FROM usage_month GROUP BY ALL
            HAVING count(value) = 1 OR min(value) <> max(value)"""),
        ("factor_pos", f"""SELECT p.b, p.d, p.f, p.m, t.type, u.value,
            row_number() OVER (PARTITION BY p.b, p.d, p.f, t.type ORDER BY p.m) AS pos
            FROM panel p JOIN usage_types t ON p.b = t.b
            LEFT JOIN usage_month u ON u.b = p.b AND u.m = p.m AND u.type = t.type"""),
        *filled("factor", "factor_pos", f"{K}, type", "m", "value"),
        ("factors", f"""SELECT {K}, m, max(CASE WHEN type = 'fi_A' THEN filled END) AS fi_A,
            max(CASE WHEN type = 'fi_N' THEN filled END) AS fi_N,
            max(CASE WHEN type = 'fi_R' THEN filled END) AS fi_R
            FROM factor_filled GROUP BY ALL"""),
    ]


def filled(name: str, source: str, keys: str, order: str, value: str) -> list[tuple[str, str]]:
    """Linear interpolation on ``pos``; the result is ``<name>_filled`` with column ``filled``."""
    past = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    ahead = f"""OVER (PARTITION BY {keys} ORDER BY {order}
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
    at = f"CASE WHEN {value} IS NOT NULL THEN pos END"
    return [
        (f"{name}_ends", f"""SELECT *, last_value({value} IGNORE NULLS) {past} AS v0,
            last_value({at} IGNORE NULLS) {past} AS p0,
            first_value({value} IGNORE NULLS) {ahead} AS v1,
            first_value({at} IGNORE NULLS) {ahead} AS p1 FROM {source}"""),
        (f"{name}_filled", f"""SELECT *, coalesce({value},
            v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v0, v1) AS filled
            FROM {name}_ends"""),
    ]


def decisions() -> list[tuple[str, str]]:
    pairs = " UNION ALL ".join(
        f"SELECT {K}, '{c}' AS ref, {o} AS o, v AS y, {c} AS x FROM train" for o, c in enumerate(REFS)
    )
    picked = {
        n: "CASE " + " ".join(f"WHEN {n} = '{c}' THEN t.{c}" for c in REFS) + f" WHEN {n} IS NULL "
        "THEN 0 END" for n in ("best_hdd", "best_cdd")
    }
    return [
        ("train", f"""SELECT *, row_number() OVER w - 1 AS i,
            count(*) OVER (PARTITION BY {K}) AS n FROM panel WHERE is_train
            WINDOW w AS (PARTITION BY {K} ORDER BY m)"""),
        ("counts", f"""SELECT k.b, k.d, k.f, count(t.v) AS n_train,
            count(CASE WHEN t.v = 0 THEN 1 END) AS n_zero, avg(t.v) AS mean_v,
            stddev_samp(t.v) AS sd_v
            FROM (SELECT DISTINCT {K} FROM panel) k
            LEFT JOIN train t ON k.b = t.b AND k.d = t.d AND k.f = t.f GROUP BY ALL"""),
        ("decision", """SELECT *, CASE WHEN n_zero = n_train THEN 'note_000'
            WHEN n_train < 6 THEN 'note_001' ELSE 'note_annual_ref' END AS code FROM counts"""),
        ("pairs", pairs),
        ("univariate", f"""SELECT {K}, ref, o, count(*) AS n, regr_sxx(y, x) AS sxx,
            regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
            FROM pairs WHERE x IS NOT NULL GROUP BY ALL"""),
        ("scored", f"""SELECT {K}, ref, o, 1 - (1 - CASE WHEN sxx = 0 THEN 0
            ELSE sxy * sxy / sxx / syy END) * (n - 1) / (n - 2) AS adj
            FROM univariate WHERE n >= 6 AND syy > 1e-12"""),
        ("ranked", f"""SELECT *, row_number() OVER (PARTITION BY {K}, ref[1:3]
            ORDER BY adj DESC, o) AS rk FROM scored"""),
        ("best", f"""SELECT k.b, k.d, k.f, h.ref AS best_hdd, c.ref AS best_cdd
            FROM (SELECT DISTINCT {K} FROM panel) k
            LEFT JOIN ranked h ON k.b = h.b AND k.d = h.d AND k.f = h.f AND h.rk = 1
                AND h.ref[1:3] = 'hdd'
            LEFT JOIN ranked c ON k.b = c.b AND k.d = c.d AND k.f = c.f AND c.rk = 1
                AND c.ref[1:3] = 'cdd'"""),
        ("chosen_all", f"""SELECT t.b, t.d, t.f, t.m, t.s, t.e, t.v, t.is_train, t.is_test,
            z.best_hdd, z.best_cdd, {picked['best_hdd']} AS xa, {picked['best_cdd']} AS xb,
            CAST(z.best_hdd IS NOT NULL AS int) + CAST(z.best_cdd IS NOT NULL AS int) AS p
            FROM panel t JOIN best z ON t.b = z.b AND t.d = z.d AND t.f = z.f
            JOIN decision q ON t.b = q.b AND t.d = q.d AND t.f = q.f
            WHERE q.code = 'note_annual_ref'"""),
        ("chosen", f"""SELECT *, row_number() OVER w - 1 AS i,
            count(*) OVER (PARTITION BY {K}) AS n FROM chosen_all WHERE is_train
            WINDOW w AS (PARTITION BY {K} ORDER BY m)"""),
    ]


def fit(name: str, source: str, y: str, where: str = "true") -> list[tuple[str, str]]:
    """Full-rank two-factor least squares per series, centred: ``<name>_fit``."""
    return [
        (f"{name}_rows", f"""SELECT *, {y} - avg({y}) OVER w AS cy, xa - avg(xa) OVER w AS ca,
            xb - avg(xb) OVER w AS cb FROM {source}
            WHERE {y} IS NOT NULL AND xa IS NOT NULL AND xb IS NOT NULL AND ({where})
            WINDOW w AS (PARTITION BY {K})"""),
        (f"{name}_sums", f"""SELECT {K}, count(*) AS fn, max(p) AS fp, avg({y}) AS my,
            avg(xa) AS ma, avg(xb) AS mb, sum(ca * ca) AS saa, sum(cb * cb) AS sbb,
            sum(ca * cb) AS sab, sum(ca * cy) AS say, sum(cb * cy) AS sby, sum(cy * cy) AS syy
            FROM {name}_rows GROUP BY {K}"""),
        (f"{name}_slopes", f"""SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
            (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb
            FROM {name}_sums WHERE fp > 0 AND fn >= fp + 2"""),
        (f"{name}_fit", f"""SELECT *, my - ba * ma - bb * mb AS b0,
            greatest(0, syy - ba * say - bb * sby) AS sse,
            CASE WHEN syy > 1e-12 THEN 1 - (greatest(0, syy - ba * say - bb * sby) / syy)
                * (fn - 1) / (fn - fp - 1) END AS adj FROM {name}_slopes"""),
    ]


def smoother(name: str, source: str, y: str) -> list[tuple[str, str]]:
    """Theil-Sen up to 12 points, tricube local line beyond: ``<name>_smooth(b, d, f, i, sm)``."""
    return [
        (f"{name}_slope", f"""SELECT p.b, p.d, p.f,
            quantile_cont((q.{y} - p.{y}) / (q.i - p.i), 0.5) AS slope
            FROM {source} p JOIN {source} q ON p.b = q.b AND p.d = q.d AND p.f = q.f AND p.i < q.i
            WHERE p.n <= 12 GROUP BY ALL"""),
        (f"{name}_mid", f"""SELECT {K}, quantile_cont({y}, 0.5) AS mid, max(n) AS nn
            FROM {source} WHERE n <= 12 GROUP BY {K}"""),
        (f"{name}_window", f"""SELECT *, greatest(i - lo, lo + k - 1 - i) AS h FROM (
            SELECT {K}, i, {y} AS yi, k, greatest(0, least(n - k, i - k // 2)) AS lo FROM (
            SELECT *, cast(floor(n * CASE WHEN n < 40 THEN 0.25 WHEN n < 100 THEN 0.2 ELSE 0.15 END
                + 1e-10) AS int) AS k FROM {source} WHERE n > 12))"""),
        (f"{name}_near", f"""SELECT w.b, w.d, w.f, w.i, w.yi, q.i - w.i AS dx, q.{y} - w.yi AS dy,
            CASE WHEN abs(q.i - w.i) < w.h
                THEN pow(1 - pow(abs(q.i - w.i) / w.h, 3), 3) ELSE 0 END AS wt
            FROM {name}_window w JOIN {source} q ON w.b = q.b AND w.d = q.d AND w.f = q.f
                AND q.i BETWEEN w.lo AND w.lo + w.k - 1"""),
        (f"{name}_local", f"""SELECT {K}, i, any_value(yi) AS yi,
            count(CASE WHEN wt > 0 THEN 1 END) AS m, sum(wt) AS sw, sum(wt * dx) AS sx,
            sum(wt * dx * dx) AS sxx, sum(wt * dy) AS sy, sum(wt * dx * dy) AS sxy
            FROM {name}_near GROUP BY {K}, i"""),
        (f"{name}_smooth", f"""SELECT {K}, i, CASE WHEN m <= 1 THEN yi
            ELSE yi + (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) END AS sm FROM {name}_local
            UNION ALL
            SELECT x.b, x.d, x.f, x.i, g.mid - t.slope * (g.nn + 1) / 2 + t.slope * (x.i + 1)
            FROM {source} x JOIN {name}_slope t ON x.b = t.b AND x.d = t.d AND x.f = t.f
            JOIN {name}_mid g ON x.b = g.b AND x.d = g.d AND x.f = g.f WHERE x.n <= 12"""),
    ]


def detection(source: str, y: str, seasonal: bool = False) -> list[tuple[str, str]]:
    """Two-pass detection: ``flags(b, d, f, i, hit)``; ``seasonal`` adds the steps of series over two years."""

    flat = "{0}_adjusted" if seasonal else "{0}_varying"
    again = "again_whole" if seasonal else "again_filled"

    def one(name: str, rows: str, col: str) -> list[tuple[str, str]]:
        return [
            (f"{name}_varying", f"""SELECT * FROM (SELECT *, stddev_pop({col}) OVER
                (PARTITION BY {K}) AS spread FROM {rows}) WHERE spread > 1e-8"""),
            *(adjusted(name, f"{name}_varying", col) if seasonal else []),
            *smoother(name, flat.format(name), col),
            (f"{name}_resid", f"""SELECT x.b, x.d, x.f, x.i, x.{col} - s.sm AS resid
                FROM {flat.format(name)} x JOIN {name}_smooth s
                ON x.b = s.b AND x.d = s.d AND x.f = s.f AND x.i = s.i"""),
            (f"{name}_fence", f"""SELECT {K}, quantile_cont(resid, 0.25) AS q1,
                quantile_cont(resid, 0.75) AS q3 FROM {name}_resid GROUP BY {K}"""),
            (f"{name}_hits", f"""SELECT x.b, x.d, x.f, x.i FROM {name}_resid x
                JOIN {name}_fence g ON x.b = g.b AND x.d = g.d AND x.f = g.f
                WHERE g.q3 - g.q1 > 0 AND (x.resid < g.q1 - 3 * (g.q3 - g.q1)
                    OR x.resid > g.q3 + 3 * (g.q3 - g.q1))"""),
        ]

    return [
        ("series_in", f"SELECT {K}, i, n, {y} AS y, i AS pos FROM {source}"),
        *one("pass1", "series_in", "y"),
        ("blanked", f"""SELECT x.b, x.d, x.f, x.i, x.n, x.pos,
            CASE WHEN h.i IS NULL THEN x.y END AS y
            FROM series_in x SEMI JOIN pass1_hits k ON x.b = k.b AND x.d = k.d AND x.f = k.f
            LEFT JOIN pass1_hits h ON x.b = h.b AND x.d = h.d AND x.f = h.f AND x.i = h.i"""),
        *filled("again", "blanked", K, "i", "y"),
        *(seasonally_filled("again", "again_filled", "y") if seasonal else []),
        *one("pass2", again, "filled"),
        ("hits", "SELECT * FROM pass1_hits UNION SELECT * FROM pass2_hits"),
        ("flags", f"""SELECT x.b, x.d, x.f, x.i, h.i IS NOT NULL AS hit FROM series_in x
            LEFT JOIN hits h ON x.b = h.b AND x.d = h.d AND x.f = h.f AND x.i = h.i"""),
    ]


def adjusted(name: str, source: str, y: str) -> list[tuple[str, str]]:
    """Complete series without their season where it is strong: ``<name>_adjusted`` with ``strength``."""
    same = "x.b = p.b AND x.d = p.d AND x.f = p.f"
    spread = "list_aggregate(list_transform(y, lambda v, t: v - trend[t]{0}), 'var_pop')"
    rest, whole = spread.format(" - season[t]"), spread.format("")
    return [
        (f"{name}_lists", f"SELECT {K}, n, list({y}::double ORDER BY i) AS y FROM {source} WHERE n > 24 GROUP BY {K}, n"),
        *decomposition(name),
        (f"{name}_strength", f"""SELECT {K}, season, CASE WHEN {whole} = 0 THEN 0 ELSE 1 - {rest} / {whole} END AS strength
            FROM {name}_parts"""),
        (f"{name}_adjusted", f"""SELECT x.* REPLACE (CASE WHEN p.strength >= 0.6 THEN x.{y} - p.season[x.i + 1]
            ELSE x.{y} END AS {y}), p.strength FROM {source} x LEFT JOIN {name}_strength p ON {same}"""),
    ]


def seasonally_filled(name: str, source: str, y: str) -> list[tuple[str, str]]:
    """Gaps of the linearly filled rows of ``source`` by trend and season beyond two years: ``<name>_whole``."""
    same = "x.b = p.b AND x.d = p.d AND x.f = p.f"
    return [
        (f"{name}_lists", f"""SELECT {K}, n, list(filled::double ORDER BY i) AS y FROM {source} WHERE n > 24
            GROUP BY {K}, n HAVING count({y}) < count(*)"""),
        *decomposition(name),
        (f"{name}_whole", f"""SELECT x.* REPLACE (coalesce(x.{y}, p.trend[x.i + 1] + p.season[x.i + 1], x.filled) AS filled)
            FROM {source} x LEFT JOIN {name}_parts p ON {same}"""),
    ]


def structural() -> list[tuple[str, str]]:
    """Level of a local linear trend per blanked series of at most two seasons: ``level``.

    The covariance of every grid point is built from closed forms and eliminated in place,
    next to the data and the two trend columns.
    """
    take = "list_transform(s.m, lambda w: w[n + {0}])"
    low = "least(p, q)"
    ramp = f"({low} - 1) * {low} * (2 * {low} - 1) / 6.0 + abs(p - q) * {low} * ({low} - 1) / 2.0"
    return [
        ("lined", f"""SELECT {K}, list(filled ORDER BY i) AS y, count(*) AS n FROM rank_filled
            GROUP BY {K} HAVING bool_or(hit) AND count(kept) >= 3"""),
        ("grid", """SELECT row_number() OVER (ORDER BY ql, qs) AS g, ql, qs
            FROM (VALUES (0.0), (0.01), (0.1), (1.0), (10.0)) l(ql)
            CROSS JOIN (VALUES (0.0), (0.001), (0.01), (0.1)) r(qs)"""),
        ("system", f"""SELECT {K}, n, y, g, list_transform(range(0, n), lambda p: list_concat(
                list_transform(range(0, n), lambda q: (CASE WHEN p = q THEN 1 ELSE 0 END
                    + ql * least(p, q) + qs * ({ramp}))::double),
                [y[p + 1]::double, 1.0::double, p::double])) AS m
            FROM lined CROSS JOIN grid"""),
        ("reduced", f"""SELECT {K}, n, y, g, list_reduce(list_concat(
                [{{'m': m, 'ld': 0.0::double, 'k': 0::bigint}}],
                list_transform(range(1, n + 1),
                    lambda k: {{'m': NULL::double[][], 'ld': NULL::double, 'k': k::bigint}})),
            lambda a, x: {{'m': list_transform(a.m, lambda w, z: CASE WHEN z = x.k
                    THEN list_transform(w, lambda c: c / w[x.k])
                    ELSE list_transform(w, lambda c, o: c - w[x.k] * a.m[x.k][o] / a.m[x.k][x.k]) END),
                'ld': a.ld + ln(a.m[x.k][x.k]), 'k': x.k}}) AS s FROM system"""),
        ("solved", f"""SELECT *, list_dot_product(t, u) AS b2, list_sum(u) AS b1,
            list_sum(o) AS a11, list_sum(h) AS a12, list_dot_product(t, h) AS a22 FROM (
            SELECT {K}, n, y, g, s.ld AS ld, {take.format(1)} AS u, {take.format(2)} AS o,
            {take.format(3)} AS h, list_transform(range(0, n), lambda p: p::double) AS t FROM reduced)"""),
        ("weighed", f"""SELECT *, list_transform(range(1, n + 1), lambda p: u[p]
            - (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) * o[p]
            - (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) * h[p]) AS e FROM solved"""),
        ("rated", """SELECT *, row_number() OVER (PARTITION BY b, d, f ORDER BY -((n - 2)
            * ln(greatest(list_dot_product(y, e), 1e-12 * list_dot_product(y, y)) / (n - 2))
            + ld + ln(a11 * a22 - a12 * a12)) DESC, g) AS place FROM weighed"""),
        ("level", f"""SELECT {K}, unnest(range(0, n)) AS i,
            unnest(list_transform(range(1, n + 1), lambda p: y[p] - e[p])) AS level
            FROM rated WHERE place = 1"""),
        ("rank_mean", """SELECT x.* EXCLUDE (filled), CASE WHEN x.hit
            THEN (x.filled + coalesce(l.level, x.filled)) / 2 ELSE x.filled END AS filled
            FROM rank_filled x LEFT JOIN level l
            ON x.b = l.b AND x.d = l.d AND x.f = l.f AND x.i = l.i"""),
    ]


def target() -> list[tuple[str, str]]:
    """Correction, zero rule and final choice for series of at most two seasons: ``final_rows``."""
    same = "x.b = {0}.b AND x.d = {0}.d AND x.f = {0}.f"
    score = """LEFT JOIN {0}_fit {0} ON x.b = {0}.b AND x.d = {0}.d AND x.f = {0}.f"""
    return [
        *detection("chosen", "v"),
        ("gapped", f"""SELECT x.*, g.hit, x.i AS pos, CASE WHEN NOT g.hit THEN x.v END AS kept
            FROM chosen x JOIN flags g ON {same.format('g')} AND x.i = g.i"""),
        *filled("rank", "gapped", K, "i", "kept"),
        *structural(),
        *fit("refit", "rank_mean", "filled"),
        ("corrected", f"""SELECT x.*, CASE WHEN x.hit THEN
            coalesce(r.b0 + r.ba * x.xa + r.bb * x.xb, x.filled) ELSE x.v END AS cor
            FROM rank_mean x LEFT JOIN refit_fit r ON {same.format('r')}"""),
        *fit("imp", "corrected", "v"),
        *fit("imp_nz", "corrected", "v", "v <> 0"),
        *fit("cor", "corrected", "cor"),
        *fit("cor_nz", "corrected", "cor", "v <> 0"),
        ("facts", f"""SELECT {K}, count(CASE WHEN hit THEN 1 END) AS n_hits,
            count(CASE WHEN v = 0 THEN 1 END) AS n_zeros FROM corrected GROUP BY {K}"""),
        ("rules", f"""SELECT x.*, imp.adj AS s_all, cor.adj AS c_all, cor_nz.adj AS c_nz,
            CASE WHEN n_zeros = 0 THEN imp.adj ELSE imp_nz.adj END AS s_nz
            FROM facts x {score.format('imp')} {score.format('imp_nz')} {score.format('cor')}
            {score.format('cor_nz')}"""),
        ("zero_rule", """SELECT *, s_nz IS NOT NULL
            AND s_nz >= coalesce(s_all, '-infinity'::double) AS drop_zeros FROM rules"""),
        ("choice", """SELECT *, CASE WHEN n_hits = 0
            OR coalesce(CASE WHEN drop_zeros THEN s_nz ELSE s_all END, '-infinity'::double)
                >= coalesce(CASE WHEN drop_zeros THEN c_nz ELSE c_all END, '-infinity'::double)
            THEN 'consumption_imputation' ELSE 'consumption_correction' END AS best_y
            FROM zero_rule"""),
        ("final_rows", f"""SELECT x.*, c.drop_zeros, c.best_y,
            CASE WHEN c.best_y = 'consumption_imputation' THEN x.v ELSE x.cor END AS y_final
            FROM corrected x JOIN choice c ON {same.format('c')}
            WHERE NOT c.drop_zeros OR x.v <> 0"""),
    ]


def final_models() -> list[tuple[str, str]]:
    """Models over ``final_rows``: a regression on both references from six rows on, else the mean: ``models``."""
    same = "x.b = {0}.b AND x.d = {0}.d AND x.f = {0}.f"
    return [
        *fit("model", "final_rows", "y_final"),
        ("final_errors", f"""SELECT x.b, x.d, x.f, w.b0 + w.ba * x.xa + w.bb * x.xb AS h, x.y_final AS y
            FROM final_rows x JOIN model_fit w ON {same.format('w')}
            WHERE w.fn >= 6 AND x.y_final IS NOT NULL AND x.xa IS NOT NULL AND x.xb IS NOT NULL"""),
        ("final_measures", f"""SELECT {K}, avg(h) AS mean_h, avg(h - y) AS me, sqrt(avg((h - y) * (h - y))) AS rmse,
            avg(abs(h - y)) AS mae, avg((h - y) / nullif(h, 0) * 100) AS mpe,
            avg(abs((h - y) / nullif(h, 0)) * 100) AS mape FROM final_errors GROUP BY {K}"""),
        ("final_outliers", f"""SELECT {K}, string_agg(concat(strftime(m, '%Y-%m'), '=',
            printf('%.1f', {r('cor', 1)})), ',' ORDER BY m) AS outliers FROM final_rows WHERE hit GROUP BY {K}"""),
        ("final_notes", f"""SELECT {K}, concat('anomalous values: ', count(*), '; [',
            string_agg(strftime(m, '%Y-%m'), ', ' ORDER BY m), ']') AS notes FROM corrected WHERE hit GROUP BY {K}"""),
        ("models", f"""SELECT x.b, x.d, x.f, x.code, x.mean_v, x.sd_v, w.b0, w.ba, w.bb, w.adj,
            1 - w.sse / w.syy AS r2, g.* EXCLUDE (b, d, f), z.best_hdd, z.best_cdd, c.best_y, o.outliers, s.notes,
            CASE WHEN x.code = 'note_000' THEN NULL WHEN g.b IS NOT NULL THEN 'ols_dju_plus_factors'
                ELSE 'mean' END AS family,
            CASE WHEN x.code = 'note_000' THEN NULL WHEN g.b IS NOT NULL THEN 12 * g.mean_h
                ELSE 12 * x.mean_v END AS annual
            FROM decision x LEFT JOIN final_measures g ON {same.format('g')}
            LEFT JOIN model_fit w ON {same.format('w')} AND g.b IS NOT NULL
            LEFT JOIN best z ON {same.format('z')} AND g.b IS NOT NULL
            LEFT JOIN choice c ON {same.format('c')} AND g.b IS NOT NULL
            LEFT JOIN final_outliers o ON {same.format('o')} LEFT JOIN final_notes s ON {same.format('s')}"""),
    ]


def gapped() -> list[tuple[str, str]]:
    """Two of seven months unknown (``kept``), and filled linearly: ``rank_filled``."""
    return [
        ("marked", "SELECT *, (12 * year(m) + month(m)) % 7 < 2 AS hit FROM chosen"),
        ("gapped", "SELECT *, i AS pos, CASE WHEN NOT hit THEN v END AS kept FROM marked"),
        *filled("rank", "gapped", K, "i", "kept"),
    ]


def seasonal_arm() -> list[tuple[str, str]]:
    """Unknown months of series over two years: the season, and a line between what is left without it."""
    same = "x.b = p.b AND x.d = p.d AND x.f = p.f"
    return [
        ("arm_lists", f"""SELECT {K}, n, list(filled::double ORDER BY i) AS y FROM rank_filled WHERE n > 24
            GROUP BY {K}, n HAVING count(kept) >= 3 AND count(kept) < count(*)"""),
        *decomposition("arm"),
        ("without_season", f"""SELECT x.* EXCLUDE (filled, v0, p0, v1, p1), p.season[x.i + 1] AS season,
            x.kept - coalesce(p.season[x.i + 1], 0) AS rest FROM rank_filled x
            LEFT JOIN arm_parts p ON {same} WHERE x.n > 24"""),
        *filled("rest", "without_season", K, "i", "rest"),
    ]


def with_gaps() -> list[tuple[str, str]]:
    """Two of seven months unknown, filled by the ranking mean, then by the fit of the known rows: ``imputed``."""
    same = "x.b = {0}.b AND x.d = {0}.d AND x.f = {0}.f"
    low = "coalesce({0}.adj, '-infinity'::double)"
    return [
        *gapped(),
        *structural(),
        *fit("known", "rank_mean", "kept"),
        ("imputed", f"""SELECT x.*, CASE WHEN x.hit THEN coalesce(w.b0 + w.ba * x.xa + w.bb * x.xb, x.filled)
            ELSE x.v END AS imp FROM rank_mean x LEFT JOIN known_fit w ON {same.format('w')}"""),
        *fit("whole", "imputed", "imp"),
        ("gap_facts", f"""SELECT x.*, n_missing > 0 AND {low.format('whole')} < {low.format('known')} AS raw_wins
            FROM (SELECT {K}, count(*) FILTER (WHERE hit) AS n_missing, count(*) AS n_rows FROM imputed GROUP BY {K}) x
            LEFT JOIN whole_fit whole ON {same.format('whole')} LEFT JOIN known_fit known ON {same.format('known')}"""),
    ]


def gauss_jordan(name: str, source: str, keys: str, xs: list[str]) -> list[tuple[str, str]]:
    """Coefficients, inverse of X'X and variance per key by plain elimination on the raw normal equations."""
    p = len(xs) + 1
    cols = ["1.0", *[f"cast({x} AS double)" for x in xs]]
    gram = ", ".join("[" + ", ".join(
        [f"sum({a} * {b})" for b in cols] + [f"{float(i == j)}::double" for j in range(p)]) + "]"
        for i, a in enumerate(cols))
    fitted = " + ".join(f"beta[{i + 1}] * {a}" for i, a in enumerate(cols))
    rest = f"""list_transform(range(1, {2 * p + 1}), lambda j: CASE WHEN i = k THEN a[k][j] / a[k][k]
        ELSE a[i][j] - a[i][k] * a[k][j] / a[k][k] END)"""
    moment = ", ".join(f"sum({a} * v)" for a in cols)
    return [
        (f"{name}_gram", f"""SELECT {keys}, count(*) AS n, [{gram}] AS a, [{moment}] AS g
            FROM {source} GROUP BY {keys}"""),
        (f"{name}_steps", f"""SELECT {keys}, n, g, 1 AS k, a FROM {name}_gram UNION ALL
            SELECT {keys}, n, g, k + 1, list_transform(range(1, {p + 1}), lambda i: {rest})
            FROM {name}_steps WHERE k <= {p}"""),
        (f"{name}_beta", f"""SELECT {keys}, n, list_transform(a, lambda x: x[{p + 1}:{2 * p}]) AS inv,
            list_transform(a, lambda x: list_dot_product(x[{p + 1}:{2 * p}], g)) AS beta
            FROM {name}_steps WHERE k = {p + 1}"""),
        (f"{name}_sse", f"""SELECT {keys}, sum((v - ({fitted})) * (v - ({fitted}))) AS sse
            FROM {source} JOIN {name}_beta USING ({keys}) GROUP BY {keys}"""),
    ]


def query(ctes: list[tuple[str, str]], select: str) -> str:
    chain = ",\n".join(f"{n} AS ({q})" for n, q in ctes)
    steps = "RECURSIVE " if any(f"FROM {n} WHERE" in q for n, q in ctes) else ""
    return f"WITH {steps}{chain}\n{select}"


def oracle_sql() -> dict[str, str]:
    seg, cust = panel("segment", STANDARD), panel("customer", STANDARD)
    seg_short, cust_short = panel("segment", SHORT), panel("customer", SHORT)
    mid, late = panel("segment", MIDSTART), panel("segment", LATE)
    dec = decisions()
    sql: dict[str, str] = {}

    sql["site_lookup"] = query(seg, """SELECT b AS id_building_primaire, name,
        station AS weather_station, surface, cast(occupant AS bigint) AS occupant
        FROM fx_building""")
    sql["building_invoices"] = query(seg, f"""SELECT id AS invoice_id, {NAMED},
        unit AS fluid_unit, {day('s', 'start')}, {day('e', '"end"')}, v AS value FROM inv""")
    sql["building_usage"] = query(seg, f"""SELECT u.b AS id_building_primaire,
        {day('day', 'date')}, type, count(*) AS n_rows, {r('sum(value)')} AS total
        FROM fx_usage u JOIN params p ON u.b = p.b
        WHERE u.day BETWEEN start_pred AND end_pred GROUP BY 1, 2, 3""")
    sql["station_degreedays"] = query(mid, f"""SELECT w.station AS station_id,
        ym AS period_month, ind AS indicator, cast(basis AS bigint) AS basis,
        {r('value')} AS value
        FROM fx_degreedays w JOIN fx_building g ON w.station = g.station
        JOIN params p ON p.b = g.b WHERE ym BETWEEN strftime(start_pred, '%Y-%m')
        AND strftime(end_pred, '%Y-%m')""")
    pdl = "d AS deliverypoint_id_primaire, f AS fluid"
    sql["invoice_dedup"] = query(seg, f"""SELECT id AS invoice_id, {pdl}, {day('s', 'start')},
        {day('e', '"end"')}, v AS value, cast(dur AS double) AS invoice_duration FROM dedup""")
    sql["invoice_dedup_removed"] = query(seg, f"""SELECT {pdl},
        cast(count(*) - count(DISTINCT coalesce(s, DATE '0001-01-01')) AS bigint) AS removed_rows
        FROM inv GROUP BY d, f""")
    sql["invoice_prorata"] = query(seg, f"""SELECT id AS invoice_id, {pdl}, {day('s', 'start')},
        {day('e', '"end"')}, {r('v')} AS value, cast(dur AS double) AS invoice_duration,
        pr AS is_prorated FROM pieces""")
    monthly = f"""SELECT {NAMED}, strftime(s, '%Y%m') AS month_year,
        strftime(e, '%Y%m') AS month_year_end_date, {day('s', 'start')}, {day('e', '"end"')},
        {r('v')} AS value, date_diff('day', s, e) + 1 AS invoice_duration,
        first_id AS first_invoice_id FROM monthly"""
    sql["monthly_invoices"] = sql["joined_monthly_invoices"] = query(seg, monthly)
    sql["single_building_run"] = query(
        seg, f"SELECT * FROM ({monthly}) WHERE id_building_primaire = 'B_1'")
    sql["customer_monthly_invoices"] = query(cust, monthly)
    sql["series_pairs"] = query(seg, f"SELECT DISTINCT {NAMED} FROM inv "
                                "WHERE e IS NOT NULL AND (b, d, f) IN (SELECT (b, d, f) FROM monthly)")
    sql["month_spine"] = query(seg, f"SELECT {NAMED}, {month()} FROM spine")
    sql["horizon_cut"] = query(
        seg, f"SELECT * FROM (SELECT {NAMED}, {month()} FROM spine) WHERE month_str <= '2000-11'")
    sql["month_spine_midstart"] = query(mid, f"SELECT {NAMED}, {month()} FROM spine")

    refs = ", ".join(f"{r(c)} AS {c}" for c in REFS)
    first = " ".join(f"WHEN bool_or(has_{c}) OVER w THEN has_{c}" for c in REFS)
    sql["degreedays_pivot"] = query(seg, f"""SELECT station AS station_id, ym AS month_str, {refs}
        FROM (SELECT *, CASE {first} END AS ok FROM weather
            WHERE ym BETWEEN '1996-01' AND '2000-12' WINDOW w AS (PARTITION BY station))
        WHERE ok""")
    sql["degreedays_missing_months"] = query(seg, """SELECT station AS station_id, ref,
        string_agg(ym, ',' ORDER BY ym) AS missing_months FROM (
            SELECT g.station, r.ref, strftime(mm, '%Y-%m') AS ym FROM fx_building g,
            (VALUES ('hdd10'), ('hdd15'), ('hdd18'), ('cdd21'), ('cdd24'), ('cdd26')) r(ref),
            generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) t(mm)
            EXCEPT SELECT station, concat(ind, basis), ym FROM fx_degreedays)
        GROUP BY 1, 2""")
    usage = f"b AS id_building_primaire, {month()}, type, {r('value', 6)} AS value"
    sql["usage_monthly"] = query(seg, f"SELECT {usage} FROM usage_month")
    sql["usage_non_constant"] = query(
        seg, f"SELECT {usage} FROM usage_month SEMI JOIN usage_types USING (b, type)")
    wide = ", ".join(
        f"round(avg(CASE WHEN type = '{t}' THEN value END) + {NUDGE[6]:.10f}, 6) AS {t}"
        for t in ("fi_A", "fi_N", "fi_R"))
    sql["usage_wide"] = query(seg, f"""SELECT b AS id_building_primaire,
        strftime(day, '%Y-%m') AS month_str, {wide} FROM fx_usage WHERE year(day) = 1998
        GROUP BY 1, 2""")
    sql["factor_profile"] = query(seg, """SELECT type AS column_name,
        count(DISTINCT (b, date_trunc('month', day))) AS n_numeric FROM fx_usage GROUP BY 1""")
    sql["usage_interpolated"] = query(
        [*seg, ("all_usage", """SELECT b, type, date_trunc('month', day) AS m, avg(value) AS a
            FROM fx_usage GROUP BY ALL"""),
         ("gappy", """SELECT b, type, m, a AS value, row_number() OVER (PARTITION BY b, type ORDER BY m) AS pos
            FROM (SELECT DISTINCT b, m FROM all_usage) JOIN (SELECT DISTINCT b, type FROM all_usage) USING (b)
            LEFT JOIN all_usage USING (b, type, m)"""),
         *filled("line", "gappy", "b, type", "m", "value")],
        f"""SELECT b AS id_building_primaire, type, {month()}, value IS NULL AS was_unknown, {r('filled', 6)} AS value
        FROM line_filled""")

    factors = ", ".join(f"{r(c, 4)} AS {c}" for c in ("fi_A", "fi_N", "fi_R"))
    table = f"""SELECT p.b AS id_building_primaire, p.d AS deliverypoint_id_primaire,
        p.f AS fluid, {month('p.m')}, {day('s', 'start')}, {day('e', '"end"')}, {r('v')} AS value,
        is_train, is_test, {refs}, {factors}
        FROM panel p LEFT JOIN factors u ON p.b = u.b AND p.d = u.d AND p.f = u.f AND p.m = u.m"""
    sql["model_table"] = query(seg, table)
    sql["customer_model_table"] = query(cust_short, table)
    sql["train_test_flags"] = query(mid, f"""SELECT {NAMED}, count(*) AS n_months,
        count(CASE WHEN is_train THEN 1 END) AS n_train,
        count(CASE WHEN is_test THEN 1 END) AS n_test,
        count(CASE WHEN is_test AND v IS NOT NULL THEN 1 END) AS n_test_invoiced
        FROM panel GROUP BY {K}""")

    decision = f"""SELECT {NAMED}, n_train, n_zero, code AS status_code,
        CASE code WHEN 'note_000' THEN 'TrainStatus.NO_REFERENCE_DATA'
            WHEN 'note_001' THEN 'TrainStatus.TOO_FEW_OBSERVATIONS'
            ELSE 'TrainStatus.OK_ANNUAL_REFERENCE' END AS status FROM decision"""
    sql["train_decision"] = query(seg + dec, decision)
    sql["customer_train_decision"] = query(cust_short + dec, decision)
    sql["mean_model"] = query(seg + dec, f"""SELECT p.b AS id_building_primaire,
        p.d AS deliverypoint_id_primaire, p.f AS fluid, {month('p.m')},
        {r('p.v')} AS real_consumption, {r('mean_v')} AS predictive_consumption,
        {r('mean_v - 1.96 * sd_v')} AS confidence_lower95,
        {r('mean_v + 1.96 * sd_v')} AS confidence_upper95,
        {r('12 * mean_v')} AS annual_consumption_reference
        FROM panel p JOIN counts c ON p.b = c.b AND p.d = c.d AND p.f = c.f
        WHERE p.is_test AND c.n_train > 0""")
    chosen = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    sql["quantile_selection"] = " UNION ALL ".join(
        f"""SELECT {g} AS grp, count(*) AS n, {p}::double AS probability,
            {r(f'quantile_cont(o_totalprice, {p})', 4)} AS quantile
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""" for g in ("'all'", "c_mktsegment")
        for p in chosen)
    factor = "CASE WHEN p.b = 'B_0' THEN 2 ELSE 1 END"
    run_of = "CASE WHEN p.b = 'B_0' THEN 'second' ELSE 'first' END"
    sql["persist_roundtrip"] = query(seg + dec, f"""SELECT p.b AS id_building_primaire,
        p.d AS deliverypoint_id_primaire, p.f AS fluid, {month('p.m')}, {run_of} AS run_id, {run_of} AS model_run,
        {r(f'{factor} * mean_v')} AS predictive, {r('12 * mean_v')} AS annual
        FROM panel p JOIN counts c ON p.b = c.b AND p.d = c.d AND p.f = c.f
        WHERE p.is_test AND c.n_train > 0 AND p.b <> 'B_1'""")
    scores = f"SELECT {NAMED}, ref, {r('adj', 6)} AS adj_r2 FROM scored"
    sql["dju_scores"] = query(seg + dec, scores)
    sql["customer_dju_scores"] = query(cust_short + dec, scores)
    sql["dju_best"] = query(seg + dec, f"SELECT {NAMED}, best_hdd, best_cdd FROM best")

    plain = [*seg, *dec, *fit("plain", "chosen", "v")]
    sql["ols_two_factor"] = query(plain, f"""SELECT {NAMED}, fn AS n, {r('b0', 1)} AS b_coefficient,
        {r('ba')} AS a_hdd, {r('bb')} AS a_cdd,
        {r('sqrt(sse / greatest(fn - 3, 1))', 1)} AS sigma FROM plain_fit""")
    named_x = ("x.b AS id_building_primaire, x.d AS deliverypoint_id_primaire, x.f AS fluid")
    joined = "chosen_all x LEFT JOIN plain_fit w ON x.b = w.b AND x.d = w.d AND x.f = w.f"
    fitted = "b0 + ba * xa + bb * xb"
    sql["fitted_two_factor"] = query(
        plain, f"SELECT {named_x}, {month('x.m')}, {r(fitted, 1)} AS fitted FROM {joined}")
    t_values = ", ".join(f"({k}, {t_975(k)!r})" for k in range(1, 181))
    half = """(t975 * sqrt(greatest(0, sse / greatest(fn - 3, 1) * (1.0 / fn
        + ((xa - ma) * (xa - ma) * sbb - 2 * (xa - ma) * (xb - mb) * sab
            + (xb - mb) * (xb - mb) * saa) / (saa * sbb - sab * sab)))))"""
    lower, upper = r(f"{fitted} - {half}", 1), r(f"{fitted} + {half}", 1)
    sql["ols_confidence"] = query(
        [*plain, ("t_table", f"SELECT * FROM (VALUES {t_values}) t(dof, t975)")],
        f"""SELECT {named_x}, {month('x.m')}, {r(fitted, 1)} AS fit, {lower} AS lower95,
        {upper} AS upper95
        FROM {joined} LEFT JOIN t_table t ON t.dof = greatest(w.fn - 3, 1) WHERE x.is_test""")
    sql["accuracy"] = query(
        [*plain, ("errors", f"""SELECT x.b, x.d, x.f, x.v AS y, {fitted} AS h, fn, sse, syy, adj
            FROM chosen x JOIN plain_fit w ON x.b = w.b AND x.d = w.d AND x.f = w.f
            WHERE x.xa IS NOT NULL AND x.xb IS NOT NULL""")],
        f"""SELECT {NAMED}, count(*) AS n_pairs, {r('avg(h - y)', 1)} AS "ME",
        {r('sqrt(avg((h - y) * (h - y)))', 1)} AS "RMSE", {r('avg(abs(h - y))', 1)} AS "MAE",
        {r('avg((h - y) / nullif(h, 0) * 100)', 1)} AS "MPE",
        {r('avg(abs((h - y) / nullif(h, 0)) * 100)', 1)} AS "MAPE",
        {r('any_value(1 - sse / syy)', 6)} AS "R2", {r('any_value(adj)', 6)} AS "adjR2"
        FROM errors WHERE fn >= 6 GROUP BY {K}""")

    smooth = (f"SELECT {named_x}, {month('x.m')}, {r('t.sm')} AS smooth FROM chosen x "
              "JOIN one_smooth t ON x.b = t.b AND x.d = t.d AND x.f = t.f AND x.i = t.i")
    one = smoother("one", "chosen", "v")
    sql["theil_sen"] = query([*cust_short, *dec, *one], smooth + " WHERE x.n <= 12")
    sql["lowess_equispaced"] = query([*seg, *dec, *one], smooth + " WHERE x.n > 12")
    sql["iqr_fence"] = query(
        [*cust, *dec, ("quartiles", f"""SELECT {K}, quantile_cont(v, 0.25) AS q1,
            quantile_cont(v, 0.75) AS q3 FROM chosen GROUP BY {K}""")],
        f"""SELECT {NAMED}, {r('q1')} AS q1, {r('q3')} AS q3, {r('q1 - 3 * (q3 - q1)')} AS low,
        {r('q3 + 3 * (q3 - q1)')} AS high FROM quartiles WHERE q3 - q1 > 0""")
    found = (f"SELECT {named_x}, {month('x.m')}, g.hit AS is_anomaly FROM chosen x "
             "JOIN flags g ON x.b = g.b AND x.d = g.d AND x.f = g.f AND x.i = g.i")
    sql["anomalies_short"] = query([*seg_short, *dec, *detection("chosen", "v")], found)
    sql["anomalies_long"] = query([*seg, *dec, *detection("chosen", "v", seasonal=True)], found)
    sql["customer_anomalies_short"] = query([*cust_short, *dec, *detection("chosen", "v")], found)

    final = f"""SELECT {NAMED}, {month()}, best_y, drop_zeros, hit AS is_anomaly,
        {r('v', 1)} AS consumption_imputation, {r('cor', 1)} AS consumption_correction,
        {r('y_final', 1)} AS y_final FROM final_rows"""
    seg_target, cust_target = [*seg_short, *dec, *target()], [*cust_short, *dec, *target()]
    sql["y_final"] = query(seg_target, final)
    sql["customer_y_final"] = query(cust_target, final)
    sql["outliers_table"] = query(seg_target, f"""SELECT b AS id_building_primaire,
        d AS invoice_delivery_point, f AS invoice_fluid, {day('s', 'invoice_start_date')},
        {day('e', 'invoice_end_date')}, {r('v')} AS invoice_consumption, false AS is_missing,
        {r('v')} AS invoice_consumption_imputation, hit AS is_anomaly,
        {r('cor', 1)} AS invoice_consumption_correction FROM final_rows WHERE hit""")
    sql["outlier_notes"] = query(seg_target, f"""SELECT DISTINCT b AS id_building_primaire, code, text
        FROM (SELECT b, d, f, 'note_005' AS code,
            concat('anomalous values: ', count(*)) AS text
            FROM corrected WHERE hit GROUP BY {K}
            UNION ALL
            SELECT b, d, f, 'debug_outliers_months',
            concat('[', string_agg(strftime(m, '%Y-%m'), ', ' ORDER BY m), ']')
            FROM corrected WHERE hit GROUP BY {K})""")
    sql["ordered_notes"] = query(
        [*seg_target, ("said", f"""SELECT b, d, f, 0 AS seq, 'note_005' AS code,
            concat('anomalous values: ', count(*)) AS text FROM corrected WHERE hit GROUP BY {K}
            UNION ALL SELECT b, d, f, 1, 'debug_outliers_months',
            concat('[', string_agg(strftime(m, '%Y-%m'), ', ' ORDER BY m), ']') FROM corrected WHERE hit GROUP BY {K}""")],
        """SELECT b AS id_building_primaire, row_number() OVER (PARTITION BY b ORDER BY first) AS ordinal, code, text
        FROM (SELECT b, code, text, min(struct_pack(d := d, f := f, s := seq)) AS first FROM said GROUP BY 1, 2, 3)""")
    seg_models = [*seg_target, *final_models()]
    sql["model_details"] = query(seg_models, f"""SELECT {NAMED}, family AS model_family,
        CASE code WHEN 'note_000' THEN 'TrainStatus.NO_REFERENCE_DATA'
            WHEN 'note_001' THEN 'TrainStatus.TOO_FEW_OBSERVATIONS'
            ELSE 'TrainStatus.OK_ANNUAL_REFERENCE' END AS status,
        best_hdd AS chosen_hdd, best_cdd AS chosen_cdd,
        CASE WHEN family = 'ols_dju_plus_factors' THEN concat_ws(',', best_hdd, best_cdd) END AS x_cols,
        best_y AS y_col, {r('b0', 1)} AS b_coefficient, {r('annual', 1)} AS annual_consumption_reference,
        {r('ba')} AS a_hdd, {r('bb')} AS a_cdd, {r('mean_v')} AS monthly_mean, {r('sd_v')} AS monthly_sd,
        {r('me', 1)} AS "ME", {r('rmse', 1)} AS "RMSE", {r('mae', 1)} AS "MAE", {r('mpe', 1)} AS "MPE",
        {r('mape', 1)} AS "MAPE", {r('r2', 6)} AS "R2", {r('adj', 6)} AS "adjR2",
        coalesce(outliers, '') AS outliers, coalesce(notes, '') AS outlier_notes FROM models""")
    report = "(SELECT sum(annual) FROM models x WHERE x.b = g.b)"
    sql["building_report"] = query(seg_models, f"""SELECT g.b AS id_building_primaire,
        {r('total', 1)} AS total_energy_annual_consumption_reference,
        {r('total / nullif(g.surface, 0)', 1)} AS ratio_kwh_m2,
        {r('total / nullif(g.occupant, 0)', 1)} AS ratio_kwh_occupant
        FROM (SELECT *, {report} AS total FROM fx_building g) g""")
    gaps = [*seg_short, *dec, *with_gaps()]
    sql["ranking_imputation"] = query(gaps, f"""SELECT {NAMED}, {month()}, {r('kept')} AS value,
        {r('filled', 1)} AS filled FROM rank_mean""")
    sql["target_with_missing"] = query(gaps, f"""SELECT {named_x}, {month('x.m')}, {r('kept')} AS value,
        {r('imp', 1)} AS consumption_imputation, n_missing, {r('n_missing / n_rows', 6)} AS gap_ratio, raw_wins
        FROM imputed x JOIN gap_facts y ON x.b = y.b AND x.d = y.d AND x.f = y.f WHERE NOT raw_wins OR NOT hit""")
    long_gaps = [*seg, *dec, *gapped()]
    sql["seasonal_strength"] = query(
        [*long_gaps, *seasonally_filled("line", "rank_filled", "kept"),
         ("given", "SELECT * FROM chosen WHERE n > 24"), *adjusted("flat", "given", "v"),
         ("ratios", f"""SELECT {K}, avg(filled) FILTER (WHERE hit) / avg(kept) AS ratio FROM line_whole GROUP BY {K}""")],
        f"""SELECT {named_x}, len(x.season) AS n_months, {r('x.strength')} AS strength, x.strength >= 0.6 AS is_strong,
        {r('ratio')} AS filled_to_known FROM flat_strength x JOIN ratios y
        ON x.b = y.b AND x.d = y.d AND x.f = y.f""")
    sql["seasonal_imputation"] = query([*long_gaps, *seasonal_arm()], f"""SELECT {NAMED}, {month()}, {r('kept')} AS value,
        {r('filled + coalesce(season, 0)', 1)} AS filled FROM rest_filled""")
    sql["usage_gapfill_long"] = query(
        [("readings", """SELECT o_orderkey, 1 AS k, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos,
            CASE WHEN (o_orderkey // 30) % 3 = 1 OR o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS value
            FROM orders"""), *filled("long", "readings", "k", "pos", "value")],
        f"SELECT o_orderkey AS reading, {r('value')} AS value, {r('filled')} AS filled FROM long_filled")
    flagged = [("start", "bad_value", "o_orderkey % 23 = 0"), ("end", "out_of_calendar", "o_orderkey % 31 = 0 OR o_orderkey % 37 = 0"),
               ("end", "bad_value", "o_orderkey % 41 = 0 AND o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0"),
               ("value", "bad_value", "o_orderkey % 13 = 0"), ("value", "nan", "o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0"),
               ("value", "infinity", "o_orderkey % 19 = 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0")]
    sql["input_problems"] = "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT 'invoice' AS "table", '{c}' AS "column", '{problem}' AS problem,
            count(*) FILTER (WHERE {where}) AS n_rows FROM orders""" for c, problem, where in flagged) + ") WHERE n_rows > 0"
    sql["missing_prediction_months"] = query(
        [*late, *dec], f"""SELECT {NAMED}, string_agg(strftime(m, '%Y-%m'), ',' ORDER BY m)
            AS missing_months FROM chosen_all WHERE is_test AND (xa IS NULL OR xb IS NULL)
            GROUP BY {K}""")
    total = "sum(12 * c.mean_v)"
    sql["building_metrics"] = query([*seg, *dec], f"""SELECT g.b AS id_building_primaire,
        {r(total)} AS total_energy_annual_consumption_reference,
        {r(f'{total} / nullif(g.surface, 0)')} AS ratio_kwh_m2,
        {r(f'{total} / nullif(g.occupant, 0)')} AS ratio_kwh_occupant
        FROM fx_building g LEFT JOIN counts c ON c.b = g.b
        GROUP BY g.b, g.surface, g.occupant""")
    many = [
        *seg,
        ("many", """SELECT b, f, v, dur AS days, dayofyear(s) AS day_of_year,
            12 * (year(s) - 1992) + month(s) AS month_number, dayofweek(s) + 1 AS weekday, id % 11 AS remainder
            FROM inv WHERE v IS NOT NULL AND dur IS NOT NULL"""),
        *gauss_jordan("full5", "many", "b, f", ["days", "day_of_year", "month_number", "weekday", "remainder"]),
        *gauss_jordan("three", "many", "b, f", ["days", "month_number", "weekday"]),
    ]
    full = ["intercept", "days", "day_of_year", "month_number", "weekday", "remainder"]
    # x and 2x share a slope in the ratio 1 : 2, an intercept and a constant of 12 in the ratio 1 : 12.
    shared = [("intercept", 1, 1 / 145), ("days", 2, 1 / 5), ("twice_days", 2, 2 / 5), ("month_number", 3, 1),
              ("weekday", 4, 1), ("twelve", 1, 12 / 145)]
    sides = [(name, "full", "full5", k + 1, 1, 6) for k, name in enumerate(full)]
    sides += [(name, "dependent", "three", at, share, 4) for name, at, share in shared]
    sql["ols_many_factors"] = query(many, " UNION ALL ".join(
        f"""SELECT b AS id_building_primaire, f AS fluid, '{design}' AS design, '{name}' AS term, n, {rank}::bigint AS rank,
            {r(f'beta[{at}] * {share!r}')} AS beta,
            {r(f'sqrt(inv[{at}][{at}] * sse / greatest(n - 6, 1)) * {share!r}')} AS std_error,
            {r('sqrt(sse / greatest(n - 6, 1))', 1)} AS sigma
            FROM {fit}_beta JOIN {fit}_sse USING (b, f)""" for name, design, fit, at, share, rank in sides))
    text = """CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m')
        WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
        ELSE strftime(o_orderdate, '%m/%Y') END"""
    sql["month_validation"] = f"""WITH t AS (SELECT {text} AS month_str,
            CASE o_orderkey % 4 WHEN 3 THEN strftime(o_orderdate, '%m/%Y')
            ELSE strftime(o_orderdate, '%Y-%m') END AS normalised FROM orders)
        SELECT month_str, normalised, regexp_matches(normalised, '^\\d{{4}}-\\d{{2}}$') AS repaired,
        count(*) AS n_rows FROM t WHERE NOT regexp_matches(month_str, '^\\d{{4}}-\\d{{2}}$')
        GROUP BY 1, 2, 3"""
    return sql
