"""Least squares of y on at most two factors, as SQL expressions on an array of rows.

Rows are STRUCT(y, a, b). An absent factor is passed as a zero column: the minimum-norm solution
gives it a zero coefficient. Sums are centred before squaring.
"""

from panelcast.functions.series import let

_CONSTANT = "1e-20D"  # centred over raw sum of squares below which a column counts as constant
_COLLINEAR = "1e-13D"  # 1 - r^2 below which two columns count as collinear


def moments(rows: str) -> str:
    """STRUCT(n, my, ma, mb, saa, sbb, sab, say, sby, syy), NULL without rows."""
    totals = """aggregate(pts, struct(0D AS y, 0D AS a, 0D AS b),
        (s, r) -> struct(s.y + r.y AS y, s.a + r.a AS a, s.b + r.b AS b))"""
    means = "struct(tt.y / size(pts) AS y, tt.a / size(pts) AS a, tt.b / size(pts) AS b)"
    centred = """aggregate(
        transform(pts, r -> struct(r.y - c.y AS y, r.a - c.a AS a, r.b - c.b AS b)),
        struct(0D AS aa, 0D AS bb, 0D AS ab, 0D AS ay, 0D AS by, 0D AS yy),
        (s, r) -> struct(s.aa + r.a * r.a AS aa, s.bb + r.b * r.b AS bb, s.ab + r.a * r.b AS ab,
            s.ay + r.a * r.y AS ay, s.by + r.b * r.y AS by, s.yy + r.y * r.y AS yy))"""
    out = """struct(size(pts) AS n, c.y AS my, c.a AS ma, c.b AS mb, z.aa AS saa, z.bb AS sbb,
        z.ab AS sab, z.ay AS say, z.by AS sby, z.yy AS syy)"""
    body = let(totals, "tt", let(means, "c", let(centred, "z", out)))
    return let(rows, "pts", f"CASE WHEN size(pts) > 0 THEN {body} END")


def one_factor_moments(rows: str) -> str:
    """STRUCT(n, saa, say, syy) of rows STRUCT(y, a), equal to those of ``moments``; NULL without rows."""
    totals = """aggregate(pts, struct(0D AS y, 0D AS a),
        (s, r) -> struct(s.y + r.y AS y, s.a + r.a AS a))"""
    means = "struct(tt.y / size(pts) AS y, tt.a / size(pts) AS a)"
    centred = """aggregate(pts, struct(0D AS aa, 0D AS ay, 0D AS yy), (s, r) -> struct(
        s.aa + (r.a - c.a) * (r.a - c.a) AS aa, s.ay + (r.a - c.a) * (r.y - c.y) AS ay,
        s.yy + (r.y - c.y) * (r.y - c.y) AS yy))"""
    out = "struct(size(pts) AS n, z.aa AS saa, z.ay AS say, z.yy AS syy)"
    body = let(totals, "tt", let(means, "c", let(centred, "z", out)))
    return let(rows, "pts", f"CASE WHEN size(pts) > 0 THEN {body} END")


def two_factor_fit(m: str) -> str:
    """Minimum-norm STRUCT(b0, ba, bb, sse) from moments ``m`` (a plain name).

    Each degenerate case has a null vector z of the raw design; removing its part from any
    particular solution p leaves the shortest one.
    """
    flat_a = f"{m}.saa <= {_CONSTANT} * ({m}.saa + {m}.n * {m}.ma * {m}.ma)"
    flat_b = f"{m}.sbb <= {_CONSTANT} * ({m}.sbb + {m}.n * {m}.mb * {m}.mb)"
    det = f"({m}.saa * {m}.sbb - {m}.sab * {m}.sab)"

    def coef(b0: str, ba: str, bb: str) -> str:
        return f"struct({b0} AS b0, {ba} AS ba, {bb} AS bb)"

    def remove(p: str, z: str) -> str:
        share = """(p.b0 * z.b0 + p.ba * z.ba + p.bb * z.bb)
            / (z.b0 * z.b0 + z.ba * z.ba + z.bb * z.bb)"""
        shortest = coef("p.b0 - t * z.b0", "p.ba - t * z.ba", "p.bb - t * z.bb")
        return let(p, "p", let(z, "z", let(share, "t", shortest)))

    on_a = coef(f"{m}.my - {m}.say / {m}.saa * {m}.ma", f"{m}.say / {m}.saa", "0D")
    on_b = coef(f"{m}.my - {m}.sby / {m}.sbb * {m}.mb", "0D", f"{m}.sby / {m}.sbb")
    norm = f"(1 + {m}.ma * {m}.ma + {m}.mb * {m}.mb)"
    slopes = f"""struct(({m}.sbb * {m}.say - {m}.sab * {m}.sby) / {det} AS a,
        ({m}.saa * {m}.sby - {m}.sab * {m}.say) / {det} AS b)"""
    full = let(slopes, "g", coef(f"{m}.my - g.a * {m}.ma - g.b * {m}.mb", "g.a", "g.b"))
    both_flat = coef(f"{m}.my / {norm}", f"{m}.my * {m}.ma / {norm}", f"{m}.my * {m}.mb / {norm}")
    ratio = f"{m}.sab / {m}.sbb"
    beta = f"""CASE
        WHEN {flat_a} AND {flat_b} THEN {both_flat}
        WHEN {flat_a} THEN {remove(on_b, coef(f"{m}.ma", "-1D", "0D"))}
        WHEN {flat_b} THEN {remove(on_a, coef(f"{m}.mb", "0D", "-1D"))}
        WHEN {det} <= {_COLLINEAR} * {m}.saa * {m}.sbb
            THEN {remove(on_a, coef(f"{m}.ma - {ratio} * {m}.mb", "-1D", ratio))}
        ELSE {full} END"""
    sse = f"greatest(0D, {m}.syy - h.ba * {m}.say - h.bb * {m}.sby)"
    return let(beta, "h", f"struct(h.b0 AS b0, h.ba AS ba, h.bb AS bb, {sse} AS sse)")


def r2(n: str, sse: str, syy: str) -> str:
    """R2; NULL below 3 points or for a flat target."""
    return f"CASE WHEN {n} >= 3 AND {syy} > 1e-12D THEN 1 - {sse} / {syy} END"


def adj_r2(n: str, sse: str, syy: str, p: str) -> str:
    """Adjusted R2; NULL where R2 is, or without spare degrees of freedom."""
    return f"""CASE WHEN {n} >= 3 AND {syy} > 1e-12D AND {n} - {p} - 1 > 0
        THEN 1 - ({sse} / {syy}) * ({n} - 1) / ({n} - {p} - 1) END"""


def fit_if_enough(m: str, p: str) -> str:
    """The two-factor fit when there are at least p + 2 rows and one factor, else NULL."""
    return f"CASE WHEN {p} > 0 AND {m}.n >= {p} + 2 THEN {two_factor_fit(m)} END"


def adj_r2_score(rows: str, p: str) -> str:
    """Adjusted R2 of the two-factor fit; NULL stands for "cannot be scored"."""
    score = adj_r2("m.n", "w.sse", "m.syy", p)
    return let(moments(rows), "m", let(fit_if_enough("m", p), "w", score))


def fitted_values(rows: str, a: str, b: str, p: str) -> str:
    """Fit on ``rows``, evaluate at every position of the factor arrays (NULL in, NULL out)."""
    values = f"zip_with({a}, {b}, (fx, fz) -> w.b0 + w.ba * fx + w.bb * fz)"
    return let(moments(rows), "m", let(fit_if_enough("m", p), "w", values))
