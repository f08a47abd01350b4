"""Shared pieces of the oracle statements: the networks, start values and expected weights in plain SQL."""

from __future__ import annotations

K = 2


def r(expression: str, digits: int = 6) -> str:
    """Rounded, and never a negative zero."""
    return f"round({expression}, {digits}) + 0.0"


HO = """ho AS (SELECT i, j, ts FROM (SELECT user_id AS i, lead(user_id) OVER (ORDER BY ts, event_id) AS j, ts
  FROM events) WHERE j IS NOT NULL AND i <> j)"""
HANDOFF = HO + ",\ne AS (SELECT 0 AS a, i, j, count(*)::DOUBLE AS w FROM ho GROUP BY i, j)"
BINARY = HO + ",\ne AS (SELECT 0 AS a, i, j, 1.0::DOUBLE AS w FROM ho GROUP BY i, j)"
SNAPSHOTS = HO + ",\ne AS (SELECT DISTINCT ((day(ts) - 1) // 6)::INT AS a, i, j, 1.0::DOUBLE AS w FROM ho)"
TRADE = """e AS (SELECT (year(o_orderdate) - 1995)::INT AS a, c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j,
  count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""
REVERSE = """r AS (SELECT e.*, coalesce(b.w, 0.0) AS w_rev
  FROM e LEFT JOIN e b ON b.a = e.a AND b.i = e.j AND b.j = e.i)"""
MODES = """m AS (SELECT user_id AS i, event_type AS z, count(*) AS n FROM events GROUP BY ALL),
kinds AS (SELECT z, (row_number() OVER (ORDER BY z) - 1)::INT AS z_idx FROM (SELECT DISTINCT z FROM m)),
x AS (SELECT i, z, z_idx FROM (SELECT i, z, row_number() OVER (PARTITION BY i ORDER BY n DESC, z) AS k FROM m)
  JOIN kinds USING (z) WHERE k = 1)"""
NODES = "n AS (SELECT i FROM e UNION SELECT j FROM e)"


def params(normalise: bool = True) -> str:
    u = [f"((i * 7919 + {k * 104729 + 13}) % 1000 + 1) / 1001.0::DOUBLE AS u{k}" for k in range(K)]
    v = [f"((i * 6007 + {k * 92821 + 29}) % 1000 + 1) / 1001.0::DOUBLE AS v{k}" for k in range(K)]
    raw = f"SELECT i, {', '.join(u + v)} FROM n"
    if not normalise:
        return f"{NODES},\np AS ({raw})"
    return (
        f"{NODES},\np AS (SELECT i, u0 / (u0 + u1) AS u0, u1 / (u0 + u1) AS u1, "
        f"v0 / (v0 + v1) AS v0, v1 / (v0 + v1) AS v1 FROM ({raw}))"
    )


def affinity(layers: int, assortative: bool = False) -> str:
    pairs = [(k, k) for k in range(K)] if assortative else [(k, q) for k in range(K) for q in range(K)]
    cols = [
        f"((a * 31 + {k * 17 + q * 7}) % 10 + 1) / 10.0::DOUBLE AS " + (f"w{k}" if assortative else f"w{k}_{q}")
        for k, q in pairs
    ]
    return f"w AS (SELECT a::INT AS a, {', '.join(cols)} FROM range({layers}) t(a))"


def gathered(source: str = "r", name: str = "g") -> str:
    return f"""{name} AS (SELECT {source}.*, y.u0, y.u1, z.v0, z.v1, w.* EXCLUDE (a)
  FROM {source} JOIN p y ON y.i = {source}.i JOIN p z ON z.i = {source}.j JOIN w ON w.a = {source}.a)"""


def to(k: int, assortative: bool = False, v: str = "v", t: bool = False) -> str:
    """sum over q of w[k, q] v[q]."""
    if assortative:
        return f"(w{k} * {v}{k})"
    return f"(w{'0_' + str(k) if t else str(k) + '_0'} * {v}0 + w{'1_' + str(k) if t else str(k) + '_1'} * {v}1)"


def lam(assortative: bool = False, u: str = "u", v: str = "v") -> str:
    return f"({u}0 * {to(0, assortative, v)} + {u}1 * {to(1, assortative, v)})"


CELLS = f"""c AS (SELECT w.a, s.i, t.i AS j, s.u0, s.u1, t.v0, t.v1, s.v0 AS y0, s.v1 AS y1, t.u0 AS x0, t.u1 AS x1,
  w.* EXCLUDE (a) FROM p s, p t, w),
cells AS (SELECT *, {lam()} AS lam, {lam(u='x', v='y')} AS lam_t FROM c)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
