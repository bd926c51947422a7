"""SQL of the queries over all line items as one long track: recursions walk the samples one by one."""

from __future__ import annotations

import re

import numpy as np

from ..operators import kernels as k
from . import oracles as o
from . import signal_sql


def number(v: float) -> str:
    return signal_sql.number(float(v))


#: Samples of one segment of a report.
SEGMENT = 1_000
SR = 8_000.0

SERIES = """s AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS n,
           l_extendedprice / 100000.0::DOUBLE - 0.5 AS x, l_quantity / 50.0::DOUBLE - 0.5 AS y FROM lineitem
), z AS MATERIALIZED (SELECT count(*) AS n FROM s)"""


def walked(name: str, source: str, coefficients: tuple[np.ndarray, np.ndarray]) -> str:
    """(n, x): ``source`` (n, x), whose places start at 0, after a filter that starts from silence."""
    b, a = coefficients
    m = len(b) - 1
    y = f"({number(b[0])} * e.x + r.s1)"
    then = lambda i: f"r.s{i + 1}" if i < m else "0.0::DOUBLE"
    states = ", ".join(f"{then(i)} + {number(b[i])} * e.x - {number(a[i])} * {y}" for i in range(1, m + 1))
    names = ", ".join(f"s{i}" for i in range(1, m + 1))
    return f"""{name}_w(n, x, {names}) AS (
        SELECT -1::BIGINT, 0.0::DOUBLE, {', '.join(['0.0::DOUBLE'] * m)}
        UNION ALL SELECT e.n, {y}, {states} FROM {name}_w r JOIN {source} e ON e.n = r.n + 1
    ), {name} AS MATERIALIZED (SELECT n, x FROM {name}_w WHERE n >= 0)"""


def zero_phase(name: str, source: str, coefficients: tuple[np.ndarray, np.ndarray]) -> str:
    pad = 6 * len(coefficients[0])
    return f"""{name}_p AS MATERIALIZED (
        SELECT n + {pad} AS n, x FROM {source}
        UNION ALL SELECT {pad} - k, 2 * (SELECT x FROM {source} WHERE n = 0) - x FROM {source} JOIN (SELECT unnest(range(1, {pad + 1})) AS k) ON n = k
        UNION ALL SELECT z.n + {pad} - 1 + k, 2 * (SELECT x FROM {source}, z WHERE {source}.n = z.n - 1) - x FROM {source}, z JOIN (SELECT unnest(range(1, {pad + 1})) AS k) ON {source}.n = z.n - 1 - k
    ), {walked(name + '_f', name + '_p', coefficients)},
    {name}_r AS MATERIALIZED (SELECT z.n + {2 * pad} - 1 - f.n AS n, x FROM {name}_f f, z), {walked(name + '_b', name + '_r', coefficients)},
    {name} AS MATERIALIZED (SELECT z.n + {pad} - 1 - b.n AS n, x FROM {name}_b b, z WHERE z.n + {pad} - 1 - b.n BETWEEN 0 AND z.n - 1)"""


def smoothed(name: str, source: str, first: float, fall: float, rise: float) -> str:
    return f"""{name}_w(n, x) AS (
        SELECT -1::BIGINT, {number(first)} UNION ALL
        SELECT e.n, e.x + (r.x - e.x) * CASE WHEN e.x < r.x THEN {number(fall)} ELSE {number(rise)} END FROM {name}_w r JOIN {source} e ON e.n = r.n + 1
    ), {name} AS MATERIALIZED (SELECT n, x FROM {name}_w WHERE n >= 0)"""


def segments(source: str, columns: tuple[str, ...] = ("x",)) -> str:
    parts = ", ".join(f"round(sqrt(avg({c} * {c})), 6) + 0.0 AS {c}_rms, round(min({c}), 6) + 0.0 AS {c}_low, round(max({c}), 6) + 0.0 AS {c}_high" for c in columns)
    return f"SELECT n // {SEGMENT} AS segment, count(*) AS cnt, {parts} FROM {source} GROUP BY n // {SEGMENT}"


def long_filters() -> str:
    low, band = k.butterworth(SR, None, 300.0), k.butterworth(SR, 200.0, 900.0)
    return f"WITH RECURSIVE {SERIES}, {zero_phase('lo', 's', low)}, {zero_phase('mid', 's', band)}, b AS (SELECT n, lo.x AS low, mid.x AS mid FROM lo JOIN mid USING (n)) {segments('b', ('low', 'mid'))}"


def long_loudness() -> str:
    shelf, high = k.shelf(SR), k.butterworth(SR, 38.0, None)
    block, hop = int(SR * 0.4), int(SR * 0.1)
    return f"""WITH RECURSIVE {SERIES}, {walked('a', 's', shelf)}, {walked('w', 'a', high)},
        b AS (SELECT k, avg(x * x) AS e FROM w, unnest(range(greatest(CAST(ceil((n - {block - 1}) / {hop}.0) AS BIGINT), 0), n // {hop} + 1)) t(k) GROUP BY k HAVING count(*) = {block}),
        g AS (SELECT *, {o.lu('avg(e) OVER ()')} - 10 AS gate FROM b WHERE {o.lu('e')} > -70)
        SELECT 0::BIGINT AS track, count(*) AS blocks, round({o.lu(f"coalesce(avg(e) FILTER (WHERE {o.lu('e')} > gate), avg(e))")}, 6) + 0.0 AS lufs FROM g"""


def long_compressor(ratio: float) -> str:
    size = max(32, int(SR * 0.004))
    slope = f"(1 - 1 / {number(ratio)})"
    level = "20 * log10(greatest(sqrt(avg(x * x)), max(abs(x)) * 0.55, 1e-9))"
    return f"""WITH RECURSIVE {SERIES}, v AS (SELECT n // {size} AS n, {level} + 15 AS over FROM s GROUP BY n // {size}),
        t AS MATERIALIZED (SELECT n, -least(CASE WHEN over >= 3.5 THEN over * {slope} ELSE {slope} * greatest(least(over + 3.5, 7), 0) ** 2 / 14 END, 7) AS x FROM v),
        {smoothed('g', 't', 0.0, k.decay(size, SR, 0.018), k.decay(size, SR, 0.16))},
        y AS (SELECT s.n, s.x * 10 ** ((g.x + (coalesce(h.x, g.x) - g.x) * (s.n % {size}) / {size}.0) / 20) AS x FROM s JOIN g ON g.n = s.n // {size} LEFT JOIN g h ON h.n = g.n + 1)
        {segments('y')}"""


def long_limiter(ceiling_db: float) -> str:
    ceiling, ahead = number(10 ** (ceiling_db / 20)), 2 * max(1, round(SR * 0.004))
    return f"""WITH RECURSIVE {SERIES}, t AS MATERIALIZED (
            SELECT n, min(least(1.0::DOUBLE, {ceiling} / (greatest(abs(x), abs(y)) + 1e-12))) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND {ahead} FOLLOWING) AS x FROM s
        ), {smoothed('g', 't', 1.0, k.decay(1, SR, 0.0015), k.decay(1, SR, 0.090))},
        c AS (SELECT n, greatest(least(s.x * g.x, {ceiling}), -{ceiling}) AS l, greatest(least(s.y * g.x, {ceiling}), -{ceiling}) AS r FROM s JOIN g USING (n)) {segments('c', ('l', 'r'))}"""


LONG_PERCENTILES = f"""WITH {SERIES} SELECT 0::BIGINT AS track, count(*) AS cnt, {', '.join(f'round(quantile_cont(x, {q}), 6) + 0.0 AS p{int(q * 100)}' for q in (0.0, 0.1, 0.5, 0.95, 1.0))} FROM s"""

_FRAMES = "f AS (SELECT k AS f, sqrt(avg(x * x)) AS rms FROM s, unnest(range(greatest(CAST(ceil((n - 15) / 4.0) AS BIGINT), 0), n // 4 + 1)) t(k) GROUP BY k HAVING count(*) = 16)"
LONG_ACTIVITY = f"""WITH {SERIES}, {_FRAMES}, b AS (SELECT quantile_cont(rms, 0.1) AS quiet, quantile_cont(rms, 0.65) AS least, count(*) AS frames FROM f),
    a AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS pos, count(*) OVER () AS cnt FROM f, b WHERE rms >= least),
    m AS (SELECT f * 4 AS centre FROM a WHERE pos = cnt // 2)
    SELECT 0::BIGINT AS track, frames, round({o.db('quiet')}, 6) + 0.0 AS noise_floor_db, greatest(least(centre - 10000, z.n - 20000), 0) AS start,
           least(greatest(least(centre - 10000, z.n - 20000), 0) + 20000, z.n) AS stop FROM b, m, z"""

LONG_CLICKS = f"""WITH {SERIES}, m AS (
        SELECT *, abs(x - list_sort([coalesce(lag(x, 2) OVER w, 0), coalesce(lag(x) OVER w, 0), x, coalesce(lead(x) OVER w, 0), coalesce(lead(x, 2) OVER w, 0)])[3]) AS residual,
               coalesce(abs(x - lag(x) OVER w), 0) AS slope, lag(x) OVER w AS before, lead(x) OVER w AS after, lead(x, 2) OVER w AS edge FROM s WINDOW w AS (ORDER BY n)
    ), t AS (SELECT greatest((quantile_cont(residual, 0.5) + 1e-9) * 2, 0.055) AS threshold, (quantile_cont(slope, 0.95) + 1e-9) * 1.15 AS steep FROM m)
    SELECT 0::BIGINT AS track, n, round(x, 6) + 0.0 AS x, round((before + after) / 2, 6) + 0.0 AS repaired FROM m, t WHERE residual > threshold AND slope >= steep AND n > 1 AND edge IS NOT NULL"""


def _bank(bank: np.ndarray) -> str:
    """(p, i, w): a filter bank's phases, taps and weights."""
    cells = ", ".join(f"({p}, {i}, {number(w)})" for p, row in enumerate(bank) for i, w in enumerate(row))
    return f"b(p, i, w) AS (VALUES {cells})"


def long_resampled(to: float) -> str:
    up, down = k.rational(SR, to)
    bank = k.polyphase_bank(up, down)
    taps = bank.shape[1]
    return f"""WITH {SERIES}, {_bank(bank)},
        m AS (SELECT unnest(range(0, CAST(ceil(n * {up} / {down}.0) AS BIGINT))) AS m FROM z),
        y AS (SELECT m AS n, sum(w * x) AS x FROM m JOIN b ON p = m * {down} % {up} JOIN s ON s.n = m * {down} // {up} + {taps // 2} - i GROUP BY m)
        {segments('y')}"""


def long_true_peak(factor: int = 4) -> str:
    bank = k.polyphase_bank(factor, 1, cut=1.0)
    taps = bank.shape[1]
    return f"""WITH {SERIES}, {_bank(bank)},
        m AS MATERIALIZED (SELECT n, i, n + {taps // 2} - i AS near FROM s, (SELECT unnest(range(0, {taps})) AS i)),
        t AS MATERIALIZED (SELECT m.n, i, s.x FROM m JOIN s ON s.n = near),
        y AS (SELECT t.n, p, sum(w * x) AS x FROM t JOIN b USING (i) GROUP BY t.n, p)
        SELECT 0::BIGINT AS track, round({o.db('max(abs(x))')}, 6) + 0.0 AS true_peak_db FROM y"""


def long_gate(intensity: float, size: int, hop: int) -> str:
    turn, w = f"2 * pi() * k * j / {size}", f"(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {size}))"
    bins = f"(SELECT unnest(range(0, {size // 2 + 1})) AS k)"
    return f"""WITH {SERIES}, f AS (SELECT f, j, coalesce(x, 0) * {w} AS v FROM (SELECT unnest(range(0, CAST(ceil(n / {hop}.0) AS BIGINT) + 1)) AS f FROM z), (SELECT unnest(range(0, {size})) AS j) LEFT JOIN s ON s.n = f * {hop} - {size // 2} + j),
        p AS (SELECT f, k, sum(v * cos({turn})) AS re, -sum(v * sin({turn})) AS im FROM f, {bins} GROUP BY f, k),
        q AS (SELECT k, quantile_cont(sqrt(re * re + im * im), 0.2) AS quiet FROM p GROUP BY k),
        g AS (SELECT f, k, re, im, CASE WHEN k IN (0, {size // 2}) THEN 1 ELSE 2 END * CASE WHEN sqrt(re * re + im * im) >= quiet * {number(1 + 2.5 * intensity)} THEN 1.0::DOUBLE ELSE {number(1 - 0.75 * intensity)} END AS c FROM p JOIN q USING (k)),
        t AS (SELECT f, j, sum(c * (re * cos({turn}) - im * sin({turn}))) / {size} * {w} AS v FROM g, (SELECT unnest(range(0, {size})) AS j) GROUP BY f, j),
        y AS (SELECT f * {hop} - {size // 2} + j AS n, sum(v) / greatest(sum({w} ** 2), 1e-8) AS x FROM t GROUP BY ALL)
        SELECT * FROM ({segments('y, z WHERE y.n BETWEEN 0 AND z.n - 1').replace('n //', 'y.n //')})"""


#: Columns of the line items as stems of three songs, and a source that is nearly their sum.
STEMS = {"vocals": "l_extendedprice / 100000.0D - 0.5D", "drums": "l_quantity / 50.0D - 0.5D", "bass": "l_discount * 10.0D - 0.5D", "other": "l_tax * 10.0D - 0.4D", "instrumental": "(l_linenumber - 4) / 4.0D"}
GOAL = "0.93D * vocals + 0.99D * drums + 0.5D * bass + 1.0D * other + 0.95D * instrumental + 0.05D * vocals * drums"


def song_gains(gains: dict[str, tuple[float, float, float]]) -> str:
    """Gauss-Jordan elimination of each song's five normal equations, a step at a time."""
    names, plain = list(STEMS), lambda e: re.sub(r"([0-9.]+)D", r"\1::DOUBLE", e)
    n = len(names)
    sums = ", ".join(f"sum({a} * {b}) AS a{i}_{j}" for i, a in enumerate(names) for j, b in enumerate([*names, "y"]))
    steps = ["g"]
    for p in range(n):
        cells = ", ".join(f"a{i}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" for i in range(n) for j in range(n + 1))
        steps.append(f"(SELECT song, {cells} FROM {steps[-1]})")
    limits = {m: (gains[m][0], gains[m][0] * 10 ** (-gains[m][1] / 20), gains[m][0] * 10 ** (gains[m][1] / 20)) for m in names}
    held = ", ".join(f"{o.clip(f'a{i}_{n} / a{i}_{i}', limits[m][1], limits[m][2])} AS g_{m}" for i, m in enumerate(names))
    error = lambda g: f"sqrt(avg(({' + '.join(f'{g(m)} * {m}' for m in names)} - y) ** 2))"
    return f"""WITH r AS (SELECT l_returnflag AS song, {', '.join(f'{plain(e)} AS {m}' for m, e in STEMS.items())} FROM lineitem), w AS (SELECT *, {plain(GOAL)} AS y FROM r),
        g AS (SELECT song, {sums} FROM w GROUP BY song), h AS (SELECT song, {held} FROM {steps[-1]}),
        e AS (SELECT song, {error(lambda m: number(limits[m][0]))} AS base, {error(lambda m: f'g_{m}')} AS now FROM w JOIN h USING (song) GROUP BY song)
        SELECT song, true AS applied, {', '.join(f'round(g_{m}, 6) + 0.0 AS {m}' for m in names)}, round(greatest(least((base - now) / base, 1), -1), 6) + 0.0 AS error_reduction FROM h JOIN e USING (song)"""
