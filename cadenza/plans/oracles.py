"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from cadenza.operators import bands, power

GROUP = "CAST(floor(user_id / 10) AS BIGINT)"
KEYS = {
    "rides": f"'r' || {GROUP}",
    "days": f"'r' || {GROUP} || '-' || strftime(ts, '%Y-%m-%d')",
    "weeks": f"'r' || {GROUP} || '-w' || ((CAST(ts AS DATE) - DATE '1970-01-01') // 7)",
}


def samples(view: str, watts: str = "value") -> str:
    return f"""
ev AS (SELECT {KEYS[view]} AS activity_id, {GROUP} AS g, ts, event_id, value, CAST(props->>'k' AS INTEGER) AS k FROM events),
nm AS (
  SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY ts, event_id) - 1 AS n,
         CASE WHEN event_id % 701 = 0 THEN 6 ELSE 1 + k % 3 END AS step
  FROM ev),
smp AS (
  SELECT activity_id, g, ts, n AS sample_idx, CAST(sum(step) OVER w AS BIGINT) AS t,
         CASE WHEN g % 7 <> 6 THEN {watts} END AS watts,
         CASE WHEN g % 5 <> 4 AND k % 10 <> 0 THEN least(178.0::DOUBLE, floor(95 + 0.19::DOUBLE * value + 0.5::DOUBLE)) END AS heartrate,
         CAST(k AS DOUBLE) AS cadence,
         CASE WHEN g % 11 <> 10 THEN CAST(10000 + sum(CASE WHEN (n // 40) % 2 = 0 THEN step * (50 + k % 10) ELSE -step * (40 + k % 10) END) OVER w AS DOUBLE) / 100.0::DOUBLE END AS altitude,
         CAST(sum(step * (70 + k % 20)) OVER w AS DOUBLE) / 10.0::DOUBLE AS distance,
         k % 17 <> 0 AS moving
  FROM nm WINDOW w AS (PARTITION BY activity_id ORDER BY ts, event_id)),
cl AS (
  SELECT *, min(t) OVER (PARTITION BY activity_id) AS first, max(t) OVER (PARTITION BY activity_id) AS last,
         lead(t) OVER (PARTITION BY activity_id ORDER BY t) AS next
  FROM smp)"""


def activities(view: str) -> str:
    return """
act AS (
  SELECT activity_id, min(g) AS athlete_id, CAST(min(ts) AS DATE) AS day,
         CASE WHEN min(g) % 4 = 1 THEN false WHEN min(g) % 4 <> 3 THEN true END AS device_watts
  FROM smp GROUP BY 1)"""


SIGNALS = ("watts", "heartrate", "cadence", "altitude", "distance")


def aligned(view: str, watts: str = "value") -> str:
    found = ", ".join(
        f"last_value(CASE WHEN {s} IS NOT NULL THEN t END IGNORE NULLS) OVER up AS pt_{s}, last_value({s} IGNORE NULLS) OVER up AS pv_{s}, "
        f"first_value(CASE WHEN {s} IS NOT NULL THEN t END IGNORE NULLS) OVER rest AS qt_{s}, first_value({s} IGNORE NULLS) OVER rest AS qv_{s}"
        for s in SIGNALS
    )
    values = ", ".join(
        f"coalesce(CASE WHEN pt_{s} IS NULL THEN qv_{s} WHEN qt_{s} IS NULL OR c = pt_{s} OR qt_{s} - pt_{s} - 1 > 3 THEN pv_{s} "
        f"ELSE pv_{s} + (qv_{s} - pv_{s}) * (c - pt_{s}) / (qt_{s} - pt_{s}) END, 0) AS {s}, coalesce(c = pt_{s}, false) AS known_{s}, bool_or({s} IS NOT NULL) OVER (PARTITION BY activity_id) AS has_{s}"
        for s in SIGNALS
    )
    return f"""{samples(view, watts)},
nb AS (
  SELECT *, {found}
  FROM cl WINDOW up AS (PARTITION BY activity_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    rest AS (PARTITION BY activity_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
cell AS (SELECT *, unnest(generate_series(t, coalesce(next - 1, t))) AS c FROM nb),
al AS (
  SELECT activity_id, c - first AS i, first AS "offset", c = t OR next - t - 1 <= 3 AS valid, CASE WHEN c = t THEN next - t - 1 END AS gap,
         last_value(moving) OVER (PARTITION BY activity_id ORDER BY c ROWS UNBOUNDED PRECEDING) AS moving, {values}
  FROM cell)"""


def rnd(x: str, d: int) -> str:
    return f"(floor(({x}) * 1e{d} + 0.5::DOUBLE) / 1e{d})"


def micro(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5::DOUBLE) AS BIGINT)"


def prefix(signal: str) -> str:
    w = "OVER (PARTITION BY activity_id ORDER BY i ROWS UNBOUNDED PRECEDING)"
    return f"px AS (SELECT *, sum({micro(signal)}) {w} AS s, sum(CAST(valid AS INT)) {w} AS ok FROM al)"


def trailing(d: int) -> str:
    w = "OVER (PARTITION BY activity_id ORDER BY i)"
    return f"CASE WHEN ok - lag(ok, {d}, 0) {w} = {d} AND i >= {d - 1} THEN s - lag(s, {d}, 0) {w} END"


def metrics_cte(ftp: str, kg: str) -> str:
    """fo, g and pm: power metrics of al, with the parameters as expressions over g."""
    np_ = "pow(fourth, 0.25::DOUBLE)"
    avg = "total / 1e6 / nullif(valid_seconds, 0)"
    return f"""{prefix("watts")},
fo AS (SELECT *, CASE WHEN has_watts THEN pow(({trailing(30)}) / 30.0::DOUBLE / 1e6, 4) END AS fourth FROM px),
g AS (
  SELECT activity_id, count(*) FILTER (valid) AS valid_seconds, sum({micro("watts")}) FILTER (valid AND has_watts) AS total,
         avg(fourth) AS fourth, count(fourth) AS np_windows
  FROM fo GROUP BY 1),
pm AS (
  SELECT activity_id, valid_seconds, {rnd(avg, 2)} AS avg_w, {rnd(np_, 2)} AS np_w, {rnd(f"{np_} / nullif({avg}, 0)", 4)} AS vi,
         {rnd(f"{np_} / {ftp}", 4)} AS intensity, {rnd(f"valid_seconds * {np_} * ({np_} / {ftp}) / ({ftp} * 3600) * 100", 2)} AS tss,
         {rnd("total / 1e6 / 1000", 2)} AS work_kj, {rnd(f"{avg} / {kg}", 3)} AS avg_wkg, np_windows
  FROM g)"""


def metrics(view: str, ftp: float, kg: float) -> str:
    return f"WITH {aligned(view)}, {metrics_cte(f'{ftp}::DOUBLE', f'{kg}::DOUBLE')} SELECT * FROM pm"


def curves(durations: tuple[int, ...], signal: str = "watts") -> str:
    parts = " UNION ALL ".join(f"SELECT activity_id, i, \"offset\", {d} AS duration_s, CASE WHEN has_{signal} THEN {trailing(d)} END AS b FROM px" for d in durations)
    return f"""{prefix(signal)}, ws AS ({parts}),
cv AS (SELECT activity_id, duration_s, max(b) AS b, arg_max(i, (b, -i)) FILTER (b IS NOT NULL) + max("offset") AS end_s FROM ws GROUP BY ALL),
curve AS (SELECT activity_id, duration_s, {rnd("b / duration_s / 1e6", 2)} AS best, end_s - duration_s + 1 AS start_s, end_s FROM cv)"""


def bands_sql(zones: list, name: str = "zs") -> str:
    rows = ", ".join(f"({k}, '{n}', {lo}::DOUBLE, {'NULL' if hi is None else f'{hi}::DOUBLE'})" for k, (n, lo, hi) in enumerate(zones))
    return f"{name}(band, zone, lower, upper) AS (VALUES {rows})"


def zones(view: str, signal: str, zones_: list) -> str:
    return f"""WITH {aligned(view)}, {bands_sql(zones_)},
hit AS (
  SELECT activity_id, band, {micro("watts")} AS w, has_{signal} AS has, has_watts AS power
  FROM al LEFT JOIN zs ON {signal} >= lower AND (upper IS NULL OR {signal} < upper) WHERE valid),
per AS (SELECT activity_id, band, count(*) AS n, sum(w) AS w FROM hit GROUP BY ALL),
tot AS (
  SELECT activity_id, count(band) AS classified, count(*) FILTER (band IS NULL) AS out_, bool_or(has) AS has, bool_or(power) AS power
  FROM hit GROUP BY 1)
SELECT t.activity_id, zone, {rnd("lower", 4)} AS lower, {rnd("upper", 4)} AS upper, CASE WHEN has THEN coalesce(n, 0) END AS seconds,
  CASE WHEN has THEN {rnd("coalesce(n, 0) / 60.0::DOUBLE", 2)} END AS minutes,
  CASE WHEN has THEN CASE WHEN classified > 0 THEN {rnd("coalesce(n, 0)::DOUBLE / classified * 100", 2)} ELSE 0 END END AS percent,
  CASE WHEN has AND power THEN {rnd("coalesce(w, 0) / 1e6 / 1000", 2)} END AS work_kj, CASE WHEN has THEN out_ END AS unclassified_seconds
FROM tot t CROSS JOIN zs LEFT JOIN per p ON p.activity_id = t.activity_id AND p.band = zs.band"""


def efforts(zones_: list) -> str:
    return f"""{bands_sql(zones_)},
bk AS (SELECT *, sum(CAST(NOT valid AS INT)) OVER (PARTITION BY activity_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS bad FROM al),
inn AS (SELECT activity_id, i, bad, band, zone FROM bk JOIN zs ON valid AND has_watts AND watts >= lower AND (upper IS NULL OR watts < upper)),
nw AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL OR i - lag(i) OVER w - 1 > 2 OR lag(bad) OVER w <> bad THEN 1 ELSE 0 END AS new FROM inn WINDOW w AS (PARTITION BY activity_id, band ORDER BY i)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY activity_id, band ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM nw),
eff AS (SELECT activity_id, zone AS range, CAST(island AS BIGINT) AS island, min(i) AS from_i, max(i) AS to_i, count(*) AS seconds FROM isl GROUP BY ALL)"""


FTP, KG = 60.0, 70.0
DUR = (1, 5, 10, 30, 60, 120, 300)
POWER = bands.absolute(bands.POWER_ZONES, FTP)
WORK = bands.absolute(bands.WORK_RANGES, FTP)
HR = bands.lthr_zones(110.0, 178.0)
ACTS = "acts AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"
PROFILE = "pr AS (SELECT o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS effective_from, CAST(max(o_totalprice) AS DOUBLE) AS value FROM orders GROUP BY ALL), pf AS (SELECT *, lead(effective_from) OVER (PARTITION BY athlete_id ORDER BY effective_from) - 1 AS effective_to FROM pr)"

DAYS = (1, 5, 10)
#: Power uphill, more for some groups than for others.
UPHILL = "value * CASE WHEN (n // 40) % 2 = 0 THEN 1 + (g % 5) / 4.0::DOUBLE ELSE 1 END"
SMOOTH = f"""n AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n FROM al),
r AS (SELECT *, least(7, i, n - 1 - i) AS r FROM n),
sm AS (
  SELECT a.activity_id, a.i, a.distance, coalesce(sum({micro('b.altitude')}) FILTER (b.valid) / count(*) FILTER (b.valid) / 1e6, any_value(a.altitude)) AS smooth
  FROM r a JOIN al b ON b.activity_id = a.activity_id AND b.i BETWEEN a.i - a.r AND a.i + a.r GROUP BY a.activity_id, a.i, a.distance),
bk AS (
  SELECT *, coalesce(max((i, distance, smooth)) OVER (PARTITION BY activity_id ORDER BY distance RANGE BETWEEN UNBOUNDED PRECEDING AND 50 PRECEDING),
                     min((i, distance, smooth)) OVER (PARTITION BY activity_id)) AS b
  FROM sm),
gr AS (SELECT activity_id, i, smooth, CASE WHEN distance - b[2] < 1 THEN 0 ELSE (smooth - b[3]) / (distance - b[2]) * 100 END AS grade FROM bk)"""
#: Climbs of `al` as `climb`, after `act` with the power's source.
CLIMBS = f"""{SMOOTH}, {prefix("watts")},
c1 AS (
  SELECT px.*, gr.smooth, gr.grade, pow(({trailing(30)}) / 30.0::DOUBLE / 1e6, 4) AS fourth,
         lag(px.valid) OVER w AS was, px.distance - lag(px.distance) OVER w AS gone, coalesce(gr.smooth > lag(gr.smooth) OVER w, false) AS up
  FROM px JOIN gr USING (activity_id, i) WHERE has_altitude AND has_distance WINDOW w AS (PARTITION BY activity_id ORDER BY i)),
c2 AS (SELECT *, valid AND coalesce(was, false) AS fine, greatest(coalesce(gone, 0), 0) AS step FROM c1),
c3 AS (SELECT *, fine AND grade >= 3 AS rising FROM c2),
c4 AS (
  SELECT *, sum(CAST(NOT fine AS INT)) OVER w AS bad, sum(CASE WHEN rising THEN 0 ELSE step END) OVER w AS flat
  FROM c3 WINDOW w AS (PARTITION BY activity_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
c5 AS (SELECT activity_id, i, CASE WHEN lag(bad) OVER w = bad AND flat - lag(flat) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM c4 WHERE rising WINDOW w AS (PARTITION BY activity_id ORDER BY i)),
c6 AS (SELECT activity_id, i, sum(new) OVER (PARTITION BY activity_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS climb FROM c5),
c7 AS (SELECT activity_id, climb, min(i) - 1 AS a, max(i) AS b FROM c6 GROUP BY ALL),
c8 AS (SELECT c4.*, climb, a FROM c4 JOIN c7 ON c7.activity_id = c4.activity_id AND i BETWEEN a AND b),
c9 AS (SELECT *, min(CASE WHEN up AND i > a THEN i - 1 END) OVER w AS from_i, max(CASE WHEN up AND i > a THEN i END) OVER w AS to_i FROM c8 WINDOW w AS (PARTITION BY activity_id, climb)),
c10 AS (
  SELECT *, min((i, distance, smooth)) OVER (PARTITION BY activity_id, climb ORDER BY distance RANGE BETWEEN 200 PRECEDING AND CURRENT ROW) AS back
  FROM c9 WHERE i BETWEEN from_i AND to_i),
c11 AS (
  SELECT activity_id, climb, from_i, to_i, max(distance) - min(distance) AS d,
         list_reduce(list_transform(list(smooth ORDER BY i), lambda x: {{'ref': x, 'gain': 0.0::DOUBLE}}),
           lambda acc, e: CASE WHEN e.ref < acc.ref THEN {{'ref': e.ref, 'gain': acc.gain}}
                               WHEN e.ref - acc.ref > 1.0 THEN {{'ref': e.ref, 'gain': acc.gain + (e.ref - acc.ref)}} ELSE acc END).gain AS g,
         sum({micro("watts")}) FILTER (valid AND has_watts) / 1e6 / nullif(count(*) FILTER (valid AND has_watts), 0) AS w,
         avg(fourth) FILTER (i - from_i >= 29 AND has_watts) AS fourth,
         max(CASE WHEN distance - back[2] >= 180 THEN (smooth - back[3]) / (distance - back[2]) * 100 END) AS sustained,
         sum({micro("heartrate")}) FILTER (valid AND has_heartrate) / 1e6 / nullif(count(*) FILTER (valid AND has_heartrate), 0) AS h
  FROM c10 GROUP BY ALL),
c12 AS (SELECT *, g / d * 100 AS gp, g / ((to_i - from_i) / 3600.0::DOUBLE) AS v, w / {KG}::DOUBLE AS wkg FROM c11 WHERE d >= 500 AND g >= 30 AND g / d * 100 >= 3),
climb AS (
  SELECT activity_id, CAST(row_number() OVER (PARTITION BY activity_id ORDER BY from_i) AS INTEGER) AS climb, from_i, to_i,
         {rnd("d", 1)} AS distance_m, {rnd("g", 1)} AS gain_m, {rnd("gp", 2)} AS grade_pct, {rnd("sustained", 2)} AS sustained_pct, {rnd("v", 1)} AS vam,
         {rnd("gp * gp * d / 1000", 1)} AS score,
         CASE WHEN gp * gp * d / 1000 >= 700 THEN 'muy dura' WHEN gp * gp * d / 1000 >= 300 THEN 'dura' WHEN gp * gp * d / 1000 >= 100 THEN 'media'
              WHEN gp * gp * d / 1000 >= 20 THEN 'suave' ELSE 'corta' END AS tier,
         {rnd("w", 2)} AS avg_w, {rnd("pow(fourth, 0.25::DOUBLE)", 2)} AS np_w, {rnd("wkg", 3)} AS avg_wkg,
         CASE WHEN device_watts AND wkg > 0 THEN {rnd("v / wkg", 2)} END AS efficiency_index, {rnd("h", 2)} AS avg_hr
  FROM c12 JOIN act USING (activity_id))"""
RIDES = f"WITH {aligned('rides')}, {activities('rides')}"


def trend(y: str) -> str:
    return f"""{RIDES}, {CLIMBS}
SELECT activity_id, {rnd(f"regr_slope({y}, climb)", 4)} AS slope, {rnd(f"regr_intercept({y}, climb)", 4)} AS intercept,
       {rnd(f"coalesce(regr_r2({y}, climb), 1)", 4)} AS r2, count(*) AS n
FROM climb WHERE {y} IS NOT NULL GROUP BY 1 HAVING count(*) >= 3"""


def best(signal: str, measured: str) -> str:
    return f"""WITH {aligned('days')}, {activities('days')}, {curves(DAYS, signal)},
top AS (
  SELECT *, row_number() OVER (ORDER BY day DESC, activity_id) AS pos FROM act
  WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' ORDER BY pos LIMIT 30),
kept AS (SELECT * FROM top WHERE athlete_id % 13 <> 5),
fit AS (SELECT DISTINCT activity_id FROM curve JOIN kept USING (activity_id) WHERE best IS NOT NULL AND {measured})"""


#: Parameters of each activity as of its day, as fp, after act: each kind's entry that covers the day.
PARAMETERS = """pe0 AS (
  SELECT o_custkey % 60 AS athlete_id, o_orderkey % 3 AS m, DATE '2023-12-20' + CAST(o_orderkey % 50 AS INT) AS f, max(o_orderkey) AS k,
         max(CASE o_orderkey % 3 WHEN 0 THEN 50 + o_orderkey % 20 WHEN 1 THEN 60 + o_orderkey % 9 ELSE 160 + o_orderkey % 30 END)::DOUBLE AS value
  FROM orders GROUP BY 1, 2, 3),
pe AS (SELECT *, least(lead(f) OVER (PARTITION BY athlete_id, m ORDER BY f) - 1, CASE WHEN k % 5 = 0 THEN f + 9 END) AS u FROM pe0),
fp AS (
  SELECT activity_id, any_value(device_watts) AS device_watts, max(value) FILTER (m = 0) AS ftp, max(value) FILTER (m = 1) AS kg, max(value) FILTER (m = 2) AS hm
  FROM act LEFT JOIN pe ON pe.athlete_id = act.athlete_id AND day >= f AND (u IS NULL OR day <= u) GROUP BY 1)"""
#: Heart rate and cadence of each activity, as sg.
SUMMARIES = f"""sg AS (
  SELECT activity_id, bool_or(has_watts) AS hw, bool_or(has_heartrate) AS hh, bool_or(has_cadence) AS hc,
         {rnd(f"sum({micro('heartrate')}) FILTER (valid AND has_heartrate) / 1e6 / nullif(count(*) FILTER (valid AND has_heartrate), 0)", 2)} AS mean_hr,
         {rnd("max(heartrate) FILTER (valid AND has_heartrate)", 2)} AS max_hr, {rnd("min(heartrate) FILTER (valid AND has_heartrate)", 2)} AS min_hr,
         {rnd(f"sum({micro('cadence')}) FILTER (valid AND cadence > 0) / 1e6 / nullif(count(*) FILTER (valid AND cadence > 0), 0)", 2)} AS mean_cadence
  FROM al GROUP BY 1)"""
#: Orders, newest first, with the running sum of their whole prices.
CACHE = """WITH n AS (
  SELECT *, row_number() OVER w AS place, sum(CAST(trunc(o_totalprice) AS BIGINT)) OVER w AS total
  FROM orders WINDOW w AS (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS LAST ROWS UNBOUNDED PRECEDING))"""

SQL = {
    "align_grid": f"""WITH {aligned('rides')}
SELECT activity_id, i, "offset", valid, moving, {', '.join(rnd(s, 6) + f' AS {s}' for s in SIGNALS)} FROM al""",
    "availability": f"""WITH {samples('rides')}
SELECT activity_id, 'ok' AS status, {', '.join(f'bool_or({s} IS NOT NULL) AS has_{s}' for s in SIGNALS)} FROM smp GROUP BY 1""",
    "gap_summary": f"""WITH {samples('rides')}, gp AS (SELECT activity_id, next - t - 1 AS d FROM cl WHERE next - t > 1)
SELECT activity_id, count(*) AS gap_count, CAST(sum(d) AS BIGINT) AS gap_seconds, max(d) AS longest_gap_s, count(*) FILTER (d > 3) AS unfilled_gaps
FROM gp GROUP BY 1""",
    "quality": f"""WITH {aligned('rides')}, {activities('rides')},
q AS (
  SELECT activity_id, count(*) AS cells, count(*) FILTER (valid) AS valid_cells, count(*) FILTER (known_heartrate) AS h, count(*) FILTER (known_watts) AS p,
         count(*) FILTER (gap > 0) AS gap_count, CAST(coalesce(sum(gap) FILTER (gap > 0), 0) AS BIGINT) AS gap_seconds, coalesce(max(gap) FILTER (gap > 0), 0) AS longest_gap_s,
         count(*) FILTER (gap > 3) AS unfilled_gaps, coalesce(string_agg(CAST(i + 1 AS VARCHAR) || '-' || CAST(i + gap AS VARCHAR), ',' ORDER BY i) FILTER (gap > 3), '') AS unfilled_list
  FROM al GROUP BY 1)
SELECT activity_id, cells, valid_cells, {rnd('valid_cells::DOUBLE / cells * 100', 1)} AS coverage_pct, gap_count, gap_seconds, longest_gap_s, unfilled_gaps, unfilled_list,
  p > 0 AS watts_available, h > 0 AS heartrate_available, CASE WHEN p > 0 THEN cells - p ELSE 0 END AS watts_filled, CASE WHEN h > 0 THEN cells - h ELSE 0 END AS heartrate_filled,
  {rnd('valid_cells::DOUBLE / cells * 100', 1)} < 80 AS low_coverage,
  CASE WHEN p = 0 THEN 'none' WHEN device_watts THEN 'measured' ELSE 'estimated' END AS power_source
FROM q JOIN act USING (activity_id)""",
    "power_metrics": metrics("rides", FTP, KG),
    "power_metrics_daily": metrics("days", FTP, KG),
    "power_curve": f"""WITH {aligned('rides')}, {curves(DUR)}
SELECT *, {rnd(f"best / {KG}::DOUBLE", 3)} AS best_wkg FROM curve""",
    "signal_summary": f"""WITH {aligned('rides')},
v AS (
  SELECT activity_id, 'heartrate' AS signal, CASE WHEN valid AND has_heartrate THEN heartrate END AS v FROM al
  UNION ALL SELECT activity_id, 'cadence', CASE WHEN valid AND has_cadence AND cadence > 0 THEN cadence END FROM al)
SELECT activity_id, signal, count(v) AS seconds, {rnd(f"sum({micro('v')}) / 1e6 / nullif(count(v), 0)", 2)} AS mean, {rnd('max(v)', 2)} AS max, {rnd('min(v)', 2)} AS min
FROM v GROUP BY ALL""",
    "time_in_power_zones": zones("rides", "watts", POWER),
    "time_in_hr_zones": zones("rides", "heartrate", HR),
    "torque_cadence": f"""WITH {aligned('rides')}, {bands_sql([(str(k), k * 10.0, None if k == 14 else (k + 1) * 10.0) for k in range(15)])},
tq AS (
  SELECT activity_id, least(CAST(floor(cadence / 10.0::DOUBLE) AS INT), 14) AS band, {micro('watts')} AS w, watts / (2 * pi() * cadence / 60) AS torque
  FROM al WHERE valid AND cadence > 0 AND has_watts AND has_cadence),
per AS (SELECT activity_id, band, count(*) AS n, sum(w) AS w, sum({micro('torque')}) AS t, max(torque) AS top FROM tq GROUP BY ALL),
tt AS (SELECT activity_id, sum(n) AS analysed FROM per GROUP BY 1),
base AS (SELECT activity_id, bool_or(has_watts AND has_cadence) AS has, count(*) FILTER (NOT cadence > 0) AS out_ FROM al WHERE valid GROUP BY 1)
SELECT b.activity_id, lower AS lower_rpm, upper AS upper_rpm, CASE WHEN has THEN coalesce(n, 0) END AS seconds,
  CASE WHEN has THEN coalesce({rnd('n::DOUBLE / analysed * 100', 2)}, 0) END AS percent, {rnd('w / 1e6 / n', 2)} AS mean_power_w, {rnd('t / 1e6 / n', 3)} AS mean_torque_nm,
  {rnd('top', 3)} AS max_torque_nm, CASE WHEN has THEN coalesce({rnd('w / 1e6 / 1000', 3)}, 0) END AS work_kj, CASE WHEN has THEN out_ END AS excluded_seconds
FROM base b CROSS JOIN zs LEFT JOIN tt ON tt.activity_id = b.activity_id LEFT JOIN per p ON p.activity_id = b.activity_id AND p.band = zs.band""",
    "efforts": f"WITH {aligned('rides')}, {efforts(WORK)} SELECT * FROM eff",
    "work_above_ftp": f"""WITH {aligned('rides')}, {efforts(WORK)},
vs AS (SELECT activity_id, count(*) FILTER (valid) AS vn, bool_or(has_watts) AS has FROM al GROUP BY 1),
wk AS (SELECT activity_id, band, count(*) AS n, sum({micro('watts')}) AS w FROM al JOIN zs ON valid AND has_watts AND watts >= lower AND (upper IS NULL OR watts < upper) GROUP BY ALL),
es AS (SELECT activity_id, range, count(*) AS c, sum(seconds) AS total, max(seconds) AS m FROM eff GROUP BY ALL)
SELECT vs.activity_id, zone AS range, {rnd('lower', 2)} AS lower_w, {rnd('upper', 2)} AS upper_w, CASE WHEN has THEN coalesce(n, 0) END AS seconds,
  CASE WHEN has THEN {rnd('coalesce(n, 0)::DOUBLE / nullif(vn, 0) * 100', 2)} END AS percent, CASE WHEN has THEN {rnd('coalesce(w, 0) / 1e6 / 1000', 3)} END AS work_kj,
  CASE WHEN has THEN {rnd(f'(coalesce(w, 0) / 1e6 - coalesce(n, 0) * {FTP}::DOUBLE) / 1000', 3)} END AS work_above_kj, CASE WHEN has THEN coalesce(c, 0) END AS effort_count,
  {rnd('total::DOUBLE / c', 2)} AS mean_effort_s, m AS max_effort_s
FROM vs CROSS JOIN zs LEFT JOIN wk ON wk.activity_id = vs.activity_id AND wk.band = zs.band LEFT JOIN es ON es.activity_id = vs.activity_id AND es.range = zone""",
    "decoupling": f"""WITH {aligned('rides')},
k AS (SELECT *, i >= 60 AND heartrate > 0 AND watts >= 10 AND has_watts AND has_heartrate AND moving AS keep FROM al WHERE valid),
n AS (SELECT *, count(*) OVER (PARTITION BY activity_id, keep) AS n, row_number() OVER (PARTITION BY activity_id, keep ORDER BY i) AS at_ FROM k),
g AS (
  SELECT activity_id, count(*) FILTER (keep) AS n, count(*) FILTER (NOT keep) AS x,
         sum({micro('watts')}) FILTER (keep AND at_ <= n // 2)::DOUBLE AS w1, sum({micro('heartrate')}) FILTER (keep AND at_ <= n // 2)::DOUBLE AS h1,
         sum({micro('watts')}) FILTER (keep AND at_ > n // 2)::DOUBLE AS w2, sum({micro('heartrate')}) FILTER (keep AND at_ > n // 2)::DOUBLE AS h2
  FROM n GROUP BY 1),
e AS (SELECT *, (w1 / 1e6 / (n // 2)) / (h1 / 1e6 / (n // 2)) AS e1, (w2 / 1e6 / (n - n // 2)) / (h2 / 1e6 / (n - n // 2)) AS e2 FROM g)
SELECT activity_id, n >= 100 AS available, CASE WHEN n >= 2 THEN n ELSE 0 END AS valid_seconds, CASE WHEN n >= 2 THEN x ELSE 0 END AS excluded_seconds,
  CASE WHEN n >= 100 THEN {rnd('e1', 6)} END AS first_ef, CASE WHEN n >= 100 THEN {rnd('e2', 6)} END AS second_ef,
  CASE WHEN n >= 100 THEN {rnd('(e1 - e2) / nullif(e1, 0) * 100', 4)} END AS decoupling_pct FROM e""",
    "best_effort_period": f"""{best('watts', 'device_watts')}
SELECT duration_s, activity_id, day, best, start_s, end_s FROM curve JOIN kept USING (activity_id)
WHERE best IS NOT NULL AND device_watts QUALIFY row_number() OVER (PARTITION BY duration_s ORDER BY best DESC, pos) = 1""",
    "best_effort_hr": f"""{best('heartrate', 'true')}
SELECT duration_s, activity_id, day, best, start_s, end_s FROM curve JOIN kept USING (activity_id)
WHERE best IS NOT NULL QUALIFY row_number() OVER (PARTITION BY duration_s ORDER BY best DESC, pos) = 1""",
    "best_effort_skips": f"""{best('watts', 'device_watts')}
SELECT activity_id, day, CASE WHEN device_watts IS NULL THEN 'power_source_unknown' WHEN NOT device_watts THEN 'power_estimated'
  WHEN activity_id IN (SELECT activity_id FROM fit) THEN 'used' ELSE 'no_data' END AS status FROM kept""",
    "estimates": f"""WITH {aligned('rides')}, {curves((300, 1200))},
hx AS (
  SELECT activity_id, i, has_heartrate, sum({micro('heartrate')}) OVER w AS hs, sum(CAST(valid AS INT)) OVER w AS hok
  FROM al WINDOW w AS (PARTITION BY activity_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
hw AS (
  SELECT activity_id, CASE WHEN has_heartrate AND hok - lag(hok, 1200, 0) OVER w = 1200 AND i >= 1199 THEN hs - lag(hs, 1200, 0) OVER w END AS h
  FROM hx WINDOW w AS (PARTITION BY activity_id ORDER BY i)),
hb AS (SELECT activity_id, {rnd('max(h) / 1200 / 1e6', 2)} AS beats FROM hw GROUP BY 1),
c AS (SELECT activity_id, max(best) FILTER (duration_s = 300) AS short, max(best) FILTER (duration_s = 1200) AS long FROM curve GROUP BY 1)
SELECT activity_id, CASE WHEN short > 0 THEN {rnd(f'16.6::DOUBLE + 8.87::DOUBLE * (short / {KG}::DOUBLE)', 2)} END AS vo2max,
       CASE WHEN long > 0 THEN {rnd('long * 0.95::DOUBLE', 2)} END AS ftp, CASE WHEN beats > 0 THEN {rnd('beats * 0.98::DOUBLE', 0)} END AS lthr
FROM c JOIN hb USING (activity_id)""",
    "climb_grade": f"""WITH {aligned('rides')}, {SMOOTH}
SELECT activity_id, i, {rnd('smooth', 4)} AS smooth, {rnd('grade', 3)} AS grade FROM gr""",
    "climb_segments": f"{RIDES}, {CLIMBS} SELECT * FROM climb",
    "climb_trend": trend("avg_w"),
    "climb_trend_hr": trend("avg_hr"),
    "climb_gain": f"""{RIDES}, {CLIMBS}
SELECT activity_id, count(*) AS climbs, {rnd("sum(CAST(floor(gain_m * 10 + 0.5::DOUBLE) AS BIGINT)) / 10.0::DOUBLE", 1)} AS gain_m FROM climb GROUP BY 1""",
    "climb_vs_best": f"""WITH {aligned('weeks', UPHILL)}, {activities('weeks')}, {CLIMBS},
own AS (SELECT *, athlete_id // 5 AS rider FROM act),
dc AS (SELECT c.*, to_i - from_i AS duration_s, rider, device_watts FROM climb c JOIN own USING (activity_id)),
dem AS (SELECT DISTINCT rider, duration_s AS d FROM dc WHERE device_watts AND duration_s > 0),
ls AS (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY day DESC, activity_id) AS pos FROM own WHERE day BETWEEN DATE '2024-02-20' - 42 AND DATE '2024-02-20'),
hs AS (SELECT * FROM ls WHERE pos <= 30 AND device_watts),
wn AS (
  SELECT hs.rider, hs.activity_id, hs.pos, hs.day, d, p1.s - coalesce(p0.s, 0) AS b
  FROM hs JOIN dem USING (rider) JOIN px p1 ON p1.activity_id = hs.activity_id AND p1.i >= d - 1 LEFT JOIN px p0 ON p0.activity_id = p1.activity_id AND p0.i = p1.i - d
  WHERE p1.has_watts AND p1.ok - coalesce(p0.ok, 0) = d),
bs AS (SELECT rider, activity_id, pos, day, d, {rnd("max(b) / d / 1e6", 2)} AS best FROM wn GROUP BY 1, 2, 3, 4, 5)
SELECT c.activity_id, c.climb, c.duration_s, c.avg_w,
       CASE WHEN NOT coalesce(device_watts, false) THEN 'not_measured' WHEN avg_w IS NULL THEN 'no_power' WHEN best IS NULL THEN 'no_history' ELSE 'compared' END AS status,
       CASE WHEN device_watts AND avg_w IS NOT NULL THEN best END AS best_w, CASE WHEN device_watts AND avg_w IS NOT NULL THEN b.activity_id END AS best_activity_id,
       CASE WHEN device_watts AND avg_w IS NOT NULL THEN b.day END AS best_day, CASE WHEN device_watts THEN {rnd("avg_w / nullif(best, 0) * 1000", 0)} / 10.0::DOUBLE END AS percent_of_best
FROM dc c LEFT JOIN bs b ON b.rider = c.rider AND b.d = c.duration_s AND b.activity_id <> c.activity_id
QUALIFY row_number() OVER (PARTITION BY c.activity_id, c.climb ORDER BY best DESC NULLS LAST, b.pos) = 1""",
    "activity_analysis": f"""WITH {aligned('weeks')}, {activities('weeks')}, {PARAMETERS},
{metrics_cte('(SELECT ftp FROM fp WHERE fp.activity_id = g.activity_id)', '(SELECT kg FROM fp WHERE fp.activity_id = g.activity_id)')}, {SUMMARIES}, {CLIMBS.replace(prefix("watts") + ",", "")},
z AS (
  SELECT activity_id, count(*) FILTER (valid) AS valid_n, count(*) AS cells, bool_or(has_altitude AND has_distance) AS ha,
         {', '.join(f"count(*) FILTER (valid AND has_watts AND watts >= {lo}::DOUBLE * ftp" + (f" AND watts < {hi}::DOUBLE * ftp" if hi else "") + f") AS p{k}" for k, (_, lo, hi) in enumerate(bands.POWER_ZONES))},
         {', '.join(f"count(*) FILTER (valid AND has_heartrate AND heartrate >= {lo}::DOUBLE * hm" + (f" AND heartrate < {hi}::DOUBLE * hm" if hi else "") + f") AS h{k}" for k, (_, lo, hi) in enumerate(bands.HR_ZONES))}
  FROM al JOIN fp USING (activity_id) GROUP BY 1),
k AS (SELECT * FROM al WHERE valid AND heartrate > 0 AND has_watts AND has_heartrate),
kn AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n, row_number() OVER (PARTITION BY activity_id ORDER BY i) AS at_ FROM k),
kg_ AS (
  SELECT activity_id, count(*) AS n, sum({micro('watts')}) FILTER (at_ <= n // 2)::DOUBLE AS w1, sum({micro('heartrate')}) FILTER (at_ <= n // 2)::DOUBLE AS h1,
         sum({micro('watts')}) FILTER (at_ > n // 2)::DOUBLE AS w2, sum({micro('heartrate')}) FILTER (at_ > n // 2)::DOUBLE AS h2
  FROM kn GROUP BY 1),
e AS (SELECT *, (w1 / 1e6 / (n // 2)) / (h1 / 1e6 / (n // 2)) AS e1, (w2 / 1e6 / (n - n // 2)) / (h2 / 1e6 / (n - n // 2)) AS e2 FROM kg_ WHERE n >= 200),
cs AS (SELECT activity_id, count(*) AS c, {rnd("sum(CAST(floor(gain_m * 10 + 0.5::DOUBLE) AS BIGINT)) / 10.0::DOUBLE", 1)} AS gain, max(vam) AS vam FROM climb GROUP BY 1),
j AS (
  SELECT *, CASE WHEN NOT hw THEN 'MISSING_POWER' END AS pc, CASE WHEN NOT hh THEN 'MISSING_HR' END AS hc_, {rnd('valid_n::DOUBLE / cells * 100', 1)} AS coverage,
         CASE WHEN NOT hw THEN 'MISSING_POWER' WHEN NOT hh THEN 'MISSING_HR' WHEN e1 IS NULL THEN 'INSUFFICIENT_DURATION' END AS dc, CASE WHEN NOT ha THEN 'MISSING_ELEVATION' END AS cc
  FROM z JOIN pm USING (activity_id) JOIN sg USING (activity_id) JOIN fp USING (activity_id) LEFT JOIN e USING (activity_id) LEFT JOIN cs USING (activity_id)),
q AS (SELECT *, coalesce(pc, CASE WHEN ftp IS NULL THEN 'MISSING_FTP' END) AS pzc, coalesce(hc_, CASE WHEN hm IS NULL THEN 'INVALID_PROFILE' END) AS hzc FROM j)
SELECT activity_id, true AS activity_details_available, CAST(NULL AS VARCHAR) AS activity_details_code, pc IS NULL AS power_metrics_available, pc AS power_metrics_code,
       hc_ IS NULL AS heartrate_summary_available, hc_ AS heartrate_summary_code, mean_cadence IS NOT NULL AS cadence_summary_available, CAST(NULL AS VARCHAR) AS cadence_summary_code,
       pzc IS NULL AS power_zones_available, pzc AS power_zones_code, hzc IS NULL AS heartrate_zones_available, hzc AS heartrate_zones_code,
       dc IS NULL AS decoupling_available, dc AS decoupling_code, cc IS NULL AS climbs_available, cc AS climbs_code,
       CAST(1 + CAST(pc IS NULL AS INT) + CAST(hc_ IS NULL AS INT) + CAST(mean_cadence IS NOT NULL AS INT) + CAST(pzc IS NULL AS INT) + CAST(hzc IS NULL AS INT) + CAST(dc IS NULL AS INT) + CAST(cc IS NULL AS INT) AS INT) AS modules_available,
       concat_ws(',', CASE WHEN ftp IS NULL THEN 'MISSING_FTP' END, CASE WHEN kg IS NULL THEN 'MISSING_WEIGHT' END, CASE WHEN coverage < 80 THEN 'LOW_COVERAGE' END) AS errors,
       cells, valid_n AS valid_seconds, coverage AS coverage_pct, CASE WHEN NOT hw THEN 'none' WHEN device_watts THEN 'measured' ELSE 'estimated' END AS power_source,
       avg_w, np_w, vi, intensity, tss, work_kj, avg_wkg, CASE WHEN pc IS NULL THEN np_windows END AS np_windows,
       CASE WHEN pc IS NULL THEN concat_ws(',', CASE WHEN ftp IS NULL THEN 'intensity' END, CASE WHEN ftp IS NULL THEN 'tss' END, CASE WHEN kg IS NULL THEN 'avg_wkg' END) END AS lacking,
       mean_hr, max_hr, min_hr, mean_cadence, CASE WHEN pzc IS NULL THEN concat_ws(',', {', '.join(f'p{k}' for k in range(7))}) END AS power_seconds,
       CASE WHEN pzc IS NULL THEN CASE WHEN {'+'.join(f'p{k}' for k in range(7))} > 0 THEN {rnd(f"p1::DOUBLE / ({'+'.join(f'p{k}' for k in range(7))}) * 100", 2)} ELSE 0 END END AS z2_percent,
       CASE WHEN hzc IS NULL THEN concat_ws(',', {', '.join(f'h{k}' for k in range(5))}) END AS hr_seconds, CASE WHEN hzc IS NULL THEN valid_n - ({'+'.join(f'h{k}' for k in range(5))}) END AS hr_unclassified,
       {rnd('e1', 6)} AS first_ef, {rnd('e2', 6)} AS second_ef, {rnd('(e1 - e2) / nullif(e1, 0) * 100', 4)} AS decoupling_pct,
       CASE WHEN cc IS NULL THEN coalesce(c, 0) END AS climb_count, CASE WHEN cc IS NULL THEN coalesce(gain, 0) END AS total_gain_m, vam AS best_vam
FROM q""",
    "comparison_requests": f"""WITH {samples('weeks')}, {activities('weeks')},
rq AS (SELECT user_id, {GROUP} AS g, (CAST(ts AS DATE) - DATE '1970-01-01') // 7 AS week FROM events),
asked AS (
  SELECT DISTINCT user_id AS comparison, g AS athlete_id, 'r' || g || '-w' || week AS activity_id FROM rq
  UNION SELECT user_id, g, 'r' || (g + 1) || '-w' || week FROM rq WHERE user_id % 3 = 0 AND week % 2 = 0),
m AS (
  SELECT comparison, a.athlete_id, count(*) AS asked, count(*) FILTER (act.athlete_id = a.athlete_id) AS usable,
         coalesce(string_agg(activity_id, ',' ORDER BY activity_id) FILTER (act.athlete_id = a.athlete_id), '') AS ids
  FROM asked a LEFT JOIN act USING (activity_id) GROUP BY 1, 2)
SELECT comparison, athlete_id, asked, usable, asked - usable AS rejected,
       CASE WHEN asked < 2 OR asked > 10 THEN 'INVALID_REQUEST' WHEN usable < 2 THEN 'INSUFFICIENT_DURATION' END AS code,
       CASE WHEN asked < 2 OR asked > 10 OR usable < 2 THEN '' ELSE ids END AS ids FROM m""",
    "compare_activities": f"""WITH {aligned('weeks')}, {activities('weeks')}, {PARAMETERS},
{metrics_cte('(SELECT ftp FROM fp WHERE fp.activity_id = g.activity_id)', '(SELECT kg FROM fp WHERE fp.activity_id = g.activity_id)')}, {SUMMARIES},
b AS (SELECT * FROM pm JOIN sg USING (activity_id) JOIN fp USING (activity_id))
""" + " UNION ALL ".join(
        f"SELECT activity_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, {status} AS status FROM b"
        for m, status in (
            ("valid_seconds", "'ok'"),
            *[(m, "CASE WHEN NOT hw THEN 'no_watts' ELSE 'ok' END") for m in ("avg_w", "np_w", "vi", "work_kj")],
            *[(m, "CASE WHEN NOT hw THEN 'no_watts' WHEN ftp IS NULL THEN 'no_ftp_w' ELSE 'ok' END") for m in ("intensity", "tss")],
            ("avg_wkg", "CASE WHEN NOT hw THEN 'no_watts' WHEN kg IS NULL THEN 'no_weight_kg' ELSE 'ok' END"),
            *[(m, "CASE WHEN NOT hh THEN 'no_heartrate' ELSE 'ok' END") for m in ("mean_hr", "max_hr")],
            ("mean_cadence", "CASE WHEN NOT hc THEN 'no_cadence' ELSE 'ok' END"),
        )
    ),
    "compare_rejected": f"""WITH {samples('rides')}, {activities('rides')},
asked AS (SELECT DISTINCT 'r' || user_id AS activity_id FROM events)
SELECT asked.activity_id, CASE WHEN athlete_id IS NULL THEN 'not_found' ELSE 'other_athlete' END AS reason
FROM asked LEFT JOIN act USING (activity_id) WHERE athlete_id IS NULL OR athlete_id <> 1""",
    "stream_stats": f"""WITH {samples('rides')},
sp AS (
  SELECT *, (distance - lag(distance) OVER w) / nullif(t - lag(t) OVER w, 0) AS speed,
         CASE WHEN row_number() OVER w >= 30 THEN pow(sum({micro('coalesce(watts, 0)')}) OVER (PARTITION BY activity_id ORDER BY sample_idx ROWS 29 PRECEDING) / 30.0::DOUBLE / 1e6, 4) END AS f
  FROM smp WINDOW w AS (PARTITION BY activity_id ORDER BY sample_idx))
SELECT activity_id, count(*) AS samples, max(heartrate) AS hr_max, min(heartrate) AS hr_min, {rnd(f"sum({micro('heartrate')}) / 1e6 / nullif(count(heartrate), 0)", 0)} AS hr_avg,
       max(watts) AS watts_max, {rnd(f"sum({micro('watts')}) / 1e6 / nullif(count(watts), 0)", 0)} AS watts_avg, {rnd('max(speed) * 3.6::DOUBLE', 1)} AS speed_max,
       {rnd(f"sum({micro('speed')}) / 1e6 / nullif(count(speed), 0) * 3.6::DOUBLE", 1)} AS speed_avg, coalesce({rnd('pow(avg(f), 0.25::DOUBLE)', 0)}, 0) AS naive_np
FROM sp GROUP BY 1""",
    "downsample": f"""WITH {aligned('rides')}, sz AS (SELECT activity_id, count(*) AS n FROM al GROUP BY 1),
tg AS (
  SELECT activity_id, n, unnest(CASE WHEN n <= 100 THEN generate_series(0, n - 1)
    ELSE list_transform(generate_series(0, 99), lambda j: CAST(floor(j * (n - 1) / 99.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) END) AS target FROM sz),
nr AS (SELECT t.activity_id, target, a.i, a.watts AS v FROM tg t JOIN al a ON a.activity_id = t.activity_id AND a.i BETWEEN target - 3 AND target + 3),
pk AS (
  SELECT activity_id, target, max(v) FILTER (i = target) AS v, max(v) AS tv, arg_max(i, (v, -i)) AS ti, min(v) AS lv, arg_min(i, (v, i)) AS li
  FROM nr GROUP BY ALL),
al2 AS (
  SELECT activity_id, target AS i FROM pk UNION SELECT activity_id, ti FROM pk WHERE abs(tv - v) > 0.1::DOUBLE * abs(v)
  UNION SELECT activity_id, li FROM pk WHERE abs(lv - v) > 0.1::DOUBLE * abs(v)),
pl AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY i) AS place FROM al2)
SELECT activity_id, i, CAST(place AS INTEGER) AS place, {rnd('watts', 6)} AS watts FROM pl JOIN al USING (activity_id, i) WHERE place <= 100""",
    "uniform_sample": f"""WITH {aligned('rides')}, sz AS (SELECT activity_id, count(*) AS n FROM al GROUP BY 1),
tg AS (
  SELECT activity_id, unnest(CASE WHEN n <= 100 THEN generate_series(0, n - 1)
    ELSE list_transform(generate_series(0, 99), lambda j: CAST(floor(j * (n - 1) / 99.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) END) AS i FROM sz)
SELECT activity_id, i, moving FROM tg JOIN al USING (activity_id, i)""",
    "verbose_streams": f"""WITH {samples('rides')}
SELECT activity_id, sample_idx, t::DOUBLE AS seconds_from_start, printf('%02d:%02d:%02d', t % 86400 // 3600, t % 3600 // 60, t % 60) AS clock, distance AS metres, {rnd('distance / 1000.0::DOUBLE', 2)} AS kilometres,
       {rnd('distance / t::DOUBLE * 3.6::DOUBLE', 1)} AS kmh, {rnd('altitude / 3.1::DOUBLE', 6)} AS latitude, {rnd('-distance / 91.7::DOUBLE', 6)} AS longitude, {rnd('altitude / 7 - 30', 1)} AS grade, watts, moving FROM smp""",
    "stream_page": f"""WITH {aligned('rides')}, sz AS (SELECT activity_id, count(*) AS n FROM al GROUP BY 1),
tg AS (
  SELECT activity_id, n, unnest(CASE WHEN n <= 100 THEN generate_series(0, n - 1)
    ELSE list_transform(generate_series(0, 99), lambda j: CAST(floor(j * (n - 1) / 99.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) END) AS target FROM sz),
v AS (SELECT activity_id, i, 'watts' AS signal, watts AS v FROM al UNION ALL SELECT activity_id, i, 'heartrate', heartrate FROM al),
nr AS (SELECT t.activity_id, signal, n, target, i, v FROM tg t JOIN v ON v.activity_id = t.activity_id AND i BETWEEN target - 3 AND target + 3),
pk AS (
  SELECT activity_id, signal, n, target, max(v) FILTER (i = target) AS v, max(v) FILTER (i > 0 AND i < n - 1) AS tv, arg_max(i, (v, -i)) FILTER (i > 0 AND i < n - 1) AS ti,
         min(v) FILTER (i > 0 AND i < n - 1) AS lv, arg_min(i, (v, i)) FILTER (i > 0 AND i < n - 1) AS li
  FROM nr GROUP BY ALL),
a2 AS (
  SELECT activity_id, signal, target AS i FROM pk UNION SELECT activity_id, signal, ti FROM pk WHERE n > 100 AND target > 0 AND target < n - 1 AND abs(tv - v) > 0.1::DOUBLE * abs(v)
  UNION SELECT activity_id, signal, li FROM pk WHERE n > 100 AND target > 0 AND target < n - 1 AND abs(lv - v) > 0.1::DOUBLE * abs(v)),
pt AS (
  SELECT activity_id, signal, i, v FROM a2 JOIN v USING (activity_id, signal, i)
  UNION ALL SELECT activity_id, 'moving', i, CAST(moving AS INT)::DOUBLE FROM tg JOIN al USING (activity_id) WHERE i = target),
pl AS (SELECT *, row_number() OVER (PARTITION BY activity_id, signal ORDER BY i) AS place FROM pt QUALIFY place <= 100),
pg AS (SELECT activity_id, CAST(ceil(max(place) / 40.0::DOUBLE) AS INT) AS pages FROM pl WHERE signal = 'watts' GROUP BY 1)
SELECT activity_id, signal, 2 AS page, any_value(pages) AS pages, CAST(count(*) FILTER (pages >= 2 AND place BETWEEN 41 AND 80) AS INT) AS points, CASE WHEN any_value(pages) >= 2 THEN 'ok' ELSE 'invalid_page' END AS status,
       coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY place) FILTER (pages >= 2 AND place BETWEEN 41 AND 80), '') AS indexes,
       coalesce(string_agg(CAST(CAST(floor(v * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (pages >= 2 AND place BETWEEN 41 AND 80), '') AS data
FROM pl JOIN pg USING (activity_id) GROUP BY 1, 2""",
    "chunk_assign": f"""WITH {aligned('rides')}
SELECT activity_id, i // 405 AS chunk, count(*) AS points, '{{"i":[' || string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) || '],"valid":[' || string_agg(CAST(valid AS VARCHAR), ',' ORDER BY i) || ']}}' AS payload
FROM al GROUP BY ALL""",
    "profile_asof": f"""WITH {PROFILE}, ac AS (SELECT l_orderkey * 10 + l_linenumber AS activity_id, l_orderkey % 500 AS athlete_id, CAST(l_shipdate AS DATE) AS day FROM lineitem),
a2 AS (SELECT activity_id, min(athlete_id) AS athlete_id, min(day) AS day FROM ac GROUP BY 1)
SELECT a2.activity_id, a2.athlete_id, a2.day, max(value) AS value, max(effective_from) AS effective_from FROM a2 LEFT JOIN pf ON pf.athlete_id = a2.athlete_id AND effective_from <= day AND (effective_to IS NULL OR day <= effective_to) GROUP BY 1, 2, 3""",
    "profile_overlap_violations": """WITH p AS (SELECT o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS effective_from, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS effective_to FROM orders),
q AS (SELECT DISTINCT * FROM p QUALIFY row_number() OVER (PARTITION BY athlete_id, effective_from ORDER BY effective_to) = 1),
r AS (SELECT *, lead(effective_from) OVER (PARTITION BY athlete_id ORDER BY effective_from) AS next_from FROM q) SELECT * FROM r WHERE next_from IS NOT NULL AND effective_to >= next_from""",
    "activity_filter": "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND lower(o_orderstatus) IN ('f', 'o') AND lower(o_orderpriority) IN ('1-urgent', '5-low')",
    "activity_page": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100",
    "recent_activities": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30",
    "segment_bbox": "SELECT s_suppkey, s_acctbal / 100 AS lat, CAST(s_nationkey AS DOUBLE) AS lng FROM suppliers_ WHERE lat BETWEEN 10 AND 60 AND lng BETWEEN 3 AND 15".replace("suppliers_", "supplier"),
    "leaderboard_topk": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem QUALIFY rank <= 10",
    "athlete_totals": f"SELECT c_nationkey, year(o_orderdate) AS year, count(*) AS activities, {rnd('sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) / 1e2', 2)} AS distance, max(o_totalprice) AS biggest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "format_durations": r"""SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock, CASE WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s % 3600 // 60) ELSE printf('%dm', s // 60) END AS short, strftime(ts, '%m/%d/%Y, %H:%M') AS local,
  printf('%d:%02d', CAST(floor(1000.0::DOUBLE / value + 0.5::DOUBLE) AS BIGINT) // 60, CAST(floor(1000.0::DOUBLE / value + 0.5::DOUBLE) AS BIGINT) % 60) AS pace FROM (SELECT *, CAST(floor(value * 60) AS BIGINT) AS s FROM events)""",
}
assert power.NP_WINDOW == 30

SQL["workout_segments"] = """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place, event_type AS kind, CAST(CASE WHEN k % 2 = 0 THEN 60 * k ELSE k END AS BIGINT) AS seconds,
       CASE k % 4 WHEN 0 THEN 'tempo' WHEN 1 THEN '80% FTP' WHEN 2 THEN 'Very hard' ELSE 'steady' END AS target,
       CASE k % 4 WHEN 0 THEN 0.85::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 1.05::DOUBLE ELSE 0.75::DOUBLE END AS power,
       CASE WHEN k % 3 = 0 AND k > 0 THEN k END AS cadence, CASE WHEN k % 3 = 0 THEN 'go' END AS notes
FROM (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events)"""

SQL |= {
    "hr_order_violations": """WITH o AS (
  SELECT o_custkey AS athlete_id, ['aet_hr_bpm', 'hr_threshold_bpm', 'hr_max_bpm'][1 + o_orderkey % 3] AS metric, 1 + o_orderkey % 3 AS place, 80 + o_orderkey % 120 AS value,
         CAST(o_orderdate AS DATE) AS effective_from, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS effective_to FROM orders)
SELECT a.athlete_id, a.metric AS metric_a, CAST(a.value AS DOUBLE) AS value_a, a.effective_from AS effective_from_a, a.effective_to AS effective_to_a,
       b.metric AS metric_b, CAST(b.value AS DOUBLE) AS value_b, b.effective_from AS effective_from_b, b.effective_to AS effective_to_b
FROM o a JOIN o b ON a.athlete_id = b.athlete_id AND a.place < b.place AND a.effective_from <= b.effective_to AND b.effective_from <= a.effective_to WHERE a.value >= b.value""",
    "profile_violations": """WITH e AS (
  SELECT o_orderkey AS entry, ['ftp_w', 'weight_kg', 'hr_max_bpm', 'speed'][1 + o_orderkey % 4] AS metric, CAST(o_totalprice / 1000 AS DOUBLE) AS value,
         ['W', 'kg', 'bpm', 'W', 'W'][1 + o_orderkey % 5] AS unit, CAST(o_orderdate AS DATE) AS effective_from,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 - 2 AS INTEGER) AS effective_to FROM orders),
s(metric, wanted, lo, hi) AS (VALUES ('ftp_w', 'W', 50.0, 600.0), ('weight_kg', 'kg', 30.0, 200.0), ('hr_max_bpm', 'bpm', 120.0, 230.0)),
p AS (
  SELECT e.entry, e.metric, CASE WHEN wanted IS NULL THEN 'unknown_metric' WHEN unit <> wanted THEN 'unit' WHEN value < lo OR value > hi THEN 'range'
    WHEN effective_to < effective_from THEN 'dates' END AS problem FROM e LEFT JOIN s USING (metric))
SELECT * FROM p WHERE problem IS NOT NULL""",
    "profile_multi_asof": """WITH e AS (
  SELECT o_custkey % 200 AS athlete_id, ['ftp_w', 'weight_kg', 'hr_max_bpm'][1 + o_orderkey % 3] AS metric, CAST(o_orderdate AS DATE) AS effective_from, max(o_totalprice) AS value
  FROM orders GROUP BY ALL),
f AS (SELECT *, lead(effective_from) OVER (PARTITION BY athlete_id, metric ORDER BY effective_from) - 1 AS effective_to FROM e),
a AS (SELECT o_orderkey AS activity_id, o_custkey % 200 AS athlete_id, CAST(o_orderdate AS DATE) + 40 AS day FROM orders)
SELECT activity_id, a.athlete_id, day, max(value) FILTER (metric = 'ftp_w') AS ftp_w, max(value) FILTER (metric = 'weight_kg') AS weight_kg, max(value) FILTER (metric = 'hr_max_bpm') AS hr_max_bpm
FROM a LEFT JOIN f ON f.athlete_id = a.athlete_id AND effective_from <= day AND (effective_to IS NULL OR day <= effective_to) GROUP BY 1, 2, 3""",
    "profile_upsert": """WITH p AS (
  SELECT o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS effective_from, max(o_totalprice) AS value, NULL::DATE AS effective_to FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
n AS (SELECT o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS effective_from, max(o_totalprice) AS value, NULL::DATE AS effective_to FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
u AS (SELECT *, false AS new FROM p UNION ALL SELECT *, true FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.athlete_id = n.athlete_id AND p.effective_from = n.effective_from))
SELECT athlete_id, effective_from, value, CASE WHEN lead(new) OVER w AND effective_to IS NULL THEN lead(effective_from) OVER w - 1 ELSE effective_to END AS effective_to
FROM u WINDOW w AS (PARTITION BY athlete_id ORDER BY effective_from)""",
    "leaderboard_filters": """SELECT l_orderkey, l_linenumber, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity >= 25 AND l_quantity < 35 AND 40 + l_suppkey % 60 >= 65 AND 40 + l_suppkey % 60 < 75 AND l_linenumber % 2 = 0 AND l_partkey % 7 IN (1, 3)
    AND CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-10-15') WHERE rank <= 100""",
    "climb_category": "SELECT p_partkey, p_size % 6 AS climb_category FROM part WHERE p_size % 6 BETWEEN 2 AND 4",
    "athlete_period_totals": f"""WITH o AS (SELECT c_nationkey, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, o_orderpriority AS sport FROM orders JOIN customer ON o_custkey = c_custkey),
p(period) AS (VALUES ('recent'), ('ytd'), ('all')),
k AS (SELECT DISTINCT c_nationkey, sport FROM o)
SELECT k.c_nationkey, k.sport, period, count(day) AS activities, CAST(coalesce(sum(cents), 0) AS BIGINT) AS distance
FROM k CROSS JOIN p LEFT JOIN o ON o.c_nationkey = k.c_nationkey AND o.sport = k.sport
  AND CASE period WHEN 'recent' THEN day > DATE '1998-06-30' - 28 AND day <= DATE '1998-06-30' WHEN 'ytd' THEN year(day) = 1998 AND day <= DATE '1998-06-30' ELSE true END
GROUP BY ALL""",
    "record_counts": "SELECT count(*) AS fetched, count(*) FILTER (lower(o_orderstatus) = 'f') AS matching, least(count(*) FILTER (lower(o_orderstatus) = 'f'), 50) AS returned FROM orders",
    "unit_conversions": f"""SELECT event_id, {rnd('value * 1000 / 1000.0::DOUBLE', 3)} AS km, {rnd('value * 1000 / 1609.344::DOUBLE', 3)} AS miles, {rnd('value * 3.28084::DOUBLE', 3)} AS feet, {rnd('value * 3.6::DOUBLE', 3)} AS kmh,
  printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS clock_of_day, CASE WHEN length(props) > 8 THEN left(props, 8) || '...' ELSE props END AS short,
  concat_ws(', ', event_type, CASE WHEN event_id % 3 <> 0 THEN props END) AS joined, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS id, substring(sha1(array_to_string(list_sort([event_type, 'heartrate']), ',')), 1, 8) AS types,
  CASE WHEN event_id % 4 = 0 THEN 'open' ELSE CAST(event_id % 4 AS VARCHAR) END AS source
FROM (SELECT *, CAST(floor(value * 1000) AS BIGINT) AS s FROM events)""",
    "photo_urls": """SELECT user_id, event_id, u.size, u.url FROM (
  SELECT user_id, event_id, unnest([{'size': '100', 'url': event_type || '/s'}, {'size': '600', 'url': event_type || '/l'}]) AS u FROM events)""",
    "route_gpx": """SELECT o_custkey, string_agg('<trkpt lat="' || printf('%.6f', (o_orderkey % 90)::DOUBLE) || '" lon="' || printf('%.6f', (o_orderkey % 180)::DOUBLE) || '"/>', '' ORDER BY o_orderkey) AS points FROM orders GROUP BY 1""",
}

SQL |= {
    "activity_by_id": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 100",
    "activity_details": f"""SELECT o_orderkey, {rnd('o_totalprice / 1000.0::DOUBLE', 2)} AS km, {rnd('o_totalprice / nullif(s, 0) * 3.6::DOUBLE', 1)} AS kmh,
  CASE WHEN o_orderstatus = 'F' AND s > 0 THEN printf('%d:%02d', p // 60, p % 60) END AS pace
FROM (SELECT *, CAST(floor(1000.0::DOUBLE / (o_totalprice / nullif(s, 0)) + 0.5::DOUBLE) AS BIGINT) AS p FROM (SELECT *, o_orderkey % 5000 AS s FROM orders))""",
    "segment_efforts": """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS TIMESTAMP) AS start FROM lineitem
WHERE CAST(l_shipdate AS TIMESTAMP) BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-03-15'""",
    "activity_laps": f"""WITH m AS (SELECT l_orderkey, l_linenumber, CAST(floor(sum(l_extendedprice) + 0.5) AS BIGINT) AS metres, sum(l_quantity) * 60 AS seconds FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(row_number() OVER w AS INTEGER) AS lap, {rnd('metres / 1000.0::DOUBLE', 2)} AS km, {rnd('metres::DOUBLE / nullif(seconds, 0) * 3.6::DOUBLE', 1)} AS kmh,
       {rnd('CAST(sum(metres) OVER w AS BIGINT) / 1000.0::DOUBLE', 2)} AS total_km
FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""",
    "athlete_zones": """SELECT c_custkey, CAST(z AS INTEGER) AS zone, CAST(CASE WHEN z = 1 THEN 0 ELSE c_custkey % 40 + 80 + 20 * z END AS INTEGER) AS lower,
       CAST(CASE WHEN z < 5 THEN c_custkey % 40 + 100 + 20 * z END AS INTEGER) AS upper FROM customer, range(1, 6) t(z)""",
    "athlete_shoes": f"""SELECT o_custkey, CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS items, 'shoe' || o_orderkey AS name, {rnd('o_totalprice / 1000.0::DOUBLE', 2)} AS km,
       o_orderstatus = 'F' AS primary FROM orders""".replace("AS primary", 'AS "primary"'),
    "starred_segments": f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {rnd('p_size * 137 / 1000.0::DOUBLE', 2)} ELSE {rnd('p_size * 137 / 1609.344::DOUBLE', 2)} END AS length,
       CASE WHEN p_partkey % 2 = 0 THEN 'km' ELSE 'mi' END AS unit FROM part WHERE p_partkey % 3 = 0""",
    "cell_store": f"""WITH {aligned('rides')}
SELECT activity_id, count(*) AS cells, count(*) FILTER (valid) AS valid_cells, CAST(sum(CAST(floor(watts * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS watts,
       CAST(CASE WHEN CAST(substr(activity_id, 2) AS BIGINT) % 4 = 2 THEN 1 ELSE 2 END AS INTEGER) AS fill
FROM al GROUP BY 1""",
    "cache_newest": f"{CACHE} SELECT o_orderkey, o_orderdate, o_totalprice FROM n WHERE place <= 200 AND total <= 20000000",
    "cache_bytes": f"{CACHE} SELECT o_orderkey, o_orderdate, o_totalprice FROM n WHERE total <= 134217728",
    "zone_problems": "SELECT c_custkey, 'own_power' AS set, 'not_contiguous' AS problem FROM customer WHERE c_custkey % 22 = 0",
    "time_in_own_zones": f"""WITH {aligned('weeks')}, {activities('weeks')},
cu AS (
  SELECT c_custkey AS k, (c_custkey // 2) % 60 AS athlete_id, CASE WHEN c_custkey % 2 = 0 THEN 'own_power' ELSE 'lthr' END AS set, DATE '2023-12-01' + CAST(c_custkey % 53 AS INT) AS f,
         (c_custkey % 50 + 89)::DOUBLE AS l, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 50 + 89 + c_custkey % 3 * 8)::DOUBLE END AS hm
  FROM customer WHERE c_custkey % 22 <> 0 QUALIFY row_number() OVER (PARTITION BY athlete_id, set, f ORDER BY c_custkey) = 1),
cw AS (SELECT *, lead(f) OVER (PARTITION BY athlete_id, set ORDER BY f) - 1 AS u FROM cu),
lo AS (
  SELECT *, unnest(range(0, 5)) AS j, CASE WHEN set = 'own_power' THEN [0, 10 + k % 7, 2 * (10 + k % 7), 3 * (10 + k % 7), 4 * (10 + k % 7)]::DOUBLE[]
    ELSE [0, floor(0.69::DOUBLE * l + 0.5), floor(0.84::DOUBLE * l + 0.5), floor(0.95::DOUBLE * l + 0.5), floor(1.05::DOUBLE * l + 0.5) + 1]::DOUBLE[] END AS b
  FROM cw),
zo AS (
  SELECT athlete_id, set, f, u, CAST(j + 1 AS INT) AS zone, CASE WHEN set = 'own_power' THEN 'P' || j ELSE 'Z' || (j + 1) END AS name, b[j + 1] AS lower,
         CASE WHEN j < 4 THEN b[j + 2] WHEN set = 'lthr' AND hm >= b[5] THEN floor(hm + 0.5::DOUBLE) + 1 END AS upper
  FROM lo),
az AS (SELECT activity_id, zo.* FROM act JOIN zo ON zo.athlete_id = act.athlete_id AND day >= f AND (u IS NULL OR day <= u)),
v AS (SELECT activity_id, 'own_power' AS set, watts AS v, has_watts AS has FROM al WHERE valid UNION ALL SELECT activity_id, 'lthr', heartrate, has_heartrate FROM al WHERE valid),
tv AS (SELECT activity_id, set, count(*) AS n, bool_or(has) AS has FROM v GROUP BY 1, 2),
hit AS (SELECT activity_id, set, zone, count(*) AS n FROM v JOIN az USING (activity_id, set) WHERE has AND v >= lower AND (upper IS NULL OR v < upper) GROUP BY 1, 2, 3),
ct AS (SELECT activity_id, set, CAST(sum(n) AS BIGINT) AS c FROM hit GROUP BY 1, 2)
SELECT az.activity_id, az.set, az.zone, name, lower, upper, CASE WHEN has THEN coalesce(hit.n, 0) END AS seconds,
       CASE WHEN has THEN coalesce({rnd('hit.n::DOUBLE / c * 100', 2)}, 0) END AS percent, CASE WHEN has THEN tv.n - coalesce(c, 0) END AS unclassified_seconds
FROM az JOIN tv USING (activity_id, set) LEFT JOIN hit ON hit.activity_id = az.activity_id AND hit.set = az.set AND hit.zone = az.zone LEFT JOIN ct ON ct.activity_id = az.activity_id AND ct.set = az.set""",
    "span_slices": f"""WITH {aligned('weeks')},
sp AS (SELECT {KEYS['weeks']} AS activity_id, event_id, event_id * 37 % 900 - 20 AS lo, event_id * 37 % 900 - 20 + event_id % 90 - 5 AS hi FROM events)
SELECT event_id, count(*) AS cells, count(*) FILTER (valid) AS valid_cells, max(i - greatest(lo, 0)) AS last_i, CAST(sum(CAST(floor(watts * 100 + 0.5::DOUBLE) AS BIGINT)) FILTER (valid) AS BIGINT) AS watts
FROM sp JOIN al ON al.activity_id = sp.activity_id AND i BETWEEN lo AND hi GROUP BY 1""",
    "sanitize_envelopes": f"""WITH x AS (
  SELECT event_id, value AS v, event_id % 13 <> 0 AS m, {', '.join(f"CASE event_id % {n} WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' END AS o{n}" for n in (5, 7, 11, 17))} FROM events)
SELECT event_id, CASE WHEN m AND o11 IS NULL THEN v END AS np, CASE WHEN m AND o5 IS NULL THEN v END AS c0, CASE WHEN m THEN v END AS c1, CASE WHEN m AND o7 IS NULL THEN v * 2 END AS c2,
       CASE WHEN o17 IS NULL THEN v END AS z1, 0::DOUBLE AS z2,
       concat_ws('; ', CASE WHEN m THEN 'metrics.np: ' || o11 END, CASE WHEN m THEN 'metrics.power.curve[0]: ' || o5 END, CASE WHEN m THEN 'metrics.power.curve[2]: ' || o7 END, 'zones.z1: ' || o17) AS changed
FROM x""",
    "athlete_routes": f"""WITH r AS (
  SELECT o_orderkey AS route_id, o_custkey AS athlete_id, o_totalprice AS m, o_orderkey % 4 AS type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place,
         CAST(ceil(count(*) OVER (PARTITION BY o_custkey) / 3.0::DOUBLE) AS INT) AS pages FROM orders)
SELECT route_id, athlete_id, CAST(place AS INT) AS place, pages, {rnd('m / 1000.0::DOUBLE', 1)} AS km, {rnd('m / 37', 0)} AS gain_m, CASE type WHEN 1 THEN 'Ride' WHEN 2 THEN 'Run' ELSE 'Other' END AS kind,
       (SELECT nullif(count(*), 0) FROM lineitem WHERE l_orderkey = route_id) AS segment_count FROM r WHERE place BETWEEN 4 AND 6""",
    "athlete_clubs": """WITH m AS (SELECT c_nationkey, count(*) AS members, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS sports FROM customer GROUP BY 1)
SELECT n_nationkey AS club_id, n_name AS name, sports, members, concat_ws(', ', CASE WHEN n_nationkey % 3 <> 0 THEN 'c' || n_nationkey END, r_name) AS location, n_nationkey % 2 = 0 AS private
FROM nation JOIN region ON r_regionkey = n_regionkey JOIN m ON c_nationkey = n_nationkey""",
    "parameter_sources": """WITH o AS (SELECT o_orderkey AS k, o_custkey % 300 AS athlete_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders),
e0 AS (SELECT athlete_id, day AS f, arg_max(price, k) AS value, max(k) AS k FROM o WHERE k % 2 = 0 GROUP BY 1, 2),
e AS (SELECT *, least(lead(f) OVER (PARTITION BY athlete_id ORDER BY f) - 1, f + 60) AS u, CASE k % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'estimated_20min' ELSE 'estimated_hr20min' END AS source FROM e0),
j AS (
  SELECT o.k, o.athlete_id, day, CASE WHEN o.k % 5 = 0 THEN price + 1 END AS asked, e.value, e.source, f
  FROM o LEFT JOIN e ON e.athlete_id = o.athlete_id AND day BETWEEN f AND u WHERE o.k % 2 = 1)
SELECT k, athlete_id, day, coalesce(asked, value) AS value, CASE WHEN asked IS NOT NULL THEN 'override' ELSE source END AS source, CASE WHEN asked IS NULL THEN f END AS effective_from,
       asked IS NULL AND coalesce(source = 'estimated_20min', false) AS estimated, CASE WHEN asked IS NOT NULL THEN 'override' WHEN value IS NOT NULL THEN 'profile' ELSE 'missing_parameter' END AS status FROM j""",
}
