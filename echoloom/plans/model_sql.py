"""SQL of the tracker, of densities with their peaks, and of the mixture: recursive steps over lists."""

from __future__ import annotations

from ..operators.mixtures import LEVELS, POINTS
from ..operators.species import label_sql
from ..schema import MixtureConfig, SplitConfig, TrackingConfig
from .events_view import with_steps


def _recursive(select: str, more: dict[str, str]) -> str:
    return with_steps(select, more=more).replace("WITH ", "WITH RECURSIVE ", 1)


def _passages(gap: int, echo: int) -> dict[str, str]:
    """The steps of `clean` with other gaps, where the best signal of a chain of echoes stays."""
    return {
        "ses": f"SELECT *, CAST(sum(CASE WHEN gap_ms IS NULL OR gap_ms >= {gap} THEN 1 ELSE 0 END) OVER (ORDER BY time_ms, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passage_id FROM gaps",
        "lnk": f"SELECT *, coalesce(gap_ms <= {echo} AND delta_fme_bins <= 1, FALSE) AS link FROM ses",
        "ech": "SELECT * FROM best",
        "ses2": f"SELECT *, CAST(sum(CASE WHEN gap_ms2 IS NULL OR gap_ms2 >= {gap} THEN 1 ELSE 0 END) OVER (ORDER BY time_ms, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passage_id2 FROM noe",
    }


def tracker_sql(select: str, gap: int, echo: int, split: SplitConfig = SplitConfig(), tracking: TrackingConfig = TrackingConfig()) -> str:
    """A query over `trk` (tracks), `own` (calls with their tracks) and `clean`.

    A passage that the mixture would have to split is an error: these statements follow passages of one packet.
    """
    c = tracking
    ici = f"coalesce(list_median(k.icis), {c.bootstrap_ici_ms}::DOUBLE)"
    allowed = f"greatest(1.0::DOUBLE, {ici} * {c.ici_tolerance}::DOUBLE)"
    late, away = f"abs(t - k.last - {ici})", "abs(b - list_median(k.bins))"
    steps = _passages(gap, echo) | {
        "seq": f"""SELECT CASE WHEN count(*) OVER p >= {split.min_chirps} AND min(fme_khz) OVER p < max(fme_khz) OVER p THEN CAST(error('a passage to split') AS BIGINT) ELSE passage_id2 END AS passage_id, line_no, time_ms, fme_khz,
            CAST(time_ms AS DOUBLE) AS t, CAST(pos_fme AS DOUBLE) AS b, row_number() OVER (PARTITION BY passage_id2 ORDER BY time_ms, line_no) AS n FROM clean WINDOW p AS (PARTITION BY passage_id2)""",
        "walk": f"""SELECT passage_id, n, line_no, time_ms, fme_khz, 0::BIGINT AS open_ord, 1::BIGINT AS opened, []::BIGINT[] AS gone, [{{'no': 0::BIGINT, 'last': t, 'icis': []::DOUBLE[], 'bins': [b]}}] AS open FROM seq WHERE n = 1
            UNION ALL
            SELECT passage_id, n, line_no, time_ms, fme_khz, mine, greatest(opened, mine + 1), gone,
                list_concat(list_transform(still, lambda k: CASE WHEN k.no = mine THEN {{'no': k.no, 'last': t, 'icis': list_append(k.icis, t - k.last), 'bins': list_append(k.bins, b)}} ELSE k END),
                    CASE WHEN mine = opened THEN [{{'no': mine, 'last': t, 'icis': []::DOUBLE[], 'bins': [b]}}] ELSE [] END)
            FROM (SELECT *, coalesce(list_sort(list_transform(list_filter(still, lambda k: t > k.last AND {late} <= {allowed} AND {away} <= {c.fme_tolerance_bins}),
                    lambda k: {{'score': {late} / {allowed} + {away} / {max(1.0, c.fme_tolerance_bins)}::DOUBLE, 'no': k.no}}))[1].no, opened) AS mine
                FROM (SELECT s.*, opened, list_filter(open, lambda k: t - k.last <= {c.expiry_icis} * {ici}) AS still, list_transform(list_filter(open, lambda k: t - k.last > {c.expiry_icis} * {ici}), lambda k: k.no) AS gone
                    FROM walk w JOIN seq s ON s.passage_id = w.passage_id AND s.n = w.n + 1))""",
        "own": "SELECT passage_id, open_ord, line_no, time_ms, fme_khz, time_ms - lag(time_ms) OVER (PARTITION BY passage_id, open_ord ORDER BY n) AS ici_ms FROM walk",
        "shut": "SELECT passage_id, unnest(gone) AS open_ord, n AS closed FROM walk",
        "base": f"SELECT passage_id, count(DISTINCT open_ord) AS opened, count(*) AS n, median(fme_khz) AS fme_khz, {label_sql('median(fme_khz)')} AS species FROM own GROUP BY passage_id",
        "offs": "SELECT *, coalesce(sum(opened) OVER (ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM base",
        "all_": """SELECT passage_id, open_ord, min(time_ms) AS start_time_ms, max(time_ms) AS end_time_ms, CAST(count(*) AS INT) AS n_chirps, median(own.fme_khz) AS fme_median_khz, median(CAST(ici_ms AS DOUBLE)) AS ici_median_ms FROM own GROUP BY ALL""",
        "trk": f"""SELECT concat('track-', lpad(CAST(earlier + open_ord + 1 AS VARCHAR), greatest(4, length(CAST(earlier + open_ord + 1 AS VARCHAR)))::INT, '0')) AS track_id, passage_id, concat(passage_id, ':0') AS packet_id, species AS passage_species,
            start_time_ms, end_time_ms, n_chirps, fme_median_khz, ici_median_ms, coalesce(ici_median_ms < {c.suspicious_ici_ms}, FALSE) AS suspicious_short_ici, 0::BIGINT AS packet, open_ord, close_ord
            FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY closed NULLS LAST, open_ord) - 1 AS close_ord FROM all_ LEFT JOIN shut USING (passage_id, open_ord)) JOIN offs USING (passage_id) WHERE n_chirps >= {c.min_chirps}""",
    }
    return _recursive(select, steps)


def _sums(value: str, k: str = "k") -> str:
    """The sum over all values of the histogram (places i of xs and ns) of an expression that may name a component k."""
    return f"list_sum(list_transform(range(1, len(xs) + 1), lambda i: {value}))"


def density_sql(select: str, configs: list[MixtureConfig]) -> str:
    """A query over `peak` (config, i, x: peaks in order), `grd` (config, i, x, y), `cfg` and, of config 0, the mixture `mix` (m, s, w)
    and its thresholds `thr` (level, j, spot).

    Configurations are of one flavor, canonical ones with scott's or silverman's rule, web ones with scott's, at a distance of one bandwidth.
    """
    web = configs[0].flavor == "web"
    rows = ", ".join(f"({n}, {1.0 if c.bandwidth == 'scott' else 0.75}::DOUBLE, {c.scale}::DOUBLE, {c.prominence}::DOUBLE)" for n, c in enumerate(configs))
    grid, most = configs[0].grid, configs[0].max_components
    place = "list_transform(xs, lambda x: list_position(list_transform(c, lambda m: abs(x - m)), list_min(list_transform(c, lambda m: abs(x - m)))))"
    per = lambda value: f"list_transform(range(1, len(c) + 1), lambda k: {value})"
    mine = "CASE WHEN own[i] = k THEN ns[i] ELSE 0 END"
    eps = "2.220446049250313e-15::DOUBLE"
    moved_squares = _sums("share[i][k] * pow(xs[i] - new[k], 2)")
    first_squares = _sums(f"({mine}) * pow(xs[i] - mid[k], 2)")
    own_start = f"""SELECT 0 AS step, c, {per(f"{first_squares} / mass[k] + 1e-6::DOUBLE")} AS v, {per('mass[k] / total')} AS w, '-infinity'::DOUBLE AS before, FALSE AS done FROM mid0"""
    web_start = f"""SELECT 0 AS step, c, {per('pow(greatest(sqrt(greatest(sd * sd, 0.05::DOUBLE)) / sqrt(len(c)), 0.15::DOUBLE), 2)')} AS v, {per('1.0::DOUBLE / len(c)')} AS w, '-infinity'::DOUBLE AS before, FALSE AS done FROM (SELECT peaks AS c, sd FROM data, sprd)"""
    thin = """SELECT config, list({'y': y, 'i': i} ORDER BY y DESC, i DESC) AS rest, []::STRUCT(y DOUBLE, i BIGINT)[] AS kept, any_value(greatest(1, round_even(width / step, 0))) AS far FROM @ JOIN cfg USING (config) GROUP BY config
            UNION ALL SELECT config, list_filter(rest[2:], lambda k: abs(k.i - rest[1].i) >= far), list_append(kept, rest[1]), far FROM thin WHERE len(rest) > 0"""
    chosen = {
        "tops": "SELECT config, i, x, y, coalesce(lag(i) OVER o, 0) AS a, coalesce(lead(i) OVER o, last) AS b FROM (SELECT *, lag(y) OVER o AS low, lead(y) OVER o AS high, max(i) OVER (PARTITION BY config) AS last FROM grd WINDOW o AS (PARTITION BY config ORDER BY i)) WHERE y > low AND y >= high WINDOW o AS (PARTITION BY config ORDER BY i)",
        "prom": "SELECT t.config, t.i, t.y, (SELECT max(y) FROM grd WHERE config = t.config) AS top, t.y - greatest(min(g.y) FILTER (g.i BETWEEN t.a AND t.i), min(g.y) FILTER (g.i BETWEEN t.i AND t.b)) AS rise FROM tops t JOIN grd g ON g.config = t.config GROUP BY t.config, t.i, t.y",
        "good": "SELECT config, i, y FROM prom JOIN cfg USING (config) WHERE rise >= top * prominence",
        "thin": thin.replace("@", "good"),
        "left_": "SELECT config, i, y FROM (SELECT config, unnest(kept).i AS i FROM thin WHERE len(rest) = 0) JOIN good USING (config, i)",
        "any_": "SELECT * FROM left_ UNION ALL SELECT config, arg_max(i, y), max(y) FROM grd WHERE config NOT IN (SELECT config FROM left_) GROUP BY config",
    } if web else {
        "tops": "SELECT * FROM (SELECT *, lag(y) OVER o AS low, lead(y) OVER o AS high FROM grd WINDOW o AS (PARTITION BY config ORDER BY i)) WHERE y > low AND y > high",
        "thin": thin.replace("@", "tops"),
        "left_": "SELECT config, unnest(kept).i AS i FROM thin WHERE len(rest) = 0",
        "high": """SELECT p.config, p.i, p.y, coalesce(max(g.i) FILTER (g.i < p.i AND g.y > p.y), 0) AS a, coalesce(min(g.i) FILTER (g.i > p.i AND g.y > p.y), max(g.i)) AS b, max(g.y) AS top
            FROM (SELECT config, i, x, y FROM grd JOIN left_ USING (config, i)) p JOIN grd g ON g.config = p.config GROUP BY ALL""",
        "prom": "SELECT h.config, h.i, h.y, h.top, h.y - greatest(min(g.y) FILTER (g.i BETWEEN h.a AND h.i), min(g.y) FILTER (g.i BETWEEN h.i AND h.b)) AS rise FROM high h JOIN grd g ON g.config = h.config GROUP BY h.config, h.i, h.y, h.top",
        "good": "SELECT config, i, y FROM prom JOIN cfg USING (config) WHERE rise >= top * prominence",
        "any_": "SELECT * FROM good UNION ALL SELECT config, arg_max(i, y), max(y) FROM grd WHERE config NOT IN (SELECT config FROM good) GROUP BY config",
    }
    steps = {
        "hst": "SELECT fme_khz AS v, CAST(count(*) AS DOUBLE) AS n FROM clean GROUP BY fme_khz",
        "mean": "SELECT sum(n) AS total, sum(n * v) / sum(n) AS mean, min(v) AS lo, max(v) AS hi FROM hst",
        "sprd": "SELECT total, lo, hi, sqrt(sum(n * (v - mean) * (v - mean)) / (total - 1)) AS sd FROM hst, mean GROUP BY total, lo, hi",
        "cfg": f"""SELECT *, {'greatest(0.05::DOUBLE, greatest(sd, sqrt(1e-9::DOUBLE)) * pow(total, -0.2::DOUBLE) * scale)' if web else 'pow(total * factor, -0.2::DOUBLE) * scale * sd'} AS width, lo - pad AS a, (hi + pad - (lo - pad)) / {grid - 1} AS step
            FROM (SELECT *, greatest(0.5::DOUBLE, (hi - lo) * 0.02::DOUBLE) AS pad FROM sprd, (VALUES {rows}) AS t(config, factor, scale, prominence))""",
        "grd": f"SELECT config, i, any_value(a + i * step) AS x, sum(n * exp(-0.5 * pow((a + i * step - v) / width, 2))) / any_value(total * width * sqrt(2 * pi())) AS y FROM cfg, (SELECT range AS i FROM range({grid})), hst GROUP BY config, i",
        **chosen,
        "peak": f"SELECT config, i, a + i * step AS x, row_number() OVER (PARTITION BY config ORDER BY i) AS place, count(*) OVER (PARTITION BY config) AS k FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY {'i' if web else 'y DESC, i DESC'}) AS r FROM any_) JOIN cfg USING (config) WHERE r <= {most}",
        "data": "SELECT list(v ORDER BY v) AS xs, list(n ORDER BY v) AS ns, sum(n) AS total, (SELECT list(x ORDER BY x) FROM peak WHERE config = 0) AS peaks FROM hst",
        "kmn": f"""SELECT 0 AS step, peaks AS c, []::INT[] AS own, FALSE AS done FROM data
            UNION ALL
            SELECT step + 1, CASE WHEN near THEN c ELSE moved END, own, near FROM (SELECT *, list_bool_and({per('abs(moved[k] - c[k]) <= 1e-10::DOUBLE + 1e-5::DOUBLE * abs(c[k])')}) AS near
                FROM (SELECT step, c, own, {per(f"CASE WHEN {_sums(mine)} > 0 THEN {_sums(f'({mine}) * xs[i]')} / {_sums(mine)} ELSE c[k] END")} AS moved
                    FROM (SELECT step, c, {place} AS own, xs, ns FROM kmn, data WHERE NOT done AND step < 100)))""",
        "hard": "SELECT peaks AS c, xs, ns, total, (SELECT own FROM kmn ORDER BY step DESC LIMIT 1) AS own FROM data",
        "mass0": f"SELECT *, {per(f'{_sums(mine)} + {eps}')} AS mass FROM hard",
        "mid0": f"SELECT *, {per(f'{_sums(f'({mine}) * xs[i]')} / mass[k]')} AS mid FROM mass0",
        "em": f"""{web_start if web else own_start}
            UNION ALL
            SELECT step + 1, new, {per(f"greatest({moved_squares} / mass[k], 0.0025::DOUBLE)" if web else f"{moved_squares} / mass[k] + 1e-6::DOUBLE")}, {per('mass[k] / total')}, now, {'abs(now - before) < 1e-5::DOUBLE * greatest(1, abs(now))' if web else 'abs(now - before) < 1e-3::DOUBLE * total'}
            FROM (SELECT *, {per(f"CASE WHEN {_sums('share[i][k]')} < 1e-6 THEN c[k] ELSE {_sums('share[i][k] * xs[i]')} / mass[k] END" if web else f"{_sums('share[i][k] * xs[i]')} / mass[k]")} AS new FROM (SELECT *, {per(f"greatest({_sums('share[i][k]')}, 1e-6::DOUBLE)" if web else f"{_sums('share[i][k]')} + {eps}")} AS mass
                FROM (SELECT *, {_sums('ns[i] * each[i]')} AS now, list_transform(range(1, len(xs) + 1), lambda i: {per('exp(logs[i][k] - each[i]) * ns[i]')}) AS share
                FROM (SELECT *, list_transform(logs, lambda l: list_max(l) + ln(list_sum(list_transform(l, lambda z: exp(z - list_max(l)))))) AS each
                FROM (SELECT em.*, xs, ns, total, list_transform(xs, lambda x: {per('ln(w[k]) - 0.5 * ln(2 * pi() * v[k]) - 0.5 * pow(x - c[k], 2) / v[k]')}) AS logs FROM em, data WHERE NOT done AND step < {120 if web else 100})))))""",
        "mix": "SELECT m, sqrt(v) AS s, w, row_number() OVER (ORDER BY m) AS component FROM (SELECT unnest(c) AS m, unnest(v) AS v, unnest(w) AS w FROM (SELECT * FROM em ORDER BY step DESC LIMIT 1))",
        "prt": "SELECT list({'m': m, 's': s, 'w': w} ORDER BY component) AS parts FROM mix",
        "thr": f"""SELECT 0 AS level, component AS j, m AS a, b, NULL::DOUBLE AS spot FROM (SELECT *, lead(m) OVER (ORDER BY component) AS b FROM mix) WHERE b IS NOT NULL
            UNION ALL
            SELECT level + 1, j, a + (b - a) * greatest(0, i - 1) / {POINTS - 1}, a + (b - a) * least({POINTS - 1}, i + 1) / {POINTS - 1}, a + (b - a) * i / {POINTS - 1} FROM (SELECT *, list_position(ys, list_min(ys)) - 1 AS i
                FROM (SELECT thr.*, list_transform(range({POINTS}), lambda i: list_sum(list_transform(parts, lambda c: c.w * exp(-0.5 * pow((a + (b - a) * i / {POINTS - 1} - c.m) / c.s, 2)) / c.s))) AS ys FROM thr, prt WHERE level < {1 if web else LEVELS}))""",
    }
    return _recursive(select, steps)
