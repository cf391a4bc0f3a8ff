"""SQL for whole rule catalogues, from the definition of a range: every sample meets every grid point that can see it.

It shares nothing with the operators but the rules themselves. A table of samples ``smp`` (metric, lab, ts, value) is
expected, lab the text of label=value in order of the labels, and ``hours``, the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from tidewatch.operators.recording import Alert, Operand, Rule

STEP = 3600


def _div(x: str, y: str) -> str:
    return f"CASE WHEN {y} = 0 AND {x} = 0 THEN 'NaN'::DOUBLE WHEN {y} = 0 THEN sign({x}) * 'Infinity'::DOUBLE ELSE {x} / {y} END"


_DIV = _div("a", "b")
_OPS = {
    "a": "a", "a/b": _DIV, "a-b": "a - b", "1-a/b": f"1 - ({_DIV})", "a/(a+b)": _div("a", "(a + b)"),
    "a/k": "a / k", "1-a": "1 - a", "(1-a)/(1-k)": "(1 - a) / (1 - k)", "(a-t)/86400": "(a - epoch(t)) / 86400.0",
    "a is k": "CASE WHEN a IS NOT NULL THEN CASE WHEN a = k THEN 1.0 ELSE 0.0 END END", "a<k": "CASE WHEN a IS NOT NULL THEN CASE WHEN a < k THEN 1.0 ELSE 0.0 END END",
    "worst": "greatest(coalesce(b, 0) * 1, coalesce(c, 0) * 2, 0)",
    "a is k and b is 1 and c is 0": "CASE WHEN coalesce(a, 0) = k AND coalesce(b, 0) = 1 AND coalesce(c, 0) = 0 THEN 1.0 ELSE 0.0 END",
    "a/b<k": f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN ({_DIV}) < k THEN 1.0 ELSE 0.0 END END",
    "1-(1-a)/(1-k)": "1 - (1 - a) / (1 - k)", "a and b": "CASE WHEN b IS NOT NULL THEN a END", "a<b*k": "CASE WHEN a < b * k THEN a END", "quantile": "a",
}
_FNS = """CASE fn WHEN 'instant' THEN last WHEN 'avg' THEN mean WHEN 'rate' THEN CASE WHEN n >= 2 AND lts > fts THEN inc / ((epoch_us(lts) - epoch_us(fts)) / 1e6) END
    WHEN 'increase' THEN CASE WHEN n >= 2 THEN inc END WHEN 'delta' THEN CASE WHEN n >= 2 THEN last - first END WHEN 'changes' THEN chg
    WHEN 'irate' THEN CASE WHEN lpts > w.t - to_seconds(w.seconds) AND lts > lpts THEN CASE WHEN last >= lpv THEN last - lpv ELSE last END / ((epoch_us(lts) - epoch_us(lpts)) / 1e6) END
    WHEN 'predict' THEN CASE WHEN n >= 2 THEN intercept + slope * horizon END WHEN 'deriv' THEN CASE WHEN n >= 2 THEN slope END END"""


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_text, xs)) + "]::VARCHAR[]"


def _span(o: Operand, names: set[str]) -> int:
    return STEP if o.metric in names and o.fn == "instant" else -(-o.seconds // STEP) * STEP


def _level(tag: str, rules: Sequence[Rule], names: set[str], before: Sequence[str]) -> str:
    """CTEs that end in rec_<tag> (t, name, lab, value): the rules over samples and the levels before."""
    reads = [r for r in rules if r.operands]
    needs = sorted({(o.metric, _span(o, names)) for r in reads for o in r.operands})
    metrics = ", ".join(_text(x) for x in sorted({x for x, _ in needs}))
    union = " UNION ALL ".join([f"SELECT metric, lab, ts, value FROM smp WHERE metric IN ({metrics})"] + [f"SELECT name, lab, t, value FROM rec_{b} WHERE name IN ({metrics})" for b in before])
    ops = ",\n  ".join(
        f"({_text(r.name)}, {_text(r.op)}, {float(r.k)!r}::DOUBLE, {slot}, {_text(o.fn)}, {_span(o, names)}, {o.horizon}, {_text(o.metric)}, {_list(f'{k}={v}' for k, v in o.match)}, "
        f"{_text(o.like[0][0] + '=(?:' + o.like[0][1] + ')') if o.like else 'NULL'}, {_text(o.where[0]) if o.where else 'NULL'}, {float(o.where[1]) if o.where else 'NULL'}, {_text(o.agg)}, {_list(o.by)}, {o.back})"
        for r in reads for slot, o in enumerate(r.operands))
    side = lambda i: f"""CASE max(agg) FILTER (slot = {i}) WHEN 'sum' THEN sum(v) FILTER (slot = {i}) WHEN 'avg' THEN avg(v) FILTER (slot = {i})
      WHEN 'count' THEN count(v) FILTER (slot = {i}) WHEN 'min' THEN min(v) FILTER (slot = {i}) ELSE max(v) FILTER (slot = {i}) END"""  # noqa: E731
    used = sorted({r.op for r in reads})
    sql = f"""
src_{tag} AS MATERIALIZED (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pts FROM ({union}) u WINDOW w AS (PARTITION BY metric, lab ORDER BY ts)),
need_{tag}(metric, seconds) AS (VALUES {", ".join(f"({_text(k)}, {n})" for k, n in needs)}),
win_{tag} AS (SELECT metric, lab, seconds, t, count(*) AS n, max_by(value, ts) AS last, max(ts) AS lts, min(ts) AS fts, min_by(value, ts) AS first, max_by(pv, ts) AS lpv, max_by(pts, ts) AS lpts, avg(value) AS mean,
    sum(CASE WHEN pts > t - to_seconds(seconds) THEN CASE WHEN value >= pv THEN value - pv ELSE value END ELSE 0 END) AS inc, sum(CASE WHEN pts > t - to_seconds(seconds) AND value <> pv THEN 1 ELSE 0 END) AS chg,
    regr_slope(value, epoch(ts) - epoch(t)) AS slope, regr_intercept(value, epoch(ts) - epoch(t)) AS intercept
  FROM (SELECT s.*, k.seconds, unnest(generate_series(date_trunc('hour', ts + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND), ts + to_seconds(k.seconds) - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS t
    FROM src_{tag} s JOIN need_{tag} k USING (metric)) x GROUP BY 1, 2, 3, 4),
ops_{tag}(name, op, k, slot, fn, seconds, horizon, metric, eq, pat, cmp, cmpk, agg, keep, back) AS (VALUES {ops}),
ser_{tag} AS (SELECT metric, lab AS own, CASE WHEN lab = '' THEN []::VARCHAR[] ELSE string_split(lab, ',') END AS labs FROM (SELECT DISTINCT metric, lab FROM src_{tag}) d),
tgt_{tag} AS MATERIALIZED (SELECT o.*, own, CASE WHEN agg IS NULL THEN own ELSE array_to_string(list_filter(labs, lambda x: list_contains(keep, split_part(x, '=', 1))), ',') END AS lab
  FROM ser_{tag} s JOIN ops_{tag} o USING (metric) WHERE list_has_all(labs, eq) AND (pat IS NULL OR len(list_filter(labs, lambda x: regexp_full_match(x, pat))) > 0)),
val_{tag} AS (SELECT * FROM (SELECT o.name, o.op, o.k, o.slot, o.agg, o.cmp, o.cmpk, w.t + to_seconds(o.back) AS t, o.lab, CAST({_FNS} AS DOUBLE) AS v
  FROM win_{tag} w JOIN tgt_{tag} o ON o.metric = w.metric AND o.seconds = w.seconds AND o.own = w.lab) q
  WHERE v IS NOT NULL AND (cmp IS NULL OR CASE cmp WHEN '==' THEN v = cmpk WHEN '>' THEN v > cmpk WHEN '<' THEN v < cmpk WHEN '!=' THEN v <> cmpk END)),
abc_{tag} AS (SELECT name, op, k, t, lab, {side(0)} AS a, {side(1)} AS b, {side(2)} AS c FROM val_{tag} GROUP BY 1, 2, 3, 4, 5),
out_{tag} AS MATERIALIZED (SELECT * FROM (SELECT t, name, op, k, lab, CAST(CASE op {" ".join(f"WHEN {_text(op)} THEN {_OPS[op]}" for op in used)} END AS DOUBLE) AS value FROM abc_{tag}) q WHERE value IS NOT NULL),
le_{tag} AS (SELECT t, name, k, regexp_replace(regexp_replace(lab, '(^|,)le=[^,]*', ''), '^,', '') AS lab, CASE regexp_extract(lab, '(?:^|,)le=([^,]*)', 1) WHEN '+Inf' THEN 'Infinity'::DOUBLE ELSE TRY_CAST(regexp_extract(lab, '(?:^|,)le=([^,]*)', 1) AS DOUBLE) END AS le, value
  FROM out_{tag} WHERE op = 'quantile'),
cum_{tag} AS (SELECT *, max(CASE WHEN isinf(le) THEN value END) OVER (PARTITION BY t, name, lab) * k AS rank, lag(le) OVER w AS lo, coalesce(lag(value) OVER w, 0) AS below FROM le_{tag} WINDOW w AS (PARTITION BY t, name, lab ORDER BY le)),
rec_{tag} AS MATERIALIZED (SELECT t, name, lab, value FROM out_{tag} WHERE op <> 'quantile'
  UNION ALL SELECT t, name, lab, CASE WHEN isinf(le) THEN lo WHEN value > below THEN coalesce(lo, CASE WHEN le > 0 THEN 0 ELSE le END) + (le - coalesce(lo, CASE WHEN le > 0 THEN 0 ELSE le END)) * (rank - below) / (value - below) ELSE coalesce(lo, CASE WHEN le > 0 THEN 0 ELSE le END) END
    FROM cum_{tag} WHERE rank > 0 AND value >= rank AND (lo IS NULL OR below < rank)"""
    fixed = [r for r in rules if r.op == "const"]
    if fixed:
        sql += f"\n  UNION ALL SELECT t, c.name, '', c.k FROM hours CROSS JOIN (VALUES {', '.join(f'({_text(r.name)}, {float(r.k)!r}::DOUBLE)' for r in fixed)}) AS c(name, k)"
    filled = [r.name for r in reads if r.op in ("a<k", "a/b<k")]
    if filled:
        sql += f"\n  UNION ALL SELECT t, z.name, '', 0.0 FROM hours CROSS JOIN (VALUES {', '.join(f'({_text(x)})' for x in filled)}) AS z(name) ANTI JOIN (SELECT t, name FROM out_{tag} WHERE lab = '') o USING (t, name)"
    return sql + ")"


def levels(rules: Sequence[Rule]) -> list[list[Rule]]:
    by_name = {r.name: r for r in rules}
    depth: dict[str, int] = {}

    def of(name: str) -> int:
        if name not in depth:
            depth[name] = max([1 + of(o.metric) for o in by_name[name].operands if o.metric in by_name], default=0)
        return depth[name]

    out: list[list[Rule]] = []
    for r in rules:
        while len(out) <= of(r.name):
            out.append([])
        out[of(r.name)].append(r)
    return out


def recorded_sql(rules: Sequence[Rule]) -> tuple[str, list[str]]:
    """The CTEs of all levels, whose values are in rec_<tag> (t, name, lab, value), and their tags."""
    names = {r.name for r in rules}
    parts, tags = [], []
    for n, here in enumerate(levels(rules)):
        parts.append(_level(f"l{n}", here, names, tags))
        tags.append(f"l{n}")
    return ",".join(parts), tags


def all_of(tags: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT t, name, lab, value FROM rec_{x}" for x in tags)


def breaches_sql(rules: Sequence[Rule], alerts: Sequence[Alert]) -> str:
    """CTEs that end in breaches (t, alertname, lab, value)."""
    names = {r.name for r in rules}
    base, tags = recorded_sql(rules)
    plain = [Rule(a.name, a.rule.op, a.rule.operands, a.rule.k) for a in alerts if a.rule.op != "absent"]
    limits = [f"({_text(a.name)}, {_text(a.compare[0])}, {float(a.compare[1])!r}::DOUBLE)" for a in alerts if a.compare and a.rule.op != "absent"]
    gone = "".join(
        f"\n  UNION ALL SELECT t, {_text(a.name)}, '', 1.0 FROM hours ANTI JOIN (SELECT DISTINCT unnest(generate_series(date_trunc('hour', ts + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND), ts + to_seconds({a.rule.operands[0].seconds}) - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS t FROM smp WHERE metric = {_text(a.rule.operands[0].metric)}) o USING (t)"
        for a in alerts if a.rule.op == "absent")
    return f"""{base},{_level("alerts", plain, names, tags)},
limits(name, cmp, lim) AS (VALUES {", ".join(limits)}),
breaches AS (SELECT t, r.name AS alertname, lab, value FROM rec_alerts r LEFT JOIN limits l USING (name)
  WHERE l.cmp IS NULL OR CASE l.cmp WHEN '==' THEN value = lim WHEN '>' THEN value > lim WHEN '<' THEN value < lim WHEN '!=' THEN value <> lim END{gone})"""
