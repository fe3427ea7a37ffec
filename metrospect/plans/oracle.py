"""Check SQL: the same results from the same tables, for DuckDB."""

from __future__ import annotations

import itertools

from metrospect import constants as K
from metrospect.plans.queries import DIGITS

METRICS = K.METRICS
PAIRS = list(itertools.combinations(METRICS, 2))


def rnd(expression: str, digits: int, name: str) -> str:
    return f"round(({expression})::double, {digits}) AS {name}"


def by_metric(expression: str, name: str) -> str:
    """Round to the digits that fit the metric of the row."""
    arms = " ".join(
        f"WHEN '{m}' THEN round(({expression})::double, {d})" for m, d in DIGITS.items()
    )
    return f"CASE metric {arms} END AS {name}"


# Words, marks and lines of every text, then the seven metrics.
LEX = r"""
tok AS (
  SELECT doc_id, source, lang, text, n_chars,
    regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w,
    regexp_extract_all(text, '[^\p{L}\p{N}_ \t\n\r\f\v]') AS m,
    string_split(text, chr(10)) AS l
  FROM documents),
cnt AS (
  SELECT doc_id, source, lang, text, n_chars,
    len(m)::double AS bn1, len(w)::double AS bn2,
    len(list_distinct(m))::double AS n1, len(list_distinct(w))::double AS n2,
    len(list_filter(w, lambda t: t IN
      ('if','elif','for','while','except','and','or','case','assert'))) AS decisions,
    len(l) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS loc,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\r\f\v]*[^# \t\r\f\v]'))) AS code,
    len(list_filter(l, lambda x: contains(x, '#'))) AS comments
  FROM tok),
vol AS (
  SELECT *, CASE WHEN n1 + n2 > 0 THEN (bn1 + bn2) * log2(n1 + n2) ELSE 0::double END AS volume,
    CASE WHEN n2 > 0 THEN n1 / 2::double * bn2 / n2 ELSE 0::double END AS difficulty
  FROM cnt),
met AS (
  SELECT doc_id, source, lang, text, n_chars, sha256(text) AS sha, code > 0 AS ok,
    CASE WHEN code > 0 THEN 1 + decisions END AS cc,
    CASE WHEN code > 0 THEN CASE WHEN volume <= 0 THEN 100::double ELSE
      least(greatest((171::double - 5.2::double * ln(volume) - 0.23::double * (1 + decisions)
        - 16.2::double * ln(code::double)
        + 50::double * sin(sqrt(2.46::double * radians(100::double * comments / code))))
        * 100::double / 171::double, 0::double), 100::double) END END AS mi,
    CASE WHEN code > 0 THEN comments::double / greatest(loc + comments, 1) END AS comment_ratio,
    CASE WHEN code > 0 THEN volume END AS h_volume,
    CASE WHEN code > 0 THEN difficulty END AS h_difficulty,
    CASE WHEN code > 0 THEN volume * difficulty END AS h_effort,
    CASE WHEN code > 0 THEN code END AS sloc,
    ('0x' || substr(sha256(text), 1, 8))::bigint % 100 AS bucket
  FROM vol)"""

SPLIT = "CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'val' ELSE 'test' END"
HASH_SPLIT = SPLIT.replace("bucket", "('0x' || substr(sha256(text), 1, 8))::bigint % 100")

TABLE = LEX + f""",
tab AS (
  SELECT doc_id AS id, source AS task_id, lang AS model, n_chars, {SPLIT} AS split,
    {', '.join(f'{m}::double AS {m}' for m in METRICS)}
  FROM met)"""


def unpivoted(relation: str, columns: str, name: str) -> str:
    arms = " UNION ALL ".join(
        f"SELECT {columns}, '{m}' AS metric, {m}::double AS value FROM {relation}" for m in METRICS
    )
    return f"{name} AS ({arms})"


SURVIVORS = """
fit AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS copy
  FROM met WHERE length(text) BETWEEN 50 AND 6500 AND NOT contains(text, chr(0))),
kept AS (SELECT * FROM fit WHERE copy = 1 AND ok)"""

VECTORS = """
base AS (
  SELECT vec_id AS id, CASE WHEN n_chars > 6500
    THEN list_transform(embedding::double[], lambda x: 0::double)
    ELSE embedding::double[] END AS x
  FROM embeddings JOIN documents ON vec_id = doc_id),
vec AS (
  SELECT id, 1 AS layer, 'mean' AS pool, x AS vec FROM base
  UNION ALL SELECT id, 1, 'last', list_reverse(x) FROM base
  UNION ALL SELECT id, 2, 'mean', list_transform(x, lambda v: v * v + v * 0.5::double) FROM base
  UNION ALL SELECT id, 2, 'last',
    list_reverse(list_transform(x, lambda v: v * v + v * 0.5::double)) FROM base),
nz AS (SELECT * FROM vec WHERE len(list_filter(vec, lambda v: v <> 0)) > 0)"""
NORM = "sqrt(list_sum(list_transform(vec, lambda v: v * v)))"

STATUSES = """
judged AS (
  SELECT l.doc_id AS id, d.source AS task_id, d.lang AS model, l.doc_id AS generation_id,
    CASE WHEN toxic = 1 THEN -1::double WHEN quality = 0 THEN 0.5::double ELSE 1::double END AS alpha,
    CASE WHEN toxic = 1 THEN 'SyntaxError' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS status
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SAMPLES = TABLE + "," + STATUSES + """,
smp AS (
  SELECT tab.*, judged.alpha, CASE WHEN judged.id IS NULL THEN NULL ELSE status = 'pass' END AS passed
  FROM tab LEFT JOIN judged ON tab.id = judged.id)"""


def selected(relation: str) -> str:
    """Interior rows of each metric among the train rows of relation, ranked from both ends."""
    return f"""
train AS (SELECT * FROM {relation} WHERE split = 'train'),
{unpivoted('train', 'id', 'long_all')},
edge AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long_all GROUP BY metric),
inner_rows AS (SELECT id, l.metric, value FROM long_all l JOIN edge e ON l.metric = e.metric
  WHERE value > lo AND value < hi),
placed AS (
  SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY metric) * 10::double / 100::double))::bigint AS k,
    row_number() OVER (PARTITION BY metric ORDER BY value, id) AS up,
    row_number() OVER (PARTITION BY metric ORDER BY value DESC, id DESC) AS down
  FROM inner_rows),
chosen AS (SELECT id, metric, value, k, down <= k AS is_top, up <= k AS is_bottom
  FROM placed WHERE down <= k OR up <= k)"""


CURATED_CONTRAST = LEX + "," + SURVIVORS + "," + VECTORS + f""",
named AS (SELECT 'doc-' || id AS id, layer, pool, vec::float[]::double[] AS vec FROM nz),
present AS (
  SELECT 'doc-' || doc_id AS id, {SPLIT} AS split, {', '.join(f"{m}::{'int' if m in ('cc', 'sloc') else 'float'}::double AS {m}" for m in METRICS)}
  FROM kept WHERE 'doc-' || doc_id IN (SELECT id FROM named WHERE layer = 1 AND pool = 'mean')),""" + selected("present") + """,
elements AS (SELECT id, layer, pool, unnest(generate_series(0, len(vec) - 1))::int AS dim,
  unnest(vec) AS v FROM named),
contrast AS (
  SELECT metric, layer, pool, dim,
    avg(CASE WHEN is_top THEN v END) - avg(CASE WHEN is_bottom THEN v END) AS v
  FROM elements e JOIN chosen c ON e.id = c.id GROUP BY metric, layer, pool, dim)"""

CONTRAST = TABLE + "," + VECTORS + """,
present AS (SELECT * FROM tab WHERE id IN (SELECT id FROM nz WHERE layer = 1 AND pool = 'mean')),""" + (
    selected("present")
) + """,
elements AS (SELECT id, layer, pool, unnest(generate_series(0, len(vec) - 1))::int AS dim,
  unnest(vec) AS v FROM nz),
contrast AS (
  SELECT metric, layer, pool, dim,
    avg(CASE WHEN is_top THEN v END) - avg(CASE WHEN is_bottom THEN v END) AS v
  FROM elements e JOIN chosen c ON e.id = c.id GROUP BY metric, layer, pool, dim)"""

COSINES = CONTRAST + """,
ordered AS (SELECT *, list_position(['comment_ratio','h_volume','h_difficulty','h_effort','cc',
  'sloc','mi'], metric) AS ord FROM contrast),
cosines AS (
  SELECT a.layer, a.pool, a.metric AS metric_a, b.metric AS metric_b, a.ord AS oa, b.ord AS ob,
    sum(a.v * b.v) / (greatest(sqrt(sum(a.v * a.v)), 1e-8::double)
      * greatest(sqrt(sum(b.v * b.v)), 1e-8::double)) AS cosine
  FROM ordered a JOIN ordered b
    ON a.layer = b.layer AND a.pool = b.pool AND a.dim = b.dim AND a.ord <= b.ord
  GROUP BY ALL)"""


def spearman(relation: str, columns: list[str], pairs: list[tuple[str, str]]) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2::double AS {c}"
        for c in columns
    )
    arms = " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(covar_pop({a}, {b})"
        f" / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 9) AS rho FROM ranked"
        for a, b in pairs
    )
    return f"ranked AS (SELECT {ranks} FROM {relation}) {arms}"


def scalar_probe() -> str:
    """One-feature ridge, closed form, scored over rows, for two models of the feature."""
    return TABLE + "," + VECTORS + f""",
{unpivoted('tab', 'id, split', 'long_all')},
edge AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long_all GROUP BY metric),
feat AS (
  SELECT id, layer, pool, 'signed' AS model, list_sum(vec) AS x FROM nz
  UNION ALL SELECT id, layer, pool, 'positive',
    list_sum(list_transform(vec, lambda v: greatest(v, 0::double))) FROM nz),
obs AS (
  SELECT f.model, f.layer, f.pool, l.metric, l.split, x, value AS y
  FROM feat f JOIN long_all l ON f.id = l.id JOIN edge e ON l.metric = e.metric
  WHERE value > lo AND value < hi AND split IN ('train', 'test')),
fitted AS (
  SELECT model, layer, pool, metric, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my,
    covar_pop(x, y) * count(*) / stddev_pop(x) / (count(*) + 1) AS w
  FROM obs WHERE split = 'train' GROUP BY ALL),
scored AS (
  SELECT o.*, my, w, my + w * (x - mx) / sx AS guess,
    avg(y) OVER (PARTITION BY o.model, o.layer, o.pool, o.metric, split) AS centre
  FROM obs o JOIN fitted f ON o.model = f.model AND o.layer = f.layer AND o.pool = f.pool
    AND o.metric = f.metric),
parts AS (
  SELECT model, layer, pool, metric, split, count(*) AS n, any_value(my) AS my, any_value(w) AS w,
    1 - sum((y - guess) * (y - guess)) / nullif(sum((y - centre) * (y - centre)), 0) AS r2
  FROM scored GROUP BY ALL),
scores AS (
  SELECT model, layer, pool, metric, max(CASE WHEN split = 'train' THEN r2 END) AS r2_train,
    max(CASE WHEN split = 'test' THEN r2 END) AS r2_test,
    coalesce(max(CASE WHEN split = 'train' THEN n END), 0) AS n_train,
    coalesce(max(CASE WHEN split = 'test' THEN n END), 0) AS n_test,
    max(w) AS weight, max(my) AS intercept
  FROM parts GROUP BY model, layer, pool, metric)"""


PAIR = f"""{VECTORS},
feat AS (
  SELECT id, layer, pool, list_sum(vec) AS x,
    list_sum(list_transform(vec, lambda v: greatest(v, 0::double))) AS z FROM nz)"""


def pair_probe() -> str:
    """Two-feature ridge by Cramer's rule, scored over rows."""
    return TABLE + "," + PAIR + f""",
{unpivoted('tab', 'id, split', 'long_all')},
edge AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long_all GROUP BY metric),
obs AS (
  SELECT f.layer, f.pool, l.metric, l.split, x, z, value AS y
  FROM feat f JOIN long_all l ON f.id = l.id JOIN edge e ON l.metric = e.metric
  WHERE value > lo AND value < hi AND split IN ('train', 'test')),
sums AS (
  SELECT layer, pool, metric, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my,
    stddev_pop(x) AS sx, stddev_pop(z) AS sz, count(*) * corr(x, z) AS nr,
    count(*) * covar_pop(x, y) / stddev_pop(x) AS rx, count(*) * covar_pop(z, y) / stddev_pop(z) AS rz
  FROM obs WHERE split = 'train' GROUP BY ALL),
fitted AS (
  SELECT *, ((n + 1) * rx - nr * rz) / ((n + 1) * (n + 1) - nr * nr) AS wx,
    ((n + 1) * rz - nr * rx) / ((n + 1) * (n + 1) - nr * nr) AS wz FROM sums),
scored AS (
  SELECT o.*, my + wx * (x - mx) / sx + wz * (z - mz) / sz AS guess,
    avg(y) OVER (PARTITION BY o.layer, o.pool, o.metric, split) AS centre
  FROM obs o JOIN fitted f ON o.layer = f.layer AND o.pool = f.pool AND o.metric = f.metric)
SELECT layer, pool, metric, split, count(*) AS n,
  round(1 - sum((y - guess) * (y - guess)) / nullif(sum((y - centre) * (y - centre)), 0), 6) AS r2
FROM scored GROUP BY ALL"""


def pair_axes() -> str:
    """Principal axes of two features by the angle that turns their covariance diagonal."""
    return PAIR + """,
turned AS (
  SELECT layer, pool, avg(x) AS mx, avg(z) AS mz,
    0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS t FROM feat GROUP BY layer, pool),
axes AS (
  SELECT layer, pool, mx, mz, cos(t) AS c, sin(t) AS s,
    CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS lead,
    CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE -sign(sin(t)) END AS next
  FROM turned)
SELECT id, f.layer, f.pool, round(lead * (c * (x - mx) + s * (z - mz)), 6) AS pc_0,
  round(next * (c * (z - mz) - s * (x - mx)), 6) AS pc_1
FROM feat f JOIN axes a ON f.layer = a.layer AND f.pool = a.pool"""


def pivot_scores(rows: str) -> str:
    cells = ", ".join(
        f"round(max(CASE WHEN metric = '{m}' THEN r2_test END), 6) AS {m}" for m in METRICS
    )
    return f"WITH {scalar_probe()} SELECT {rows}, pool, {cells} FROM scores GROUP BY {rows}, pool"


def deltas(metrics: list[str], base_by: str, steered_by: str, steered: str) -> str:
    """CTEs ending in `delta`: change statistics per run and metric."""
    run = "".join(f"{c}, " for c in steered_by.split() )
    base_keys = "".join(f"{c}, " for c in base_by.split())
    means = ", ".join(f"avg({m}) AS {m}" for m in metrics)
    complete = " AND ".join(f"{m} IS NOT NULL" for m in metrics)
    same = " AND ".join(f"s.{c} = b.{c}" for c in [*base_by.split(), "task_id"])
    s_run = "".join(f"s.{c}, " for c in steered_by.split())
    arms = " UNION ALL ".join(
        f"SELECT {s_run}'{m}' AS metric, b.{m} AS base, s.{m} - b.{m} AS d,"
        f" (s.{m} - b.{m}) / nullif(abs(b.{m}), 0) * 100 AS pct"
        f" FROM steered_means s JOIN base_means b ON {same}" for m in metrics
    )
    return f"""
base_means AS (SELECT {base_keys}task_id, {means} FROM smp WHERE {complete} GROUP BY {base_keys}task_id),
steered_means AS (SELECT {run}task_id, {means} FROM smp WHERE {steered} AND {complete}
  GROUP BY {run}task_id),
changes AS ({arms}),
delta AS (
  SELECT {run}metric, avg(pct) AS mean_pct_delta, median(pct) AS median_pct_delta,
    stddev_samp(pct) AS std_pct_delta,
    avg(d) / nullif(avg(base), 0) * 100 AS mean_delta_over_base_mean_pct,
    median(d) / nullif(avg(base), 0) * 100 AS median_delta_over_base_mean_pct, count(d) AS n
  FROM changes GROUP BY {run}metric)"""


DELTA_FIELDS = [
    "mean_pct_delta", "median_pct_delta", "std_pct_delta", "mean_delta_over_base_mean_pct",
    "median_delta_over_base_mean_pct",
]


def pass_at(k: int) -> str:
    missed = f"list_product(list_transform(range({k}), lambda j: greatest(total - passed - j, 0)::double / (total - j)))"
    return f"CASE WHEN total >= {k} THEN 1 - {missed} END"


TOTALS = STATUSES + """,
totals AS (SELECT task_id, count(*) FILTER (status = 'pass') AS passed, count(*) AS total
  FROM judged GROUP BY task_id)"""

GENERATIONS = """
gens AS (
  SELECT d.doc_id AS seq, source AS task_id, quality::bigint AS given
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
rebuilt AS (
  SELECT seq, task_id, coalesce(given, row_number() OVER
    (PARTITION BY task_id, given IS NULL ORDER BY seq) - 1) AS generation_id FROM gens)"""

POINTS = SAMPLES + "," + deltas(K.REPORT_METRICS, "model", "model alpha", "alpha IS NOT NULL") + f""",
both_runs AS (
  SELECT model, alpha, task_id, status FROM judged
  UNION ALL SELECT model, 0::double, task_id, status FROM judged),
run_tasks AS (SELECT model, alpha, task_id, count(*) FILTER (status = 'pass') AS passed,
  count(*) AS total FROM both_runs GROUP BY ALL),
rates AS (SELECT model, alpha, avg({pass_at(1)}) AS pass FROM run_tasks GROUP BY model, alpha),
found AS (
  SELECT 1 AS pass_k, d.model, metric, d.alpha, pass, mean_pct_delta AS mean_delta,
    std_pct_delta AS std_delta
  FROM delta d JOIN rates r ON d.model = r.model AND d.alpha = r.alpha
  UNION ALL SELECT 1, model, NULL, alpha, pass, NULL, NULL FROM rates WHERE alpha = 0),
points AS (
  SELECT * FROM found WHERE metric IS NOT NULL
  UNION ALL SELECT pass_k, model, m, alpha, pass, 0::double, 0::double
  FROM found JOIN (SELECT unnest(['comment_ratio', 'mi']) AS m) ON metric IS NULL),
ordinals AS (
  SELECT pass_k, model, alpha, dense_rank() OVER (PARTITION BY pass_k, model ORDER BY alpha)::int AS ordinal
  FROM (SELECT DISTINCT pass_k, model, alpha FROM points))"""

CELL = """CASE WHEN mean_delta IS NULL OR pass IS NULL THEN '   —       —   '
  ELSE printf('%+6.1f', mean_delta) || '±' || coalesce(printf('%5.1f', std_delta), '  nan')
    || ' ' || printf('%.3f', pass) END"""

MODELS = ["de", "en", "es", "fr"]

BROKEN = "contains(text, '|')"
BLOCKS = "len(string_split(text, chr(10)))"


SCRIPTS = f"""
lines AS (
  SELECT doc_id, lang, {BROKEN} AS broken, string_split(text, chr(10)) AS l FROM documents),
written AS (
  SELECT doc_id AS seq, broken, lang = 'fr' AND NOT broken AS idle,
    CASE WHEN lang = 'en' THEN concat('def task_func(x):', chr(10),
        array_to_string(list_transform(l, lambda x: '    # ' || x), chr(10)), chr(10),
        repeat(concat('    if x > 0:', chr(10), '        x = x - 1', chr(10)), len(l)),
        '    return ', CASE WHEN broken THEN '(' ELSE 'x' END, chr(10))
      WHEN lang = 'fr' AND NOT broken THEN array_to_string(list_transform(l, lambda x: '# ' || x), chr(10)) || chr(10)
      ELSE concat('x = 5', chr(10), array_to_string(list_transform(l, lambda x: '# ' || x), chr(10)), chr(10),
        repeat(concat('if x > 0:', chr(10), '    x = x - 1', chr(10)), len(l)),
        'y = ', CASE WHEN broken THEN '(' ELSE 'x' END, chr(10)) END AS program
  FROM lines),
copies AS (
  SELECT seq, row_number() OVER (PARTITION BY sha256(program) ORDER BY seq) AS copy
  FROM written WHERE NOT broken AND length(program) BETWEEN 50 AND 6500),
reasons AS (
  SELECT seq, CASE WHEN broken THEN 'syntax' WHEN copy IS NULL THEN 'char_length' WHEN copy > 1 THEN 'dedup'
    WHEN idle THEN 'metrics' ELSE 'kept' END AS drop_reason
  FROM written LEFT JOIN copies USING (seq))"""


def _program_metrics() -> str:
    """Metrics of the derived programs in closed form: b comments, b branches, one header line.

    With a function: def, b times (if, assignment), return. Without: the same below an assignment,
    where the wrapper adds a def. Operators are > and -, operands x, 0 and 1.
    """
    return f"""
WITH prog AS (
  SELECT doc_id AS id, {BROKEN} AS broken, lang = 'en' AS fn, {BLOCKS}::double AS b FROM documents),
val AS (
  SELECT *, 6 * b * log2(5::double) AS volume, 1::double * 4 * b / 3 AS difficulty,
    CASE WHEN fn THEN 2 * b + 2 ELSE 2 * b + 3 END AS lloc,
    2 * b + 2 AS code, CASE WHEN fn THEN 2 * b + 2 ELSE 2 * b + 3 END AS wrapped_code
  FROM prog)
SELECT id, NOT broken AS valid, broken AS failed,
  CASE WHEN NOT broken THEN (1 + b)::int END AS cc,
  CASE WHEN NOT broken THEN round(least(greatest((171::double - 5.2::double * ln(volume)
    - 0.23::double * (b + 1) - 16.2::double * ln(lloc)
    + 50::double * sin(sqrt(2.46::double * radians(100::double * b / wrapped_code))))
    * 100::double / 171::double, 0::double), 100::double), {DIGITS['mi']}) END AS mi,
  CASE WHEN NOT broken THEN round(b / (code + b + b), {DIGITS['comment_ratio']}) END AS comment_ratio,
  CASE WHEN NOT broken THEN round(volume, {DIGITS['h_volume']}) END AS h_volume,
  CASE WHEN NOT broken THEN round(difficulty, {DIGITS['h_difficulty']}) END AS h_difficulty,
  CASE WHEN NOT broken THEN round(volume * difficulty, {DIGITS['h_effort']}) END AS h_effort,
  CASE WHEN NOT broken THEN code::int END AS sloc
FROM val"""


def _quality(keys: str, relation: str) -> str:
    select = f"{keys}, " if keys else ""
    group = f"{keys}, metric" if keys else "metric"
    return f"""SELECT {select}metric, count(value) AS count, {by_metric('avg(value)', 'mean')},
  {by_metric('median(value)', 'median')}, {by_metric('stddev_samp(value)', 'std')}
  FROM {relation} GROUP BY {group}"""


def _summary_sections(ks: list[int], per_task: bool = True, with_deltas: bool = False) -> str:
    rows = [
        "SELECT 'run' AS section, 'run' AS key, 'num_total' AS field, count(*)::double AS value FROM totals",
        "SELECT 'run', 'run', 'num_correct', count(*) FILTER (passed > 0)::double FROM totals",
        "SELECT 'run', 'run', 'num_invalid', count(*) FILTER "
        "(regexp_matches(lower(status), 'syntax|invalid|empty'))::double FROM judged",
        "SELECT 'status_counts', status, 'n_rows', count(*)::double FROM judged GROUP BY status",
    ]
    rows += [
        f"SELECT 'pass_at_k', 'pass@{k}', 'pass_at_k', CASE WHEN count({pass_at(k)}) = count(*)"
        f" THEN avg({pass_at(k)}) END FROM totals" for k in ks
    ]
    if per_task:
        rows += [
            f"SELECT 'per_task', task_id, '{f}', {f}::double FROM totals" for f in ("passed", "total")
        ]
    if with_deltas:
        rows += [
            f"SELECT 'metric_deltas', metric, '{f}', {f}::double FROM delta"
            for f in [*DELTA_FIELDS, "n"]
        ]
    return " UNION ALL ".join(rows)


PROFILE = ["count(value) AS n", by_metric("avg(value)", "mean"),
           by_metric("stddev_samp(value)", "std"), by_metric("min(value)", "min")]
PROFILE += [by_metric(f"quantile_cont(value, 0.{q})", f"q{q}") for q in (25, 50, 75)]
PROFILE += [by_metric("max(value)", "max")]

ROUNDED = ", ".join(f"round({m}::double, {DIGITS[m]}) AS {m}" for m in METRICS)
LENGTH_OK = "length(text) BETWEEN 50 AND 6500 AND NOT contains(text, chr(0))"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["curate_flagship"] = f"""WITH {LEX}, {SURVIVORS},
      parts AS (SELECT {SPLIT} AS split, count(*) AS n_rows, avg(comment_ratio) AS r
        FROM fit WHERE copy = 1 GROUP BY 1)
      SELECT split, n_rows, round(r, 9) AS mean_comment_ratio,
        round(100::double * n_rows / sum(n_rows) OVER (), 6) AS pct FROM parts"""
    sql["drop_reason_counts"] = f"""WITH {LEX}, {SURVIVORS}
      SELECT (SELECT count(*) FROM met WHERE contains(text, chr(0))) AS syntax,
        (SELECT count(*) FROM met WHERE NOT contains(text, chr(0))
          AND length(text) NOT BETWEEN 50 AND 6500) AS char_length,
        count(*) FILTER (copy > 1) AS dedup, count(*) FILTER (copy = 1 AND NOT ok) AS metrics,
        count(*) FILTER (copy = 1 AND ok) AS kept, (SELECT count(*) FROM met) AS pulled
      FROM fit"""
    sql["drop_reason_rows"] = f"""WITH {LEX}, {SURVIVORS}
      SELECT met.doc_id AS seq, CASE WHEN contains(met.text, chr(0)) THEN 'syntax'
        WHEN fit.doc_id IS NULL THEN 'char_length' WHEN copy > 1 THEN 'dedup'
        WHEN NOT met.ok THEN 'metrics' ELSE 'kept' END AS drop_reason
      FROM met LEFT JOIN fit ON met.doc_id = fit.doc_id"""
    sql["python_drop_counts"] = f"""WITH {SCRIPTS}
      SELECT count(*) FILTER (drop_reason = 'syntax') AS syntax, count(*) FILTER (drop_reason = 'char_length') AS char_length,
        count(*) FILTER (drop_reason = 'dedup') AS dedup, count(*) FILTER (drop_reason = 'metrics') AS metrics,
        count(*) FILTER (drop_reason = 'kept') AS kept, count(*) AS pulled FROM reasons"""
    sql["python_drop_rows"] = f"WITH {SCRIPTS} SELECT seq, drop_reason FROM reasons"
    sql["exact_dedup"] = """SELECT doc_id AS seq, sha256(text) AS sha256, n_chars, text
      FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1"""
    sql["hash_split_share"] = f"""SELECT {HASH_SPLIT} AS split, count(*) AS n_rows,
      round(100::double * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY 1"""
    sql["pull_order_limit"] = """WITH k AS (SELECT doc_id AS seq, text,
        ('0x' || substr(sha256('42:' || doc_id), 1, 15))::bigint AS pull_key FROM documents)
      SELECT seq, pull_key, text FROM k ORDER BY pull_key, seq LIMIT 500"""
    sql["id_fallback_chain"] = """SELECT doc_id AS seq, n_chars,
      CASE WHEN lang = 'en' THEN sha1(text) WHEN lang = 'fr' THEN doc_id::varchar
        ELSE substr(sha256(text), 1, 16) END AS id FROM documents"""
    sql["lexical_metrics"] = f"""WITH {LEX} SELECT doc_id AS seq, {ROUNDED},
      CASE WHEN NOT ok THEN 'IndentationError' END AS metrics_error FROM met"""
    sql["python_ast_metrics"] = _program_metrics()
    sql["curated_rows"] = f"""WITH {LEX}, {SURVIVORS}
      SELECT doc_id::varchar AS id, sha AS sha256, cc::int AS cc, sloc::int AS sloc,
        {SPLIT} AS split, round(mi::float::double, 3) AS mi,
        round(comment_ratio::float::double, 5) AS comment_ratio,
        round(h_difficulty::float::double, 2) AS h_difficulty FROM kept"""
    sql["code_block_extract"] = r"""SELECT conv_id, turn, regexp_replace(CASE role
        WHEN 'assistant' THEN text WHEN 'user' THEN 'def task_func(x):' || chr(10) || '    return x'
        ELSE text END, '^[ \t\n\r\f\v\x1C-\x1F]+|[ \t\n\r\f\v\x1C-\x1F]+$', '', 'g') AS code
      FROM conversations"""
    sql["vector_norm_profile"] = f"""WITH {VECTORS}, n AS (SELECT layer, pool, {NORM} AS n,
        len(list_filter(vec, lambda v: isnan(v))) AS nans FROM vec)
      SELECT layer, pool, count(*) AS n_rows, round(avg(n), 9) AS mean_norm,
        round(stddev_pop(n), 9) AS std_norm, sum(nans)::bigint AS nan_count
      FROM n GROUP BY layer, pool"""
    sql["zero_vector_filter"] = f"""WITH {VECTORS}
      SELECT id, layer, pool, round({NORM}, 9) AS norm FROM nz"""
    sql["index_metrics_join"] = f"""WITH {TABLE} SELECT vec_id AS id, label, split, cc, sloc,
      round(comment_ratio, 9) AS comment_ratio FROM embeddings LEFT JOIN tab ON vec_id = id"""
    states = """WITH s AS (SELECT label AS seq_id, vec_id, embedding,
        unnest(generate_series(0, len(embedding) - 1))::int AS dim,
        unnest(embedding::double[]) AS v FROM embeddings)"""
    sql["masked_mean_pool"] = f"""{states} SELECT seq_id, dim, round(avg(v), 9) AS value
      FROM s WHERE embedding[1] >= 0 GROUP BY seq_id, dim"""
    sql["last_position_pool"] = f"""{states} SELECT seq_id, dim, round(v, 9) AS value FROM s
      WHERE (seq_id, vec_id) IN (SELECT (label, max(vec_id)) FROM embeddings GROUP BY label)"""
    sql["feature_scaling"] = f"""WITH {VECTORS},
      e AS (SELECT nz.id, layer, pool, {HASH_SPLIT} AS split,
        unnest(generate_series(0, len(vec) - 1))::int AS dim, unnest(vec) AS v
        FROM nz JOIN documents ON nz.id = doc_id),
      s AS (SELECT layer, pool, dim, avg(v) AS mean, stddev_pop(v) AS std FROM e
        WHERE split = 'train' GROUP BY layer, pool, dim)
      SELECT e.id, e.layer, e.pool, split, e.dim,
        round((v - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS value
      FROM e JOIN s ON e.layer = s.layer AND e.pool = s.pool AND e.dim = s.dim"""
    sql["overflow_batches"] = """WITH b AS (SELECT doc_id AS seq, doc_id // 16 AS batch,
        max(n_chars) OVER (PARTITION BY doc_id // 16) AS padded FROM documents)
      SELECT seq, batch, padded FROM b WHERE padded <= 6500"""
    sql["length_bucket_batches"] = """WITH b AS (SELECT n_chars,
        (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 64 AS batch FROM documents)
      SELECT batch, count(*) AS n_rows, max(n_chars) AS padded,
        (count(*) * max(n_chars) - sum(n_chars))::bigint AS waste FROM b GROUP BY batch"""
    flags = ", ".join(
        f"coalesce({m} > min({m}) OVER () AND {m} < max({m}) OVER (), false) AS {m}_inside"
        for m in METRICS
    )
    sql["boundary_filter"] = f"WITH {TABLE} SELECT id, {flags} FROM tab"
    sql["tail_bands"] = f"""WITH {TABLE}, {unpivoted('tab', 'id', 'long_rows')},
      cuts AS (SELECT metric, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi
        FROM long_rows GROUP BY metric)
      SELECT id, l.metric, CASE WHEN value <= lo THEN 'bottom 5%' ELSE 'top 5%' END AS band
      FROM long_rows l JOIN cuts c ON l.metric = c.metric WHERE value <= lo OR value >= hi"""
    logs = ", ".join(f"round(ln(1 + ({m} - min({m}) OVER ())), 9) AS {m}_log" for m in METRICS)
    sql["shifted_log"] = f"WITH {TABLE} SELECT id, {logs} FROM tab"
    sql["top_bottom_select"] = f"""WITH {TABLE}, {selected('tab')}
      SELECT id, metric, k, is_top, is_bottom FROM chosen"""
    sql["selection_report"] = f"""WITH {TABLE}, {selected('tab')},
      sides AS (SELECT metric, value, 'top' AS side FROM chosen WHERE is_top
        UNION ALL SELECT metric, value, 'bottom' FROM chosen WHERE is_bottom)
      SELECT metric, side, count(*) AS n_rows, {by_metric('min(value)', 'low')},
        {by_metric('max(value)', 'high')}, any_value(n_dropped) AS n_dropped
      FROM sides JOIN (SELECT l.metric, count(*) FILTER (value <= lo OR value >= hi) AS n_dropped
        FROM long_all l JOIN edge e ON l.metric = e.metric GROUP BY l.metric) USING (metric) GROUP BY metric, side"""
    sql["contrast_vectors"] = f"""WITH {CONTRAST}
      SELECT metric, layer, pool, dim, round(v, 9) AS value FROM contrast"""
    norms = """norms AS (SELECT metric, layer, pool, sqrt(sum(v * v)) AS norm
      FROM contrast GROUP BY metric, layer, pool)"""
    sql["curated_contrast"] = f"""WITH {CURATED_CONTRAST}
      SELECT metric, layer, pool, dim, round(v, 9) AS value FROM contrast"""
    sql["contrast_norm_range"] = f"""WITH {CONTRAST}, {norms}
      SELECT metric, count(*) AS n_layers, round(min(norm), 9) AS min_norm,
        round(max(norm), 9) AS max_norm FROM norms GROUP BY metric"""
    sql["cosine_gram"] = f"""WITH {COSINES}
      SELECT layer, pool, metric_a, metric_b, round(cosine, 9) AS cosine FROM cosines"""
    sql["principal_angles"] = f"""WITH {COSINES}
      SELECT layer, pool, metric_a, metric_b, round(cosine, 9) AS cosine,
        round(degrees(acos(least(abs(cosine), 1::double))), 6) AS angle FROM cosines WHERE oa < ob"""
    within = " AND ".join(
        f"{m} > (SELECT min({m}) FROM tab) AND {m} < (SELECT max({m}) FROM tab)" for m in METRICS
    )
    sql["spearman_matrix"] = f"""WITH {TABLE}, inner_rows AS (SELECT * FROM tab WHERE {within}),
      {spearman('inner_rows', METRICS, PAIRS)}"""
    sql["verdict_spearman"] = f"""WITH {SAMPLES}, rated AS (SELECT {', '.join(METRICS)},
        passed::int AS passed FROM smp WHERE passed IS NOT NULL),
      {spearman('rated', [*METRICS, 'passed'], [(m, 'passed') for m in METRICS])}"""
    sql["column_profile"] = f"""WITH {TABLE}, {unpivoted('tab', 'id', 'long_rows')}
      SELECT metric, {', '.join(PROFILE)} FROM long_rows GROUP BY metric"""
    sql["probe_sweep_scalar"] = f"""WITH {scalar_probe()}
      SELECT model, layer, pool, metric, round(r2_train, 6) AS r2_train,
        round(r2_test, 6) AS r2_test, n_train, n_test, round(weight, 3) AS weight,
        {by_metric('intercept', 'intercept')} FROM scores"""
    sql["probe_sweep_pair"] = f"WITH {pair_probe()}"
    sql["pca_scores_pair"] = f"WITH {pair_axes()}"
    sql["probe_pivot"] = pivot_scores("model, layer")
    sql["model_pivot"] = pivot_scores("model")
    sql["best_layer"] = f"""WITH {scalar_probe()}
      SELECT model, pool, metric, layer, round(r2_test, 6) AS r2_test FROM scores
      QUALIFY row_number() OVER (PARTITION BY model, pool, metric
        ORDER BY r2_test DESC NULLS LAST, layer) = 1"""
    sql["winner_model"] = f"""WITH {scalar_probe()}
      SELECT pool, metric, model, layer, round(r2_test, 6) AS r2_test FROM scores
      QUALIFY row_number() OVER (PARTITION BY pool, metric
        ORDER BY r2_test DESC NULLS LAST, model, layer) = 1"""
    sql["probe_curve"] = f"""WITH {scalar_probe()}
      SELECT pool, metric, layer, round(r2_test, 6) AS r2_test, round(abs(weight), 3) AS weight_norm
      FROM scores WHERE model = 'signed'"""
    sql["generation_id_rebuild"] = f"WITH {GENERATIONS} SELECT * FROM rebuilt"
    sql["repeated_generations"] = f"""WITH {GENERATIONS}
      SELECT task_id, generation_id, count(*) AS n_rows FROM rebuilt
      GROUP BY task_id, generation_id HAVING count(*) > 1"""
    sql["verdict_join"] = f"""WITH {STATUSES}
      SELECT source AS task_id, d.doc_id AS seq,
        row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS generation_id,
        status = 'pass' AS passed FROM documents d LEFT JOIN judged ON d.doc_id = judged.id"""
    sql["quality_summary"] = f"""WITH {SAMPLES}, {unpivoted('smp', 'id, passed', 'long_rows')}
      {_quality('passed', 'long_rows')}"""
    sql["quality_summary_all"] = f"""WITH {TABLE}, {unpivoted('tab', 'id', 'long_rows')}
      {_quality('', 'long_rows')}"""
    sql["samples_quality"] = f"""WITH {LEX},
      smp AS (SELECT met.*, CASE WHEN l.doc_id IS NULL THEN 'none' WHEN quality = 1 THEN 'true' ELSE 'false' END AS verdict
        FROM met LEFT JOIN labels l ON met.doc_id = l.doc_id),
      {unpivoted('smp', 'doc_id, verdict', 'long_rows')} {_quality('verdict', 'long_rows')}"""
    sql["status_counts"] = (
        f"WITH {STATUSES} SELECT status, count(*) AS n_rows FROM judged GROUP BY status"
    )
    sql["task_rollup"] = f"WITH {TOTALS} SELECT task_id, passed, total FROM totals"
    sql["task_status_chunks"] = f"""WITH {STATUSES}
      SELECT task_id, generation_id // 256 AS part,
        string_agg(status, ',' ORDER BY generation_id) AS statuses FROM judged GROUP BY ALL"""
    sql["run_totals"] = f"""WITH {TOTALS}
      SELECT count(*) AS num_total, count(*) FILTER (passed > 0) AS num_correct,
        (SELECT count(*) FROM judged WHERE regexp_matches(lower(status), 'syntax|invalid|empty'))
        AS num_invalid FROM totals"""
    sql["pass_at_k"] = f"WITH {TOTALS} " + " UNION ALL ".join(
        f"SELECT {k}::int AS k, count(*) AS n_tasks, count(*) - count({pass_at(k)}) AS n_short,"
        f" round(CASE WHEN count(*) = count({pass_at(k)}) THEN avg({pass_at(k)}) END, 9) AS pass_at_k"
        " FROM totals" for k in (1, 5, 1000)
    )
    judged_deltas = deltas(METRICS, "", "", "passed IS NOT NULL")
    sql["metric_deltas"] = f"""WITH {SAMPLES}, {judged_deltas}
      SELECT metric, {', '.join(f'round({f}, 6) AS {f}' for f in DELTA_FIELDS)}, n FROM delta"""
    totals_only = TOTALS.replace(STATUSES + ",", "")
    sql["run_summary"] = f"""WITH {SAMPLES}, {totals_only}, {judged_deltas},
      parts AS ({_summary_sections([1, 5], with_deltas=True)})
      SELECT section, key, field, round(value, 6) AS value FROM parts"""
    old = TOTALS.replace("judged", "all_judged", 1).replace(
        "totals AS", "judged AS (SELECT * FROM all_judged WHERE status <> 'SyntaxError'),\ntotals AS"
    )
    sql["run_record"] = f"""WITH
      fresh AS (WITH {SAMPLES}, {totals_only}, {judged_deltas} {_summary_sections([5], per_task=False, with_deltas=True)}),
      stale AS (WITH {old} {_summary_sections([1], per_task=False)}),
      merged AS (SELECT * FROM fresh UNION ALL SELECT s.* FROM stale s ANTI JOIN fresh f
        ON s.section = f.section AND s.key = f.key AND s.field = f.field),
      {STATUSES.strip()},
      truth AS (SELECT task_id, arg_min(status, id) = 'pass' AS passed FROM judged GROUP BY task_id),
      totals AS (SELECT task_id, count(*) FILTER (status = 'pass') AS passed FROM judged GROUP BY task_id)
      SELECT section, key, field, round(value, 6) AS value, NULL AS text FROM merged WHERE section <> 'pass_at_k' OR value IS NOT NULL
      UNION ALL SELECT 'run', 'run', 'gt_pass_rate', round(avg(passed::int), 6), NULL FROM truth
      UNION ALL SELECT 'run', 'run', 'version', 2, NULL
      UNION ALL SELECT 'run', 'run', 'samples', NULL, 'all.jsonl'
      UNION ALL SELECT 'run', 'run', 'baseline', NULL, 'base.jsonl'
      UNION ALL SELECT 'failed_tasks', task_id, 'task_id', NULL, task_id FROM truth WHERE NOT passed
      UNION ALL SELECT 'per_task', j.task_id, 'statuses_' || (generation_id // 1000), t.passed,
        string_agg(status, ',' ORDER BY generation_id) FROM judged j JOIN totals t ON j.task_id = t.task_id
        GROUP BY j.task_id, generation_id // 1000, t.passed"""
    sql["summary_upsert"] = f"""WITH
      fresh AS (WITH {TOTALS} {_summary_sections([5], per_task=False)}),
      stale AS (WITH {old} {_summary_sections([1])})
      SELECT coalesce(f.section, s.section) AS section, coalesce(f.key, s.key) AS key,
        coalesce(f.field, s.field) AS field,
        round(CASE WHEN f.section IS NOT NULL THEN f.value ELSE s.value END, 6) AS value
      FROM stale s FULL JOIN fresh f
        ON s.section = f.section AND s.key = f.key AND s.field = f.field"""
    configs = """runs AS (SELECT d.doc_id AS seq, 'run' || d.doc_id AS name, lang AS model, source,
        quality, n_chars / 100::double AS size FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
    sql["sweep_expand"] = f"""WITH {configs},
      swept AS (SELECT seq, name, model, source, unnest([quality * -1::double, quality * 0.25::double,
        size, size / 1e6::double]) AS alpha FROM runs WHERE quality IS NOT NULL)
      SELECT seq, model, name || '_a' || printf('%g', alpha) AS name, 1 AS n_specs, source AS metric,
        alpha FROM swept
      UNION ALL SELECT seq, model, name, 0, NULL, NULL FROM runs WHERE quality IS NULL"""
    sql["sample_replication"] = (
        "SELECT item_id, unnest(range(5))::int AS generation_id FROM benchmark"
    )
    sql["runs_by_model"] = f"""WITH {configs} SELECT model, name,
      row_number() OVER (PARTITION BY model ORDER BY seq) AS place FROM runs"""
    sql["run_filter"] = f"WITH {configs} SELECT seq, name, model FROM runs WHERE model = 'en'"
    sql["steering_specs"] = """SELECT doc_id, source AS metric, doc_id::int AS layer,
      printf('%g', n_chars / 100::double)::double AS alpha FROM documents"""
    sql["run_stems"] = """SELECT doc_id, lang || '--' || source || CASE WHEN lang = 'en' THEN '-hard'
      ELSE '' END || '-instruct--repo-' || CASE WHEN n_chars > 1000 THEN 'steered' ELSE 'base' END
      || '-' || printf('%g', n_chars / 100::double) || '-5' AS stem FROM documents"""
    sql["run_name_parse"] = """WITH n AS (SELECT l.doc_id, lang, quality, toxic,
        CASE WHEN toxic = 1 THEN 'mi' ELSE 'comment_ratio' END AS metric,
        printf('%g', (n_chars - 1000) / 100::double) AS alpha
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
      SELECT doc_id, 'pass1_full_' || lang || '_' || metric || '_a' || alpha || '_p10_summary.json'
        AS name, 1 AS pass_k, lang AS model, metric, alpha::double AS alpha FROM n WHERE quality = 1
      UNION ALL SELECT doc_id, 'pass5_full_' || lang || '_base_p10_summary.json', 5, lang, NULL,
        0::double FROM n WHERE quality <> 1 AND toxic = 1"""
    sql["summary_scan"] = f"""WITH {POINTS} SELECT pass_k, model, metric, alpha,
      round(pass, 9) AS pass_rate, round(mean_delta, 6) AS mean_delta,
      round(std_delta, 6) AS std_delta FROM found"""
    sql["alpha_ordinal"] = f"WITH {POINTS} SELECT pass_k, model, alpha, ordinal FROM ordinals"
    sql["alpha_check"] = f"""WITH {POINTS}, seen AS (SELECT pass_k, model, alpha,
        count(DISTINCT metric) AS n FROM points GROUP BY ALL)
      SELECT pass_k, model, count(*) AS n_alphas, min(n) = 2 AS agrees FROM seen
      GROUP BY pass_k, model"""
    cells = ", ".join(
        f"coalesce(max(CASE WHEN p.model = '{model}' AND metric = '{metric}' THEN {CELL} END),"
        f" '{K.MISSING_CELL}') AS {model}_{metric}"
        for model in MODELS for metric in K.REPORT_METRICS
    )
    sql["final_report"] = f"""WITH {POINTS} SELECT p.pass_k, ordinal, {cells} FROM points p
      JOIN ordinals o ON p.pass_k = o.pass_k AND p.model = o.model AND p.alpha = o.alpha
      GROUP BY p.pass_k, ordinal"""
    legend = ", ".join(
        f"max(CASE WHEN model = '{m}' THEN printf('%.4g', alpha) END) AS {m}" for m in MODELS
    )
    sql["alpha_legend"] = (
        f"WITH {POINTS} SELECT pass_k, ordinal, {legend} FROM ordinals GROUP BY pass_k, ordinal"
    )
    sql["jsonl_roundtrip"] = f"""WITH {LEX}
      SELECT 'task-' || met.doc_id AS task_id, coalesce(quality, 0)::bigint AS generation_id, {ROUNDED}
      FROM met LEFT JOIN labels l ON met.doc_id = l.doc_id
      WHERE length(text) BETWEEN 50 AND 6500"""
    sql["verdict_scan"] = """
      SELECT 'doc-' || doc_id AS task_id, 0::bigint AS generation_id,
        CASE WHEN quality = 1 THEN 'PASS' ELSE 'fail' END AS status, quality = 1 AS passed FROM labels
      UNION ALL SELECT 'doc-' || doc_id, 1, CASE WHEN toxic = 1 THEN 'Syntax Error' ELSE 'pass' END,
        toxic = 0 FROM labels
      UNION ALL SELECT 'doc-' || doc_id, 2, NULL, false FROM labels"""
    sql["verdict_documents"] = sql["verdict_scan"]
    sql["manifest_counts"] = f"""WITH {LEX}, {SURVIVORS},
      line AS (SELECT coalesce(sum(strlen(text)) OVER (ORDER BY sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint
        AS begins FROM kept)
      SELECT max(begins // 262144) + 1 AS n_shards, count(*) AS total_rows,
        1 AS schema_version, count(*) AS listed_rows FROM line"""
    sql["shard_union"] = f"""WITH {LEX}, {SURVIVORS} SELECT doc_id::varchar AS id, {SPLIT} AS split,
      cc::int AS cc, sloc::int AS sloc FROM kept"""
    sql["partitioned_vectors"] = f"""WITH {VECTORS},
      small AS (SELECT id, layer, pool, vec::float[]::double[] AS vec FROM vec
        WHERE layer = 2 AND pool = 'mean')
      SELECT id, layer, pool, round({NORM}, 5) AS norm FROM small"""
    sql["index_roundtrip"] = f"SELECT doc_id AS id, {HASH_SPLIT} AS split FROM documents"
    sql["contrast_store"] = f"""WITH {CONTRAST}, {norms}
      SELECT 'tables' AS model, 10 AS p, metric, layer, pool, round(norm, 9) AS norm FROM norms"""
    sql["probe_store"] = f"""WITH {TABLE}, {VECTORS},
      {unpivoted('tab', 'id, split', 'long_all')},
      edge AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long_all GROUP BY metric)
      SELECT 'tables' AS model, pool, layer, l.metric, count(*) FILTER (split = 'train') AS n_train,
        count(*) FILTER (split = 'test') AS n_test, 64 AS width, 1::double AS ridge_alpha
      FROM nz JOIN long_all l ON nz.id = l.id JOIN edge e ON l.metric = e.metric
      WHERE value > lo AND value < hi GROUP BY pool, layer, l.metric"""
    sql["run_metadata"] = """SELECT 'tables' AS model_name, count(*) AS n_rows,
      max(len(embedding))::bigint AS d_model, 'last,mean' AS pools FROM embeddings"""
    sql["task_scan"] = """SELECT 'task/' || item_id AS task_id, text AS prompt FROM benchmark
      ORDER BY task_id LIMIT 25"""
    sql["stream_curation"] = f"""WITH {LEX}, {SURVIVORS}
      SELECT doc_id::varchar AS id, sha AS sha256, {SPLIT} AS split, cc::int AS cc,
        sloc::int AS sloc FROM kept"""
    sql["stream_drop_counts"] = sql["drop_reason_counts"]
    return sql
