"""The same queries in SQL for an independent engine, over the same tables."""

from __future__ import annotations

from ..operators.resample import DRAWS, PRIME, STEPS, factors
from .contracts import COLUMNS

_M = """
m AS (SELECT r_name || '_' || CASE WHEN l_linestatus = 'F' THEN 'IC50' ELSE 'Ki' END AS task, r_name AS target, CASE WHEN l_linestatus = 'F' THEN 'IC50' ELSE 'Ki' END AS type,
  l_partkey AS mol_id, p_brand || ' ' || p_type AS structure, l_suppkey AS doc_id, l_orderkey AS assay_id, CAST(year(l_shipdate) AS INTEGER) AS year,
  4e0 + CAST(p_size AS DOUBLE) / 25e0 + log10(l_extendedprice) / 2e0 AS y, p_brand, p_type, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_D = _M + ",\nd AS (SELECT task, mol_id, doc_id, avg(y) AS y, min(year) AS year, list_sort(list_distinct(list(assay_id))) AS assays FROM m GROUP BY ALL)"
_S = _D + ",\ns AS (SELECT task, mol_id, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss, max(y) - min(y) AS range FROM d GROUP BY ALL)"


def _ceil(keep: str, by: str, source: str = "s", k: str = "inv_docs", spread: str = "var_samp(mean)") -> str:
    return f"""SELECT {by}, n_mols_rep, n_meas_rep, CASE WHEN dof > 0 THEN sqrt(ss / dof) END AS sigma, var_y, CASE WHEN dof > 0 THEN sqrt(ss / dof * {k}) END AS rmse_floor,
  CASE WHEN dof > 0 AND var_y > 0 THEN least(1e0, greatest(0e0, 1 - ss / dof * {k} / var_y)) END AS r2_max, CASE WHEN dof > 0 THEN sqrt(ss / dof * {k}) * sqrt(2 / pi()) END AS mae_floor
  FROM (SELECT {by}, count(*) FILTER ({keep}) AS n_mols_rep, CAST(coalesce(sum(n) FILTER ({keep}), 0) AS BIGINT) AS n_meas_rep, sum(ss) FILTER ({keep}) AS ss, sum(n - 1) FILTER ({keep}) AS dof,
        {spread} AS var_y, avg(1e0 / n) AS inv_docs FROM {source} GROUP BY {by})"""


_C = _S + ",\nc AS (" + _ceil("n >= 2 AND range <= 3", "task") + ")"
_E = _C + """,
e AS (SELECT s.task, s.mol_id, s.mean AS y, s.n AS n_docs, x.first_year, x.structure, x.p_brand, x.p_type, x.p_size FROM s
      JOIN (SELECT task, mol_id, min(year) AS first_year, any_value(structure) AS structure, any_value(p_brand) AS p_brand, any_value(p_type) AS p_type, any_value(p_size) AS p_size FROM m GROUP BY ALL) x
      ON s.task = x.task AND s.mol_id = x.mol_id)"""


def _hash(*keys: str, seed: str = "'0'") -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {seed}, " + ", ".join(keys) + ")), 1, 8) AS BIGINT)"


_TAKE = "round_even(count(*) OVER (PARTITION BY {by}) * 2e-1, 0)"
_EC = "task, mol_id, y, n_docs, first_year, structure, p_brand, p_type, p_size"
_P = _E + f""",
sd AS (SELECT unnest([0, 1, 2, 3, 4]) AS seed),
pr5 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY seed, task ORDER BY {_hash('task', 'mol_id', seed='seed')}, mol_id) <= {_TAKE.format(by='seed, task')} THEN 'test' ELSE 'train' END AS part FROM e, sd),
pr AS (SELECT * FROM pr5 WHERE seed = 0),
pt AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY first_year, mol_id) > count(*) OVER (PARTITION BY task) - {_TAKE.format(by='task')} THEN 'test' ELSE 'train' END AS part FROM e),
gs AS (SELECT seed, task, structure, size, {_hash('task', 'structure', seed='seed')} AS h FROM (SELECT task, structure, count(*) AS size FROM e GROUP BY task, structure), sd),
go AS (SELECT *, row_number() OVER (PARTITION BY seed, task ORDER BY h, structure) AS "at", CAST(round_even(sum(size) OVER (PARTITION BY seed, task) * 2e-1, 0) AS BIGINT) AS budget FROM gs),
fo AS (SELECT seed, task, structure, "at", budget, CASE WHEN size <= budget THEN size ELSE 0 END AS used, size <= budget AS taken FROM go WHERE "at" = 1
       UNION ALL SELECT g.seed, g.task, g.structure, g."at", g.budget, CASE WHEN used + g.size <= g.budget THEN used + g.size ELSE used END, used + g.size <= g.budget
       FROM fo JOIN go g ON g.seed = fo.seed AND g.task = fo.task AND g."at" = fo."at" + 1),
pc AS (SELECT e.*, fo.seed, CASE WHEN taken THEN 'test' ELSE 'train' END AS part FROM e JOIN fo ON e.task = fo.task AND e.structure = fo.structure),
pa AS MATERIALIZED (SELECT 'random' AS split, seed, part, {_EC} FROM pr5 UNION ALL SELECT 'temporal', seed, part, {_EC} FROM pt, sd UNION ALL SELECT 'scaffold', seed, part, {_EC} FROM pc),
tm AS (SELECT split, seed, task, avg(y) AS y_train_mean FROM pa WHERE part = 'train' GROUP BY ALL),
tb AS (SELECT split, seed, task, p_brand, avg(y) AS g FROM pa WHERE part = 'train' GROUP BY ALL),
tt AS (SELECT split, seed, task, p_type, avg(y) AS g FROM pa WHERE part = 'train' GROUP BY ALL),
ts AS (SELECT split, seed, task, p_size, avg(y) AS g FROM pa WHERE part = 'train' GROUP BY ALL),
te AS (SELECT pa.*, y_train_mean, coalesce(tb.g, y_train_mean) AS b, coalesce(tt.g, y_train_mean) AS t, coalesce(ts.g, y_train_mean) AS z FROM pa JOIN tm USING (split, seed, task)
       LEFT JOIN tb USING (split, seed, task, p_brand) LEFT JOIN tt USING (split, seed, task, p_type) LEFT JOIN ts USING (split, seed, task, p_size) WHERE part = 'test'),
p AS MATERIALIZED (SELECT task, split, seed, u.model, mol_id, y, u.pred, n_docs, y_train_mean
      FROM te, LATERAL (SELECT unnest(['mean_all', 'mean_by_brand', 'mean_by_type', 'mean_by_size']) AS model, unnest([y_train_mean, b, t, z]) AS pred) u)"""


def _rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


_B = _P + f""",
rk AS (SELECT *, {_rank('y', 'task, split, seed, model')} AS ry, {_rank('pred', 'task, split, seed, model')} AS rp FROM p),
mt AS (SELECT task, split, seed, model, count(*) AS n_test, sqrt(avg((y - pred) ** 2)) AS rmse, avg(abs(y - pred)) AS mae, CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - pred) ** 2) / var_pop(y) END AS r2,
       {_corr('ry', 'rp')} AS spearman, sqrt(avg((y - y_train_mean) ** 2)) AS rmse_mean, avg(1e0 / n_docs) AS test_mean_inv_ndocs FROM rk GROUP BY ALL),
bm AS (SELECT mt.*, n_train FROM mt JOIN (SELECT split, seed, task, count(*) FILTER (part = 'train') AS n_train FROM pa GROUP BY ALL) USING (split, seed, task))"""
_A = _B + """,
a0 AS (SELECT bm.*, sigma, var_y, sigma * sqrt(test_mean_inv_ndocs) AS rmse_floor FROM bm JOIN (SELECT task, sigma, var_y FROM c) USING (task)),
a AS (SELECT *, CASE WHEN rmse_floor IS NOT NULL THEN greatest(0e0, CASE WHEN var_y > 0 THEN 1 - rmse_floor ** 2 / var_y END) END AS r2_max,
      CASE WHEN rmse_mean - rmse_floor > 0 THEN (rmse_mean - rmse) / (rmse_mean - rmse_floor) END AS frac_ceiling, CASE WHEN rmse > 0 THEN rmse_floor / rmse END AS frac_rmse,
      CASE WHEN rmse_floor IS NOT NULL AND sqrt(greatest(0e0, rmse_mean ** 2 - rmse_floor ** 2)) > 0 THEN 1 - sqrt(greatest(0e0, rmse ** 2 - rmse_floor ** 2)) / sqrt(greatest(0e0, rmse_mean ** 2 - rmse_floor ** 2)) END AS frac_ceiling_true,
      coalesce(rmse < rmse_floor, false) AS below_floor, CASE WHEN rmse_mean > 0 THEN (rmse_mean - rmse_floor) / rmse_mean END AS headroom FROM a0),
ac AS (SELECT *, CASE WHEN r2_max > 0 THEN r2 / r2_max END AS frac_r2, coalesce(headroom < 0.2, false) AS low_headroom FROM a),
pk AS (SELECT task, split, model, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2, avg(spearman) AS spearman, avg(rmse_mean) AS rmse_mean, avg(frac_ceiling) AS frac_ceiling,
       avg(frac_rmse) AS frac_rmse, CAST(sum(n_test) AS BIGINT) AS n_test_rows FROM ac GROUP BY ALL)"""
_MEANS = ", ".join(f"avg({c}) AS {c}" for c in ("rmse", "mae", "r2", "spearman", "rmse_mean", "frac_ceiling", "frac_rmse"))

_X = """
w AS (SELECT doc_id, source, md5(text) AS key_full, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS words, source IN ('src0', 'src1', 'src2', 'src3') AS in_registry, lang, n_chars FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, CASE WHEN len(words) > 0 THEN md5(array_to_string(list_sort(list_distinct(words)), ' ')) END AS key_short FROM w),
g AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS feature FROM
      (SELECT doc_id, list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gs FROM x WHERE len(words) >= 1)),
rg AS (SELECT * FROM x WHERE in_registry), ds AS (SELECT * FROM x WHERE NOT in_registry),
fl AS (SELECT ds.doc_id, ds.source, ds.key_short, key_full IN (SELECT key_full FROM rg) AS exact_full, s.src IS NOT NULL AS exact_short, s.src AS exact_sources FROM ds
       LEFT JOIN (SELECT key_short, list_sort(list_distinct(list(source))) AS src FROM rg WHERE key_short IS NOT NULL GROUP BY ALL) s USING (key_short))"""
_J = _X + """,
o AS (SELECT a.doc_id, b.doc_id AS reg_id, a.n AS an, b.n AS bn, count(*) AS "both" FROM g a JOIN g b USING (feature) WHERE a.doc_id IN (SELECT doc_id FROM ds) AND b.doc_id IN (SELECT doc_id FROM rg) GROUP BY ALL),
j AS (SELECT *, CAST("both" AS DOUBLE) / (an + bn - "both") AS similarity FROM o),
sm AS (SELECT ds.doc_id, coalesce(max(similarity), 0e0) AS similarity FROM ds LEFT JOIN j USING (doc_id) GROUP BY ALL)"""
_F = _J + """,
an AS (SELECT fl.*, NOT exact_full AND NOT exact_short AND coalesce(nr, false) AS near FROM fl LEFT JOIN (SELECT doc_id, bool_or("both" * 1000 > (an + bn - "both") * 800) AS nr FROM j GROUP BY ALL) USING (doc_id)),
st AS (SELECT source, count(*) AS total, count(*) FILTER (exact_full) AS f, count(*) FILTER (NOT exact_full AND exact_short) AS h, count(*) FILTER (near) AS r FROM an GROUP BY ALL),
lg AS (SELECT source, u.step_no, u.step, u.removed, u."left" FROM st, LATERAL (SELECT unnest([0, 1, 2, 3]) AS step_no, unnest(['raw', 'exact_full', 'exact_short', 'near']) AS step,
       unnest([0, f, h, r]) AS removed, unnest([total, total - f, total - f - h, total - f - h - r]) AS "left") u)"""
_CUT = "cu(model, cutoff, basis, cut_year, sources) AS (VALUES ('alpha', DATE '1998-03-01', 'training_cutoff', 1998, ['src0', 'src1']), ('beta', DATE '1999-11-15', 'paper_date', 1999, ['src2']), ('gamma', DATE '2001-06-30', 'today', 2001, NULL))"
_Q = """
q AS (SELECT a.task, a.mol_id, a.doc_id AS doc_a, b.doc_id AS doc_b, abs(a.y - b.y) AS delta, abs(a.year - b.year) AS d_year, (a.y + b.y) / 2 AS mean_y, a.assays = b.assays AS same_assays
      FROM d a JOIN d b ON a.task = b.task AND a.mol_id = b.mol_id AND a.doc_id < b.doc_id)"""
_WQ = """
wd AS (SELECT task, mol_id, doc_id, assay_id, avg(y) AS y FROM m GROUP BY ALL),
wq AS (SELECT a.task, a.mol_id, a.doc_id, a.assay_id AS assay_a, b.assay_id AS assay_b, abs(a.y - b.y) AS delta FROM wd a JOIN wd b
       ON a.task = b.task AND a.mol_id = b.mol_id AND a.doc_id = b.doc_id AND a.assay_id < b.assay_id)"""
_PAIRS = _D + "," + _Q


def _profile(source: str, kind: str) -> str:
    qs = ", ".join(f"quantile_cont(delta, {p}) AS q{int(100 * p)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99))
    fs = ", ".join(f"avg(CASE WHEN delta >= {t} THEN 1e0 ELSE 0e0 END) AS frac_ge{n}" for t, n in (("2e-1", 1), ("4e-1", 2), ("6e-1", 3)))
    return f"SELECT task, count(*) AS n_pairs, {qs}, max(delta) AS max, {fs}, '{kind}' AS kind FROM {source} GROUP BY task"


def _shift(source: str, unit: str) -> str:
    return f"""v AS (SELECT *, count(*) OVER w AS n, sum(y) OVER w AS sy FROM ({source}) WINDOW w AS (PARTITION BY task, mol_id)),
r AS (SELECT task, {unit}, y - (sy - y) / (n - 1) AS x FROM v WHERE n > 1),
t AS (SELECT task, {unit}, count(*) AS n_overlap, avg(x) AS mean_shift, stddev_samp(x) AS sd, stddev_samp(x) / sqrt(count(*)) AS se FROM r GROUP BY ALL)
SELECT *, CASE WHEN se > 0 THEN mean_shift / se END AS z, n_overlap >= 5 AND coalesce((abs(CASE WHEN se > 0 THEN mean_shift / se END) > 3) OR (se = 0 AND mean_shift <> 0), false) AS flag_shift FROM t"""


def _iv(x: str, name: str) -> str:
    return ", ".join(f"quantile_cont({x}, {p}) AS {name}_{s}" for p, s in ((0.025, "lo"), (0.5, "med"), (0.975, "hi")))


def _picks(source: str, by: str, key: str = "mol_id") -> str:
    return f"""kk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_hash(*by.split(', '), key)}, {key}) - 1 AS "at" FROM (SELECT DISTINCT {by}, {key} FROM {source})),
kg AS (SELECT {by}, count(*) AS g FROM kk GROUP BY ALL), kb AS (SELECT *, unnest(range(0, g)) AS i FROM (SELECT *, unnest(range(0, {DRAWS})) AS b FROM kg)),
kp AS (SELECT {by}, b, CAST('0x' || substr(md5(concat_ws('|', '0', b, i)), 1, 8) AS BIGINT) % g AS "at" FROM kb),
wt AS (SELECT {by}, {key}, b, count(*) AS w FROM kp JOIN kk USING ({by}, "at") GROUP BY ALL)"""


def _poisson(source: str, by: str, values: tuple, keys: str = "task, mol_id", name: str = "ps") -> str:
    """Sums of the source's values over each resample: the same generator, from an entity's hash."""
    w = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in STEPS)
    weighed = ", ".join(f"sum(w * {v}) AS {v}" for v in values)
    return f"""{name}f AS (SELECT unnest(range(0, {DRAWS})) AS b, unnest([{', '.join(map(str, factors(DRAWS)))}]) AS f),
{name}s AS (SELECT *, {_hash(*keys.split(', '))} % {PRIME - 1} + 1 AS state FROM {source}),
{name}w AS (SELECT x.*, b, {w} AS w FROM (SELECT {name}s.*, b, state * f % {PRIME} AS u FROM {name}s, {name}f) x),
{name} AS (SELECT {by}, b, {weighed} FROM {name}w GROUP BY ALL)"""


_FP = _P.rstrip() + """,
pm AS (SELECT task, split, model, mol_id, CAST(count(*) AS DOUBLE) AS n, sum((y - pred) ** 2) AS e2, sum((y - y_train_mean) ** 2) AS b2, sum(1e0 / n_docs) AS inv FROM p GROUP BY ALL),
pn AS MATERIALIZED (SELECT pm.* FROM pm JOIN (SELECT task, split, model FROM pm GROUP BY ALL HAVING sum(n) >= 10) USING (task, split, model)),
"""
_FRACTIONS = """,
f0 AS (SELECT task, split, model, b, sqrt(e2 / n) AS rmse, sqrt(b2 / n) AS mean, sigma * sqrt(inv / n) AS floor FROM ps JOIN (SELECT task, sigma FROM c) USING (task) WHERE n > 0),
fd AS MATERIALIZED (SELECT task, split, model, b, rmse, CASE WHEN mean - floor > 0 THEN (mean - rmse) / (mean - floor) END AS frac FROM f0)"""
_FD = {
    "poisson": _FP + _poisson("pn", "task, split, model", ("n", "e2", "b2", "inv")) + _FRACTIONS,
    "hash": _FP + _picks("pn", "task, split") + """,
ps AS (SELECT task, split, model, b, sum(w * n) AS n, sum(w * e2) AS e2, sum(w * b2) AS b2, sum(w * inv) AS inv FROM pn JOIN wt USING (task, split, mol_id) GROUP BY ALL)""" + _FRACTIONS,
}
_L = _P + """,
sg0 AS (SELECT DISTINCT structure, string_split(structure, ' ') AS ws FROM e WHERE structure IS NOT NULL), sg AS (SELECT structure, len(ws) AS n, unnest(ws) AS w FROM (SELECT structure, list_distinct(ws) AS ws FROM sg0)),
sp AS MATERIALIZED (SELECT structure, other, CAST(k AS DOUBLE) / (an + bn - k) AS sim FROM (SELECT a.structure, b.structure AS other, a.n AS an, b.n AS bn, count(*) AS k FROM sg a JOIN sg b USING (w) GROUP BY ALL) ),
rt AS (SELECT task, split, seed, structure AS other, min(y) AS low, max(y) AS high FROM pa WHERE part = 'train' GROUP BY ALL),
xt AS (SELECT task, split, seed, mol_id, structure, y, n_docs FROM pa WHERE part = 'test'),
xs AS (SELECT xt.task, xt.split, xt.seed, mol_id, max(sim) AS max_sim, bool_or(sim >= 8e-1 AND (y - low >= 15e-1 OR high - y >= 15e-1)) AS cliff FROM xt JOIN sp USING (structure) JOIN rt USING (task, split, seed, other) GROUP BY ALL),
cx AS MATERIALIZED (SELECT xt.task, xt.split, xt.seed, xt.mol_id, y, n_docs, coalesce(max_sim, 0e0) AS max_sim, coalesce(cliff, false) AS cliff FROM xt LEFT JOIN xs USING (task, split, seed, mol_id)),
yc AS (SELECT task, quantile_cont(y, CAST(1 AS DOUBLE) / 3) AS lo, quantile_cont(y, CAST(2 AS DOUBLE) / 3) AS hi, count(*) AS n FROM e GROUP BY task),
zc AS (SELECT quantile_cont(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3) AS zlo, quantile_cont(CAST(n AS DOUBLE), CAST(2 AS DOUBLE) / 3) AS zhi, count(*) AS k FROM yc),
sl0 AS (SELECT cx.*, CASE WHEN n_docs = 1 THEN '1' WHEN n_docs = 2 THEN '2' ELSE '3+' END AS v1, CASE WHEN y < lo THEN 'y_low' WHEN y < hi THEN 'y_mid' ELSE 'y_high' END AS v2,
        CASE WHEN k < 3 THEN 'n/a' WHEN n <= zlo THEN 'small' WHEN n >= zhi THEN 'large' ELSE 'medium' END AS v3, split_part(task, '_', 1) AS v4,
        CASE WHEN max_sim < 4e-1 THEN '<0.4' WHEN max_sim < 6e-1 THEN '0.4-0.6' WHEN max_sim < 8e-1 THEN '0.6-0.8' ELSE '>=0.8' END AS v5, CASE WHEN cliff THEN 'cliff' ELSE 'no_cliff' END AS v6 FROM cx JOIN yc USING (task), zc),
sl AS (SELECT task, split, seed, mol_id, u.slice_type, u.slice_value FROM sl0,
       LATERAL (SELECT unnest(['noise', 'y_range', 'task_size', 'all', 'target', 'tanimoto', 'cliff']) AS slice_type, unnest([v1, v2, v3, 'all', v4, v5, v6]) AS slice_value) u),
pb AS MATERIALIZED (SELECT sl.slice_type, sl.slice_value, a.split, a.model, a.task, a.mol_id, CAST(count(*) AS DOUBLE) AS n, sum((a.y - a.pred) ** 2) AS e2, sum((b.y - b.pred) ** 2) AS base_e2
       FROM p a JOIN p b ON a.task = b.task AND a.split = b.split AND a.seed = b.seed AND a.mol_id = b.mol_id AND b.model = 'mean_by_brand'
       JOIN sl ON a.task = sl.task AND a.split = sl.split AND a.seed = sl.seed AND a.mol_id = sl.mol_id WHERE a.model <> 'mean_by_brand' GROUP BY ALL),
pd AS (SELECT slice_type, slice_value, split, model, task, count(*) AS n_mols, sum(n) AS n, sum(e2) AS e2, sum(base_e2) AS base_e2 FROM pb GROUP BY ALL HAVING count(*) >= 30)"""
_SI = _L + """,
pk AS (SELECT pb.* FROM pb JOIN (SELECT slice_type, slice_value, split, model, task FROM pd) USING (slice_type, slice_value, split, model, task)),
""" + _poisson("pk", "slice_type, slice_value, split, model, task", ("n", "e2", "base_e2")) + """,
sb AS (SELECT slice_type, slice_value, split, model, b, avg(sqrt(e2 / n) - sqrt(base_e2 / n)) AS d, avg(CASE WHEN sigma > 0 THEN (sqrt(e2 / n) - sqrt(base_e2 / n)) / sigma END) AS o
       FROM ps LEFT JOIN (SELECT task, sigma FROM c) USING (task) WHERE n > 0 GROUP BY ALL),
si AS (SELECT slice_type, slice_value, split, model, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, quantile_cont(o, 0.025) AS lo_over_sigma, quantile_cont(o, 0.975) AS hi_over_sigma, stddev_samp(d) AS se FROM sb GROUP BY ALL),
sv AS (SELECT *, 2.8015852181 * se AS mde_80, CASE WHEN lo <= 0 AND hi >= 0 THEN 'within noise' WHEN hi < 0 THEN 'model better' ELSE 'model worse' END AS flag FROM si)"""
_SD = """sx AS (SELECT slice_type, slice_value, split, model, count(*) AS n_tasks, CAST(sum(n_mols) AS BIGINT) AS n_mols, avg(sqrt(e2 / n) - sqrt(base_e2 / n)) AS delta_rmse,
      avg(CASE WHEN sigma > 0 THEN (sqrt(e2 / n) - sqrt(base_e2 / n)) / sigma END) AS delta_over_sigma FROM pd LEFT JOIN (SELECT task, sigma FROM c) USING (task) GROUP BY ALL)"""
_CL = _X + """,
dv AS (SELECT lang AS task, doc_id AS mol_id, log10(n_chars + 1) AS y, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM x),
cp AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS "both" FROM g a JOIN g b USING (feature) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
ca AS (SELECT u.task, a, b, u.part AS pa, v.part AS pb, CAST("both" AS DOUBLE) / (an + bn - "both") AS similarity, abs(u.y - v.y) AS delta FROM cp JOIN dv u ON a = u.mol_id JOIN dv v ON b = v.mol_id
       WHERE u.task = v.task AND "both" * 1000 >= (an + bn - "both") * 800 AND abs(u.y - v.y) >= 2e-2)"""
_V = _M + """,
vm AS (SELECT *, structure || '-' || (assay_id % 2) AS full_key FROM m), vk AS (SELECT task, mol_id, count(DISTINCT full_key) AS k FROM vm GROUP BY ALL),
vd AS (SELECT task, mol_id, doc_id, avg(y) AS y, array_to_string(list_sort(list_distinct(list(full_key))), ';') AS keys FROM vm JOIN (SELECT task, mol_id FROM vk WHERE k > 1) USING (task, mol_id) GROUP BY ALL),
vp AS (SELECT a.task, a.keys = b.keys AS same, abs(a.y - b.y) AS delta FROM vd a JOIN vd b ON a.task = b.task AND a.mol_id = b.mol_id AND a.doc_id < b.doc_id)"""

_CEIL_DRAWS = """
      bn AS (SELECT task, CASE WHEN dof > 0 THEN ss / dof END AS v, CASE WHEN sw > 0 THEN inv / sw END AS k, CASE WHEN sw > 1 THEN (s2 - s1 * s1 / sw) / (sw - 1) END AS var_y FROM bs),
      bd AS (SELECT task, sqrt(v) AS sigma, sqrt(v * k) AS rmse_floor, CASE WHEN v IS NOT NULL AND var_y > 0 THEN least(1e0, greatest(0e0, 1 - v * k / var_y)) END AS r2_max FROM bn) SELECT task, """ + ", ".join(_iv(c, c) for c in ("sigma", "rmse_floor", "r2_max")) + ", count(sigma) AS n_valid_draws FROM bd GROUP BY task"
#: Entities by structure against the registry of :func:`catalogue.entity_flags`; equal words mean equal order here, so that nothing is near only.
_EF = _M + """,
er AS (SELECT DISTINCT p_brand || ' ' || p_type AS structure, 'src' || (p_size - 1) AS source FROM part WHERE p_size <= 3),
es AS (SELECT structure, list_sort(list_distinct(list(source))) AS src FROM er GROUP BY structure),
ef AS (SELECT m.*, es.src FROM m LEFT JOIN es USING (structure)),
em AS (SELECT task, mol_id, any_value(src) AS src, count(*) AS n, count(*) FILTER (year > 1999) AS late FROM ef GROUP BY task, mol_id),
el AS (SELECT task, count(*) AS mols, CAST(sum(n) AS BIGINT) AS meas, count(*) FILTER (src IS NOT NULL) AS m1, CAST(coalesce(sum(n) FILTER (src IS NOT NULL), 0) AS BIGINT) AS x1,
       count(*) FILTER (src IS NULL AND late = 0) AS m4, CAST(coalesce(sum(n - late) FILTER (src IS NULL), 0) AS BIGINT) AS x4 FROM em GROUP BY task)"""
_MT = _EF + ", " + _CUT + """,
mb AS (SELECT task, model, cutoff, basis, count(DISTINCT mol_id) FILTER (year > cut_year) AS mols_after_year, count(*) FILTER (year > cut_year) AS n_meas, count(DISTINCT mol_id) AS mols_after_steps12 FROM ef, cu WHERE src IS NULL GROUP BY ALL),
mo AS (SELECT task, model, CASE WHEN any_value(sources) IS NOT NULL THEN avg(CASE WHEN list_has_any(src, sources) THEN 1e0 ELSE 0e0 END) END AS overlap, count(*) AS n_entities FROM em, cu GROUP BY task, model),
mz AS (SELECT * FROM mb JOIN mo USING (task, model))"""

_RAW = {
    "task_ceiling": "WITH" + _S + _ceil("n >= 2 AND range <= 3", "task"),
    "ceiling_sensitivity": "WITH" + _S + ", gr(min_docs, max_range) AS (VALUES (2, NULL), (2, 6e-1), (2, 4e-1), (2, 2e-1), (3, NULL), (3, 6e-1), (3, 4e-1), (3, 2e-1)), sg AS (SELECT s.*, min_docs, max_range FROM s, gr)"
    + _ceil("n >= min_docs AND (max_range IS NULL OR range <= max_range)", "task, min_docs, max_range", "sg"),
    "doc_level": "WITH" + _D + "SELECT task, mol_id, doc_id, y FROM d",
    "molecule_aggregate": "WITH" + _E + "SELECT task, mol_id, y, n_docs, first_year, structure FROM e",
    "entity_stats": "WITH" + _S + "SELECT * FROM s",
    "task_summary": "WITH" + _S + """SELECT task, split_part(task, '_', 1) AS target, split_part(task, '_', 2) AS type, n_mols, n_rep_mols, n_docs, n_rep_mols >= 100 AS passes
      FROM (SELECT task, count(*) AS n_mols, count(*) FILTER (n >= 2) AS n_rep_mols FROM s GROUP BY task) JOIN (SELECT task, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY task) USING (task)""",
    "label_noise_factor": "WITH" + _S + "SELECT task, avg(1e0 / n) AS inv_docs FROM s GROUP BY task",
    "ceiling_single_label": "WITH" + _S + ", dv AS (SELECT task, var_samp(y) AS v FROM d GROUP BY task), s2 AS (SELECT s.*, v FROM s JOIN dv USING (task))"
    + _ceil("n >= 2 AND range <= 3", "task", "s2", "1", "any_value(v)"),
    "replicate_windows": "WITH" + _D + """SELECT task, mol_id, doc_id, y, count(*) OVER w AS n, max(y) OVER w - min(y) OVER w AS range, y - avg(y) OVER w AS deviation,
      CASE WHEN count(*) OVER w > 1 THEN (sum(y) OVER w - y) / (count(*) OVER w - 1) END AS others FROM d WINDOW w AS (PARTITION BY task, mol_id)""",
    "ceiling_bootstrap_hash": "WITH" + _S + ",\n" + _picks("s", "task") + """,
      bs AS (SELECT task, b, sum(w * ss) FILTER (n >= 2 AND range <= 3) AS ss, sum(w * (n - 1)) FILTER (n >= 2 AND range <= 3) AS dof, sum(w) AS sw, sum(w * mean) AS s1, sum(w * mean * mean) AS s2, sum(w * 1e0 / n) AS inv
             FROM s JOIN wt USING (task, mol_id) GROUP BY ALL),""" + _CEIL_DRAWS,
    "ceiling_bootstrap_poisson": "WITH" + _S + """,
      s9 AS (SELECT task, mol_id, CASE WHEN n >= 2 AND range <= 3 THEN ss ELSE 0e0 END AS ss, CASE WHEN n >= 2 AND range <= 3 THEN CAST(n - 1 AS DOUBLE) ELSE 0e0 END AS dof, 1e0 AS sw, mean AS s1, mean * mean AS s2, 1e0 / n AS inv FROM s),
      """ + _poisson("s9", "task", ("ss", "dof", "sw", "s1", "s2", "inv"), name="bs") + "," + _CEIL_DRAWS,
    "doc_pairs": "WITH" + _PAIRS + " SELECT * FROM q",
    "within_doc_pairs": "WITH" + _M + "," + _WQ + " SELECT * FROM wq",
    "delta_profile": "WITH" + _PAIRS + "," + _WQ + " " + _profile("q", "between_docs") + " UNION ALL " + _profile("wq", "within_doc"),
    "big_pairs": "WITH" + _PAIRS + " SELECT q.task, q.mol_id, doc_a, doc_b, delta, t.structure, delta >= 0.9 AS very_big FROM q LEFT JOIN (SELECT task, mol_id, any_value(structure) AS structure FROM m GROUP BY ALL) t ON q.task = t.task AND q.mol_id = t.mol_id WHERE delta >= 0.8",
    "sigma_from_pairs": "WITH" + _PAIRS + """ SELECT task, sqrt(avg(delta * delta) / 2) AS sigma_pairs, sqrt(avg(delta * delta) FILTER (d_year <= 3) / 2) AS sigma_near, sqrt(avg(delta * delta) FILTER (d_year > 3) / 2) AS sigma_far,
      count(*) FILTER (d_year <= 3) AS n_near, count(*) FILTER (d_year > 3) AS n_far, avg(CASE WHEN same_assays THEN 1e0 ELSE 0e0 END) AS frac_same_assays FROM q GROUP BY task""",
    "spearman_delta_year": "WITH" + _PAIRS + f", r AS (SELECT task, {_rank('delta', 'task')} AS r, {_rank('d_year', 'task')} AS ry, {_rank('mean_y', 'task')} AS rm FROM q) SELECT task, count(*) AS n_pairs, {_corr('r', 'ry')} AS rho_year, {_corr('r', 'rm')} AS rho_mean FROM r GROUP BY task",
    "doc_shift": "WITH" + _D + ",\n" + _shift("SELECT task, mol_id, doc_id, y FROM d", "doc_id"),
    "assay_shift": "WITH" + _M + ",\n" + _shift("SELECT task, mol_id, assay_id, avg(y) AS y FROM m GROUP BY ALL", "assay_id"),
    "audit_summary": "WITH" + _S + """SELECT u.*, n_mols, n_ge2, n_ge3, frac_ge2, CAST(top AS DOUBLE) / n_mols AS top_doc_share FROM
      (SELECT task, count(*) AS n_meas, count(DISTINCT doc_id) AS n_docs, count(DISTINCT assay_id) AS n_assays, min(year) AS year_min, max(year) AS year_max FROM m GROUP BY task) u
      JOIN (SELECT task, count(*) AS n_mols, count(*) FILTER (n >= 2) AS n_ge2, count(*) FILTER (n >= 3) AS n_ge3, avg(CASE WHEN n >= 2 THEN 1e0 ELSE 0e0 END) AS frac_ge2 FROM s GROUP BY task) USING (task)
      JOIN (SELECT task, max(k) AS top FROM (SELECT task, doc_id, count(*) AS k FROM d GROUP BY ALL) GROUP BY task) USING (task)""",
    "assays_per_doc": "WITH" + _M + "SELECT task, avg(k) AS assays_per_doc FROM (SELECT task, doc_id, count(DISTINCT assay_id) AS k FROM m GROUP BY ALL) GROUP BY task",
    "type_compare": "WITH" + _M + f""", td AS (SELECT target, type, mol_id, doc_id, avg(y) AS y FROM m GROUP BY ALL), tm AS (SELECT target, type, mol_id, avg(y) AS y FROM td GROUP BY ALL),
      tb AS (SELECT a.target, a.y AS a, b.y AS b, b.y - a.y AS d FROM tm a JOIN tm b ON a.target = b.target AND a.mol_id = b.mol_id AND a.type = 'IC50' AND b.type = 'Ki'),
      tr AS (SELECT *, {_rank('a', 'target')} AS ra, {_rank('b', 'target')} AS rb FROM tb),
      tk AS (SELECT target, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff, quantile_cont(d, 0.5) AS median_diff, {_corr('a', 'b')} AS pearson, {_corr('ra', 'rb')} AS spearman FROM tr GROUP BY target HAVING count(*) >= 5),
      tn AS (SELECT target, type, CASE WHEN sum(n - 1) FILTER (n >= 2) > 0 THEN sqrt(sum(ss) FILTER (n >= 2) / sum(n - 1) FILTER (n >= 2)) END AS sigma
             FROM (SELECT target, type, mol_id, count(*) AS n, var_pop(y) * count(*) AS ss FROM td GROUP BY ALL) GROUP BY ALL),
      tc AS (SELECT target, count(*) AS n_both FROM tb GROUP BY target)
      SELECT i.target, coalesce(n_both, 0) AS n_both, mean_diff, sd_diff, median_diff, pearson, spearman, i.sigma AS sigma_ic50, k.sigma AS sigma_ki
      FROM tn i JOIN tn k ON i.target = k.target AND i.type = 'IC50' AND k.type = 'Ki' LEFT JOIN tc ON tc.target = i.target LEFT JOIN tk ON tk.target = i.target""",
    "multi_variant": "WITH" + _V + """SELECT * FROM (SELECT task, count(*) FILTER (k > 1) AS n_multi, avg(CASE WHEN k > 1 THEN 1e0 ELSE 0e0 END) AS frac_multi FROM vk GROUP BY task)
      LEFT JOIN (SELECT task, count(*) FILTER (same) AS n_same, avg(delta) FILTER (same) AS delta_same, count(*) FILTER (NOT same) AS n_other, avg(delta) FILTER (NOT same) AS delta_other FROM vp GROUP BY task) USING (task)""",
    "exact_match_flags": "WITH" + _X + "SELECT doc_id, coalesce(key_short, CAST(doc_id AS VARCHAR)) AS key_short, exact_full, exact_short, array_to_string(exact_sources, ';') AS exact_sources FROM fl",
    "exact_rate": "WITH" + _X + "SELECT avg(CASE WHEN exact_full THEN 1e0 ELSE 0e0 END) AS full_rate, avg(CASE WHEN exact_short THEN 1e0 ELSE 0e0 END) AS short_rate, count(*) AS n FROM fl",
    "near_duplicates": "WITH" + _J + ', rd AS (SELECT min(doc_id) AS reg_id FROM rg GROUP BY key_full) SELECT doc_id, reg_id, "both", similarity FROM j JOIN rd USING (reg_id) WHERE "both" * 1000 > (an + bn - "both") * 800',
    "max_similarity": "WITH" + _J + "SELECT * FROM sm",
    "decontam_funnel": "WITH" + _F + "SELECT * FROM lg",
    "loss_totals": "WITH" + _F + "SELECT step, CAST(sum(removed) AS BIGINT) AS removed FROM lg GROUP BY step",
    "loss_last": "WITH" + _F + 'SELECT source, "left", step FROM lg WHERE step_no = 3',
    "loss_pivot": "WITH" + _F + "SELECT source, CAST(0 AS BIGINT) AS raw, f AS exact_full, h AS exact_short, r AS near FROM st",
    "year_filter": "WITH" + _M + "SELECT task, count(*) AS n, count(DISTINCT mol_id) AS n_mols FROM m WHERE year > 1998 GROUP BY task",
    "model_cutoffs": "WITH" + _MT + " SELECT task, model, cutoff, basis, mols_after_year, n_meas, mols_after_steps12, overlap, n_entities FROM mz",
    "model_overlap": "WITH" + _X + ", " + _CUT + "SELECT model, CASE WHEN any_value(sources) IS NOT NULL THEN avg(CASE WHEN list_has_any(exact_sources, sources) THEN 1e0 ELSE 0e0 END) END AS overlap, count(*) AS n_entities FROM fl, cu GROUP BY model",
    "source_overlap": "WITH" + _X + "SELECT source, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fl) AS share FROM (SELECT unnest(exact_sources) AS source FROM fl) GROUP BY source",
    "similarity_quantiles": "WITH" + _J + "SELECT " + ", ".join(f"quantile_cont(similarity, {p}) AS q{int(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM sm",
    "similarity_histogram": "WITH" + _J + "SELECT CAST(" + " + ".join(f"CASE WHEN similarity >= CAST({k / 10!r} AS DOUBLE) THEN 1 ELSE 0 END" for k in range(1, 10)) + " AS INTEGER) AS bin, count(*) AS n FROM sm GROUP BY 1",
    "threshold_sweep": "WITH" + _J + ", sn AS (SELECT sm.*, exact_full OR exact_short AS exact FROM sm JOIN fl USING (doc_id)) SELECT threshold, count(*) FILTER (similarity > threshold AND NOT exact) AS removed, CAST(count(*) FILTER (similarity > threshold AND NOT exact) AS DOUBLE) / count(*) AS share FROM sn, (SELECT unnest([5e-1, 6e-1, 7e-1, 8e-1, 9e-1, 95e-2]) AS threshold) GROUP BY threshold",
    "containment_hits": "WITH" + _X + """, bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS words FROM benchmark),
      bg AS (SELECT item_id, len(gs) AS n, unnest(gs) AS feature FROM (SELECT item_id, list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gs FROM bw WHERE len(words) >= 1))
      SELECT item_id, doc_id, count(*) AS "both", CAST(count(*) AS DOUBLE) / any_value(bg.n) AS containment FROM bg JOIN g USING (feature) GROUP BY item_id, doc_id HAVING CAST(count(*) AS DOUBLE) / any_value(bg.n) >= 0.8""",
    "registry_totals": "WITH" + _X + "SELECT source, count(*) AS n, count(DISTINCT key_full) AS n_full, count(DISTINCT key_short) AS n_short FROM rg GROUP BY source UNION ALL SELECT NULL, count(*), count(DISTINCT key_full), count(DISTINCT key_short) FROM rg",
    "registry_upsert": "WITH" + _X + "SELECT source, count(*) AS n FROM x WHERE source IN ('src0', 'src1', 'src2') GROUP BY source UNION ALL SELECT source, count(*) * 10 FROM x WHERE source IN ('src3', 'src4') GROUP BY source",
    "split_random": "WITH" + _P + "SELECT task, mol_id, part FROM pr",
    "split_temporal": "WITH" + _P + "SELECT task, mol_id, part FROM pt",
    "split_scaffold": "WITH" + _P + "SELECT task, mol_id, part FROM pc WHERE seed = 0",
    "predictions_long": "WITH" + _P + "SELECT * FROM p",
    "predictions_completion": "WITH" + _P + "SELECT * FROM p",
    "regression_metrics": "WITH" + _B + "SELECT task, split, seed, model, n_test, rmse, mae, r2, spearman FROM mt",
    "benchmark_rows": "WITH" + _B + "SELECT * FROM bm",
    "add_ceiling": "WITH" + _A + "SELECT * FROM ac",
    "per_task_fraction": "WITH" + _A + "SELECT * FROM pk",
    "common_rows": "WITH" + _P + """, px AS (SELECT * FROM p WHERE NOT (model = 'mean_by_type' AND mol_id % 7 = 0)), pf AS (SELECT task, split, seed, mol_id FROM px GROUP BY ALL HAVING count(DISTINCT model) = 4),
      pz AS (SELECT task, split, model, count(*) AS n_common_rows, sqrt(avg((y - pred) ** 2)) AS rmse, sqrt(avg((y - y_train_mean) ** 2)) AS rmse_mean, any_value(sigma) * sqrt(avg(1e0 / n_docs)) AS floor
             FROM px JOIN pf USING (task, split, seed, mol_id) JOIN (SELECT task, sigma FROM c) USING (task) GROUP BY ALL)
      SELECT task, split, model, n_common_rows, CASE WHEN rmse_mean - floor > 0 THEN (rmse_mean - rmse) / (rmse_mean - floor) END AS frac_ceiling FROM pz""",
    "leaderboard": "WITH" + _A + f", lb AS (SELECT split, model, count(DISTINCT task) AS n_tasks, {_MEANS} FROM pk GROUP BY ALL) SELECT *, CAST(rank() OVER (PARTITION BY split ORDER BY round(frac_ceiling, 9) DESC NULLS LAST) AS INTEGER) AS place FROM lb",
    "paired_vs_baseline": "WITH" + _A + """, pd AS (SELECT a.split, a.model, a.frac_ceiling - b.frac_ceiling AS d, a.rmse - b.rmse AS dr FROM pk a JOIN pk b ON a.task = b.task AND a.split = b.split AND b.model = 'mean_by_brand' WHERE a.model <> 'mean_by_brand')
      SELECT split, model, count(d) AS n_tasks, avg(d) AS mean_diff, quantile_cont(d, 0.5) AS median_diff, count(*) FILTER (d > 0) AS n_better, avg(dr) AS mean_diff_rmse FROM pd GROUP BY ALL""",
    "attenuation": "WITH" + _A + """, rl AS (SELECT *, CASE WHEN var_y > 0 AND rmse_floor IS NOT NULL THEN least(1e0, greatest(0e0, 1 - rmse_floor ** 2 / var_y)) END AS reliability FROM ac)
      SELECT task, split, seed, model, reliability, CASE WHEN reliability > 0 THEN r2 / reliability END AS r2_true, CASE WHEN reliability > 0 THEN spearman / sqrt(reliability) END AS rho_true FROM rl""",
    "holm_bh": "WITH" + _B + """, h AS (SELECT task, split, seed, model, round(abs(r2), 6) AS p FROM bm), hk AS (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY p, task, split, seed, model) AS i FROM h WHERE p IS NOT NULL)
      SELECT h.task, h.split, h.seed, h.model, h.p, p_holm, p_bh FROM h LEFT JOIN (SELECT task, split, seed, model, least(1e0, max((k - i + 1) * p) OVER (ORDER BY i)) AS p_holm,
        least(1e0, min(CAST(k AS DOUBLE) / i * p) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM hk) u ON h.task = u.task AND h.split = u.split AND h.seed = u.seed AND h.model = u.model""",
    "slice_labels": "WITH" + _L + "SELECT * FROM sl",
    "slice_delta": "WITH" + _L + ", " + _SD + " SELECT * FROM sx",
    "slice_intervals": "WITH" + _SI + " SELECT * FROM sv",
    "cliff_pairs": "WITH" + _CL + "SELECT task, a, b, similarity, delta FROM ca WHERE a < b",
    "cliff_mask": "WITH" + _CL + "SELECT task, mol_id, mol_id IN (SELECT a FROM ca WHERE pb = 'train') AS cliff FROM dv WHERE part = 'test'",
    "cliff_pair_metrics": "WITH" + _L + """, zz AS (SELECT u.task, u.split, u.seed, u.mol_id AS a, v.mol_id AS b FROM xt u JOIN sp ON u.structure = sp.structure AND sim >= 8e-1 JOIN xt v ON u.task = v.task AND u.split = v.split AND u.seed = v.seed AND v.structure = sp.other
        AND u.mol_id < v.mol_id AND abs(u.y - v.y) >= 15e-1)
      SELECT x.task, x.split, x.seed, x.model, count(*) AS n_pairs, avg(CASE WHEN sign(x.y - v.y) = sign(x.pred - v.pred) THEN 1e0 ELSE 0e0 END) AS sign_acc, sqrt(avg(((x.y - v.y) - (x.pred - v.pred)) ** 2)) AS rmse_delta
      FROM zz JOIN p x ON zz.task = x.task AND zz.split = x.split AND zz.seed = x.seed AND zz.a = x.mol_id JOIN p v ON zz.task = v.task AND zz.split = v.split AND zz.seed = v.seed AND zz.b = v.mol_id AND x.model = v.model GROUP BY ALL""",
    "similarity_to_train": "WITH" + _CL + """, sx AS (SELECT dv.task, dv.mol_id, coalesce(max(CAST("both" AS DOUBLE) / (an + bn - "both")), 0e0) AS similarity FROM dv LEFT JOIN
        (SELECT cp.* FROM cp JOIN dv ON b = mol_id WHERE part = 'train') q ON q.a = dv.mol_id WHERE part = 'test' GROUP BY ALL)
      SELECT *, CASE WHEN similarity < 0.4 THEN '<0.4' WHEN similarity < 0.6 THEN '0.4-0.6' WHEN similarity < 0.8 THEN '0.6-0.8' ELSE '>=0.8' END AS sim_bin FROM sx""",
    "ks_statistic": "WITH" + _P + """, kc AS (SELECT task, y, count(*) FILTER (part = 'test') AS a, count(*) FILTER (part <> 'test') AS b FROM pr GROUP BY ALL),
      ku AS (SELECT task, abs(CAST(sum(a) OVER u AS DOUBLE) / sum(a) OVER v - CAST(sum(b) OVER u AS DOUBLE) / sum(b) OVER v) AS gap FROM kc WINDOW u AS (PARTITION BY task ORDER BY y ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY task))
      SELECT task, max(gap) AS ks FROM ku GROUP BY task""",
    "comparison_artifacts": "WITH" + _L + """, kc AS (SELECT task, split, seed, y, count(*) FILTER (part = 'test') AS a, count(*) FILTER (part <> 'test') AS b FROM pa GROUP BY ALL),
      ku AS (SELECT task, split, seed, abs(CAST(sum(a) OVER u AS DOUBLE) / sum(a) OVER v - CAST(sum(b) OVER u AS DOUBLE) / sum(b) OVER v) AS gap FROM kc WINDOW u AS (PARTITION BY task, split, seed ORDER BY y ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY task, split, seed)),
      kk AS (SELECT task, split, seed, max(gap) AS ks FROM ku GROUP BY ALL),
      ar AS (SELECT task, split, seed, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test, avg(n_docs) FILTER (part = 'test') AS mean_n_docs, avg(CASE WHEN n_docs >= 2 THEN 1e0 ELSE 0e0 END) FILTER (part = 'test') AS frac_ge2,
        avg(1e0 / n_docs) FILTER (part = 'test') AS inv, avg(y) FILTER (part = 'train') AS y_mean_train, avg(y) FILTER (part = 'test') AS y_mean_test, stddev_pop(y) FILTER (part = 'train') AS y_sd_train, stddev_pop(y) FILTER (part = 'test') AS y_sd_test,
        quantile_cont(y, 0.05) FILTER (part = 'train') AS q05, quantile_cont(y, 0.95) FILTER (part = 'train') AS q95, quantile_cont(CAST(first_year AS DOUBLE), 0.5) FILTER (part = 'train') AS year_train, quantile_cont(CAST(first_year AS DOUBLE), 0.5) FILTER (part = 'test') AS year_test FROM pa GROUP BY ALL),
      ou AS (SELECT task, split, seed, avg(CASE WHEN y < q05 OR y > q95 THEN 1e0 ELSE 0e0 END) AS frac_outside FROM pa JOIN ar USING (task, split, seed) WHERE part = 'test' GROUP BY ALL),
      nr AS (SELECT task, split, seed, avg(max_sim) AS maxsim_mean, quantile_cont(max_sim, 0.5) AS maxsim_median, quantile_cont(max_sim, 0.1) AS maxsim_q10, quantile_cont(max_sim, 0.9) AS maxsim_q90, avg(CASE WHEN max_sim >= 8e-1 THEN 1e0 ELSE 0e0 END) AS frac_maxsim_ge_08,
        avg(CASE WHEN cliff THEN 1e0 ELSE 0e0 END) AS frac_cliff_mols FROM cx GROUP BY ALL)
      SELECT task, split, seed, n_train, n_test, mean_n_docs, frac_ge2, sigma * sqrt(inv) AS rmse_floor, CASE WHEN y_sd_test > 0 THEN sigma * sqrt(inv) / y_sd_test END AS floor_over_sd, y_mean_train, y_mean_test, y_sd_train, y_sd_test,
        CASE WHEN y_sd_train > 0 THEN y_sd_test / y_sd_train END AS sd_ratio, ks, frac_outside, maxsim_mean, maxsim_median, maxsim_q10, maxsim_q90, frac_maxsim_ge_08, frac_cliff_mols, year_train, year_test
      FROM ar LEFT JOIN ou USING (task, split, seed) LEFT JOIN kk USING (task, split, seed) LEFT JOIN nr USING (task, split, seed) LEFT JOIN (SELECT task, sigma FROM c) USING (task)""",
    "decontam_loss": "WITH" + _EF + """ SELECT task, u.step_no, u.step, u.mr AS mols_removed, u.xr AS meas_removed, u.ml AS mols_left, u.xl AS meas_left FROM el,
      LATERAL (SELECT unnest([0, 1, 2, 3, 4]) AS step_no, unnest(['raw', 'exact_full', 'exact_short', 'near', 'year>1999']) AS step, unnest([0, m1, 0, 0, m4]) AS mr, unnest([0, x1, 0, 0, x4]) AS xr,
        unnest([mols, mols - m1, mols - m1, mols - m1, mols - m1 - m4]) AS ml, unnest([meas, meas - x1, meas - x1, meas - x1, meas - x1 - x4]) AS xl) u""",
    "model_summary": "WITH" + _MT + " SELECT model, cutoff, basis, CAST(sum(mols_after_year) AS BIGINT) AS mols_after_year, sum(overlap * n_entities) / sum(CASE WHEN overlap IS NOT NULL THEN n_entities END) AS overlap FROM mz GROUP BY ALL",
    "slice_table": "WITH" + _SI + ", " + _SD + " SELECT sx.*, lo, hi, lo_over_sigma, hi_over_sigma, se, mde_80, flag FROM sx JOIN sv USING (slice_type, slice_value, split, model)",
    "parse_records": """SELECT CAST(o_custkey AS VARCHAR) AS target_id, CAST(o_orderkey AS VARCHAR) AS molecule_id, o_orderpriority AS structure, o_orderstatus AS standard_type, CAST(o_custkey AS DOUBLE) AS value,
      CAST(o_custkey % 13 AS VARCHAR) AS assay_id, CAST(o_custkey AS VARCHAR) AS doc_id, CAST(year(o_orderdate) AS INTEGER) AS doc_year FROM orders
      WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_custkey % 13 >= 8""",
    "embedding_lookup": "SELECT label, count(*) AS n, avg(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS mean_square FROM embeddings GROUP BY label",
    "ridge_gram": """WITH v AS (SELECT list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [1e0, CAST(label AS DOUBLE)]) AS x FROM embeddings),
      i AS (SELECT x, CAST(unnest(range(0, len(x))) AS INTEGER) AS i FROM v), j AS (SELECT x, i, CAST(unnest(range(0, len(x))) AS INTEGER) AS j FROM i)
      SELECT i, j, sum(x[i + 1] * x[j + 1]) AS v FROM j WHERE i <= j GROUP BY ALL""",
    "value_quantiles": "WITH" + _M + "SELECT task, quantile_cont(y, 0.05) AS q05, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.95) AS q95 FROM m GROUP BY task",
    "cutoff_table": "WITH " + _CUT + "SELECT model, CAST(cutoff AS VARCHAR) AS cutoff, basis, cut_year FROM cu",
}



for _mode, _fd in _FD.items():
    _RAW |= {
        f"cluster_bootstrap_{_mode}": "WITH" + _fd + f" SELECT task, split, model, {_iv('frac', 'frac')}, {_iv('rmse', 'rmse')}, count(frac) AS n_valid_draws FROM fd GROUP BY ALL",
        f"aggregate_bootstrap_{_mode}": "WITH" + _fd + f" SELECT split, model, {_iv('frac', 'frac')} FROM (SELECT split, model, b, avg(frac) AS frac FROM fd GROUP BY ALL) GROUP BY ALL",
        f"paired_bootstrap_{_mode}": "WITH" + _fd + f""", pd AS (SELECT a.task, a.split, a.model, a.frac - b.frac AS d FROM fd a JOIN fd b ON a.task = b.task AND a.split = b.split AND a.b = b.b AND b.model = 'mean_by_brand' WHERE a.model <> 'mean_by_brand' AND a.frac IS NOT NULL AND b.frac IS NOT NULL),
      pq AS (SELECT task, split, model, {_iv('d', 'diff')}, least(1e0, 2 * least(avg(CASE WHEN d <= 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN d >= 0 THEN 1e0 ELSE 0e0 END))) AS p_boot FROM pd GROUP BY ALL) SELECT *, diff_lo <= 0 AND diff_hi >= 0 AS inside_noise FROM pq""",
    }
_FILTERED = " UNION ALL ".join("SELECT '" + n + "' AS filter, * FROM (" + _ceil("n >= 2" + (f" AND range <= {r}" if r else ""), "task") + ")" for n, r in (("nofilter", None), ("diff3", 3), ("diff2", 2)))
_RAW["audit_table"] = f"""SELECT a.*, n.* EXCLUDE (task), p.* EXCLUDE (task), r.* EXCLUDE (task), f.* EXCLUDE (task), d.assays_per_doc AS assays_per_doc_mean, v.n_multi AS n_mols_multi_fullkey, v.frac_multi AS frac_mols_multi_fullkey
FROM ({_RAW["audit_summary"]}) a
LEFT JOIN (WITH {_S} SELECT task, {", ".join(f"max(sigma) FILTER (filter = '{n}') AS sigma_{n}, max(n_mols_rep) FILTER (filter = '{n}') AS n_rep_mols_{n}" for n in ("nofilter", "diff3", "diff2"))} FROM ({_FILTERED}) GROUP BY task) n ON n.task = a.task
LEFT JOIN (SELECT task, sigma_near AS sigma_pairs_dyear_le3, sigma_far AS sigma_pairs_dyear_gt3, n_near AS n_pairs_dyear_le3, n_far AS n_pairs_dyear_gt3, frac_same_assays AS frac_pairs_same_assay_id FROM ({_RAW["sigma_from_pairs"]})) p ON p.task = a.task
LEFT JOIN (SELECT task, rho_year AS spearman_delta_dyear, rho_mean AS spearman_delta_mean FROM ({_RAW["spearman_delta_year"]})) r ON r.task = a.task
LEFT JOIN (SELECT task, count(*) FILTER (flag_shift) AS n_docs_flag_shift, count(*) AS n_docs_in_shift FROM ({_RAW["doc_shift"]}) GROUP BY task) f ON f.task = a.task
LEFT JOIN ({_RAW["assays_per_doc"]}) d ON d.task = a.task LEFT JOIN ({_RAW["multi_variant"]}) v ON v.task = a.task"""


def _typed(name: str) -> str:
    """The query with its columns in the types of its contract, doubles at six decimals, no zero negative."""
    columns = (c.split() for c in COLUMNS[name].split(", "))
    out = [f'round(CAST("{c}" AS DOUBLE), 6) + 0e0 AS "{c}"' if t == "double" else f'CAST("{c}" AS {t.upper()}) AS "{c}"' for c, t in columns]
    raw = _RAW[name].replace("WITH", "WITH RECURSIVE", 1) if "pc AS" in _RAW[name] else _RAW[name]
    return f"SELECT {', '.join(out)} FROM ({raw})"


SQL = {name: _typed(name) for name in _RAW}
