"""DuckDB oracles of the statistics and model queries that SQL can express."""

from checks.oracle_catalogue import CLEAN
from checks.views import with_views

MATRIX_1 = ["price", "discount", "depth", "height", "width", "v_furniture",
            "other_category_le", "other_colors_le"]
MATRIX_2 = ["price", "depth", "height", "width", "v_furniture", "s3", "s2", "s1"]
FEATURES = ["depth", "height", "width", "s1", "s2", "s3"]

PREP = with_views("items") + f""",
cl AS (SELECT item_id, category, price, {CLEAN} - price AS discount, depth, height, width,
              CAST(dense_rank() OVER (ORDER BY other_colors) - 1 AS INTEGER) AS other_colors_le,
              CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS other_category_le
       FROM items),
imp AS (SELECT * REPLACE (
          coalesce(width, median(width) OVER (PARTITION BY category)) AS width,
          coalesce(height, median(height) OVER (PARTITION BY category)) AS height,
          coalesce(depth, median(depth) OVER (PARTITION BY category)) AS depth)
        FROM cl),
prep AS (SELECT *, depth * height * width / 1000000.0 AS v_furniture, depth * height AS s1,
                width * height AS s2, width * depth AS s3 FROM imp)"""

ML = PREP + """,
ml AS (SELECT item_id, """ + ", ".join(f"round_even({c}, 2) AS {c}" for c in FEATURES) + """,
              CAST(trunc(round_even(price, 2)) AS INTEGER) AS label
       FROM prep
       WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES) + ")"

SPLIT = "CASE WHEN CAST(('0x' || substr(md5(CAST({id} AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 7 THEN 'train' ELSE 'test' END"


def _spearman(cols):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    long = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS DOUBLE) AS xa, CAST({b} AS DOUBLE) AS xb "
        f"FROM prep WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    diag = "\nUNION ALL\n".join(f"SELECT '{c}', '{c}', 1.0" for c in cols)
    return PREP + f""",
long AS ({long}),
r AS (SELECT col_a, col_b,
             rank() OVER (PARTITION BY col_a, col_b ORDER BY xa)
               + (count(*) OVER (PARTITION BY col_a, col_b, xa) - 1) / 2.0 AS ra,
             rank() OVER (PARTITION BY col_a, col_b ORDER BY xb)
               + (count(*) OVER (PARTITION BY col_a, col_b, xb) - 1) / 2.0 AS rb
      FROM long),
off AS (SELECT col_a, col_b, corr(ra, rb) AS rho FROM r GROUP BY 1, 2),
m AS (SELECT col_a, col_b, rho FROM off
      UNION ALL SELECT col_b, col_a, rho FROM off
      UNION ALL {diag})"""


EMB = f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS DOUBLE) AS label,
                  {SPLIT.format(id="vec_id")} AS split FROM embeddings),
tr AS (SELECT * FROM e WHERE split = 'train'),
te AS (SELECT * FROM e WHERE split = 'test')"""


def _nbs(k, test="te"):
    return f""",
d AS (SELECT q.id AS qid, t.id AS tid, t.label, list_distance(q.v, t.v) AS dist
      FROM {test} q, tr t),
nb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS nb_rank FROM d
       QUALIFY nb_rank <= {k})"""


def _vote(k):
    return f"""(SELECT qid, label AS predicted FROM (
      SELECT qid, label, count(*) AS votes FROM nb WHERE nb_rank <= {k} GROUP BY qid, label)
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) = 1)"""


SQL = {
    "mann_whitney_u": with_views("items") + """,
d AS (SELECT price AS x, other_colors = 'No' AS in_a FROM items
      WHERE price IS NOT NULL AND other_colors IN ('No', 'Yes')),
r AS (SELECT x, in_a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM d),
s AS (SELECT CAST(count(*) FILTER (WHERE in_a) AS DOUBLE) AS n1,
             CAST(count(*) FILTER (WHERE NOT in_a) AS DOUBLE) AS n2,
             sum(rk) FILTER (WHERE in_a) AS r1 FROM r),
t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY x)),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2) AS u2, ties FROM s, t)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u1, u2,
       (greatest(u1, u2) - n1 * n2 / 2.0 - 0.5)
         / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z
FROM u""",
    "pearson": PREP + """
SELECT corr(price, v_furniture) AS r,
       count(*) FILTER (WHERE price IS NOT NULL AND v_furniture IS NOT NULL) AS n FROM prep""",
    "spearman_matrix": _spearman(MATRIX_1) + "\nSELECT * FROM m",
    "feature_selection": _spearman(MATRIX_2) + """
SELECT col_b AS feature, rho FROM m WHERE col_a = 'price' AND col_b <> 'price' AND abs(rho) > 0.3""",
    "feature_selection_sides": _spearman(["price", "s1", "s2", "s3"]) + """
SELECT col_b AS feature, rho FROM m WHERE col_a = 'price' AND col_b <> 'price' AND abs(rho) > 0.5""",
    "features": ML + "\nSELECT * FROM ml",
    "hash_split": ML + f"\nSELECT item_id, {SPLIT.format(id='item_id')} AS split FROM ml",
    "knn_classify": EMB + _nbs(3) + f"\nSELECT * FROM {_vote(3)}",
    "knn_accuracy_by_k": EMB + _nbs(9) + ",\n" + ",\n".join(
        f"v{k} AS {_vote(k)}" for k in range(1, 10)) + "\n" + "\nUNION ALL\n".join(
        f"SELECT {k} AS k, avg(CAST(v{k}.predicted = te.label AS DOUBLE)) AS accuracy "
        f"FROM v{k} JOIN te ON te.id = v{k}.qid" for k in range(1, 10)),
    "knn_predict_one": EMB + """,
c AS (SELECT CAST(0 AS BIGINT) AS id, [""" + ", ".join(
        f"avg(v[{i + 1}])" for i in range(64)) + """] AS v FROM e)""" + _nbs(1, "c") + f"""
SELECT * FROM {_vote(1)}""",
    "knn_train_accuracy": EMB + _nbs(1, "tr") + f""",
v AS {_vote(1)}
SELECT avg(CAST(v.predicted = tr.label AS DOUBLE)) AS accuracy FROM v JOIN tr ON tr.id = v.qid""",
}


def _horner(coefs, x):
    expr = repr(coefs[0])
    for c in coefs[1:]:
        expr = f"({expr}) * ({x}) + {c!r}"
    return expr


def _ppf(p):
    """AS 241 inverse normal CDF in SQL (published coefficients)."""
    from quarry.functions.normal import A, B, C, D, E, G
    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1.0 - ({p}) END))"
    near = f"({_horner(C, f'{r} - 1.6')}) / ({_horner(D, f'{r} - 1.6')})"
    far = f"({_horner(E, f'{r} - 5.0')}) / ({_horner(G, f'{r} - 5.0')})"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {near} ELSE {far} END)"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * ({_horner(A, rc)}) / ({_horner(B, rc)}) "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END")


SQL["shapiro_wilk_w"] = with_views("items") + f""",
x AS (SELECT price AS x FROM items WHERE price IS NOT NULL AND NOT isnan(price)),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM x),
m AS (SELECT x, i, n, {_ppf("(i - 0.375) / (n + 0.25)")} AS m FROM o),
a AS (SELECT n, sum(m * m) AS s, sum(CASE WHEN i > 2 AND i < n - 1 THEN m * x END) AS mx,
             max(CASE WHEN i = 1 THEN x END) AS x1, max(CASE WHEN i = 2 THEN x END) AS x2,
             max(CASE WHEN i = n - 1 THEN x END) AS xn1, max(CASE WHEN i = n THEN x END) AS xn,
             max(CASE WHEN i = n THEN m END) AS mn, max(CASE WHEN i = n - 1 THEN m END) AS mn1,
             var_samp(x) * (count(x) - 1) AS ss
      FROM m GROUP BY n),
c AS (SELECT *, 1.0 / sqrt(n) AS r FROM a),
d AS (SELECT *,
        mn / sqrt(s) + (0.221157 * r - 0.147981 * r ^ 2 - 2.07119 * r ^ 3 + 4.434685 * r ^ 4
                        - 2.706056 * r ^ 5) AS an,
        mn1 / sqrt(s) + (0.042981 * r - 0.293762 * r ^ 2 - 1.752461 * r ^ 3 + 5.682633 * r ^ 4
                         - 3.582633 * r ^ 5) AS an1
      FROM c),
e AS (SELECT *, sqrt((s - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)) AS fac
      FROM d)
SELECT n, least(1.0, (coalesce(mx, 0) / fac + an * (xn - x1) + an1 * (xn1 - x2)) ^ 2 / ss) AS w
FROM e"""

SQL["ols_one_feature"] = ML + f""",
sp AS (SELECT *, {SPLIT.format(id='item_id')} AS split FROM ml),
fit AS (SELECT regr_slope(label, s2) AS b, regr_intercept(label, s2) AS a FROM sp
        WHERE split = 'train'),
p AS (SELECT label, a + b * s2 AS prediction FROM sp, fit WHERE split = 'test')
SELECT 'linear_s2' AS model, sqrt(avg((label - prediction) ^ 2)) AS rmse,
       1 - avg((label - prediction) ^ 2) / var_pop(label) AS r2, count(*) AS n
FROM p"""

# every pair; a key of distance and place in (id, label) order makes the five smallest one aggregate
SQL["knn_regress"] = ML + f""",
sp AS (SELECT item_id, CAST(label AS DOUBLE) AS label, """ + ", ".join(
    f"CAST(round({c} * 100) AS BIGINT) AS {c}" for c in FEATURES) + f""", {SPLIT.format(id='item_id')} AS split FROM ml),
tr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY item_id, label) AS place, count(*) OVER () + 1 AS n
                    FROM sp WHERE split = 'train'),
te AS MATERIALIZED (SELECT *, row_number() OVER () AS q FROM sp WHERE split = 'test'),
best AS (SELECT q, any_value(te.label) AS truth, unnest(min((""" + " + ".join(
    f"(te.{c} - tr.{c}) * (te.{c} - tr.{c})" for c in FEATURES) + """) * tr.n + tr.place, 5)) % any_value(tr.n) AS place
         FROM te, tr GROUP BY q),
p AS (SELECT q, any_value(truth) AS label, avg(tr.label) AS prediction FROM best JOIN tr USING (place) GROUP BY q)
SELECT 'knn' AS model, sqrt(avg((label - prediction) ^ 2)) AS rmse,
       1 - avg((label - prediction) ^ 2) / var_pop(label) AS r2, count(*) AS n
FROM p"""

METRICS = """ AS model, sqrt(avg((label - prediction) ^ 2)) AS rmse,
       1 - avg((label - prediction) ^ 2) / var_pop(label) AS r2, count(*) AS n"""


def _least_squares(cols):
    """Normal equations of centred columns, eliminated one column after the other, then solved backwards."""
    k, names = len(cols), [*cols, "label"]
    steps = ["g0 AS (SELECT " + ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(names)) + ", " + ", ".join(
        f"covar_pop({names[min(i, j)]}, {names[max(i, j)]}) AS a{i}_{j}" for i in range(k) for j in range(k + 1))
        + " FROM sp WHERE split = 'train')"]
    for p in range(k - 1):
        steps.append(f"g{p + 1} AS (SELECT * REPLACE (" + ", ".join(
            f"a{r}_{j} - a{r}_{p} / a{p}_{p} * a{p}_{j} AS a{r}_{j}" for r in range(p + 1, k) for j in range(k + 1))
            + f") FROM g{p})")
    for p in reversed(range(k)):
        tail = "".join(f" - a{p}_{j} * b{j}" for j in range(p + 1, k))
        steps.append(f"s{p} AS (SELECT *, (a{p}_{k}{tail}) / a{p}_{p} AS b{p} FROM {f's{p + 1}' if p < k - 1 else f'g{k - 1}'})")
    guess = f"m{k}" + "".join(f" + b{i} * ({c} - m{i})" for i, c in enumerate(cols))
    return ",\n".join(steps) + f",\np AS (SELECT label, {guess} AS prediction FROM sp, s0 WHERE split = 'test')"


SPLIT_ROWS = ML + f""",
sp AS MATERIALIZED (SELECT * REPLACE (CAST(label AS DOUBLE) AS label), {SPLIT.format(id='item_id')} AS split FROM ml)"""

SQL["linear_regression"] = SPLIT_ROWS + f""",
{_least_squares(FEATURES)}
SELECT 'linear'{METRICS} FROM p"""


def _tree(cols, depth):
    """All splits of all nodes, level by level."""
    steps = [f"r0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS node, [{', '.join(cols)}] AS x, label, split FROM sp)"]
    for i in range(depth):
        steps.append(f"""
long{i} AS (SELECT node, f, x[f] AS v, count(*) AS n, sum(label) AS s FROM r{i}, range(1, {len(cols) + 1}) AS q(f)
            WHERE split = 'train' GROUP BY ALL),
sums{i} AS (SELECT node, f, v, sum(n) OVER up AS nl, sum(s) OVER up AS sl, sum(n) OVER whole AS n, sum(s) OVER whole AS s,
                   lead(v) OVER up AS above
            FROM long{i} WINDOW up AS (PARTITION BY node, f ORDER BY v), whole AS (PARTITION BY node, f)),
best{i} AS MATERIALIZED (
  SELECT node, f, (v + above) / 2 AS cut FROM sums{i}
  WHERE nl < n AND node IN (SELECT node FROM r{i} WHERE split = 'train' GROUP BY node HAVING min(label) < max(label))
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, v) = 1),
r{i + 1} AS MATERIALIZED (
  SELECT 2 * r.node + CASE WHEN x[f] > cut THEN 1 ELSE 0 END AS node, x, label, split
  FROM r{i} r LEFT JOIN best{i} b USING (node))""")
    return ",\n".join(steps) + f""",
p AS (SELECT t.label, m.prediction FROM r{depth} t
      JOIN (SELECT node, avg(label) AS prediction FROM r{depth} WHERE split = 'train' GROUP BY node) m USING (node)
      WHERE t.split = 'test')"""


SQL["tree_two_levels"] = SPLIT_ROWS + f""",
{_tree(FEATURES, 2)}
SELECT 'tree_two_levels'{METRICS} FROM p"""


def _sf(z):
    """Upper tail of the standard normal: the series up to 3, the continued fraction beyond."""
    x = f"abs({z})"
    density = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()))"
    series = (f"list_reduce([1.0::DOUBLE] || list_reverse(range(1, 41))::DOUBLE[], "
              f"lambda acc, k: 1.0 + {x} * {x} / (2.0 * k + 1) * acc)")
    fraction = f"list_reduce([{x}] || list_reverse(range(1, 61))::DOUBLE[], lambda acc, k: {x} + k / acc)"
    tail = f"(CASE WHEN {x} <= 3 THEN 0.5 - {density} * {x} * {series} ELSE {density} / {fraction} END)"
    return f"(CASE WHEN {z} < 0 THEN 1.0 - {tail} ELSE {tail} END)"


SQL["ks_normal"] = with_views("items") + f""",
x AS (SELECT CAST(price AS DOUBLE) AS x FROM items WHERE price IS NOT NULL AND NOT isnan(price)),
m AS (SELECT avg(x) AS mean, stddev_samp(x) AS sd, count(*) AS n FROM x),
v AS (SELECT x, count(*) AS t FROM x GROUP BY x),
z AS (SELECT n, mean, sd, t, sum(t) OVER (ORDER BY x) AS upto, (x - mean) / sd AS z FROM v, m),
f AS (SELECT *, 1.0 - {_sf("z")} AS f FROM z),
d AS (SELECT any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd,
             CAST(max(greatest(upto / n::DOUBLE - f, f - (upto - t) / n::DOUBLE)) AS DOUBLE) AS d FROM f),
l AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS lam FROM d)
SELECT n, mean, sd, d, CASE WHEN lam < 0.04 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * list_sum(list_transform(
         range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))))) END AS p
FROM l"""


def _polynomial(coefs, x):
    return "(" + " + ".join(f"{c!r} * pow({x}, {i})" for i, c in enumerate(coefs)) + ")"


def _decision():
    from quarry.plans.stats import C5, C6
    z = f"((ln(greatest(1.0 - w, 1e-300)) - {_polynomial(C5, 'ln(n)')}) / exp({_polynomial(C6, 'ln(n)')}))"
    return f"""
WITH w AS ({SQL["shapiro_wilk_w"]}),
u AS ({SQL["mann_whitney_u"]}),
t AS (SELECT 'shapiro_wilk' AS test, w AS statistic, {_sf("z")} AS p, 0.01::DOUBLE AS alpha
      FROM (SELECT w, {z} AS z FROM w)
      UNION ALL
      SELECT 'mann_whitney_u', u1, least(1.0::DOUBLE, 2 * {_sf("z")}), 0.05::DOUBLE FROM u)
SELECT *, p < alpha AS reject FROM t"""


SQL["test_decision"] = _decision()
SQL["shapiro_wilk"] = f"""
WITH w AS ({SQL["shapiro_wilk_w"]}),
t AS (SELECT p FROM ({_decision()}) WHERE test = 'shapiro_wilk')
SELECT n, w, p FROM w, t"""
