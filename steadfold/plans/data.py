"""How the query tables are taken as vectors, samples and logs, and the same in SQL.

Vectors: the N embeddings are dealt into N div 11 steps by vec_id, so each step
has 11 workers, or 12 where N leaves a remainder; every row takes part.  The
last f workers of a step are the arbitrary ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORKERS = 11
#: Parameters of the linear models over lineitem's four scaled features, bias last.
PARAMS = (0.3, -0.2, 0.5, 0.1, -0.05)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohorts(spark: SparkSession, sf_dir: str, f: int = 0) -> DataFrame:
    """step, worker, g, n, is_byz."""
    rows = table(spark, sf_dir, "embeddings")
    steps = max(1, rows.count() // WORKERS)
    found = rows.select((F.col("vec_id") % steps).alias("step"), F.expr(f"cast(vec_id div {steps} as int)").alias("worker"), F.col("embedding").cast("array<double>").alias("g"))
    sized = found.withColumn("n", F.count("*").over(Window.partitionBy("step")))
    return sized.withColumn("is_byz", F.col("worker") >= F.col("n") - f)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, worker, x, y from lineitem: is it returned?"""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("step"), (F.col("l_partkey") % WORKERS).cast("int").alias("worker"),
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, seed, step, value from events: an event type is a run, a user a seed, a day a step."""
    days = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 5).alias("seed"), days.alias("step"), F.col("value").alias("value"))


COHORT = f"""steps AS (SELECT greatest(count(*) // {WORKERS}, 1) AS s FROM embeddings),
cohort AS (SELECT vec_id % s AS step, (vec_id // s)::INT AS worker, embedding::DOUBLE[] AS g FROM embeddings, steps),
sized AS (SELECT *, count(*) OVER (PARTITION BY step) AS n FROM cohort)"""
SAMPLES = f"""samples AS (SELECT l_orderkey % 5 AS step, (l_partkey % {WORKERS})::INT AS worker,
  [l_quantity / 50, l_extendedprice / 100000, l_discount * 10, l_tax * 10] AS x, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM lineitem)"""
LOGS = "logs AS (SELECT event_type AS run, user_id % 5 AS seed, date_diff('day', DATE '2024-01-01', ts::DATE) AS step, value FROM events)"


def rounded(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def attacked(attack: str | None, f: int, factor: float = 1.5) -> str:
    """CTEs up to ``vectors`` (step, worker, g, is_byz)."""
    if attack is None:
        return f"{COHORT},\nvectors AS (SELECT step, worker, g, worker >= n - {f} AS is_byz FROM sized)"
    way = {"nan": "'nan'::DOUBLE", "bulyan": f"avg(val) + {factor}::DOUBLE * CASE WHEN pos = 63 THEN 1 ELSE 0 END", "bulyan_all": f"avg(val) + {factor}::DOUBLE", "empire": f"avg(val) - {factor}::DOUBLE * avg(val)", "little": f"avg(val) + {factor}::DOUBLE * coalesce(stddev_samp(val), 'nan'::DOUBLE)"}[attack]
    return f"""{COHORT},
honest AS (SELECT step, worker, g FROM sized WHERE worker < n - {f}),
hcoords AS (SELECT step, unnest(range(len(g)))::INT AS pos, unnest(g) AS val FROM honest),
moved AS (SELECT step, pos, {way} AS val FROM hcoords GROUP BY step, pos),
made AS (SELECT step, list(val ORDER BY pos) AS g FROM moved GROUP BY step),
counted AS (SELECT step, count(*) AS k FROM honest GROUP BY step),
vectors AS (SELECT step, worker, g, false AS is_byz FROM honest
  UNION ALL SELECT step, (k + i)::INT AS worker, g, true AS is_byz FROM made JOIN counted USING (step), range({f}) AS r(i))"""


def coords(source: str = "vectors", name: str = "coords", more: str = "") -> str:
    return f"{name} AS (SELECT step, worker, {more} unnest(range(len(g)))::INT AS pos, unnest(g) AS val FROM {source})"


def pairs(squared: bool = False) -> str:
    d = "list_distance(a.g, b.g)"
    d = f"({d}) * ({d})" if squared else d
    return f"""pairs AS (SELECT step, x, y, CASE WHEN isfinite(d) THEN d ELSE 'inf'::DOUBLE END AS d FROM
  (SELECT a.step, a.worker AS x, b.worker AS y, {d} AS d FROM vectors a JOIN vectors b ON a.step = b.step AND a.worker < b.worker))"""


def scores(count: str, squared: bool = False) -> str:
    return f"""{pairs(squared)},
near AS (SELECT step, x AS i, y AS j, d FROM pairs UNION ALL SELECT step, y, x, d FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY step, i ORDER BY d, j) AS r, count(*) OVER (PARTITION BY step, i) + 1 AS n FROM near),
sums AS (SELECT step, i AS worker, sum(d) AS score, max(n) AS n FROM ranked WHERE r <= {count} GROUP BY step, i),
scores AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(score, 9), worker) AS rank FROM sums)"""


def brute(f: int, squared: bool = False) -> str:
    return f"""{pairs(squared)},
counts AS (SELECT step, count(*) AS n FROM vectors GROUP BY step),
masks AS (SELECT n, bits FROM (SELECT n, unnest(range(1 << n)) AS bits FROM (SELECT DISTINCT n::BIGINT AS n FROM counts)) WHERE bit_count(bits) = n - {f}),
diameters AS (SELECT c.step, m.n, bits, max(d) AS diameter FROM counts c JOIN masks m ON c.n = m.n JOIN pairs p ON p.step = c.step AND (bits >> x) & 1 = 1 AND (bits >> y) & 1 = 1 GROUP BY ALL HAVING max(d) < 'inf'::DOUBLE),
chosen AS (SELECT step, workers, diameter FROM (
  SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(diameter, 9), workers) AS r FROM (
    SELECT step, diameter, list_transform(list_filter(range(n), lambda w: (bits >> w) & 1 = 1), lambda w: w::INT) AS workers FROM diameters)) WHERE r = 1)"""


def rule(name: str, f: int) -> str:
    """CTEs after ``vectors`` up to ``result`` (step, pos, val)."""
    mean = "result AS (SELECT step, pos, avg(val) AS val FROM coords GROUP BY step, pos)"
    if name == "average":
        return f"{coords()},\n{mean}"
    if name == "median":
        return f"{coords()},\nresult AS (SELECT step, pos, CASE WHEN bool_or(isnan(val)) THEN 'nan'::DOUBLE ELSE quantile_disc(val, 0.5) END AS val FROM coords GROUP BY step, pos)"
    if name.startswith("krum"):
        squared = name == "krum_squared"
        m = "1" if name == "krum_m1" else f"n - {f} - 2"
        return f"{scores(f'n - {f} - {2 if squared else 1}', squared)},\npicked AS (SELECT v.* FROM vectors v JOIN scores s USING (step, worker) WHERE s.rank <= {m}),\n{coords('picked')},\n{mean}"
    if name == "bulyan":
        return f"""{scores(f'n - {f} - 2')},
windows AS (SELECT step, worker, i FROM (SELECT *, unnest(range(n - {2 * f} - 2)) AS i FROM scores) WHERE rank > i AND rank <= i + least(n - {f} - 2, n - {f} - 2 - i)),
parts AS (SELECT w.step, w.worker, i, g FROM windows w JOIN vectors v USING (step, worker)),
{coords('parts', more='i,')},
candidates AS (SELECT step, i, pos, avg(val) AS val FROM coords GROUP BY step, i, pos),
middle AS (SELECT step, pos, CASE WHEN bool_or(isnan(val)) THEN 'nan'::DOUBLE ELSE quantile_disc(val, 0.5) END AS mid, count(*) AS t FROM candidates GROUP BY step, pos),
close AS (SELECT c.*, t, row_number() OVER (PARTITION BY step, pos ORDER BY round(abs(val - mid), 9), i) AS r FROM candidates c JOIN middle USING (step, pos)),
result AS (SELECT step, pos, avg(val) AS val FROM close WHERE r <= t - {2 * f} GROUP BY step, pos)"""
    if name.startswith("brute"):
        return f"{brute(f, name == 'brute_squared')},\npicked AS (SELECT v.* FROM vectors v JOIN chosen USING (step) WHERE list_contains(workers, worker)),\n{coords('picked')},\n{mean}"
    raise KeyError(name)


def pruned(f: int, most: int) -> str:
    """CTEs after ``vectors`` up to ``result`` by the rule whose scores forget each selected worker; steps have ``most`` workers at most."""
    parts = [f"""{pairs(True)},
near AS (SELECT step, x AS i, y AS j, d FROM pairs UNION ALL SELECT step, y, x, d FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY step, i ORDER BY d, j) AS r, count(*) OVER (PARTITION BY step, i) + 1 AS n FROM near),
counted AS MATERIALIZED (SELECT step, i, j, d, n FROM ranked WHERE r <= n - {f} - 2),
left_0 AS MATERIALIZED (SELECT step, i AS worker, sum(d) AS score, max(n) AS n FROM counted GROUP BY step, i)"""]
    for k in range(most - 2 * f - 2):
        parts.append(f"""order_{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY step ORDER BY round(score, 9), worker) AS rank, count(*) OVER (PARTITION BY step) AS c FROM left_{k} WHERE {k} < n - {2 * f} - 2),
pick_{k} AS MATERIALIZED (SELECT step, {k} AS i, pos, avg(val) AS val FROM (SELECT step, unnest(range(len(g)))::INT AS pos, unnest(g) AS val FROM order_{k} JOIN vectors USING (step, worker) WHERE rank <= greatest(1, least(n - {f} - 2 - {k}, c))) GROUP BY step, pos),
left_{k + 1} AS MATERIALIZED (SELECT o.step, o.worker, o.score - coalesce(c.d, 0) AS score, o.n FROM order_{k} o JOIN order_{k} g ON g.step = o.step AND g.rank = 1 AND o.rank > 1 LEFT JOIN counted c ON c.step = o.step AND c.i = o.worker AND c.j = g.worker)""")
    every = " UNION ALL ".join(f"SELECT * FROM pick_{k}" for k in range(most - 2 * f - 2))
    parts.append(f"""picks AS MATERIALIZED ({every}),
middle AS (SELECT step, pos, list_sort(list(val))[count(*) // 2 + 1] AS mid, count(*) AS t FROM picks GROUP BY step, pos),
close AS (SELECT p.*, t, row_number() OVER (PARTITION BY step, pos ORDER BY round(abs(val - mid), 9), i) AS r FROM picks p JOIN middle USING (step, pos)),
result AS (SELECT step, pos, avg(val) AS val FROM close WHERE r <= t - {2 * f} GROUP BY step, pos)""")
    return ",\n".join(parts)


def search(before: str, values: str, keys: str, evaluations: int, last: str) -> str:
    """SQL of the search: ``values`` asks for the values of ``{trials}`` (step, trial); ``last`` reads ``{last}``, the final states."""
    parts = [before, f"trials_0 AS MATERIALIZED (SELECT DISTINCT step, 0.0::DOUBLE AS trial FROM {keys})"]
    for k in range(evaluations):
        if k:
            back = "last - stride / pow(2.0::DOUBLE, greatest(0, ceil(log2(stride / last))))"
            place = f"CASE WHEN growing THEN best + stride WHEN last < best THEN last + stride WHEN last <= 0 THEN 0 ELSE {back} END"
            parts.append(f"trials_{k} AS MATERIALIZED (SELECT *, {place} AS trial FROM state_{k - 1})")
        parts.append(f"values_{k} AS MATERIALIZED ({values.format(trials=f'trials_{k}')})")
        if not k:
            parts.append("state_0 AS MATERIALIZED (SELECT step, 0.0::DOUBLE AS best, round(value, 9) AS top, 0.0::DOUBLE AS last, 1.0::DOUBLE AS stride, true AS growing FROM values_0)")
        else:
            parts.append(f"""state_{k} AS MATERIALIZED (SELECT step, CASE WHEN better THEN trial ELSE best END AS best, CASE WHEN better THEN value ELSE top END AS top, trial AS last,
  stride * CASE WHEN growing AND better THEN 2.0::DOUBLE ELSE 0.8::DOUBLE END AS stride, growing AND better AS growing
  FROM (SELECT t.*, round(value, 9) AS value, round(value, 9) > top AS better FROM trials_{k} t JOIN values_{k} USING (step)))""")
    return ",\n".join(parts) + "\n" + last.format(last=f"state_{evaluations - 1}")


def searched(attack: str, defence: str, f: int, evaluations: int, last: str, sign: int = 1) -> str:
    """SQL of an attack whose factor is searched for: ``ways`` (step, pos, avg, way), ``counted`` (step, k), and the final states."""
    way = {"bulyan_all": "1.0::DOUBLE", "empire": "-avg(val)", "little": "stddev_samp(val)"}[attack]
    before = f"""{COHORT},
honest AS MATERIALIZED (SELECT step, worker, g FROM sized WHERE worker < n - {f}),
counted AS MATERIALIZED (SELECT step, count(*) AS k FROM honest GROUP BY step),
ways AS MATERIALIZED (SELECT step, pos, avg(val) AS avg, {way} AS way FROM (SELECT step, unnest(range(len(g)))::INT AS pos, unnest(g) AS val FROM honest) GROUP BY step, pos)"""
    values = f"""WITH made AS (SELECT step, list(avg + {sign} * trial * way ORDER BY pos) AS g FROM ways JOIN {{trials}} USING (step) GROUP BY step),
vectors AS MATERIALIZED (SELECT step, worker, g FROM honest UNION ALL SELECT step, (k + i)::INT, g FROM made JOIN counted USING (step), range({f}) AS r(i)),
{rule(defence, f)}
SELECT step, sum((val - avg) * (val - avg)) AS value FROM result JOIN ways USING (step, pos) GROUP BY step"""
    return "WITH " + search(before, values, "honest", evaluations, last)


def trained(steps: int, name: str, f: int, rate: float, momentum: float, clip: float | None, model: str, last: str) -> str:
    """SQL of a training loop over the samples: ``log`` (step, l2_origin, grad_norm), one CTE a step."""
    out = "list_dot_product(x, w[1:4]) + w[5]"
    out, slope = (f"1 / (1 + exp(-({out})))", "(p - y) * p * (1 - p)") if model == "logit" else (out, "p - y")
    norm = "sqrt(list_dot_product(g, g))"
    short = "g" if clip is None else f"CASE WHEN {norm} > {clip} THEN list_transform(g, lambda v: v * {clip}::DOUBLE / {norm}) ELSE g END"
    zero = "[0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]"
    parts = [SAMPLES, f"params_0 AS (SELECT {zero} AS w, {zero} AS v)"]
    for k in range(steps):
        parts.append(f"""grad_{k} AS MATERIALIZED (WITH p AS (SELECT worker, x, y, w, {out} AS p FROM samples, params_{k} WHERE step = {k}),
each AS (SELECT worker, pos, 2 * avg(s * v) AS val FROM (SELECT worker, {slope} AS s, unnest(range(5)) AS pos, unnest(list_append(x, 1.0::DOUBLE)) AS v FROM p) GROUP BY worker, pos),
whole AS (SELECT worker, list(val ORDER BY pos) AS g FROM each GROUP BY worker),
vectors AS MATERIALIZED (SELECT {k} AS step, worker, {short} AS g FROM whole),
{rule(name, f)}
SELECT list(val ORDER BY pos) AS g FROM result)""")
        velocity = "g" if not k else f"list_transform(range(1, 6), lambda i: {momentum}::DOUBLE * v[i] + g[i])"
        parts.append(f"params_{k + 1} AS MATERIALIZED (SELECT list_transform(range(1, 6), lambda i: w[i] - {rate}::DOUBLE * u[i]) AS w, u AS v FROM (SELECT w, {velocity} AS u FROM params_{k}, grad_{k}))")
    rows = " UNION ALL ".join(f"SELECT {k} AS step, sqrt(list_dot_product(w, w)) AS l2_origin, {norm} AS grad_norm FROM params_{k}, grad_{k}" for k in range(steps))
    return "WITH " + ",\n".join(parts) + f",\nlog AS ({rows})\n{last}"


def ran(options: object, rows: str, at: int, last: str) -> str:
    """SQL of a run by mean squared errors of ``logit``: ``rows`` (place, x, y), the first ``at`` of them for training (all but one at most)."""
    o, honest = options, options.workers - options.real
    many, width, norm = honest * o.batch, 2, "sqrt(list_dot_product(g, g))"
    zero = f"{[0.0] * (width + 1)}::DOUBLE[]"
    out = f"1 / (1 + exp(-(list_dot_product(x, w[1:{width}]) + w[{width + 1}])))"
    parts = [
        f"rows AS MATERIALIZED ({rows})", f"cut AS (SELECT least({at}, count(*) - 1) AS n, count(*) - least({at}, count(*) - 1) AS m FROM rows)",
        f"samples AS MATERIALIZED (SELECT k AS step, ((place - k * {many}) % n + n) % n + j * n AS slot, x, y FROM rows, cut, range({o.steps}) AS r(k), range(0, {many}) AS q(j) WHERE place < n AND j * n < {many})",
        f"params_0 AS (SELECT {zero} AS w, {zero} AS v)",
    ]
    for k in range(o.steps):
        rate = o.rate / (k // o.rate_every * o.rate_every / o.rate_decay + 1)
        parts.append(f"""grad_{k} AS MATERIALIZED (WITH p AS (SELECT slot // {o.batch} AS worker, x, y, {out} AS p FROM samples, params_{k} WHERE step = {k} AND slot < {many}),
each AS (SELECT worker, pos, 2 * avg(s * v) AS val FROM (SELECT worker, (p - y) * p * (1 - p) AS s, unnest(range({width + 1})) AS pos, unnest(list_append(x, 1.0::DOUBLE)) AS v FROM p) GROUP BY worker, pos),
whole AS (SELECT worker, list(val ORDER BY pos) AS g FROM each GROUP BY worker),
honest AS MATERIALIZED (SELECT worker, CASE WHEN {norm} > {o.clip} THEN list_transform(g, lambda v: v * {o.clip}::DOUBLE / {norm}) ELSE g END AS g FROM whole),
made AS (SELECT list(a - {o.attack_options['factor']}::DOUBLE * a ORDER BY pos) AS g FROM (SELECT pos, avg(val) AS a FROM (SELECT unnest(range(len(g))) AS pos, unnest(g) AS val FROM honest) GROUP BY pos)),
vectors AS MATERIALIZED (SELECT {k} AS step, worker, g FROM honest UNION ALL SELECT {k}, {honest} + i, g FROM made, range({o.real}) AS r(i)),
{rule(o.rule, o.declared)}
SELECT (SELECT list(val ORDER BY pos) FROM result) AS g, (SELECT avg({norm}) FROM honest) AS honest_norm,
  (SELECT avg(l) FROM (SELECT avg((p - y) * (p - y)) AS l FROM p GROUP BY worker)) AS loss_avg)""")
        velocity = "g" if not k else f"list_transform(range(1, {width + 2}), lambda i: {o.momentum}::DOUBLE * v[i] + g[i])"
        parts.append(f"params_{k + 1} AS MATERIALIZED (SELECT list_transform(range(1, {width + 2}), lambda i: w[i] - {rate}::DOUBLE * u[i]) AS w, u AS v FROM (SELECT w, {velocity} AS u FROM params_{k}, grad_{k}))")
    study = " UNION ALL ".join(f"SELECT {k} AS step, {k * many} AS datapoints, loss_avg, sqrt(list_dot_product(w, w)) AS l2_origin, honest_norm, {norm} AS defense_norm FROM params_{k}, grad_{k}" for k in range(o.steps))
    tests = " UNION ALL ".join(
        f"SELECT {k} AS step, sum((abs({out} - y) < 0.5)::INT) / count(*) AS accuracy FROM rows, cut, params_{k}, range({k // o.evaluate_every * o.test_repeat}, {(k // o.evaluate_every + 1) * o.test_repeat}) AS r(b) WHERE place >= n AND (place - n) // least({o.test_batch}, m) = b % ((m + least({o.test_batch}, m) - 1) // least({o.test_batch}, m))"
        for k in range(0, o.steps + 1, o.evaluate_every)
    )
    return "WITH " + ",\n".join(parts) + f",\nstudy AS ({study}),\ntests AS ({tests}),\nwhole AS (SELECT coalesce(s.step, t.step)::BIGINT AS step, datapoints::BIGINT AS datapoints, loss_avg, l2_origin, honest_norm, defense_norm, accuracy FROM study s FULL JOIN tests t USING (step))\n{last}"
