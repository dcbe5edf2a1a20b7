"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfold.functions import losses
from steadfold.functions.bounds import bound
from steadfold.functions.vectors import clipped, flattened, l1_norm, norm, rounded, sigmoid, unflattened
from steadfold.operators import attacks, experiment, grid, metrics, networks, optimizers, prefix, rules, search, training
from steadfold.plans import data
from steadfold.plans.data import PARAMS, cohorts, logs, samples, table
from steadfold.sources import commits, dataset, images, libsvm, runs, scratch
from steadfold.streaming import batches, numbers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
R = data.rounded
#: f that every rule allows with 11 workers.
F_ALL = 2


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(of: Query) -> Query:
        QUERIES[name] = of
        if sql:
            SQL[name] = sql
        return of

    return add


def result(rows: DataFrame) -> DataFrame:
    return rows.select("step", F.col("pos").cast("int").alias("pos"), rounded(F.col("val")).alias("val"))


RESULT = f"SELECT step, pos, {R('val')} AS val FROM result"


# Rules

query("gar_average", f"WITH {data.attacked(None, 0)}, {data.rule('average', 0)} {RESULT}")(lambda s, d: result(rules.average(cohorts(s, d))))
query("gar_median", f"WITH {data.attacked(None, 0)}, {data.rule('median', 0)} {RESULT}")(lambda s, d: result(rules.median(cohorts(s, d))))
query("gar_krum", f"WITH {data.attacked(None, 4)}, {data.rule('krum', 4)} {RESULT}")(lambda s, d: result(rules.aggregate(cohorts(s, d, 4), "krum", 4)))
query("gar_krum_m1", f"WITH {data.attacked(None, 4)}, {data.rule('krum_m1', 4)} {RESULT}")(lambda s, d: result(rules.krum(cohorts(s, d, 4), 4, 1)))
query("gar_krum_squared", f"WITH {data.attacked(None, 4)}, {data.rule('krum_squared', 4)} {RESULT}")(lambda s, d: result(rules.krum(cohorts(s, d, 4), 4, variant="squared")))
query("gar_bulyan", f"WITH {data.attacked('little', 2)}, {data.rule('bulyan', 2)} {RESULT}")(lambda s, d: result(rules.aggregate(attacks.with_attack(cohorts(s, d, 2), "little", 2, factor=1.5), "bulyan", 2)))
query("gar_brute", f"WITH {data.attacked(None, 4)}, {data.rule('brute', 4)} {RESULT}")(lambda s, d: result(rules.aggregate(cohorts(s, d, 4), "brute", 4)))
query("gar_brute_squared", f"WITH {data.attacked(None, 4)}, {data.rule('brute_squared', 4)} {RESULT}")(lambda s, d: result(rules.aggregate(cohorts(s, d, 4), "brute", 4, variant="squared")))
query("gar_bulyan_pruned", f"WITH {data.attacked(None, 2)}, {data.pruned(2, 12)} {RESULT}")(lambda s, d: result(rules.bulyan_pruned(cohorts(s, d, 2), 2)))

query("krum_blocks", f"WITH {data.attacked(None, 4)}, {data.rule('krum', 4)} {RESULT}")(lambda s, d: result(rules.krum(cohorts(s, d, 4), 4, blocks=2, parts=3)))
query("bulyan_blocks", f"WITH {data.attacked('little', 2)}, {data.rule('bulyan', 2)} {RESULT}")(lambda s, d: result(rules.bulyan(attacks.with_attack(cohorts(s, d, 2), "little", 2, factor=1.5), 2, blocks=3, parts=2)))
query("brute_blocks", f"WITH {data.attacked(None, 4)}, {data.rule('brute', 4)} {RESULT}")(lambda s, d: result(rules.brute(cohorts(s, d, 4), 4, blocks=2, parts=5)))

ONE_STEP = "vectors AS (SELECT 0 AS step, vec_id AS worker, embedding::DOUBLE[] AS g, false AS is_byz FROM embeddings)"


@query("krum_one_step", f"WITH {ONE_STEP}, {data.scores('n - 51')} SELECT step, worker, {R('score')} AS score, rank::INT AS rank FROM scores WHERE rank <= n - 52")
def krum_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one step, whose distances are spread over blocks of workers and parts of vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("step"), F.col("vec_id").alias("worker"), F.col("embedding").cast("array<double>").alias("g"))
    return rules.krum_selection(rows, 50, blocks=4, parts=4).withColumn("score", rounded(F.col("score")))


PRICES = "coords AS (SELECT 0 AS step, unnest(range(3))::INT AS pos, unnest([l_extendedprice, l_quantity, l_discount]) AS val FROM lineitem)"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem as one step of very many workers."""
    return table(spark, sf_dir, "lineitem").select(F.lit(0).alias("step"), F.col("l_orderkey").alias("worker"), F.array("l_extendedprice", "l_quantity", "l_discount").alias("g"))


query("median_by_bits", f"WITH {PRICES} SELECT step, pos, {R('quantile_disc(val, 0.5)')} AS val FROM coords GROUP BY step, pos")(lambda s, d: result(rules.median(priced(s, d), by_bits=True)))
query("median_finite_by_bits", f"WITH {PRICES} SELECT step, pos, {R('list_sort(list(val))[count(*) // 2 + 1]')} AS val FROM coords GROUP BY step, pos")(lambda s, d: result(rules.median(priced(s, d), "finite", by_bits=True)))

FINITE = "result AS (SELECT step, pos, coalesce(v[len(v) // 2 + 1], 0) AS val FROM (SELECT step, pos, coalesce(list_sort(list(val) FILTER (isfinite(val))), []) AS v FROM coords GROUP BY step, pos))"
query("gar_median_finite", f"WITH {data.attacked('nan', 3)}, {data.coords()}, {FINITE} {RESULT}")(lambda s, d: result(rules.median(attacks.with_attack(cohorts(s, d, 3), "nan", 3), "finite")))

PAIRS = f"WITH {data.attacked(None, 0)}, {data.pairs()} SELECT step, x, y, {R('d')} AS d FROM pairs"
query("pairwise_distance", PAIRS)(lambda s, d: rules.pairs(cohorts(s, d)).withColumn("d", rounded(F.col("d"))))
query("pairwise_distance_blocks", PAIRS)(lambda s, d: rules.pairs(cohorts(s, d), blocks=3).withColumn("d", rounded(F.col("d"))))
query("pairwise_distance_kernel", PAIRS)(lambda s, d: rules.pairs_by_kernel(cohorts(s, d)).withColumn("d", rounded(F.col("d"))))


@query("krum_scores", f"WITH {data.attacked(None, 4)}, {data.scores('n - 5')} SELECT step, worker, {R('score')} AS score, rank::INT AS rank FROM scores")
def krum_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.neighbour_scores(cohorts(spark, sf_dir), lambda n: n - 5).select("step", "worker", rounded(F.col("score")).alias("score"), "rank")


@query("krum_selection", f"WITH {data.attacked(None, 4)}, {data.scores('n - 5')} SELECT step, worker, {R('score')} AS score, rank::INT AS rank FROM scores WHERE rank <= n - 6")
def krum_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.krum_selection(cohorts(spark, sf_dir), 4).withColumn("score", rounded(F.col("score")))


@query("bulyan_candidates", f"WITH {data.attacked('little', 2)}, {data.rule('bulyan', 2)} SELECT step, i::INT AS i, pos, {R('val')} AS val FROM candidates")
def bulyan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.bulyan_candidates(attacks.with_attack(cohorts(spark, sf_dir, 2), "little", 2, factor=1.5), 2)
    return found.select("step", "i", "pos", rounded(F.col("val")).alias("val"))


AVERAGED = """middle AS (SELECT step, pos, quantile_disc(val, 0.5) AS mid, count(*) AS t FROM coords GROUP BY step, pos),
close AS (SELECT c.*, t, row_number() OVER (PARTITION BY step, pos ORDER BY round(abs(val - mid), 9), worker) AS r FROM coords c JOIN middle USING (step, pos)),
result AS (SELECT step, pos, avg(val) AS val FROM close WHERE r <= t - 4 GROUP BY step, pos)"""


@query("averaged_median", f"WITH {data.attacked(None, 0)}, {data.coords()}, {AVERAGED} {RESULT}")
def averaged_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(rules.averaged_median(rules.long_form(cohorts(spark, sf_dir)).withColumnRenamed("worker", "i"), 4))


CHOSEN = f"WITH {data.attacked(None, 4)}, {data.brute(4)} SELECT step,"
query("brute_selection", f"{CHOSEN} array_to_string(workers, ',') AS workers FROM chosen")(lambda s, d: rules.brute_selection(cohorts(s, d), 4).select("step", F.array_join("workers", ",").alias("workers")))
query("brute_diameter", f"{CHOSEN} {R('diameter')} AS diameter FROM chosen")(lambda s, d: rules.brute_selection(cohorts(s, d), 4).select("step", rounded(F.col("diameter")).alias("diameter")))


def share(name: str, picked: str, rest: Callable[[DataFrame], DataFrame | None]) -> None:
    sql = f"WITH {data.attacked(None, 4)}{picked} SELECT step, {R('avg(is_byz::INT)')} AS influence FROM picked GROUP BY step"
    query(name, sql)(lambda s, d: rules.influence(rows := cohorts(s, d, 4), rest(rows)).withColumn("influence", rounded(F.col("influence"))))


share("influence_average", ", picked AS (SELECT * FROM vectors)", lambda rows: None)
share("influence_krum", f", {data.scores('n - 5')}, picked AS (SELECT v.* FROM vectors v JOIN scores s USING (step, worker) WHERE s.rank <= n - 6)", lambda rows: rules.krum_selection(rows, 4))
share("influence_brute", f", {data.brute(4)}, picked AS (SELECT v.* FROM vectors v JOIN chosen USING (step) WHERE list_contains(workers, worker))", lambda rows: rules.brute_selection(rows, 4).select("step", F.explode("workers").alias("worker")))

LABELLED = "vectors AS (SELECT label AS step, vec_id AS worker, embedding::DOUBLE[] AS g, false AS is_byz FROM embeddings)"
LARGE_BRUTE = f"""WITH {LABELLED}, {data.pairs()},
far AS MATERIALIZED (SELECT step, x, y, d FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY d DESC) AS r, count(*) OVER (PARTITION BY step) AS c FROM pairs) WHERE r <= 2 * sqrt(2 * c) + 3),
gone AS (SELECT a.step, a.worker AS u, b.worker AS w FROM vectors a JOIN vectors b ON a.step = b.step AND a.worker < b.worker),
each AS (SELECT g.step, u, w, max(round(d, 9)) AS diameter FROM gone g JOIN far p ON p.step = g.step AND x <> u AND x <> w AND y <> u AND y <> w GROUP BY g.step, u, w),
chosen AS (SELECT step, u, w, diameter FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY diameter, u DESC, w DESC) AS r FROM each) WHERE r = 1)
SELECT v.step, worker, {R('diameter')} AS diameter FROM vectors v JOIN chosen c ON c.step = v.step AND worker <> u AND worker <> w"""


@query("brute_large_steps", LARGE_BRUTE)
def brute_large_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a label's embeddings, too many to list all subsets of; which workers stay without the two that are farthest out."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("step"), F.col("vec_id").alias("worker"), F.col("embedding").cast("array<double>").alias("g"))
    found = rules.brute_selection(rows, 2, blocks=2)
    return found.select("step", F.explode("workers").alias("worker"), rounded(F.col("diameter")).alias("diameter"))


SUBSETS = f"""WITH {data.attacked(None, 0)}, {data.pairs()}, counts AS (SELECT step, count(*)::BIGINT AS n FROM vectors GROUP BY step),
masks AS (SELECT n, list_filter(range(n), lambda w: (bits >> w) & 1 = 1) AS l, bits FROM (SELECT n, unnest(range(1 << n)) AS bits FROM (SELECT DISTINCT n FROM counts)) WHERE bit_count(bits) = n - 3),
ranked AS (SELECT n, bits, l, row_number() OVER (PARTITION BY n ORDER BY l) - 1 AS i FROM masks)"""


NEIGHBOURS = "(n - f + f * (n + f * (n - f - 2) - 2) / (n - 2 * f - 2))"
BOUND_SQL = {"median": "1 / sqrt(n - f)", "krum": f"1 / sqrt(2 * {NEIGHBOURS})", "bulyan": f"1 / sqrt(2 * {NEIGHBOURS})", "brute": "(n - f) / (sqrt(8) * f)"}
GRID = "grid AS (SELECT label, c::DOUBLE AS n, unnest(range(1, (c - 3) // 4 + 1))::DOUBLE AS f FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY label))"


@query("bounds", f"WITH {GRID} " + " UNION ALL ".join(f"SELECT label, '{k}' AS rule, n::BIGINT AS n, f::BIGINT AS f, {R(v)} AS bound FROM grid" for k, v in BOUND_SQL.items()))
def bounds_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of steps of a label's embeddings each: the bounds of all rules for every f that they allow."""
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    grid = sizes.select("label", "n", F.explode(F.expr("sequence(1L, (n - 3) div 4)")).alias("f"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), rounded(bound(r, F.col("n"), F.col("f"))).alias("bound")) for r in BOUND_SQL)))
    return grid.select("label", "n", "f", each.alias("b")).select("label", "b.rule", "n", "f", "b.bound")


@query("combinations", f"{SUBSETS} SELECT step, i, array_to_string(l, ',') AS members FROM counts JOIN ranked USING (n)")
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every choice of all but three places of each step's workers, by its rank."""
    every = rules.subsets(cohorts(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n")), 3)
    return every.select("step", "i", F.array_join(F.col("at").cast("array<string>"), ",").alias("members"))


@query("subset_diameters", f"{SUBSETS} SELECT step, i, {R('max(d)')} AS diameter FROM counts JOIN ranked USING (n) JOIN pairs USING (step) WHERE (bits >> x) & 1 = 1 AND (bits >> y) & 1 = 1 GROUP BY step, i")
def subset_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What minimum-diameter averaging takes the smallest of, for all subsets."""
    return rules.subset_diameters(cohorts(spark, sf_dir), 3).select("step", "i", rounded(F.col("diameter")).alias("diameter"))


# Attacks

MADE = f"SELECT step, worker, unnest(range(len(g)))::INT AS pos, unnest(list_transform(g, lambda v: {R('v')})) AS val FROM vectors WHERE is_byz"


def made(rows: DataFrame) -> DataFrame:
    return rows.where("is_byz").select("step", "worker", F.posexplode("g").alias("pos", "val")).withColumn("val", rounded(F.col("val")))


for _name, _attack, _options in (("attack_nan", "nan", {}), ("attack_bulyan", "bulyan", {"factor": 1.5}), ("attack_bulyan_all", "bulyan", {"factor": 1.5, "target": "all"}), ("attack_empire", "empire", {"factor": 1.5}), ("attack_little", "little", {"factor": 1.5})):
    query(_name, f"WITH {data.attacked('bulyan_all' if 'target' in _options else _attack, 3)} {MADE}")(lambda s, d, a=_attack, o=_options: made(attacks.with_attack(cohorts(s, d, 3), a, 3, **o)))


for _rule in ("average", "median", "krum", "bulyan", "brute"):
    _found = f"SELECT step, {R('best')} AS factor, {R('top')} AS gain FROM {{last}}"
    query(f"attack_auto_{_rule}", data.searched("little", _rule, 2, 12, _found))(lambda s, d, r=_rule: (a := attacks.auto(cohorts(s, d, 2).where("NOT is_byz"), "little", 2, 2, r, 12)).select("step", *(rounded(a[c]).alias(c) for c in ("factor", "gain"))))

query("attack_searched", data.searched("empire", "krum", 3, 8, f"SELECT m.step, (k + i)::INT AS worker, pos, {R('avg + best * way')} AS val FROM ways m JOIN {{last}} USING (step) JOIN counted USING (step), range(3) AS r(i)"))(lambda s, d: made(attacks.with_attack(cohorts(s, d, 3), "empire", 3, factor=-8, defence="krum")))
query("attack_auto_rounds", data.searched("bulyan_all", "median", 3, 6, f"SELECT step, -({R('best')}) AS factor, {R('top')} AS gain FROM {{last}}", -1))(lambda s, d: (a := attacks.auto_in_rounds(cohorts(s, d, 3).where("NOT is_byz"), "bulyan", 3, 3, "median", 6, True, "all")).select("step", *(rounded(a[c]).alias(c) for c in ("factor", "gain"))))

TOPS = "SELECT s_suppkey AS step, abs(s_acctbal) / 100 AS t FROM supplier"


@query("line_maximize", "WITH RECURSIVE " + data.search(f"tops AS ({TOPS})", "SELECT step, -(trial - t) * (trial - t) AS value FROM {trials} JOIN tops USING (step)", "tops", 24, f"SELECT step AS supplier, {R('t')} AS top, {R('best')} AS found FROM {{last}} JOIN tops USING (step)"))
def line_maximize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search on parabolas, one for each supplier, all in columns: the places found come near the tops."""
    tops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), (F.abs("s_acctbal") / 100).alias("at"))
    found = search.maxima(tops, lambda trial: -(trial - F.col("at")) * (trial - F.col("at")), 24)
    return found.select("supplier", rounded(F.col("at")).alias("top"), rounded(F.col("best")).alias("found"))


# Rules against attacks

for _rule, _attack in product(("average", "median", "krum", "bulyan", "brute"), ("nan", "bulyan", "empire", "little")):
    _options = {} if _attack == "nan" else {"factor": 1.5}
    query(f"pipeline_{_rule}_{_attack}", f"WITH {data.attacked(_attack, F_ALL)}, {data.rule(_rule, F_ALL)} {RESULT}")(lambda s, d, r=_rule, a=_attack, o=_options: result(rules.aggregate(attacks.with_attack(cohorts(s, d, F_ALL), a, F_ALL, **o), r, F_ALL)))


# Training

SHUFFLED = "numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 7919 + 13) % 1000003, o_orderkey) - 1 AS rn FROM orders)"


@query("batch_assign", f"WITH {SHUFFLED} SELECT o_orderkey, rn // 25 AS batch, rn // 25 // 11 AS step, rn // 25 % 11 AS worker FROM numbered")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix.numbered(table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 + 13) % 1000003).alias("key")), "key", "o_orderkey")
    return rows.select("o_orderkey", *training.batch_of(F.col("rn"), 25, 11))


@query("batch_test_cursor", "SELECT b AS batch, b % ((n + 99) // 100) * 100 AS start FROM (SELECT count(*) AS n FROM customer), (SELECT unnest(range(500)) AS b)")
def batch_test_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(500).select(F.col("id").alias("batch"), training.test_cursor(table(spark, sf_dir, "customer").count(), 100, F.col("id")).alias("start"))


@query("cycle_batches", "SELECT event_id AS batch, event_id % ((n + 99) // 100) AS source FROM events, (SELECT count(*) AS n FROM customer)")
def cycle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which batch of 100 customers each event takes, if events take them one after another."""
    batches_ = -(-table(spark, sf_dir, "customer").count() // 100)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), training.source_batch(F.col("event_id"), batches_).alias("source"))


@query("train_test_split", "SELECT c_custkey, CASE WHEN rn < least(greatest(1, floor(n * 0.8)), n - 1) THEN 'train' ELSE 'test' END AS part FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer)")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.train_test_split(table(spark, sf_dir, "customer").select("c_custkey"), 0.8, "c_custkey").select("c_custkey", "part")


@query("split_documents", "SELECT doc_id, length(text)::BIGINT AS n_chars, rn, CASE WHEN rn < least(greatest(1, floor(n * 0.8)), n - 1) THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their whole texts, which are wide."""
    found = training.train_test_split(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8, "doc_id")
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), "rn", "part")


LINEAR = f"list_dot_product(x, {list(PARAMS[:-1])}::DOUBLE[]) + ({PARAMS[-1]})::DOUBLE"


def grad_sql(out: str, slope: str) -> str:
    return f"""WITH {data.SAMPLES}, p AS (SELECT step, worker, x, y, {out} AS p FROM samples), s AS (SELECT step, worker, {slope} AS s, list_append(x, 1.0::DOUBLE) AS x FROM p)
SELECT step, worker, pos, {R('2 * avg(s * v)')} AS val FROM (SELECT step, worker, s, unnest(range(5))::INT AS pos, unnest(x) AS v FROM s) GROUP BY step, worker, pos"""


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose target is the place of the flag among A, N and R."""
    lines = table(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return lines.select((F.col("l_orderkey") % 5).alias("step"), (F.col("l_partkey") % data.WORKERS).cast("int").alias("worker"), x.alias("x"), (F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1).alias("y"))


def grad(spark: SparkSession, sf_dir: str, model: str, loss: str = "mse") -> DataFrame:
    found = training.gradients(samples(spark, sf_dir), np.array(PARAMS), model, loss)
    return found.select("step", "worker", F.posexplode("g").alias("pos", "val")).withColumn("val", rounded(F.col("val")))


query("grad_linear_mse", grad_sql(LINEAR, "p - y"))(lambda s, d: grad(s, d, "linear"))
query("grad_logit_mse", grad_sql(f"1 / (1 + exp(-({LINEAR})))", "(p - y) * p * (1 - p)"))(lambda s, d: grad(s, d, "logit"))

LOGIT = f"1 / (1 + exp(-({LINEAR})))"
ENTROPY = "-(y / p - (1 - y) / (1 - p)) * p * (1 - p) / 2"
query("grad_logit_bce", grad_sql(LOGIT, ENTROPY))(lambda s, d: grad(s, d, "logit", "bce"))
query("grad_linear_huber", grad_sql(LINEAR, "CASE WHEN abs(p - y) <= 1 THEN p - y ELSE sign(p - y) END / 2"))(lambda s, d: grad(s, d, "linear", "huber"))
query("grad_linear_bcewithlogits", grad_sql(LINEAR, "(1 / (1 + exp(-p)) - y) / 2"))(lambda s, d: grad(s, d, "linear", "bcewithlogits"))
query("grad_linear_softmargin", grad_sql(LINEAR, "-y / (1 + exp(p * y)) / 2"))(lambda s, d: grad(s, d, "linear", "softmargin"))
SIZE = f"sqrt({' + '.join(f'({w})::DOUBLE * ({w})::DOUBLE' for w in PARAMS)})"
COMPOSED = grad_sql(LOGIT, f"(0.5::DOUBLE * 2 * (p - y) - 2 * (y / p - (1 - y) / (1 - p))) * p * (1 - p) / 2").replace(R("2 * avg(s * v)"), "2 * avg(s * v)")
query("grad_composed", f"SELECT step, worker, pos, {R(f'val + 0.01 * sign(w) + 0.1 * w / {SIZE}')} AS val FROM ({COMPOSED}), (SELECT {list(PARAMS)}::DOUBLE[] AS params), LATERAL (SELECT params[pos + 1] AS w)")(lambda s, d: grad(s, d, "logit", "0.5*mse + 2*bce + 0.01*l1 + 0.1*l2"))

#: Weights of three classes over four features, a bias behind each.
CLASSES = tuple(round(0.1 * ((7 * i) % 11 - 5), 1) for i in range(15))
FLAGGED = f"""WITH {data.SAMPLES.replace("CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "(strpos('ANR', l_returnflag) - 1)")},
z AS (SELECT step, worker, list_append(x, 1.0::DOUBLE) AS x, y, [{", ".join(f"list_dot_product(list_append(x, 1.0::DOUBLE), {list(CLASSES[5 * k : 5 * k + 5])}::DOUBLE[])" for k in range(3))}] AS z FROM samples),
s AS (SELECT *, ln(list_sum(list_transform(z, lambda v: exp(v)))) AS whole FROM z)"""


@query("grad_softmax_nll", f"{FLAGGED} SELECT step, worker, (5 * k + pos)::INT AS pos, {R('avg((exp(z[k + 1] - whole) - (k = y)::INT) * x[pos + 1])')} AS val FROM s, range(3) AS r(k), range(5) AS q(pos) GROUP BY step, worker, k, pos")
def grad_softmax_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes by the flag of an order's line."""
    rows = flagged(spark, sf_dir)
    found = training.gradients(rows, np.array(CLASSES), "softmax", "nll", 3)
    return found.select("step", "worker", F.posexplode("g").alias("pos", "val")).withColumn("val", rounded(F.col("val")))


@query("grad_loss_crossentropy", f"{FLAGGED} SELECT step, worker, {R('avg(whole - z[y + 1])')} AS loss FROM s GROUP BY step, worker")
def grad_loss_crossentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss that comes with a gradient, of the sums themselves instead of logarithms of probabilities."""
    found = training.gradients(flagged(spark, sf_dir), np.array(CLASSES), "linear", "crossentropy", 3)
    return found.select("step", "worker", rounded(F.col("loss")).alias("loss"))


L2 = "sqrt(list_dot_product(g, g))"


@query("gradient_clip", f"WITH {data.attacked(None, 0)} SELECT step, worker, unnest(range(len(g)))::INT AS pos, unnest(list_transform(g, lambda v: {R('CASE WHEN l > 0.75 THEN v * 0.75 / l ELSE v END')})) AS val FROM (SELECT *, {L2} AS l FROM vectors)")
def gradient_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts(spark, sf_dir).withColumn("g", clipped(F.col("g"), 0.75))
    return rules.long_form(rows).withColumn("val", rounded(F.col("val")))


SIGMA = R("2 * 5.0::DOUBLE / batch * sqrt(2 * ln(1.25::DOUBLE / 0.5::DOUBLE)) / epsilon")


@query("privacy_sigma", f"WITH {data.SAMPLES}, sizes AS (SELECT step, worker, count(*) AS batch FROM samples GROUP BY step, worker) SELECT step, worker, epsilon, batch, {SIGMA} AS sigma FROM sizes, (SELECT unnest([0.1, 0.2, 0.5])::DOUBLE AS epsilon)")
def privacy_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation of the noise on each worker's gradient, whose batch is all of its samples of a step."""
    sizes = samples(spark, sf_dir).groupBy("step", "worker").agg(F.count("*").alias("batch"))
    each = sizes.withColumn("epsilon", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.5)))))
    return each.withColumn("sigma", rounded(training.privacy_deviation(5.0, F.col("batch"), F.col("epsilon"), 0.5)))


@query("privacy_noise")
def privacy_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the noise by step: near 0 and near 0.5."""
    rows = cohorts(spark, sf_dir).withColumn("g", F.transform("g", lambda x: F.lit(0.0)))
    return rules.long_form(training.with_noise(rows, 0.5, 1)).groupBy("step").agg(F.avg("val").alias("mean"), F.stddev_samp("val").alias("dev"))


@query("lr_schedule", f"SELECT step, {R('0.01 / (step // 50 * 50 / 500.0::DOUBLE + 1)')} AS lr, n FROM (SELECT o_orderkey // 11 AS step, count(*) AS n FROM orders GROUP BY ALL)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at each step, if eleven orders are a step."""
    steps = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 11").alias("step")).agg(F.count("*").alias("n"))
    return steps.withColumn("lr", rounded(training.learning_rate(F.col("step"), 0.01, 500, 50)))


@query("sgd_step", f"WITH {data.attacked(None, 0)}, {data.rule('average', 0)} SELECT step, pos, {R('0.01 * pos - 0.05 * (0.9 * 0.02 * pos + val + 0.001 * 0.01 * pos)')} AS val FROM result")
def sgd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum 0.9 and weight decay 0.001 from parameters 0.01 pos and velocities 0.02 pos."""
    params, _ = training.sgd(F.col("pos") * 0.01, F.col("pos") * 0.02, F.col("val"), 0.05, 0.9, 0.0, 0.001)
    return result(rules.average(cohorts(spark, sf_dir)).withColumn("val", params))


@query("l2_origin", f"WITH {data.attacked(None, 0)}, {data.rule('average', 0)} SELECT step, {R('sqrt(sum(val * val)) * 0.05')} AS l2_origin FROM result GROUP BY step")
def l2_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rules.wide_form(rules.average(cohorts(spark, sf_dir)).withColumn("val", F.col("val") * -0.05), "step")
    return wide.select("step", rounded(norm(F.col("g"))).alias("l2_origin"))


@query("train_loop", data.trained(5, "krum", 3, 0.5, 0.9, 0.2, "logit", f"SELECT step::BIGINT AS step, {R('l2_origin')} AS l2_origin, {R('grad_norm')} AS defense_norm FROM log"))
def train_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = training.train(samples(spark, sf_dir), 4, 5, "krum", 3, rate=0.5, clip=0.2)
    return spark.createDataFrame(log).select("step", *(rounded(F.col(c)).alias(c) for c in ("l2_origin", "defense_norm")))


NORMAL = f"""WITH {data.SAMPLES}, v AS (SELECT list_append(x, 1.0::DOUBLE) AS x, y FROM samples),
c AS (SELECT i, j, avg(a[i] * a[j]) AS m FROM (SELECT list_append(x, y) AS a FROM v), range(1, 7) AS r(i), range(1, 7) AS q(j) GROUP BY i, j),
step_0 AS MATERIALIZED (SELECT i, list(m ORDER BY j) AS row FROM c WHERE i < 6 GROUP BY i)"""
for _k in range(1, 6):
    NORMAL += f""",
pivot_{_k} AS (SELECT list_transform(row, lambda v: v / row[{_k}]) AS p FROM step_{_k - 1} WHERE i = {_k}),
step_{_k} AS MATERIALIZED (SELECT i, CASE WHEN i = {_k} THEN p ELSE list_transform(range(1, 7), lambda c: row[c] - row[{_k}] * p[c]) END AS row FROM step_{_k - 1}, pivot_{_k})"""


@query("regression", f"{NORMAL} SELECT (i - 1)::INT AS pos, round(row[6], 3) + 0.0 AS val FROM step_5")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adam's result, which is near the one of the normal equations; the SQL eliminates them."""
    found = training.regression(samples(spark, sf_dir), 4, 4000, 0.02)
    return spark.createDataFrame([(i, round(float(v), 3) + 0.0) for i, v in enumerate(found)], "pos int, val double")


RUN = experiment.Options(steps=4, workers=11, declared=3, real=2, rule="krum", attack="empire", attack_options={"factor": 1.5}, rate=0.5, rate_decay=4, rate_every=2, clip=0.1, batch=25, test_batch=40, test_repeat=3, evaluate_every=2)
RUN_ROWS = "SELECT row_number() OVER (ORDER BY (o_orderkey * 7919 + 13) % 1000003, o_orderkey) - 1 AS place, [o_totalprice / 100000, (o_custkey % 10) / 10.0::DOUBLE] AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM orders"


@query("training_run", data.ran(RUN, RUN_ROWS, 1000, f"SELECT step, datapoints, {', '.join(f'{R(c)} AS {c}' for c in ('loss_avg', 'l2_origin', 'honest_norm', 'defense_norm', 'accuracy'))} FROM whole"))
def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with an attack, a rate that decays and evaluations, as its logs tell it."""
    key = ((F.col("o_orderkey") * 7919 + 13) % 1000003).alias("key")
    rows = table(spark, sf_dir, "orders").select(key, "o_orderkey", F.array(F.col("o_totalprice") / 100000, (F.col("o_custkey") % 10) / 10).alias("x"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    train, test = dataset.datasets(rows, 1000, RUN.batch, RUN.test_batch, "key", "o_orderkey")
    experiment.run(train, test, 2, RUN, folder := scratch.folder(spark, "run"))
    found = runs.Session(spark, folder).data
    return found.select("step", "datapoints", *(rounded(F.col(c)).alias(c) for c in ("loss_avg", "l2_origin", "honest_norm", "defense_norm", "accuracy")))


GRID_RULES = (("average", 0), ("median", 0), ("krum", 2))
GRID_RUNS = [grid.Setting(f"{rule}-{rate}", seed, rule, f, rate=rate) for rule, f in GRID_RULES for rate in (0.5, 0.1) for seed in (0, 1)]


def grid_sql() -> str:
    """Each run of the grid on its own: (name, seed, step, loss, grad_norm, l2_origin) as ``runs``."""
    parts = []
    for o in GRID_RUNS:
        one = data.trained(4, o.rule, o.f, o.rate, o.momentum, None, o.model, f"SELECT '{o.name}' AS name, {o.seed}::BIGINT AS seed, step::BIGINT AS step, grad_norm, l2_origin FROM log")
        parts.append(f"SELECT * FROM ({one.replace('l_orderkey % 5', f'(l_orderkey + {o.seed}) % 5')})")
    return f"WITH runs AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve runs over lineitem at once: three rules, two rates, and two orders of the steps."""
    lines = samples(spark, sf_dir).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = lines.withColumn("step", (F.col("step") + F.col("seed")) % 5)
    return grid.train(rows, 4, 4, GRID_RUNS, scratch.folder(spark, "grid"))


query("grid_in_one_plan", f"{grid_sql()} SELECT name, seed, step, {R('grad_norm')} AS grad_norm, {R('l2_origin')} AS l2_origin FROM runs")(lambda s, d: gridded(s, d).select("name", F.col("seed").cast("long").alias("seed"), "step", rounded(F.col("grad_norm")).alias("grad_norm"), rounded(F.col("l2_origin")).alias("l2_origin")))
query("grid_over_seeds", f"{grid_sql()} SELECT name, step, count(*) AS seeds, {R('avg(grad_norm)')} AS grad_norm_avg, {R('stddev_pop(grad_norm)')} AS grad_norm_err FROM runs GROUP BY name, step")(lambda s, d: runs.over_seeds(gridded(s, d), "grad_norm", by=("name",)).select("name", "step", "seeds", rounded(F.col("grad_norm_avg")).alias("grad_norm_avg"), rounded(F.col("grad_norm_err")).alias("grad_norm_err")))


# Statistics

STATS = f"""each AS (SELECT step, is_byz, {L2} AS l, list_max(list_transform(g, lambda v: abs(v))) AS m FROM vectors),
stats AS (SELECT step, is_byz, count(*) AS n, avg(l) AS norm, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(l) END AS dev, max(m) AS max FROM each GROUP BY step, is_byz)"""


@query("avg_dev_max", f"WITH {data.attacked(None, 3)}, {STATS} SELECT step, is_byz, n, {R('norm')} AS norm, {R('dev')} AS dev, {R('max')} AS max FROM stats")
def avg_dev_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.avg_dev_max(cohorts(spark, sf_dir, 3), "step", "is_byz")
    return found.select("step", "is_byz", "n", *(rounded(F.col(c)).alias(c) for c in ("norm", "dev", "max")))


STUDY = f"""{data.coords(name='all_coords', more='is_byz,')},
means AS (SELECT step, pos, avg(val) FILTER (NOT is_byz) AS h, avg(val) FILTER (is_byz) AS a FROM all_coords GROUP BY step, pos),
products AS (SELECT step, sum(h * a) AS ha, sum(h * val) AS hr, sum(a * val) AS ar, sqrt(sum(val * val)) AS defense_norm, max(abs(val)) AS defense_max FROM means JOIN result USING (step, pos) GROUP BY step),
{STATS},
study AS (SELECT step, step * 25 * h.n AS datapoints, h.dev AS honest_dev, a.dev AS attack_dev, h.norm AS honest_norm, a.norm AS attack_norm, defense_norm, h.max AS honest_max, a.max AS attack_max, defense_max,
  ha / (h.norm * a.norm) AS cos_hon_att, hr / (h.norm * defense_norm) AS cos_hon_def, ar / (a.norm * defense_norm) AS cos_att_def
  FROM products JOIN (SELECT * FROM stats WHERE NOT is_byz) h USING (step) JOIN (SELECT * FROM stats WHERE is_byz) a USING (step))"""
STUDY_COLUMNS = ("honest_dev", "attack_dev", "honest_norm", "attack_norm", "defense_norm", "honest_max", "attack_max", "defense_max", "cos_hon_att", "cos_hon_def", "cos_att_def")
STUDY_WITH = f"WITH {data.attacked('little', 2)}, {data.rule('krum', 2)}, {STUDY}"


def studied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attacks.with_attack(cohorts(spark, sf_dir, 2), "little", 2, factor=1.5)
    found = metrics.study(rows, rules.krum(rows, 2))
    return found.select("step", "datapoints", *(rounded(F.col(c)).alias(c) for c in STUDY_COLUMNS))


STUDY_SELECT = f"SELECT step, datapoints::BIGINT AS datapoints, {', '.join(f'{R(c)} AS {c}' for c in STUDY_COLUMNS)} FROM study"
query("study", f"{STUDY_WITH} {STUDY_SELECT}")(studied)
query("study_cosines", f"{STUDY_WITH} SELECT step, {', '.join(f'{R(c)} AS {c}' for c in STUDY_COLUMNS[-3:])} FROM study")(lambda s, d: studied(s, d).select("step", *STUDY_COLUMNS[-3:]))


@query("study_sink_roundtrip", f"{STUDY_WITH} {STUDY_SELECT}")
def study_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs.write(studied(spark, sf_dir), path := scratch.folder(spark))
    return runs.read(spark, path, "step long, datapoints long, " + ", ".join(f"{c} double" for c in STUDY_COLUMNS))


@query("checkpoint_roundtrip", f"WITH {data.attacked(None, 0)}, {data.rule('average', 0)} {RESULT}")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates as parts that a commit makes known; one that none has named isn't read."""
    found, kept = result(rules.average(cohorts(spark, sf_dir))), commits.Commits(spark, scratch.folder(spark, "commits"))
    for k in range(2):
        found.where(F.col("step") % 2 == k).write.parquet(f"{kept.folder}/{(part := kept.place('aggregates'))}")
        kept.commit({"aggregates": part})
    found.limit(5).write.parquet(f"{kept.folder}/{kept.place('aggregates')}")
    return spark.read.parquet(*kept.paths("aggregates"))


@query("scalar_avg_dev", f"SELECT c_nationkey, {R('avg(c_acctbal)')} AS mean, {R('stddev_samp(c_acctbal)')} AS dev FROM customer GROUP BY c_nationkey")
def scalar_avg_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, dev = metrics.scalar_avg_dev(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(rounded(mean).alias("mean"), rounded(dev).alias("dev"))


@query("bound_satisfied", f"WITH {data.attacked(None, 2)}, {STATS}, sizes AS (SELECT step, count(*)::DOUBLE AS n, 2::DOUBLE AS f FROM vectors GROUP BY step) SELECT step, {R('dev / norm')} AS ratio, {R(BOUND_SQL['krum'])} AS bound, dev / norm <= {BOUND_SQL['krum']} AS satisfied FROM (SELECT step, norm, dev FROM stats WHERE NOT is_byz) JOIN sizes USING (step)")
def bound_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.bound_satisfied(cohorts(spark, sf_dir, 2), "krum", 2)
    return found.select("step", rounded(F.col("ratio")).alias("ratio"), rounded(F.col("bound")).alias("bound"), "satisfied")


# Losses, criteria, models

PREDICTED = f"WITH {data.SAMPLES}, p AS (SELECT *, {LINEAR} AS z, 1 / (1 + exp(-({LINEAR}))) AS p FROM samples)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b = F.array(*map(F.lit, PARAMS[:-1])), F.lit(PARAMS[-1])
    return samples(spark, sf_dir).withColumn("z", losses.linear(F.col("x"), w, b)).withColumn("p", sigmoid(F.col("z")))


def loss(name: str, sql: str, of: Callable[[], F.Column] | Callable) -> None:
    query(name, f"{PREDICTED} SELECT step, {R(sql)} AS loss FROM p GROUP BY step")(lambda s, d: predicted(s, d).groupBy("step").agg(rounded(of()).alias("loss")))


loss("loss_mse", "avg((p - y) * (p - y))", lambda: losses.mse(F.col("p"), F.col("y")))
loss("loss_bce", "avg(-(y * ln(p) + (1 - y) * ln(1 - p)))", lambda: losses.bce(F.col("p"), F.col("y")))
loss("loss_nll", "avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END)", lambda: losses.nll(F.array(F.ln(1 - F.col("p")), F.ln("p")), F.col("y").cast("int")))
loss("weighted_mse", "avg((worker + 1) * (p - y) * (p - y))", lambda: losses.weighted_mse(F.col("p"), F.col("y"), F.col("worker") + 1))
loss("loss_composed", "0.5 * avg((p - y) * (p - y)) + 2 * avg(-(y * ln(p) + (1 - y) * ln(1 - p)))", lambda: (0.5 * losses.LOSSES["mse"] + losses.LOSSES["bce"] * 2.0)(F.col("p"), F.col("y"), F.col("x")))
loss("loss_bce_with_logits", "avg(-(y * ln(p) + (1 - y) * ln(1 - p)))", lambda: losses.LOSSES["bcewithlogits"](F.col("z"), F.col("y"), F.col("x")))
loss("loss_huber", "avg(CASE WHEN abs(z - y) <= 1 THEN 0.5::DOUBLE * (z - y) * (z - y) ELSE abs(z - y) - 0.5::DOUBLE END)", lambda: losses.LOSSES["huber"](F.col("z"), F.col("y"), F.col("x")))
loss("loss_cross_entropy", "avg(ln(exp(z) + exp(-z)) - CASE WHEN y = 1 THEN z ELSE -z END)", lambda: losses.LOSSES["crossentropy"](F.array(-F.col("z"), F.col("z")), F.col("y").cast("int"), F.col("x")))
loss("loss_soft_margin", "avg(ln(1 + exp(-z * (2 * y - 1))))", lambda: losses.LOSSES["softmargin"](F.col("z"), 2 * F.col("y") - 1, F.col("x")))
query("loss_l1_l2", f"WITH {data.attacked(None, 0)} SELECT step, worker, {R('list_sum(list_transform(g, lambda v: abs(v)))')} AS l1, {R(L2)} AS l2 FROM vectors")(lambda s, d: cohorts(s, d).select("step", "worker", rounded(l1_norm(F.col("g"))).alias("l1"), rounded(norm(F.col("g"))).alias("l2")))
query("criterion_sigmoid", f"{PREDICTED} SELECT step, sum((abs(y - p) < 0.5)::INT)::BIGINT AS correct, count(*) AS total FROM p GROUP BY step")(lambda s, d: predicted(s, d).groupBy("step").agg(F.sum(losses.sigmoid_right(F.col("p"), F.col("y"))).alias("correct"), F.count("*").alias("total")))
query("evaluate_sigmoid", f"{PREDICTED} SELECT worker, {R('sum((abs(y - p) < 0.5)::INT) / count(*)')} AS accuracy FROM p GROUP BY worker")(lambda s, d: predicted(s, d).groupBy("worker").agg(rounded(F.sum(losses.sigmoid_right(F.col("p"), F.col("y"))) / F.count("*")).alias("accuracy")))
query("criterion_topk", "SELECT label, sum((better < 5)::INT)::BIGINT AS correct, count(*) AS total FROM (SELECT label, len(list_filter(range(len(embedding)), lambda i: embedding[i + 1] > embedding[label + 1] OR (embedding[i + 1] = embedding[label + 1] AND i < label))) AS better FROM embeddings) GROUP BY label")(lambda s, d: table(s, d, "embeddings").groupBy("label").agg(F.sum(losses.in_top_k(F.col("embedding"), F.col("label"), 5)).alias("correct"), F.count("*").alias("total")))
for _kind, _column in (("linear", "z"), ("logit", "p")):
    query(f"predict_{_kind}", f"{PREDICTED} SELECT step, worker, round({_column}, 9) + 0.0 AS out, count(*) AS n FROM p GROUP BY ALL")(lambda s, d, c=_column: predicted(s, d).groupBy("step", "worker", rounded(F.col(c), 9).alias("out")).agg(F.count("*").alias("n")))


#: Weights of a perceptron from places: 64 inputs, 32 hidden units, 10 classes.
MLP_PARAMS = np.concatenate([np.sin(np.arange(32 * 64) * 0.7) * 0.3, np.zeros(32), np.cos(np.arange(10 * 32) * 1.3) * 0.3, np.zeros(10)])
MLP = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
h AS (SELECT vec_id, list_transform(range(32), lambda o: greatest(0.0::DOUBLE, list_dot_product(x, list_transform(range(64), lambda i: sin((o * 64 + i) * 0.7::DOUBLE) * 0.3::DOUBLE)))) AS h FROM e),
z AS (SELECT vec_id, list_transform(range(10), lambda o: list_dot_product(h, list_transform(range(32), lambda i: cos((o * 32 + i) * 1.3::DOUBLE) * 0.3::DOUBLE))) AS z FROM h),
s AS (SELECT vec_id, z, ln(list_sum(list_transform(z, lambda v: exp(v)))) AS s FROM z)"""


@query("predict_mlp", f"{MLP} SELECT vec_id AS id, unnest(range(10))::INT AS pos, unnest(list_transform(z, lambda v: {R('v - s')})) AS val FROM s")
def predict_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    found = networks.predict(rows, networks.full(8, 32, 10), MLP_PARAMS)
    return found.select("id", F.posexplode("out").alias("pos", "val")).withColumn("val", rounded(F.col("val")))


@query("predict_conv")
def predict_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A convolutional network over embeddings as images of eight by eight places."""
    network = networks.conv(8, (4, 6), 2, 16, 10)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    found = networks.predict(rows, network, optimizers.initial(network.shapes, seed=3))
    return found.select("id", F.posexplode("out").alias("pos", "val"))


@query("grad_network", f"""{MLP}, p AS (SELECT label, z.vec_id, pos, exp(z[pos + 1] - s) - (pos = label)::INT AS d FROM s AS z, embeddings e, range(10) AS r(pos) WHERE z.vec_id = e.vec_id)
SELECT label AS worker, (32 * 64 + 32 + 10 * 32 + pos)::INT AS pos, {R('avg(d)')} AS val FROM p GROUP BY label, pos""")
def grad_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last layer's bias of a perceptron's gradient, a worker for each label."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("step"), F.col("label").alias("worker"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    found = networks.gradients(rows, networks.full(8, 32, 10), MLP_PARAMS, "nll").select("worker", F.posexplode("g").alias("pos", "val"))
    return found.where(F.col("pos") >= 32 * 64 + 32 + 10 * 32).withColumn("val", rounded(F.col("val")))


@query("flatten_unflatten", "SELECT vec_id, a, b, c FROM (SELECT vec_id, round(list_sum(list_transform(embedding[1:20], lambda v: v::DOUBLE)), 6) + 0.0 AS a, round(list_sum(list_transform(embedding[21:64], lambda v: v::DOUBLE)), 6) + 0.0 AS b, 0.0::DOUBLE AS c FROM embeddings)")
def flatten_unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks as one vector and back; a third block, which the vector lacks, is zero."""
    e = F.col("embedding").cast("array<double>")
    whole = flattened(F.slice(e, 1, 20), F.slice(e, 21, 44))
    parts = unflattened(whole, [20, 44, 5])
    sums = [rounded(F.aggregate(p, F.lit(0.0), lambda s, v: s + v)).alias(c) for p, c in zip(parts, "abc", strict=True)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *sums)


# Sources, sinks, run logs

LIBSVM_TEXT = "CASE WHEN l_returnflag = 'R' THEN '1' ELSE '-1' END || ' 1:' || l_linenumber || ' 3:' || l_suppkey || ' 68:' || l_partkey"


@query("libsvm_parse", "SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, l_linenumber::DOUBLE AS x1, 0.0::DOUBLE AS x2, l_suppkey::DOUBLE AS x3, l_partkey::DOUBLE AS x68, 68 AS width FROM lineitem")
def libsvm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "lineitem").select(F.expr(LIBSVM_TEXT).alias("line"))
    x = F.col("r.x")
    return text.select(libsvm.parse(F.col("line"), 68).alias("r")).select("r.label", x[0].alias("x1"), x[1].alias("x2"), x[2].alias("x3"), x[67].alias("x68"), F.size(x).alias("width"))


@query("libsvm_source", "SELECT label, count(*) AS n, sum(x) AS x FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, l_partkey::DOUBLE AS x FROM lineitem) GROUP BY label")
def libsvm_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").select(F.expr(LIBSVM_TEXT)).write.text(path := scratch.folder(spark))
    return libsvm.read(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("x")[67]).alias("x"))


@query("normalize_features", "SELECT vec_id, unnest(range(64))::INT AS pos, unnest(list_transform(embedding, lambda v: round((v::DOUBLE - 0.1307) / 0.3081, 6) + 0.0)) AS val FROM embeddings")
def normalize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = libsvm.normalize(F.col("embedding").cast("array<double>"), 0.1307, 0.3081)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(x).alias("pos", "val")).withColumn("val", rounded(F.col("val")))


@query("minmax_scale", "SELECT vec_id, unnest(range(64))::INT AS pos, unnest(list_transform(embedding, lambda v: floor((v::DOUBLE - lo) / (hi - lo) * 255)::INT)) AS byte FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image of eight by eight places, and the places that are read from it."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    found = images.decoded(images.images(rows, 8).select(F.col("id").alias("path"), F.col("image").alias("content")))
    return found.select(F.col("path").alias("vec_id"), F.posexplode("x").alias("pos", "byte"))


@query("flip_images", f"SELECT vec_id, unnest(range(64))::INT AS pos, unnest(list_transform(flatten(list_transform(range(8), lambda k: list_reverse(embedding[k * 8 + 1 : k * 8 + 8]))), lambda v: {R('v::DOUBLE')})) AS val FROM embeddings")
def flip_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of eight by eight places, left side right."""
    x = images.flipped(F.col("embedding").cast("array<double>"), 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(x).alias("pos", "val")).withColumn("val", rounded(F.col("val")))


@query("image_files", "SELECT vec_id, 13 + 64 AS n_bytes, list_sum(list_transform(embedding, lambda v: floor((v::DOUBLE - lo) / (hi - lo) * 255)::INT))::BIGINT AS total FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as grey images of eight by eight places: their files' sizes, and the sums of their places."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    body = F.hex(F.expr("substring(image, 12)"))
    total = F.expr("aggregate(sequence(0, 63), 0L, (s, i) -> s + cast(conv(substring(body, 2 * i + 1, 2), 16, 10) as long))")
    return images.images(rows, 8).withColumn("body", body).select(F.col("id").alias("vec_id"), (F.length("image") + 2).alias("n_bytes"), total.alias("total"))


DAILY = f"""WITH {data.LOGS}, study AS (SELECT run, step, count(*) AS datapoints, avg(value) AS loss_avg, max(value) AS honest_max FROM logs WHERE seed <> 0 GROUP BY run, step),
eval AS (SELECT run, step, avg((value > 50)::INT) AS accuracy FROM logs WHERE seed = 0 GROUP BY run, step)"""


def daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = logs(spark, sf_dir)
    study = rows.where("seed <> 0").groupBy("run", "step").agg(F.count("*").alias("datapoints"), F.avg("value").alias("loss_avg"), F.max("value").alias("honest_max"))
    return study, rows.where("seed = 0").groupBy("run", "step").agg(F.avg((F.col("value") > 50).cast("int")).alias("accuracy"))


JOINED = f"{DAILY}, session AS (SELECT run, step, datapoints, {R('loss_avg')} AS loss_avg, {R('honest_max')} AS honest_max, {R('accuracy')} AS accuracy FROM study FULL JOIN eval USING (run, step))"


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = runs.join_session(*daily(spark, sf_dir), "run")
    return joined.select("run", "step", "datapoints", *(rounded(F.col(c)).alias(c) for c in ("loss_avg", "honest_max", "accuracy")))


query("session_join", f"{JOINED} SELECT * FROM session")(session)
query("select_like", f"{JOINED} SELECT loss_avg, accuracy, datapoints FROM session")(lambda s, d: runs.select_like(session(s, d), "LOSS", "acc", "ata"))
query("discard_like", f"{JOINED} SELECT run, step, accuracy FROM session")(lambda s, d: runs.discard_like(session(s, d), "avg", "Data", "max"))
query("compute_epoch", f"{JOINED} SELECT run, step, {R('datapoints / 60000.0::DOUBLE')} AS epoch FROM session")(lambda s, d: session(s, d).select("run", "step", rounded(runs.epoch(F.col("datapoints"), "mnist")).alias("epoch")))
query("compute_lr", f"{JOINED} SELECT run, step, {R('0.5 / (step // 7 * 7 / 30.0::DOUBLE + 1)')} AS lr FROM session")(lambda s, d: session(s, d).select("run", "step", rounded(training.learning_rate(F.col("step"), 0.5, 30, 7)).alias("lr")))

SEEDS = f"""WITH {data.LOGS}, by_seed AS (SELECT run, seed, step, avg(value) AS value FROM logs GROUP BY ALL),
err AS (SELECT step, count(*) AS seeds, avg(value) AS value_avg, stddev_pop(value) AS value_err FROM by_seed WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY step)"""


def over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.over_seeds(logs(spark, sf_dir).groupBy("run", "seed", "step").agg(F.avg("value").alias("value")), "value")


query("avg_err_over_seeds", f"{SEEDS} SELECT step, seeds, {R('value_avg')} AS value_avg, {R('value_err')} AS value_err FROM err")(lambda s, d: over_seeds(s, d).select("step", "seeds", rounded(F.col("value_avg")).alias("value_avg"), rounded(F.col("value_err")).alias("value_err")))
query("plot_band", f"{SEEDS} SELECT 'value' AS series, step::DOUBLE AS x, {R('value_avg')} AS y, {R('value_avg - value_err')} AS y_lo, {R('value_avg + value_err')} AS y_hi FROM err")(lambda s, d: (b := runs.band(over_seeds(s, d), "step", "value_avg", "value_err", "value")).select("series", "x", *(rounded(b[c]).alias(c) for c in ("y", "y_lo", "y_hi"))))


@query("histogram", f"WITH v AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL), r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 25 AS w FROM v), c AS (SELECT least(floor((v - lo) / w), 24)::BIGINT AS bin, count(*) AS n FROM v, r GROUP BY 1) SELECT b AS bin, {R('lo + b * w')} AS lo, {R('lo + (b + 1) * w')} AS hi, coalesce(n, 0)::BIGINT AS n FROM r, (SELECT unnest(range(25)) AS b) LEFT JOIN c ON c.bin = b")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.select("bin", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), "n")


@query("experiment_grid", "SELECT DISTINCT event_type AS name, user_id % 5 AS seed, d[1] AS gar, d[2] AS attack, epsilon, batch FROM events, (SELECT unnest([['average', 'nan'], ['krum', 'little'], ['brute', 'empire']]) AS d), (SELECT unnest([0.0, 0.1, 0.2, 0.5])::DOUBLE AS epsilon), (SELECT unnest([10, 25, 50, 100, 250, 500]) AS batch)")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """72 settings for each kind of event and each of its seeds."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 5).alias("seed")).distinct()
    pairs = F.explode(F.array(*(F.struct(F.lit(g).alias("gar"), F.lit(a).alias("attack")) for g, a in (("average", "nan"), ("krum", "little"), ("brute", "empire")))))
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    return rows.select("name", "seed", pairs.alias("p")).select("name", "seed", "p.*").withColumn("epsilon", each((0.0, 0.1, 0.2, 0.5))).withColumn("batch", each((10, 25, 50, 100, 250, 500)))


PARSED = """SELECT event_id, split_part(w, ':', 1) AS key, CASE WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float' ELSE 'str' END AS kind, v AS value
FROM (SELECT event_id, w, substr(w, strpos(w, ':') + 1) AS v FROM (SELECT event_id, unnest(['type:' || event_type, 'user:' || user_id, 'big:' || (CASE WHEN value > 50 THEN 'True' ELSE 'false' END), 'rate:1.5e-' || (user_id % 10), 'half:' || (user_id % 10) || '.5']) AS w FROM events))"""


@query("parse_keyval", PARSED)
def parse_keyval(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.expr("array('type:' || event_type, 'user:' || user_id, 'big:' || CASE WHEN value > 50 THEN 'True' ELSE 'false' END, 'rate:1.5e-' || (user_id % 10), 'half:' || (user_id % 10) || '.5')")
    return table(spark, sf_dir, "events").select("event_id", F.explode(runs.parse_keyval(words)).alias("p")).select("event_id", "p.*")


# Streams

query("stream_aggregate", f"WITH {data.attacked(None, 0)}, {data.rule('median', 0)} {RESULT}")(lambda s, d: result(batches.aggregated(cohorts(s, d).select("step", "worker", "g"), scratch.folder(s))))

WINDOWS = f"""WITH buckets AS (SELECT ts::DATE AS day, user_id % 16 AS worker, count(*) AS n, avg(value) AS v FROM events GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, sum(n)::BIGINT AS n, {R('avg(v)')} AS mean, {R('quantile_disc(v, 0.5)')} AS median FROM buckets GROUP BY day"""
query("stream_window_average", WINDOWS)(lambda s, d: batches.windowed_stream(table(s, d, "events"), scratch.folder(s)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("median")).alias("median")))
STREAMED = {"fast": batches.Settings("median", 0, 0.5, 0.9), "slow": batches.Settings("average", 0, 0.1, 0.0)}
TRAINED = " UNION ALL ".join(f"SELECT * FROM ({data.trained(5, o.rule, o.f, o.rate, o.momentum, None, o.model, f'''SELECT '{k}' AS run, step::BIGINT AS step, {R('grad_norm')} AS grad_norm FROM log''')})" for k, o in STREAMED.items())


@query("stream_sgd", TRAINED)
def stream_sgd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of logistic regression over the steps of lineitem, a step a micro-batch."""
    folder = scratch.folder(spark)
    stream = numbers.by_step(samples(spark, sf_dir), folder, 5)
    return batches.train_on(stream, folder, 4, STREAMED).select("run", "step", rounded(F.col("grad_norm")).alias("grad_norm"))


ORDERED = "SELECT row_number() OVER (ORDER BY (o_orderkey * 7919 + 13) % 1000003, o_orderkey) - 1 AS rn, o_orderkey, count(*) OVER () AS n FROM orders"


@query("stream_batches", f"WITH o AS ({ORDERED}) SELECT b AS batch, o_orderkey FROM o, range(60) AS r(b) WHERE ((rn - b * 40) % n + n) % n < 40")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty batches of forty orders as a stream, over the end of the table if it is that short."""
    folder, orders = scratch.folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 + 13) % 1000003).alias("key"))
    stream = numbers.sampled(dataset.Batches(orders, 40, "key", "o_orderkey"), folder, 60, per=20).select("batch", "o_orderkey")
    numbers.until_done(stream, folder, "append", lambda w: w.format("parquet").option("path", f"{folder}/out"))
    return spark.read.schema("batch long, o_orderkey long").parquet(f"{folder}/out")
