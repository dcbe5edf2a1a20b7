"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are to be copied target / size times each.  The whole part
is plain; the fractional parts are rounded dependently.  Two documents with
fractional copies p and q are paired, and mass is moved from one to the other,
in words, in a random direction, until one of them is integral; the other goes
on to the next pair.  Directions are drawn so that each document's expected
copies stay what they were, and what one document loses in words the other
gains, so a source's words stay exact up to the one document that is last.

The pairs form a reduction tree: documents are dealt into blocks of about
BLOCK by a hash, each block is folded on its own, the longest documents first,
and leaves one residual; the residuals are dealt into blocks again until a
source has one.  All draws are hashes of the documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.llm.common import materialize, text_key
from steadfold.operators import prefix
from steadfold.sources.names import unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Copies of a document at most.
MOST = 3
BLOCK = 128
#: Documents above these shares of the words that their source still needs are rounded before the others.
TIERS = (1 / 8, 1 / 64)
_TIER = "CASE " + " ".join(f"WHEN size > {share} * mass THEN {t}" for t, share in enumerate(TIERS)) + f" ELSE {len(TIERS)} END"
_FIELDS = ("doc_id", "key", "size", "rows", "whole", "source_size", "target", "draw")


def n_words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text has; null has none.

    Only borders are counted, by replacements, which search bytes: no pattern
    is matched and no array of words is made.  A run of white space becomes one
    opening and one closing mark, as those between two spaces cancel out.
    """
    spaces = F.coalesce(text.cast("string"), F.lit(""))
    for other, plain in (("\x01", "x"), ("\x02", "x"), *((c, " ") for c in "\t\n\x0b\x0c\r"), (" ", "\x01\x02"), ("\x02\x01", "")):
        spaces = F.replace(spaces, F.lit(other), F.lit(plain))

    def count(marked: Column) -> Column:
        runs = (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("\x01\x02"), F.lit("")))) / 2
        return F.when(marked == "", 0).otherwise(runs + 1 - marked.startswith("\x01").cast("int") - marked.endswith("\x02").cast("int")).cast("long")

    # The text is marked once, as the only element of an array.
    return F.transform(F.array(spaces), count)[0]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> with ``target``: shares by weight, none above ``most`` times the source's size.

    Ordered by size over weight, a source is full as soon as its share of what
    the fuller ones leave reaches its bound, so the water level is the largest
    of these shares.  Ranks and sums are taken over ranges, so that sources may
    be many; null is the last one.  No sources give no rows.
    """
    ranked = prefix.numbered(sizes, F.col("source").asc_nulls_last(), name="rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ordered = prefix.running(ranked, {"full": "source_size", "heavier": "weight"}, F.expr(f"{most} * source_size / weight"), F.col("source").asc_nulls_last())
    ordered = materialize(ordered, "shares")
    whole = ordered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    share = (F.lit(whole.size or 0) - F.col("full") * most) / (F.lit(whole.weight or 1) - F.col("heavier"))
    level = ordered.agg(F.max(share)).first()[0]
    return ordered.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(most)), F.lit(level or 0.0) * F.col("weight")).alias("target"))


#: One pair.  acc: u (the fractional document), p (its copies), done.  x: the next document.
_FOLD = """
aggregate(
  units,
  cast(null as struct<u: {unit}, p: double, done: array<struct<u: {unit}, up: boolean>>>),
  (acc, x) -> CASE WHEN acc IS NULL THEN named_struct('u', x.u, 'p', x.p, 'done', cast(array() as array<struct<u: {unit}, up: boolean>>))
  ELSE transform(array(named_struct(
      'a', least((1 - acc.p) * acc.u.size, x.p * x.u.size),
      'b', least(acc.p * acc.u.size, (1 - x.p) * x.u.size),
      'draw', (xxhash64(acc.u.draw, x.u.draw, acc.u.key, x.u.key) & 4503599627370495L) / 4503599627370496D)), t ->
    CASE WHEN t.draw * (t.a + t.b) < t.b THEN
      CASE WHEN (1 - acc.p) * acc.u.size <= x.p * x.u.size
        THEN named_struct('u', x.u, 'p', x.p - t.a / x.u.size, 'done', array_append(acc.done, named_struct('u', acc.u, 'up', true)))
        ELSE named_struct('u', acc.u, 'p', acc.p + t.a / acc.u.size, 'done', array_append(acc.done, named_struct('u', x.u, 'up', false))) END
    ELSE
      CASE WHEN acc.p * acc.u.size <= (1 - x.p) * x.u.size
        THEN named_struct('u', x.u, 'p', x.p + t.b / x.u.size, 'done', array_append(acc.done, named_struct('u', acc.u, 'up', false)))
        ELSE named_struct('u', acc.u, 'p', acc.p - t.b / acc.u.size, 'done', array_append(acc.done, named_struct('u', x.u, 'up', true))) END
    END)[0] END)
"""


def _tree(units: DataFrame, block: int) -> DataFrame:
    """(source, u, p) with 0 < p < 1 and a size each -> (source, u, up)."""
    kind = units.schema["u"].dataType.simpleString()
    decided, level, rows = None, 0, units
    while True:
        counts = rows.groupBy("source").agg(F.expr(f"cast(ceil(count(*) / {block}) as long)").alias("blocks")).select(F.col("source").alias("of"), "blocks")
        counts = materialize(counts, "blocks")  # its size is known then, so that a few sources don't make all rows move
        dealt = rows.join(counts, rows["source"].eqNullSafe(F.col("of"))).withColumn("block", F.expr(f"pmod(xxhash64({level}, u.draw, u.key), blocks)"))
        folded = dealt.groupBy("source", "block").agg(F.expr("transform(array_sort(collect_list(struct(-u.size as s, u.draw as d, u.key as k, u, p))), x -> struct(x.u as u, x.p as p))").alias("units"), F.max("blocks").alias("blocks"))
        folded = materialize(folded.select("source", "blocks", F.expr(_FOLD.format(unit=kind)).alias("r")), "mixing")
        one = folded.select("source", F.explode("r.done").alias("d")).select("source", "d.u", "d.up")
        decided = one if decided is None else decided.unionByName(one)
        rows = folded.select("source", F.col("r.u").alias("u"), F.col("r.p").alias("p"))
        if folded.where("blocks > 1").isEmpty():
            draw = F.expr("(xxhash64(u.key, u.draw, 'last') & 4503599627370495L) / 4503599627370496D")
            return decided.unionByName(rows.select("source", "u", (draw < F.col("p")).alias("up")))
        level += 1


def _by_tier(units: DataFrame, block: int) -> DataFrame:
    """(source, u, p, tier) -> (source, u, up).

    Documents that are long against what their source still needs are rounded
    before the others.  What the last of them gains or loses, zero on average,
    is spread evenly over the source's shorter documents, so that what remains
    open in the end is a short document.
    """
    rest = units.groupBy(F.col("source").alias("of")).agg(*(F.sum(F.expr(f"CASE WHEN tier >= {t} THEN u.size ELSE 0 END")).alias(f"rest{t}") for t in range(len(TIERS) + 1)))
    rest, decided = materialize(rest, "rest"), None
    for t in range(len(TIERS) + 1):
        shift = rest.select("of", F.lit(0.0).alias("by")) if decided is None else decided.groupBy("source").agg(F.sum(F.expr("u.size * (p - cast(up as int))")).alias("d")).join(rest, F.col("source").eqNullSafe(F.col("of"))).select("of", F.expr(f"try_divide(d, rest{t})").alias("by"))
        here = units.where(F.col("tier") == t).join(shift, F.col("source").eqNullSafe(F.col("of")), "left")
        here = here.select("source", F.struct("u.*", "p").alias("u"), F.expr("greatest(0D, least(1D, p + coalesce(by, 0D)))").alias("p"))
        done = _tree(here.where("p > 0 AND p < 1"), block).unionByName(here.where("p <= 0 OR p >= 1").select("source", "u", F.expr("p >= 1").alias("up")))
        done = done.select("source", "u", "u.p", "up")
        done = materialize(done, "rounded") if t < len(TIERS) else done
        decided = done if decided is None else decided.unionByName(done)
    return decided.select("source", F.struct(*(f"u.{c}" for c in _FIELDS)).alias("u"), "up")


def plan(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Copies of the documents: source, doc_id, key, size, rows, source_size, target, copies.

    Needs doc_id, text and source.  ``rows`` rows are the same in source,
    doc_id and text; they are one unit, and ``copies`` holds for all of them
    together.  Null texts and texts without words have size 0: they add no
    words, and each is copied or not on its own.  A null source is one of the
    sources, the last; null ids take part.  A source without words has target
    0; an empty table gives an empty plan.
    """
    kept = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_key(F.col("text")).alias("key"), n_words(F.col("text")).alias("size"))
    units = materialize(kept.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("rows")), "units")
    sizes = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")))
    sizes = materialize(sizes.withColumnRenamed("source", "of"), "targets")
    rated = units.join(sizes, units["source"].eqNullSafe(F.col("of"))).drop("of")
    rated = rated.withColumn("rate", F.expr("coalesce(try_divide(rows * target, source_size), 0D)"))
    rated = rated.withColumn("rate", F.expr("CASE WHEN abs(rate - round(rate)) < 1e-9 THEN round(rate) ELSE rate END")).withColumn("whole", F.expr("cast(floor(rate) as long)"))
    rated = rated.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "key")).withColumn("p", F.expr("rate - whole"))
    rated = rated.withColumn("mass", F.expr("target - floor(coalesce(try_divide(target, source_size), 0D)) * source_size"))
    open_ = F.expr("p > 0 AND size > 0")
    paired = _by_tier(rated.where(open_).select("source", F.struct(*_FIELDS).alias("u"), "p", F.expr(_TIER).alias("tier")), block)
    lone = rated.where(~open_).select("source", F.struct(*_FIELDS).alias("u"), F.expr("(xxhash64(draw, 'lone') & 4503599627370495L) / 4503599627370496D < p").alias("up"))
    return paired.unionByName(lone).select("source", "u.doc_id", "u.key", "u.size", "u.rows", "u.source_size", "u.target", F.expr("u.whole + cast(up as long)").alias("copies"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs``, all columns as they are, each row as often as the plan says.

    Nulls, repeated rows and empty tables are taken as ``plan`` takes them;
    helper columns have names that ``docs`` doesn't.
    """
    source, ident, key, rows, copies, own, n = unused(docs.columns, "of_source", "of_id", "of_text", "rows", "copies", "own", "nth")
    chosen = plan(docs, seed).where("copies > 0").select(F.col("source").alias(source), F.col("doc_id").alias(ident), F.col("key").alias(key), F.col("rows").alias(rows), F.col("copies").alias(copies))
    chosen = materialize(chosen, "copies")
    same = F.col(ident).eqNullSafe(F.col("doc_id")) & (F.col(key) == F.col(own)) & F.col(source).eqNullSafe(F.col("source").cast("string"))
    found = docs.withColumn(own, text_key(F.col("text"))).join(chosen, same)
    one = found.where(F.col(rows) == 1)
    if not chosen.where(F.col(rows) > 1).isEmpty():
        # Rows that are alike share their copies out, the first ones one more.
        many = prefix.within(found.where(F.col(rows) > 1), n, "doc_id", "source", own)
        one = one.unionByName(many.withColumn(copies, F.expr(f"`{copies}` div `{rows}` + cast(`{n}` < `{copies}` % `{rows}` as long)")).drop(n))
    return one.withColumn(n, F.explode(F.expr(f"array_repeat(0, cast(`{copies}` as int))"))).select(*docs.columns)


#: Rows of a unit that are made from one piece of it.
PIECE = 1 << 16


def shared(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """A plan's rows as one row for each of the documents, with its own copies: the first ones have one more.

    A unit of very many equal rows is cut into pieces, which are dealt to all
    tasks, so that no task makes the rows of more than some pieces.
    """
    one = rows.where("rows = 1")
    many = rows.where("rows > 1").withColumn("piece", F.explode(F.expr(f"sequence(0L, (rows - 1) div {piece})")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.repartition(tasks, F.xxhash64("source", "doc_id", "key", "piece"))
    each = many.withColumn("n", F.explode(F.expr(f"sequence(piece * {piece}, least(rows, (piece + 1) * {piece}) - 1)")))
    return one.unionByName(each.withColumn("copies", F.expr("copies div rows + cast(n < copies % rows as long)")).drop("piece", "n"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared(plan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "size", "source_size", "target", F.expr("size * copies").alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's size and target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = targets(docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    return found.withColumn("target", F.round("target", 3))


_WEIGHTS = list(WEIGHTS)
TARGETS_SQL = rf"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, ({_WEIGHTS})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
o AS (SELECT *, coalesce(sum({MOST} * source_size) OVER before, 0) AS done, coalesce(sum(weight) OVER before, 0) AS heavier, sum(source_size) OVER () AS size, sum(weight) OVER () AS whole
  FROM w WINDOW before AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, source_size, round(least({MOST}.0::DOUBLE * source_size, (SELECT max((size - done) / (whole - heavier)) FROM o) * weight), 3) AS target FROM o
"""
