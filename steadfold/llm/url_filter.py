"""URL filters by a temporal list join.

A list is a history of dated changes: an entry is put on it or taken off.  The
changes become validity intervals, and a capture is judged by the entries that
were on the list when it was fetched, whatever the list says today.

An entry is a host, which also covers the hosts below it, or a host with the
beginning of a path, in whole segments, whose case matters; closing slashes of
an entry don't count.  A capture's possible hosts, its own and those above it,
are looked up among the hosts of the list by equality.  Only those that are
there are continued by the beginnings of the path and looked up among the
entries, so a capture without a listed host is one row for each of its host's
parts, and no more.  Both lists have one row a key, the entries' with their
intervals in order, so a host with very many captures meets one row; where the
list is large the joins are shuffle joins, whose skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfold.llm.common import LOWER, UPPER, materialize

#: The list of the registered query, as changes (list, entry, action, day).
CHANGES = (
    ("adult", "adult.example.org", "add", "2024-03-01"),
    ("malware", "blog.ththan.example.net", "add", "2024-02-10"),
    ("malware", "blog.ththan.example.net", "remove", "2024-04-20"),
    ("malware", "blog.ththan.example.net", "add", "2024-09-01"),
    ("malware", "ththre.example.com/fr", "add", "2024-01-15"),
    ("spam", "cheap-pills.example.com", "add", "2024-01-01"),
    ("spam", "cheap-pills.example.com", "remove", "2024-06-15"),
    ("spam", "cheap-pills.example.com", "add", "2024-08-01"),
    ("spam", "spam-farm.example.org", "add", "2024-01-01"),
    ("spam", "casino.example.net", "add", "2024-05-05"),
    ("tracking", "m.ththth.example.net", "add", "2024-07-01"),
    ("tracking", "example.org/es", "add", "2024-10-01"),
    ("tracking", "cdn.example.com/a/b/c/d/", "add", "2024-01-01"),
    ("malware", "a.b.c.d.e.f.g.h.example.org", "add", "2024-02-01"),
)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and closing dots; null without one."""
    authority = F.regexp_extract(F.translate(url, UPPER, LOWER), r"^\s*[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.*(:[0-9]*)?$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path of a URL, from its slash on, without query and fragment; empty without one."""
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def depths(entries: DataFrame) -> tuple[int, int, int]:
    """The smallest and largest number of a host's labels, and the largest of a path's slashes, over all entries."""
    labels = F.size(F.split("host", r"\."))
    slashes = F.length("entry") - F.length(F.replace(F.col("entry"), F.lit("/"), F.lit("")))
    most = entries.agg(F.min(labels).alias("least"), F.max(labels).alias("most"), F.max(slashes).alias("slashes")).first()
    return most.least or 1, most.most or 0, most.slashes or 0


def hosts_above(host: Column, least: int, most: int) -> Column:
    """A host and the hosts above it, of ``least`` to ``most`` labels; none for null."""
    labels = F.split(host, r"\.")
    last = F.least(F.size(labels), F.lit(most))
    every = F.transform(F.sequence(F.lit(least), last), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    return F.when(host.isNull() | (last < least), F.expr("cast(array() as array<string>)")).otherwise(every)


def beginnings(path: Column, most: int) -> Column:
    """A path's beginnings in whole segments, of ``most`` slashes at most: of /a/b they are nothing, /a and /a/b."""
    segments = F.slice(F.split(path, "/"), 1, most + 1)
    return F.transform(segments, lambda x, i: F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))


def validity(changes: DataFrame) -> DataFrame:
    """(list, entry, action, at) -> list, entry, start, end: where each entry was on each list.

    ``start`` is within and ``end`` is not; it is null while the entry stays.
    Hosts are in lower case; closing dots of a host and closing slashes of an
    entry are left out.  Of several changes at one time an ``add`` counts last.  Changes that change
    nothing, nulls in any column and other actions are left out.
    """
    known = changes.where("list IS NOT NULL AND entry IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    plain = F.regexp_replace("entry", "/+$", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(plain, "^[^/]*", 0), UPPER, LOWER), r"\.+$", "")
    entry = F.concat(host, F.regexp_replace(plain, "^[^/]*", "")).alias("entry")
    one = known.groupBy("list", entry, "at").agg(F.max(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("list", "entry").orderBy("at")
    turned = one.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where("on <> was")
    return turned.withColumn("end", F.lead("at").over(order)).where("on").select("list", "entry", F.col("at").alias("start"), "end")


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Every capture's page_id, host, n_entries, lists, entry and since: the entries on a list at its ``fetched_at``.

    ``lists`` has the distinct names, sorted and comma-joined; ``entry`` is the
    longest one, the first in order of several, and ``since`` the start of its
    interval.  An entry's intervals are one array, as long as its changes are
    many.  A URL that is null or has no host, and a capture whose time is
    null, match nothing and get n_entries 0, lists '' and nulls.  Repeated rows
    each get their row; an empty table gives an empty result.
    """
    entries = validity(changes).groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("start", "end", "list"))).alias("spans"))
    entries = materialize(entries.withColumn("host", F.regexp_extract("entry", "^[^/]*", 0)), "entries")
    least, most, slashes = depths(entries)
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), beginnings(path_of(F.col("url")), slashes).alias("paths"), "fetched_at").withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows, "captures")
    hosts = rows.where("fetched_at IS NOT NULL").select("rid", "fetched_at", "paths", F.explode(hosts_above(F.col("host"), least, most)).alias("above"))
    listed = hosts.join(entries.select(F.col("host").alias("above")).distinct(), "above", "left_semi")
    keyed = listed.select("rid", "fetched_at", F.explode(F.transform("paths", lambda p: F.concat("above", p))).alias("entry")).join(entries.select("entry", "spans"), "entry")
    active = keyed.select("rid", "entry", F.explode(F.expr("filter(spans, s -> s.start <= fetched_at AND (s.end IS NULL OR fetched_at < s.end))")).alias("s"))
    best = F.min(F.struct((-F.length("entry")).alias("n"), "entry", F.col("s.start").alias("start"))).alias("best")
    found = active.groupBy("rid").agg(F.count("*").alias("n_entries"), F.array_join(F.sort_array(F.collect_set("s.list")), ",").alias("lists"), best)
    out = rows.join(found, "rid", "left")
    return out.select("page_id", "host", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("best.entry").alias("entry"), F.col("best.start").alias("since"))


#: The names of the lists that ``drawn_changes`` deals entries to, and of 16 hosts, first folders and pages so many are listed.
LISTS, SHARES = ("adult", "malware", "spam", "tracking"), (1, 2, 4)


def drawn_changes(pages: DataFrame) -> DataFrame:
    """A list that grows with the pages, (list, entry, action, at): of their hosts, first folders and pages some, by the MD5 of the entry.

    An entry is added on a day of 2024 that its hash draws; about half of them
    are removed later, and half of those added again.  Entries of ``CHANGES``
    aren't drawn.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host IS NOT NULL")
    kinds = F.array(F.struct(F.col("host").alias("entry"), F.lit(SHARES[0]).alias("share")), F.struct(F.concat("host", F.regexp_extract("path", "^/[^/]+", 0)).alias("entry"), F.lit(SHARES[1]).alias("share")), F.struct(F.concat("host", F.rtrim("path", F.lit("/"))).alias("entry"), F.lit(SHARES[2]).alias("share")))
    each = rows.select(F.explode(kinds).alias("k")).select("k.*").groupBy("entry").agg(F.min("share").alias("share"))
    digit = lambda k: F.conv(F.substring(F.md5(F.col("entry").cast("binary")), k, 1), 16, 10).cast("int")
    chosen = each.where((digit(2) < F.col("share")) & ~F.col("entry").isin([e.rstrip("/") for _, e, _, _ in CHANGES]))
    first = F.date_add(F.lit("2024-01-01").cast("date"), 16 * digit(3) + digit(4))
    second = F.date_add(first, 20 + 4 * digit(6))
    third = F.date_add(second, 10 + digit(8))
    change = lambda action, day, fits: F.when(fits, F.struct(F.lit(action).alias("action"), day.cast("timestamp").alias("at")))
    changes = F.array(change("add", first, F.lit(True)), change("remove", second, digit(5) < 8), change("add", third, (digit(5) < 8) & (digit(7) < 8)))
    name = F.get(F.array(*map(F.lit, LISTS)), digit(1) % len(LISTS)).alias("list")
    return chosen.select(name, "entry", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("list", "entry", "c.action", "c.at")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time; page_id modulo 366 is taken as the day of 2024 on which each was fetched.  The list is ``CHANGES`` and one drawn from the pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.expr("timestamp '2024-01-01 12:00:00' + make_dt_interval(cast(page_id % 366 as int))").alias("fetched_at"))
    values = ", ".join(f"('{a}', '{b}', '{c}', timestamp '{d} 00:00:00')" for a, b, c, d in CHANGES)
    rows = judge(captures, spark.sql(f"SELECT * FROM VALUES {values} AS c(list, entry, action, at)").unionByName(drawn_changes(pages)))
    return rows.select("page_id", "host", "n_entries", "lists", "entry", F.date_format("since", "yyyy-MM-dd").alias("since"), (F.col("n_entries") > 0).alias("blocked"))


_VALUES = ", ".join(f"('{a}', rtrim('{b}', '/'), '{c}', DATE '{d}')" for a, b, c, d in CHANGES)
SQL = rf"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS day,
         nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.*(:[0-9]*)?$', ''), '') AS host,
         regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
every AS (
  SELECT entry, min(share) AS share FROM (
    SELECT host AS entry, {SHARES[0]} AS share FROM p UNION ALL SELECT host || regexp_extract(path, '^/[^/]+', 0), {SHARES[1]} FROM p UNION ALL SELECT host || rtrim(path, '/'), {SHARES[2]} FROM p)
  WHERE entry IS NOT NULL GROUP BY entry),
digits AS (SELECT entry, share, list_transform(range(1, 9), lambda k: ('0x' || substr(md5(entry), k, 1))::INT) AS d FROM every),
drawn AS (
  SELECT {list(LISTS)}[d[1] % {len(LISTS)} + 1] AS list, entry, d, DATE '2024-01-01' + (16 * d[3] + d[4]) AS first, DATE '2024-01-01' + (16 * d[3] + d[4] + 20 + 4 * d[6]) AS second,
         DATE '2024-01-01' + (16 * d[3] + d[4] + 30 + 4 * d[6] + d[8]) AS third
  FROM digits WHERE d[2] < share AND entry NOT IN (SELECT rtrim(e, '/') FROM (VALUES {_VALUES}) AS f(l, e, a, c))),
changes(list, entry, action, changed) AS (
  SELECT * FROM (VALUES {_VALUES}) UNION ALL SELECT list, entry, 'add', first FROM drawn UNION ALL SELECT list, entry, 'remove', second FROM drawn WHERE d[5] < 8
  UNION ALL SELECT list, entry, 'add', third FROM drawn WHERE d[5] < 8 AND d[7] < 8),
spans AS (
  SELECT list, entry, changed AS start, next FROM (
    SELECT *, lead(changed) OVER (PARTITION BY list, entry ORDER BY changed) AS next FROM changes) WHERE action = 'add'),
m AS (
  SELECT rid, s.* FROM p JOIN spans s
    ON (host = split_part(entry, '/', 1) OR ends_with(host, '.' || split_part(entry, '/', 1)))
   AND (NOT contains(entry, '/') OR starts_with(path || '/', substr(entry, strpos(entry, '/')) || '/'))
   AND start <= day AND (next IS NULL OR day < next)),
f AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
         min(struct_pack(n := -length(entry), e := entry, s := start)) AS best
  FROM m GROUP BY rid)
SELECT page_id, host, coalesce(n, 0)::BIGINT AS n_entries, coalesce(lists, '') AS lists, best.e AS entry,
       strftime(best.s, '%Y-%m-%d') AS since, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN f USING (rid)
"""
