"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join. DataFrame functions only.

A list entry is a host and a path prefix, written ``host/path``; it fits its host and all subdomains where the url's path
starts with the entry's. A url's candidate keys are its host suffixes joined to its path prefixes, of just those label
counts and prefix lengths that the list has. Rules stand as they are written; listed urls are made canonical by the function
that makes the pages' hosts so: no scheme needed, lower case, no user, port or final dot. Each key sets three bits in one 64-bit
block; the filter has about four entries to a block and at most ``MAX_BLOCKS`` (16 bytes each), so its broadcast is bounded
whatever the list's size; beyond 8 million entries it only lets more false positives through to the join, which removes
them all. How the join is done is left to Spark, which knows the list's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 32 MB.
MAX_BLOCKS = 1 << 21

#: The rules of the query.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Listed urls of the query, blocked where no rule fits.
LISTED = tuple(f"http://{name}.example.{top}/" for name in ("casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null or a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    """host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")


def entries(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """entry, verdict, kind of rules (entry, verdict) and listed urls, a sequence or a table with a column url. Urls without a scheme
    have one put before them; those without a host, and nulls, list nothing. Of entries that occur more than once as one kind,
    block stands."""
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(u,) for u in listed], "url string")
    url = F.when(F.instr("url", "://") > 0, F.col("url")).otherwise(F.concat(F.lit("http://"), "url"))
    host, path = host_and_path(url)
    blocked = listed.select(canonical(host).alias("host"), F.when(path == "", "/").otherwise(path).alias("path")).where("host <> ''")
    blocked = blocked.select(F.concat("host", "path").alias("entry"), F.lit("block").alias("verdict"), F.lit("listed").alias("kind"))
    ruled = spark.createDataFrame([(e, v, "rule") for e, v in rules], "entry string, verdict string, kind string")
    return ruled.unionAll(blocked).groupBy("entry", "kind").agg(F.max("verdict").alias("verdict"))


def block_and_mask(key: str, blocks: int) -> tuple[Column, Column]:
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}), {s}) & 63L as int))" for s in (20, 32, 44))
    return F.expr(f"pmod(xxhash64({key}), {blocks}L)"), F.expr(bits)


def judge(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    The longest fitting rule decides; where none fits, a listed entry means block, and none allow. Rows are kept one for one:
    repeated pages, null ids and null urls (both parts empty, so no rule fits) included. An empty list allows all.
    """
    host_part = F.split_part("entry", F.lit("/"), F.lit(1))
    shape = listing.select("kind", F.size(F.split(host_part, "[.]")).alias("labels"), (F.length("entry") - F.length(host_part)).alias("prefix"))
    one = lambda kind, c: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col(c)))).alias(f"{kind}_{c}")
    stat = shape.agg(*[one(k, c) for k in ("rule", "listed") for c in ("labels", "prefix")], F.count(F.lit(1)).alias("n")).first()

    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), h.alias("own"), F.array(*map(F.lit, stat[f"{k}_labels"])).cast("array<int>").alias("labels"), F.array(*map(F.lit, stat[f"{k}_prefix"])).cast("array<int>").alias("prefixes"))
        for k, h in (("rule", F.col("host")), ("listed", canonical(F.col("host"))))
    ])
    # a listed url without a path of its own fits an empty path too
    each = parsed.where("host <> ''").select("host", "path", F.explode(kinds).alias("k")).select("host", "path", "k.*", F.when((F.col("k.kind") == "listed") & (F.col("path") == ""), "/").otherwise(F.col("path")).alias("at")).where("at <> ''")
    keys = (
        each.select("host", "path", "kind", "own", "at", "prefixes", F.explode(F.filter("labels", lambda n: n <= F.size(F.split("own", "[.]")))).alias("n_labels"))
        .select("host", "path", "kind", F.expr("substring_index(own, '.', -n_labels)").alias("suffix"), "at", F.explode(F.filter("prefixes", lambda n: n <= F.length("at"))).alias("n_prefix"))
        .select("host", "path", "kind", F.concat("suffix", F.expr("substring(at, 1, n_prefix)")).alias("entry"))
    )

    blocks = min(MAX_BLOCKS, 1 << max(0, (stat.n // 4).bit_length()))
    block, mask = block_and_mask("entry", blocks)
    bloom = listing.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    possible = keys.withColumn("block", block).join(F.broadcast(bloom), "block").where((F.col("word").bitwiseAND(mask)) == mask).select("host", "path", "kind", "entry").distinct()

    exact = possible.join(listing, ["entry", "kind"])
    best = exact.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "rule", F.struct(F.length("entry").alias("length"), "entry", "verdict"))).alias("rule"),
        F.max(F.when(F.col("kind") == "listed", F.lit("block"))).alias("listed"),
    )
    # joined by a key of its own, so that both sides are dealt anew and a hot url can be split
    best = best.select(F.concat("host", "path").alias("place"), F.col("rule.entry").alias("rule"), F.coalesce("rule.verdict", "listed").alias("found"))
    return (
        parsed.withColumn("place", F.concat("host", "path")).join(best, "place", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"))
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS plain FROM p),
e(entry, verdict) AS (VALUES {_values(RULES)}),
f AS (SELECT d.host, d.path, e.* FROM d, e
      WHERE (d.host = split_part(e.entry, '/', 1) OR suffix(d.host, '.' || split_part(e.entry, '/', 1)))
        AND starts_with(d.path, substr(e.entry, length(split_part(e.entry, '/', 1)) + 1))),
b AS (SELECT host, path, arg_max(entry, length(entry)) AS rule, arg_max(verdict, length(entry)) AS found FROM f GROUP BY host, path),
l(h) AS (VALUES {_values([(x.split('/')[2],) for x in LISTED])}),
k AS (SELECT DISTINCT host FROM d, l WHERE plain = h OR suffix(plain, '.' || h))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.found, CASE WHEN k.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path LEFT JOIN k ON p.host = k.host
"""
