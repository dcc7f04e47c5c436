"""URL filters: rules by host and path, then a blocked Bloom filter of listed canonical URLs and an exact hash join.

The filter has a fixed number of blocks of four 64-bit words; a URL sets two bits in each word of one block. It is
built by a partial aggregation (bit_or by block), so its size, which is what is broadcast, is bounded whatever the
list's. Only URLs that pass it meet the list in a hash join, which removes the false positives; a fuller filter
passes more, and the result stays exact.

Defined cases: a null URL or one without `://` has empty host, path and canonical form, fits no rule and is on no list
(allowed); repeated rows each get their verdict; extra columns are ignored; empty tables give empty results, an empty
list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.llm.text import spark_tables

#: Blocks of the filter: 2**16 rows of 40 bytes when broadcast.
BLOCK_BITS = 16
#: Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def _part(url: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), _URL, group), F.lit(""))


def host(url: str = "url") -> Column:
    return F.translate(_part(url, 1), _UP, _LOW)


def path(url: str = "url") -> Column:
    return _part(url, 2)


def canonical(url: str = "url") -> Column:
    """Host without a leading www. and default port, path without trailing slashes, the query's other than tracking
    parameters in order; no scheme, no fragment. Null where there is no host."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    kept = F.array_sort(F.filter(F.split(_part(url, 3), "&"), lambda p: (p != "") & ~p.rlike(_TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(name != "", F.concat(name, F.regexp_replace(path(url), "/+$", ""), query))


def rule_of(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of columns host and path: the longest rule that fits, or null."""
    which, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        which, says = F.when(fits, h + p).otherwise(which), F.when(fits, verdict).otherwise(says)
    return which, says


def _bits(url: str) -> tuple[Column, list[Column]]:
    """A URL's block and its bits in each of the block's four words."""
    spread = F.xxhash64(F.col(url), F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * k).bitwiseAND(63).cast("int"))
    return F.xxhash64(F.col(url)).bitwiseAND((1 << BLOCK_BITS) - 1), [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom(listed: DataFrame) -> DataFrame:
    """_block and its four words, of the URLs (canon): 2**BLOCK_BITS rows at most."""
    block, words = _bits("canon")
    return listed.select(block.alias("_block"), *(w.alias(f"_m{k}") for k, w in enumerate(words))).groupBy("_block").agg(*(F.bit_or(f"_m{k}").alias(f"_w{k}") for k in range(4)))


def on_list(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows (with a column canon) and `listed`: whether canon is among listed.canon."""
    listed = listed.where("canon is not null").select("canon").distinct()
    block, words = _bits("canon")
    probed = rows.withColumn("_block", block).join(F.broadcast(bloom(listed)), "_block", "left")
    passes = F.lit(True)
    for k, w in enumerate(words):
        passes = passes & (F.col(f"_w{k}").bitwiseAND(w) == w)
    probed = probed.withColumn("_maybe", F.coalesce(F.col("canon").isNotNull() & passes, F.lit(False)))
    exact = probed.where("_maybe").join(listed.withColumn("_listed", F.lit(True)), "canon", "left").select(*rows.columns, F.coalesce("_listed", F.lit(False)).alias("listed"))
    return exact.union(probed.where("not _maybe").select(*rows.columns, F.lit(False)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url)."""
    rows = pages.select("page_id", host().alias("host"), path().alias("path"), canonical().alias("canon"))
    which, says = rule_of(rules)
    return on_list(rows, listed).select("page_id", "host", "path", which.alias("rule"), F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canon: the block list that is derived from the given tables, the URLs that lead to documents labelled toxic."""
    pages = spark_tables(spark, sf_dir, "pages").select("url", F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{1,18})', 1) as bigint)").alias("doc_id"))
    toxic = spark_tables(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return pages.join(toxic, "doc_id").select(canonical().alias("canon"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark_tables(spark, sf_dir, "pages"), listed_urls(spark, sf_dir))


_CANON = rf"""CASE WHEN n = '' THEN NULL ELSE n || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END"""
QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {
    "op5_url_filter": rf"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path,
 list_sort(list_filter(string_split(coalesce(regexp_extract(url, '{_URL}', 3), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACKING}'))) AS q FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') AS n FROM p),
c AS (SELECT page_id, url, host, path, {_CANON} AS canon FROM h),
l AS (SELECT DISTINCT canon FROM c JOIN labels ON labels.doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT) WHERE toxic = 1 AND canon IS NOT NULL),
r AS (SELECT c.*, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
 WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN l ON r.canon = l.canon"""
}
