"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. Each distinct blob is scanned once by each
version of each rule that the ledger does not have for it yet; findings are kept by blob and joined back to all paths
that ever held it. A rule finds leftmost non-overlapping matches and drops those whose tested part is too short.

Offsets: each rule's pattern is matched with the text before it, `\\G(.*?)(rule)`, so consecutive matches cover the
text without gaps and the running sum of their lengths gives the code point at which each ends. `\\G` ties each to
the one before, so a text is gone through once.

Blobs are grouped by hash with one text kept per group in the partial aggregation already, so a text that a third of
all rows hold is shuffled once per task. Findings meet paths by hash.

Defined cases: a null text is the empty blob and has no findings; repeated rows each get the findings of their blob;
extra columns are ignored; empty tables give empty results; without findings the counts are 0 and the digests those of
the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstack.llm.text import spark_tables, stash


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length is tested (0: the whole match), the least length, and a version.

    Where a pattern ends in a run that decides alone whether a match is long enough, `tight` asks for that run at once: it
    has the same matches as those of `pattern` that are kept, without all the short ones in between."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    tight: str | None = None


#: Fixed values.
RULES = [
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, tight=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, tight=r"[0-9a-f]{16,}"),
]


def _matches(rule: Rule):
    """Of the blob's text: (kind, version, whole: code points since the last match's end, gap before it, ok)."""
    both = r"(?s)\G(.*?)(" + (rule.tight or rule.pattern) + ")"
    whole, gaps = F.regexp_extract_all("text", F.lit(both), F.lit(0)), F.regexp_extract_all("text", F.lit(both), F.lit(1))

    def one(x, gap):
        at = F.char_length(gap)
        match = F.substring(x, at + 1, F.char_length(x))
        tested = F.char_length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.group else F.char_length(x) - at
        return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.char_length(x).alias("whole"), at.alias("gap"), (tested >= rule.least).alias("ok"))

    return F.zip_with(whole, gaps, one)


def blobs(versions: DataFrame) -> DataFrame:
    """(blob, text): each distinct text once."""
    return versions.select(F.coalesce("text", F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))


def scan(unique: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, scanned) of the blobs (blob, text): new findings (blob, kind, version, start, end), code points and
    end exclusive, and the new ledger rows (blob, kind, version). ledger: the rows of earlier scans; those pairs are
    not scanned again."""
    names = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    if ledger is None:
        open_ = unique.withColumn("_open", names)
    else:
        seen = ledger.where(F.concat_ws(":", "kind", "version").isin(*(f"{r.kind}:{r.version}" for r in rules))).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("_seen"))
        open_ = unique.join(seen, "blob", "left").withColumn("_open", F.array_except(names, F.coalesce("_seen", F.array().cast("array<string>")))).where("size(_open) > 0")
    found = [F.when(F.array_contains("_open", f"{r.kind}:{r.version}") & F.col("text").rlike(r.tight or r.pattern), _matches(r)) for r in rules]
    kind = "array<struct<kind:string,version:int,whole:int,gap:int,ok:boolean>>"
    raw = open_.select("blob", F.explode(F.array(*(F.coalesce(x, F.array().cast(kind)) for x in found))).alias("m")).select("blob", F.posexplode("m").alias("i", "m")).select("blob", "i", "m.*")
    end = F.sum("whole").over(Window.partitionBy("blob", "kind", "version").orderBy("i"))
    ends = raw.withColumn("end", end).withColumn("start", F.col("end") - F.col("whole") + F.col("gap"))
    scanned = open_.select("blob", F.explode("_open").alias("r")).select("blob", F.split("r", ":")[0].alias("kind"), F.split("r", ":")[1].cast("int").alias("version"))
    return ends.where("ok").select("blob", "kind", "version", "start", "end"), scanned


def advance(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(ledger, findings) after these versions (text) have been scanned too: only blobs that the ledger does not have, or has not for
    a rule's version, are scanned; both are written to the shared folder, with what was there before."""
    found, scanned = scan(blobs(versions), ledger, rules)
    found, scanned = stash(found), stash(scanned)
    return (ledger.union(scanned), findings.union(found)) if ledger is not None else (scanned, found)


def by_path(versions: DataFrame, findings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, and the spans of its blob by the rules' versions: (start, number of the kind, end), in order."""
    number = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))))
    current = F.concat_ws(":", "kind", "version").isin(*(f"{r.kind}:{r.version}" for r in rules))
    spans = findings.where(current).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", number[F.col("kind")].alias("k"), "end"))).alias("spans"))
    return versions.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")).join(spans, "blob", "left").select("doc_id", "blob", "spans")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two deliveries, by source: what the first one's blobs gave is in the ledger when the second one comes."""
    docs = spark_tables(spark, sf_dir, "documents").select("doc_id", "text", F.pmod(F.xxhash64("source"), F.lit(2)).alias("_delivery"))
    ledger = findings = None
    for k in range(2):
        ledger, findings = advance(docs.where(F.col("_delivery") == k), ledger, findings)
    rows = by_path(docs, findings)
    count = lambda k: F.coalesce(F.size(F.filter("spans", lambda x: x["k"] == k)), F.lit(0)).cast("long")
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    text = F.when(F.col("spans").isNull(), "").otherwise(F.array_join(F.transform("spans", lambda x: F.concat_ws(":", kinds[x["k"]], x["start"], x["end"])), ","))
    return rows.select("doc_id", *(F.when(F.col("spans").isNull(), 0).otherwise(count(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(RULES)), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _sql(rule: Rule, k: int) -> str:
    both = ("(?s)(.*?)(" + rule.pattern + ")").replace("'", "''")
    tested = "len(regexp_extract(whole[len(gap) + 1:], '" + rule.pattern.replace("'", "''") + f"', {rule.group}))" if rule.group else "len(whole) - len(gap)"
    return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, e - len(whole) + len(gap) AS s, e FROM (SELECT doc_id, whole, gap, sum(len(whole)) OVER (PARTITION BY doc_id ORDER BY i) AS e
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{both}', 0)) AS whole, unnest(regexp_extract_all(text, '{both}', 1)) AS gap, generate_subscripts(regexp_extract_all(text, '{both}', 0), 1) AS i FROM documents)) WHERE {tested} >= {rule.least}"""


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES = {
    "op2_secret_scan": "WITH f AS ("
    + " UNION ALL ".join(_sql(r, k) for k, r in enumerate(RULES))
    + """), g AS (SELECT doc_id, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS c,
 string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""
}
