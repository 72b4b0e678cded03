"""Line dedup by distinct-site spread.

Every line is hashed (128 bits); HyperLogLog sketches of the sites that have it
are built per map task and merged by aggregation, so a line that a third of all
documents hold moves one small sketch a task. Lines whose estimate is clearly
below or above the threshold are settled; those near it get an exact count of
distinct sites. The band is over six standard errors wide on either side (a chance of
about one in a billion a line, by the normal law, that a line is settled wrongly); up
to some 190 sites the sketch still lists what it has seen and is all but exact.
Lines spread over at least ``min_sites`` sites are boilerplate and are removed
from every document.

Documents are read three times (sketches, exact counts of the near lines,
removal). Up to SHIPPED lines of boilerplate, as counted, are shipped to where the
documents are and no text moves. Beyond that each different text gets the hashes that
it loses by a join on its digest, which moves texts once; results are the same.

Cases: null and empty texts have no lines; blank lines are never boilerplate
and stay; lines are compared without surrounding spaces, tabs and carriage
returns; a null site counts as no site; repeated rows and ids each lose the
same lines; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, id_text, map_arrow, stage, utf8

MIN_SITES = 8
LG_K = 11  #: 2048 registers: relative standard error of about 2.3 percent
SHIPPED = 200_000  #: lines of boilerplate, as a set of digests about 20 MB
BAND = 0.15  #: of the threshold, over six standard errors: estimates within are counted exactly


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(F.encode(_bare(line), "UTF-8")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sites_of_lines(df: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """line (hash) and site of every line that is not blank and has a site."""
    return (
        df.where(F.col(site_col).isNotNull())
        .select(F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(_lines(F.col(text_col)))).alias("raw"))
        .where(F.length(_bare(F.col("raw"))) > 0)
        .select(_hash(F.col("raw")).alias("line"), "site")
    )


def boilerplate(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines that at least ``min_sites`` distinct sites have."""
    found = sites_of_lines(df, text_col, site_col)
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    spread = stage(
        found.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("s"))
        .select("line", F.hll_sketch_estimate("s").alias("estimate")).where(F.col("estimate") >= low),
        "spread",
    )
    near = spread.where(F.col("estimate") <= high).select("line")
    exact = found.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return stage(spread.where(F.col("estimate") > high).select("line").unionByName(exact.select("line")), "boilerplate")


def remove(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, shipped: int = SHIPPED
) -> DataFrame:
    """doc_id, n_lines, n_removed and text (what is left) of every row."""
    bad = boilerplate(df, text_col, site_col, min_sites)
    docs = id_text(df, id_col, text_col)
    if bad.count() > shipped:
        return _removed_by_join(docs, bad)
    held = df.sparkSession.sparkContext.broadcast(frozenset(bytes(r["line"]) for r in bad.collect()))

    def rows(batch):
        lost = held.value
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            lines = text.split(b"\n") if text else []
            kept = lines if not lost else [x for x in lines if not (bare := x.strip(b" \t\r")) or hashlib.md5(bare).digest() not in lost]
            yield key, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, rows, f"doc_id {kind}, n_lines long, n_removed long, text string", lambda r: len(r[3]))


def _removed_by_join(docs: DataFrame, bad: DataFrame) -> DataFrame:
    digest = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    # which of its lines each text loses: only lines that are boilerplate survive the join
    lost = (
        docs.select("digest", F.explode(F.array_distinct(_lines(F.col("text")))).alias("raw"))
        .select("digest", _hash(F.col("raw")).alias("line"))
        .join(bad, "line", "left_semi")
        .groupBy("digest").agg(F.collect_set("line").alias("lost"))
    )
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("lost"), _hash(x)))
    )
    return (
        docs.join(lost, "digest", "left")
        .withColumn("lines", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(_lines(F.col("text"))))
        .withColumn("kept", kept)
        .select(
            "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
            F.array_join("kept", "\n").alias("text"),
        )
    )


def op4_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5")
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT DISTINCT source, trim(unnest(l), ' ' || chr(9) || chr(13)) AS line FROM d WHERE source IS NOT NULL),
bad AS (SELECT line FROM x WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8),
r AS (SELECT doc_id, text, l, (SELECT list(line) FROM bad) AS b FROM d),
k AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE l END AS l,
             CASE WHEN text = '' THEN [] ELSE list_filter(l, lambda y: NOT coalesce(list_contains(b, trim(y, ' ' || chr(9) || chr(13))), false)) END AS kept FROM r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(kept) AS BIGINT) AS n_removed,
       CAST(strlen(array_to_string(kept, chr(10))) AS BIGINT) AS kept_bytes, md5(array_to_string(kept, chr(10))) AS kept_md5
FROM k
"""
