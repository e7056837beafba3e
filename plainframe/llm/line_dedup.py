"""Line deduplication by site-relative frequency, in DataFrame functions alone.

A line's frequency on a host is the share of the host's pages that contain it. Lines whose share is
over a boilerplate ratio are dropped from every page of that host.

Pages send one 16-byte digest per distinct line, summed on the map side; texts stay where they are.
Lines over the ratio r number at most (mean lines a page) / r on a host, whatever its size, so a
host's list is small. All lists are counted first: up to BROADCAST_LINES lines they go to every task
and texts are not shuffled at all; beyond that pages are joined with the lists on the host, where
adaptive execution splits a hot host's pages.

Cases: lines are compared without spaces, tabs and carriage returns around them; blank lines stay
and count as no line. A null text counts as empty and comes back null. Pages without a host share
one. Every host goes by the ratio, but a line on one page alone is never boilerplate; min_pages
leaves smaller hosts alone where a caller asks for it. Repeated rows
count as pages of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import let, ship, write_table

#: Share of a host's pages over which a line is boilerplate, and pages a host needs: any host goes by the ratio.
RATIO, MIN_PAGES = 0.05, 1
#: Lines of all hosts, at 16 bytes each, that are broadcast at most.
BROADCAST_LINES = 500_000


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(bare(line)))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """_pf_host and _pf_lines, the digests of its boilerplate lines."""
    pages = docs.select(F.col(host_col).alias("_pf_host"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    lines = F.array_distinct(F.transform(F.filter("lines", lambda x: bare(x) != ""), digest))
    counts = pages.select("_pf_host", F.explode(lines).alias("line")).groupBy("_pf_host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = docs.groupBy(F.col(host_col).alias("_pf_host")).agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = totals.withColumnRenamed("_pf_host", "host")
    over = counts.filter("n > 1").join(totals, F.col("_pf_host").eqNullSafe(F.col("host"))).filter(F.col("n") > ratio * F.col("n_pages"))
    return over.groupBy("_pf_host").agg(F.collect_list("line").alias("_pf_lines"))


def line_dedup(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, report: bool = False) -> DataFrame:
    """docs with boilerplate lines gone from their texts; report adds n_lines and n_dropped."""
    ship(docs.sparkSession)
    found = write_table(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    if (found.agg(F.sum(F.size("_pf_lines")).alias("n")).first().n or 0) <= BROADCAST_LINES:
        found = F.broadcast(found)
    joined = docs.join(found, F.col(f"`{host_col}`").eqNullSafe(F.col("_pf_host")), "left")
    text, lines = F.col(f"`{text_col}`"), F.split(F.col(f"`{text_col}`"), "\n")

    def without(x: Column) -> Column:
        """Lines that stay. A page's lines are digested once and meet the host's list by hash; blank lines are in no list."""
        stay = lambda d: let(F.array_intersect(d, "_pf_lines"), lambda hits: F.when(F.size(hits) == 0, x).otherwise(F.filter(x, lambda _, i: ~F.array_contains(hits, F.get(d, i)))))
        return let(F.transform(x, digest), stay)

    kept = F.when(F.col("_pf_lines").isNull(), lines).otherwise(let(lines, without))
    names = [c for c in docs.columns if c != text_col]
    rows = joined.select(*(F.col(f"`{c}`").alias(f"_pf_{i}") for i, c in enumerate(names)), text.alias("_pf_text"), kept.alias("_pf_kept"))
    place = {c: F.col(f"_pf_{i}") for i, c in enumerate(names)}
    out = [F.array_join("_pf_kept", "\n").alias(c) if c == text_col else place[c].alias(c) for c in docs.columns]
    if report:
        lines = F.split("_pf_text", "\n")
        n_lines = F.coalesce(F.size(F.filter(lines, lambda x: bare(x) != "")), F.lit(0))
        n_dropped = F.coalesce(F.size(lines) - F.size("_pf_kept"), F.lit(0))
        out += [F.when(F.col("_pf_text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("_pf_text").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped")]
    return rows.select(*out)


ORACLE = """
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT DISTINCT doc_id, source, trim(l, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, source, unnest(lines) AS l FROM pages) WHERE trim(l, ' ' || chr(9) || chr(13)) <> ''),
totals AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
over AS (SELECT source, list(line) AS found FROM (SELECT source, line, count(*) AS n FROM each GROUP BY ALL) JOIN totals USING (source) WHERE n > 1 AND n > CAST(0.05 AS DOUBLE) * n_pages GROUP BY source),
cut AS (
  SELECT doc_id, lines, list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND list_contains(coalesce(found, []), trim(x, ' ' || chr(9) || chr(13)))) AS gone,
    list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(coalesce(found, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
  FROM pages LEFT JOIN over USING (source))
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(len(list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_dropped FROM cut
"""
