"""Boilerplate lines by how many sites they appear on, in column expressions only.

1. Every task keeps a HyperLogLog sketch of the sites per line hash; the sketches merge in the aggregation, so a line
   with a third of all rows is one row a task.
2. Lines whose estimate is clearly at or above ``min_sites`` are boilerplate, those clearly below are not.
3. Lines whose estimate lies within ``band`` of the threshold get an exact distinct count of sites.
4. A line on ``min_sites`` sites or more is removed wherever it stands, first copy included: it belongs to the page
   frame, not to the text.

Defined results: a null text has no lines and stays null; an empty line is never removed; a null site is a site of its
own; a document whose lines all go keeps an empty text; repeated rows are treated alike; other columns, whatever their
names, pass through, except that columns called n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt.llm.scratch import stored, without

MIN_SITES = 10
LG_K = 12
BAND = 0.1


def line_key(line: Column) -> Column:
    """96 bits: two hashes, so that different lines do not meet at any realistic size."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _line_rows(docs: DataFrame, text: str, site: str, doc: str) -> DataFrame:
    lines = F.explode(F.array_distinct(F.split(F.col(f"`{text}`"), "\n", -1)))
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.coalesce(F.xxhash64(F.col(f"`{site}`")), F.lit(0)).alias("site"), lines.alias("line"))
    return rows.where("line != ''").select("doc", "site", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def boilerplate_lines(docs: DataFrame, text: str = "text", site: str = "source", doc: str = "doc_id", min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """Hashes (h, g) of the lines found on at least ``min_sites`` distinct sites."""
    rows = _line_rows(docs, text, site, doc)
    sketches = rows.groupBy("h", "g").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = stored(sketches.select("h", "g", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band) - 1), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band) + 1).select("h", "g")
    near = spread.where(F.col("sites").between(min_sites * (1 - band) - 1, min_sites * (1 + band) + 1)).select("h", "g")
    exact = (
        rows.select("h", "g", "site").distinct().join(near, ["h", "g"], "left_semi")
        .groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h", "g")
    )
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", doc: str = "doc_id", min_sites: int = MIN_SITES, lines: DataFrame | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    Only the hashes that a document holds travel to it: at most one small array per document.
    """
    docs = without(docs, "n_lines", "n_removed")
    spread_out = lines if lines is not None else boilerplate_lines(docs, text, site, doc, min_sites)
    held = (
        _line_rows(docs, text, site, doc).join(spread_out, ["h", "g"], "left_semi")
        .groupBy("doc").agg(F.collect_set(F.struct("h", "g")).alias("__held"))
    )
    joined = docs.alias("d").join(held.alias("b"), F.col(f"d.`{doc}`").eqNullSafe(F.col("b.doc")), "left")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    split = joined.select(*columns, F.col("b.__held").alias("__held"), F.split(F.col(f"d.`{text}`"), "\n", -1).alias("__lines"))
    kept = F.when(F.col("__held").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: (x == "") | ~F.array_contains("__held", line_key(x))))
    names = [F.col(f"`{c}`") for c in docs.columns]
    filtered = split.select(*names, F.col("__lines"), kept.alias("__kept"))
    out = [F.array_join("__kept", "\n").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    n_lines = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
    return filtered.select(*out, F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"), F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(F.size("__lines") - F.size("__kept")).cast("long").alias("n_removed"))
