"""Line dedup: lines that many distinct sites share are boilerplate and go.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import back, numbered

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 5
#: Shorter lines (after trimming) are never boilerplate: short phrases recur by chance.
MIN_CHARS = 20
#: log2 of a sketch's registers, and the relative error beyond which an estimate is trusted: over five times 1.04 / sqrt(2^12).
LG_K, MARGIN = 12, 0.1


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def plain(line: Column) -> Column:
    """The line without white space at its ends; null for lines too short to count."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(F.char_length(bare) >= MIN_CHARS, bare)


def line_hash(line: Column) -> Column:
    """The 128-bit hash of the trimmed line; null for lines too short to count."""
    return F.unhex(F.md5(plain(line).cast("binary")))


def hashed_lines(docs: DataFrame, text: str, *also: Column) -> DataFrame:
    """The columns `also` and `_line`, the hash, for each distinct line of each row that counts.

    Lines are made distinct as strings: Spark compares every two binary values of an array.
    """
    each = docs.select(*also, F.explode(F.array_distinct(F.transform(lines(F.col(text)), plain))).alias("_plain")).where("_plain is not null")
    return each.withColumn("_line", F.unhex(F.md5(F.col("_plain").cast("binary")))).drop("_plain")


def boilerplate(docs: DataFrame, text: str, site: str, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (`_line`) of the lines that at least `min_sites` distinct non-null sites have.

    Sketches of sites merge line by line, within tasks and then across them. Estimates over the margin decide; lines
    near the threshold are counted again, exactly.
    """
    each = hashed_lines(docs.where(F.col(site).isNotNull()), text, F.col(site).cast("string").alias("_site")).where("_site is not null")
    spread = each.groupBy("_line").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), F.count("*").alias("_rows")).where(F.col("_rows") >= min_sites)
    spread = spread.select("_line", F.hll_sketch_estimate("_sketch").alias("_sites")).where(F.col("_sites") >= min_sites * (1 - MARGIN) - 1)
    sure = spread.where(F.col("_sites") > min_sites * (1 + MARGIN) + 1).select("_line")
    near = spread.where(F.col("_sites") <= min_sites * (1 + MARGIN) + 1).select("_line")
    # A key of its own makes Spark shuffle both sides for a join, and only such joins can split a hot line.
    near = near.select(F.xxhash64("_line").alias("_k"), F.col("_line").alias("_near"))
    exact = each.join(near, [F.xxhash64("_line") == F.col("_k"), F.col("_line") == F.col("_near")], "left_semi").distinct().groupBy("_line").count().where(F.col("count") >= min_sites).select("_line")
    return sure.unionByName(exact)


def remove(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with `text` less its boilerplate lines, and n_removed, their number; order and other lines stay.

    A null or empty text stays as it is. A null site counts towards no spread, but its boilerplate goes too. Lines
    equal but for white space at their ends are the same. Repeated rows each stay. Texts and lines may be of any length. An
    empty table gives an empty one. A column n_removed is replaced; others stay, whatever their names.
    """
    docs, names = numbered(docs.drop("n_removed"))
    text, site = names[text], names[site]
    docs = docs.withColumn("_doc", F.xxhash64(text))
    bad = boilerplate(docs, text, site, min_sites)
    # By text, not by row: copies of a text lose the same lines.
    held = hashed_lines(docs, text, F.col("_doc")).distinct()
    bad = bad.select(F.xxhash64("_line").alias("_k"), F.col("_line").alias("_bad"))
    hits = held.join(bad, [F.xxhash64("_line") == F.col("_k"), F.col("_line") == F.col("_bad")]).groupBy("_doc").agg(F.collect_set("_line").alias("_gone"))
    hits = hits.select(F.bitwise_not("_doc").alias("_of"), "_gone")
    out = docs.join(hits, F.bitwise_not("_doc") == F.col("_of"), "left")
    kept = F.filter(lines(F.col(text)), lambda x: ~F.coalesce(F.array_contains("_gone", line_hash(x)), F.lit(False)))
    n = F.when(F.col("_gone").isNull(), 0).otherwise(F.size(lines(F.col(text))) - F.size(kept)).cast("long")
    cleaned = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return back(out.withColumns({text: cleaned, "n_removed": n}), names, "n_removed")
