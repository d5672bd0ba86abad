"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Main path: DataFrame functions only. Lists are tables, so they may be as long as the corpus; only the filter's blocks
are broadcast, and their number is bounded by `max_blocks` whatever the list's length (a fuller filter passes more keys
to the exact join, and results stay the same).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import back, numbered

#: A block is four 64-bit words; a key sets one bit in each.
WORDS = 4
#: Blocks a filter may have: with 40 bytes a row, at most 2.6 MB are broadcast.
MAX_BLOCKS = 1 << 16
#: Query parameters that only track visits.
TRACKING = r"(?i)^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Scheme, `www.` or `m.`, port 80 or 443, trailing slashes, fragment and tracking parameters go; other parameters are sorted."""
    name = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    place = F.regexp_replace(path, r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(name, place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(64)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row for each block in use: its words with the bits of all keys. Partial aggregates merge by bit_or."""
    block, bits = _bits(F.col(key), blocks)
    return listed.groupBy(block.alias("_block")).agg(*(F.bit_or(b).alias(f"_w{i}") for i, b in enumerate(bits)))


def blocks_for(count: int, max_blocks: int = MAX_BLOCKS) -> int:
    """16 bits for each of `count` keys, in powers of two up to `max_blocks`."""
    need = max(1, -(-count * 16 // (64 * WORDS)))
    return min(max_blocks, 1 << (need - 1).bit_length())


def listed_hits(rows: DataFrame, key: str, listed: DataFrame, blocks: int) -> DataFrame:
    """`rows` whose `key` is in `listed` (column `key`, distinct, no nulls), with the listed row's other columns.

    The probe of the filter is a hash join on the block, broadcast because its size is bounded. What passes joins the
    list itself, which removes false positives; a key that many rows share is split by adaptive execution.
    """
    block, bits = _bits(F.col(key), blocks)
    filled = F.broadcast(bloom(listed, key, blocks))
    passes = reduce(Column.__and__, (F.col(f"_w{i}").bitwiseAND(b) != 0 for i, b in enumerate(bits)))
    passed = rows.withColumn("_block", block).join(filled, "_block").where(passes)
    return passed.drop("_block", *(f"_w{i}" for i in range(WORDS))).join(listed, key)


def _rule_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule of each (host, path): a key is a host suffix and a path prefix of a length that some rule has."""
    keyed = rules.select(F.concat("rule_host", "rule_path").alias("_key"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict"), F.char_length("rule_host").alias("_host"), F.char_length("rule_path").alias("_path")).dropDuplicates(["_key"])
    shape = keyed.agg(F.array_sort(F.collect_set("_path")).alias("p"), F.max(F.size(F.split("rule", r"[./]"))).alias("labels"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict")).where(F.lit(False))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(shape["labels"] - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(1 << 20)), "."))
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in shape["p"])), lambda n: n <= F.char_length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keys = urls.select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(F.concat(h, p).alias("key"), F.char_length(h).alias("host"), F.char_length(p).alias("path")))))).alias("_k"))
    keys = keys.select("host", "path", F.col("_k.key").alias("_key"), F.col("_k.host").alias("_h"), F.col("_k.path").alias("_p"))
    hits = listed_hits(keys, "_key", keyed, blocks_for(shape["n"])).where("_h = _host and _p = _path")
    return hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.char_length("rule"), F.col("rule"))).alias("_best")).select("host", "path", "_best.rule", "_best.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """`pages` with host, path, canonical_url, rule, listed and verdict.

    `rules` has rule_host, rule_path and rule_verdict, `listed` canonical_url. The longest rule that fits decides;
    without one, a listed canonical URL is blocked and any other allowed. Each different URL is judged once, so a URL
    that many rows share costs as much as any other until its verdict is joined back.

    Null URLs and those without `://` have an empty host and path, no rule, and are allowed unless the list has the
    empty string, which it never has here. Repeated rows each get their verdict. URLs may be of any length. An empty table
    gives an empty one. Columns of `pages` named like an output are replaced; others stay, whatever their names.
    """
    own = ["host", "path", "canonical_url", "rule", "listed", "verdict"]
    pages, names = numbered(pages.drop(*own))
    url = names[url]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    pages = pages.withColumn("canonical_url", F.when(F.col("host") == "", F.lit("")).otherwise(canonical(F.col(url), F.col("host"), F.col("path"))))
    rule = _rule_hits(pages.where("host <> ''").select("host", "path").distinct(), rules)
    entries = listed.select("canonical_url").where("canonical_url <> ''").distinct()
    hit = listed_hits(pages.where("host <> ''").select("canonical_url").distinct(), "canonical_url", entries, blocks_for(entries.count(), max_blocks))
    # A key of its own makes Spark shuffle both sides for the join, and only such joins can split a hot key.
    rule = rule.select(F.xxhash64("host", "path").alias("_place"), F.col("host").alias("_host"), F.col("path").alias("_path"), "rule", "rule_verdict")
    hit = hit.select(F.xxhash64("canonical_url").alias("_entry"), F.col("canonical_url").alias("_canonical"), F.lit(True).alias("listed"))
    out = pages.join(rule, [F.xxhash64("host", "path") == F.col("_place"), F.col("host") == F.col("_host"), F.col("path") == F.col("_path")], "left").drop("_place", "_host", "_path")
    out = out.join(hit, [F.xxhash64("canonical_url") == F.col("_entry"), F.col("canonical_url") == F.col("_canonical")], "left").drop("_entry", "_canonical")
    by_list = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    out = out.withColumns({"listed": F.coalesce("listed", F.lit(False)), "verdict": F.coalesce("rule_verdict", by_list)})
    return back(out, names, *own)


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules such as ("example.com/en/", "block"); the path begins at the first `/`."""
    rows = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2] if "/" in r else "", v) for r, v in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string")


def hosts_with(pages: DataFrame, labels: Sequence[str], url: str = "url") -> DataFrame:
    """The canonical URLs of `pages` whose host has one of `labels` between its dots."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    named = pages.select(F.col(url).alias("_url"), host.alias("_host"), path.alias("_path")).where(F.arrays_overlap(F.split("_host", r"\."), F.array(*(F.lit(x) for x in labels))))
    return named.select(canonical(F.col("_url"), F.col("_host"), F.col("_path")).alias("canonical_url")).distinct()
