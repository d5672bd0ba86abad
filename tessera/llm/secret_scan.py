"""Secret scans: candidates in whole texts, told apart by how many repositories and owners share them.

Main path: DataFrame functions only. Positions are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import back, numbered

#: Kinds in the order of their names in digests: (name, pattern, group of the secret, least characters of that group).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Runs that the method adds if they mix lower case, upper case and digits.
ADDED = (("opaque", r"[A-Za-z0-9_-]{24,}", 0, 24),)
MIXED = (r"[a-z]", r"[A-Z]", r"[0-9]")
#: A run as short as these can't give a match long enough, so a cheap test spares the exact pattern most texts.
PROBES = {"assign": BASE[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "opaque": ADDED[0][1]}
#: Longest runs only: `[0-9a-f]+` takes whole runs, so `{24,}` finds the same long ones without the short ones.
SCANNED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: From so many owners on, a candidate is an example that people copy.
COPIED_OWNERS = 3


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Of each leftmost non-overlapping match: characters since the last match, its characters, its secret."""
    scanned = SCANNED.get(kind, pattern)
    gaps, whole = F.split(text, scanned, -1), F.regexp_extract_all(text, F.lit(scanned), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(scanned), F.lit(group))
    zipped = F.transform(whole, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(gaps[i]).alias("gap"), F.char_length(m).alias("size"), secret[i].alias("secret")))
    return F.when(text.rlike(PROBES[kind]), zipped)


def candidates(docs: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """A row for each match of each kind: `key`, `keep`, kind, start, end, secret. Positions are running sums within a text."""
    kinds = (*BASE, *ADDED)
    empty = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,secret:string>>")
    found = F.concat(*(F.coalesce(_found(F.col(text), k, p, g), empty) for k, p, g, _ in kinds))
    rows = docs.select(key, *keep, F.explode(found).alias("m")).select(key, *keep, "m.*").distinct()
    before = Window.partitionBy(key, "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    least = reduce(lambda c, k: c.when(F.col("kind") == k[0], k[3]), kinds[1:], F.when(F.col("kind") == kinds[0][0], kinds[0][3]))
    mixed = reduce(Column.__and__, (F.col("secret").rlike(p) for p in MIXED))
    return rows.where((F.char_length("secret") >= least) & (F.col("kind").isin([k[0] for k in BASE]) | mixed)).select(key, *keep, "kind", "start", "end", "secret")


def looks_live(secret: Column) -> Column:
    """At least eight different characters and no run of four: placeholders such as xxxx or 1234 repeated aren't live."""
    return (F.size(F.array_distinct(F.split(secret, ""))) >= 8) & ~secret.rlike(r"(.)\1{3}|(?i:example|changeme|placeholder|your[_-])")


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """`docs` with `secrets`: an array of (start, end, kind, secret_sha256, repositories, owners, verdict), by start, then kind.

    A candidate's hash is counted over the corpus by distinct repositories and owners. Verdicts: `example` if
    COPIED_OWNERS or more owners have it, `live` if fewer have it and it looks live, else `weak`. Base kinds stay
    whatever their verdict; added kinds stay only if `live`.

    Null and empty texts have no secrets. Rows that repeat are scanned each. A null owner or repository isn't counted.
    Texts may be of any length. An empty table gives an empty one. A column named `secrets` is replaced; others stay,
    whatever their names.
    """
    docs, names = numbered(docs.drop("secrets"))
    text, repository, owner = names[text], names[repository], names[owner]
    docs = docs.withColumn("_row", F.xxhash64(F.col(repository), F.col(owner), F.col(text)))
    # Equal rows share a row key, have equal matches, and get equal results; candidates() keeps one of each match.
    once = docs.select("_row", F.col(text).alias("_text"), F.col(repository).alias("_repo"), F.col(owner).alias("_owner")).where(reduce(Column.__or__, (F.col("_text").rlike(p) for p in PROBES.values())))
    found = candidates(once, "_row", "_text", ["_repo", "_owner"])
    found = found.withColumn("secret_sha256", F.sha2("secret", 256))
    pairs = found.groupBy("secret_sha256", "_owner").agg(F.count_distinct("_repo").alias("_repos"))
    counts = pairs.groupBy("secret_sha256").agg(F.sum("_repos").alias("repositories"), F.count("_owner").alias("owners"))
    # A key of its own makes Spark shuffle both sides for the join, and only such joins can split a widely copied secret.
    counts = counts.select(F.xxhash64("secret_sha256").alias("_key"), F.col("secret_sha256").alias("_sha"), "repositories", "owners")
    rows = found.join(counts, [F.xxhash64("secret_sha256") == F.col("_key"), F.col("secret_sha256") == F.col("_sha")])
    rows = rows.withColumn("verdict", F.when(F.col("owners") >= COPIED_OWNERS, "example").when(looks_live(F.col("secret")), "live").otherwise("weak"))
    order = reduce(lambda c, k: c.when(F.col("kind") == k[1][0], k[0]), list(enumerate((*BASE, *ADDED)))[1:], F.when(F.col("kind") == BASE[0][0], 0))
    kept = rows.where(F.col("kind").isin([k[0] for k in BASE]) | (F.col("verdict") == "live")).withColumn("rank", order)
    spans = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "secret_sha256", "repositories", "owners", "verdict"))).alias("secrets"))
    spans = spans.select(F.col("_row").alias("_of"), "secrets")
    out = docs.join(spans, F.col("_row") == F.col("_of"), "left")
    return back(out.withColumn("secrets", F.coalesce("secrets", F.array().cast(spans.schema["secrets"].dataType))), names, "secrets")
