"""URL filter: a blocked Bloom filter of listed URL prefixes, then an exact hash join for its possible hits.

Column expressions and joins only. A rule names a host and a path; it fits the host and its subdomains where the
URL's path starts with the rule's path. A URL's keys are its host suffixes, each with every path prefix of a length
that some rule has. The filter has 64-bit blocks; a key's hash picks a block and PROBES bits in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisa.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROBES = 3
BITS_A_RULE = 16
#: Blocks up to this number (8 bytes each) are a literal of the plan; a larger filter is joined by block.
LITERAL_BLOCKS = 4096
#: Rules, and URLs with a verdict, up to this number are broadcast to their joins; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _bits(h: Column) -> Column:
    """The PROBES bits of a key's hash, as one mask."""
    mask = None
    for k in range(PROBES):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(blocks - 1).cast("long"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host, path, verdict). A rule's host is canonical like a URL's, A-Z lower-cased; rules without host or path
    are left out, and of contradicting ones the smallest verdict holds. The fitting rule with the longest host and path
    decides; without one, rule is null and verdict the default. A null URL or one without :// has empty host and path.
    Rows come back as they came, repeated ones too; columns of pages named like a new one are replaced. Empty tables
    are fine on either side. Of a host, only as many labels are looked at as the longest rule has.

    Rows that the filter passes are looked up once for each distinct URL; all others, nulls too, meet no join.
    """
    canonical = F.translate(F.col("host"), UPPER, LOWER)
    rules = rules.filter("host is not null and path is not null").groupBy(canonical.alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))
    rules = rules.withColumn("h", F.xxhash64(_key(F.col("r_host"), F.col("r_path"))))
    stats = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"), F.max(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    named = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not stats["n"]:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = 1 << max(0, (stats["n"] * BITS_A_RULE - 1).bit_length() - 6)
    bloom = rules.groupBy(_block(F.col("h"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("h"))).alias("word"))

    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, stats["labels"])
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, F.lit(1), i)), "."))
    lengths = F.filter(F.array(*[F.lit(x) for x in stats["lengths"]]), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(s.alias("r_host"), F.substring(F.col("path"), F.lit(1), n).alias("r_path"), F.xxhash64(_key(s, F.substring(F.col("path"), F.lit(1), n))).alias("h")))))
    if blocks <= LITERAL_BLOCKS:
        words = [0] * blocks
        for row in bloom.collect():  # at most LITERAL_BLOCKS rows
            words[row["block"]] = row["word"]
        table = F.array(*[F.lit(w).cast("long") for w in words])
        keys = F.filter(keys, lambda k: F.element_at(table, (_block(k["h"], blocks) + 1).cast("int")).bitwiseAND(_bits(k["h"])) == _bits(k["h"]))
    passed = F.coalesce((F.size(keys) > 0 if blocks <= LITERAL_BLOCKS else F.col("host") != "") & F.col(url).isNotNull(), F.lit(False))
    urls = named.filter(passed).select(F.col(url).alias("key_url"), "host", "path").distinct()
    hits = urls.select("key_url", F.inline(keys))
    if blocks > LITERAL_BLOCKS:
        hits = hits.withColumn("block", _block(F.col("h"), blocks)).join(bloom, "block")
        hits = hits.filter(F.col("word").bitwiseAND(_bits(F.col("h"))) == _bits(F.col("h")))
    exact = rules.drop("h")
    if stats["n"] <= BROADCAST_RULES:
        exact = F.broadcast(exact)
    hits = hits.select("key_url", "r_host", "r_path").join(exact, ["r_host", "r_path"])
    rule = F.concat("r_host", "r_path")
    best = hits.groupBy("key_url").agg(F.max(F.struct(F.length(rule).alias("size"), F.length("r_host").alias("of_host"), rule.alias("rule"), "r_verdict")).alias("best"))
    best = materialize(best.select("key_url", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict")), "ruled-urls")
    none = {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
    if best.count() <= BROADCAST_RULES:
        out = named.join(F.broadcast(best), named[url] == best["key_url"], "left").drop(best["key_url"])
        return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    # too many to broadcast: rows that no rule can fit stay where they are, the others meet their URL's verdict
    maybe, rest = named.filter(passed), named.filter(~passed).withColumns(none)
    joined = maybe.join(best, maybe[url] == best["key_url"], "left").drop(best["key_url"])
    return rest.unionByName(joined.withColumn("verdict", F.coalesce("verdict", F.lit(default))))
