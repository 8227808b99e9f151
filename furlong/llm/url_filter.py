"""Operator 2: URL filter lists by a blocked Bloom filter and an exact hash join, in DataFrame functions only.

A rule is ``host + path`` in canonical form.  Of a URL, every host suffix at a
dot with every path prefix of a length that some rule has is a possible key.
Keys go first through a blocked Bloom filter, a table of 256-bit blocks built
from the rules and joined by block, which passes the possible hits; these
meet the rules in an exact hash join that removes what the filter let through by
chance.  URLs are judged once for each distinct (host, path).  Rules and blocks
are joined as tables: Spark broadcasts them only while their size is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_RULE = 16
BLOCK_BITS = 256
PROBES = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bit(key: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(BLOCK_BITS)).cast("int")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w3): the blocks that any key sets a bit of."""
    bit = F.explode(F.array(*[_bit(F.col(key), p) for p in range(PROBES)]))
    bits = keys.select(_block(F.col(key), blocks).alias("block"), bit.alias("bit"))
    one = F.expr("shiftleft(1L, bit & 63)")
    return bits.groupBy("block").agg(*[F.bit_or(F.when(F.col("bit").between(64 * w, 64 * w + 63), one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(BLOCK_BITS // 64)])


def may_hold(key: Column) -> Column:
    """Whether the block that the row carries has all bits of the key."""
    found = F.lit(True)
    for p in range(PROBES):
        bit = _bit(key, p)
        word = F.when(bit < 64, F.col("w0")).when(bit < 128, F.col("w1")).when(bit < 192, F.col("w2")).otherwise(F.col("w3"))
        found = found & (F.getbit(word, bit.bitwiseAND(63)) == 1)
    return found


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id_col``, host, path, rule (the longest that fits, else null), verdict (its action, else ``default``).

    ``rules`` has rule (``host + path``) and action (allow or block).  A rule fits its host and all
    subdomains if the path starts with the rule's.  Of rules of equal length the
    first in text order wins; of one rule with both actions, block.  A null
    url and one without ``://`` have an empty host and path and no rule.  Null
    or repeated ids are carried along, extra columns are ignored, empty tables
    give the default or no rows.
    """
    listed = rules.filter("rule is not null and action is not null").groupBy("rule").agg(F.max(F.col("action") == "block").alias("block_it")).select("rule", F.when(F.col("block_it"), "block").otherwise("allow").alias("action"))
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring(F.col("rule"), F.lit(1), slash - 1)).otherwise(F.col("rule"))
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(slash > 0, F.length("rule") - slash + 1).otherwise(0)).alias("lengths"), F.coalesce(F.max(F.size(F.split(host, r"\."))), F.lit(0)).alias("labels")).first()
    lengths = sorted(shape["lengths"])  # as many as a path has characters
    blocks = max(1, shape["n"] * BITS_PER_RULE // BLOCK_BITS)

    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    # a suffix of more labels than any rule's host has can't be listed, so a host of many dots costs no more than others
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, shape["labels"])))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    possible = parsed.select("host", "path").filter("host <> ''").distinct().select("host", "path", F.explode(keys).alias("rule")).withColumn("block", _block(F.col("rule"), blocks))
    hits = possible.join(blocked_bloom(listed, "rule", blocks), "block").filter(may_hold(F.col("rule"))).join(listed, "rule")
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), F.struct(-F.length("rule"), F.col("rule"))).alias("best"))
    judged = parsed.filter("host <> ''").join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    # URLs without a host are one key that no rule fits: they stay out of the join
    return judged.unionByName(parsed.filter("host = ''").select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
