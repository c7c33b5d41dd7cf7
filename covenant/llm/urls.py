"""URL allow/block rules by host-suffix and path-prefix expressions (native).

Every URL is expanded into its host suffixes times its path prefixes (cut after
each ``/``); a rule is filed under its host and its path up to the last ``/``.
The two sides meet in an equi-join on the first 32 bits of the expression's
SHA-256, then the full digest and
the rest of the rule's path are compared and the longest rule wins.

A rule (host, path) fits its host and all subdomains if the URL's path starts
with the rule's path. The longest rule is that with most characters of host
and path together; ties go to the longer host, then to ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import inner_names, small_enough

#: Rules up to this count are broadcast (a rule takes well under 1 kB).
BROADCAST_RULES = 50_000
#: Copies of the rule side when it is too large to broadcast, so that an
#: expression that a third of all URLs share is spread over as many tasks.
SALTS = 32

#: Bits of a length in the packed precedence (total, host, block).
BITS = 21


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column) -> Column:
    """The empty path and the path up to each ``/``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                       lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def file_rules(rules: DataFrame, *, host: str = "host", path: str = "path", action: str = "action") -> DataFrame:
    """Distinct rules with the digest, and its short prefix, that they are filed under."""
    r = inner_names(rules, {host: "h", path: "p", action: "a"}).where("h is not null and p is not null and a in ('allow', 'block')")
    r = r.groupBy("h", "p").agg(F.max((F.col("a") == "block").cast("int")).alias("blocks"))
    full = digest(F.col("h"), F.substr(F.col("p"), F.lit(1), F.length("p") - F.length(F.substring_index("p", "/", -1))))
    return r.select(F.substring(full, 1, 8).alias("short"), full.alias("rule_digest"), "h", "p", "blocks")


def url_verdicts(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow",
                 rule_host: str = "host", rule_path: str = "path", rule_action: str = "action") -> DataFrame:
    """Per input row: key, host, path, rule (null if none fits), verdict.

    Null URLs and URLs without ``://`` have empty host and path, fit no rule and
    get the ``default`` verdict. Repeated rows come back as often. Rules with a
    null field or another action are not used. Other columns are ignored.
    """
    filed = file_rules(rules, host=rule_host, path=rule_path, action=rule_action)
    u = inner_names(pages, {key: "key", url: "url"})
    # one row per distinct (key, url), with its number of copies: they share a result
    u = u.groupBy("key", "url").agg(F.count(F.lit(1)).alias("copies"))
    u = u.select("key", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url")
    e = (u.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
         .withColumn("prefix", F.explode(path_prefixes(F.col("path"))))
         .withColumn("digest", digest(F.col("suffix"), F.col("prefix")))
         .withColumn("short", F.substring("digest", 1, 8)))
    small = small_enough(filed, BROADCAST_RULES)
    if small:
        joined = e.join(F.broadcast(filed), "short", "left")
    else:
        salted = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = e.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    fits = (F.col("rule_digest") == F.col("digest")) & (F.col("h") == F.col("suffix")) & F.startswith(F.col("path"), F.col("p"))
    host_chars, all_chars = F.length("h").cast("long"), F.length("h").cast("long") + F.length("p")
    best = F.when(fits, F.shiftleft(all_chars, 1 + BITS) + F.shiftleft(host_chars, 1) + F.col("blocks"))
    found = (joined.groupBy("key", "url", "host", "path", "copies").agg(F.max(best).alias("best")))
    host_len = F.shiftright("best", 1).bitwiseAND((1 << BITS) - 1).cast("int")
    path_len = (F.shiftright("best", 1 + BITS) - host_len).cast("int")
    rule = F.when(F.col("best").isNotNull(), F.concat(F.right("host", host_len), F.left("path", path_len)))
    verdict = (F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best").bitwiseAND(1) == 1, F.lit("block")).otherwise(F.lit("allow")))
    return (found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict")))

