"""Listing, counting and looking up records, and scanners over their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions import constants as C
from tidepool.functions.text import column

#: Canaries that one search looks for.
MOST_CANARIES = 64


def listed(memories: DataFrame, source_type: str | None = None, tier: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page in id order with ``total_count`` and ``truncated``; records without a source type pass every one."""
    limit, offset = min(limit if limit > 0 else 50, 200), max(offset, 0)
    found = memories
    if source_type is not None:
        found = found.where(F.col("source_type").isNull() | (F.col("source_type") == source_type))
    if tier is not None:
        found = found.where(F.col("tier") == tier)
    total = found.agg(F.count(F.lit(1)).alias("total_count"))  # one row
    page = found.orderBy("id").limit(offset + limit).withColumn("_n", F.row_number().over(Window.orderBy("id"))).where(F.col("_n") > offset).drop("_n")
    return page.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_count") > offset + limit)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def injection_score(c: str | Column) -> Column:
    """The weights of the phrases found, each once, and once that of controls of writing direction."""
    low = F.lower(F.coalesce(column(c), F.lit("")))
    total = F.when(low.rlike(f"[{C.BIDI}]"), C.BIDI_WEIGHT).otherwise(0.0)
    for phrase, weight in C.INJECTION:
        total = total + F.when(F.contains(low, F.lit(phrase.lower())), weight).otherwise(0.0)
    return total


def verdict(score: str | Column) -> Column:
    return F.when(column(score) >= C.BLOCKED, "blocked").when(column(score) >= C.SUSPICIOUS, "suspicious").otherwise("clean")


def shannon_bits(c: Column) -> Column:
    """Entropy of a string's characters, in bits."""
    letters = F.split(c, "")
    n = F.length(c).cast("double")
    share = lambda x: F.size(F.filter(letters, lambda y: y == x)) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda total, x: total - share(x) * F.log2(share(x)))


def secret_kind(c: str | Column) -> Column:
    """The first kind of secret that a text holds, ``entropy`` for a long word of high entropy that is no address; null if none."""
    own = F.coalesce(column(c), F.lit(""))
    out = None
    for kind, pattern in C.SECRETS.items():
        out = F.when(own.rlike(pattern), kind) if out is None else out.when(own.rlike(pattern), kind)
    words = F.filter(F.split(own, r"[ \t\r\n]+"), lambda w: F.length(w) > C.ENTROPY_LENGTH)
    odd = F.exists(words, lambda w: ~F.contains(w, F.lit("http://")) & ~F.contains(w, F.lit("https://")) & (shannon_bits(w) > C.ENTROPY_BITS))
    return out.when(odd, "entropy")


def redacted(c: str | Column, mark: str = "[secret]") -> Column:
    out = column(c)
    for pattern in C.SECRETS.values():
        out = F.regexp_replace(out, pattern, mark)
    return out


def asks_for_credentials(c: str | Column) -> Column:
    low = F.lower(F.coalesce(column(c), F.lit("")))
    out = F.lit(False)
    for word in C.CREDENTIAL_WORDS:
        out = out | F.contains(low, F.lit(word.lower()))
    return out


def canary_hits(results: DataFrame, canaries: DataFrame, json: str = "result") -> DataFrame:
    """Results that hold the id of a canary; more than ``MOST_CANARIES`` canaries are refused, since every result is compared with each."""
    if canaries.limit(MOST_CANARIES + 1).count() > MOST_CANARIES:
        raise ValueError(f"more than {MOST_CANARIES} canaries")
    return results.join(F.broadcast(canaries), F.contains(F.col(json), F.col("canary_id")), "left_semi")


def ip_number(c: str | Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    own = column(c)
    parts = F.split(own, r"\.")
    valid = own.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.cast("int") <= 255)
    return F.when(valid, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long")))


def in_network(ip: str | Column, cidr: str | Column) -> Column:
    """Whether an address is in a network; a missing or bad prefix length is 32."""
    base, prefix = F.split_part(column(cidr), F.lit("/"), F.lit(1)), F.split_part(column(cidr), F.lit("/"), F.lit(2))
    bits = F.when(prefix.rlike(r"^\d{1,2}$") & (prefix.cast("int") <= 32), prefix.cast("int")).otherwise(32)
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    return F.coalesce(F.floor(ip_number(ip) / size) == F.floor(ip_number(base) / size), F.lit(False))
