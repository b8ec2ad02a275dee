"""URL rules and lists by an exact cascade of Bloom filters (DataFrame operations only).

The keys are (host, path prefix) pairs. The complete universe is known: every key that a url of the
corpus can ask for. Level 0 is a Bloom filter of the listed keys; level 1 encodes the keys of the
universe that pass level 0 wrongly; level 2 the listed keys that level 1 would wrongly turn away,
and so on until a level has no false positive left. A key of the universe is listed exactly when
the first level that it fails has an odd number (or it passes them all and their number is odd).

Sizes. Level 0 takes a false-positive rate of about |listed| / |universe|, so it has
1.44 log2(|universe| / |listed|) bits per listed key, and the later levels, at a rate of one half,
hold about as many keys as are listed. So a cascade grows with the list and the logarithm of the
corpus. It enters the plan as a literal, after a check of its size; pages are then read in one pass
with no join and no shuffle. The universe is found by one aggregation over distinct keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, local_rows, staged

#: Bits of one piece of a filter, as ``bitmap_construct_agg`` makes them.
PIECE_BITS = 32_768
MAX_CASCADE_BYTES = 16 << 20

#: (action, host, path prefix) of the standing rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = [
    f"{name}.example.{top}"
    for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
    for top in ("com", "net", "org")
]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every parent domain, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def candidate_keys(host: Column, path: Column, prefix_lengths: list[int]) -> Column:
    """Every key that may fit a url: host suffixes times path prefixes of the lists' own lengths."""
    prefixes = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in prefix_lengths]),
        lambda p: p.isNotNull(),
    )
    return F.flatten(
        F.transform(suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\t"), p)))
    )


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``pieces`` are bitmaps of PIECE_BITS bits in order."""

    pieces: tuple[bytes, ...]
    bits: int
    hashes: int
    seed: int


def _positions(key: Column, seed: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + k), key), F.lit(bits)) for k in range(hashes)]


def _build(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the n ``key`` values; its bits come to the driver in pieces of fixed size."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    if bits > MAX_CASCADE_BYTES * 8:
        raise ValueError(f"a filter of {n} keys takes {bits // 8} bytes, over the limit of {MAX_CASCADE_BYTES}")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, hashes, bits))).alias("at"))
    # positions count from 0; Spark's bucket of a position counts from 1 for positions 1..32768
    made = (
        at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap"))
        .collect()
    )
    have = {r["b"]: bytes(r["bitmap"]) for r in made}
    empty = bytes(PIECE_BITS // 8)
    return Level(
        tuple(have.get(b, empty) for b in range(1, math.ceil(bits / PIECE_BITS) + 1)), bits, hashes, seed
    )


def _passes(key: Column, level: Level) -> Column:
    bitmap = F.lit(b"".join(level.pieces))
    tests = []
    for at in _positions(key, level.seed, level.hashes, level.bits):
        byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10)
        tests.append(F.call_function("getbit", byte.cast("int"), (at % 8).cast("int")) == 1)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def is_listed(key: Column, cascade: list[Level]) -> Column:
    """Exact for every key of the universe that the cascade was built for."""
    out = F.lit(len(cascade) % 2 == 1)
    for number, level in reversed(list(enumerate(cascade))):
        out = F.when(~_passes(key, level), F.lit(number % 2 == 1)).otherwise(out)
    return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Filter levels for distinct ``key`` values; no listed key gives no level."""
    spark = listed.sparkSession
    n, total = listed.count(), universe.count()
    if n == 0:
        return []
    rate = min(0.5, n * math.sqrt(0.5) / max(1, total - n))
    cascade = [_build(listed, n, rate, 0)]
    inside = listed
    # keys that the level just built lets through wrongly: from the universe first, from few keys after
    wrong = universe.join(listed, "key", "left_anti").where(_passes(F.col("key"), cascade[0]))
    while True:
        wrong = staged(wrong, f"url-level{len(cascade)}")
        m = wrong.count()
        if m == 0:
            return cascade
        cascade.append(_build(wrong, m, 0.5, len(cascade)))
        inside, wrong = wrong, inside.where(_passes(F.col("key"), cascade[-1]))


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return local_rows(spark, [(k,) for k in sorted(set(keys))], "key string")


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    blocked_hosts: list[str] = BLOCKED_HOSTS,
) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of ``pages`` (page_id, url).

    The longest rule that fits decides (host and path together; of equal length the longer host).
    Where none fits, ``rule`` is null and the verdict is ``block`` for a listed host or a subdomain
    of one, else ``allow``. A null url, or one without ``://``, has an empty host and path: no rule
    fits it and it is allowed. Repeated rows and null ids come back one for one; an empty table
    gives no rows; other columns of ``pages`` are ignored, whatever their names.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = urls.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")])
    asked = rows.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    asked = staged(asked.distinct(), "url-rule-keys")
    hosts = staged(rows.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct(), "url-hosts")
    cascades = {
        action: build_cascade(_keys(spark, [f"{h}\t{p}" for a, h, p in rules if a == action]), asked)
        for action in ("allow", "block")
    }
    host_list = build_cascade(_keys(spark, blocked_hosts), hosts)

    keys = F.col("_keys")
    hits = lambda action: F.filter(keys, lambda k: is_listed(k, cascades[action]))
    ranked = lambda found, verdict: F.transform(
        found,
        lambda k: F.struct(
            F.char_length(k).alias("n"), F.instr(k, "\t").alias("h"), F.lit(verdict).alias("verdict"), k.alias("key")
        ),
    )
    best = F.array_max(F.concat(ranked(hits("allow"), "allow"), ranked(hits("block"), "block")))
    listed_host = F.exists(suffixes(F.col("host")), lambda h: is_listed(h, host_list))
    return (
        rows.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
        .withColumn("_best", best)
        .select(
            "page_id",
            "host",
            "path",
            F.replace(F.col("_best.key"), F.lit("\t"), F.lit("")).alias("rule"),
            F.coalesce(
                F.col("_best.verdict"), F.when(listed_host, F.lit("block")).otherwise(F.lit("allow"))
            ).alias("verdict"),
        )
    )
