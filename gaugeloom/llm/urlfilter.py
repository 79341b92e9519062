"""URL rules by Bloom filter cascades: exact membership over the corpus's key universe, without joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z in lower case) and path of a url; both empty where it is null or has no ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, shape, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


class Cascade:
    """Levels of Bloom filters: odd ones hold listed keys, even ones the keys that wrongly passed the level before.

    For every key of the universe that it was built over, and every listed key, :meth:`holds` is exact. The
    first level's rate of false positives is about listed / universe, so that the second level holds about as
    many keys as the first, and the bitmaps take O(listed * log(universe / listed)) bits. The list of rules is
    given by the caller as a Python sequence, so it bounds what lies in the plan.
    """

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> Cascade:
        """listed, universe: one string column ``key`` each."""
        levels: list[tuple[int, int, bytes]] = []
        if not n_listed:
            return cls(levels)
        inside, outside, n = listed.distinct(), universe, n_listed
        rate = min(0.5, n_listed / max(1, n_universe) / math.sqrt(2))
        while n:
            bits = max(64, math.ceil(n * 1.4427 * math.log2(1 / rate)))
            probes = max(1, round(bits / n * 0.6931))
            level = (bits, min(probes, 24), b"")
            level = (*level[:2], cls._bitmap(inside, level, len(levels)))
            levels.append(level)
            wrong = outside.where(cls._passes(F.col("key"), level, len(levels) - 1)).distinct()
            if len(levels) == 1:
                wrong = wrong.join(F.broadcast(listed), "key", "left_anti")  # no more rows than the caller's list
            inside, outside = wrong, inside
            n, rate = inside.count(), 0.5
        return cls(levels)

    @staticmethod
    def _bit(key: Column, bits: int, level: int, probe: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(level * 64 + probe), key), F.lit(bits).cast("long"))

    @classmethod
    def _bitmap(cls, keys: DataFrame, level: tuple[int, int, bytes], at: int) -> bytes:
        bits, probes, _ = level
        place = keys.select(F.explode(F.array(*(cls._bit(F.col("key"), bits, at, i) for i in range(probes)))).alias("bit")).select((F.col("bit") + 1).alias("bit"))
        made = place.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        parts = {r["part"]: bytes(r["map"]) for r in made.collect()}  # 4 KB for each 32,768 bits of the list's filter
        return b"".join(parts.get(i + 1, bytes(4096)) for i in range((bits - 1) // 32768 + 1))[: (bits + 7) // 8]

    @classmethod
    def _passes(cls, key: Column, level: tuple[int, int, bytes], at: int) -> Column:
        bits, probes, bitmap = level

        def is_set(probe: int) -> Column:
            bit = cls._bit(key, bits, at, probe)
            byte = F.conv(F.hex(F.substring(F.lit(bitmap), (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
            return F.getbit(byte, (bit % 8).cast("int")) == 1

        return reduce(lambda a, b: a & b, (is_set(i) for i in range(probes)))

    def holds(self, key: Column) -> Column:
        """Whether ``key`` is listed; false for null."""
        known = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels) - 1, -1, -1):
            known = F.when(self._passes(key, self.levels[at], at), known).otherwise(F.lit(at % 2 == 1))
        return key.isNotNull() & known


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict for each row's url.

    rules: (verdict 'allow' or 'block', host, path); a path is empty or begins with '/'. A rule fits its host
    and all subdomains where the url's path starts with the rule's; the longest fitting rule decides. A url
    that no rule fits is in no list: rule is null and the verdict is 'allow'. Null urls and urls without
    ``://`` have an empty host and path. Rows keep their other columns, but for columns that have the names
    of the four new ones, which are replaced. Repeated rows stay. An empty table gives an empty result.
    """
    keys = [(v, h + p) for v, h, p in rules]
    if len({k for _, k in keys}) < len(keys) or {v for v, _ in keys} - {"allow", "block"}:
        raise ValueError("rules must be distinct and say allow or block")
    if any(p and not p.startswith("/") or "/" in h for _, h, p in rules):
        raise ValueError("a rule's path is empty or begins with '/'")
    host, path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    candidates = [F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)) for labels, length in shapes]
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    universe = pages.select(F.explode(F.array(*candidates)).alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    found = {}
    for verdict in ("block", "allow"):
        own = [k for v, k in keys if v == verdict]
        others = [k for v, k in keys if v != verdict]
        table = lambda of: pages.sparkSession.range(1).select(F.explode(F.array(*(F.lit(k) for k in of)).cast("array<string>")).alias("key"))
        found[verdict] = Cascade.build(table(own), universe.union(table(others)), len(own), n_universe + len(others))
    fits = [F.when(found[v].holds(c), F.struct(F.length(c).alias("n"), c.alias("key"), F.lit(v).alias("verdict"))) for c in candidates for v in found]
    longest = F.array_max(F.array(*fits))
    return pages.withColumn("_longest", longest).withColumns({"rule": F.col("_longest.key"), "verdict": F.coalesce("_longest.verdict", F.lit("allow"))}).drop("_longest")
