"""URL rules by Bloom filter cascades, in DataFrame functions alone.

A cascade tells exactly which keys of a known universe are listed. Level 0 is a Bloom filter
of the listed keys. Universe keys that pass it by mistake go into level 1, listed keys that
pass level 1 by mistake into level 2, and so on until no mistake is left. Looking a key up is
an expression: the first level that it fails decides, so a scan needs no join.

A cascade has about ``1.44 * listed * log2(universe / listed)`` bits. It is read by scalar
subqueries, hence ``MAX_LISTED``: beyond it, split the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.llm import tables

MAX_LISTED = 5_000_000
WORD = 64


@dataclass(frozen=True)
class Level:
    words: DataFrame  # one row: the bits, as an array of 64-bit words
    bits: int
    hashes: int
    seed: int


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def attach(self, df: DataFrame, prefix: str) -> DataFrame:
        """Add the levels' words as columns, which :meth:`member` refers to."""
        words = {f"{prefix}{i}": level.words.scalar() for i, level in enumerate(self.levels)}
        return df.withColumns(words) if words else df

    def member(self, key: Column, prefix: str) -> Column:
        """Whether a key of the universe is listed; ``df`` must have been through :meth:`attach`."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            passes = F.lit(True)
            for position in _positions(key, self.levels[i]):
                word = F.element_at(F.col(f"{prefix}{i}"), (position / WORD).cast("int") + 1)
                mask = F.call_function("shiftleft", F.lit(1).cast("long"), (position % WORD).cast("int"))
                passes = passes & (word.bitwiseAND(mask) != 0)
            answer = F.when(~passes, F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def _positions(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level.seed), F.lit(j), key), F.lit(level.bits)) for j in range(level.hashes)]


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    bits = max(1, math.ceil(count * math.log(1 / rate) / math.log(2) ** 2 / WORD)) * WORD
    shape = Level(keys, bits, max(1, round(math.log2(1 / rate))), seed)
    set_bits = keys.select(F.explode(F.array(*_positions(F.col("key"), shape))).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % WORD).cast("int"))
    some = set_bits.groupBy((F.col("p") / WORD).cast("int").alias("at")).agg(F.bit_or(mask).alias("w"))
    none = keys.sparkSession.range(bits // WORD).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("w"))
    full = some.union(none).groupBy("at").agg(F.bit_or("w").alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "w")))
    words = full.agg(F.transform(ordered, lambda x: x["w"]).alias("words"))
    return Level(tables.stored(words, "filter-level"), bits, shape.hashes, seed)


def build(listed: DataFrame, universe: DataFrame, max_listed: int = MAX_LISTED) -> Cascade:
    """The cascade of the ``key`` column of ``listed`` over that of ``universe``.

    Null keys are no keys. An empty list gives a cascade that contains nothing.
    """
    wanted = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    keys = universe.select("key").filter(F.col("key").isNotNull()).distinct()
    marked = keys.join(wanted.withColumn("listed", F.lit(True)), "key", "full_outer")
    marked = tables.stored(marked.select("key", F.col("listed").isNotNull().alias("listed")), "filter-keys")
    counts = {r.listed: r["count"] for r in marked.groupBy("listed").count().collect()}
    n, others = counts.get(True, 0), counts.get(False, 0)
    if n > max_listed:
        raise ValueError(f"{n} listed keys; a cascade takes {max_listed}")
    inside, outside = marked.filter("listed").select("key"), marked.filter("NOT listed").select("key")
    levels: list[Level] = []
    rate = max(1e-9, min(0.5, n / (math.sqrt(2) * max(others, 1))))
    encode, test, count = inside, outside, n
    while count:
        level = _level(encode, count, rate, seed=len(levels))
        levels.append(level)
        alone = Cascade((level,))
        wrong = alone.attach(test, "level").filter(alone.member(F.col("key"), "level")).select("key")
        wrong = tables.stored(wrong, "filter-mistakes")
        encode, test, count, rate = wrong, encode, wrong.count(), 0.5
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to rows with a ``url``.

    ``rules`` has ``rule`` (host, then a path that starts with a slash) and ``verdict`` (allow
    or block). A rule fits its host and all subdomains if the path starts with its path; the
    longest wins; a rule given with both verdicts blocks. Without one, ``rule`` is null and the
    verdict is ``default``. Existing columns of these four names are replaced, others stay whatever
    their names; a null URL has no host.

    The keys of a URL are its host suffixes with its path prefixes, in the few shapes (labels,
    path length) that occur among the rules. The cascades' universe is the keys of all URLs.
    """
    host, path = host_and_path(F.col("url"))
    own, block_bits, allow_bits, blocks, allows = tables.unused(urls, "keys", "block_bits", "allow_bits", "block", "allow")
    urls = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    listed = rules.select(F.col("rule").alias("key"), "verdict").filter(F.col("key").isNotNull())
    listed = tables.stored(listed.distinct(), "filter-rules")
    labels = F.size(F.split(F.substring_index("key", "/", 1), r"\."))
    length = F.length("key") - F.length(F.substring_index("key", "/", 1))
    shapes = listed.select(labels.alias("labels"), length.alias("length")).distinct().collect()  # of the rules
    keys = [
        F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.length))
        for s in sorted(shapes, key=lambda s: (-s.length, -s.labels))
    ]
    keyed = urls.withColumn(own, F.array_distinct(F.array(*keys)) if keys else F.array().cast("array<string>"))
    universe = keyed.select(F.explode(own).alias("key")).distinct()
    universe = tables.stored(universe, "filter-universe")
    block = build(listed.filter("verdict = 'block'"), universe)
    allow = build(listed.filter("verdict = 'allow'"), universe)
    found = allow.attach(block.attach(keyed, block_bits), allow_bits)

    def longest(member) -> Column:
        hits = F.transform(F.filter(own, member), lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))
        return F.array_max(hits)

    found = found.withColumns({
        blocks: longest(lambda k: block.member(k, block_bits)),
        allows: longest(lambda k: allow.member(k, allow_bits)),
    })
    blocked = F.coalesce(F.col(blocks)["n"] >= F.coalesce(F.col(allows)["n"], F.lit(0)), F.lit(False))
    rule = F.when(blocked, F.col(blocks)["key"]).otherwise(F.col(allows)["key"])
    verdict = F.when(blocked, "block").when(F.col(allows)["key"].isNotNull(), "allow").otherwise(default)
    columns = [F.col(f"`{c}`") for c in urls.columns]
    return found.select(*columns, rule.alias("rule"), verdict.alias("verdict"))
