"""Similarity of words as column expressions.

ratio is 100 * (1 - insertions and deletions / both lengths), which the longest
common subsequence gives. That is found by bits: a word's signs are masks of
their places, and a fold over the other word's signs updates one long.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridline.operators.layout import let

#: Signs that a long's bits can stand for; longer words are compared by a table of lengths.
BITS = 62
#: Bits of a presence mask: a sign's bit is its code point modulo this.
MASK = 63
_NONE = "struct<score:double,match:string>"


def constant(value: object, kind: str) -> Column:
    """A list or dictionary as one constant of the plan; as many literals it would be analysed again and again."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def signs(word: Column) -> Column:
    """The code points of a word as strings."""
    return F.filter(F.split(word, ""), lambda c: c != "")


def presence(held: Column) -> Column:
    """A long with the bits of all signs in an array."""
    return F.aggregate(held, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % MASK).cast("int"))))


def places(held: Column) -> Column:
    """map<sign, long>: the bits of each sign's places among the first BITS."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    at = lambda sign: F.aggregate(F.transform(held, lambda c, i: F.when((c == sign) & (i < BITS), bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(b))
    return F.map_from_entries(F.transform(F.array_distinct(held), lambda c: F.struct(c, at(c))))


def common(held: Column, masks: Column, other: Column) -> Column:
    """Length of the longest common subsequence of two arrays of signs; masks are places(held)."""
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.size(held), F.lit(BITS))) - 1

    def step(v: Column, c: Column) -> Column:
        return let(v.bitwiseAND(F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long"))), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(ones))

    by_bits = F.size(held) - F.bit_count(F.aggregate(other, ones, step))

    def row(above: Column, c: Column) -> Column:
        def cell(own: Column, i: Column) -> Column:
            left = F.get(own, F.size(own) - 1)
            return F.array_append(own, F.when(F.get(held, i) == c, F.get(above, i) + 1).otherwise(F.greatest(F.get(above, i + 1), left)))

        return F.aggregate(F.sequence(F.lit(0), F.size(held) - 1), F.array(F.lit(0)), cell)

    by_table = F.element_at(F.aggregate(other, F.array_repeat(F.lit(0), F.size(held) + 1), row), -1)
    return F.when(F.size(held) == 0, 0).when(F.size(held) <= BITS, by_bits).otherwise(by_table).cast("int")


def score(shared: Column, n: Column, m: Column) -> Column:
    """The ratio of words of lengths n and m with a common subsequence of length shared."""
    return F.when(n + m == 0, 100.0).otherwise(200.0 * shared / F.greatest(n + m, F.lit(1)))


def may_reach(n: Column, m: Column, own: Column, other: Column, least: Column | float) -> Column:
    """Whether lengths and presence masks allow a ratio: signs that only one word has are in no common subsequence."""
    here = n - F.bit_count(own.bitwiseAND(F.bitwise_not(other)))
    there = m - F.bit_count(other.bitwiseAND(F.bitwise_not(own)))
    return 200.0 * F.least(here, there) >= least * (n + m)


def ratio(a: Column, b: Column) -> Column:
    """The ratio of two words; null if one is."""
    found = let(signs(a), lambda x: let(signs(b), lambda y: let(places(x), lambda masks: score(common(x, masks, y), F.size(x), F.size(y)))))
    return F.when(a.isNotNull() & b.isNotNull(), found)


def best_of(word: Column, terms: list[tuple[str, str]], least: float) -> Column:
    """struct<score, match>: of a short list of (term, match) the first of the highest ratio from least on; else null.

    The list is a literal of the plan. Lengths and presence masks rule out most
    terms before their subsequences are compared.
    """
    if not terms:
        return F.lit(None).cast(_NONE)
    mask = lambda t: sum(1 << b for b in {ord(c) % MASK for c in t})
    held = [{"signs": list(t), "match": m, "mask": mask(t), "m": len(t)} for t, m in terms]
    rows = constant(held, "array<struct<signs:array<string>,match:string,mask:bigint,m:int>>")

    def among(x: Column, masks: Column, own: Column) -> Column:
        def step(best: Column, t: Column) -> Column:
            def better(s: Column) -> Column:
                return F.when((s >= least) & (s > F.coalesce(best["score"], F.lit(-1.0))), F.struct(s.alias("score"), t["match"].alias("match"))).otherwise(best)

            hopeful = may_reach(F.size(x), t["m"], own, t["mask"], F.greatest(F.coalesce(best["score"], F.lit(0.0)), F.lit(least)))
            return F.when(hopeful, let(score(common(x, masks, t["signs"]), F.size(x), t["m"]), better)).otherwise(best)

        return F.aggregate(rows, F.lit(None).cast(_NONE), step)

    return F.when(word.isNotNull(), let(signs(word), lambda x: let(F.struct(places(x).alias("p"), presence(x).alias("o")), lambda k: among(x, k["p"], k["o"]))))
