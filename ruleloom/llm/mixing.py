"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents with the same set of sources form a pattern. A small network routes words from patterns to sources: each
pattern offers its words once, twice and three times at rising (convex) cost, each source takes its target. The
flow is solved on the driver; its size is the number of patterns and sources, never that of the documents. Spark
then gives each pattern's words to documents in seeded hash order: whole repeats for all, one more for the first
documents in that order, and a part of the one at the border, so every pattern's words are met exactly.

A null text has size 0 and takes nothing. A null source is a source of its own, the last. Rows that are equal get
equal treatment. An empty table gives an empty result. Reruns agree: nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm.common import WORD, local_table, scratch, text_or_empty

MOST_REPEATS = 3
#: The network is solved on the driver, so its size is checked.
MAX_PATTERNS = 50_000
#: Slices of a pattern in hash order; only one slice a pattern is put in exact order.
SLICES = 4096


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of all words by weight; a share above most times its source's size stops there, the rest is shared anew."""
    out, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in over or free:
            out[i] = Fraction(most * sizes[i]) if over else unit * weights[i]
        left -= sum(out[i] for i in over or free)
        free -= over or free
    return out


def whole_targets(exact: Sequence[Fraction]) -> list[int]:
    """Whole words with the same sum, rounded down by the whole sum's largest remainders."""
    floor = [int(x) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (floor[i] - exact[i], i))
    for i in order[: int(sum(exact)) - sum(floor)]:
        floor[i] += 1
    return floor


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], most: int = MOST_REPEATS) -> list[int]:
    """Min-cost flow by successive shortest paths; the words taken of each pattern.

    patterns: the sources (by number) and words of each. Taking a pattern's words for the n-th time costs n - 1.
    Paths go quota <- source <- pattern (<- source <- pattern)*: the inner steps re-route words already given.
    """
    by_source: list[list[int]] = [[] for _ in quotas]
    for p, (members, _) in enumerate(patterns):
        for s in members:
            by_source[s].append(p)
    taken, given, need = [0] * len(patterns), [dict.fromkeys(m, 0) for m, _ in patterns], list(quotas)

    def tier(p: int) -> tuple[int, int]:
        """What the pattern's next words cost, and how many cost as much."""
        size = patterns[p][1]
        n = taken[p] // size if size else most
        return (n, (n + 1) * size - taken[p]) if n < most else (most, 0)

    for s in range(len(quotas)):
        while need[s] > 0:
            # breadth first by cost: sources reachable from s through re-routing, and the cheapest open pattern
            came: dict[int, tuple[int, int] | None] = {s: None}
            queue, best = [s], None
            for a in queue:
                for p in by_source[a]:
                    cost, room = tier(p)
                    if room and (best is None or cost < best[0]):
                        best = (cost, room, p, a)
                    for b, flow in given[p].items():
                        if flow and b not in came:
                            came[b] = (p, a)
                            queue.append(b)
            if best is None:
                break
            _, room, p, a = best
            path, b = [], a
            while came[b] is not None:
                path.append((*came[b], b))
                b = came[b][1]
            amount = min([room, need[s], *(given[q][lost] for q, _, lost in path)])
            taken[p] += amount
            given[p][a] += amount
            for q, gets, lost in path:
                given[q][lost] -= amount
                given[q][gets] += amount
            need[s] -= amount
    return taken


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    seed: int = 0,
) -> DataFrame:
    """One row per row: id, size, source_size, target, taken, whole (full repeats) and part (words of one more).

    source_col holds a source or an array of them; with several, source_size and target are sums over them.
    """
    many = isinstance(df.schema[source_col].dataType, T.ArrayType)
    members = F.array_sort(F.array_distinct(F.col(source_col))) if many else F.array(F.col(source_col).cast("string"))
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.to_json(F.struct(members.alias("m")), {"ignoreNullFields": "false"}).alias("_pattern"),
        members.alias("_members"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("_order"),
        F.xxhash64(F.col(text_col)).alias("_text"),
    )
    rows = scratch(rows.withColumn("_slice", F.shiftright("_order", 52).cast("int")), "sizes")
    found = rows.groupBy("_pattern").agg(F.first("_members").alias("m"), F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    found.sort(key=lambda r: r["_pattern"])
    names = sorted({x for r in found for x in r["m"]}, key=lambda x: (x is None, (x or "").encode()))
    number = {x: i for i, x in enumerate(names)}
    sizes = [sum(r["n"] for r in found if x in r["m"]) for x in names]
    shares = targets_within([([number[x] for x in r["m"]], r["n"]) for r in found], sizes, [weights[i % len(weights)] for i in range(len(names))])
    flow = route([([number[x] for x in r["m"]], r["n"]) for r in found], whole_targets(shares))
    plan = [
        (r["_pattern"], sum(sizes[number[x]] for x in r["m"]), float(sum(shares[number[x]] for x in r["m"])), f // r["n"] if r["n"] else 0, f % r["n"] if r["n"] else 0)
        for r, f in zip(found, flow, strict=True)
    ]
    spark = df.sparkSession
    plan_df = F.broadcast(local_table(spark, plan, {"_pattern": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "whole": pa.int64(), "rest": pa.int64()}))
    # the slice in which a pattern's rest runs out, and the words before it
    by_slice = rows.groupBy("_pattern", "_slice").agg(F.sum("size").alias("n")).join(plan_df, "_pattern")
    upto = Window.partitionBy("_pattern").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        by_slice.withColumn("upto", F.sum("n").over(upto))
        .where((F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        .select("_pattern", F.col("_slice").alias("_border"), (F.col("rest") - F.col("upto") + F.col("n")).alias("_left"))
    )
    border = local_table(spark, border.limit(MAX_PATTERNS).collect(), {"_pattern": pa.string(), "_border": pa.int32(), "_left": pa.int64()})
    rows = rows.join(plan_df, "_pattern").join(F.broadcast(border), "_pattern", "left")
    outside = rows.where(F.col("_border").isNull() | (F.col("_slice") != F.col("_border")))
    outside = outside.withColumn("_more", F.when(F.col("_slice") < F.col("_border"), F.col("size")).otherwise(0))
    before = Window.partitionBy("_pattern").orderBy("_order", "_id", "_text", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(F.col("_slice") == F.col("_border"))
    left = F.col("_left") - F.coalesce(F.sum("size").over(before), F.lit(0))
    inside = inside.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = outside.unionByName(inside)
    full = (F.col("size") > 0) & (F.col("_more") == F.col("size"))
    return out.select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("_more")).cast("long").alias("taken"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + F.when(full, 1).otherwise(0)).cast("long").alias("whole"),
        F.when(full, 0).otherwise(F.col("_more")).cast("long").alias("part"),
        F.col("_text").alias("text_hash"),
    )


def targets_within(patterns: Sequence[tuple[Sequence[int], int]], sizes: Sequence[int], weights: Sequence[int]) -> list[Fraction]:
    """As targets(), sharing the words of all patterns, each counted once though it may count for several sources."""
    total = sum(n for _, n in patterns)
    if total == sum(sizes):
        return targets(sizes, weights)
    scaled = targets(sizes, weights)
    return [x * Fraction(total, sum(sizes)) for x in scaled]


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, parts: bool = True, **options) -> DataFrame:
    """The mix itself, with the columns of df: each row as often as it was taken; a part is the text up to its last taken word.

    length_col, if any, gets the number of characters of a text that was cut. Without parts no text is cut: a document
    of which a part was taken comes once more if that is half of it or more, so a pattern's words are met to half a
    document. Of rows that agree in id and text, all get what the best of them got. Documents without words are
    taken never.
    """
    plan = mix(df, id_col, text_col, source_col, **options)
    if not parts:
        plan = plan.withColumn("whole", F.col("whole") + (2 * F.col("part") >= F.greatest("size", F.lit(1))).cast("long")).withColumn("part", F.lit(0).cast("long"))
    plan = plan.where("whole > 0 or part > 0")
    plan = plan.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max(F.struct("whole", "part")).alias("_plan"))
    keyed = df.select(F.struct("*").alias("_whole"), F.col(id_col).alias("_own"), F.xxhash64(F.col(text_col)).alias("_key"))
    met = keyed.join(plan, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")))
    times = F.col("_plan.whole") + F.when(F.col("_plan.part") > 0, 1).otherwise(0)
    met = met.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    cut, whole = F.col("_n") > F.col("_plan.whole"), F.col("_whole")
    words = F.regexp_extract_all(whole[text_col], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_plan.part").cast("int")), "")).otherwise(whole[text_col])
    own = {text_col: text} | ({length_col: F.when(cut, F.length(text)).otherwise(whole[length_col]).cast(df.schema[length_col].dataType)} if length_col else {})
    return met.select(*[own.get(c, whole[c]).alias(c) for c in df.columns])
