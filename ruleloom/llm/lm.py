"""LM scoring by prediction by partial matching over bytes.

A text is scored as its token stream: words with A-Z lower-cased, one space between them, one end. Byte contexts of up
to ORDER bytes form a trie of counts from the training rows. A symbol seen c times in the longest known context has probability
(2c - 1) / 2n, n the context's count; else the escape d / 2n is paid, d its number of distinct symbols, and the next
shorter context is asked, from which the symbols of the longer one are excluded; below the empty context all bytes
not yet excluded are equally likely. The trie is pretrained: scoring doesn't change it.

Counts of grams (context and symbol) and of words cover all training rows and are summed by Spark; every gram of every
length stays in a written table. The costs of the NODES most frequent longest grams are looked up on the workers; all
other grams of a text, seen in training or not, get theirs by joins with the whole tables, so NODES and COMMON set
speed, not results. Words' counts are looked up among the COMMON most frequent words likewise, all others by a join.

A null text counts as empty: one token, the end. A null id is never held out. An empty table gives an empty result;
with no training rows every symbol has probability 1/256 and the base is log10(1 / (0 + 0 + 1)) a token. Equal texts
have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import broadcast_if_small, scratch
from ruleloom.llm.text_arrays import _SPACE, encoded, words

ORDER = 5
NODES = 1 << 20
COMMON = 200_000
END = 10  # a line feed: no token holds it
U = np.uint64
#: Grams or words that a task holds before it passes on what it has.
HELD = 1 << 20
_KEEP = (1 << (8 * (ORDER + 1))) - 1


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: grams of ORDER + 1 bytes and their texts' numbers; words' hashes and theirs.

    Each text's stream begins after ORDER ends. A text of over a group's size comes in several groups, whose streams
    join, as the pieces of one text follow each other.
    """
    last_text, tail = -1, b""
    groups = list(words(texts))
    seen = np.zeros(len(texts), bool)
    for k, (low, start, end, hashes, of) in enumerate(groups):
        stop = np.zeros(len(low), bool)
        stop[end] = True
        keep = ~_SPACE[low]
        keep |= stop
        sym = low.copy()
        sym[end] = 32
        ends_text = np.ones(len(of), bool)
        ends_text[:-1] = of[1:] != of[:-1]
        after = next((g[4] for g in groups[k + 1 :] if len(g[4])), None)
        if len(of) and after is not None and after[0] == of[-1]:
            ends_text[-1] = False  # the text goes on in the next group
        sym[end[ends_text]] = END
        at = np.flatnonzero(keep)
        symbols = sym[at]
        # each symbol's text: that of its word
        word_of = np.repeat(np.arange(len(of)), end - start + 1)
        doc = of[word_of]
        first = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
        context = [np.full(ORDER, END, np.uint8)] * len(first)
        if len(doc) and doc[0] == last_text:
            context[0] = np.frombuffer(tail, np.uint8)
        pad = np.insert(symbols, np.repeat(first, ORDER), np.concatenate([np.zeros(0, np.uint8), *context])).astype(U)
        g = np.zeros(max(0, len(pad) - ORDER), U)
        for i in range(ORDER + 1):
            g = (g << U(8)) | pad[i : i + len(g)]
        own = np.arange(len(symbols)) + np.searchsorted(first, np.arange(len(symbols)), side="right") * ORDER - ORDER
        seen[doc] = True
        if len(doc):
            last_text = int(doc[-1])
            tail = bytes((context[-1].tobytes() + symbols[first[-1] :].tobytes())[-ORDER:])
        yield g[own], doc, hashes, of
    empty = np.flatnonzero(~seen)
    if len(empty):
        yield np.full(len(empty), int.from_bytes(bytes([END]) * (ORDER + 1)), U), empty, np.zeros(0, U), np.zeros(0, np.int64)


class Costs:
    """Log10 probabilities by gram, as a hash table."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray) -> None:
        self.bits = max(10, int(len(keys)).bit_length() + 1)
        self.table_key = np.full(1 << self.bits, np.iinfo(np.uint64).max, U)
        self.table_cost = np.zeros(1 << self.bits, np.float32)
        left, cost, slot = keys, costs.astype(np.float32), self._slot(keys)
        while len(left):
            free = self.table_key[slot] == np.iinfo(np.uint64).max
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.table_key[slot[put]], self.table_cost[slot[put]] = left[put], cost[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, cost, slot = left[rest], cost[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, 0 where the table lacks the gram, and the places of those."""
        slot = self._slot(g)
        hit = self.table_key[slot] == g
        out = np.where(hit, self.table_cost[slot], np.float32(0)).astype(float)
        left = np.flatnonzero(~hit)
        slot = slot[left]
        lost = [np.zeros(0, np.int64)]
        while len(left):
            key = self.table_key[slot]
            gone = key == np.iinfo(np.uint64).max
            hit = key == g[left]
            out[left[hit]] = self.table_cost[slot[hit]]
            lost.append(left[gone])
            on = ~(gone | hit)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out, np.sort(np.concatenate(lost))


def _low(key: str, n: int) -> Column:
    """The last n bytes of a gram."""
    return F.col(key).bitwiseAND((1 << (8 * n)) - 1)


def _levels(gram_counts: DataFrame) -> list[DataFrame]:
    """Counts of all grams of 1, 2, ..., ORDER + 1 bytes."""
    out = [gram_counts]
    for j in range(ORDER, 0, -1):
        out.insert(0, scratch(out[0].groupBy(_low("key", j).alias("key")).agg(F.sum("c").alias("c")), f"grams{j}"))
    return out


def _open_costs(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """key, cost for any distinct grams, by the definition: all levels are whole tables, met by joins."""
    kinds, total = F.col("d") - F.coalesce("up_d", F.lit(0)), F.col("n") - F.coalesce("up_out", F.lit(0))
    step = F.when(F.col("c").isNotNull(), F.log10((2 * F.col("c") - 1) / (2 * total)))
    step = step.when(kinds > 0, F.log10(kinds / (2 * total))).otherwise(0.0)  # with nothing left to offer, the escape is certain
    none = F.lit(None).cast("long")
    left, done = keys.select("key", F.lit(0.0).alias("cost"), none.alias("up_d"), none.alias("up_out")), []
    for j in range(ORDER, -1, -1):
        own = left.select(_low("key", j + 1).alias("own")).distinct()
        own = scratch(own.select("own", F.shiftright("own", 8).alias("context")), f"own{j}")
        wanted = own.select("context").distinct()
        counts = levels[j].select(F.col("key").alias("own"), "c", F.shiftright("key", 8).alias("context"))
        met = counts.join(wanted, "context", "left_semi")
        # what the next shorter context counts for the symbols that this one has seen
        if j:
            met = met.join(levels[j - 1].select(F.col("key").alias("s"), F.col("c").alias("sc")), _low("own", j) == F.col("s"), "left")
        else:
            met = met.withColumn("sc", F.lit(0))
        contexts = met.groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("sc").alias("out"))
        found = own.join(contexts, "context").join(counts.select("own", "c"), "own", "left").drop("context")
        found = broadcast_if_small(scratch(found, f"found{j}"), 48)
        met = left.withColumn("own", _low("key", j + 1)).join(found, "own", "left")
        left = scratch(
            met.select(
                "key", (F.col("cost") + F.when(F.col("n").isNull(), 0.0).otherwise(step)).alias("cost"), F.col("d").alias("up_d"),
                F.col("out").alias("up_out"), F.col("c").isNotNull().alias("done"),
            ),
            f"step{j}",
        )
        done.append(left.where("done").select("key", "cost"))
        left = left.where("not done").drop("done")
    symbols = levels[0].count()
    out = left.select("key", (F.col("cost") - float(np.log10(256 - symbols)) if symbols < 256 else F.col("cost")).alias("cost"))
    for x in done:
        out = out.unionByName(x)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _counted(texts: DataFrame) -> DataFrame:
    """kind (0: gram, 1: word), key, c over all rows of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merged(k: int) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([np.zeros(0, U), *(x for x, _ in held[k])]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([np.zeros(0), *(c for _, c in held[k])]), len(keys)).astype(np.int64)

        def out(k: int) -> pd.DataFrame:
            keys, c = merged(k)
            held[k] = []
            return pd.DataFrame({"kind": np.full(len(keys), k, np.int32), "key": keys.view(np.int64), "c": c})

        for batch in batches:
            for g, _, h, _ in grams(encoded(batch["_text"])):
                for k, x in enumerate((g, h)):
                    held[k].append(np.unique(x, return_counts=True))
                    if sum(len(x) for x, _ in held[k]) > 2 * HELD:
                        held[k] = [merged(k)]
                        if len(held[k][0][0]) > HELD:
                            yield out(k)
        yield out(0)
        yield out(1)

    return texts.mapInPandas(count, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most so many rows of the highest counts; all of a count or none, unless that would leave none."""
    by = counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    least, total = None, 0
    for r in by:
        if total + r["n"] > most:
            break
        least, total = r["c"], total + r["n"]
    return counts.where(F.col("c") >= F.lit(least)) if least is not None else counts.limit(0) if by else counts


@lru_cache(1)
def _costs(keys: bytes, costs: bytes) -> Costs:
    return Costs(np.frombuffer(keys, U), np.frombuffer(costs))


def _columns(df: DataFrame, value: str = "c") -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted as unsigned, and values of a bounded table."""
    table = df.select("key", value).toArrow()
    keys, c = table["key"].to_numpy().astype(np.int64).view(U), table[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], c[order]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, common: int = COMMON) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    training = rows.where(~held_out("_id"))
    counts = scratch(_counted(training.select("_text")), "counts")
    texts = training.count()
    vocabulary = counts.where("kind = 1").select("key", "c")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + texts, distinct + (texts > 0)
    gram_counts = counts.where("kind = 0").select("key", "c")
    # a gram that training has seen ends at the longest context, so its cost needs that context's count only
    hot = scratch(_most_frequent(gram_counts, nodes), "hot")
    contexts = gram_counts.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("c").alias("n"))
    hot = hot.join(contexts, F.shiftright("key", 8) == F.col("context")).select("key", F.log10((2 * F.col("c") - 1) / (2 * F.col("n"))).alias("cost"))
    keys, costs = _columns(hot, "cost")
    known_keys, known_c = _columns(_most_frequent(vocabulary, common))
    least = int(known_c.min()) if len(known_c) else 0
    model = spark.sparkContext.broadcast((keys.tobytes(), costs.astype(float).tobytes(), known_keys, np.log10(known_c + 1.0)))
    log_all, end = float(np.log10(total + distinct + 1.0)), float(np.log10(texts + 1.0))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        k, c, known, logs = model.value
        hot, number = _costs(k, c), TaskContext.get().partitionId() << 40
        for batch in batches:
            n = len(batch)
            value, tokens, hits, base = np.zeros(n), np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, end)
            rest: list[list[np.ndarray]] = [[np.zeros(0, U)] for _ in range(n)]
            miss: list[list[np.ndarray]] = [[np.zeros(0, U)] for _ in range(n)]

            def keep(into: list[list[np.ndarray]], left: np.ndarray, left_of: np.ndarray) -> None:
                cut = np.searchsorted(left_of, np.arange(len(into) + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    into[i].append(left[cut[i] : cut[i + 1]])

            for g, doc, h, of in grams(encoded(batch["_text"])):
                cost, lost = hot.find(g)
                value += np.bincount(doc, cost, n)
                keep(miss, g[lost], doc[lost])
                tokens += np.bincount(of, minlength=n)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                base += np.bincount(of[hit], logs[at[hit]], n)
                hits += np.bincount(of[hit], minlength=n)
                keep(rest, h[~hit], of[~hit])
            yield pd.DataFrame(
                {
                    "_id": batch["_id"], "_row": number + np.arange(n), "n_tokens": tokens, "hits": hits, "base": base, "score": value,
                    "rest": [np.concatenate(x).view(np.int64) for x in rest], "miss": [np.concatenate(x).view(np.int64) for x in miss],
                }
            )
            number += n

    out = rows.mapInPandas(scored, f"_id {kind}, _row long, n_tokens long, hits long, base double, score double, rest array<long>, miss array<long>")
    out = scratch(out, "scored")
    rare = out.select("_row", F.explode("rest").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("k"))
    found = vocabulary.where(F.col("c") < least) if least else vocabulary
    rare = rare.join(found, "key").groupBy("_row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("add"))
    missed = scratch(out.select("_row", F.explode("miss").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("k")), "missed")
    open_ = scratch(missed.select("key").distinct(), "open")
    open_ = broadcast_if_small(scratch(_open_costs(open_, _levels(gram_counts)), "costs"), 24)
    # decimals, as their sum doesn't depend on the order of rows
    added = F.sum(F.col("k").cast("decimal(12,0)") * F.col("cost").cast("decimal(16,12)")).cast("double")
    missed = missed.join(open_, "key").groupBy("_row").agg(added.alias("open"))
    met = out.drop("rest", "miss").join(rare, "_row", "left").join(missed, "_row", "left")
    return met.select(
        F.col("_id").alias(id_col),
        held_out("_id").alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("more", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("score") + F.coalesce("open", F.lit(0.0))).alias("score"),
    )
