"""N-gram Jaccard join by grouped prefixes: all links between documents' shingle sets, as components.

1. Equal sets become one set. Shingles get one global order: those of a fixed-size count sketch's crowded cells last,
   the others by hash. Any two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1.
2. Sets with the same prefix and size form a group. Groups that share a prefix shingle, and whose sizes and places of
   that shingle allow the threshold, are pairs. In a crowded shingle's bucket groups are first paired with one hub only.
3. Group pairs expand to pairs of sets; a parity signature bounds each pair's difference from below and drops most;
   the rest are verified on the whole sets.
4. Links give components. In crowded buckets only groups stay whose size and place some other there allows; documents of
   one template that differ too much end here. Where such a bucket then still holds several components, its sets meet HUBS more hubs of
   other components, in up to ROUNDS rounds: members of a cluster of near copies soon share one component, at about m
   comparisons a round instead of m squared.
5. Buckets that even then hold several components are searched by parts. Sets that reach the threshold differ in at
   most D shingles; dealt by hash into more than D parts, they agree in at least one. Sets of a crowded bucket that
   agree in a part, that of the part's largest component against the others, are verified. Pairs within a component
   can't change the result, so no link between components is lost, whatever a bucket's size.

Shingles are 64-bit hashes of words; sets, links and sizes are exact but for their collisions. A document without
words has an empty set and links with nothing; one with fewer words than n has its whole sequence as one shingle.
Rows that are equal share a component. An empty table gives an empty result. Null ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import BROADCAST_BYTES, broadcast_if_narrow, broadcast_if_small, few_files, join_one, scratch
from ruleloom.llm.components import components
from ruleloom.llm.text_arrays import encoded, mix, word_hashes

U = np.uint64
#: Bytes of each task's sketch, a counter each; its size is fixed, so it may be broadcast (as one bit a cell).
CELLS = 1 << 22
BLOCK = 1 << 16
#: A cell is crowded from so many above twice the mean on. This sets the order's quality, not the result.
CROWDED = 8
#: Larger buckets are searched by hubs, components and parts; in others all pairs meet.
LARGE = 256
#: So many shingles that recur in prefixes are sent to the workers as a sorted array; more are joined instead.
SENT = 8 << 20
#: Sets of a group that stay together.
GROUP = 16
#: Rounds of hubs, and hubs of a crowded bucket in each. They set the speed: what they leave open goes by parts.
ROUNDS = 1
HUBS = 16
#: Rows of a crowded part that stay together, about.
TILE = 2048
#: 64-bit words of a signature at least; a larger set has as many bits as shingles, rounded up to a power of two.
WORDS = 16
FOLDED = 4  # words of its short form
#: A block's counts are added up in so many parts first.
PARTS = 16
#: A row with signatures or shingles, or work on one, counts as so many narrow rows of a file.
WIDE, WIDER = 16, 64


def shingles(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    w, first = word_hashes(texts)
    with np.errstate(over="ignore"):
        all_ = w[: max(0, len(w) - n + 1)].copy()
        for k in range(1, n):
            all_ = all_ * U(0x9E3779B97F4A7C15) + w[k : k + len(all_)]
        all_ = mix(all_)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(all_[a : b - n + 1])
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                yield s[keep]
            elif b > a:
                x = U(b - a)
                for y in w[a:b]:
                    x = x * U(0xD6E8FEB86659FD93) + y
                yield mix(np.array([x], U))
            else:
                yield np.zeros(0, U)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _crowded_cells(texts: DataFrame, n: int, cells: int) -> np.ndarray:
    """A bit for each cell of the sketch: the number of documents' shingles in it is far above the mean."""
    shift = U(64 - cells.bit_length() + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(cells, np.uint8)
        for batch in batches:
            at = np.concatenate([np.zeros(0, U), *shingles(encoded(batch["_text"]), n)]) >> shift
            cell, c = np.unique(at.astype(np.int64), return_counts=True)
            total[cell] = np.minimum(255, total[cell].astype(np.int64) + c)  # what is crowded stays so
        blocks = total.reshape(-1, BLOCK)
        yield pd.DataFrame({"block": np.arange(len(blocks)), "part": TaskContext.get().partitionId() % PARTS, "counts": [x.tobytes() for x in blocks]})

    def total_of(rows: pd.DataFrame, kind: type) -> np.ndarray:
        return sum(np.frombuffer(x, kind).astype(np.uint32) for x in rows["counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.minimum(total_of(rows, np.uint8), 65535).astype(np.uint16)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "counts": [total.tobytes()]})

    def crowd(rows: pd.DataFrame) -> pd.DataFrame:
        total = total_of(rows, np.uint16)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "counts": [np.packbits(total > CROWDED + 2 * total.mean()).tobytes()]})

    kind = "block long, counts binary"
    parts = texts.mapInPandas(count, "block long, part int, counts binary")
    sums = parts.groupBy("block", "part").applyInPandas(add, kind)  # a block's counts meet in two steps
    bits = dict(map(tuple, sums.groupBy("block").applyInPandas(crowd, kind).collect()))
    empty = bytes(BLOCK // 8)
    return np.unpackbits(np.frombuffer(b"".join(bytes(bits.get(i, empty)) for i in range(cells // BLOCK)), np.uint8)).astype(bool)


def _described(rows: DataFrame, kind: str, n: int, num: int, den: int, crowded: np.ndarray) -> DataFrame:
    """For each row its text's hash and its set's size, digest, prefix and signature."""
    shift = U(64 - len(crowded).bit_length() + 1)
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(crowded))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            size, digest, prefix, signature, fold = [], [], [], [], []
            for s in shingles(encoded(batch["_text"]), n):
                k = len(s)
                last = late[(s >> shift).astype(np.int64)]
                order = np.concatenate([s[~last], s[last]])
                size.append(k)
                digest.append(_digest(s))
                prefix.append(order[: k + (-num * k // den) + 1 if k else 0].view(np.int64))
                signature.append(_parity(s, max(64 * WORDS, 1 << max(0, k - 1).bit_length())))
                fold.append(_parity(s, 64 * FOLDED))
            yield pd.DataFrame({"_id": batch["_id"], "hash": batch["_hash"], "n": size, "set": digest, "prefix": prefix, "sig": signature, "fold": fold})

    return rows.mapInPandas(describe, f"_id {kind}, hash long, n int, set binary, prefix array<long>, sig array<long>, fold array<long>")


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """For each bit whether an odd number of shingles falls on it; halves xor-ed together give the form of half the bits."""
    at = (s & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _fold_near(num: int, den: int) -> str:
    """Whether the short signatures allow the threshold: parities differ in at most as many bits as the sets do."""
    bits = " + ".join(f"bit_count(fold_a[{i}] ^ fold_b[{i}])" for i in range(FOLDED))
    return f"({den} + {num}) * ({bits}) <= ({den} - {num}) * (n_a + n_b)"


def _near(num: int, den: int) -> str:
    """The same by the full signatures; of two lengths, the longer one is folded."""
    least = "least(size(sig_a), size(sig_b))"
    a, b = (f"if(size(sig_{x}) > {least}, zip_with(slice(sig_{x}, 1, {least}), slice(sig_{x}, {least} + 1, {least}), (p, q) -> p ^ q), sig_{x})" for x in "ab")
    bits = f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (m, x) -> m + x)"
    far = "size(sig_a) > 2 * size(sig_b) or size(sig_b) > 2 * size(sig_a)"
    return f"({_fold_near(num, den)} and ({far} or ({den} + {num}) * {bits} <= ({den} - {num}) * (n_a + n_b)))"


def _maybe_near(num: int, den: int) -> str:
    """The short form's answer; groups of several sets have none."""
    return f"(fold_a is null or fold_b is null or {_fold_near(num, den)})"


def _sizes(num: int, den: int) -> str:
    return f"{num} * greatest(n_a, n_b) <= {den} * least(n_a, n_b)"


def _places(num: int, den: int) -> str:
    """Whether sets whose first shingle in common has these places, from 1 on, can have enough in common from there on."""
    return f"({den} + {num}) * (least(n_a - pos_a, n_b - pos_b) + 1) >= {num} * (n_a + n_b)"


def bands(most: int, num: int, den: int) -> list[int]:
    """The first size of each band, up to one beyond most: linked sets lie in the same band or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return out


def parts_of(s: np.ndarray, first: list[int], num: int, den: int) -> np.ndarray:
    """Keys of a set's parts: any two sets that reach the threshold share one.

    With the smaller set in band b, of sizes below m, the sets differ in at most D = (den - num) / num * (m - 1)
    shingles. Of P > D parts at least P - D agree. A set with fewer empty parts than that leaves those out, as one that
    agrees isn't empty; if both sets have more, both keep theirs.
    """
    out, band = [np.zeros(0, U)], int(np.searchsorted(first, len(s), side="right")) - 1
    with np.errstate(over="ignore"):
        mixed = mix(s * U(0x9FB21C651E98DF25) + U(1))
        for b in {max(0, band - 1), band}:
            d = (den - num) * (first[b + 1] - 1) // num
            p = d + 2 + d // 16
            at = ((mixed >> U(32)) % U(p)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            held, begin = np.unique(at[order], return_index=True)
            sums = np.zeros(p, U)
            sums[held] = np.add.reduceat(mixed[order], begin) if len(s) else 0
            keys = mix(sums + mix(np.arange(p, dtype=U) * U(0xD6E8FEB86659FD93) + U(b)))
            out.append(keys[held] if p - len(held) < p - d else keys)
    return np.concatenate(out)


def _side(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "token" else f"{c}_{side}") for c in names])


def _recurring(often: DataFrame):
    """The places, from 1 on, of those of an array's shingles that a bounded table holds."""
    keys = np.sort(often.select("token").toArrow()["token"].to_numpy())
    shared = often.sparkSession.sparkContext.broadcast(keys)

    @F.pandas_udf("array<int>")
    def keep(prefixes: pd.Series) -> pd.Series:
        known, out = shared.value, []
        for p in prefixes:
            at = np.minimum(np.searchsorted(known, p), max(0, len(known) - 1))
            out.append((1 + np.flatnonzero(known[at] == p)).astype(np.int32) if len(known) else np.zeros(0, np.int32))
        return pd.Series(out)

    return keep


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots, as components() gives them, after further links; these count between the components that they join."""
    known = broadcast_if_small(roots, 64)
    for end in ("a", "b"):
        own = known.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
        links = links.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    new = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    up = broadcast_if_small(new, 64).select(F.col("id").alias("root"), F.col("root").alias("up"))
    old = roots.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    return scratch(old.unionByName(new), "roots")


class _Join:
    def __init__(self, rows: DataFrame, described: DataFrame, n: int, num: int, den: int) -> None:
        self.rows, self.described, self.n, self.num, self.den = rows, described.where("n > 0"), n, num, den
        self.docs, shingled = self.described.agg(F.count("*"), F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()
        # a row whose key no other has is a group by itself and doesn't shuffle; equal sets fall together in collect_set
        several = scratch(few_files(self.described.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), self.docs), "several")
        several = broadcast_if_small(several, 32)
        met = self.described.join(several, "key")
        crowd = met.select("key", "set").distinct().groupBy("key").agg(F.count("*").alias("k")).where(f"k > {2 * GROUP}")
        dealt = met.join(broadcast_if_small(scratch(few_files(crowd, self.docs), "crowd"), 32), "key", "left")
        deal = F.coalesce(F.pmod(F.xxhash64("set"), F.ceil(F.col("k") / GROUP)), F.lit(0))
        groups = dealt.groupBy("key", "n", "prefix", deal.alias("deal")).agg(F.collect_set(F.struct("set", "sig", "fold")).alias("members"))
        groups = scratch(few_files(groups.select("n", "prefix", "members"), WIDE * self.docs), "groups")
        alone = self.described.join(several, "key", "left_anti").select("n", "prefix", F.array(F.struct("set", "sig", "fold")).alias("members"))
        # a collision of node numbers only adds pairs, which are verified on the sets
        node = F.xxhash64(F.array_min(F.transform("members", lambda m: m["set"])))
        self.groups = alone.unionByName(groups).select(node.alias("node"), "n", "prefix", "members")
        every = self.groups.select(F.explode("prefix").alias("token"))
        often = scratch(few_files(every.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), shingled), "often")
        groups = self.groups.select("node", "n", "prefix", F.when(F.size("members") == 1, F.col("members")[0]["fold"]).alias("fold"))
        large = broadcast_if_small(scratch(often.where(f"c > {LARGE}").select("token", F.lit(True).alias("large")), "large"), 72)
        if often.count() <= SENT:
            known = F.transform(_recurring(often)(F.col("prefix")), lambda p: F.struct(F.element_at("prefix", p).alias("token"), p.alias("pos")))
            tokens = groups.select("node", "n", "fold", F.inline(known))
        else:
            every = groups.select("node", "n", "fold", F.posexplode("prefix").alias("pos", "token"))
            tokens = every.withColumn("pos", F.col("pos") + 1).join(often.select("token"), "token", "left_semi")
        tokens = tokens.join(large, "token", "left").withColumn("large", F.coalesce("large", F.lit(False)))
        self.tokens = scratch(tokens.select("token", "pos", "node", "n", "fold", "large"), "tokens")
        self.places = self.tokens.count()

    def group_pairs(self) -> DataFrame:
        """Pairs of groups (node_a < node_b): all in small buckets; in large ones each with a hub of about its size."""
        near = f"{_sizes(self.num, self.den)} and {_places(self.num, self.den)} and {_maybe_near(self.num, self.den)}"
        small, names = self.tokens.where("not large"), ["token", "pos", "node", "n", "fold"]
        a, b = _side(small, "a", *names), _side(small, "b", *names)
        met = a.join(b, (a["token"] == b["token"]) & F.expr(f"node_a < node_b and {near}")).select("node_a", "node_b")
        large = self.tokens.where("large")
        large = large.withColumn("band", F.floor(F.log("n") / F.log(F.lit(self.den / self.num))))
        hubs = large.groupBy("token", "band").agg(F.min_by(F.struct("node", "n", "fold", "pos"), "node").alias("hub"))
        star = large.join(hubs, ["token", "band"]).where("node <> hub.node")
        star = star.selectExpr("node as node_a", "n as n_a", "fold as fold_a", "pos as pos_a", "hub.node as node_b", "hub.n as n_b", "hub.fold as fold_b", "hub.pos as pos_b")
        star = star.where(near).select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"))
        return met.unionByName(star).distinct()

    def set_pairs(self) -> DataFrame:
        """Pairs of sets that may reach the threshold, of group pairs and within groups."""
        pairs, groups = scratch(few_files(self.group_pairs(), WIDE * self.places), "group-pairs"), self.groups.select("node", "n", "members")
        few = 2 * pairs.count()
        if few * 24 <= BROADCAST_BYTES:
            ends = pairs.select(F.col("node_a").alias("node")).unionByName(pairs.select(F.col("node_b").alias("node")))
            groups = scratch(few_files(groups.join(F.broadcast(ends), "node", "left_semi"), WIDE * few), "paired")
            groups = broadcast_if_narrow(groups, F.lit(64) + F.aggregate("members", F.lit(0), lambda z, m: z + 96 + 8 * F.size(m["sig"])))
        met = pairs.join(_side(groups, "a", "node", "n", "members"), "node_a").join(_side(groups, "b", "node", "n", "members"), "node_b")
        met = met.select("n_a", "n_b", "members_a", "members_b", F.lit(False).alias("own"))
        own = self.groups.where("size(members) > 1").selectExpr("n as n_a", "n as n_b", "members as members_a", "members as members_b", "true as own")
        met = met.unionByName(own).select("n_a", "n_b", F.explode("members_a").alias("x"), "members_b", "own")
        met = met.select("n_a", "n_b", "x", F.explode("members_b").alias("y"), "own").where("if(own, x.set < y.set, x.set <> y.set)")
        met = met.selectExpr("n_a", "n_b", "x.set as set_a", "y.set as set_b", "x.sig as sig_a", "y.sig as sig_b", "x.fold as fold_a", "y.fold as fold_b").where(_near(self.num, self.den))
        # a set is in one group only and group pairs are distinct, so no pair comes twice
        return met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))

    def made(self, sets: DataFrame) -> DataFrame:
        """set, s: the shingles of sets (read from a written table; they may repeat), made anew from the text of one document each."""
        n = self.n
        found = self.described.select("set", "_id").join(broadcast_if_small(sets, 48), "set", "left_semi")
        wanted = scratch(few_files(found.groupBy("set").agg(F.min("_id").alias("_id")), self.docs), "found")
        ids = broadcast_if_small(wanted.select(F.col("_id").alias("_want")), 32)
        texts = self.rows.join(ids, F.col("_id").eqNullSafe(F.col("_want")), "left_semi").select("_text")

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = list(shingles(encoded(batch["_text"]), n))
                yield pd.DataFrame({"set": [_digest(s) for s in found], "s": [s.tobytes() for s in found]})

        made = texts.mapInPandas(make, "set binary, s binary").join(wanted.select("set"), "set", "left_semi").dropDuplicates(["set"])
        return scratch(few_files(made, WIDER * wanted.count()), "made")

    def verified(self, pairs: DataFrame, made: DataFrame | None = None) -> DataFrame:
        """The pairs that reach the threshold; made has their sets' shingles, if they are there already."""
        num, den = self.num, self.den
        pairs = scratch(pairs, "pairs")
        count = pairs.count()
        wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))
        few = 2 * count * 48 <= BROADCAST_BYTES
        wanted = wanted if few else scratch(wanted.distinct(), "wanted")
        made = self.made(wanted) if made is None else made
        # few and short sets go to the pairs; else both are shuffled, without sets that no pair has
        sent = broadcast_if_narrow(made, F.length("s") + 64)
        made = made.join(broadcast_if_small(wanted, 48), "set", "left_semi") if sent is made else sent

        @F.pandas_udf("boolean")
        def reach(left: pd.Series, right: pd.Series) -> pd.Series:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                out.append(den * both >= num * (len(x) + len(y) - both))
            return pd.Series(out, dtype=bool)

        met = pairs.join(made.select(F.col("set").alias("a"), F.col("s").alias("s_a")), "a").join(
            made.select(F.col("set").alias("b"), F.col("s").alias("s_b")), "b"
        )
        return scratch(few_files(met.where(reach("s_a", "s_b")).select("a", "b"), WIDE * count), "verified")

    def live(self) -> DataFrame:
        """The rows of large buckets that some row there may link with, by sizes and places.

        With its shingle as the first in common, a row can reach sizes up to its limit only. Any two linked sets are live in
        the bucket of their first common shingle; rows that only share a template's late shingles aren't.
        """
        num, den = self.num, self.den
        limit = F.floor((num + den) * (F.col("n") - F.col("pos") + 1) / num) - F.col("n")
        band = F.floor(F.log("n") / F.log(F.lit(den / num)))
        large = self.tokens.where("large").select("token", "node", "n", limit.alias("limit"), band.alias("band"))
        sizes = scratch(few_files(large.groupBy("token", "band").agg(F.min("n").alias("lo"), F.max("limit").alias("hi")), self.places), "sizes")
        # linked sets lie in one band or in neighbours; one more on each side allows for rounded logarithms
        near = sizes.select("token", F.explode(F.array(*[F.col("band") + i for i in range(-2, 3)])).alias("band"), "lo", "hi")
        near = F.broadcast(near) if sizes.count() * 5 * 64 <= BROADCAST_BYTES else near
        fits = (large["token"] == near["token"]) & (large["band"] == near["band"]) & (large["limit"] >= near["lo"]) & (large["n"] <= near["hi"])
        return large.join(near, fits, "left_semi").select("token", "node")

    def open_sets(self, roots: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """The sets of large buckets that hold several components: set, n, sig, fold, tokens (of such buckets), root."""
        roots = broadcast_if_small(roots.withColumnRenamed("id", "set"), 64)
        if before is None:
            large = scratch(few_files(self.live().groupBy("node").agg(F.collect_list("token").alias("tokens")), 4 * self.places), "live")
            large = broadcast_if_narrow(large, F.lit(64) + 8 * F.size("tokens"))
            members = self.groups.select("node", "n", F.explode("members").alias("m")).selectExpr("node", "n", "m.set as set", "m.sig as sig", "m.fold as fold")
            before = large.join(members, "node")
        met = before.select("set", "n", "sig", "fold", "tokens").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        met = scratch(few_files(met, WIDE * self.docs), "in-large")
        token = met.select("root", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        token = scratch(few_files(token.where("lo <> hi").select("token"), 4 * self.places), "open-buckets")
        if token.count() <= SENT:
            met = met.withColumn("tokens", F.transform(_recurring(token)(F.col("tokens")), lambda p: F.element_at("tokens", p)))
            return scratch(met.where("size(tokens) > 0"), "open")
        held = met.select("set", F.explode("tokens").alias("token")).join(broadcast_if_small(token, 24), "token")
        held = held.groupBy("set").agg(F.collect_list("token").alias("tokens"))
        return scratch(met.drop("tokens").join(held, "set"), "open")

    def hub_pairs(self, open_: DataFrame, k: int) -> DataFrame:
        """Pairs of sets of open buckets with hubs of other components; each set in one of its buckets, another in each round k."""
        bucket = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(k))))
        band = F.floor(F.log("n") / F.log(F.lit(self.den / self.num)))
        met = open_.select(bucket.alias("token"), band.alias("band"), "n", "set", "sig", "fold", "root")
        deal = F.xxhash64("set", F.lit(k))
        hubs = met.groupBy("token", "band", F.pmod(deal, F.lit(HUBS)).alias("slot")).agg(F.min_by(F.struct("n", "set", "sig", "fold", "root"), deal).alias("hub"))
        hubs = hubs.select("token", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "hub.*").withColumnsRenamed({c: f"{c}_b" for c in ("n", "set", "sig", "fold", "root")})
        met = met.withColumnsRenamed({c: f"{c}_a" for c in ("n", "set", "sig", "fold", "root")})
        met = met.join(hubs, ["token", "band"]).where(F.expr(f"root_a <> root_b and {_sizes(self.num, self.den)} and {_near(self.num, self.den)}"))
        return met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()

    def part_pairs(self, open_: DataFrame, made: DataFrame) -> DataFrame:
        """Pairs of open sets of different components that agree in a part."""
        num, den = self.num, self.den
        first = bands(int(open_.agg(F.max("n")).first()[0]), num, den)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    some = batch.iloc[at : at + 64]
                    keys = [parts_of(np.frombuffer(s, U), first, num, den).view(np.int64) for s in some["s"]]
                    sizes = list(map(len, keys))
                    yield pd.DataFrame({c: some[c].to_numpy().repeat(sizes) for c in ("set", "n", "root")} | {"key": np.concatenate(keys)})

        known = broadcast_if_small(open_.select("set", "n", "root"), 96)
        parts = scratch(made.join(known, "set").mapInPandas(deal, "set binary, n int, root binary, key long"), "parts")
        held = parts.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", "c").alias("most"), F.count("*").alias("k"), F.sum("c").alias("c"))
        held = held.where("k > 1").select("key", "most", F.ceil(F.col("c") / TILE).alias("tiles"))
        held = broadcast_if_small(scratch(few_files(held, parts.count()), "open-parts"), 72)
        # only rows whose part agrees with one of another component's set get their signatures, for the join's condition
        forms = broadcast_if_narrow(open_.select("set", "sig", "fold"), F.lit(128) + 8 * F.size("sig"))
        met = scratch(parts.join(held, "key").join(forms, "set"), "met-in-parts")
        count = met.count()
        a, b = (met.select("key", "tiles", *[F.col(c).alias(f"{c}_{s}") for c in ("set", "n", "root", "sig", "fold", "most")]) for s in "ab")
        # a crowded part is dealt into tiles, which the rows of smaller components visit one by one
        a = a.where("root_a <> most_a").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles")
        b = b.withColumn("tile", F.pmod(F.xxhash64("set_b", F.lit(5)), F.col("tiles"))).drop("tiles")
        met = a.join(b, ["key", "tile"]).where(F.expr(f"root_a <> root_b and {_sizes(num, den)} and {_near(num, den)}"))
        return few_files(met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct(), WIDE * count)

    def roots(self) -> DataFrame:
        """(id, root) of linked sets, as components() gives them; made anew only where a step has found more links."""
        roots = components(self.verified(self.set_pairs()))
        if self.tokens.where("large").isEmpty():
            return roots
        open_ = self.open_sets(roots)
        if open_.isEmpty():
            return roots
        made = self.made(open_.select("set"))
        for k in range(ROUNDS):
            more = self.verified(few_files(self.hub_pairs(open_, k), 3 * HUBS * open_.count()), made)
            if more.isEmpty():
                break
            roots = _joined(roots, more)
            open_ = self.open_sets(roots, open_)
            if open_.isEmpty():
                return roots
        more = self.verified(self.part_pairs(open_, made), made)
        return roots if more.isEmpty() else _joined(roots, more)


def ngram_components(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_shingles, component_id, keep (the row of the smallest id stands for its component).

    Links: den * intersection >= num * union. Of rows of the smallest id that differ in text, one stays.
    """
    return _components(df, n, num, den, id_col, text_col).drop("hash")


def _components(df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """ngram_components() with the hash of each row's text."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    crowded = _crowded_cells(rows.select("_text"), n, CELLS)
    described = _described(rows, kind, n, num, den, crowded).withColumn("key", F.xxhash64("n", "prefix"))
    described = scratch(described, "described")
    roots = _Join(rows, described, n, num, den).roots().withColumnRenamed("id", "set")
    count = described.count()
    docs = described.select("_id", "hash", "n", "set").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    docs = scratch(few_files(docs, 4 * count), "rooted")
    full = docs.where("n > 0")
    least = full.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "set", "hash")).alias("least"), F.count("*").alias("size"))
    met = join_one(full, scratch(few_files(least, 4 * count), "least"), "root", "size", 96).select(
        F.col("_id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.col("least._id").alias("component_id"),
        (F.col("_id").eqNullSafe(F.col("least._id")) & (F.col("set") == F.col("least.set")) & (F.col("hash") == F.col("least.hash"))).alias("keep"),
        "hash",
    )
    empty = docs.where("n = 0").select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(True).alias("keep"), "hash")
    return met.unionByName(empty)


def drop_near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stand for their component, with their columns as they were.

    A row goes by its id and its text, as ids may be null or repeat with other texts. Rows that agree in both stay or go alike.
    """
    found = _components(df, n, num, den, id_col, text_col)
    drop = scratch(found.where("not keep").select(F.col(id_col).alias("_drop"), F.col("hash").alias("_hash")).distinct(), "dropped")
    whole = df.select(F.struct("*").alias("_whole"), F.col(id_col).alias("_own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"))
    return whole.join(broadcast_if_small(drop, 24), (F.col("_key") == F.col("_hash")) & F.col("_own").eqNullSafe(F.col("_drop")), "left_anti").select("_whole.*")
