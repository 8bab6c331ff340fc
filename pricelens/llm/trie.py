"""Prefix trie of conversations: double arrays by shard, merged above.

A turn is a key, the hash of its role and text. Conversations are cut into segments of a few turns; a segment hangs on its
gate, the node where its conversation stands before it, named by a sum of hashes of the segments so far. Equal segments
of a gate are one, with a count, so that a prefix that a third of all conversations share is a handful of rows.

Segments are dealt to shards by gate and first turn (what a hot first turn begins is dealt by the whole segment). A
shard numbers its gates and turns densely and packs its trie into two arrays: the child of node s by turn c is BASE[s] + c,
and it is one if CHECK there says s. All segments walk these arrays level by level, which gives their nodes. Nodes that
several shards share are then merged by their names.

What a node sums over its subtree comes from chains: a node belongs to its smallest member, and what belongs to one
conversation is a chain of nodes that hangs on the chain of a smaller one. Totals of chains of chains come from pointer
doubling, the nodes of a chain from running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import attach, lineage_cut
from pricelens.operators import ranges

#: Turns of a segment; segments of a shard, about; conversations whose ids are written out as one piece of text.
SEGMENT, SHARD, PIECE = 8, 50_000, 4096
#: Conversations are rebuilt from the first turns of every so-manieth one, fewer than MOST_SHARED of them.
EVERY, MOST_SHARED = 100, 6
_NAME = 32  # hex digits of a hash that are kept


def _name(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, _NAME)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, chars): turns in order, places from 1. A null role or text counts as empty, a null turn stands
    first; turns that tie are ordered by the SHA-256 of the role's length, role and text. Rows without conv_id take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = _name(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.char_length(text).cast("long").alias("chars"))
    return ranges.numbered(rows, ["conv_id"], ["turn", "key"], "place").select("conv_id", "place", "key", "chars")


def shared_turns(conv_id: str = "conv_id") -> Column:
    return F.crc32(F.col(conv_id).cast("string")) % MOST_SHARED


def base_of(conv_id: str = "conv_id") -> Column:
    return F.col(conv_id) - F.col(conv_id) % EVERY


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of every conversation, and (conv_id, pos, key, chars) of the rebuilt ones, pos from 0: the first turns of the
    conversation at the last multiple of EVERY, so many as the hash of the id says, then the own ones behind that many."""
    own = lineage_cut(turns(conversations))
    ids = lineage_cut(own.select("conv_id").distinct().withColumns({"h": shared_turns(), "base": base_of()}))
    first = own.where((F.col("conv_id") % EVERY == 0) & (F.col("place") < MOST_SHARED)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "key", "chars"))).alias("lead"))
    led = ids.join(first, "base").select("conv_id", F.posexplode(F.expr("slice(lead, 1, cast(h as int))")).alias("pos", "x"))
    size = first.select("base", F.size("lead").alias("n_lead"))
    behind = own.withColumns({"h": shared_turns(), "base": base_of()}).where("place > h")
    moved = attach(behind, "base", size, "left", by=["conv_id", "place"])
    pos = F.col("place") - 1 - F.col("h") + F.least(F.col("h"), F.coalesce("n_lead", F.lit(0)))
    rest = moved.select("conv_id", pos.alias("pos"), "key", "chars")
    return ids.select("conv_id"), led.select("conv_id", F.col("pos").cast("long").alias("pos"), "x.key", "x.chars").unionByName(rest)


def segments(steps: DataFrame) -> DataFrame:
    """(conv_id, band, gate, next_gate, keys, chars): each conversation's segments, in order from band 0."""
    cut = steps.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("band")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("x"))
    rows = cut.select("conv_id", "band", F.transform("x", lambda t: t["key"]).alias("keys"), F.transform("x", lambda t: t["chars"]).alias("chars"))
    digest = F.sha2(F.concat(F.col("band").cast("string"), F.lit(":"), F.array_join("keys", "")), 256)
    pieces = {f"p{i}": F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)}
    dealt = ranges.ranged(rows.withColumns(pieces), ["conv_id"], ["band"])
    summed = ranges.running(dealt, ["conv_id"], ["band"], {f"s{i}": ("sum", F.col(f"p{i}")) for i in range(4)})
    before = _gate(F.col("band"), [F.col(f"s{i}") - F.col(f"p{i}") for i in range(4)])
    return summed.select("conv_id", "band", before.alias("gate"), _gate(F.col("band") + 1, [F.col(f"s{i}") for i in range(4)]).alias("next_gate"), "keys", "chars")


def _gate(band: Column, sums: list[Column]) -> Column:
    return _name(F.concat_ws(":", band.cast("string"), *[s.cast("string") for s in sums]))


def root_name() -> Column:
    return _gate(F.lit(0), [F.lit(0)] * 4)


class DoubleArray:
    """A trie over dense numbers, packed into BASE and CHECK. Words have equal length; -1 ends a shorter one.

    Level by level, the children of a node get a base at which all of their slots are free. A node with several children
    tries the lowest free slots and else the end of the arrays; single children then fill the gaps."""

    TRIES = 64

    def __init__(self, words: np.ndarray):
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self.check[0] = -2  # the root's own slot is taken
        self.first_free, state = 1, np.zeros(len(words), np.int64)
        for symbols in words.T:
            alive = np.flatnonzero(symbols >= 0)
            pairs = np.unique(np.stack([state[alive], symbols[alive]], axis=1), axis=0) if len(alive) else np.zeros((0, 2), np.int64)
            self._place(pairs)
            state[alive] = self.step(state[alive], symbols[alive])

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The n lowest free slots; the arrays grow where there are fewer."""
        found = np.flatnonzero(self.check[self.first_free :] == -1)[:n] + self.first_free
        if len(found) < n:
            old = len(self.check)
            self._grow(old + n - len(found))
            found = np.concatenate([found, np.arange(old, old + n - len(found))])
        if n:
            self.first_free = int(found[0])
        return found

    def _place(self, pairs: np.ndarray) -> None:
        parents, starts, counts = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        for k in np.flatnonzero(counts > 1).tolist():
            symbols = pairs[starts[k] : starts[k] + counts[k], 1]
            offsets = symbols - symbols[0]
            tried = self._free(max(1, self.TRIES // (1 + len(symbols) // 64)))
            self._grow(int(tried[-1] + offsets[-1]) + 1)
            fits = (self.check[tried[:, None] + offsets] == -1).all(axis=1)
            slot = int(tried[fits.argmax()]) if fits.any() else int(np.flatnonzero(self.check != -1)[-1]) + 1
            self._grow(slot + int(offsets[-1]) + 1)
            self.base[parents[k]] = slot - symbols[0]
            self.check[slot + offsets] = parents[k]
        single = np.flatnonzero(counts == 1)
        slots = self._free(len(single))
        self.base[parents[single]] = slots - pairs[starts[single], 1]
        self.check[slots] = parents[single]

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of nodes; -1 where there is none."""
        slot = self.base[state] + symbols
        inside = (slot >= 0) & (slot < len(self.check)) & (state >= 0) & (symbols >= 0)
        slot = np.where(inside, slot, 0)
        return np.where(inside & (self.check[slot] == state), slot, -1)


_NODES = "node string, depth long, parent string, chars long, n long, conv long"


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard's segments, as far as the shard knows them: each once, with its part of the counts."""
    frame = frame.sort_values(["gate", "band"], kind="stable").reset_index(drop=True)
    width, keys = max(map(len, frame["keys"])), frame["keys"].tolist()
    names = pd.Series([list(k) + [None] * (width - len(k)) for k in keys]).tolist()
    columns = [frame["gate"].to_numpy(object), *(np.array([row[i] for row in names], object) for i in range(width))]
    codes, _ = pd.factorize(np.concatenate(columns), use_na_sentinel=True)  # level by level, in order of appearance
    words = codes.reshape(width + 1, len(frame)).T.astype(np.int64)
    packed, state = DoubleArray(words), np.zeros(len(frame), np.int64)
    gates, followers = frame["gate"].tolist(), frame["next_gate"].tolist()
    n, conv, band, chars = frame["n"].to_numpy(np.int64), frame["conv"].to_numpy(np.int64), frame["band"].to_numpy(np.int64), frame["chars"].tolist()
    out, named = [], {}
    for level, symbols in enumerate(words.T):
        state = packed.step(state, symbols)
        alive = np.flatnonzero(state >= 0)
        slots, first, of = np.unique(state[alive], return_index=True, return_inverse=True)
        who = alive[first].tolist()
        if level == 0:
            named = {s: gates[w] for s, w in zip(slots.tolist(), who, strict=True)}
            continue
        least = np.full(len(slots), np.iinfo(np.int64).max)
        np.minimum.at(least, of, conv[alive])
        parents = packed.check[slots].tolist()
        fresh = [followers[w] if level == SEGMENT else hashlib.sha256("".join([gates[w], *keys[w][:level]]).encode()).hexdigest()[:_NAME] for w in who]
        out.append(pd.DataFrame({
            "node": fresh, "depth": band[who] * SEGMENT + level, "parent": [named[p] for p in parents], "chars": [chars[w][level - 1] for w in who],
            "n": np.bincount(of, weights=n[alive], minlength=len(slots)).astype(np.int64), "conv": least,
        }))
        named = dict(zip(slots.tolist(), fresh, strict=True))
    return pd.concat(out)


def nodes(cut: DataFrame, shard: int = SHARD) -> DataFrame:
    """(node, depth, parent, chars, n, conv) of every node but the root: its name, its parent's, the length of its last text,
    its members and the smallest of them."""
    head = F.xxhash64("gate", F.get("keys", F.lit(0)))
    once = cut.groupBy("gate", "next_gate", "band", "keys").agg(F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).withColumn("head", head)
    once = lineage_cut(once)
    shards = max(1, -(-once.count() // shard))
    hot = once.groupBy("head").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max(1, shard // 4)).withColumn("hot", F.lit(True)).select("head", "hot")
    dealt = attach(once, "head", hot, "left", by=["keys"])
    place = F.pmod(F.when(F.col("hot"), F.xxhash64("gate", "keys")).otherwise(F.col("head")), F.lit(shards))
    parts = dealt.withColumn("shard", place).select("shard", "gate", "next_gate", "band", "keys", "chars", "n", "conv").groupBy("shard").applyInPandas(_shard, _NODES)
    return parts.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.sum("n").alias("n"), F.min("conv").alias("conv"))


def chain_totals(chains: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(conv, values) with the sums over all chains that hang on a chain, directly or not, itself included. chains: (conv, up,
    values). After k rounds a sum reaches over 2 ** k generations, and up points as far."""
    now = lineage_cut(chains.select("conv", "up", *values))
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("conv")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        summed = now.join(below, "conv", "left").select("conv", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        further = now.where("up is not null").select(F.col("conv").alias("up"), F.col("up").alias("far"))
        now = lineage_cut(attach(summed, "up", further, "left", by=["conv"]).select("conv", F.col("far").alias("up"), *values))
    return now.select("conv", *values)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(node, hash): SHA-256 of the ids of the conversations that end in a node, in numeric order, comma-joined. ends: (node,
    conv_id). Ids are first joined in pieces of bounded length, which then run through one hash in order, however many."""
    piece = F.floor(F.col("conv_id") / PIECE)
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("node", piece.alias("piece")).agg(text.alias("text")).repartition("node").sortWithinPartitions("node", "piece")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hasher = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node == at:
                    hasher.update(f",{text}".encode())
                    continue
                if hasher is not None:
                    done[0].append(at)
                    done[1].append(hasher.hexdigest())
                at, hasher = node, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], ["node", "hash"])
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([hasher.hexdigest()])], ["node", "hash"])

    return pieces.select("node", "text").mapInArrow(hashed, "node string, hash string")


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row to a node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    See `turns` for nulls, ties and repeated rows (a repeated turn is a turn of its own). Texts are hashed where they are
    read, so very long ones cost nothing later; a conversation may have any number of turns. Other columns don't matter. An
    empty table, or one without any conv_id, gives no rows."""
    ids, steps = rebuilt(conversations)
    cut = segments(steps)
    cut = lineage_cut(cut)
    root = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).where("n > 0")
    root = root.select(root_name().alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("chars"), "n", "conv")
    every = lineage_cut(nodes(cut, shard).unionByName(root))
    children = every.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    over = every.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    known = attach(every, "parent", over, "left", by=["node"]).join(children, "node", "left")
    known = known.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n") - 1) * F.col("chars")})
    known = lineage_cut(known.withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    chains = known.groupBy("conv").agg(F.min_by("parent_conv", "depth").alias("up"), (F.min("depth") - 1).alias("at"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    chains = lineage_cut(chains)
    totals = chain_totals(chains, ("leaf", "saved"))
    hung = chains.select("conv", "up", "at").where("up is not null").join(totals, "conv").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    whole = known.join(hung, ["conv", "depth"], "left").withColumn("height", -F.col("depth"))
    whole = ranges.ranged(whole, ["conv"], ["height"])
    summed = ranges.running(whole, ["conv"], ["height"], {f"all_{v}": ("sum", F.col(v) + F.coalesce(f"more_{v}", F.lit(0))) for v in ("leaf", "saved")})

    last = cut.groupBy("conv_id").agg(F.max_by(F.struct("gate", "next_gate", "keys"), "band").alias("x")).select("conv_id", "x.*")
    end = F.when(F.size("keys") == SEGMENT, F.col("next_gate")).otherwise(_name("gate", F.array_join("keys", "")))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce(end, root_name()).alias("node"), "conv_id")
    hashes = F.coalesce("hash", F.sha2(F.lit(""), 256))
    out = summed.join(member_hashes(ends), "node", "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("all_leaf").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), hashes.alias("ends_sha256"))
