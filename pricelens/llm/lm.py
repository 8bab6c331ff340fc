"""Language-model scores from an Elias-Fano n-gram trie.

The trie has one level for each order. Level 1 is the vocabulary: 64-bit hashes of words in rising order, a word's place is
its number. Level 2 holds the words that follow each word, level 3 those that follow each pair: a level is a monotone
pointer for each entry of the level above (where its followers begin) and the followers' numbers, rising within each
entry, made monotone over the whole level by adding what the entry before ended with. Both sequences are Elias-Fano coded:
low bits packed, high bits in unary with counts to jump by. A follower is found by a search between two pointers, relative
to its context. Beside each entry stands its smoothed log probability, quantised to one byte.

Counting, smoothing and coding run as Spark jobs over shards (an n-gram belongs to the shard of its context's hash, that of a
common context to the shard of its own hash, so that no shard grows with one); shards are files in the folder that all executors share, and scoring maps them into memory,
so that tasks share pages and read only what they touch.

Probabilities are smoothed by a Dirichlet prior: p(w | c) = (n(c w) + m p(w | c')) / (n(c) + m), where c' is the shorter
context; at the base stands the additively smoothed unigram. Every word is followed by a token, as each text has an end, so
the count of a context is that of its n-gram, which its own level holds.
"""

from __future__ import annotations

import functools
import gc
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.common import fresh, shared_folder

#: Levels of the trie.
ORDER = 3
#: Weight of the shorter context, in tokens; the unigram's added count.
PRIOR, ADDED = 4.0, 0.1
#: Tokens that a task counts before it hands counts on, tokens that it scores at once, tokens to a shard, about.
COUNT_TOKENS, SCORE_TOKENS, SHARD_TOKENS = 700_000, 700_000, 3_000_000
#: A context that occurs more often than a shard's tokens divided by this has its entries in all shards.
HOT = 64
#: Bytes to a token, about.
TOKEN_BYTES = 6
#: The end of a text; no word has a space.
END = b" "
#: Log probabilities are quantised to steps of this, in one byte.
STEP = 0.04


# ---- Elias-Fano sequences --------------------------------------------------------------------------------------------


def encode(values: np.ndarray, searched: bool = True) -> dict[str, np.ndarray]:
    """A rising sequence of unsigned numbers: packed low bits, high bits in unary, and the ones and, if it is to be searched,
    the zeros before each word of the latter."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = min(56, max(0, (top // max(1, n)).bit_length() - 1))
    high = (values >> np.uint64(low)).astype(np.int64)
    unary = np.zeros((int(high[-1]) if n else 0) + n + 64 >> 6 << 6, np.uint8)
    unary[high + np.arange(n)] = 1
    words = np.packbits(unary, bitorder="little").view(np.uint64)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
    counts = {"ones": ones} | ({"zeros": 64 * np.arange(len(ones)) - ones} if searched else {})
    counts = {k: v.astype(np.uint32 if len(unary) < 2**32 else np.uint64) for k, v in counts.items()}
    packed = [np.zeros(0, np.uint8)]
    for at in range(0, n if low else 0, 1 << 16):  # whole bytes each time, in bounded memory
        part = values[at : at + (1 << 16)]
        packed.append(np.packbits(((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little"))
    return {"head": np.array([n, low], np.uint64), "words": words, **counts, "lows": np.concatenate([*packed, np.zeros(16, np.uint8)])}


#: The place of the (rank + 1)-th one of a byte, by byte and rank.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int8).reshape(-1)
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select(words: np.ndarray, before: np.ndarray, at: np.ndarray, flip: bool) -> np.ndarray:
    """The place of the (at + 1)-th one (zero, if flip) among the bits of words."""
    word = np.searchsorted(before, at, side="right") - 1
    rest = (at - before[word].astype(np.int64)).astype(np.uint64)
    bits = ~words[word] if flip else words[word]
    # Ones of each byte and those before it, all bytes of a word at once.
    sums = bits - (bits >> np.uint64(1) & np.uint64(0x5555555555555555))
    sums = (sums & np.uint64(0x3333333333333333)) + (sums >> np.uint64(2) & np.uint64(0x3333333333333333))
    sums = (sums + (sums >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    # A byte is passed if the ones up to its end are no more than the rest; the sum of such bytes is the byte to look into.
    passed = ((rest * _EACH | _TOPS) - sums & _TOPS) >> np.uint64(7)
    shift = (passed * _EACH >> np.uint64(56)) << np.uint64(3)
    rest -= (sums << np.uint64(8)) >> shift & np.uint64(0xFF)
    byte = bits >> shift & np.uint64(0xFF)
    return word * 64 + shift.astype(np.int64) + _IN_BYTE[(byte << np.uint64(3) | rest).astype(np.int64)]


def _lows(code: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    low = int(code["head"][1])
    if not low:
        return np.zeros(len(at), np.uint64)
    bit, lows = at * low, code["lows"]
    # Eight bytes from any byte on hold a value, as low is at most 56 and the shift 7.
    raw = np.ndarray((len(lows) - 7,), np.dtype("<u8"), buffer=lows, strides=(1,))[bit >> 3]
    return raw >> (bit & 7).astype(np.uint64) & np.uint64((1 << low) - 1)


def access(code: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The values at these places."""
    high = _select(code["words"], code["ones"], at, False) - at
    return high.astype(np.uint64) << code["head"][1] | _lows(code, at)


def search(code: dict[str, np.ndarray], target: np.ndarray) -> np.ndarray:
    """The place of each target, or -1: values with its high bits stand between two zeros, and are few."""
    n, low = (int(x) for x in code["head"])
    found = np.full(len(target), -1, np.int64)
    if not n:
        return found
    high = (target >> np.uint64(low)).astype(np.int64)
    asked = np.flatnonzero(high < int(code["zeros"][-1]))
    high, rest = high[asked], target[asked] & np.uint64((1 << low) - 1)
    begin = np.where(high > 0, _select(code["words"], code["zeros"], np.maximum(high - 1, 0), True) - np.maximum(high - 1, 0), 0)
    # The bucket's values are the ones up to the next zero; more than the rest of a word has are counted by the zero itself.
    place = begin + high
    last = len(code["words"]) - 1
    bits = ~(code["words"][np.minimum(place >> 6, last)] >> (place & 63).astype(np.uint64))
    run = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    after = begin + run
    beyond = np.flatnonzero((run >= 64 - (place & 63)) | (place >> 6 > last))
    if beyond.size:
        after[beyond] = _select(code["words"], code["zeros"], high[beyond], True) - high[beyond]
    end = after.copy()
    while (active := np.flatnonzero(begin < end)).size:
        middle = (begin[active] + end[active]) >> 1
        less = _lows(code, middle) < rest[active]
        begin[active] = np.where(less, middle + 1, begin[active])
        end[active] = np.where(less, end[active], middle)
    there = np.flatnonzero(begin < after)
    hit = there[_lows(code, begin[there]) == rest[there]]
    found[asked[hit]] = begin[hit]
    return found


# ---- Levels ----------------------------------------------------------------------------------------------------------


def level(parents: np.ndarray, words: np.ndarray) -> dict[str, dict[str, np.ndarray]]:
    """The level of entries (parent, word), sorted: the parents that have followers, where each one's begin, the followers.
    What is added to a parent's followers is one more than the last value before them, so it isn't stored."""
    heads, begins = np.unique(parents, return_index=True)
    begins = np.append(begins, len(parents)).astype(np.uint64)
    ends = words[begins[1:].astype(np.int64) - 1].astype(np.uint64) + np.uint64(1)
    base = np.concatenate(([np.uint64(0)], np.cumsum(ends)[:-1])).astype(np.uint64) if len(heads) else np.zeros(0, np.uint64)
    sizes = np.diff(begins.astype(np.int64))
    return {"heads": encode(heads.astype(np.uint64)), "begins": encode(begins, False), "words": encode(words.astype(np.uint64) + np.repeat(base, sizes))}


def lookup(code: dict, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each entry (parent, word), or -1: successor search relative to the parent's context. Entries with the same
    parent stand together, so that the parent is looked up once."""
    out = np.full(len(parents), -1, np.int64)
    first = np.ones(len(parents), bool)
    first[1:] = parents[1:] != parents[:-1]
    own, back = parents[first], np.cumsum(first) - 1
    head = search(code["heads"], own.astype(np.uint64))
    base, begin, end = (np.zeros(len(own), np.int64) for _ in range(3))
    have = np.flatnonzero(head >= 0)
    begin[have], end[have] = access(code["begins"], head[have]), access(code["begins"], head[have] + 1)
    later = np.flatnonzero(begin > 0)
    base[later] = access(code["words"], begin[later] - 1) + np.uint64(1)
    ask = np.flatnonzero((head >= 0)[back])
    context = back[ask]
    place = search(code["words"], (words[ask] + base[context]).astype(np.uint64))
    inside = (place >= begin[context]) & (place < end[context])  # a word beyond a context's last one is another context's
    out[ask[inside]] = place[inside]
    return out


# ---- Files -----------------------------------------------------------------------------------------------------------


def _flat(code: dict, prefix: str = "") -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for k, v in code.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def write(folder: str, name: str, arrays: dict) -> None:
    """A shard as files of plain arrays; written aside and moved, so that a task that is run again does no harm."""
    store, path = fs.FileSystem.from_uri(folder)
    flat = _flat(arrays)
    head = "\n".join(f"{k} {v.dtype.str} {len(v)}" for k, v in flat.items()).encode().ljust(4096)
    aside = f"{path}/{name}.{os.getpid()}-{os.urandom(4).hex()}"
    store.create_dir(path, recursive=True)
    with store.open_output_stream(aside) as out:
        out.write(head)
        for v in flat.values():
            out.write(v.tobytes())
            out.write(b"\0" * (-v.nbytes % 64))
    store.move(aside, f"{path}/{name}")


def read(folder: str, name: str) -> dict:
    """A shard, mapped into memory where the shared folder is mounted; else its bytes are read, and a task keeps few of them."""
    store, path = fs.FileSystem.from_uri(folder)
    return _mapped(f"{path}/{name}") if isinstance(store, fs.LocalFileSystem) else _loaded(folder, name)


@functools.lru_cache(maxsize=4096)
def _mapped(where: str) -> dict:
    return _arrays(np.memmap(where, np.uint8, "r").view(np.ndarray)) if os.path.exists(where) else {}


@functools.lru_cache(maxsize=16)
def _loaded(folder: str, name: str) -> dict:
    store, path = fs.FileSystem.from_uri(folder)
    where = f"{path}/{name}"
    return {} if store.get_file_info(where).type == fs.FileType.NotFound else _arrays(np.frombuffer(store.open_input_stream(where).read(), np.uint8))


def _arrays(raw: np.ndarray) -> dict:
    out: dict = {}
    at = 4096
    for line in bytes(raw[:4096]).decode().strip().split("\n"):
        key, kind, n = line.split(" ")
        size = np.dtype(kind).itemsize * int(n)
        part = out
        *above, last = key.split(".")
        for k in above:
            part = part.setdefault(k, {})
        part[last] = raw[at : at + size].view(kind)
        at += size + -size % 64
    return out


# ---- Tokens ----------------------------------------------------------------------------------------------------------


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the end last; all tokens of the texts by their places among these, each text's words
    and then the end; and where each text begins."""
    low = pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(low)  # white space at either end leaves an empty word
    of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    coded = pc.dictionary_encode(parts.flatten())
    _, offsets, raw = coded.dictionary.buffers()
    edge = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1] if len(coded.dictionary) else np.zeros(1, np.int64)
    digest, raw, edges = xxhash.xxh64_intdigest, memoryview(raw or b""), edge.tolist()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)), np.uint64, len(edges) - 1)
    codes = coded.indices.to_numpy()
    word = np.diff(edge)[codes] > 0
    starts = np.concatenate(([0], np.cumsum(np.bincount(of[word], minlength=len(texts)) + 1))).astype(np.int64)
    out = np.full(starts[-1], len(hashes), np.int64)
    inner = np.ones(len(out), bool)
    inner[starts[1:] - 1] = False
    out[inner] = codes[word]
    return np.append(hashes, np.uint64(digest(END))), out, starts


def _batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[list[str | None]]:
    """Texts in lists of about so many characters, whatever the batches they come in."""
    texts, chars = [], 0
    for frame in frames:
        for text in frame["text"]:
            texts.append(text)
            chars += len(text or "") + 1
            if chars >= size:
                yield texts
                texts, chars = [], 0
    if texts:
        yield texts


def shard_of(parents: np.ndarray, words: np.ndarray, totals: np.ndarray, shards: int, hot: int) -> np.ndarray:
    """The shard of entries (parent, word): a parent's entries share one, so that its pointers are stored once; those of a parent
    that occurs more than `hot` times (totals) are dealt by word."""
    mixed = parents.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.where(totals > hot, mixed ^ (words.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), mixed)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


class Model:
    """A trained trie in a shared folder; opens its shards where it is used. An entry of a level above 1 is numbered by its
    place in its shard and the shard."""

    def __init__(self, folder: str, shards: int, order: int, hot: int):
        self.folder, self.shards, self.order, self.hot = folder, shards, order, hot
        self.tokens = self.words = 0
        self.starts = [0] * shards

    # A word's shard is the top of its hash, so numbers rise with hashes over all shards.
    def edges(self, hashes: np.ndarray) -> np.ndarray:
        """Where each shard's words begin among sorted hashes."""
        return np.searchsorted(hashes, np.array([(i << 64) // self.shards for i in range(self.shards)] + [2**64 - 1], np.uint64), side="left")

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, -1 if it is new, and its count."""
        own, back = np.unique(hashes, return_inverse=True)
        out, count, edge = np.full(len(own), -1, np.int64), np.zeros(len(own), np.int64), self.edges(own)
        edge[-1] = len(own)
        for k in range(self.shards):
            part, code = own[edge[k] : edge[k + 1]], read(self.folder, f"level1-{k}")
            if len(part) and code:
                at = search(code["hashes"], part)
                out[edge[k] : edge[k + 1]] = np.where(at >= 0, at + self.starts[k], -1)
                count[edge[k] : edge[k + 1]] = np.where(at >= 0, code["counts"][np.maximum(at, 0)], 0)
        return out[back], count[back]

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the unigram probability with added counts."""
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.words + 1)))

    def find(self, order: int, parents: np.ndarray, words: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each entry (parent, word) of a level, given its parent's count, its number (-1 if new), its log10 probability and its count (0 at the top)."""
        number, stored, count = np.full(len(parents), -1, np.int64), np.zeros(len(parents)), np.zeros(len(parents), np.int64)
        ask = np.flatnonzero((parents >= 0) & (words >= 0))
        ask = ask[_order(parents[ask], words[ask])]
        first = np.ones(len(ask), bool)
        first[1:] = (parents[ask[1:]] != parents[ask[:-1]]) | (words[ask[1:]] != words[ask[:-1]])
        one, back = ask[first], np.cumsum(first) - 1  # each entry once, entries of a parent together
        own, shown, seen = np.full(len(one), -1, np.int64), np.zeros(len(one)), np.zeros(len(one), np.int64)
        shard = shard_of(parents[one], words[one], totals[one], self.shards, self.hot)
        turn = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[turn], np.arange(self.shards + 1))
        for k in range(self.shards):
            rows = turn[edge[k] : edge[k + 1]]
            if len(rows) and (code := read(self.folder, f"level{order}-{k}")):
                at = lookup(code, parents[one[rows]], words[one[rows]])
                rows, at = rows[at >= 0], at[at >= 0]
                own[rows], shown[rows] = at * self.shards + k, -STEP * code["quant"][at].astype(float)
                if order < self.order:
                    seen[rows] = code["counts"][at]
        number[ask], stored[ask], count[ask] = own[back], shown[back], seen[back]
        return number, stored, count

    def walk(self, hashes: np.ndarray, tokens: np.ndarray, starts: np.ndarray, order: int) -> dict[str, np.ndarray]:
        """Of each token: number and count, base (its unigram log10 probability), best (that by n-grams up to order), and as
        context of the next order the entry of the last `order` tokens before it, and that entry's count as total."""
        number, count = self.numbers(hashes)
        number, count, base = number[tokens], count[tokens], self.base(count)[tokens]
        place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
        before = lambda x, k, none: np.where(place >= k, np.roll(x, 1), none)
        best, context, total = base.copy(), before(number, 1, -1), before(count, 1, 0)
        for k in range(2, order + 1):
            found, stored, own = self.find(k, context, number, total)
            best = np.where(found >= 0, stored, best + np.log10(PRIOR / (total + PRIOR)))
            context, total = before(found, k, -1), before(own, k, 0)
        return {"number": number, "count": count, "base": base, "best": best, "context": context, "total": total}


# ---- Training --------------------------------------------------------------------------------------------------------


def _order(*keys: np.ndarray) -> np.ndarray:
    """An order by these numbers, the first one first; two are sorted as one where they fit into 63 bits."""
    if len(keys) == 2 and len(keys[0]):
        high, low = (int(k.max()).bit_length() for k in keys)
        if high + low < 64:
            keys = ((keys[0].astype(np.int64) << low) | keys[1].astype(np.int64),)
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _merge(parts: list[tuple[np.ndarray, ...]], keys: int) -> tuple[np.ndarray, ...]:
    """Rows with equal keys (the first arrays) made one: counts (the next array) are summed, of the rest any stays; sorted."""
    arrays = [np.concatenate(x) for x in zip(*parts, strict=True)]
    turn = _order(*arrays[:keys])
    arrays = [a[turn] for a in arrays]
    new = np.ones(len(turn), bool)
    new[1:] = np.any([a[1:] != a[:-1] for a in arrays[:keys]], axis=0)
    first = np.flatnonzero(new)
    return (*[a[first] for a in arrays[:keys]], np.add.reduceat(arrays[keys], first), *[a[first] for a in arrays[keys + 1 :]])


def _fit(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes that hold the largest."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, the first one sorted, compressed: of the first the differences; each in few bytes, and those of
    one rank together, as the high ones hardly vary."""
    columns = tuple(_fit(c) for c in (np.diff(columns[0].view(np.uint64), prepend=np.uint64(0)), *columns[1:]))
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    head = " ".join([str(len(columns[0])), *[c.dtype.str for c in columns]]).encode()
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    at = 4 + int.from_bytes(blob[:4], "little")
    n, *kinds = blob[4:at].decode().split(" ")
    flat, n, at, columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at:]), np.uint8), int(n), 0, []
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        columns.append(np.ascontiguousarray(flat[at : at + size].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return (np.cumsum(columns[0], dtype=np.uint64), *columns[1:])


def _heads(parents: np.ndarray) -> np.ndarray:
    """Whether an entry is the first of its parent."""
    out = np.ones(len(parents), bool)
    out[1:] = parents[1:] != parents[:-1]
    return out


def train(docs: DataFrame, order: int = ORDER, shard_tokens: int = SHARD_TOKENS) -> Model:
    """A trie over all tokens of the documents given, written below the shared folder.

    Null and empty texts count as an end alone. An empty table gives a model that knows nothing. For each level the counts
    of a task are packed by shard, shuffled, and merged and coded by shard; nothing but a row to a shard comes to the driver."""
    texts = docs.select("text")
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + TOKEN_BYTES)).first()[0] or 0
    model = Model(shared_folder(docs.sparkSession), max(1, -(-size // (TOKEN_BYTES * shard_tokens))), order, shard_tokens // HOT)
    for k in range(1, order + 1):
        counted = texts.mapInPandas(functools.partial(_count, model, k), "shard int, blob binary")
        coded = counted.repartition(model.shards, "shard").groupBy("shard").applyInPandas(_coder(model, k), "shard int, entries long, tokens long")
        made = {r.shard: r for r in coded.collect()}
        del counted, coded
        forget_shuffles(docs.sparkSession)
        if k == 1:
            words = [made[i].entries if i in made else 0 for i in range(model.shards)]
            model.starts = [sum(words[:i]) for i in range(model.shards)]
            model.words, model.tokens = sum(words), sum(r.tokens for r in made.values())
    return model


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more: it does so when the driver collects them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _count(model: Model, order: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed counts by shard: of words; or of entries, with the probability of their word in the shorter context."""
    for part in _batches(frames, COUNT_TOKENS * TOKEN_BYTES):
        hashes, tokens, starts = _tokens(part)
        if order == 1:
            n = np.bincount(tokens, minlength=len(hashes))
            own, n = _merge([(hashes[n > 0], n[n > 0])], 1)
            edge = model.edges(own)
            edge[-1] = len(own)
            blobs = [(k, _pack(own[a:b], n[a:b].astype(np.int32))) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        else:
            at = model.walk(hashes, tokens, starts, order - 1)
            own = np.flatnonzero(at["context"] >= 0)
            rows = _merge([(at["context"][own], at["number"][own], np.ones(len(own), np.int32), at["total"][own], at["best"][own])], 2)
            shard = shard_of(rows[0], rows[1], rows[3], model.shards, model.hot)
            turn = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[turn], np.arange(model.shards + 1))
            quantised = np.minimum(255, np.round(-rows[4] / STEP)).astype(np.uint8)
            blobs = []
            for k in range(model.shards):
                if len(t := turn[edge[k] : edge[k + 1]]):
                    # The parent's count stands at its first entry only.
                    blobs.append((k, _pack(rows[0][t].astype(np.uint64), rows[1][t], rows[2][t], rows[3][t] * _heads(rows[0][t]), quantised[t])))
        yield pd.DataFrame(blobs, columns=["shard", "blob"])


def _coder(model: Model, order: int):
    def code(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _code(model, order, key, frame)

    return code


def _code(model: Model, order: int, key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Writes a level's shard from its packed counts."""
    shard, parts = int(key[0]), [_unpack(b) for b in frame["blob"]]
    if order == 1:
        hashes, n = _merge([(p[0], p[1].astype(np.int64)) for p in parts], 1)
        write(model.folder, f"level1-{shard}", {"hashes": encode(hashes), "counts": _fit(n)})
        return pd.DataFrame({"shard": [shard], "entries": [len(hashes)], "tokens": [int(n.sum())]})
    parts = [(p[0], p[1], p[2].astype(np.int64), p[3][_heads(p[0])][np.cumsum(_heads(p[0])) - 1], p[4]) for p in parts]
    parents, words, n, total, shorter = _merge(parts, 2)
    p = (n + PRIOR * 10.0 ** (-STEP * shorter)) / (total + PRIOR)
    arrays = level(parents, words) | {"quant": np.minimum(255, np.round(-np.log10(p) / STEP)).astype(np.uint8)}
    write(model.folder, f"level{order}-{shard}", arrays | ({"counts": _fit(n)} if order < model.order else {}))
    return pd.DataFrame({"shard": [shard], "entries": [len(words)], "tokens": [int(n.sum())]})


# ---- Scoring ---------------------------------------------------------------------------------------------------------


def in_training(column: str = "doc_id"):
    """Documents from which the query's model learns: all but those whose id's CRC-32 is divisible by 10."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 10 != 0, F.lit(True))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with n_tokens, n_known (tokens seen in training), base_score (unigram) and score (the trie's log10
    probability of the text). A null or empty text is an end alone; a very long one is scored whole. Each text is scored by
    itself, so repeated rows and ties of doc_id agree. Existing columns of these names are replaced."""

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for some in _batches(iter([pd.DataFrame({"text": texts})]), SCORE_TOKENS * TOKEN_BYTES):
                hashes, tokens, starts = _tokens(some)
                at = model.walk(hashes, tokens, starts, model.order)
                total = lambda x: np.add.reduceat(x, starts[:-1])
                parts.append(pd.DataFrame({"n_tokens": np.diff(starts), "n_known": total((at["count"] > 0).astype(np.int64)), "base_score": total(at["base"]), "score": total(at["best"])}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_tokens": [], "n_known": [], "base_score": [], "score": []})

    docs = docs.drop("n_tokens", "n_known", "base_score", "score")
    found = fresh(docs.columns, "found")[0]
    return docs.withColumn(found, judge("text")).select(*docs.columns, f"{found}.*")
