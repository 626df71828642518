"""Operator 2: scores of documents under a probabilistic suffix tree.

Symbols are the tokens of the training documents and one more for all unknown tokens. The
tree's contexts are the up to DEPTH tokens before a symbol, the end token standing for what
is before a text. A context is kept if it occurs at least twice and its next-symbol
distribution diverges from that of its suffix: if the counts, each occurrence left out in
turn, predict the training data better than the suffix does, by GAIN nats. In a kept
context, symbols have their counts (in one longer than a token, those seen at least twice),
and as much weight as there are different symbols goes to the suffix's distribution, down to
the root's discounted token shares; so each is a proper distribution. A text is scored token
by token in the state of its longest kept suffix.

The tree grows with the corpus, so it is never in one place. Documents are encoded in chunks
of about BLOCK bytes, each with its own dictionary, and kept by chunk. A word gets a number
that no other word has, in order of counts, so that the number tells the count. For every
depth, a chunk sends its distinct (context, next) cells to buckets of contexts, all as such
numbers, with the counts from which the suffix's chance follows; a bucket adds up the counts
of all chunks, tests the contexts, and sends each chunk the numbers of the cells that it
asked for. Words and contexts are told apart by their numbers alone, and chances are computed
where they are needed, so nothing is rounded. What is sent is bounded by a chunk's own text,
a bucket by the number of buckets. Contexts that make up more than HEAVY of all tokens are
cut by their symbols, into parts of about that weight; only their sums, of fewer than
1 / HEAVY contexts, are gathered and broadcast.

Chunks and answers are persisted until the session ends or clears its cache.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permitlake.llm.common import pick, remainder, small_batches

FOLDS = 7
HELD_OUT = 2
DEPTH = 2
GAIN = 3.0
HEAVY = 1e-5
BLOCK = 8 << 20  # bytes of text in a chunk, about
WORD_BITS = 48  # of a word's hash, besides those that its bucket stands for
LEAST = (1, 2)  # count from which a symbol has a share of its own, by depth
TOP = 1 << 17  # so many words at most are numbered without gaps
LEVEL = 8  # contexts of a token are cut where it would be more than this part of a bucket

_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- numbers on their way ---------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, in byte planes and compressed.

    Each has as many bytes for a number as its largest one needs.
    """
    import zstandard

    head, planes = [len(arrays)], []
    for array in arrays:
        top = int(array.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        narrow = np.ascontiguousarray(array.astype(f"<u{width}"))
        head += [len(array), width]
        planes.append(narrow.view(np.uint8).reshape(len(array), width).T.tobytes())
    first = np.array(head, "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(first + b"".join(planes))


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays, as unsigned numbers of their widths."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    (n_arrays,) = np.frombuffer(raw, "<i8", 1).tolist()
    head = np.frombuffer(raw, "<i8", 2 * n_arrays, 8).tolist()
    at, arrays = 8 + 16 * n_arrays, []
    for n, width in zip(head[::2], head[1::2], strict=True):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        arrays.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n))
        at += n * width
    return arrays


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """The places at which a row differs from the one before it; the first one does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _steps(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Numbers that rise within runs, as differences there; `new` are the runs' first places."""
    return np.where(new, values, values - np.concatenate([values[:1], values[:-1]]))


def _climbed(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The numbers again."""
    steps = steps.astype(np.uint64)
    total = np.cumsum(steps, dtype=np.uint64)
    return total - _spread((total - steps)[new], new)


def _spread(firsts: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The value of each run at all of its places."""
    return np.repeat(firsts, np.diff(np.flatnonzero(new), append=len(new)))


def _top(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(64 - bits)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, not symmetric."""
    value = (a ^ (b + _MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * _MIX
    return value ^ (value >> np.uint64(29))


# --- chunks -----------------------------------------------------------------------------


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words each text has, all words' numbers in order of first places, from 1, and
    the distinct words.

    Arrow's ASCII functions take bytes as bytes.lower() and bytes.split() do, but have an empty
    word where a text begins or ends with a space.
    """
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    flat = lists.flatten().dictionary_encode()
    words, tokens = flat.dictionary.view(pa.binary()).to_numpy(False).tolist(), flat.indices.to_numpy()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" not in words:
        return lengths, tokens + np.int32(1), words
    empty = words.index(b"")
    del words[empty]
    real = tokens != empty
    upto, ends = np.concatenate([[0], np.cumsum(real)]), np.cumsum(lengths)
    tokens = tokens[real]
    return upto[ends] - upto[ends - lengths], tokens + (tokens < empty), words


def encode(documents: DataFrame) -> DataFrame:
    """Chunks of documents: chunk, ids, hashes (of the dictionary's words), docs (lengths and
    which are learned from), tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(small_batches(batches, "text", BLOCK)):
            counts, tokens, words = _split(batch.column(1))
            learns = np.array(batch.column(2).to_pylist(), np.int64)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], "<u8")
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([part + number], pa.int64()),
                "ids": pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)),
                "hashes": pa.array([hashes.tobytes()], pa.binary()),
                "docs": pa.array([packed(counts, learns)], pa.binary()),
                "tokens": pa.array([packed(tokens)], pa.binary()),
            })
        pa.default_memory_pool().release_unused()  # the worker goes on without Arrow's functions

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", "learns").mapInArrow(
        run, f"chunk bigint, ids array<{kind}>, hashes binary, docs binary, tokens binary"
    )


class Chunk:
    """A chunk's positions: symbol, the tokens before it, and whether the text is learned from.

    Tokens are numbers in the chunk's dictionary until they are laid out, then what `named` gives
    for these. The first two places of every text stand for its beginning and are no positions
    themselves.
    """

    def __init__(self, row) -> None:
        self.hashes = np.concatenate([np.ones(1, np.uint64), np.frombuffer(row["hashes"], "<u8")])
        lengths, learns = unpacked(row["docs"])
        self.lengths, self.learning = lengths.astype(np.int64), learns.astype(bool)
        (self.tokens,) = unpacked(row["tokens"])

    def word_counts(self) -> np.ndarray:
        learns = np.repeat(self.learning, self.lengths)
        counts = np.bincount(self.tokens[learns], minlength=len(self.hashes))
        counts[0] = self.learning.sum()  # the end token
        return counts

    def lay_out(self, named: np.ndarray) -> None:
        sizes = self.lengths + DEPTH + 1
        starts = np.cumsum(sizes) - sizes
        stream = np.full(int(sizes.sum()), named[0], np.int32)
        inside = np.ones(len(stream), bool)
        for k in range(DEPTH):
            inside[starts + k] = False
        at = np.flatnonzero(inside)
        inside[starts + sizes - 1] = False
        stream[inside] = named[self.tokens]
        del self.tokens
        self.symbol = stream[at]
        self.before = [stream[at - k] for k in range(1, DEPTH + 1)]
        self.learns = np.repeat(self.learning, self.lengths + 1)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1


@dataclasses.dataclass
class Totals:
    """What is known of all training tokens: their number, distinct ones, the discount."""

    tokens: int
    distinct: int
    discount: float

    def root(self, counts: np.ndarray) -> np.ndarray:
        """The root's chance of symbols with these counts; 0 stands for the unknown one."""
        if not self.tokens:
            return np.ones(len(counts))
        spread = self.discount * self.distinct / self.tokens / (self.distinct + 1)
        return np.maximum(counts - self.discount, 0) / self.tokens + spread


@dataclasses.dataclass
class Numbering:
    """Words' numbers, from 1, frequent ones first, so that a number tells its word's count.

    Words of `limit` occurrences and more (fewer than `top`) have the first numbers, without
    gaps: for each such count and bucket there is a range. Below, each count has a range, in
    which the buckets take turns, with gaps where a bucket has fewer words than another. For N
    tokens there are at most `top` + sqrt(2 N) ranges, as counts that occur add up to N at most.
    """

    n_buckets: int
    limit: int
    edges: np.ndarray  # the ranges' first numbers, rising
    counts: np.ndarray  # their counts, falling
    slots: np.ndarray  # their places among the counts, times buckets, plus the bucket for frequent ones

    @classmethod
    def of(cls, n_buckets: int, limit: int, frequent: np.ndarray, rare: np.ndarray) -> Numbering:
        """`frequent` has rows of count, bucket, words in it; `rare` rows of count, most words in a
        bucket."""
        frequent = frequent[np.lexsort((frequent[:, 1], -frequent[:, 0]))]
        rare = rare[np.argsort(-rare[:, 0])]
        counts = np.concatenate([frequent[:, 0], rare[:, 0]])
        bucket = np.concatenate([frequent[:, 1], np.zeros(len(rare), np.int64)])
        room = np.concatenate([frequent[:, 2], rare[:, 1] * n_buckets]).astype(np.uint64)
        slots = (np.cumsum(_changes([counts])) - 1) * n_buckets + bucket
        return cls(n_buckets, limit, np.cumsum(room, dtype=np.uint64) - room + np.uint64(1), counts, slots)

    def numbers(self, total: np.ndarray, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Of words with these counts and places among those of their bucket with that count."""
        each = self.counts[_changes([self.counts])]
        slot = np.searchsorted(-each, -total) * self.n_buckets
        dense = total >= self.limit
        at = np.searchsorted(self.slots, slot + np.where(dense, bucket, 0))
        within = np.where(dense, place, place * self.n_buckets + bucket)
        return self.edges[at] + within.astype(np.uint64)

    def told(self, numbers: np.ndarray) -> np.ndarray:
        """The counts that numbers tell, 0 for the number 0."""
        if not len(self.edges):
            return np.zeros(len(numbers), np.int64)
        at = np.searchsorted(self.edges, numbers, "right") - 1
        return np.where(at < 0, 0, self.counts[at])


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which the keys rise, equal ones as they came if the keys leave bits for their
    places, and the keys in it."""
    places = max(len(keys) - 1, 0).bit_length()
    if int(keys.max(initial=0)).bit_length() + places > 64:
        order = np.argsort(keys)
        return order, keys[order]
    # Numbers that end in their places are sorted faster than places by keys.
    both = keys.astype(np.uint64) << np.uint64(places)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << places) - 1)).view(np.int64)
    both >>= np.uint64(places)
    return order, both


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each distinct key, in their order, and every key's rank."""
    order, sorted_ = _sorted(keys)
    new = _changes([sorted_])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row that only equal rows share, in the order of the rows."""
    key, bits = np.zeros(len(columns[0]), np.uint64), 0
    for column in columns:
        own = int(column.max(initial=0)).bit_length()
        if bits + own > 64:  # ranks need fewer
            key = _grouped(key)[1].astype(np.uint64)
            bits = int(key.max(initial=0)).bit_length()
        if bits + own > 64:
            column = _grouped(column)[1]
            own = int(column.max(initial=0)).bit_length()
        key, bits = key << np.uint64(own) | column.astype(np.uint64), bits + own
    return key


def _dealt(buckets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order in which each bucket's entries stand together, and where."""
    order, sorted_ = _sorted(buckets)
    edges = np.append(np.flatnonzero(_changes([sorted_])), len(sorted_))
    return order, [
        (int(sorted_[a]), slice(int(a), int(b))) for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((_mixed(hashes, hashes) >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)


@dataclasses.dataclass
class Question:
    """The cells of a chunk at one depth, bucket by bucket, each context's cells together.

    `tokens` (nearest first), `size` (cells), `heavy` and `above` (for each shorter context:
    what it counts in all, and its kinds) are the contexts'; `symbol`, `n` and `own` (its count
    after each shorter context) the cells'.
    """

    parts: list[tuple[int, slice, slice]]  # bucket, contexts, cells
    tokens: list[np.ndarray]
    size: np.ndarray
    heavy: np.ndarray
    above: list[tuple[np.ndarray, np.ndarray]]
    symbol: np.ndarray
    n: np.ndarray
    own: list[np.ndarray]

    def messages(self) -> Iterator[tuple[int, bytes]]:
        for bucket, contexts, cells in self.parts:
            arrays, columns = [], []
            for token in self.tokens:
                new = _changes(columns) if columns else np.arange(contexts.stop - contexts.start) == 0
                columns.append(token[contexts])
                arrays.append(_steps(columns[-1], new))
            # What belongs to a shorter context travels where that changes.
            for depth, pair in enumerate(self.above, 1):
                new = _changes(columns[:depth])
                arrays += [values[contexts][new] for values in pair]
            size = self.size[contexts]
            opens = np.zeros(cells.stop - cells.start, bool)
            opens[np.cumsum(size) - size] = True
            symbol = self.symbol[cells]
            arrays += [size, self.heavy[contexts], _steps(symbol, opens), self.n[cells]]
            # A symbol's count after a shorter context travels once.
            for depth, own in enumerate(self.own, 1):
                first, _ = _after(columns[:depth], size, symbol)
                arrays.append(own[cells][first])
            yield bucket, packed(*arrays)


def _after(tokens: list[np.ndarray], size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_grouped for the cells' symbols after shorter contexts, in rising order of these."""
    shorter = np.cumsum(_changes(tokens))
    return _grouped(_keys([np.repeat(shorter, size), symbol]))


def understood(data: bytes, depth: int) -> dict[str, list[np.ndarray]]:
    """A message's arrays again, those of shorter contexts at every context; `depth` from 0."""
    arrays = iter(unpacked(data))
    tokens: list[np.ndarray] = []
    for _ in range(depth + 1):
        steps = next(arrays)
        tokens.append(_climbed(steps, _changes(tokens) if tokens else np.arange(len(steps)) == 0))
    above = []
    for k in range(1, depth + 1):
        new = _changes(tokens[:k])
        above += [_spread(next(arrays).astype(np.int64), new) for _ in range(2)]
    size, heavy, steps = next(arrays).astype(np.int64), next(arrays).astype(bool), next(arrays)
    opens = np.zeros(len(steps), bool)
    opens[np.cumsum(size) - size] = True
    symbol, n = _climbed(steps, opens), next(arrays).astype(np.int64)
    own = [next(arrays).astype(np.int64)[_after(tokens[:k], size, symbol)[1]] for k in range(1, depth + 1)]
    return {"tokens": tokens, "above": above, "context": [size, heavy], "cell": [symbol, n, *own]}


class Walk:
    """A chunk on its way down the tree: what its symbols have in the states found so far.

    Tokens are ranks in the order of the words' numbers; words that are not learned from share 0.
    """

    def __init__(
        self, chunk: Chunk, counts: np.ndarray, numbers: np.ndarray, totals: Totals, numbering: Numbering
    ) -> None:
        self.chunk, self.totals, self.numbering = chunk, totals, numbering
        first, rank = _grouped(np.where(counts > 0, numbers, np.uint64(0)))
        if len(first) and counts[first[0]] > 0:  # 0 is no word's
            first, rank = np.concatenate([first[:1], first]), rank + 1
        self.counts, self.numbers, self.hashes = counts[first], numbers[first], chunk.hashes[first]
        self.counts[:1] = self.numbers[:1] = 0
        chunk.lay_out(rank.astype(np.int32))
        self.known = chunk.symbol > 0
        # By depth: the positions' cells, and what these count; the last cell stands for none.
        self.levels: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.depth = 0
        # How often the context of the next depth occurs in training; below 2 it is not kept.
        self.times = self.counts[chunk.before[0]]
        self.alive = self.times >= 2

    def find(self) -> None:
        """The cells of the next depth, and which position has which, bucket by bucket.

        Symbols that cannot have been seen twice after the context share the symbol 0.
        """
        chunk, n_buckets, tokens = self.chunk, self.numbering.n_buckets, max(self.totals.tokens, 1)
        self.at = at = np.flatnonzero(self.alive)
        before = [b[at] for b in chunk.before[: self.depth + 1]]
        group = before[0] if self.depth == 0 else _grouped(_keys(before))[1]
        symbol = np.where(self.known[at], chunk.symbol[at], np.int32(0))
        by_key, key = _sorted(_keys([group, symbol]))
        new = _changes([key])
        first = by_key[new]
        self.symbol, opens = symbol[first], _changes([group[first]])
        del group, symbol, key
        heads = first[opens]
        self.contexts = [b[heads] for b in before]
        del before
        # Contexts go by their nearest token, so that what they share travels once; those of a
        # token that many texts have are cut by their other tokens. A heavy context is cut by its
        # symbols into as many parts as it has the weight for.
        share = self.counts[self.contexts[0]] * (LEVEL * n_buckets / tokens)
        rest = np.zeros(len(heads), np.uint64)
        for b in self.contexts[1:]:
            rest = _mixed(self.hashes[b], rest)
        rest %= share.astype(np.uint64) + np.uint64(1)
        near = self.hashes[self.contexts[0]]
        cuts = (self.times[at[heads]] / max(HEAVY * self.totals.tokens, 1)).astype(np.uint64)
        context = np.cumsum(opens, dtype=np.int32) - np.int32(1)
        bucket = _bucket(_mixed(near, _mixed(rest, np.uint64(0))), n_buckets)[context]
        cut = np.flatnonzero((cuts > 0)[context])
        of, word = context[cut], self.symbol[cut]
        part = np.where(word > 0, self.hashes[word] >> np.uint64(11), np.uint64(0)) % (cuts[of] + np.uint64(1))
        bucket[cut] = _bucket(_mixed(near[of], _mixed(rest[of], part)), n_buckets)
        del cut, of, word, part, rest, near
        order, self.parts = _dealt(bucket)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.cell = np.empty(len(at), np.int32)
        self.cell[by_key] = _spread(place, new)
        del bucket, place, by_key, new
        self.symbol, self.one = self.symbol[order], at[first[order]]
        self.group = context[order]
        opens = _changes([self.group])
        opens[[p.start for _, p in self.parts]] = True
        self.context, self.heads = np.cumsum(opens, dtype=np.int32) - np.int32(1), np.flatnonzero(opens)
        self.heavy = (cuts > 0)[self.group[self.heads]]

    def named(self, which: np.ndarray | slice) -> list[np.ndarray]:
        """The numbers of some contexts' tokens."""
        group = self.group[self.heads[which]]
        return [self.numbers[b[group]] for b in self.contexts]

    def ask(self) -> Question:
        """The cells that were found, as they are sent."""
        chunk, heads, one = self.chunk, self.heads, self.one
        edges = np.searchsorted(heads, [p.start for _, p in self.parts] + [len(one)])
        counts = [(held[one], *values) for held, values in self.levels]
        return Question(
            [(b, slice(i, j), p) for (b, p), i, j in zip(self.parts, edges[:-1], edges[1:], strict=True)],
            self.named(slice(None)), np.diff(heads, append=len(one)), self.heavy,
            [(counted[of[heads]], kinds[of[heads]]) for of, _, counted, kinds in counts],
            self.numbers[self.symbol],
            np.bincount(self.cell[chunk.learns[self.at]], minlength=len(one)),
            [np.where(self.symbol > 0, own[of], 0) for of, own, _, _ in counts],
        )

    def step(self, n: np.ndarray, counted: np.ndarray, kinds: np.ndarray) -> None:
        """Go down one depth with the counts of the cells and, for each context, what it counts
        in all and its kinds, which is 0 where it is not kept."""
        # A cell of unnamed symbols counts them all; none of them has been seen twice.
        n = np.where(self.symbol > 0, n, 0)
        counted, kinds = counted[self.context], kinds[self.context]
        del self.symbol, self.one, self.group, self.context, self.heads, self.contexts
        own = np.where((n >= LEAST[self.depth]) & (kinds > 0), n, 0)
        held = np.full(len(self.alive), len(n), np.int32)
        held[self.at] = self.cell
        self.levels.append((held, [np.append(v, 0) for v in (own, counted, kinds)]))
        self.depth += 1
        if self.depth < DEPTH:
            # What a shorter context has seen too seldom for a share, so has every longer one.
            self.known[self.at] = (n >= LEAST[self.depth])[self.cell]
            # After a context with one symbol only, so has every longer one.
            self.alive[self.at] = (kinds != 1)[self.cell]
            # The longer context's count is that of the cell one position earlier, whose
            # symbol is now the nearest token of the context.
            times = np.zeros(len(self.alive) + 1, np.int64)
            times[1:][self.at] = n[self.cell]
            # Before the first symbol there are only beginnings, as often as texts.
            times[self.chunk.starts] = self.times[self.chunk.starts]
            self.times = times[:-1]
            self.alive &= self.times >= 2
        del self.at, self.cell

    def chances(self) -> np.ndarray:
        """The chances of all symbols in the states found."""
        chance = self.totals.root(self.counts)[self.chunk.symbol]
        for held, values in self.levels:
            share, left = lowering(*values)
            chance *= left[held]
            chance += share[held]
        return chance


def lowering(own, counted, kinds):
    """What symbols have in a context, and the part that they get of their chance in its suffix;
    kinds and own are 0 where it is not kept."""
    below = np.maximum(counted + kinds, 1)
    return own / below, np.where(kinds > 0, kinds / below, 1.0)


# --- buckets ----------------------------------------------------------------------------


def merge_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds up the counts of one bucket's words and answers every chunk in its own order.

    Answers: a word's count, and its place among the bucket's words of that count. The first
    row tells how many words there are of each count.
    """
    asked = [unpacked(d) for d in rows["data"]]
    words = np.concatenate([np.cumsum(w, dtype=np.uint64) for w, _ in asked])
    first, rank = _grouped(words)
    total = np.bincount(rank, np.concatenate([n for _, n in asked]), len(first)).astype(np.int64)
    order = np.argsort(-total, kind="stable")
    new = _changes([total[order]])
    at = np.arange(len(order))
    place = np.empty(len(order), np.int64)
    place[order] = at - _spread(at[new], new)
    cuts = np.cumsum([len(w) for w, _ in asked])[:-1]
    out = pd.DataFrame({
        "chunk": rows["chunk"].to_numpy(), "bucket": rows["bucket"].to_numpy(),
        "data": [packed(total[part], place[part]) for part in np.split(rank, cuts)],
        "tokens": 0, "counts": None, "words": None,
    })
    out["tokens"] = [int(total.sum()), *[0] * (len(out) - 1)]
    none = [None] * (len(out) - 1)
    out["counts"] = pd.Series([total[order][new].tolist(), *none], dtype=object)
    out["words"] = pd.Series([np.diff(at[new], append=len(at)).tolist(), *none], dtype=object)
    return out


def gains(n, chance, named, number, size: int) -> tuple[np.ndarray, ...]:
    """Sums over the seen cells of each context: all counts, different symbols, counts of
    two and more, and the told part of the gain. A cell that is not `named` has symbols seen
    once, as many as it counts."""
    seen = n > 0
    c, n, chance, named = number[seen], n[seen].astype(float), chance[seen], named[seen]
    many = named & (n >= 2)

    def add(values):
        return np.bincount(c, values, size)

    logs = np.log(np.maximum(n - 1, 1)) - np.log(chance)
    return (
        add(n), add(np.where(named, 1.0, n)), add(np.where(many, n, 0)),
        add(np.where(many, n * logs, 0)),
    )


def keeps(total, kinds, repeated, told, least: int) -> np.ndarray:
    """The test: does a context predict better than its suffix, each occurrence left out?

    A symbol seen n times, two or more, has then n - 1 of counted - 1 + kinds; one seen once
    has only what the smoothing leaves to the suffix.
    """
    counted = total if least == 1 else repeated
    below = np.maximum(counted - 1 + kinds, 1)
    once = (total - repeated) * np.log(np.maximum(kinds, 1) / below)
    return (repeated >= 2) & (told - repeated * np.log(below) + once >= GAIN)


SUMS = ("total", "kinds", "repeated", "told")


def merge_cells(rows: pd.DataFrame, depth: int, totals: Totals, numbering: Numbering) -> pd.DataFrame:
    """Adds up one bucket's cells, tests its contexts, and answers every chunk in its order.

    Answers: the counts of the cells, and, for each context, what it counts in all and its
    kinds, 0 if it is not kept. Heavy contexts have cells elsewhere; their sums go on as rows
    of their own.
    """
    least = LEAST[depth]
    asked = [understood(data, depth) for data in rows["data"]]

    def joined(name: str) -> list[np.ndarray]:
        return [np.concatenate(a) for a in zip(*[q[name] for q in asked], strict=True)]

    tokens, above, (size, heavy) = joined("tokens"), joined("above"), joined("context")
    symbol, n, *own = joined("cell")
    head, context = _grouped(_keys(tokens))
    first, rank = _grouped(_keys([np.repeat(context, size), symbol]))
    of = np.repeat(np.arange(len(size)), size)[first]
    total = np.bincount(rank, n, len(first)).astype(np.int64)
    symbol = symbol[first]
    chance = totals.root(numbering.told(symbol))
    for k in range(depth):
        share, left = lowering(own[k][first], above[2 * k][of], above[2 * k + 1][of])
        chance = share + left * chance
    sums = gains(total, chance, symbol > 0, context[of], len(head))
    held = heavy[head]
    kept = keeps(*sums, least) & ~held
    counted = np.where(kept, sums[0 if least == 1 else 2], 0).astype(np.int64)
    kinds = np.where(kept, sums[1], 0).astype(np.int64)
    answers = [
        packed(total[cells], counted[contexts], kinds[contexts])
        for cells, contexts in zip(
            np.split(rank, np.cumsum([len(q["cell"][0]) for q in asked])[:-1]),
            np.split(context, np.cumsum([len(q["tokens"][0]) for q in asked])[:-1]), strict=True,
        )
    ]
    out = pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "data": answers})
    out["context"] = None
    some = np.flatnonzero(held)
    extra = pd.DataFrame({
        "chunk": np.full(len(some), -1 - rows["bucket"].iloc[0]), "bucket": rows["bucket"].iloc[0], "data": None,
        "context": np.stack([t[head[some]] for t in tokens], 1).astype(np.int64).tolist(),
        **{name: sums[i][some] for i, name in enumerate(SUMS)},
    })
    out = out.assign(**dict.fromkeys(SUMS, 0.0))
    return pd.concat([out, extra]) if len(some) else out


def _merger(depth: int, totals: Totals, numbering: Numbering) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: merge_cells(rows, depth, totals, numbering)


_UP = "chunk bigint, bucket bigint, data binary"
_SUMS = "context array<bigint>, total double, kinds double, repeated double, told double"


def _word_order(chunk: Chunk, n_buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The chunk's words by bucket and, within it, by hash."""
    by_hash = np.argsort(chunk.hashes)
    order, parts = _dealt(_bucket(chunk.hashes[by_hash], n_buckets))
    return by_hash[order], parts


def score_documents(documents: DataFrame, top: int = TOP) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.

    Tokens are the runs of non-space bytes of the ASCII-lower-cased text, then an end token.
    Documents whose crc32(doc_id) modulo FOLDS is HELD_OUT are not learned from. A null or
    empty text is the end token alone. A null id is learned from, a repeated document is
    learned from and scored each time. Without training documents no token is known, and the
    one symbol that is left has chance one. `top` changes what is sent, not the scores.
    """
    spark = documents.sparkSession
    docs = pick(documents, "doc_id", "text").withColumn(
        "learns", (remainder("doc_id", FOLDS) != HELD_OUT).cast("int")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Kept by chunk in the executors' memory, or on their disks where that is full; what is
    # lost with one of them is computed again.
    chunks = encode(docs).repartition(n_parts, "chunk").persist(StorageLevel.MEMORY_AND_DISK)
    n_buckets = max(8, -(-chunks.count() // 2))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                order, parts = _word_order(chunk, n_buckets)
                words, n = _top(chunk.hashes[order], WORD_BITS), chunk.word_counts()[order]
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()),
                    "bucket": pa.array([bucket for bucket, _ in parts], pa.int64()),
                    "data": pa.array(
                        [packed(_deltas(words[p]), n[p].astype(np.uint32)) for _, p in parts],
                        pa.binary(),
                    ),
                })

    def laid_out(rows: DataFrame) -> DataFrame:
        """Answers where their chunks are, once for all later depths."""
        named = rows.withColumnRenamed("chunk", "part")
        return named.repartition(n_parts, "part").persist(StorageLevel.MEMORY_AND_DISK)

    words = laid_out(
        chunks.mapInArrow(ask_words, _UP).groupBy("bucket")
        .applyInPandas(merge_words, f"{_UP}, tokens bigint, counts array<bigint>, words array<bigint>")
    )
    tokens = int(words.agg(F.sum("tokens")).first()[0] or 0)
    sizes = (
        words.filter("counts is not null")
        .select("bucket", F.explode(F.arrays_zip("counts", "words")).alias("of"))
        .select("bucket", "of.counts", "of.words")
    )
    known, once, twice = (
        int(n or 0) for n in sizes.agg(*[
            F.sum(F.when(c, F.col("words")))
            for c in (F.col("counts") > 0, F.col("counts") == 1, F.col("counts") == 2)
        ]).first()
    )
    totals = Totals(tokens, known, min(max(once / max(once + 2 * twice, 1), 0.1), 0.9))
    # Bounded as Numbering says, and gathered in columns.
    limit = tokens // top + 1
    frequent, rare = (
        np.stack([c.to_numpy() for c in frame.toArrow().columns], 1).astype(np.int64)
        for frame in (
            sizes.filter(F.col("counts") >= limit).select("counts", "bucket", "words"),
            sizes.filter(F.col("counts") < limit).groupBy("counts").agg(F.max("words")),
        )
    )
    numbering = Numbering.of(n_buckets, limit, frequent, rare)
    answers = [words.select("part", "bucket", "data", F.lit(0).alias("depth"))]
    heavies: list[dict[tuple[int, ...], tuple[float, float]]] = []

    def arrive(row, replies: pd.DataFrame) -> Walk:
        """The chunk's walk, with all the replies that have come."""
        chunk = Chunk(row)
        by: dict[int, list[list[np.ndarray]]] = {}
        for depth, data in zip(replies["depth"], replies["data"], strict=True):
            by.setdefault(depth, []).append(unpacked(data))

        def told(depth: int, i: int) -> np.ndarray:
            parts = [reply[i] for reply in by.get(depth, [])]
            return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)

        order, parts = _word_order(chunk, n_buckets)
        counts, numbers = np.zeros(len(order), np.int64), np.zeros(len(order), np.uint64)
        bucket = np.concatenate([np.full(p.stop - p.start, b) for b, p in parts])
        counts[order] = told(0, 0)
        numbers[order] = numbering.numbers(counts[order], told(0, 1), bucket)
        walk = Walk(chunk, counts, numbers, totals, numbering)
        for depth, found in enumerate(heavies, 1):
            walk.find()
            n, counted, kinds = (told(depth, i) for i in range(3))
            some = np.flatnonzero(walk.heavy)
            contexts = zip(*[t.tolist() for t in walk.named(some)], strict=True)
            for i, context in zip(some.tolist(), contexts, strict=True):
                counted[i], kinds[i] = found.get(context, (0, 0))
            walk.step(n, counted, kinds)
        return walk

    def each(rows: pd.DataFrame, replies: pd.DataFrame) -> Iterator[tuple]:
        replies = replies.sort_values(["part", "depth", "bucket"])
        for row in rows.to_dict("records"):
            yield row, arrive(row, replies[replies["part"] == row["chunk"]])

    def ask_cells(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, walk in each(rows, replies):
            walk.find()
            out += [(row["chunk"], bucket, data) for bucket, data in walk.ask().messages()]
        return pd.DataFrame(out, columns=["chunk", "bucket", "data"])

    def together(fn, schema: str) -> DataFrame:
        replies = answers[0]
        for more in answers[1:]:
            replies = replies.union(more)
        return chunks.groupBy("chunk").cogroup(replies.groupBy("part")).applyInPandas(fn, schema)

    for depth in range(1, DEPTH + 1):
        least = LEAST[depth - 1]
        merged = laid_out(
            together(ask_cells, _UP).groupBy("bucket")
            .applyInPandas(_merger(depth - 1, totals, numbering), f"{_UP}, {_SUMS}")
        )
        rows = merged.filter("part < 0").groupBy("context").agg(
            *[F.sum(c).alias(c) for c in SUMS]
        ).collect()
        sums = [np.array([row[c] for row in rows]) for c in SUMS]
        kept = keeps(*sums, least) if rows else []
        heavies.append({
            tuple(row["context"]): (row["total" if least == 1 else "repeated"], row["kinds"])
            for row, keep in zip(rows, kept, strict=True) if keep
        })
        answers.append(
            merged.filter("part >= 0").select("part", "bucket", "data", F.lit(depth).alias("depth"))
        )

    log_total = math.log10(totals.tokens + totals.distinct + 1)

    def score(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row, walk in each(rows, replies):
            chunk = walk.chunk
            n_docs, owner = len(chunk.lengths), np.repeat(np.arange(len(chunk.lengths)), chunk.lengths + 1)
            seen = walk.counts[chunk.symbol]
            parts.append(pd.DataFrame({
                "doc_id": list(row["ids"]),
                "n_tokens": chunk.lengths + 1,
                "n_known": np.bincount(owner, seen > 0, n_docs).astype(np.int64),
                "base_score": np.bincount(owner, np.log10(seen + 1.0) - log_total, n_docs),
                "score": np.bincount(owner, np.log10(walk.chances()), n_docs),
            }))
        return pd.concat(parts)

    scored = together(
        score, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        "n_known", F.lit(totals.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
