"""An adaptive mixing range coder for token ids, vectorised over independently reset blocks.

``pack`` takes a group of ids. Its header holds a prior of the group: order-0 counts, and order-1 counts of the pairs
that are worth their place. The ids are cut into blocks that know nothing of each other: each starts from the prior,
an empty order-2 table and even weights. A step codes one id of every block with one numpy operation after the other:

* order 2: the id that last followed the two ids before it in the block, trusted by how often it was right; how much
  each degree of trust is worth is a weight that the block learns, and mixes this guess with the lower orders;
* order 1: the prior's frequencies after the id before, which include an escape;
* order 0: the prior's frequencies of what escapes.

The parts of the unit interval that these orders give to an id are what a carry-free range coder narrows: 64-bit lower
end and width, a 32-bit word leaves when the width falls below 2**32 (a width across a word's border is cut there).

Layout (little-endian): ``MIX2``; ids, blocks, header bytes and header CRC-32 (32 bits each); the header (deflated);
words and CRC-32 of the ids (as 32-bit integers) of every block; the blocks' 32-bit words.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block at most.
BLOCK = 2048
MAGIC = b"MIX2"
#: Ids are below this.
MOST_ID = 1 << 18
#: Slots of a block's order-2 table (a power of two); bits of the order-0 total, and of an order-1 total at most.
_SLOTS, _BITS0, _BITS1 = 1 << 11, 20, 12
#: Trust of an order-2 entry: 0 to 3, and 4 for an empty one; entries are 8 * id + trust.
_EMPTY = -8 + 4
#: Bits that a pair in the header costs, about.
_PAIR_BITS = 12
_U = np.uint64
_32, _WORD = _U(32), _U((1 << 32) - 1)


def _classes(counts: np.ndarray) -> np.ndarray:
    """Counts (0 and up) as bytes: exact below 8, then two bits after the leading one."""
    c = counts.astype(np.int64)
    e = np.frexp(np.maximum(c, 1).astype(np.float64))[1] - 1
    return np.where(c < 8, c, 8 + (e - 3) * 4 + (c >> np.maximum(e - 2, 0) & 3)).astype(np.uint8)


def _class_counts(code: np.ndarray) -> np.ndarray:
    k = code.astype(np.int64)
    big = np.maximum(k - 8, 0)
    return np.where(k < 8, k, (4 + (big & 3)) << ((big >> 2) + 1))


def _planes(values: np.ndarray) -> bytes:
    """Integers below 2**24 as three planes of bytes."""
    v = values.astype("<u4")
    return b"".join((v >> s & 255).astype(np.uint8).tobytes() for s in (0, 8, 16))


def _from_planes(data: bytes) -> np.ndarray:
    p = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int64)
    return p[0] | p[1] << 8 | p[2] << 16


def _deltas(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the value before; at ``first`` the values themselves."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


class _Prior:
    """What all blocks of a group start from: symbols (dense numbers of ids) and the coding tables of orders 0 and 1.

    Order-1 entries of context c are ``begin[c]`` and following, the escape last; context ``n`` is the block's begin.
    """

    def __init__(self, symbols, escapes, sizes, context_escapes, follow, codes):
        self.header = (symbols, escapes, sizes, context_escapes, follow, codes)
        self.symbols, n = symbols, len(symbols)
        self.n = n
        sizes = np.append(sizes, 0)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(n + 1), sizes)
        counts = _class_counts(codes)
        total = np.bincount(owner, counts, n + 1).astype(np.int64) + np.maximum(np.append(_class_counts(context_escapes), 1), 1)
        bits = np.frexp(np.maximum(total, 4 * (sizes + 1)).astype(np.float64))[1]
        bits = np.where(sizes > 0, np.minimum(bits, _BITS1), 0)
        room = (1 << bits) - sizes - 1
        width = 1 + counts * room[owner] // total[owner]
        self.begin = np.arange(n + 1) + ends - sizes
        self.escape = self.begin + sizes
        freq = np.zeros(len(owner) + n + 1, np.int64)
        self.sym = np.full(len(freq), -1, np.int64)
        at = np.arange(len(owner)) + owner
        freq[at], self.sym[at] = width, follow
        freq[self.escape] = (1 << bits) - np.bincount(owner, width, n + 1).astype(np.int64)
        before = np.cumsum(freq) - freq
        self.start = (before - np.repeat(before[self.begin], sizes + 1)).astype(_U)
        self.bits = bits.astype(_U)
        self.slot_begin = before[self.begin]
        # order 0: only what escapes
        zero = _class_counts(escapes)
        some = zero > 0
        scale = (1 << _BITS0) - int(some.sum())
        freq0 = np.where(some, 1 + zero * scale // max(1, int(zero.sum())), 0)
        self.start0 = (np.cumsum(freq0) - freq0).astype(_U)
        self.freq, self.freq0 = freq.astype(_U), freq0.astype(_U)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The entry of every slot of the order-1 totals, one context after the other; the symbol of order 0's."""
        return (
            np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64)),
            np.repeat(np.arange(self.n, dtype=np.int32), self.freq0.astype(np.int64)),
        )

    def to_bytes(self) -> bytes:
        symbols, escapes, sizes, context_escapes, follow, codes = self.header
        first = np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]
        parts = [
            _planes(np.diff(symbols, prepend=0)),
            escapes.tobytes(),
            _planes(sizes),
            context_escapes.tobytes(),
            _planes(_deltas(follow, first)),
            codes.tobytes(),
        ]
        return np.array([self.n, len(follow)], "<u4").tobytes() + zlib.compress(b"".join(parts), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> _Prior:
        n, m = np.frombuffer(data, "<u4", 2).astype(int)
        raw = zlib.decompress(data[8:])
        cuts = np.cumsum([0, 3 * n, n, 3 * n, n, 3 * m, m])
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        sizes, delta = _from_planes(parts[2]), _from_planes(parts[4])
        run = np.cumsum(delta)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        follow = run - np.repeat(run[first] - delta[first], sizes[sizes > 0])
        as_bytes = lambda p: np.frombuffer(p, np.uint8)
        return cls(np.cumsum(_from_planes(parts[0])), as_bytes(parts[1]), sizes, as_bytes(parts[3]), follow, as_bytes(parts[5]))


def _pairs(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys (below ``most``) in order, which of them each key is, and how often each came."""
    if most > 1 << 25:
        return np.unique(key, return_inverse=True, return_counts=True)
    times = np.bincount(key, minlength=most)  # the same without sorting
    pairs = np.nonzero(times)[0]
    number = np.zeros(most, np.int32)
    number[pairs] = np.arange(len(pairs))
    return pairs, number[key], times[pairs]


def _prior(ids: np.ndarray) -> tuple[_Prior, np.ndarray, np.ndarray]:
    """The group's prior, the ids as symbols, and the order-1 entry of each (the escape where its pair is not kept)."""
    counts = np.bincount(ids, minlength=1)
    symbols = np.nonzero(counts)[0]
    dense = np.zeros(len(counts), np.int32)
    dense[symbols] = np.arange(len(symbols))
    x, n = dense[ids], len(symbols)
    key = x[:-1].astype(np.int64) * n + x[1:]
    pairs, which, times = _pairs(key, n * n)
    c, follow = pairs // n, pairs % n
    of_context = np.bincount(x[:-1], minlength=n)
    gain = times * np.log2(times / of_context[c] * (len(ids) / counts[symbols][follow]))
    keep = (gain > _PAIR_BITS) & (times > 1)
    # the most frequent successors, if there are more than an order-1 total has room for
    order = np.lexsort((-times, ~keep, c))
    rank = np.empty(len(pairs), np.int64)
    rank[order] = np.arange(len(pairs)) - np.searchsorted(c, c[order])
    keep &= rank < (1 << _BITS1) // 4
    sizes = np.bincount(c[keep], minlength=n)
    left = np.where(keep, 0, times)
    escapes = np.bincount(follow, left, n).astype(np.int64)
    escapes = np.maximum(escapes, 1)  # a block may begin with any id
    context_escapes = np.bincount(c, left, n).astype(np.int64)
    prior = _Prior(symbols, _classes(escapes), sizes, _classes(context_escapes), follow[keep], _classes(times[keep]))
    entry = np.where(keep, np.cumsum(keep) - 1 + c, prior.escape[c]).astype(np.int32)
    return prior, x, np.concatenate([prior.escape[n : n + 1].astype(np.int32), entry[which.ravel()]])


class _Coder:
    """The state of all blocks of a group between two steps; encoder and decoder take the same path through it."""

    def __init__(self, blocks: int, begin: int):
        self.row2, self.row_w = np.arange(blocks) * _SLOTS, np.arange(blocks) * 8
        self.table = np.full(blocks * _SLOTS, _EMPTY, np.int32)
        self.weights = np.full(blocks * 8, 1 << 14, _U)
        self.last, self.before = np.full(blocks, begin, np.int64), np.full(blocks, begin, np.int64)
        self.low, self.width = np.zeros(blocks, _U), np.full(blocks, (1 << 64) - 1, _U)

    def keep(self, n: int) -> None:
        for name in ("row2", "row_w", "last", "before", "low", "width"):
            setattr(self, name, getattr(self, name)[:n])

    def guess(self) -> None:
        """Order 2's guess, its weight, and the part of the interval it is given."""
        self.at = self.row2 + ((self.last * 40503 + self.before * 30011 >> 4) & (_SLOTS - 1))
        self.entry = self.table[self.at]
        self.trust, self.guessed = self.entry & 7, self.entry >> 3
        self.at_w = self.row_w + self.trust
        self.weight = self.weights[self.at_w]
        self.part = (self.width >> _U(16)) * self.weight

    def mix(self, hit: np.ndarray) -> None:
        """Narrows to the guess where it was right, else to the rest, and learns the weight."""
        self.low += np.where(hit, _U(0), self.part)
        self.width = np.where(hit, self.part, self.width - self.part)
        self.weights[self.at_w] = self.weight - (self.weight >> _U(5)) + np.where(hit, _U(2042), _U(2))

    def narrow(self, bits, start, freq) -> None:
        """Narrows to the part [start, start + freq) of 2**bits."""
        unit = self.width >> bits
        self.low += unit * start
        self.width = unit * freq

    def escape(self, rest, start, freq) -> tuple[np.ndarray, np.ndarray]:
        """Lower ends and widths of the blocks ``rest`` after their order-0 part."""
        unit = self.width[rest] >> _U(_BITS0)
        return self.low[rest] + unit * start, unit * freq

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        worse = np.where((self.trust > 1) & (self.trust < 4), self.entry - self.trust + 1, x << 3)
        self.table[self.at] = np.where(hit, self.entry + (self.trust < 3), worse)
        self.before, self.last = self.last, x


def _shift(low, width) -> tuple[np.ndarray, np.ndarray]:
    """Intervals narrower than 2**32 lose their leading word (in place); which ones, and the words."""
    k = np.nonzero(width < _U(1 << 32))[0]
    if len(k):
        lo = low[k]
        width[k] = np.minimum(width[k], _U(1 << 32) - (lo & _WORD)) << _32
        low[k] = lo << _32
        return k, lo >> _32
    return k, k


def _cut(n: int) -> tuple[int, int, int]:
    """Blocks, steps, and blocks that have the last step; all others are one id shorter."""
    blocks = -(-n // BLOCK)
    steps = -(-n // blocks)
    return blocks, steps, n - blocks * (steps - 1)


def _grid(values: np.ndarray, blocks: int, steps: int, longer: int) -> np.ndarray:
    """Values by step and block."""
    out = np.zeros((steps, blocks), values.dtype)
    whole = longer * steps
    out[:, :longer] = values[:whole].reshape(longer, steps).T
    if longer < blocks:
        out[: steps - 1, longer:] = values[whole:].reshape(blocks - longer, steps - 1).T
    return out


def _ungrid(grid: np.ndarray, longer: int) -> np.ndarray:
    return np.concatenate([grid[:, :longer].T.ravel(), grid[:-1, longer:].T.ravel()])


def _block_bounds(blocks: int, steps: int, longer: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.where(np.arange(blocks) < longer, steps, steps - 1))])


def _checksums(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    raw = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def pack(ids: np.ndarray) -> bytes:
    """A group's bytes for its ids (each from 0 to ``MOST_ID`` - 1)."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    if not n:
        return MAGIC + np.zeros(4, "<u4").tobytes()
    if ids.min() < 0 or ids.max() >= MOST_ID:
        raise ValueError("an id is out of range")
    prior, x, entries = _prior(ids)
    blocks, steps, longer = _cut(n)
    bounds = _block_bounds(blocks, steps, longer)
    entries[bounds[:-1]] = prior.escape[prior.n]
    x_of, e_of, esc_of = (_grid(v, blocks, steps, longer) for v in (x, entries, prior.sym[entries] < 0))
    coder = _Coder(blocks, prior.n)
    low_of_all = coder.low
    capacity = 2 * steps + 4
    words, first = np.zeros(blocks * capacity, "<u4"), np.arange(blocks) * capacity
    used = first.copy()

    def emit(k, out):
        words[used[k]] = out
        used[k] += 1

    for step in range(steps):
        if step == steps - 1:
            coder.keep(longer)
        live = len(coder.last)
        now, e = x_of[step, :live].astype(np.int64), e_of[step, :live]
        bits = prior.bits[coder.last]
        coder.guess()
        hit = coder.guessed == now
        coder.mix(hit)
        start = np.where(hit, _U(0), prior.start[e])
        coder.narrow(bits, start, np.where(hit, _U(1) << bits, prior.freq[e]))
        emit(*_shift(coder.low, coder.width))
        rest = np.nonzero(esc_of[step, :live] & ~hit)[0]
        if len(rest):
            s = now[rest]
            lo, wi = coder.escape(rest, prior.start0[s], prior.freq0[s])
            k, out = _shift(lo, wi)
            emit(rest[k], out)
            coder.low[rest], coder.width[rest] = lo, wi
        coder.learn(now, hit)
    emit(np.arange(blocks), low_of_all + _WORD >> _32)  # a value inside each interval; what follows counts as 0
    sizes = used - first
    header = prior.to_bytes()
    taken = words.reshape(blocks, capacity)[np.arange(capacity) < sizes[:, None]]
    return b"".join(
        [
            MAGIC,
            np.array([n, blocks, len(header), zlib.crc32(header)], "<u4").tobytes(),
            header,
            np.stack([sizes, _checksums(ids, bounds)], 1).astype("<u4").tobytes(),
            taken.tobytes(),
        ]
    )


def unpack(data: bytes, *, check: bool = True) -> np.ndarray:
    """The ids of a group's bytes; raises ValueError where a checksum is wrong.

    Without ``check`` the blocks' checksums are not looked at: damage in a block's words spoils the ids of that block.
    """
    if data[:4] != MAGIC or len(data) < 20:
        raise ValueError("not a group of token blocks")
    n, blocks, size, crc = np.frombuffer(data, "<u4", 4, 4).astype(int)
    if not n:
        return np.zeros(0, np.int64)
    header = data[20 : 20 + size]
    at = 20 + size + 8 * blocks
    if zlib.crc32(header) != crc or len(data) < at or blocks != _cut(n)[0]:
        raise ValueError("the header of a group: the checksum is wrong")
    prior = _Prior.from_bytes(header)
    steps, longer = _cut(n)[1:]
    table = np.frombuffer(data, "<u4", 2 * blocks, 20 + size).reshape(blocks, 2).astype(np.int64)
    ends = np.cumsum(table[:, 0])
    words = np.frombuffer(data, "<u4", offset=at).astype(_U)
    if ends[-1] != len(words):
        raise ValueError("a group is cut short")
    words = np.append(words, _U(0))
    place = ends - table[:, 0]

    def take(k):
        p = place[k]
        place[k] = p + 1
        return words[np.where(p < ends[k], p, len(words) - 1)]

    every = np.arange(blocks)
    code = take(every) << _32
    code |= take(every)
    slots1, slots0 = prior.slots()
    coder = _Coder(blocks, prior.n)
    grid = np.zeros((steps, blocks), np.int32)
    one = _U(1)
    for step in range(steps):
        if step == steps - 1:
            coder.keep(longer)
            code = code[:longer]
        live = len(coder.last)
        bits = prior.bits[coder.last]
        coder.guess()
        hit = code - coder.low < coder.part
        coder.mix(hit)
        unit = coder.width >> bits
        slot = np.minimum((code - coder.low) // unit, (one << bits) - one).astype(np.int64)
        e = slots1[prior.slot_begin[coder.last] + slot]
        start = np.where(hit, _U(0), prior.start[e])
        coder.narrow(bits, start, np.where(hit, one << bits, prior.freq[e]))
        now = np.where(hit, coder.guessed, prior.sym[e])
        k, _ = _shift(coder.low, coder.width)
        code[k] = code[k] << _32 | take(k)
        rest = np.nonzero(now < 0)[0]
        if len(rest):
            unit = coder.width[rest] >> _U(_BITS0)
            slot = np.minimum((code[rest] - coder.low[rest]) // unit, _U((1 << _BITS0) - 1)).astype(np.int64)
            s = slots0[np.minimum(slot, len(slots0) - 1)]
            now[rest] = s
            lo, wi = coder.escape(rest, prior.start0[s], prior.freq0[s])
            k, _ = _shift(lo, wi)
            k = rest[k]
            code[k] = code[k] << _32 | take(k)
            coder.low[rest], coder.width[rest] = lo, wi
        grid[step, :live] = now
        coder.learn(now, hit)
    ids = prior.symbols[_ungrid(grid, longer)]
    found = _checksums(ids, _block_bounds(blocks, steps, longer)) if check else table[:, 1].tolist()
    for k, (want, got) in enumerate(zip(table[:, 1].tolist(), found, strict=True)):
        if want != got:
            raise ValueError(f"block {k}: the checksum is wrong")
    return ids
