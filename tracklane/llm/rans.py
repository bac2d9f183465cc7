"""Static range asymmetric numeral coding of token ids, vectorised over interleaved lanes.

One frequency table serves any number of independent blocks. Token i of a block belongs to lane i mod LANES; all lanes
share one stream of 32-bit words, which a decoder reads in lane order. States are 64-bit in [2^31, 2^63). Every STEPS
steps of a block there is a checkpoint, the states of all lanes and a position in the words, where decoding can start:
the decoder runs all spans between checkpoints side by side.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SCALE = 20
LANES = 512
STEPS = 512
SPAN = LANES * STEPS
BLOCK = 4 * SPAN
LOW = np.uint64(1 << 31)
U64 = np.uint64


class Table(NamedTuple):
    """Symbols in ascending order with frequencies that add up to 2^SCALE."""

    symbols: np.ndarray
    freqs: np.ndarray

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frequency and start by symbol number, and symbol number by slot."""
        starts = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(U64)
        return self.freqs.astype(U64), starts, np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs)


class Block(NamedTuple):
    n: int
    positions: np.ndarray  # word position of each checkpoint
    states: np.ndarray  # (checkpoints, LANES)
    words: np.ndarray


def make_table(ids: np.ndarray) -> Table:
    """Frequencies in proportion to counts, at least 1 each; the rounding error goes to the most frequent symbols."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    if not len(symbols):
        return Table(symbols.astype(np.uint32), counts.astype(np.int64))
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError("too many different ids for the scale of the table")
    freqs = np.maximum(1, counts * (1 << SCALE) // counts.sum())
    by_count = np.argsort(-freqs, kind="stable")
    over = int(freqs.sum()) - (1 << SCALE)
    if over < 0:
        freqs[by_count[0]] -= over
    while over > 0:
        for i in by_count:
            cut = min(over, int(freqs[i]) // 2)
            freqs[i] -= cut
            over -= cut
            if not over or freqs[i] < 2:
                break
    return Table(symbols.astype(np.uint32), freqs)


def encode(ids: np.ndarray, table: Table) -> list[Block]:
    """Blocks of BLOCK ids; full blocks are encoded side by side."""
    number = np.zeros(int(table.symbols[-1]) + 1 if len(table.symbols) else 0, np.uint32)
    number[table.symbols] = np.arange(len(table.symbols))
    numbers = number[ids]
    full = len(ids) // BLOCK
    out = _encode_equal(numbers[:full * BLOCK].reshape(full, BLOCK), table) if full else []
    if len(ids) % BLOCK:
        out += _encode_equal(numbers[full * BLOCK:].reshape(1, -1), table)
    return out


def _encode_equal(numbers: np.ndarray, table: Table) -> list[Block]:
    freq, start, _ = table.lookup()
    count, n = numbers.shape
    steps = -(-n // LANES)
    x = np.full((count, LANES), LOW, U64)
    up, whole, word = U64(63 - SCALE), U64(1 << SCALE), U64(32)
    emitted: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    sizes = np.zeros((steps, count), np.int64)
    states = np.zeros((-(-steps // STEPS), count, LANES), U64)
    for t in range(steps - 1, -1, -1):
        s = numbers[:, t * LANES:(t + 1) * LANES]
        y = x[:, :s.shape[1]]
        f = freq[s]
        need = y >= f << up
        emitted[t] = y[need].astype(np.uint32)
        sizes[t] = need.sum(1)
        y = np.where(need, y >> word, y)
        x[:, :s.shape[1]] = y + y // f * (whole - f) + start[s]  # (q << scale) + remainder + start
        if t % STEPS == 0:
            states[t // STEPS] = x
    words = np.concatenate(emitted)
    owner = np.repeat(np.tile(np.arange(count), steps), sizes.ravel())
    before = np.cumsum(sizes, 0) - sizes
    return [Block(n, before[::STEPS, b], states[:, b], words[owner == b]) for b in range(count)]


def decode(blocks: list[Block], table: Table) -> list[np.ndarray]:
    """The ids of each block; spans of equal length of all blocks are decoded side by side."""
    freq, start, by_slot = table.lookup()
    words = np.concatenate([b.words for b in blocks]) if blocks else np.empty(0, np.uint32)
    words = words.astype(U64)
    base = np.cumsum([0, *(len(b.words) for b in blocks)])
    out = [np.empty(b.n, np.uint32) for b in blocks]
    spans: dict[int, list[tuple[int, int]]] = {}
    for i, b in enumerate(blocks):
        for k in range(len(b.positions)):
            spans.setdefault(min(SPAN, b.n - k * SPAN), []).append((i, k))
    for n, of in spans.items():
        x = np.stack([blocks[i].states[k] for i, k in of])
        pos = np.array([base[i] + blocks[i].positions[k] for i, k in of])
        got = _decode_equal(n, x, pos, words, freq, start, by_slot)
        for (i, k), g in zip(of, got):
            out[i][k * SPAN:k * SPAN + n] = table.symbols[g]
    return out


def _decode_equal(n, x, pos, words, freq, start, by_slot) -> np.ndarray:
    steps = -(-n // LANES)
    got = np.empty((len(x), n), np.uint32)
    mask, scale, word = U64((1 << SCALE) - 1), U64(SCALE), U64(32)
    for t in range(steps):
        wide = min(LANES, n - t * LANES)
        y = x[:, :wide]
        slot = y & mask
        s = by_slot[slot]
        got[:, t * LANES:t * LANES + wide] = s
        y = freq[s] * (y >> scale) + slot - start[s]
        need = y < LOW
        at = pos[:, None] + np.cumsum(need, 1) - 1
        y[need] = (y[need] << word) | words[at[need]]
        x[:, :wide] = y
        pos = pos + need.sum(1)
    return got
