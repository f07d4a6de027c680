"""Token ids in binary blocks: an adaptive context-mixing range coder.

A block holds whole documents.  Its ids are cut into lanes of equal length that are
coded in step, so that every arithmetic step is one array operation; all lanes share
one model, which starts empty in every block and learns after every step:

* order 2 and order 1: for the last two ids (hashed) and for the last id, the id that
  mostly followed, with how often it was right of how often it was asked; that ratio is
  the order's estimate of the id, and what it leaves goes to order 0;
* order 0: the frequencies of the ids so far, brought up to date every few steps, with
  a floor for every id, so that any id can be coded at any time.

The three estimates are mixed into one distribution, which codes the id in one arithmetic
step: in whole units the order-2 and the order-1 id get their estimate times
the order's weight, and the rest is spread by order 0.  The weights belong to the pair of
counts behind the two estimates and adapt: each is the credit that the order had in the
probabilities of the ids that came, over what it had asked for.  All of it is integer
arithmetic, so a block reads alike on any machine.  A block ends in a CRC-32 of all its bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TMB2"
HEAD = struct.Struct("<4sIIIII")  # magic, documents, ids, lanes, length of the coded words, ids are below this
MOST_IDS = 1 << 21  # blocks with ids from here on code each id as two symbols of 16 bits
WIDE = 0  # the limit written for such blocks
BITS = 30  # of the whole distribution; so all of the model fits 32-bit integers
WEIGHT = 1 << 10
TOP, MASK = 1 << 32, (1 << 48) - 1
CONTEXTS = 1 << 18
REFRESH = 16
# an order's entry holds the id, how often it was right (4 bits) and how often it was asked (4 bits)
RIGHT, ASKED = np.arange(256) >> 4, np.arange(256) & 15
ESTIMATE = np.where(ASKED > 0, (2 * RIGHT + 1) * WEIGHT // (2 * ASKED + 2), 0).astype(np.int32)
FULL = ASKED == 15
HIT = (np.where(FULL, (RIGHT + 1) >> 1, RIGHT) + 1) << 4 | np.where(FULL, 8, ASKED) + 1
MISS = np.where(FULL, RIGHT >> 1, RIGHT) << 4 | np.where(FULL, 8, ASKED) + 1
# the next counts after a miss, then after a hit; an id that is mostly wrong gives way to the one that came
GIVES_WAY = 1 << 8
NEXT = np.concatenate([np.where(2 * RIGHT < ASKED + 1, GIVES_WAY, MISS), HIT]).astype(np.int32)
FRESH = 1 << 4 | 1
CLASS = np.where(ASKED == 0, 0, 1 + np.minimum(6, ESTIMATE * 7 // WEIGHT)).astype(np.int32)
CLASS8 = CLASS * 8


class Model:
    """What coder and decoder know alike: predictions, counts and weights."""

    def __init__(self, limit: int):
        self.limit = limit
        self.bits = max(20, (limit - 1).bit_length() + 3)  # of the order-0 frequencies
        self.unit = 1 << BITS - self.bits  # the mixture is in units of one of this
        self.next1 = np.zeros(limit, dtype=np.int32)
        self.next2 = np.zeros(CONTEXTS, dtype=np.int32)
        self.credit, self.wanted = np.full((2, 128), 512.0 * self.unit), np.full((2, 128), 1024.0 * WEIGHT)
        self.count0 = np.zeros(limit, dtype=np.int64)
        self.recent: list[np.ndarray] = []
        self.spread()
        self.weigh()

    def weigh(self) -> None:
        """What an estimate is multiplied by, at most twice its due, and shifted down by 10 bits."""
        self.weight2, self.weight1 = np.minimum(self.credit * WEIGHT / self.wanted, 2 * self.unit).astype(np.int32)

    def spread(self) -> None:
        """Order-0 frequencies: one for every id, the rest in proportion to the counts."""
        total, seen = 1 << self.bits, int(self.count0.sum())
        frequency = 1 + self.count0 * (total - self.limit) // max(1, seen)
        frequency[self.count0.argmax()] += total - frequency.sum()
        self.start, self.frequency = (np.cumsum(frequency) - frequency).astype(np.int32), frequency.astype(np.int32)

    def predict(self, before: np.ndarray, last: np.ndarray) -> None:
        """The ids of both orders for each lane, and what they get in the mixture."""
        self.at2, self.at1 = (before * np.int32(40503) + last * np.int32(30011) + (before >> 5)) & (CONTEXTS - 1), last
        self.entry2, self.entry1 = self.next2.take(self.at2), self.next1.take(last)
        self.id2, self.id1 = self.entry2 >> 8, self.entry1 >> 8
        self.state2, self.state1 = self.entry2 & 255, self.entry1 & 255
        self.context = CLASS8.take(self.state2) + CLASS.take(self.state1) + 64 * (self.id2 == self.id1).view(np.int8)
        self.asked2, self.asked1 = ESTIMATE.take(self.state2), ESTIMATE.take(self.state1)
        self.mass2 = np.minimum(self.asked2 * self.weight2.take(self.context) >> 10, self.unit - 1)
        self.mass1 = np.minimum(self.asked1 * self.weight1.take(self.context) >> 10, self.unit - 1 - self.mass2)
        self.mass0 = self.unit - self.mass2 - self.mass1

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the mixture's distribution has each id: start and size, of ``2 ** BITS``."""
        self.hit2, self.hit1 = self.id2 == ids, self.id1 == ids
        below = (self.id2 < ids) * self.mass2 + (self.id1 < ids) * self.mass1
        self.own2, self.own1 = self.hit2 * self.mass2, self.hit1 * self.mass1
        start = self.mass0 * self.start.take(ids) + (below << self.bits)
        self.size = self.mass0 * self.frequency.take(ids) + (self.own2 + self.own1 << self.bits)
        return start, self.size

    def ids_at(self, slot: np.ndarray) -> np.ndarray:
        """The id whose interval holds each slot."""
        swap = self.id2 > self.id1
        low, high = np.minimum(self.id2, self.id1), np.maximum(self.id2, self.id1)
        mass_low, mass_high = np.where(swap, self.mass1, self.mass2) << self.bits, np.where(swap, self.mass2, self.mass1) << self.bits
        one = np.flatnonzero(low == high)
        mass_low[one] += mass_high[one]
        mass_high[one] = 0
        from_low = self.mass0 * self.start.take(low)
        to_low = from_low + self.mass0 * self.frequency.take(low) + mass_low
        from_high = self.mass0 * self.start.take(high) + mass_low
        to_high = from_high + self.mass0 * self.frequency.take(high) + mass_high
        past_low = slot >= to_low
        rest = slot - past_low * mass_low - (slot >= to_high) * mass_high
        found = self.of_slot.take((rest / self.mass0).astype(np.int32), mode="clip")
        found = np.where((slot >= from_high) & (slot < to_high), high, found)
        return np.where((slot >= from_low) & ~past_low, low, found)

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids of a step, after ``interval`` of the same ids."""
        fresh = ids << 8 | FRESH
        for table, at, entry, state, hit in ((self.next2, self.at2, self.entry2, self.state2, self.hit2), (self.next1, self.at1, self.entry1, self.state1, self.hit1)):
            now = NEXT.take(state + (hit.astype(np.int32) << 8))
            table[at] = np.where(now == GIVES_WAY, fresh, entry - state + now)
        self.turn = (self.turn + 1) % 4  # the weights learn from a quarter of the lanes in turn
        some = slice(self.turn, None, 4)
        context, size = self.context[some], self.size[some]
        for credit, wanted, own, asked in ((self.credit[0], self.wanted[0], self.own2[some], self.asked2[some]), (self.credit[1], self.wanted[1], self.own1[some], self.asked1[some])):
            hit = np.flatnonzero(own)
            # whole numbers below 2**53, so the sums are the same in any order
            credit += np.bincount(context.take(hit), np.floor(own.take(hit) * float(1 << BITS) / size.take(hit)), 128)
            wanted += np.bincount(context, asked, 128)
        if self.wanted.max() > 1 << 40:
            self.credit, self.wanted = np.ceil(self.credit / 2), np.ceil(self.wanted / 2)
        self.weigh()
        self.recent.append(ids)
        if len(self.recent) == REFRESH:
            self.count0 += np.bincount(np.concatenate(self.recent), minlength=self.limit)
            self.recent = []
            self.spread()
            self.refreshed = True

    refreshed, turn = True, 0

    def prepare_slots(self) -> None:
        """For decoding: the id of every order-0 slot."""
        if self.refreshed:
            self.of_slot, self.refreshed = np.repeat(np.arange(self.limit, dtype=np.int32), self.frequency), False


class Writer:
    """Range coders of all lanes.  Carries are added to the last word and settled at the end."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, MASK)
        self.words, self.count = np.zeros((2 * steps + 3, lanes), np.int32), np.zeros(lanes, np.int64)
        self.lanes = np.arange(lanes)

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        """Code each lane's interval [start, start + size) of 2**BITS."""
        unit = self.range >> BITS
        low, wide = self.low + unit * start, unit * size
        over = np.flatnonzero(low > MASK)
        if len(over):
            self.words[self.count[over] - 1, over] += 1
            low[over] &= MASK
        out = np.flatnonzero(wide < TOP)
        while len(out):
            count, part = self.count[out], low[out]
            self.words[count, out] = part >> 32
            self.count[out] = count + 1
            low[out] = (part << 16) & MASK
            wide[out] <<= 16
            out = out[wide[out] < TOP]
        self.low, self.range = low, wide

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane, one lane after the other, and their numbers."""
        for shift in (32, 16, 0):
            self.words[self.count, self.lanes] = (self.low >> shift) & 0xFFFF
            self.count += 1
        carry = np.zeros(len(self.lanes), np.int32)
        for row in self.words[::-1]:
            row += carry
            carry = row >> 16
            row &= 0xFFFF
        inside = np.arange(len(self.words))[None, :] < self.count[:, None]
        return np.ascontiguousarray(self.words.T)[inside].astype("<u2"), self.count


class Reader:
    """The counterpart of Writer."""

    def __init__(self, words: np.ndarray, count: np.ndarray):
        self.words, self.at = np.concatenate([words, np.zeros(4, words.dtype)]).astype(np.int64), np.cumsum(count) - count
        self.code, self.range = np.zeros(len(count), np.int64), np.full(len(count), MASK)
        for _ in range(3):
            self.code = (self.code << 16) | self.words[self.at]
            self.at += 1

    def slot(self) -> np.ndarray:
        # exact: the quotient of numbers below 2**48 and 2**18 cannot be rounded up to a whole number
        self.unit = self.range >> BITS
        return np.minimum(self.code / self.unit, (1 << BITS) - 1).astype(np.int32)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        code, wide = self.code - self.unit * start, self.unit * size
        out = np.flatnonzero(wide < TOP)
        while len(out):
            at = self.at[out]
            code[out] = (code[out] << 16) | self.words[at]
            self.at[out] = at + 1
            wide[out] <<= 16
            out = out[wide[out] < TOP]
        self.code, self.range = code, wide


def lanes_for(n: int) -> int:
    return max(1, min(8192, n // 256))


def encode_ids(ids: np.ndarray, limit: int) -> tuple[bytes, int]:
    """Coded ids (below ``limit``) and the number of lanes."""
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, writer = Model(limit), Writer(lanes, steps)
    before = last = np.zeros(lanes, dtype=np.int32)
    for now in grid:
        model.predict(before, last)
        writer.put(*model.interval(now))
        model.learn(now)
        before, last = last, now
    words, count = writer.finish()
    return count.astype("<u4").tobytes() + words.tobytes(), lanes


def decode_ids(coded: bytes, n: int, lanes: int, limit: int) -> np.ndarray:
    """The ids of ``encode_ids``."""
    steps = -(-n // lanes)
    count = np.frombuffer(coded, "<u4", lanes).astype(np.int64)
    model, reader = Model(limit), Reader(np.frombuffer(coded, "<u2", offset=4 * lanes), count)
    before = last = np.zeros(lanes, dtype=np.int32)
    grid = np.zeros((steps, lanes), dtype=np.int32)
    for t in range(steps):
        model.predict(before, last)
        model.prepare_slots()
        now = grid[t]
        now[:] = model.ids_at(reader.slot())
        reader.take(*model.interval(now))
        model.learn(now)
        before, last = last, now
    return grid.T.reshape(-1)[:n]


def write_block(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A block of whole documents: header, documents, coded ids, CRC-32."""
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError(f"ids must be from 0 to {(1 << 32) - 1}")
    limit = int(ids.max()) + 1 if len(ids) else 1
    if limit > MOST_IDS:
        limit = WIDE
        coded, lanes = encode_ids(ids.astype("<u4").view("<u2").astype(np.int32), 1 << 16)
    else:
        coded, lanes = encode_ids(ids, limit) if len(ids) else (b"", 0)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    body = HEAD.pack(MAGIC, len(doc_ids), len(ids), lanes, len(coded), limit) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(counts, "<u4").tobytes() + coded
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids for each, and all ids; raises where the checksum is wrong."""
    if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0] or block[:4] != MAGIC:
        raise ValueError("damaged block")
    _, docs, n, lanes, size, limit = HEAD.unpack_from(block)
    at = HEAD.size
    doc_ids, known = np.frombuffer(block, "<i8", docs, at).tolist(), np.frombuffer(block, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(block, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    if limit == WIDE:
        ids = decode_ids(block[at : at + size], 2 * n, lanes, 1 << 16).astype("<u2").view("<u4").astype(np.int64)
    else:
        ids = decode_ids(block[at : at + size], n, lanes, limit) if n else np.zeros(0, np.int32)
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], counts, ids
