"""A static three-wise binary-fuse filter (Graf and Lemire, 2022) over 64-bit keys, built by peeling in whole rounds.

Each key has one slot in each of three consecutive segments. Peeling removes, round by round, all keys that are alone in
a slot; going back over the rounds, each key's own slot gets the byte that makes the three slots XOR to its fingerprint.
Keys peeled in one round cannot hold each other's own slot, so a round is one array operation.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_HEAD = struct.Struct("<QIII")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Murmur's 64-bit finaliser of key plus seed."""
    with np.errstate(over="ignore"):
        h = x + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


@dataclass
class BinaryFuse:
    seed: int
    segment: int  # slots of a segment, a power of two
    segments: int  # segments in which a key may start
    table: np.ndarray

    def _slots(self, h: np.ndarray) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(self.segment - 1)
        within = [(h >> np.uint64(s) & mask).astype(np.int64) for s in (0, 18, 36)]
        return np.stack([(first + k) * self.segment + within[k] for k in range(3)])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not self.segments:
            return np.zeros(len(keys), bool)
        h = _mix(keys, self.seed)
        a, b, c = self._slots(h)
        return self.table[a] ^ self.table[b] ^ self.table[c] == self._print(h)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys)
        n = len(keys)
        if not n:
            return cls(0, 1, 0, np.zeros(0, np.uint8))
        segment = 1 << min(18, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        for attempt in range(1, 200):
            size = int(n * room * (0.98 + 0.02 * attempt))
            made = cls(attempt * 0x9E3779B97F4A7C15 % 2**64, segment, max(1, -(-size // segment) - 2), np.zeros(0, np.uint8))
            if made._assign(keys):
                return made
        raise RuntimeError("no assignment found")

    def _assign(self, keys: np.ndarray) -> bool:
        h = _mix(keys, self.seed)
        slots, total = self._slots(h), (self.segments + 2) * self.segment
        count = np.bincount(slots.ravel(), minlength=total)
        ids = np.zeros(total, np.int64)  # XOR of the keys still in a slot; alone in it, the key
        for row in slots:
            np.bitwise_xor.at(ids, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            who, at = np.unique(ids[alone], return_index=True)
            own = alone[at]
            rounds.append((who, own))
            left -= len(who)
            touched = slots[:, who].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(ids, touched, np.tile(who, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left:
            return False
        table, prints = np.zeros(total, np.uint8), self._print(h)
        for who, own in reversed(rounds):
            a, b, c = slots[:, who]
            table[own] = 0
            table[own] = prints[who] ^ table[a] ^ table[b] ^ table[c]
        self.table = table
        return True

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.seed, self.segment, self.segments, len(self.table)) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments, n = _HEAD.unpack_from(data)
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, n, _HEAD.size))
