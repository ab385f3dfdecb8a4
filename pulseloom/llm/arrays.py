"""Sorted integer sets with counts, as compressed bytes that travel between blocks of documents and tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import zstandard

if TYPE_CHECKING:
    import pandas as pd


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed bytes, all first bytes first."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def spread(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def put_sorted(codes: np.ndarray) -> bytes:
    return squeeze(np.diff(codes, prepend=np.int64(0)))


def get_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, np.int64))


def sum_sorted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of rows of (keys, counts), sorted, and their summed counts."""
    runs = [(get_sorted(k), spread(c, np.int64)) for k, c in zip(rows["keys"], rows["counts"], strict=True)]
    return _merged(runs)


def distinct(codes: np.ndarray) -> np.ndarray:
    """The distinct codes, sorted; sorting beats the hashing that np.unique does here."""
    codes = np.sort(codes)
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = distinct(np.concatenate([c for c, _ in runs]))
    total = np.zeros(len(codes), np.int64)
    for part, n in runs:
        total[np.searchsorted(codes, part)] += n
    return codes, total


def by_task(tasks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each task's values, in order."""
    order = np.argsort(tasks, kind="stable")
    cuts = np.flatnonzero(np.diff(tasks[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(tasks[part[0]]), part


class Distinct:
    """The distinct codes of a block, sorted, and how often they were added as counted ones."""

    #: Codes gathered before they are sorted and counted, and runs of them before those are merged.
    GATHER, RUNS = 1_000_000, 16

    def __init__(self, runs: int = RUNS) -> None:
        self.most = runs
        self.fresh: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size = 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, codes: np.ndarray, counted: bool = True, times: int = 1) -> None:
        """Take in codes, as counted ones `times` times each."""
        if counted and times > 1:
            codes, n = np.unique(codes, return_counts=True)
            self.runs.append((codes, n * times))
            if len(self.runs) >= self.most:
                self.runs = [_merged(self.runs)]
            return
        self.fresh[counted].append(codes)
        self.size += len(codes)
        if self.size >= self.GATHER:
            self._close()

    def merge(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Take in distinct, sorted codes and how often each was counted."""
        self.runs.append((codes, counts))
        if len(self.runs) >= self.most:
            self.runs = [_merged(self.runs)]

    def _close(self) -> None:
        for counted, parts in self.fresh.items():
            if parts:
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                self.runs.append((codes, n if counted else np.zeros(len(codes), np.int64)))
                parts.clear()
        self.size = 0
        if len(self.runs) >= self.most:
            self.runs = [_merged(self.runs)]

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        self._close()
        self.runs = [_merged(self.runs)]
        return self.runs[0]
