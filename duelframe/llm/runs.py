"""Periodic runs of words: online dyadic square catching.

Words arrive in order. A catcher of level L stands on a completed block of B = 2 ** L words, one at each multiple of
B / 2, and listens while the next B words complete suffixes of B words. Each appended word completes one suffix a
level, which is compared by name with the two catchers that still listen. A suffix that equals the block d words
earlier, B / 2 < d <= B, is a square in the making: the suffix comparison then goes on with every appended word, in
both directions, and the squares that touch it merge into one run of period d. If the block comes back within B / 2
words it has a smaller period, which a lower level reports, and the catcher goes blind.

Complete: a run of smallest period q and length at least 4 q holds, at the level with B / 2 < q <= B, a block of some
catcher and its copy q words later, as B / 2 - 1 + B + q < 4 q; since B >= q no copy lies nearer. Each run is met at
one level and by neighbouring catchers only. Names are 64-bit hashes built by doubling; lengths and periods come from
comparing words themselves. Two appended words or a million at once give the same runs.

A task streams its documents through one set of catchers, with a word of its own between documents, so no run crosses
them. Texts are appended in pieces of STEP words or more; memory grows with the longest document, not with the table.

Defined results: null or empty text has no words and no runs, and collapses to the empty text. Repeated rows each get
a row; a null doc_id is kept as it is. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, rows_of, slices
from .decontaminate import mix

#: A run is at least this many words and this many periods long. The catchers' grid rests on the 4 periods.
LEAST, PERIODS = 6, 4
STEP = 1 << 16
GAIN = np.uint64(0xD6E8FEB86659FD93)
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Level:
    """Suffix names of one level that are still needed, and the catchers that are blind or have caught."""

    def __init__(self):
        self.first = 0  # the word at which names[0] begins
        self.names = np.zeros(0, np.uint64)
        self.done = np.zeros(0, np.int64)

    def keep(self, since: int) -> None:
        drop = max(0, min(since - self.first, len(self.names)))
        self.names, self.first = self.names[drop:], self.first + drop
        self.done = self.done[self.done >= since]


class Catchers:
    """Runs of a stream of words given as numbers; ``longest`` bounds the length of a run.

    Runs that have reached the end of the stream stay open and grow with the next words.
    """

    def __init__(self, longest: int):
        levels = 1
        while (1 << levels) // 2 + 1 <= longest // PERIODS:
            levels += 1
        self.levels = [Level() for _ in range(levels)]
        self.words = np.zeros(1024, np.int64)
        self.size = 0
        self.open: list[list[int]] = []  # [start, end, period] of runs that the last word still extends
        self.found: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        old, self.size = self.size, self.size + len(words)
        if self.size > len(self.words):
            self.words = np.concatenate([self.words[:old], np.zeros(max(old, self.size - old), np.int64)])
        self.words[old:self.size] = words
        self._advance(old)
        for k, level in enumerate(self.levels):
            block = 1 << k
            begin, end = max(0, old - block + 1), self.size - block + 1
            if begin >= end:
                break
            if k == 0:
                names = mix(words.astype(np.uint64))
            else:
                lower = self.levels[k - 1]
                left = lower.names[begin - lower.first:end - lower.first]
                right = lower.names[begin + block // 2 - lower.first:end + block // 2 - lower.first]
                names = mix(left * GAIN + right)
            level.names = np.concatenate([level.names, names])
            self._listen(level, block, begin, end)
        for k, level in enumerate(self.levels):
            # The next suffix of this level, and of the one above, begin after these words at the earliest.
            level.keep(self.size - 4 * (1 << k))

    def _listen(self, level: Level, block: int, begin: int, end: int) -> None:
        """Compare the suffixes that begin at words ``begin`` to ``end`` with the catchers that listen."""
        grid = max(1, block // 2)
        at = np.arange(begin, end)
        names = level.names[begin - level.first:]
        near = (at - 1) & -grid  # the last catcher before each suffix; at the first word there is none
        blind = np.zeros(0, np.int64)
        if block > 1:
            same = (at > 0) & (level.names[np.maximum(near - level.first, 0)] == names)
            blind = np.unique(near[same])
            near = near - grid
        same = (near >= 0) & (level.names[np.maximum(near - level.first, 0)] == names)
        hit = near[same]
        fresh = np.diff(hit, prepend=-1) != 0
        hit, period = hit[fresh], (at[same] - hit)[fresh]
        closed = np.concatenate([level.done, blind])
        if len(hit) and len(closed):
            free = ~np.isin(hit, closed)
            hit, period = hit[free], period[free]
        level.done = np.concatenate([closed, hit])
        if not len(hit):
            return
        # Neighbouring catchers that caught the same period lie in one run.
        head = np.concatenate([[True], (np.diff(hit) != grid) | (np.diff(period) != 0)])
        for start, d in zip(hit[head].tolist(), period[head].tolist()):
            self._catch(start, d)

    def _catch(self, start: int, d: int) -> None:
        for run in self.open:
            if run[2] == d and run[0] <= start:
                return  # a later catcher of a run that is still growing
        if self.found and any(p == d and a <= start and start + d < b for a, b, p in self.found[-4:]):
            return
        w = self.words
        run = [start - self._agree(w[:start][::-1], w[d:start + d][::-1]), 0, d]
        run[1] = start + d + self._agree(w[start:self.size - d], w[start + d:self.size])
        self._settle(run)

    @staticmethod
    def _agree(a: np.ndarray, b: np.ndarray) -> int:
        """Length of the common beginning."""
        done, step, n = 0, 64, min(len(a), len(b))
        while done < n:
            differ = a[done:min(n, done + step)] != b[done:min(n, done + step)]
            if differ.any():
                return done + int(differ.argmax())
            done, step = done + step, step * 2
        return n

    def _settle(self, run: list[int]) -> None:
        if run[1] == self.size:
            self.open.append(run)
        elif run[1] - run[0] >= max(LEAST, PERIODS * run[2]):
            self.found.append(tuple(run))

    def _advance(self, old: int) -> None:
        """Open runs go on with the words appended since ``old``."""
        growing, self.open = self.open, []
        for run in growing:
            d = run[2]
            run[1] = old + self._agree(self.words[old - d:self.size - d], self.words[old:self.size])
            self._settle(run)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, period) of the runs so far, by start and period."""
        ending = [tuple(r) for r in self.open if r[1] - r[0] >= max(LEAST, PERIODS * r[2])]
        return sorted(set(self.found + ending), key=lambda r: (r[0], r[2]))


def _find(carry: list[str]):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in slices(batches, "text"):
            texts = [t.split() for t in rows_of(batch, "text")]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            catchers = Catchers(int(sizes.max(initial=0)))
            numbers = defaultdict(count().__next__)
            first = np.concatenate([[0], np.cumsum(sizes + 1)])  # a word of its own, below zero, after each text
            stream = np.empty(first[-1], np.int64)
            for i, words in enumerate(texts):
                stream[first[i]:first[i + 1] - 1] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                stream[first[i + 1] - 1] = -1 - i
            while catchers.size < len(stream):  # pieces grow with what is there, so that old names are not copied often
                catchers.append(stream[catchers.size:catchers.size + max(STEP, catchers.size // 2)])
            runs: list[list] = [[] for _ in texts]
            gone: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for start, end, period in catchers.runs():
                i = int(np.searchsorted(first, start, "right")) - 1
                a = start - int(first[i])
                runs[i].append({"start": a, "length": end - start, "period": period})
                gone[i].append((a + period, a + end - start))
            for i, parts in gone.items():
                keep = np.ones(len(texts[i]), bool)
                for a, b in parts:
                    keep[a:b] = False
                texts[i] = [w for w, k in zip(texts[i], keep.tolist()) if k]
            collapsed = [b" ".join(words).decode() for words in texts]
            yield pa.record_batch([*[column(batch, c) for c in carry], pa.array(sizes), pa.array(runs, kind), pa.array(collapsed, pa.string())],
                                  names=[*carry, "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (doc_id), n_words, runs (start, length, period; by start, then period) and collapsed for every row of ``docs``.

    ``collapsed`` is the text without the words that a run holds after its first period, joined by single spaces.
    """
    carry = carry or ["doc_id"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(_find(carry), f"{kinds}, n_words long, runs {RUN}, collapsed string")
