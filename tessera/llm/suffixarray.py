"""Induced suffix sorting with common-prefix values, by bucket queues that go to disk.

Suffixes that are left-most S (LMS) are sorted first. Their substrings are sorted by induction and named in order; if
names repeat, the string of names is sorted by this same method, level by level, until it has at most BASE names, which
are sorted in memory by doubling. Each level hands its order and its common prefixes up: so many equal names are so
many symbols of the level above, and only the rest of one substring is compared there. Larger-than-next (L) and then smaller-than-next (S) suffixes are induced from the LMS suffixes.

A queue holds, for each first symbol, the suffixes still to be scanned in their final order: induction inserts them in
order, so a priority queue by (symbol, rank of the rest) is a row of first-in first-out queues. Each entry is a tuple
of the suffix's place and its common prefix with the entry before it, which induction derives as one more than the
least value scanned since that entry. Queues of over ``memory`` bytes are written to a scratch file of the task, as are
the L suffixes that wait for the second scan; single arrays (text, types, names, the result) of over ``memory`` bytes
are mapped files. Such files have no name and end with the sort. One batch of a queue, as an array, induces into all
queues at once.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Names that are sorted in memory, by doubling, instead of by one more level.
BASE = 1 << 20


def empty(n: int, dtype, memory: int) -> np.ndarray:
    """An array, in a mapped file without a name if it is larger than ``memory``."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile(prefix="sort-") as f:
        return np.memmap(f, dtype, "w+", shape=(n,))


class Spool:
    """First-in first-out batches of (place, common prefix); the older ones go to disk when memory runs out."""

    spilled = 0  # bytes, of all spools of this process

    def __init__(self, symbols: int, memory: int):
        self.batches: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, symbol: int, place: np.ndarray, prefix: np.ndarray) -> None:
        self.batches[symbol].append((place, prefix))
        self.held += place.nbytes + prefix.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="spool-")
        self.file.seek(0, 2)
        at = self.file.tell()
        for queue in self.batches:
            for k, entry in enumerate(queue):
                if len(entry) == 2:
                    queue[k] = (at, len(entry[0]), entry[0].dtype, entry[1].dtype)
                    at += self.file.write(entry[0].tobytes()) + self.file.write(entry[1].tobytes())
        Spool.spilled += self.held
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All batches of a symbol, in order."""
        queue, self.batches[symbol] = self.batches[symbol], []
        parts = []
        for entry in queue:
            if len(entry) == 4:
                at, n, a, b = entry
                self.file.seek(at)
                entry = np.frombuffer(self.file.read(n * a.itemsize), a), np.frombuffer(self.file.read(n * b.itemsize), b)
            else:
                self.held -= entry[0].nbytes + entry[1].nbytes
            parts.append(entry)
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


class _Minima:
    """Least common prefix between any two places of a scanned batch."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= longest:
            v, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-step], v[step:]) if len(v) > step else v)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least value in (start, end], for start < end."""
        size = end - start
        out = self.levels[0][end]
        more = np.flatnonzero(size > 1)
        for k, v in enumerate(self.levels):
            if not len(more):
                break
            a, b = start[more], end[more]
            now = size[more] < 2 << k
            out[more[now]] = np.minimum(v[a[now] + 1], v[b[now] - (1 << k) + 1])
            more = more[~now]
        return out


class Sorter:
    """Suffix array of a string of small integers whose last symbol is the only least one.

    limit: common prefixes are counted up to this many symbols. memory: bytes of a queue, or of an array, in memory.
    """

    def __init__(self, text: np.ndarray, limit: int, memory: int = 64 << 20):
        # symbols that are there, renumbered in order: a byte each, nearly always
        used = np.bincount(text) > 0
        self.symbols = int(used.sum())
        self.limit, self.memory = limit, memory
        dtype = next(t for t in (np.uint8, np.uint16, np.uint32) if self.symbols <= 1 << 8 * np.dtype(t).itemsize)
        n = len(text)
        padded = empty(n + 8, dtype, memory)
        padded[:n] = (np.cumsum(used) - 1).astype(dtype)[text]
        padded[n:] = 0
        self.text = text = padded[:n]
        #: the eight bytes from each symbol on, without copying
        self.words = np.ndarray((n,), "<u8", padded, strides=(padded.itemsize,))
        # S: smaller than the next suffix. A run of equal symbols has the type of its last one.
        up = np.ones(n, bool)
        up[:-1] = text[1:] > text[:-1]
        tells = np.ones(n, bool)
        tells[:-1] = text[1:] != text[:-1]
        at = np.where(tells, np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), n)
        self.is_s = empty(n, bool, memory)
        self.is_s[:] = up[np.minimum.accumulate(at[::-1])[::-1]]
        self.is_lms = empty(n, bool, memory)
        self.is_lms[0] = False
        self.is_lms[1:] = self.is_s[1:] & ~self.is_s[:-1]

    def _push(self, spool: Spool, since: np.ndarray | None, place: np.ndarray, prefix: np.ndarray, want_s: bool) -> None:
        """Induce from a scanned batch: entries before ``place`` of the wanted type go to the queues of their symbols. since: None if prefixes don't matter."""
        cap = self.limit
        ok = place > 0
        before = np.where(ok, place - 1, 0)
        ok &= self.is_s[before] == want_s
        at = np.flatnonzero(ok)
        if len(at):
            before = before[at]
            symbol = self.text[before]
            order = np.argsort(symbol, kind="stable")
            symbol, before, at = symbol[order], before[order], at[order]
            new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
            first = np.flatnonzero(new)
            value = np.zeros(len(at), np.uint16)
            if since is None:
                cuts = np.append(first, len(at)).tolist()
                for s, a, b in zip(symbol[first].tolist(), cuts[:-1], cuts[1:]):
                    spool.put(s, before[a:b], value[a:b])
                return
            rest = np.flatnonzero(~new)
            if len(rest):
                gap = at[rest] - at[rest - 1]
                value[rest] = _Minima(prefix, int(gap.max())).between(at[rest - 1], at[rest])
            low = np.minimum.accumulate(prefix)
            own = symbol[first].astype(np.int64)
            value[first] = np.minimum(since[own], low[at[first]])
            value = np.minimum(value.astype(np.int32) + 1, cap).astype(np.uint16)
            cuts = np.append(first, len(at))
            tail = np.minimum.accumulate(prefix[::-1])[::-1]
            after = np.append(tail[1:], cap).astype(np.uint16)
            since[:] = np.minimum(since, low[-1])
            since[own] = after[at[cuts[1:] - 1]]
            for s, a, b in zip(own.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                spool.put(s, before[a:b], value[a:b])
        elif since is not None:
            since[:] = np.minimum(since, prefix.min())

    def agree(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to ``most``, which are known to agree for some symbols; eight bytes at a time."""
        out = np.minimum(known, most).astype(np.int64)
        live = np.flatnonzero(out < most)
        wide = self.text.itemsize
        while len(live):
            now = out[live]
            differ = self.words[a[live] + now] ^ self.words[b[live] + now]
            same = differ == 0
            steps = np.where(same, 8 // wide, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // (8 * wide))
            out[live] = np.minimum(now + steps, most[live])
            live = live[same & (out[live] < most[live])]
        return out

    def compare(self, a: int, b: int) -> int:
        """Common prefix of two suffixes, up to the limit."""
        n = min(self.limit, len(self.text) - max(a, b))
        differ = np.flatnonzero(self.text[a : a + n] != self.text[b : b + n])
        return int(differ[0]) if len(differ) else n

    def induce(self, lms: np.ndarray, lms_prefix: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and common prefixes with the entry before, from LMS suffixes in order."""
        cap, n = self.limit, len(self.text)
        first = np.searchsorted(self.text[lms], np.arange(self.symbols + 1))  # LMS suffixes are in order of their symbol
        compare = self.compare if exact else lambda a, b: 0
        spool, larger = Spool(self.symbols, self.memory), Spool(self.symbols, self.memory)
        # since[c]: least common prefix scanned since the last entry of queue c; 0 at first, as that entry has none before it
        since = np.zeros(self.symbols, np.uint16) if exact else None
        for c in range(self.symbols):
            last = None
            while (batch := spool.take(c)) is not None:
                place, prefix = batch
                if last is None:
                    prefix = prefix.copy()
                    prefix[0] = 0
                last = int(place[-1])
                larger.put(c, place, prefix)
                self._push(spool, since, place, prefix, False)
            a, b = int(first[c]), int(first[c + 1])
            if b > a:
                prefix = lms_prefix[a:b].copy()
                prefix[0] = min(compare(last, int(lms[a])), cap) if last is not None else 0
                self._push(spool, since, lms[a:b], prefix, False)
        # S suffixes, from the largest down; an entry's value is its common prefix with the entry above it
        spool = Spool(self.symbols, self.memory)
        since = np.zeros(self.symbols, np.uint16) if exact else None
        order, common, end = empty(n, lms.dtype, self.memory), empty(n, np.uint16, self.memory), n

        def out(place: np.ndarray, prefix: np.ndarray) -> None:
            nonlocal end
            order[end - len(place) : end] = place
            common[end - len(place) : end] = prefix
            end -= len(place)

        for c in range(self.symbols - 1, -1, -1):
            done = []
            while (batch := spool.take(c)) is not None:
                place, prefix = batch
                if not done:
                    prefix = prefix.copy()
                    prefix[0] = 0
                done.append((place, prefix))
                self._push(spool, since, place, prefix, True)
            below = larger.take(c)
            place = None
            if done:
                place, prefix = (np.concatenate(x)[::-1] for x in zip(*done))
                prefix = np.concatenate([[0], prefix[:-1]]).astype(np.uint16)  # now with the entry below
            if below is not None:
                p, v = below
                down = np.empty_like(v)
                down[1:] = v[::-1][:-1]
                down[0] = min(compare(int(p[-1]), int(place[0])), cap) if place is not None else 0
                if place is not None:
                    prefix[0] = down[0]
                    out(place, prefix)
                self._push(spool, since, p[::-1], down, True)
                out(p, v)
            elif place is not None:
                out(place, prefix)
            elif first[c + 1] > first[c]:  # the least symbol of all
                own = lms[first[c] : first[c + 1]]
                out(own, np.zeros(len(own), np.uint16))
                self._push(spool, since, own, np.zeros(len(own), np.uint16), True)
        return order, common

    def names(self, lms: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of the LMS substrings, in text order: equal substrings have equal names, and names sort as they do."""
        order = self.induce(lms[np.argsort(self.text[lms], kind="stable")], np.zeros(len(lms), np.uint16), False)[0]
        order = order[self.is_lms[order]]
        number = np.searchsorted(lms, order)
        size = np.append(np.diff(lms), 0) + 1  # a substring ends with the first symbol of the next one
        size = size[number]
        least = np.minimum(size[:-1], size[1:]).astype(np.int64)
        same = (size[:-1] == size[1:]) & (self.agree(order[:-1], order[1:], np.zeros(len(least), np.int64), least) == least)
        name = np.concatenate([[0], np.cumsum(~same)])
        out = empty(len(lms), np.int64, self.memory)
        out[number] = name
        return out, int(name[-1]) + 1

    def ranked(self, name: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the LMS suffixes in order, and how many names each shares with the one before, by recursion."""
        m = len(name)
        if count == m:
            return np.argsort(name), np.zeros(m, np.int64)
        if m <= BASE:
            return doubled(name, count, self.limit // 2 + 1)
        # a name is one symbol, or two digits where that keeps the alphabet small and the string still shrinks
        digits = 2 if count > 512 and 10 * m < 4 * len(self.text) else 1
        base = int(np.ceil(np.sqrt(count))) if digits == 2 else count
        text = empty(digits * m + 1, np.int64, self.memory)
        text[-1] = 0
        text[:-1:digits] = name // base + 1 if digits == 2 else name + 1
        if digits == 2:
            text[1:-1:2] = name % base + 1
        order, common = Sorter(text, self.limit + 2, self.memory).sort()
        at = np.flatnonzero(order[1:] % digits == 0) + 1  # without the end
        shared = np.zeros(m, np.int64)
        if m > 1:
            shared[1:] = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) // digits
        return order[at] // digits, shared

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, common prefixes): entry k shares that many first symbols with entry k - 1."""
        n = len(self.text)
        if n == 1:
            return np.zeros(1, np.int64), np.zeros(1, np.uint16)
        lms = np.flatnonzero(self.is_lms).astype(np.int32 if n < 1 << 31 else np.int64)
        number, shared = self.ranked(*self.names(lms))
        order = lms[number]
        prefix = np.zeros(len(lms), np.uint16)
        if len(lms) > 1:
            known = lms[np.minimum(number + shared, len(lms) - 1)] - order  # symbols of the shared names
            prefix[1:] = self.agree(order[:-1], order[1:], known[1:].astype(np.int64), np.full(len(lms) - 1, self.limit))
        return self.induce(order, prefix, True)


def doubled(name: np.ndarray, count: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a string of names, and common prefixes as far as powers of two tell (up to ``limit``), by doubling.

    A name stands for two symbols at least but the last, so ``limit`` names are enough for twice as many symbols.
    """
    order, step, shared = None, 1, np.zeros(len(name), np.int64)
    while True:
        second = np.zeros(len(name), np.int64)
        second[:-step] = name[step:] + 1
        pair = name * (count + 1) + second
        order = np.argsort(pair, kind="stable")
        same = np.concatenate([[False], np.diff(name[order]) == 0])
        shared[same] = np.maximum(shared[same], step)  # neighbours of one name agree on that many
        pair = pair[order]
        ranks = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
        name = np.empty_like(name)
        name[order] = ranks
        count = int(ranks[-1]) + 1
        step *= 2
        if count == len(name) or step >= limit:
            same = np.concatenate([[False], np.diff(ranks) == 0])
            shared = np.where(same, step, np.where(order >= 0, shared, 0))
            return order, shared
