"""SentencePiece encoding by sampling without replacement, and decoding.

The segmentations of a text are the paths of a lattice of pieces. Each path's log-probability gets Gumbel noise, and
the `k` largest are a sample without replacement. They are found best first, as in A* search: a node of the search is
a prefix of a path, its value is the largest perturbed log-probability below it, and the children of a node share that
value by conditional Gumbel noise, so that the first child to finish is the best. One child always has its parent's
value, so a search runs straight to the end of a text and leaves the other children behind as open nodes; the best
open node starts the next path. The value of the best node still open at the end is the threshold by which a path
is in the sample with probability 1 - exp(-exp(log-probability - threshold)).

No piece spans the start of a run of blanks or a line end, so a lattice is a chain of small ones. Those of units that
come again are kept from slice to slice, up to a bound; all that the texts of a slice have are walked together, in
NumPy. The noise is a hash of the row's key, the
path's number and the place in the lattice: it is the same wherever a row is processed.

The vocabulary is a merged one and has no probabilities: pieces get those of Zipf's law in the vocabulary's order, and
characters outside it are spelled in bytes, each as rare as the last piece.

Cases: a null text is empty, with one empty segmentation; a text with fewer than `k` segmentations gives all of them,
with inclusion 1; a null key counts as a key; rows equal in key and text get equal rows; an empty table gives an empty
result; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name

VOCABULARY = "piece_bpe_32k.model"
SAMPLES = 2
BLANK = "▁"
SCHEMA = "doc_id long, rank int, ids binary, log_prob double, perturbed double, inclusion double"
#: Characters in a slice and edges of lattices kept, which bound what a worker holds; rows taken at a time.
_SLICE, _EDGES, _ROWS = 200_000, 2_000_000, 1000
#: New units whose lattices are built together.
_UNITS = 4096


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `n` of each."""
    out = np.repeat(starts - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


class Vocabulary:
    """Pieces with ids and log-probabilities; all their prefixes by hash, so that substrings are looked up in arrays."""

    _STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        odd = [t for t in text.values() if re.search(f"[^{BLANK}]{BLANK}", t) or len(t) > 1 and "\n" in t]
        if odd:
            raise ValueError(f"pieces such as {odd[0]!r} span the units of a text")
        weight = np.log(1 / (np.arange(len(plain) + 256) + 10.0))
        weight -= np.log(np.exp(weight).sum())
        self.rare = float(weight[-1])
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [b""] * n
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        entries: dict[int, tuple[int, float]] = {}
        for rank, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i))):
            h, t = 0, text[i]
            self.raw[i] = t.replace(BLANK, " ").encode()
            for at, c in enumerate(t, 1):
                h = (h + ord(c) + 1) * int(self._STEP) % 2**64
                if at < len(t):
                    entries.setdefault(h, (-1, 0.0))
            entries[h] = (i, float(weight[rank]))
        order = sorted(entries)
        self.hashes = np.array([*order, 2**64 - 1], np.uint64)
        self.ids = np.array([*(entries[h][0] for h in order), -1])
        self.weights = np.array([*(entries[h][1] for h in order), 0.0])
        # Where hashes with given high bits begin: a look-up is one step of these and a short search.
        self.slots = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        self.lattices = Lattices(self)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the entries, -1 for none."""
        at = np.minimum(self.slots[(h >> np.uint64(46)).astype(np.int64)], len(self.hashes) - 1)
        own = self.hashes[at]
        out = np.where(own == h, at, -1)
        left = np.flatnonzero(own < h)
        at, h = at[left] + 1, h[left]
        while len(left):
            own = self.hashes[np.minimum(at, len(self.hashes) - 1)]
            hit = own == h
            out[left[hit]] = at[hit]
            on = own < h
            left, at, h = left[on], at[on] + 1, h[on]
        return out

    def spelled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids as little-endian unsigned 16-bit integers, and how many each code has."""
        odd, width = codes < 0, np.ones(len(codes), np.int64)
        if odd.any():
            spelled = [chr(-1 - c).encode() for c in codes[odd].tolist()]
            width[odd] = [len(b) for b in spelled]
            codes, odd = np.repeat(codes, width), np.repeat(odd, width)
            codes[odd] = [self.bytes[b] for b in b"".join(spelled)]
        return codes.astype("<u2"), width


class Lattices:
    """The lattices of units of text as one set of arrays: nodes are the places of characters and of the ends, edges
    are sorted by node; an edge has its length, its code (an id, or less than 0 for a character spelled in bytes) and
    its conditional log-probability: its own and that of all that can follow, over the node's. Units are found by a
    hash and compared. Arrays have room for more at their ends."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0):
        self.vocabulary, self.seed, self.n_nodes, self.n_edges = vocabulary, seed, 0, 0
        self.hashes, self.by_hash = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their units
        self.bases, self.uses = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.first, self.chars = np.empty(_EDGES // 2, np.int64), np.empty(_EDGES // 2, np.uint32)
        self.length, self.code, self.logq = np.empty(_EDGES, np.int32), np.empty(_EDGES, np.int32), np.empty(_EDGES)
        self.first[0] = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old, n = getattr(self, name), at + len(values)
        if n > len(old):
            setattr(self, name, np.concatenate([old[:at], np.empty(n + n // 4 - at, old.dtype)]))
        getattr(self, name)[at:n] = values

    def hashed(self, chars: np.ndarray, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Hashes of units by their characters and the characters' places."""
        key = chars * np.uint64(0xD1342543DE82EF95)
        key += place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed + 1)
        return np.add.reduceat(mixed(key), begin)

    def numbered(self, chars: np.ndarray, begin: np.ndarray) -> np.ndarray | None:
        """The numbers of the units that begin at some of the characters; those that are new get their lattices. None if
        two units have one hash."""
        if not len(begin):
            return begin
        n, size = len(self.by_hash), np.diff(begin, append=len(chars))
        place = spread(np.zeros(len(size), np.int64), size)
        hashes = self.hashed(chars, place, begin)
        order = np.argsort(hashes)
        hashes = hashes[order]
        is_first = np.diff(hashes, prepend=~hashes[:1]) != 0
        one, hashes = order[is_first], hashes[is_first]
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        known[at < n] = self.hashes[at[at < n]] == hashes[at < n]
        number = np.empty(len(hashes), np.int64)
        number[known] = self.by_hash[at[known]]
        new = one[~known]
        number[~known] = n + np.arange(len(new))
        self.hashes, self.by_hash = np.insert(self.hashes, at[~known], hashes[~known]), np.insert(self.by_hash, at[~known], number[~known])
        for i in range(0, len(new), _UNITS):
            units = new[i : i + _UNITS]
            self._add(n + i, chars[spread(begin[units], size[units])], size[units])
        out = np.empty(len(order), np.int64)
        out[order] = number[np.cumsum(is_first) - 1]
        self._put("uses", n, np.zeros(len(new), np.int32))
        self.uses[number] += 1
        base = self.bases[out]
        same = (self.bases[out + 1] - base - 1 == size).all() and (self.chars[np.repeat(base, size) + place] == chars).all()
        return out if same else None

    def kept(self) -> "Lattices":
        """These while they are within the bound, else new ones of the units that most slices use."""
        if self.n_edges <= _EDGES:
            return self
        n, uses = len(self.by_hash), self.uses
        size = np.diff(self.first[self.bases[: n + 1]])
        units = np.arange(n)
        while int(size[units].sum()) > _EDGES // 2:
            uses = uses >> 1
            units = np.flatnonzero(uses[:n])
        out, lo, sizes = Lattices(self.vocabulary, self.seed), self.bases[units], np.diff(self.bases[: n + 1])[units]
        nodes, edges = spread(lo, sizes), spread(self.first[lo], size[units])
        number = np.full(n, -1)
        number[units] = np.arange(len(units))
        number = number[self.by_hash]
        out.hashes, out.by_hash, out.n_nodes, out.n_edges = self.hashes[number >= 0], number[number >= 0], len(nodes), len(edges)
        out._put("uses", 0, uses[units])
        out._put("bases", 0, np.concatenate([[0], np.cumsum(sizes)]))
        out._put("first", 0, np.concatenate([[0], np.cumsum(self.first[nodes + 1] - self.first[nodes])]))
        out._put("chars", 0, self.chars[nodes])
        for name in ("length", "code", "logq"):
            out._put(name, 0, getattr(self, name)[edges])
        return out

    def _add(self, number: int, chars: np.ndarray, sizes: np.ndarray) -> None:
        vocabulary, chars = self.vocabulary, chars.astype(np.int64)
        values = chars.astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(sizes)
        end, node = np.repeat(ends, sizes), np.arange(len(chars)) + np.repeat(np.arange(len(sizes)), sizes)  # an end node follows each unit
        at, h, found, length = np.arange(len(chars)), np.zeros(len(chars), np.uint64), [], 0
        while len(at):
            h = (h + values[at + length]) * Vocabulary._STEP
            length += 1
            entry = vocabulary.find(h)
            piece = np.where(entry >= 0, vocabulary.ids[entry], -1)
            if length == 1:
                wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
                found.append((at, np.where(piece >= 0, piece, -1 - chars), np.where(piece >= 0, vocabulary.weights[entry], vocabulary.rare * wide)))
            else:
                is_piece = np.flatnonzero(piece >= 0)
                found.append((at[is_piece], piece[is_piece], vocabulary.weights[entry[is_piece]]))
            on = np.flatnonzero((entry >= 0) & (at + length < end[at]))
            at, h = at[on], h[on]
        counts = np.zeros(len(chars), np.int64)
        for where, _, _ in found:  # a length has one edge a node at most
            counts[where] += 1
        # Nodes by their distance from the end: what can follow is known from the ends backward, all units at once.
        back = end - np.arange(len(chars))
        most_back = int(back.max(initial=0))
        by = np.argsort(back.astype(np.uint16) if most_back < 1 << 16 else back, kind="stable")
        n_by, node_by = counts[by], node[by]
        starts_by = np.cumsum(n_by) - n_by
        fill = np.empty(len(chars), np.int64)
        fill[by] = starts_by
        n_edges = int(n_by.sum())
        lengths, code, logq, target = np.empty(n_edges, np.int32), np.empty(n_edges, np.int32), np.empty(n_edges), np.empty(n_edges, np.int64)
        for step, (where, codes, w) in enumerate(found, 1):
            place = fill[where]
            fill[where] = place + 1
            lengths[place], code[place], logq[place], target[place] = step, codes, w, node[where] + step
        n_nodes = len(chars) + len(sizes)
        rest = np.zeros(n_nodes)
        cuts = [0, *np.cumsum(np.bincount(back)[1:]).tolist()] if len(chars) else [0]
        for a, b in zip(cuts, cuts[1:]):
            lo, n = int(starts_by[a]), n_by[a:b]
            starts, total = starts_by[a:b] - lo, logq[lo : int(starts_by[b - 1] + n_by[b - 1])]
            total += rest[target[lo : lo + len(total)]]
            most = np.maximum.reduceat(total, starts)
            total -= np.repeat(most, n)
            sums = np.log(np.add.reduceat(np.exp(total), starts))
            rest[node_by[a:b]] = most + sums
            total -= np.repeat(sums, n)
        np.minimum(logq, 0.0, out=logq)
        order = spread(fill - counts, counts)
        all_counts, all_chars = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.uint32)
        all_counts[node], all_chars[node] = counts, chars
        self._put("bases", number, self.n_nodes + np.concatenate([[0], np.cumsum(sizes + 1)]))
        self._put("first", self.n_nodes, self.n_edges + np.concatenate([[0], np.cumsum(all_counts)]))
        self._put("chars", self.n_nodes, all_chars)
        for name, values in (("length", lengths), ("code", code), ("logq", logq)):
            self._put(name, self.n_edges, values[order])
        self.n_nodes += n_nodes
        self.n_edges += n_edges


#: Log-probability of prefixes below which open nodes are looked at only if need be, and a bound of the noise.
_FAR, _NOISE = -95.0, 90.0


def mixed(key: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit keys."""
    key = key ^ key >> np.uint64(30)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(27)
    key *= np.uint64(0x94D049BB133111EB)
    key ^= key >> np.uint64(31)
    return key


def waiting(key: np.ndarray) -> np.ndarray:
    """Exponential times with mean 1 from 64-bit keys; -log of them is standard Gumbel noise."""
    key = mixed(key)
    key >>= np.uint64(11)
    even = key.astype(np.float64)
    even *= 2.0**-53
    even += 2.0**-54
    np.log(even, out=even)
    return np.negative(even, out=even)


def below(value: np.ndarray, noisy: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Noisy values conditioned to have the maximum `value` in place of `most`."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = value - noisy + np.log1p(-np.exp(np.minimum(0.0, noisy - most)))
        return value - np.maximum(0.0, v) - np.log1p(np.exp(-np.abs(v)))


class Search:
    """The best paths of several texts at once."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str], seeds: list[int], k: int):
        self.k, self.seeds = k, np.array(seeds, np.uint64)
        chars = np.frombuffer("".join(BLANK + t for t in texts if t).replace(" ", BLANK).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        # A unit is a line end, or a run of blanks and what follows up to the next blank or line end.
        blank, line = chars == ord(BLANK), chars == ord("\n")
        begins = blank | line
        begins[1:] &= ~blank[:-1] | line[1:]
        begins[1:] |= line[:-1]
        begins[ends[:-1][ends[:-1] < len(chars)]] = True
        begin = np.flatnonzero(begins)
        lattices = vocabulary.lattices.kept()
        while (unit := lattices.numbered(chars, begin)) is None:
            lattices = Lattices(vocabulary, lattices.seed + 1)
        self.lattices, self.unit, self.end = lattices, unit, np.searchsorted(begin, ends)
        vocabulary.lattices = lattices
        self.start = np.concatenate([[0], self.end[:-1]])
        self.doc = np.repeat(np.arange(len(texts)), self.end - self.start)

    def descend(self, unit: np.ndarray, place: np.ndarray, path: int):
        """Follow the best child from each (unit, place) to the unit's end. Of every node met, by unit: its unit and
        place, the chosen edge, where its edges' waiting times begin, and how many there are; where the nodes of each
        unit begin; and the times of all edges. Of exponential times with the edges' probabilities as rates the least
        wins; -log of a time is Gumbel noise."""
        lattices = self.lattices
        first, length, logq, base = lattices.first, lattices.length, lattices.logq, lattices.bases[self.unit[unit]]
        number = (unit - self.start[self.doc[unit]]).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        number += self.seeds[self.doc[unit]] + np.uint64(path * 0x632BE59BD9B4E019 % 2**64)
        out, held, done = [], [], 0
        while True:
            node = base + place
            lo = first[node]
            n = first[node + 1] - lo
            on = np.flatnonzero(n)
            if len(on) < len(n):
                unit, place, base, lo, n, number = unit[on], place[on], base[on], lo[on], n[on], number[on]
            if not len(unit):
                break
            starts = np.cumsum(n) - n
            edge = np.repeat(lo - starts, n)
            edge += np.arange(len(edge))
            key = np.repeat(number + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), n)
            far = length[edge]
            key += far.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            time = waiting(key)
            time *= np.exp(-logq[edge])
            least = np.minimum.reduceat(time, starts)
            top = np.flatnonzero(time == np.repeat(least, n))
            if len(top) > len(n):  # a tie: the first
                top = top[np.searchsorted(top, starts)]
            chosen = edge[top]
            out.append((unit, place, chosen, starts + done, n))
            held.append(time)
            done += len(time)
            place = place + far[top]
        if not out:
            return [np.zeros(0, np.int64)] * 5, np.zeros(len(self.unit) + 1, np.int64), np.zeros(0)
        unit = np.concatenate([x[0] for x in out])
        begin = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(self.unit)))])
        order = np.empty(len(unit), np.int64)
        order[begin[unit] + np.repeat(np.arange(len(out)), [len(x[0]) for x in out])] = np.arange(len(unit))
        return [np.concatenate(x)[order] for x in zip(*out)], begin, np.concatenate(held)

    def opened(self, text: np.ndarray, node: tuple, prefix: np.ndarray, value: np.ndarray, time: np.ndarray, keep: int):
        """The `keep` best children not taken of some nodes of each text, the best first, as arrays: text, value, node
        (its place among these) and edge. Nodes are as `descend` gives them."""
        unit, place, chosen, at, n = node
        rep, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        edge = spread(self.lattices.first[self.lattices.bases[self.unit[unit]] + place], n)
        noisy = prefix[rep] - np.log(time[spread(at, n)])
        most = np.maximum.reduceat(noisy, starts) if len(n) else noisy
        other = np.flatnonzero(edge != chosen[rep])
        rep, edge = rep[other], edge[other]
        v = below(value[rep], noisy[other], most[rep])
        v[np.isnan(v)] = -np.inf  # a value that is none counts last
        # What is less than the `keep` greatest values of its text is left out before they are put in order.
        own, left = text[rep], v.copy()
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(begin, append=len(own))
        for _ in range(keep if len(own) else 0):
            bar = np.repeat(np.maximum.reduceat(left, begin), size)
            left[left == bar] = -np.inf
        best = np.flatnonzero(v >= bar) if len(own) else np.zeros(0, np.int64)
        best = best[np.lexsort((-v[best], own[best]))]
        own = own[best]
        best = best[np.arange(len(own)) - np.searchsorted(own, own) < keep]
        return text[rep[best]], v[best], rep[best], edge[best]

    def paths(self) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """Of each text, its paths as (edges, log-probability, perturbed), and the threshold."""
        length, logq = self.lattices.length, self.lattices.logq
        n_docs = len(self.end)
        found: list[list] = [[] for _ in range(n_docs)]
        open_: list[list] = [[] for _ in range(n_docs)]  # (-value, path, edge, node in the path, units of the path, place after)
        roots = -np.log(waiting(self.seeds * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)))
        # (text, value, edges of the prefix, units of the prefix, unit and place to go on from)
        todo = [(d, float(roots[d]), np.zeros(0, np.int64), np.zeros(0, np.int64), int(self.start[d]), 0) for d in range(n_docs)]
        for path in range(self.k):
            begin, counts = np.array([t[4] for t in todo]), np.array([self.end[t[0]] - t[4] for t in todo])
            at = np.cumsum(counts) - counts
            unit = spread(begin, counts)
            place, some = np.zeros(len(unit), np.int64), counts > 0
            place[at[some]] = np.array([t[5] for t in todo])[some]
            nodes, where, time = self.descend(unit, place, path)
            u, places, chosen = nodes[:3]
            lo, hi = where[begin].tolist(), where[begin + counts].tolist()
            gained, keep, values = logq[chosen], self.k - path, np.array([t[1] for t in todo])
            befores = [float(logq[t[2]].sum()) for t in todo]
            prefixes = [before + np.cumsum(gained[a:b]) - gained[a:b] for before, a, b in zip(befores, lo, hi)]
            # What is open below an unlikely prefix is no better than the prefix and the largest noise; where that
            # could still be among the best, all nodes count.
            reach = np.array([np.searchsorted(-x, -_FAR) for x in prefixes])
            whole, new = np.array(hi) - lo, [[] for _ in todo]
            for full in (False, True):
                which = np.arange(len(todo)) if not full else np.flatnonzero([r < w and not (len(x) == keep and x[-1][0] > _FAR + _NOISE) for r, w, x in zip(reach, whole, new)])
                n = (whole if full else reach)[which]
                if not n.any():
                    continue
                pick, text = spread(np.array(lo)[which], n), np.repeat(which, n)
                prefix = np.concatenate([prefixes[i][:m] for i, m in zip(which.tolist(), n.tolist())])
                for i in which.tolist():
                    new[i] = []
                for i, v, at_, e in zip(*(x.tolist() for x in self.opened(text, [x[pick] for x in nodes], prefix, values[text], time, keep))):
                    new[i].append((v, int(pick[at_]) - lo[i], e))
            after = []
            for (d, value, edges, units, _, _), before, a, b, children in zip(todo, befores, lo, hi, new):
                full_units = np.concatenate([units, u[a:b]])
                found[d].append((np.concatenate([edges, chosen[a:b]]), before + float(gained[a:b].sum()), value))
                for v, node, e in children:
                    heapq.heappush(open_[d], (-v, path, e, len(edges) + node, len(found[d]) - 1, full_units, int(places[a + node] + length[e])))
                if path + 1 < self.k and open_[d]:
                    minus, _, e, p, which, of, then = heapq.heappop(open_[d])
                    after.append((d, -minus, np.append(found[d][which][0][:p], e), np.append(of[:p], of[p]), int(of[p]), then))
            todo = after
            if not todo:
                break
        return [(paths, -o[0][0] if o else -np.inf) for paths, o in zip(found, open_)]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, of which a worker holds less at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


_VOCABULARIES: dict[str | None, Vocabulary] = {}


def vocabulary_of(path: str | None) -> Vocabulary:
    """One for each worker and file; the public one where no path is given, found on the worker's own machine."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path or public_tokenizers.path(VOCABULARY))
    return _VOCABULARIES[path]


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, vocabulary: str | None = None, seed: int = 0) -> DataFrame:
    """Up to `k` distinct segmentations of each document, best first: ids (little-endian unsigned 16-bit), the
    log-probability, its perturbed value, and the probability of being in the sample at the threshold met."""
    where = vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(where)
        for batch in parts(batches):
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop] or "") < _SLICE):
                    size += len(texts[stop] or "")
                    stop += 1
                seeds = [xxhash.xxh3_64_intdigest(repr(x).encode(), seed) for x in keys[at:stop]]
                rows, edges, search = [], [], Search(vocabulary, [t or "" for t in texts[at:stop]], seeds, k)
                for x, (paths, threshold) in zip(keys[at:stop], search.paths()):
                    for rank, (path, log_prob, value) in enumerate(paths, 1):
                        inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(700.0, log_prob - threshold))))
                        rows.append((x, rank, log_prob, value, inclusion))
                        edges.append(path)
                ids, width = vocabulary.spelled(search.lattices.code[np.concatenate(edges)])
                stops = np.concatenate([[0], 2 * np.cumsum(width)])[np.cumsum([0, *map(len, edges)])].astype(np.int32)
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                columns.insert(2, pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(stops), pa.py_buffer(ids)]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion"])
                at = stop

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(encode, SCHEMA)


def texts_of(raw: pa.Array, ids: pa.Array) -> pa.Array:
    """The texts of lists of ids, whose bytes are in `raw`."""
    given = pc.fill_null(ids.cast(pa.large_binary()), b"")
    _, stops, data = given.buffers()
    stops = np.frombuffer(stops, np.int64)[given.offset : given.offset + len(given) + 1]
    if ((stops - stops[0]) % 2).any():
        raise ValueError("ids are not of two bytes each")
    pieces = raw.take(pa.array(np.frombuffer(data or b"", "<u2", int(stops[-1] - stops[0]) // 2, int(stops[0]))))
    _, ends, data = pieces.buffers()
    ends, data = np.frombuffer(ends, np.int32)[(stops - stops[0]) // 2], np.frombuffer(data or b"", np.uint8)
    begins = ends[:-1]
    some = begins < ends[1:]
    some[some] = data[begins[some]] == ord(" ")  # the blank in front is the encoder's
    left = np.delete(data[: ends[-1]], begins[some])
    ends = ends - np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(given), [None, pa.py_buffer(ends), pa.py_buffer(left)])
    try:
        out = out.cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.decode(errors="replace") for x in out.to_pylist()], pa.string())
    return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string())) if ids.null_count else out


def decoded(rows: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows with the text of their ids as `text`, or under the first free name of that with underscores behind it;
    null ids give a null text."""
    where, names = vocabulary, rows.columns
    new = free_name(names, "text")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pa.array(vocabulary_of(where).raw, pa.binary())
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts_of(raw, batch.column(ids))], [*names, new])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(decode, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{new}` string"]))


def op2_gumbel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all documents: their scores, a checksum of their ids, and the checksum of the text that these decode to."""
    rows = decoded(sampled(documents(spark, sf_dir)))
    return rows.select(
        "doc_id", "rank", (F.octet_length("ids") / 2).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.round("log_prob", 6).alias("log_prob"), F.round("perturbed", 6).alias("perturbed"), F.round("inclusion", 6).alias("inclusion"),
    )
