"""SentencePiece encoding and decoding with batched Viterbi in numpy.

A text's normal form is cut into units, each a run of word marks and what follows it up to the next mark; no piece spans
two units (checked when a model is read). Units of more than LONG characters, as scripts without spaces have them, are cut
further wherever no piece holds the two characters beside the cut: no path and no merge crosses there. Distinct units are
encoded once, those of equal length together: for each end position and each piece length, hashes of the substrings probe
the sorted hashes of the pieces, hits are compared with the pieces' text, and maxima over the lengths give scores and
backpointers for all units at once. Where only a few units share a length above LONG, all substrings of one unit probe
together instead, and the maxima go over the hits.

What makes a path best depends on the model's type:
* unigram models: the sum of the pieces' scores;
* BPE models: the sum of ranks doesn't give the model's own segmentation, which merges the best adjacent pair until none
  is left. Its paths are those whose neighbouring pieces would not have merged otherwise; there is exactly one to each
  position. So an edge is admitted (score 0, else minus infinity) if the piece and the last one of the path to its start
  are compatible, which unwinds both pieces' merges in step. The maxima then run over one finite entry.
Characters outside the vocabulary end a unit's lattice edge by edge: each is its own edge and becomes its UTF-8 byte pieces, or
the unknown piece in a model without them.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.llm.common import fresh, named, table, task

MARK = "▁"
#: Where the public model is; a parameter of the query.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE_UNITS = 150_000
LONG, FEW = 48, 4
SLICE, TOGETHER = 1 << 20, 4  # bytes of text in a slice; slices whose units are encoded together

# Fixed values of the model format: field numbers, model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes):
    """(number, value) of a protobuf message: integers, raw bytes, or 4- and 8-byte strings."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + n]
            i += n


class Model:
    """Pieces, scores, types and the options used here, read from a .model file's bytes."""

    def __init__(self, data: bytes):
        import struct

        self.pieces, self.scores, self.types = [], [], []
        self.type, self.dummy, self.squeeze, self.byte_fallback = UNIGRAM, True, True, False
        charsmap = b""
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                self.type = spec.get(3, UNIGRAM)
                self.byte_fallback = bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("models with white space as a suffix aren't supported")
            elif number == 3:
                spec = dict(fields(value))
                charsmap = spec.get(2, b"")
                self.dummy, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if not spec.get(5, 1):
                    raise ValueError("models that don't escape white space aren't supported")
        if charsmap:
            raise ValueError("models with a character map aren't supported")
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("unigram and BPE models are supported")
        self.unk = self.types.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}

    def normal(self, text: str) -> str:
        """The text as the model sees it."""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", MARK)


SPREAD = 0xD6E8FEB86659FD93


def spread_bits(x):
    """A bijection of uint64 that brings all bits of x into the leading ones, which serve as buckets."""
    import numpy as np

    return x * np.uint64(SPREAD)


class Index:
    """Sorted keys with a table of where each leading-bits bucket starts; find() gives positions, -1 if absent."""

    def __init__(self, keys, bits: int):
        import numpy as np

        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.uint64(0))
        self.shift = np.uint64(64 - bits)
        bucket = (self.keys[:-1] >> self.shift).astype(np.int64)
        self.start = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.int32)
        self.taken = np.diff(self.start) > 0  # most probes end at this table of bytes
        self.most = int(np.diff(self.start).max())

    def find(self, h):
        import numpy as np

        out = np.full(len(h), -1, np.int32)
        b = (h >> self.shift).astype(np.int32)
        live = np.flatnonzero(self.taken[b])
        if not len(live):
            return out
        b, h = b[live], h[live]
        at, end = self.start[b], self.start[b + 1]
        for _ in range(self.most):
            hit = self.keys[at] == h
            out[live[hit]] = self.order[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            if not go.any():
                break
            live, at, end, h = live[go], at[go], end[go], h[go]
        return out


class Cache:
    """Units encoded so far: number of each, and their ids end to end."""

    def __init__(self):
        import numpy as np

        self.at: dict[str, int] = {}
        self.n, self.start, self.ids, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def add(self, ids, n, start):
        """Ids of further units, each one's number of them and where they start."""
        import numpy as np

        self.start = np.concatenate([self.start, self.used + start])
        self.n = np.concatenate([self.n, n])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


class Codec:
    """Encoder and decoder of a Model."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, model: Model):
        import numpy as np

        self.m = model
        ids = [i for i, t in enumerate(model.types) if t in (NORMAL, USER)]
        if any(MARK in model.pieces[i].lstrip(MARK) for i in ids):
            raise ValueError("a piece spans words")
        held = set("".join(model.pieces[i] for i in ids))
        alone = [c for c in "\n\r\t" if model.byte_fallback and c not in held]
        self.alone = re.compile(f"([{''.join(alone)}])") if alone else None
        self.longest = max(len(model.pieces[i]) for i in ids)
        keys = np.array([self.hash_of(model.pieces[i]) for i in ids], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        with np.errstate(over="ignore"):
            self.index, self.key_ids = Index(spread_bits(keys), 20), np.array(ids)
        # the pieces' text, to compare hits with
        self.piece_len = np.array([len(p) for p in model.pieces])
        self.piece_codes = np.zeros((len(model.pieces), self.longest), np.uint32)
        for i in ids:
            self.piece_codes[i, : self.piece_len[i]] = [ord(c) for c in model.pieces[i]]
        # neighbouring characters of some piece, and characters that are one
        self.beside = np.unique(np.array([ord(a) << 32 | ord(b) for i in ids for a, b in zip(model.pieces[i], model.pieces[i][1:], strict=False)], np.uint64))
        self.single = np.unique(np.array([ord(model.pieces[i]) for i in ids if len(model.pieces[i]) == 1], np.uint64))
        self.scalar = None
        self.scores = np.array(model.scores)
        self.unk_score = float(min(model.scores[i] for i in ids)) - 10.0
        # bytes that each piece decodes to, laid end to end
        text = [b"" if t == CONTROL else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t != UNKNOWN else " ⁇ ".encode() for p, t in zip(model.pieces, model.types, strict=True)]
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.text_len = np.array([len(x) for x in text])
        self.text_at = np.cumsum(self.text_len) - self.text_len
        if model.type == BPE:
            self.merges(ids)

    def hash_of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def merges(self, ids):
        """For BPE: ranks, all (left, right) -> piece, and the last merge of each piece on its own."""
        import numpy as np

        of = {self.m.pieces[i]: i for i in ids}
        n = len(self.m.pieces)
        pairs = {}
        for p, i in of.items():
            for k in range(1, len(p)):
                a, b = of.get(p[:k]), of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        with np.errstate(over="ignore"):
            self.pair_index = Index(spread_bits(np.array(list(pairs), np.uint64)), 21)
        pair_piece = np.array(list(pairs.values()), np.int64)
        # rank: the order in which merges are preferred
        order = np.argsort(-self.scores, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.pair_rank = np.append(self.rank[pair_piece], np.int64(1) << 60)  # the last for no pair
        self.pair_keys = np.array(list(pairs), np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.reached = np.zeros(n, bool)
        for p, i in of.items():
            parts = [of.get(c, -1) for c in p]
            while len(parts) > 2:
                best = min(((self.rank[pairs[a * n + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a >= 0 and b >= 0 and a * n + b in pairs), default=None)
                if best is None:
                    break
                k = best[1]
                parts[k : k + 2] = [pairs[parts[k] * n + parts[k + 1]]]
            if len(parts) == 1:
                self.reached[i] = True
            elif len(parts) == 2 and pairs.get(parts[0] * n + parts[1]) == i:
                self.reached[i] = True
                self.left[i], self.right[i] = parts
                if max(self.rank[parts[0]] if len(self.m.pieces[parts[0]]) > 1 else -1, self.rank[parts[1]] if len(self.m.pieces[parts[1]]) > 1 else -1) > self.rank[i]:
                    raise ValueError("a piece is preferred to its own parts")

    def combined(self, a, b):
        """Rank of the piece that a and b would merge to; a large number if none."""
        import numpy as np

        with np.errstate(over="ignore"):
            return self.pair_rank[self.pair_index.find(spread_bits((a * len(self.m.pieces) + b).astype(np.uint64)))]

    def compatible(self, a, b):
        """Whether merging the text of a then b leaves just these two pieces; a = -1 stands for a text's start."""
        import numpy as np

        ok = np.ones(len(a), bool)
        live = np.flatnonzero(a >= 0)
        x, y = a[live].copy(), b[live].copy()
        # a merge across the border must come later than what made x (y): only then are x and y whole by themselves
        limit = np.full(len(live), np.int64(1) << 60)
        while len(live):
            clash = self.combined(x, y) < limit
            ok[live[clash]] = False
            single_x, single_y = self.left[x] < 0, self.left[y] < 0
            go = ~clash & ~(single_x & single_y)
            live, x, y, limit, single_x, single_y = live[go], x[go], y[go], limit[go], single_x[go], single_y[go]
            if not len(live):
                break
            rx, ry = np.where(single_x, -1, self.rank[x]), np.where(single_y, -1, self.rank[y])
            # undo the later of the two last merges; of equal ones (the same piece) the right one was made later
            undo_x = rx > ry
            limit = np.where(undo_x, rx, ry + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def scalar_compatible(self):
        """compatible() for one pair of pieces, results kept; for units that are encoded alone."""
        if self.scalar is None:
            none = 1 << 60
            of, n = dict(zip(self.pair_keys.tolist(), self.pair_rank[:-1].tolist(), strict=True)), len(self.m.pieces)
            left, right, rank, known = self.left.tolist(), self.right.tolist(), self.rank.tolist(), {}

            def ok(a, b):
                if a < 0:
                    return True
                key = a * n + b
                got = known.get(key)
                if got is None:
                    x, y, limit = a, b, none
                    while True:
                        if of.get(x * n + y, none) < limit:
                            got = False
                            break
                        rx, ry = rank[x] if left[x] >= 0 else -1, rank[y] if left[y] >= 0 else -1
                        if rx < 0 and ry < 0:
                            got = True
                            break
                        if rx > ry:
                            limit, x = rx, right[x]
                        else:
                            limit, y = ry + 1, left[y]
                    if len(known) > CACHE_UNITS:
                        known.clear()
                    known[key] = got
                return got

            self.scalar = ok
        return self.scalar

    def encode_units(self, units: list[str]):
        """(ids, n, start): piece ids of all units end to end, and of each unit how many and where they start."""
        import numpy as np

        lengths = np.array([len(u) for u in units])
        n, start, parts, used = np.zeros(len(units), np.int32), np.zeros(len(units), np.int64), [np.zeros(0, np.int32)], 0
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            if size > LONG and len(at) <= FEW:
                for k in at.tolist():
                    ids = self.viterbi_alone(np.frombuffer(units[k].encode("utf-32-le", "surrogatepass"), np.uint32))
                    parts.append(ids)
                    n[k], start[k], used = len(ids), used, used + len(ids)
                continue
            step = max(1, 4_000_000 // max(1, size * min(size, self.longest)))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                codes = np.frombuffer("".join([units[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)
                ids, count = self.viterbi(codes)
                parts.append(ids)
                n[some] = count
                start[some] = used + np.cumsum(count) - count
                used += len(ids)
        return np.concatenate(parts), n, start

    def viterbi(self, codes):
        """(ids end to end, number of ids of each row) for units of equal length, given as code points."""
        import numpy as np

        w, n = codes.shape
        # arrays are by place, then by unit: one place of all units lies together
        with np.errstate(over="ignore"):
            prefix = np.zeros((n + 1, w), np.uint64)
            for i in range(n):
                prefix[i + 1] = prefix[i] * np.uint64(self.BASE) + codes[:, i] + np.uint64(1)
            power = np.ones(self.longest + 1, np.uint64)
            for i in range(self.longest):
                power[i + 1] = power[i] * np.uint64(self.BASE)
        bpe = self.m.type == BPE
        score = np.zeros((n + 1, w))
        last = np.full((n + 1, w), -1, np.int32)  # the piece that ends here on the best path
        back = np.zeros((n + 1, w), np.int32)
        every = np.arange(w)
        for end in range(1, n + 1):
            best = np.full(w, -np.inf)
            open_ = every
            for size in range(min(end, self.longest), 0, -1):
                with np.errstate(over="ignore"):
                    # all units are open at first: no need to gather them
                    to, from_ = (prefix[end], prefix[end - size]) if open_ is every else (prefix[end][open_], prefix[end - size][open_])
                    k = self.index.find(spread_bits(to - from_ * power[size]))
                hit = np.flatnonzero(k >= 0)
                if not len(hit):
                    continue
                u, piece = open_[hit], self.key_ids[k[hit]]
                same = self.same(codes[u, end - size : end], piece, size)
                if not same.all():
                    u, piece = u[same], piece[same]
                if bpe:
                    fit = self.reached[piece]
                    before = last[end - size][u]
                    # before = -2: an unknown character, which merges with nothing
                    fit &= self.compatible(np.where(before == -2, -1, before).astype(np.int64), piece)
                    u, piece = u[fit], piece[fit]
                    if not len(u):
                        continue
                    best[u] = 0.0
                    last[end][u], back[end][u] = piece, size
                    open_ = open_[best[open_] == -np.inf]
                    if not len(open_):
                        break
                else:
                    s = score[end - size][u] + self.scores[piece]
                    # equal sums: the one met first stays, the longer piece
                    up = s > best[u]
                    u = u[up]
                    best[u] = s[up]
                    last[end][u], back[end][u] = piece[up], size
            # a character that no piece covers is an edge of its own
            if bpe:
                none = open_[best[open_] == -np.inf]
                if len(none):
                    last[end][none], back[end][none] = -2, 1
            else:
                with np.errstate(over="ignore"):
                    k = self.index.find(spread_bits(codes[:, end - 1].astype(np.uint64) + np.uint64(1)))
                s = score[end - 1] + self.unk_score
                none = np.flatnonzero((k < 0) & (s > best))
                best[none] = s[none]
                last[end][none], back[end][none] = -2, 1
            score[end] = best
        # walk back all units together
        ids, pos, rows = np.full((w, n), -1, np.int64), np.full(w, n), np.arange(w)
        unknown = []
        for k in range(n - 1, -1, -1):
            rows = rows[pos[rows] > 0]
            if not len(rows):
                break
            p = last[pos[rows], rows]
            ids[rows, k] = p
            for r in rows[p == -2].tolist():
                unknown.append((r, k, int(codes[r, pos[r] - 1])))
            pos[rows] -= back[pos[rows], rows]
        if unknown:
            return self.with_unknown(ids, unknown)
        keep = ids >= 0
        return ids[keep].astype(np.int32), keep.sum(axis=1)

    def same(self, codes, piece, size: int):
        """Whether rows of `size` code points are the pieces' texts."""
        return (self.piece_len[piece] == size) & (codes == self.piece_codes[piece, :size]).all(axis=1)

    def viterbi_alone(self, codes, together: int = 1 << 15):
        """Piece ids of one long unit: all its substrings probe together, some thousand ends at a time, and one pass over the hits
        of each end keeps the maximum."""
        import numpy as np

        n, bpe, unknown = len(codes), self.m.type == BPE, -2
        score, last, back = [0.0], [-1], [0]
        ok = self.scalar_compatible() if bpe else None
        scores = None if bpe else self.scores.tolist()
        for lo in range(0, n, together):
            hi, first = min(n, lo + together), max(0, lo - self.longest)
            part = codes[first:hi].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                # hash of the first k characters of part, by sums of c / BASE ** place
                power = np.full(len(part) + 1, np.uint64(self.BASE))
                inverse = np.full(len(part) + 1, np.uint64(pow(self.BASE, -1, 1 << 64)))
                power[0] = inverse[0] = 1
                power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * inverse[:-1]) * power[:-1]])
                found = []
                for size in range(min(hi, self.longest), 0, -1):
                    ends = np.arange(max(lo + 1, first + size), hi + 1)
                    k = self.index.find(spread_bits(prefix[ends - first] - prefix[ends - first - size] * power[size]))
                    hit = np.flatnonzero(k >= 0)
                    if len(hit):
                        ends, piece = ends[hit], self.key_ids[k[hit]]
                        rows = np.lib.stride_tricks.sliding_window_view(codes, size)[ends - size]
                        keep = self.same(rows, piece, size)
                        if bpe:
                            keep &= self.reached[piece]
                        found.append((ends[keep], np.full(int(keep.sum()), size), piece[keep]))
            ends, size, piece = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
            order = np.argsort(ends, kind="stable")  # longest first, still
            size, piece, cuts = size[order].tolist(), piece[order].tolist(), np.searchsorted(ends[order], np.arange(lo + 1, hi + 2)).tolist()
            for end in range(lo + 1, hi + 1):
                a, z = cuts[end - lo - 1], cuts[end - lo]
                best, which, step, alone = -np.inf, unknown, 1, True
                for c in range(a, z):
                    if size[c] == 1:
                        alone = False
                    if bpe:
                        if ok(last[end - size[c]], piece[c]):
                            best, which, step = 0.0, piece[c], size[c]
                            break
                    else:
                        v = score[end - size[c]] + scores[piece[c]]
                        if v > best:
                            best, which, step = v, piece[c], size[c]
                if not bpe and alone and score[end - 1] + self.unk_score > best:
                    best, which, step = score[end - 1] + self.unk_score, unknown, 1
                score.append(best)
                last.append(which)
                back.append(step)
        ids, end, chars = [], n, []
        while end > 0:
            ids.append(last[end])
            if last[end] == unknown:
                chars.append((0, len(ids) - 1, int(codes[end - 1])))
            end -= back[end]
        if chars:
            return self.with_unknown(np.array([ids[::-1]]), [(0, len(ids) - 1 - k, c) for _, k, c in chars])[0]
        return np.array(ids[::-1], np.int32)

    def with_unknown(self, ids, unknown):
        import numpy as np

        chars = {(r, k): c for r, k, c in unknown}
        out = []
        for r, row in enumerate(ids.tolist()):
            got = []
            for k, p in enumerate(row):
                if p >= 0:
                    got.append(p)
                elif p == -2:
                    if self.m.byte_fallback:
                        got += [self.m.bytes[b] for b in chr(chars[r, k]).encode("utf-8", "replace")]
                    elif not got or got[-1] != self.m.unk:  # a run of unknown characters is one unknown piece
                        got.append(self.m.unk)
            out.append(got)
        return np.array([p for got in out for p in got], np.int32), np.array([len(got) for got in out])

    def units(self, text: str) -> list[str]:
        """Units of a normal form: cut before each run of marks that follows something else, around line breaks and
        tabs that no piece holds, and in what is longer than LONG wherever no piece crosses."""
        if self.alone is not None and self.alone.search(text):
            out = [u for x in self.alone.split(text) if x for u in ([x] if self.alone.match(x) else self.between(x))]
        else:
            out = self.between(text)
        if max(map(len, out), default=0) > LONG:
            return [v for u in out for v in (self.shorter(u) if len(u) > LONG else (u,))]
        return out

    def shorter(self, unit: str) -> list[str]:
        """A unit cut between characters that no piece holds side by side. In a model without byte pieces neighbouring unknown characters stay
        together, as they are one unknown piece."""
        import numpy as np

        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        inside = np.isin(codes[:-1] << np.uint64(32) | codes[1:], self.beside)
        if not self.m.byte_fallback:
            other = ~np.isin(codes, self.single)
            inside |= other[:-1] & other[1:]
        cuts = [0, *(np.flatnonzero(~inside) + 1).tolist(), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def between(self, text: str) -> list[str]:
        if MARK + MARK not in text:
            parts = text.split(MARK)
            return ([parts[0]] if parts[0] else []) + [MARK + x for x in parts[1:]]
        return RUNS.findall(text)

    def number(self, texts: list[str], cache: Cache) -> list:
        """Numbers of each text's units in the cache; new units get the next ones, and are encoded by `learn`."""
        import numpy as np

        at = cache.at  # strings are dropped as soon as they have a number
        return [np.array([at.setdefault(u, len(at)) for u in self.units(self.m.normal(t))], np.int32) for t in texts]

    def learn(self, cache: Cache) -> None:
        """Encode the units that have a number but no ids yet, all together."""
        known = len(cache.n)
        if len(cache.at) > known:
            cache.add(*self.encode_units(list(islice(cache.at, known, None))))

    def joined(self, numbers: list, cache: Cache) -> list:
        """Piece ids of texts given by their units' numbers, as int32 arrays."""
        import numpy as np

        which = np.concatenate([*numbers, np.zeros(0, np.int32)])
        n = cache.n[which]
        ends = np.cumsum(n, dtype=np.int64)
        flat = cache.ids[np.repeat(cache.start[which] - (ends - n), n) + np.arange(int(n.sum()))]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) for x in numbers)])]
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str], cache: Cache | None = None) -> list:
        """Piece ids of each text, as int32 arrays."""
        cache = Cache() if cache is None else cache
        if len(cache.at) > CACHE_UNITS:
            cache.__init__()
        numbers = self.number(texts, cache)
        self.learn(cache)
        return self.joined(numbers, cache)

    def decode(self, ids) -> str:
        """Text of the ids; the blank that encoding put first is taken off."""
        import numpy as np

        if not len(ids):
            return ""
        n = self.text_len[ids]
        at = np.repeat(self.text_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text = self.text_bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.m.dummy and text[:1] == " " else text


def codec(data: bytes) -> Codec:
    """The codec of a model, kept for the life of a Python worker; units encoded so far are kept for a task only."""
    import sys

    held = sys.__dict__.setdefault("_textveil_codecs", {})
    if hash(data) not in held:
        held.clear()
        held[hash(data)] = Codec(Model(data))
    return held[hash(data)]


def encode(docs: DataFrame, model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """Columns `keep`, piece_ids (array of int) and, if asked for, decoded (string): one row per input row.

    Null texts have null ids and a null decoded text, empty ones no ids. Long texts are encoded whole. Repeated rows give a row each, an
    empty table none; columns not in `keep` are ignored, and kept ones of the added names lengthen those by underscores.
    """
    added, text = fresh(keep, "piece_ids", "decoded"), fresh(keep, "piece_text")[0]
    src = docs.select(*[named(c) for c in keep], named(text_col).alias(text))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(added[0], T.ArrayType(T.IntegerType())), *[T.StructField(added[1], T.StringType())] * decoded])

    @task
    def run(batches):
        import pyarrow as pa

        for part, ids, texts in encoded(batches, model, decoded):
            out = [*part.columns[:-1], pa.array(ids, pa.list_(pa.int32())), *([pa.array(texts, pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays(out, names=[*part.schema.names[:-1], *added[: 1 + decoded]])

    return src.mapInArrow(run, schema)


def encoded(batches, model: bytes, back: bool = True):
    """(slice of a batch, ids, decoded texts) for rows whose last column is the text; some slices' units are encoded
    together, and their ids put together slice by slice."""
    import numpy as np
    import pyarrow.compute as pc

    c, cache = codec(model), Cache()
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        cut = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        cut = list(zip(cut, cut[1:], strict=False))
        for some in (cut[i : i + TOGETHER] for i in range(0, len(cut), TOGETHER)):
            if len(cache.at) > CACHE_UNITS:
                cache.__init__()
            numbers = [c.number([t or "" for t in text.slice(lo, hi - lo).to_pylist()], cache) for lo, hi in some]
            c.learn(cache)
            for (lo, hi), which in zip(some, numbers, strict=True):
                null = text.slice(lo, hi - lo).is_null().to_pylist()
                ids = c.joined(which, cache)
                yield batch.slice(lo, hi - lo), [None if z else i for z, i in zip(null, ids, strict=True)], [None if z else c.decode(i) for z, i in zip(null, ids, strict=True)] if back else None


def digests(docs: DataFrame, model: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_pieces, piece_ids, ids_sha256, round_trip): what `encode` gives, and its digests, of the ids as little-endian int32.

    round_trip: the decoded text is the text. Null texts count as empty, long ones are encoded whole. Repeated rows give a row each, an
    empty table none; other columns are ignored.
    """
    src = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))

    @task
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for part, ids, back in encoded(batches, model):
            sha = [hashlib.sha256(np.ascontiguousarray(i, "<i4").tobytes()).hexdigest() for i in ids]
            same = [a == b for a, b in zip(part.column(1).to_pylist(), back, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "piece_ids", "ids_sha256", "round_trip"])

    return src.mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, ids_sha256 string, round_trip boolean")


def model_bytes(path: str = MODEL) -> bytes:
    """The model file's bytes, read on the driver; tasks get them with their function."""
    with open(path, "rb") as f:
        return f.read()


def query(spark, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_bytes(model_path))
