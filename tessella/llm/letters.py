"""Texts as bare letters, however they are printed, and winnowed fingerprints of them.

Case, accents, joined letters, punctuation, spacing, invisible characters and line
layout leave a text's letters as they are, so fingerprints are taken from the letters
alone: a gram is ``k`` letters in a row, and of the grams in every window of ``w`` the
one with the smallest hash is kept. Two texts with ``k + w - 1`` letters in a row in
common always keep a gram in common. Whole batches of texts are turned into one array
of letters by table look-ups; there is no loop over characters or documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np

#: Letters that Unicode does not decompose, with their plain spelling.
_PLAIN = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "n"})
#: Apostrophes, and the hyphens (with the not sign of some scans) that break words at line ends.
_APOSTROPHES, _HYPHENS = "'`" + chr(0x2019) + chr(0x2BC), np.array([0x2D, 0xAC, 0xAD, 0x2010, 0x2011], np.uint32)
_BRACKETS = "()[]{}"
_UNKNOWN = 255
_TOP = 0x110000


class _Characters:
    """What each character stands for, learnt when it is first met."""

    def __init__(self):
        self.size = np.full(_TOP, _UNKNOWN, np.uint8)  # letters it stands for
        self.at = np.zeros(_TOP, np.int32)  # the first of them in ``letters``
        self.bracket = np.zeros(_TOP, np.uint8)  # 1.. for those of _BRACKETS
        self.parts = np.zeros(_TOP, bool)  # does it part words?
        self.letters = np.zeros(0, np.uint32)

    def learn(self, codes: np.ndarray) -> None:
        more = []
        at = len(self.letters)
        for code in codes.tolist():
            c = chr(code)
            plain = unicodedata.normalize("NFKD", c).casefold().translate(_PLAIN)
            plain = "" if c in _APOSTROPHES else "".join(x for x in plain if x.isalnum())
            self.size[code], self.at[code] = len(plain), at
            at += len(plain)
            more.append(np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32))
            kind = unicodedata.category(c)
            self.parts[code] = not plain and c not in _APOSTROPHES and kind not in ("Mn", "Me", "Cf")
            shape = unicodedata.normalize("NFKC", c)
            self.bracket[code] = _BRACKETS.find(shape) + 1 if len(shape) == 1 else 0
        self.letters = np.concatenate([self.letters, *more])

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        n = self.size[codes]
        new = n == _UNKNOWN
        if new.any():
            self.learn(np.unique(codes[new]))
            n = self.size[codes]
        return n


_CHARACTERS = _Characters()


def _pairs(kind: Sequence[int], at: Sequence[int]) -> list[tuple[int, int]]:
    """Brackets that belong together, by place; an opening or closing one without partner is passed over."""
    stack: list[tuple[int, int]] = []
    waiting = [0, 0, 0]
    out = []
    for k, p in zip(kind, at):
        shape, closing = divmod(k - 1, 2)
        if not closing:
            stack.append((shape, p))
            waiting[shape] += 1
        elif waiting[shape]:
            while True:
                s, first = stack.pop()
                waiting[s] -= 1
                if s == shape:
                    break
            out.append((first, p))
    return out


class Laid:
    """The readings of many texts, as letters laid end to end.

    The first reading of a text takes all its letters. Where it has bracketed remarks,
    another one leaves them out, however long and nested, and each remark that holds
    others is read by itself without those.
    """

    def __init__(self, texts: Sequence[str]):
        whole = "".join(texts)
        self.codes = codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        n = _CHARACTERS.sizes(codes)
        if len(n) and n.max() > 1:
            src = np.repeat(np.arange(len(codes), dtype=np.int32), n)
            last = np.cumsum(n, dtype=np.int32)
            letters = _CHARACTERS.letters[_CHARACTERS.at[codes[src]] + (np.arange(len(src), dtype=np.int32) - (last - n)[src])]
        else:
            src = np.flatnonzero(n)
            letters = _CHARACTERS.letters[_CHARACTERS.at[codes[src]]]
        bounds = np.searchsorted(src, np.concatenate([[0], ends]))
        parts_letters, parts_src = [letters], [src]
        sizes, text = [np.diff(bounds)], [np.arange(len(texts))]
        depth, holders, marked = self._remarks(ends)
        if depth is not None:
            level = depth[src]
            for t in marked:
                outer = np.flatnonzero(level[bounds[t] : bounds[t + 1]] == 0) + bounds[t]
                parts_letters.append(letters[outer])
                parts_src.append(src[outer])
                sizes.append(np.array([len(outer)]))
                text.append(np.array([t]))
            for t, first, last in holders:
                lo, hi = np.searchsorted(src, [first, last])
                own = np.flatnonzero(level[lo:hi] == depth[first]) + lo
                parts_letters.append(letters[own])
                parts_src.append(src[own])
                sizes.append(np.array([len(own)]))
                text.append(np.array([t]))
        self.whole = len(letters)
        self.letters, self.src = np.concatenate(parts_letters), np.concatenate(parts_src)
        self.sizes, self.text = np.concatenate(sizes), np.concatenate(text)
        self.ends = np.cumsum(self.sizes)
        self.firsts = self.ends - self.sizes
        self._powers: dict[int, np.ndarray] = {}

    def _remarks(self, ends: np.ndarray):
        """How many remarks each character stands in, the remarks that hold others, and the texts with remarks."""
        kind = _CHARACTERS.bracket[self.codes]
        at = np.flatnonzero(kind)
        if not len(at):
            return None, (), ()
        kind, of = kind[at].astype(np.int64), np.searchsorted(ends, at, side="right")
        change = np.zeros(len(self.codes) + 1, np.int32)
        # an opening bracket with its closing one next to it, as nearly all are
        simple = (kind[:-1] % 2 == 1) & (kind[1:] == kind[:-1] + 1) & (of[1:] == of[:-1])
        matched = np.zeros(len(at), bool)
        matched[:-1] |= simple
        matched[1:] |= simple
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        plain = np.logical_and.reduceat(matched, first)
        bounds = np.append(first, len(at))
        opens = np.flatnonzero(simple)
        opens = opens[plain[np.searchsorted(first, opens, side="right") - 1]]
        change[at[opens]] += 1
        change[at[opens + 1]] -= 1
        marked = of[first[plain]].tolist()
        nested = []
        for g in np.flatnonzero(~plain).tolist():
            a, b = bounds[g], bounds[g + 1]
            pairs = _pairs(kind[a:b].tolist(), at[a:b].tolist())
            if pairs:
                marked.append(int(of[a]))
            for i, (one, other) in enumerate(pairs):  # inner ones come first
                change[one] += 1
                change[other] -= 1
                if i and pairs[i - 1][0] > one:
                    nested.append((int(of[a]), one, other))
        return np.cumsum(change), nested, marked

    def _run(self, k: int) -> np.ndarray:
        """A polynomial of the ``k`` letters from each place on, ``k`` a power of two."""
        if k not in self._powers:
            if k == 1:
                h = self.letters.astype(np.uint64)
                h *= np.uint64(0x7FB5D329728EA185)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x81DADEF4BC2DD44D)
            else:
                half = self._run(k // 2)
                h = half[: -(k // 2)] * np.uint64(pow(0x9E3779B97F4A7C15, k // 2, 1 << 64)) + half[k // 2 :]
            self._powers[k] = h
        return self._powers[k]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the ``k`` letters from each place on, and whether they belong to one reading."""
        n = len(self.letters) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h, done = None, 0
        for size in (1 << b for b in range(k.bit_length(), -1, -1)):
            if k & size:
                part = self._run(size)[done : done + n]
                h = part.copy() if h is None else h * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + part
                done += size
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        whole = np.ones(n, bool)
        for back in range(1, k):
            at = self.ends - back
            at = at[(at >= self.firsts) & (at < n)]
            whole[at] = False
        return h, whole

    def kept(self, h: np.ndarray, whole: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
        """Which of the grams at the places ``at`` are the smallest of some window of ``w`` grams of one reading."""
        around = at[:, None] + np.arange(1 - w, w)
        inside = (around >= 0) & (around < len(h))
        around = np.clip(around, 0, len(h) - 1)
        inside &= whole[around]
        windows = np.lib.stride_tricks.sliding_window_view(np.where(inside, h[around], np.uint64(2**64 - 1)), w, axis=1)
        sound = np.lib.stride_tricks.sliding_window_view(inside, w, axis=1).all(axis=2)
        return (sound & (windows.min(axis=2) == h[at][:, None])).any(axis=1) if len(at) else np.zeros(0, bool)

    def reading_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def repeats(self, first: int, last: int) -> bool:
        """Do these letters of one reading stand next to each other in the first reading of its text, too?"""
        if first < self.whole:
            return False
        lo, hi = np.searchsorted(self.src[: self.whole], [self.src[first], self.src[last - 1]])
        return bool(hi - lo == last - 1 - first)

    def words(self, first: int, last: int) -> tuple[list[str], np.ndarray]:
        """The words of the letters from ``first`` to ``last`` of one reading, as printed, and where each begins.

        A word that is broken with a hyphen at a line's end is one word.
        """
        if last <= first:
            return [], np.zeros(0, np.int64)
        src = self.src[first:last]
        base = int(src[0])
        codes = self.codes[base : int(src[-1]) + 1]
        parts = _CHARACTERS.parts[codes]
        upto = np.concatenate([[0], np.cumsum(parts)])
        rel = src - base
        gap = upto[rel[1:]] - upto[rel[:-1]] > 0
        wide = np.flatnonzero(gap & (np.diff(rel) > 2))
        for i in wide[np.isin(codes[rel[wide] + 1], _HYPHENS)].tolist():
            rest = "".join(map(chr, codes[rel[i] + 2 : rel[i + 1]]))
            gap[i] = not (rest.isspace() and "\n" in rest)
        starts = np.concatenate([[0], np.flatnonzero(gap) + 1])
        text = self.letters[first:last].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [text[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)])], starts
