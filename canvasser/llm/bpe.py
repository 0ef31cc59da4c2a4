"""Byte-level BPE on ragged numpy arrays: many pre-tokens are merged at once.

A vocabulary file of the tokenizers library gives ids and merges. ``merge`` holds the symbols of
all pre-tokens of a batch in one array and works in rounds: every pre-token finds its lowest-rank
pair and replaces all its occurrences, from the left, until no pair of any pre-token is listed.
Each merge of a byte-level vocabulary makes a new symbol, so a pair that arises later ranks
behind the pairs it was made from and the rounds end where one-by-one merging ends.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex

from canvasser.llm.hashing import segments

# White space other than blanks and line feeds, by Unicode.
_ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_ODD = _ODD_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level files use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and pieces of one byte-level BPE file (its text is ``source``)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.pieces = [b""] * self.size
        for piece, i in ids.items():
            self.pieces[i] = bytes(of_letter[c] for c in piece) if piece not in self.special else piece.encode()
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(names) + ")") if names else None
        self.pattern = regex.compile(PATTERN)

    def split(self, text: str | None) -> list[str]:
        """Pre-tokens in order; the string of a special token stands alone."""
        if not text:
            return []
        if not self.special_pattern or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def _plain(self, text: str) -> bool:
        """Whether no run of white space reaches over the blanks and line feeds the text is cut at."""
        if text.endswith((" ", "\n\n")) or any(s in text for s in ("  ", " \n", "\n ", "\n\n\n")):
            return False
        return not any(c in text for c in (_ODD_ASCII if text.isascii() else _ODD)) and not any(s in text for s in self.special)

    def units(self, text: str | None) -> list[str]:
        """The text in units whose pre-tokens do not depend on what stands around them.

        Plain texts are cut at blanks and line feeds, which is much faster than the pattern. A
        unit stands for itself behind a blank, unless its first character says otherwise: a line
        feed (itself), a tab (the beginning of the text) or a carriage return (one pre-token of
        a text that is not plain).
        """
        if not text:
            return []
        if not self._plain(text):
            return ["\r" + t for t in self.split(text)]
        out, mark = [], "\t"
        for line in text.split("\n"):
            parts = line.split(" ")
            parts[0] = mark + parts[0]
            out += parts
            mark = "\n"
        return out

    @staticmethod
    def text_of(unit: str) -> str:
        """The part of the text that a unit stands for."""
        mark = unit[:1]
        return unit if mark == "\n" else unit[1:] if mark in ("\t", "\r") and mark else " " + unit

    @cached_property
    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces in one array, where each begins, and its size."""
        sizes = np.fromiter(map(len, self.pieces), np.int64, self.size)
        return np.frombuffer(b"".join(self.pieces), np.uint8), np.cumsum(sizes) - sizes, sizes

    def tokens_of(self, unit: str) -> list[str]:
        """Pre-tokens of a unit."""
        if unit.isalpha():  # letters behind a blank
            return [" " + unit]
        mark = unit[:1]
        if mark == "\r":
            return [unit[1:]]
        return self.pattern.findall(unit if mark == "\n" else unit[1:] if mark == "\t" else " " + unit)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in one array, and the number of ids of each."""
        parts = [self.tokens_of(u) for u in units]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, counts = self.encode([t for part in parts for t in part])
        return ids, np.bincount(np.repeat(np.arange(len(parts)), sizes), weights=counts, minlength=len(parts)).astype(np.int64)

    def encode(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in one array, and the number of ids of each."""
        raw = [b"" if t in self.special else t.encode("utf-8", "surrogatepass") for t in tokens]
        counts = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ids, counts = merge(symbols, counts, self)
        if self.special and not self.special.keys().isdisjoint(tokens):
            at = np.array([i for i, t in enumerate(tokens) if t in self.special])
            ids = np.insert(ids, (np.cumsum(counts) - counts)[at], [self.special[tokens[i]] for i in at])
            counts[at] = 1
        return ids, counts

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value behind all ranks."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(2**31 - 1))


def merge(symbols: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence (``counts`` symbols each) to the end: symbols left, and their counts."""
    none = np.int32(2**31 - 1)
    done_ids, done_owner = [], []
    owner = np.repeat(np.arange(len(counts)), counts)
    while len(symbols):
        inside = owner[:-1] == owner[1:]
        rank = np.full(len(symbols), none, np.int32)
        at = np.flatnonzero(inside)
        rank[at] = vocabulary.rank_of(symbols[at], symbols[at + 1])
        begins = np.flatnonzero(np.concatenate(([True], ~inside)))
        lowest = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.append(begins, len(symbols)))
        lowest_here = np.repeat(lowest, sizes)
        open_ = lowest_here != none
        if not open_.all():
            done_ids.append(symbols[~open_])
            done_owner.append(owner[~open_])
            symbols, owner, rank, lowest_here = symbols[open_], owner[open_], rank[open_], lowest_here[open_]
            if not len(symbols):
                break
        hit = rank == lowest_here
        # In a run of overlapping hits (a pair of one repeated symbol) every second one counts.
        overlap = np.flatnonzero(hit[1:] & hit[:-1]) + 1
        if len(overlap):
            place = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
            hit &= (place - start) % 2 == 0
        left = np.flatnonzero(hit)
        symbols = symbols.copy()
        symbols[left] = vocabulary.made[lowest_here[left]]
        keep = np.ones(len(symbols), bool)
        keep[left + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    ids, owners = np.concatenate(done_ids), np.concatenate(done_owner)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(counts))


class Remembered:
    """Ids of whole texts, where units met before are not merged again.

    At most ``most`` units (and those of one call) are remembered.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each."""
        units = [self.vocabulary.units(t) for t in texts]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes, distinct = pd.factorize(np.array([u for part in units for u in part], dtype=object))
        fresh = [u for u in distinct if u not in self.number]
        if len(self.number) + len(fresh) > self.most:
            self._clear()
            fresh = list(distinct)
        if fresh:
            ids, counts = self.vocabulary.encode_units(fresh)
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter((self.number[u] for u in distinct), np.int64, len(distinct))[codes]
        starts = (np.cumsum(self.counts) - self.counts)[at]
        unit, place = segments(self.counts[at])
        owner = np.repeat(np.arange(len(units)), sizes)
        totals = np.bincount(owner, weights=self.counts[at], minlength=len(units)).astype(np.int64)
        return self.ids[starts[unit] + place], totals


def without_special(source: str) -> str:
    """A vocabulary file in which the strings of special tokens are ordinary text."""
    return json.dumps(json.loads(source) | {"added_tokens": []})


@lru_cache(maxsize=4)
def vocabulary(source: str) -> Vocabulary:
    """The vocabulary of a file's text, built once per worker."""
    return Vocabulary(source)
