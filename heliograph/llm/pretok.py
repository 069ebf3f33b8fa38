"""Vectorised pre-tokenisation that agrees with the tokenizer library.

A BPE tokenizer works on each pre-token by itself, and texts repeat most of their
pre-tokens, so a batch is split into pre-tokens with NumPy and the library only
sees each distinct pre-token.  The character classes come from the library itself,
which is probed once on the driver for every character of the basic plane.

Texts that the vectorised rules don't cover go to the library whole: those with an
added token's string, with characters beyond the basic plane, with characters that
the library's normaliser treats in a way of its own, or not in the form (NFC) that
the normaliser would give them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from heliograph.llm.wordscan import checked_hashes, chunks

OWN, LETTER, NUMBER, SPACE, OTHER, EDGE = range(6)
#: Characters that are split, and that the library takes, at a time.
CHUNK, WHOLE = 1 << 19, 1 << 18
PLANE = 1 << 16


def library(spec: str):
    """The library's tokenizer for a JSON text, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


@dataclass
class Rules:
    """What workers need: the tokenizer's JSON text, the class of each character, and how pre-tokens are cut."""

    spec: str
    kinds: np.ndarray
    lower: bool
    spaces_kept: bool
    single_numbers: bool
    added: list[str]
    odd: str


def rules_from(path: str) -> Rules:
    """Read a tokenizer file and probe the library for its character classes.

    Covers byte-level BPE with the usual contraction pattern, with spaces either
    leading the next word or dropped (then lower-cased, NFC, one number a pre-token).
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    data = json.loads(spec)
    tok = library(spec)
    normaliser, pre = tok.normalizer, tok.pre_tokenizer

    def n(s: str) -> int:
        return len(pre.pre_tokenize_str(s))

    spaces_kept = n("a ") == 2
    kinds = np.zeros(PLANE, np.uint8)
    odd = ["Σ"]  # lower-cased by its neighbours in Python, alone in the library
    for c in range(PLANE):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if normaliser is not None and normaliser.normalize_str(f"a{s}a") != f"a{' ' if n(s) == 0 else s.lower()}a":
            odd += [s] * (s.lower() != s)
            continue
        if n(f"a{s}a") == 1:
            kinds[c] = LETTER
        elif n(f"!{s}!") == 1:
            kinds[c] = OTHER
        elif n(f"1{s}1") == (1 if spaces_kept else 3):
            kinds[c] = NUMBER
        else:
            kinds[c] = SPACE
    return Rules(spec, kinds, normaliser is not None, spaces_kept, n("11") == 2, [t["content"] for t in data.get("added_tokens") or []], "".join(odd))


class Splitter:
    """Splits texts into pre-tokens; made once in each worker."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self._tok = None
        self._odd = re.compile("[" + re.escape(rules.odd) + "]")

    @property
    def tok(self):
        if self._tok is None:
            self._tok = library(self.rules.spec)
        return self._tok

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts by the library, a few at a time, as its own results take far more room than the ids."""
        parts = (texts[a:b] for a, b in chunks([len(t) + 64 for t in texts], WHOLE))
        return [e.ids for part in parts for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]

    def _prepared(self, text: str) -> str | None:
        """The text as its pre-tokens are cut from it; None if the library must take it whole."""
        r = self.rules
        if any(a in text for a in r.added):
            return None
        if not r.lower:
            return text
        if not text.isascii() and (self._odd.search(text) or not unicodedata.is_normalized("NFC", text)):
            return None
        return text.lower()

    def chunks(self, texts: list[str]):
        """For a chunk of texts at a time: (first, last, left, owner, units, starts, ends).

        ``left`` are the texts for the library; pre-token i is units[starts[i]:ends[i]]
        of text first + owner[i].  Pre-tokens come in the order of the texts.
        """
        for a, b in chunks([len(t) for t in texts], CHUNK):
            prepared = [self._prepared(t) for t in texts[a:b]]
            left = {i for i, p in enumerate(prepared) if p is None}
            units, kinds, edges = self._units([p or "" for p in prepared])
            if bad := {*np.searchsorted(edges, np.flatnonzero(kinds == OWN)).tolist()}:
                left |= bad
                units, kinds, edges = self._units(["" if i in left else p for i, p in enumerate(prepared)])
            starts, ends = self._cut(units, kinds)
            yield a, b, left, np.searchsorted(edges, starts), units, starts, ends

    def _units(self, parts: list[str]):
        """Code points and classes of the parts, an EDGE after each; edges: where those stand."""
        units = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le"), "<u4")
        edges = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)) - 1
        kinds = np.where(units < PLANE, self.rules.kinds[np.minimum(units, PLANE - 1)], OWN).astype(np.uint8)
        kinds[edges] = EDGE
        return units, kinds, edges

    def _cut(self, units: np.ndarray, kinds: np.ndarray):
        n, kept = len(units), self.rules.spaces_kept
        begins = np.ones(n + 4, bool)
        begins[1:n] = kinds[1:] != kinds[:-1]
        if self.rules.single_numbers:
            begins[:n] |= kinds == NUMBER
        begins[:n] |= kinds == EDGE
        wide = np.concatenate([units, np.zeros(4, units.dtype)])
        # contractions: an apostrophe that no space and no other sign precedes
        mark = np.flatnonzero((units == 39) & (kinds == OTHER) & begins[:n])
        if kept and len(mark):
            mark = mark[(mark == 0) | (wide[mark - 1] != 32)]
        one, two = wide[mark + 1], wide[mark + 2]
        short = mark[np.isin(one, [ord(c) for c in "stmd"])]
        long = mark[((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
        begins[short + 1] = False
        begins[short + 2] = True
        begins[long + 1] = False
        begins[long + 2] = False
        begins[long + 3] = True
        if kept:
            # the last of a run of white space before a word stands alone, or leads the word if it is a plain space
            last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & (kinds[1:] != EDGE))
            begins[last] = True
            begins[last[units[last] == 32] + 1] = False
        starts = np.flatnonzero(begins[:n])
        ends = np.append(starts[1:], n)
        real = kinds[starts] != EDGE
        if not kept:
            real &= kinds[starts] != SPACE
        return starts[real], ends[real]

    def hashes(self, units, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of every pre-token; pre-tokens are equal where both are."""
        return checked_hashes(units, starts, ends)

    @staticmethod
    def string(units: np.ndarray, a: int, b: int) -> str:
        return units[a:b].tobytes().decode("utf-32-le")


class PieceCache:
    """Ids of pre-tokens by their hashes, in sorted arrays; emptied when it has more than ``most`` entries.

    A pre-token is looked up by its first hash and must have the second one too; a text
    with a pre-token that shares only the first with another goes to the library whole.
    """

    def __init__(self, splitter: Splitter, most: int = 1_000_000):
        self.splitter, self.most = splitter, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.checks = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def encode(self, texts: list[str]):
        """(ids, ends) for a chunk of texts at a time: ids of all its texts in a row, and where each text's ids end."""
        sp = self.splitter
        for a, b, left, owner, units, starts, ends in sp.chunks(texts):
            h, check = sp.hashes(units, starts, ends)
            own, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, own)
            known = np.zeros(len(own), bool)
            inside = place < len(self.keys)
            known[inside] = self.keys[place[inside]] == own[inside]
            if not known.all():
                if len(self.keys) > self.most:
                    self._clear()
                    known[:] = False
                fresh = np.flatnonzero(~known)
                got = sp.whole([sp.string(units, starts[i], ends[i]) for i in first[fresh]])
                size = np.array([len(x) for x in got], np.int64)
                at = len(self.pool) + np.cumsum(size) - size
                self.pool = np.concatenate([self.pool, np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))])
                where = np.searchsorted(self.keys, own[fresh])
                rows = ((self.keys, own[fresh]), (self.checks, check[first[fresh]]), (self.at, at), (self.size, size))
                self.keys, self.checks, self.at, self.size = (np.insert(x, where, y) for x, y in rows)
                place = np.searchsorted(self.keys, own)
            which = place[inverse]
            left = left | {*owner[self.checks[which] != check].tolist()}
            size = self.size[which]
            begin = np.cumsum(size) - size
            ids = self.pool[np.repeat(self.at[which] - begin, size) + np.arange(int(size.sum()))]
            counts = np.bincount(owner, weights=size, minlength=b - a).astype(np.int64)
            if left:
                parts, done = [], 0
                whole = dict(zip(sorted(left), sp.whole([texts[a + i] for i in sorted(left)]), strict=True))
                stop = np.cumsum(counts)
                for i in sorted(left):
                    parts += [ids[done : stop[i] - counts[i]], np.array(whole[i], np.uint32)]
                    done, counts[i] = stop[i], len(whole[i])
                ids = np.concatenate([*parts, ids[done:]])
            yield ids, np.cumsum(counts)
