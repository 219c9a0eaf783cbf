"""Token ids of a byte-level BPE tokenizer for batches of texts, the pre-tokens found by numpy and looked up by hash.

The tokenizer splits a text into pre-tokens by a pattern (contractions; letters, digits or other characters, each with a
space before them; white space) and merges bytes within each. Most pre-tokens repeat, so only new ones are merged: by
``tiktoken`` where the same vocabulary is at hand as ranks, as it merges several times faster to the same ids.
Texts with a code point from ``PLAIN`` up, or with the tokenizer's special tokens, go to the tokenizer whole.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Code points under this have had their classes since Unicode 5.
PLAIN = 0x250
BEYOND = re.compile(f"[^\0-{chr(PLAIN - 1)}]")
OTHER, LETTER, DIGIT, SPACE = range(4)
#: Pre-tokens that a cache holds before it starts again.
CACHED = 1_500_000


def classes() -> np.ndarray:
    found = np.zeros(PLAIN, np.uint8)
    for point in range(PLAIN):
        for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            if regex.match(pattern, chr(point)):
                found[point] = kind
    return found


def pre_token_starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end. points: code points; firsts: the (non-empty) texts' first places."""
    n = len(points)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    start[1:n] = kinds[1:] != kinds[:-1]
    begins = np.zeros(n + 1, bool)
    begins[firsts] = begins[n] = True
    start |= begins
    runs = np.flatnonzero(start)
    white = kinds[runs[:-1]] == SPACE
    # The last white space before a word stands alone, or is part of the word if it is a space.
    ends = runs[1:][white]
    ends = ends[~begins[ends]]
    start[ends - 1] = True
    joined = ends[points[ends - 1] == 32]
    start[joined] = False
    # 's 't 're 've 'm 'll 'd at the start of a pre-token
    quotes = np.flatnonzero((points == 39) & start[:n])
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kinds[quotes + 1] == LETTER) & ~begins[quotes + 1]]
    if len(quotes):
        one = points[quotes + 1]
        after = np.minimum(quotes + 2, n - 1)
        two = np.where((quotes + 2 < n) & ~begins[quotes + 2], points[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((short, 1), (long, 2)):
            start[quotes[chosen] + 1] = False
            start[quotes[chosen] + 1 + size] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Encodes batches as ``Tokenizer.encode(text, add_special_tokens=False)`` would."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.merger = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                self.merger = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
        self.kinds = classes()
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        random = np.random.default_rng(7)
        self.codes = random.integers(0, 1 << 64, (2, PLAIN), np.uint64)
        self.bases = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
        self.inverses = [np.uint64(pow(int(b), -1, 1 << 64)) for b in self.bases]
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.checks = np.zeros(1024, np.uint64)
        self.spans = np.zeros((1024, 2), np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, keys: list[int], checks: np.ndarray, words: list[str]) -> None:
        ids = [np.array(self.merger.encode_ordinary(x), np.uint32) for x in words] if self.merger else self.whole(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        k, more = len(self.index), int(sizes.sum())
        while k + len(keys) > len(self.checks):
            self.checks = np.concatenate([self.checks, self.checks])
            self.spans = np.concatenate([self.spans, self.spans])
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + more] = np.concatenate(ids)
        ends = self.used + np.cumsum(sizes)
        self.spans[k : k + len(keys)] = np.stack([ends - sizes, sizes], 1)
        self.checks[k : k + len(keys)] = checks
        self.index.update(zip(keys, range(k, k + len(keys))))
        self.used += more

    def hashes(self, points: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each pre-token, from sums of its code points' random numbers times powers of an odd base."""
        out = []
        for codes, base, inverse in zip(self.codes, self.bases, self.inverses):
            powers = np.full(len(points), base)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            powers *= codes[points]
            sums = np.add.reduceat(powers, starts)
            back = np.full(len(points), inverse)
            back[0] = 1
            np.cumprod(back, out=back)
            out.append(sums * back[starts])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif (not text.isascii() and BEYOND.search(text)) or any(x in text for x in self.special):
                odd.append(i)
            else:
                plain.append(i)
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else []):
            out[i] = ids
        if not plain:
            return out
        joined = "".join([texts[i] for i in plain])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(texts[i]) for i in plain])
        firsts = np.r_[0, ends[:-1]]
        starts = pre_token_starts(points, self.kinds[points], firsts)
        keys, checks = self.hashes(points, starts)
        unique, place, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = unique.tolist()
        if len(self.index) + len(names) > CACHED:
            self.clear()
        index = self.index
        new = [i for i, key in enumerate(names) if key not in index]
        if new:
            begin = starts[place[new]]
            stop = np.r_[starts, len(points)][place[new] + 1]
            self.add([names[i] for i in new], checks[place[new]], [joined[a:b] for a, b in zip(begin.tolist(), stop.tolist())])
        slots = np.fromiter(map(index.__getitem__, names), np.int64, len(names))[inverse]
        spans = self.spans[slots]
        sizes = spans[:, 1]
        upto = np.cumsum(sizes)
        ids = self.flat[np.arange(upto[-1]) + np.repeat(spans[:, 0] - (upto - sizes), sizes)]
        last = np.searchsorted(starts, ends) - 1
        bounds = upto[last]
        clash = np.unique(np.searchsorted(ends, starts[self.checks[slots] != checks], side="right"))
        for k, (i, a, b) in enumerate(zip(plain, np.r_[0, bounds[:-1]].tolist(), bounds.tolist())):
            out[i] = ids[a:b]
        for k in clash.tolist():  # two pre-tokens share a hash
            out[plain[k]] = self.whole([texts[plain[k]]])[0]
        return out
