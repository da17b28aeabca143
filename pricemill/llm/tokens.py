"""Token ids of many texts with the 50k byte-level vocabulary.

The ids are those of the tokenizer file. Texts of plain Latin characters are cut into pre-tokens by
array operations on their bytes, and every different pre-token is encoded once per worker; all other
texts go through the tokenizer itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from pricemill.llm.spans import SpanHasher

# Characters for which the class of a byte decides everything: all from U+00C0 on are letters. An
# apostrophe may begin a contraction and "<|" a special token, so the tokenizer cuts such texts itself.
UNSAFE = re.compile("[^\t\n\r -&(-~À-ÖØ-öø-ſ]")
LETTER, DIGIT, OTHER, SPACE, BREAK = range(5)

# Pre-tokens kept per worker; beyond, the memory is emptied.
KEPT = 2_000_000


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for byte in range(128):
        if chr(byte).isalpha():
            kinds[byte] = LETTER
        elif chr(byte).isdigit():
            kinds[byte] = DIGIT
    kinds[128:] = LETTER
    kinds[[9, 10, 13]] = BREAK
    kinds[32] = SPACE
    return kinds


KINDS = _classes()


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: a run of one class, with the space before it; runs of white space
    give their last character away to what follows."""
    kind = KINDS[data]
    blank = kind >= SPACE
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    before = np.zeros(n, np.uint8)
    before[1:] = kind[:-1]
    start = edge[:n].copy()
    same_run = np.zeros(n, bool)
    same_run[1:] = (kind[1:] == kind[:-1]) | (blank[1:] & blank[:-1])
    start |= ~same_run
    # a space directly before a word, number or mark belongs to it
    joined = np.zeros(n, bool)
    joined[1:] = (kind[:-1] == SPACE) & ~blank[1:] & ~edge[1:n]
    start &= ~joined
    # the last blank of a run that something follows begins a pre-token of its own
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
    return np.flatnonzero(start | last)


class Encoder:
    """Encodes chunks of texts; made once per worker."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.hasher = SpanHasher()
        self._empty()

    def _empty(self) -> None:
        self.size = 1 << 22
        self.slots = np.zeros(self.size, np.uint64)
        self.entry = np.zeros(self.size, np.int32)
        self.begin, self.ids, self.n = np.zeros(1, np.int64), np.empty(0, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where it is not kept yet."""
        found = np.full(len(hashes), -1, np.int32)
        open_, at = np.arange(len(hashes)), (hashes & np.uint64(self.size - 1)).astype(np.int64)
        while len(open_):
            there = self.slots[at]
            hit = there == hashes[open_]
            found[open_[hit]] = self.entry[at[hit]]
            go_on = ~hit & (there != 0)
            open_, at = open_[go_on], (at[go_on] + 1) & (self.size - 1)
        return found

    def _keep(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        encode = self.core._core_bpe.encode_single_piece
        lists = [encode(p) for p in pieces]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter((i for ids in lists for i in ids), np.uint32, int(lengths.sum()))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])
        entries = np.arange(self.n, self.n + len(lists), dtype=np.int32)
        self.n += len(lists)
        at = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.slots[at] == 0)
            _, chosen = np.unique(at[free], return_index=True)
            placed = free[chosen]
            self.slots[at[placed]], self.entry[at[placed]] = hashes[placed], entries[placed]
            left = np.ones(len(at), bool)
            left[placed] = False
            hashes, entries, at = hashes[left], entries[left], (at[left] + 1) & (self.size - 1)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        starts = pretoken_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = self.hasher(data, starts, ends)
        hashes[hashes == 0] = 1
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.n + len(missing) > KEPT:
                self._empty()
                missing = np.arange(len(hashes))
            new, first = np.unique(hashes[missing], return_index=True)
            raw = data.tobytes()
            self._keep(new, [raw[starts[i] : ends[i]] for i in missing[first]])
            found = self._find(hashes)
        begin = self.begin[found]
        lengths = self.begin[found + 1] - begin
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
        at = total[np.searchsorted(starts, offsets)]
        return ids, np.diff(at)

    def encode(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; ``data`` and ``offsets`` are the bytes of the same texts."""
        plain = np.array([not UNSAFE.search(t) and "<|" not in t for t in texts], bool)
        out: list[np.ndarray | None] = [None] * len(texts)
        if plain.all():
            chosen, part, bounds = np.arange(len(texts)), data, offsets
        else:
            chosen = np.flatnonzero(plain)
            lengths = np.diff(offsets)
            part = data[np.repeat(plain, lengths)]
            bounds = np.concatenate([[0], np.cumsum(lengths[chosen])])
        if len(chosen) and len(part):
            ids, counts = self._plain(part, bounds)
            for i, each in zip(chosen, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = each
        for i, each in enumerate(out):
            if each is None:
                out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out
