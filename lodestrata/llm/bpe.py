"""Byte-pair encodings of whole texts with work per distinct piece.

Texts are cut into the tokenizer's pieces by vectorised rules on character classes; each distinct piece is encoded
once and kept in a bounded cache of the Python worker. A text with the tokenizer's special string, or with a
character that Unicode versions treat differently, is given to the tokenizers library as it is.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

from lodestrata.llm import vec

#: Distinct pieces that a worker keeps (some 16 bytes each, and the ids); beyond it the cache starts anew.
CACHE_PIECES = 2_000_000


class PieceCache:
    """Hash of a piece -> a number, as sorted arrays."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of sorted keys, and which are missing."""
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        return self.values[near], self.keys[near] != keys

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


def pieces(cp: np.ndarray, starts: np.ndarray, joined_space: bool, single_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pieces of all texts.

    joined_space: one blank before a run belongs to it and white space makes pieces of its own; otherwise white
    space is dropped. single_numbers: each number character is a piece.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = vec.tables()[0][np.minimum(cp, vec._TOP - 1)]
    new = np.zeros(n + 1, bool)  # a text begins here
    new[starts] = True
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut |= new
    if single_numbers:
        cut[:n] |= kind == vec.NUMBER
    apostrophe = np.flatnonzero((cp == 39) & cut[:n] & cut[1:])  # a run of this one character
    if joined_space:
        after = np.flatnonzero(cut[1:n] & ~new[1:n] & (kind[:-1] == vec.SPACE) & (kind[1:] != vec.SPACE)) + 1
        cut[after - 1] = True
        cut[after[cp[after - 1] == 32]] = False
    for suffix in ("s", "t", "re", "ve", "m", "ll", "d"):
        at, m = apostrophe[apostrophe + len(suffix) < n], len(suffix)
        at = at[cut[at]]
        for i, c in enumerate(suffix):
            at = at[(cp[at + 1 + i] == ord(c)) & ~new[at + 1 + i]]
        cut[at + 1] = False
        cut[at + 1 + m] = True
    at = np.flatnonzero(cut)
    s, e = at[:-1], at[1:]
    if not joined_space:
        word = kind[s] != vec.SPACE
        s, e = s[word], e[word]
    return s, e


class Encoder:
    """Ids of texts by the byte-level vocabulary at ``folder``/byte_bpe_50k.json, as the tokenizers library gives them.

    Its rank file holds the same vocabulary and encodes single pieces; a test compares both on whole tables.
    """

    def __init__(self, folder: str, cache: int = CACHE_PIECES):
        self.folder = folder
        self.known = PieceCache(cache)
        self.flat, self.at, self.size, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0, 0
        self._bpe = self._whole = None
        meta = json.load(open(os.path.join(folder, "byte_bpe_50k.json")))
        self.special = [t["content"] for t in meta["added_tokens"]]

    def bpe(self):
        if self._bpe is None:
            import tiktoken

            ranks = {}
            with open(os.path.join(self.folder, "byte_bpe_50k.tiktoken"), "rb") as f:
                for line in f:
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
            # Fixed value: the published pattern of this vocabulary.
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self._bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
            self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]
        return self._bpe

    def whole(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(os.path.join(self.folder, "byte_bpe_50k.json"))
        return self._whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and where each text's ids begin (one more at the end)."""
        cp, starts = vec.codes(texts)
        stable = vec.tables()[2]
        odd = np.zeros(len(cp) + 1, np.int64)
        np.cumsum((cp >= vec._TOP) | ~stable[np.minimum(cp, vec._TOP - 1)], out=odd[1:])
        slow = {i for i in np.flatnonzero(odd[starts[1:]] - odd[starts[:-1]]).tolist()}
        slow |= {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        s, e = pieces(cp, starts, True, False)
        h = vec.spans_hash(cp, s, e)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known.keys) + len(distinct) > self.known.limit:
            self.known.clear()
            self.size = self.n = 0
        index, missing = self.known.get(distinct)
        if missing.any():
            self.learn("".join(texts), cp, s[where[missing]], e[where[missing]])
            index[missing] = np.arange(self.n - missing.sum(), self.n)
            self.known.put(distinct[missing], index[missing])
        index = index[back.reshape(-1)]
        begin, count = self.at[index], self.at[index + 1] - self.at[index]
        done = np.cumsum(count)
        ids = self.flat[np.repeat(begin - (done - count), count) + np.arange(done[-1] if len(done) else 0)]
        first = np.concatenate([[0], done])[np.searchsorted(s, starts)]
        if slow:
            parts = [np.array(self.whole(t), np.int32) if i in slow else ids[first[i] : first[i + 1]] for i, t in enumerate(texts)]
            ids = np.concatenate(parts)
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first


    def learn(self, joined: str, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Append the ids of new pieces. Words behind one blank are encoded in one call: the pattern parts them again."""
        bpe = self.bpe()
        kind = vec.tables()[0]
        word = (cp[s] == 32) & (e - s > 1) & (kind[np.minimum(cp[e - 1], vec._TOP - 1)] == vec.LETTER)
        lo, hi = s.tolist(), e.tolist()
        counts, ids = np.zeros(len(s), np.int64), []
        together = np.flatnonzero(word)
        texts = [joined[lo[i] : hi[i]] for i in together.tolist()]
        many = np.array(bpe.encode_ordinary("".join(texts)), np.int32)
        ends = np.cumsum(self.bytes_of[many])
        own = np.cumsum([len(t.encode()) for t in texts]) if texts else np.zeros(0, np.int64)
        counts[together] = np.diff(np.searchsorted(ends, own), prepend=-1)
        for i in np.flatnonzero(~word).tolist():
            got = bpe.encode_ordinary(joined[lo[i] : hi[i]])
            counts[i] = len(got)
            ids.extend(got)
        total = np.cumsum(counts)
        while self.size + total[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(s) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        grouped = np.repeat(word, counts)
        part = self.flat[self.size : self.size + total[-1]]
        part[grouped], part[~grouped] = many, ids
        self.at[self.n] = self.size
        self.at[self.n + 1 : self.n + 1 + len(s)] = self.size + total
        self.size, self.n = self.size + int(total[-1]), self.n + len(s)


class MergeCounter:
    """Token counts by heap-and-linked-list byte-pair merging: symbols at first minus merges; no ids are made."""

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        with open(path) as f:
            doc = json.load(f)
        self.path, self.known, self._whole = path, PieceCache(cache), None
        model = doc["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in doc["added_tokens"]]
        shown = byte_symbols()
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + end] for c in shown]
        # pair of ids -> (rank, id of the merged symbol)
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))

    def count_piece(self, data: bytes) -> int:
        """Tokens of one piece of bytes."""
        n = len(data)
        if n < 2:
            return n
        get = self.merge.get
        sym = [self.inner[b] for b in data]
        sym[-1] = self.last[data[-1]]
        heap = []
        for i in range(n - 1):
            found = get(sym[i] << 20 | sym[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, new = pop(heap)
            a = sym[i]
            j = after[i]
            if a < 0 or j >= n:
                continue
            found = get(a << 20 | sym[j])
            if found is None or found[1] != new:
                continue  # one side has been merged meanwhile
            sym[i], sym[j] = new, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = get(new << 20 | sym[k])
                if found:
                    push(heap, (found[0], i, found[1]))
            k = before[i]
            if k >= 0:
                found = get(sym[k] << 20 | new)
                if found:
                    push(heap, (found[0], k, found[1]))
        return n - merges

    def whole(self, text: str) -> int:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return len(self._whole.encode(text, add_special_tokens=False).ids)

    def count(self, texts: list[str]) -> np.ndarray:
        kind, lower, stable, _ = vec.tables()
        cp, starts = vec.codes(texts)
        at = np.minimum(cp, vec._TOP - 1)
        odd = np.zeros(len(cp) + 1, np.int64)
        np.cumsum((cp >= vec._TOP) | ~stable[at], out=odd[1:])
        slow = set(np.flatnonzero(odd[starts[1:]] - odd[starts[:-1]]).tolist())
        slow |= {i for i, t in enumerate(texts) if any(x in t for x in self.special) or not unicodedata.is_normalized("NFC", t)}
        low = lower[at]
        s, e = pieces(low, starts, False, True)
        h = vec.spans_hash(low, s, e)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known.keys) + len(distinct) > self.known.limit:
            self.known.clear()
        got, missing = self.known.get(distinct)
        if missing.any():
            joined = low.tobytes().decode("utf-32-le", "replace")
            lo, hi = s[where[missing]].tolist(), e[where[missing]].tolist()
            got[missing] = [self.count_piece(joined[i:j].encode()) for i, j in zip(lo, hi, strict=True)]
            self.known.put(distinct[missing], got[missing])
        each = got[back.reshape(-1)]
        total = np.concatenate([[0], np.cumsum(each)])
        out = np.diff(total[np.searchsorted(s, starts)])
        for i in slow:
            out[i] = self.whole(texts[i])
        return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


@lru_cache(2)
def encoder(folder: str) -> Encoder:
    return Encoder(folder)


@lru_cache(2)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def tokenizer_folder() -> str:
    """Folder of the public vocabularies on this machine; a parameter of every operator that needs one."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
