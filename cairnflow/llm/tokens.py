"""Tokenisers on the executors.

White space ends a pre-token of a file with word ends, so the ids of a stretch between spaces do not depend on
its neighbours, and each worker keeps the stretches it has met in a ``Lexicon``.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Stretches that a worker keeps, about 200 bytes each.
CACHE = 700_000
#: Ids below this have a square table of ranks.
LOW = 1024


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    at = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


def _special_ids(spec: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}


class PairIndexBpe:
    """Byte-pair encoding of many words at once over an index from each pair to all its positions.

    The words' symbols lie in one array with links to their neighbours. A heap holds the ranks of the pairs
    that occur; the lowest is taken, all its positions are merged, and the positions to the left and right
    of each merge enter the lists of the pairs that they now form. A listed position whose pair has changed
    since is skipped when its turn comes.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        pairs = [(vocab[a] << 20 | vocab[b], vocab[a + b]) for a, b in merges]
        code = np.array([p for p, _ in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order.astype(np.int32)
        self.left = np.array([p >> 20 for p, _ in pairs], np.int32)
        self.right = np.array([p & (1 << 20) - 1 for p, _ in pairs], np.int32)
        self.merged = np.array([m for _, m in pairs], np.int32)
        # ranks of pairs of low ids, among them the single bytes, by place
        self.low = np.full((LOW, LOW), -1, np.int32)
        few = (self.left < LOW) & (self.right < LOW)
        self.low[self.left[few], self.right[few]] = np.flatnonzero(few)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' ranks, -1 where they do not merge."""
        if len(left) > LOW and max(left.max(), right.max()) < LOW:
            return np.where((left >= 0) & (right >= 0), self.low[left, right], -1)
        code = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.code[at] == code) & (left >= 0) & (right >= 0), self.rank[at], -1)

    def encode(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as one array of first symbols and their counts; the same for the merged ids."""
        # one cell of -1 after each word keeps pairs within words
        word = np.repeat(np.arange(len(lengths)), lengths)
        cells = np.arange(len(symbols)) + word + 1
        sym = np.full(len(symbols) + len(lengths) + 1, -1, np.int32)
        sym[cells] = symbols
        nxt = np.arange(1, len(sym) + 1)
        nxt[-1] = len(sym) - 1
        prv = np.arange(-1, len(sym) - 1)
        prv[0] = 0
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray, rank: np.ndarray) -> None:
            keep = rank >= 0
            both = np.sort(rank[keep].astype(np.int64) << 40 | at[keep])
            if not len(both):
                return
            at, rank = both & (1 << 40) - 1, both >> 40
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for k, r in enumerate(rank[bounds[:-1]].tolist()):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(at[bounds[k] : bounds[k + 1]])

        post(cells, self.ranks(sym[cells], sym[nxt[cells]]))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping pairs the left one wins
                taken, last = [], -1
                for p in at.tolist():
                    if p != last:
                        taken.append(p)
                        last = nxt[p]
                at = np.array(taken)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.merged[r]
            sym[gone] = -2
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            post(np.concatenate((before, at)), np.concatenate((self.ranks(sym[before], sym[at]), self.ranks(sym[at], sym[after]))))
        alive = sym[cells] >= 0
        return sym[cells][alive], np.bincount(word[alive], minlength=len(lengths))


class WordTokenizer:
    """A BPE file with word ends: NFC, white space, lower case, split, bytes as characters, merges.

    ``ids`` and ``pieces`` equal the tokenizers library's encode with add_special_tokens=False; texts of its
    special tokens become their ids, as there.
    """

    #: white space of Python or of the tokeniser's patterns, but not of both
    odd = re.compile("[\x1c-\x1f\u180e\u200b]")
    #: those, and white space other than space and newline
    rare = tuple("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000")
    rare_ascii = rare[:8]
    #: here the signs that end a stretch are a pre-token of their own ("|" is left out for the special tokens)
    last_signs = r"([a-zà-öø-ÿ])([!-/:-@\[-`{}~]+) "
    ending = frozenset(".,;:!?|)")

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.special = _special_ids(spec)
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        chars = byte_chars()
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + end] for c in chars], np.int32)
        self.bpe = PairIndexBpe(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def spaced(self, text: str) -> str:
        """The normalised text with single spaces, or runs of them, for all white space."""
        if "<|" in text or any(c in text for c in (self.rare_ascii if text.isascii() else self.rare)):
            return " ".join(self.stretches(text))
        return self._normal(text).lower().replace("\n", " ")

    def stretches(self, text: str) -> list[str]:
        """The text's parts between white space, normalised; special tokens stand alone as they are."""
        if "<|" in text:
            return [s for k, part in enumerate(self.special_at.split(text)) for s in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _normal(self, text: str) -> str:
        if not text.isascii():
            try:
                text.encode("latin-1")  # characters below U+0300 are composed already
            except UnicodeEncodeError:
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # its lower case depends on the place in Python, not in the tokeniser
                text = "".join(map(str.lower, text))
        return text

    def _plain(self, text: str) -> list[str]:
        text = self._normal(text)
        if self.odd.search(text):
            return [w for s in regex.split(r"[\p{White_Space}]+", text.lower()) for w in [s] if w]
        return text.lower().split()

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches, and how many each has."""
        plain = np.fromiter(map(str.isalpha, stretches), bool, len(stretches))
        if plain.all():
            return self._merge(stretches)
        rest = list(compress(stretches, ~plain))
        per, words = [], list(compress(stretches, plain))
        place = {w: k for k, w in enumerate(words)}  # a word is encoded once, however many stretches hold it
        order = []
        for s in rest:
            own = self._words(s)
            per.append(len(own))
            for w in own:
                order.append(place.setdefault(w, len(place)))
        words = list(place)
        ids, counts = self._merge(["" if w in self.special else w for w in words] if any(w in self.special for w in rest) else words)
        at = np.cumsum(counts) - counts
        for w in filter(self.special.__contains__, rest):
            k = place[w]
            if not counts[k]:
                counts[k], at[k] = 1, len(ids)
                ids = np.append(ids, np.int32(self.special[w]))
        n_words = np.ones(len(stretches), np.int64)
        n_words[~plain] = per
        own = np.empty(int(n_words.sum()), np.int64)
        from_rest = np.repeat(~plain, n_words)
        own[from_rest] = order
        own[~from_rest] = np.arange(int(plain.sum()))
        upto = np.concatenate(([0], np.cumsum(counts[own])))
        bounds = upto[np.concatenate(([0], np.cumsum(n_words)))]
        return gather(ids, at[own], counts[own]), np.diff(bounds)

    def _words(self, stretch: str) -> list[str]:
        """The pre-tokens; the pattern is not run where it is plain what it finds."""
        if stretch.isalpha():
            return [stretch]
        if stretch in self.special:
            return [stretch]
        if stretch[-1:] in self.ending and stretch[:-1].isalpha():
            return [stretch[:-1], stretch[-1]]
        return self.words.findall(stretch)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        held = pa.array(words, pa.large_string())
        bounds = np.frombuffer(held.buffers()[1], np.int64, len(words) + 1) if words else np.zeros(1, np.int64)
        lengths = np.diff(bounds)
        if not bounds[-1]:
            return np.zeros(0, np.int32), lengths
        raw = np.frombuffer(held.buffers()[2], np.uint8, int(bounds[-1]))
        symbols = self.inner[raw]
        ends = bounds[1:][lengths > 0] - 1
        symbols[ends] = self.final[raw[ends]]
        ids, counts = self.bpe.encode(symbols, lengths)
        return ids, counts


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``values`` from each start, one after another."""
    ends = np.cumsum(length)
    return values[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ByteTokenizer:
    """A byte-level BPE file, by tiktoken's merges over the file's vocabulary; ids equal the tokenizers library's
    encode with add_special_tokens=False, the texts of special tokens included."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        at, special = {c: b for b, c in enumerate(byte_chars())}, _special_ids(spec)
        ranks = {bytes(at[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # the byte-level pre-tokeniser's own pattern
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text:
            return self.bpe.encode_to_numpy(text, allowed_special="all")
        return self.bpe.encode_to_numpy(text, disallowed_special=())


class Lexicon:
    """The ids of the stretches that a worker has met.

    Texts of a batch are split and numbered by Arrow, so that Python looks at each distinct stretch once; the ids
    are then gathered for all of them together. When over ``CACHE`` stretches are held, those met once are dropped.
    """

    def __init__(self, encode):
        self.encode_new = encode
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length, self.uses = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _trim(self) -> None:
        kept = [(w, k) for w, k in self.slot.items() if self.uses[k] > 1]
        if len(kept) > CACHE // 2:
            kept = []
        own = np.array([k for _, k in kept], np.int64)
        ids, lengths = gather(self.ids, self.start[own], self.length[own]), self.length[own]
        self._clear()
        self._add([w for w, _ in kept], ids, lengths)

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, at, total = len(words), len(self.slot), len(ids)
        while at + n > len(self.start):
            self.start, self.length, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length, self.uses))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.start[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + n] = lengths
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.slot.update(zip(words, range(at, at + n)))

    def slots(self, words: pa.StringArray) -> np.ndarray:
        """The number of each word, new ones encoded."""
        coded = words.dictionary_encode()
        entries = coded.dictionary.to_pylist()
        if len(self.slot) > CACHE:
            self._trim()
        new = [w for w in entries if w not in self.slot]
        for k in range(0, len(new), 200_000):
            self._add(new[k : k + 200_000], *self.encode_new(new[k : k + 200_000]))
        own = np.fromiter(map(self.slot.__getitem__, entries), np.int64, len(entries))
        self.uses[own] += 1
        return own[coded.indices.to_numpy()] if len(entries) else np.zeros(0, np.int64)

    def documents(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts whose stretches stand between single spaces, and the bounds of each text's."""
        parts = pc.split_pattern(texts, " ")
        at = self.slots(parts.flatten())
        upto = parts.offsets.to_numpy().astype(np.int64)
        upto = upto - upto[0]
        return gather(self.ids, self.start[at], self.length[at]), np.concatenate(([0], np.cumsum(self.length[at])))[upto]


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=4)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


@lru_cache(maxsize=4)
def word_lexicon(path: str) -> Lexicon:
    return Lexicon(word_tokenizer(path).encode)


def word_documents(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts by a file with word ends, and the bounds of each text's."""
    tok = word_tokenizer(path)
    spaced = pa.array(map(tok.spaced, texts), pa.large_string())
    # fewer distinct stretches: the pre-tokens are cut there anyway
    return word_lexicon(path).documents(pc.replace_substring_regex(spaced, tok.last_signs, r"\1 \2 "))
