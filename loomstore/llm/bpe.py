"""Byte-pair encoding of whole batches: numpy splits a batch into words, each distinct word is encoded once.

The split follows the two patterns of public tokenizers with byte alphabets (a leading space belongs
to the next word; or white space is dropped and text lower-cased). Where white space is kept, the class of a
character (space, letter, number, other) is asked of the library itself when the character is first seen. The
lower-casing kind is split here for code points from a verified range; a document with any other character, or
with the string of a special token, is encoded by the library. Results are those of the library in every case.

``prefix_counts`` is dynamic programming over the prefixes of a word. The encoding of a prefix ends
in the one token that stands well (merges nothing across) after the encoding of what precedes it, so
the count at p is one more than the count where that token starts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd

from .shared import held
from .textops import mix, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)
#: Bounds of what a worker remembers; beyond them it starts anew. They change speed only.
MAX_WORDS, MAX_IDS, MAX_PAIRS = 300_000, 4_000_000, 400_000


def _byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in keep else next(free)) for b in range(256)]


def _classes(ranges: Sequence[tuple[int, int]], unsafe: Sequence[int]) -> np.ndarray:
    import regex

    out = np.full(0x110000, UNSAFE, np.uint8)
    kinds = (regex.compile(r"\s"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}"))
    for a, b in ranges:
        for c in range(a, b):
            out[c] = next((k for k, p in enumerate(kinds) if p.match(chr(c))), OTHER)
    out[list(unsafe)] = UNSAFE
    return out


class BatchEncoder:
    """path: a tokenizer file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tok = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.alphabet = _byte_alphabet()
        self.table = str.maketrans({i: c for i, c in enumerate(self.alphabet)})
        pre = spec["pre_tokenizer"]
        self.spaced = pre["type"] == "ByteLevel"
        ranges, unsafe = [], []
        if self.spaced:
            plain = spec["normalizer"] is None and pre["use_regex"] and not pre["add_prefix_space"]
            plain = plain and not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        else:
            plain = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
            ranges, unsafe = [(0, 0x300), (0x2010, 0x2028)], [*range(0x1C, 0x20), 0x130]
        if not plain or spec["post_processor"] is not None:
            raise ValueError(f"{path}: this kind of tokenizer file is not supported")
        self.cls = _classes(ranges, unsafe)
        if not self.spaced:
            self.lower = np.arange(0x110000, dtype=np.uint32)
            for a, b in ranges:
                for c in range(a, b):
                    if len(low := chr(c).lower()) == 1:
                        self.lower[c] = ord(low)
        self.vals = mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
        vocab = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.tails: dict[bytes, int] = {}  # every suffix of every token; its id if it is a token, else -1
        if self.spaced:
            tokens = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.specials}
            for t in tokens:
                for s in range(len(t)):
                    self.tails.setdefault(t[s:], -1)
            self.tails.update(tokens)
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.index: dict[int, int] = {}
        self.off, self.len, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0
        self.p_index: dict[int, int] = {}
        self.p_off, self.p_len, self.p_flat, self.p_used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int16), 0

    def _learn(self, cp: np.ndarray) -> None:
        """Ask the library for the classes of characters not seen before."""
        split = self.tok.pre_tokenizer.pre_tokenize_str
        for c in np.unique(cp[self.cls[cp] == UNSAFE]).tolist():
            alone = lambda x: len(split(x + chr(c))) == 1  # noqa: B023, E731
            self.cls[c] = LETTER if alone("a") else NUMBER if alone("1") else OTHER if alone("!") else SPACE

    # -- splitting ---------------------------------------------------------------------------

    def _split(self, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of words; bounds: where documents start, and the end."""
        n = len(cp)
        cls = self.cls[cp]
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        start = first[:n].copy()
        start[1:] |= cls[1:] != cls[:-1]
        if not self.spaced:
            start |= cls == NUMBER
        else:
            lead = np.flatnonzero(start[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~first[1:n]) + 1
            start[lead - 1] = True
            start[lead[cp[lead - 1] == 32]] = False
        quote = np.flatnonzero((cp == 39) & start)
        quote = quote[quote + 1 < n]
        quote = quote[~first[quote + 1]]
        if len(quote):
            c1 = cp[quote + 1]
            last = np.minimum(quote + 2, n - 1)
            c2 = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], cp[last], 0)
            two = np.isin(c1, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            three = ((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108)
            for q, k in ((quote[two], 2), (quote[three], 3)):
                start[q + 1] = False
                if k == 3:
                    start[q + 2] = False
                after = q + k
                start[after[after < n]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)[: len(starts)]
        if not self.spaced:
            keep = cls[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _plain(self, texts: Sequence[str], cp: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Documents that need more than the split: those with strings of special tokens or characters outside the verified range."""
        if self.spaced:
            self._learn(cp)
        bad = np.unique(np.searchsorted(bounds, np.flatnonzero(self.cls[cp] == UNSAFE), "right") - 1).tolist()
        if (cp == ord("<")).any():
            bad = sorted({*bad, *(i for i, t in enumerate(texts) if any(x in t for x in self.specials))})
        return bad

    def _words(self, texts: Sequence[str]):
        text = "".join(texts)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not self.spaced:
            cp = self.lower[cp]
        bad = self._plain(texts, cp, bounds)
        starts, ends = self._split(cp, bounds)
        h = span_hashes(self.vals[cp], starts, ends)
        code, uniq = pd.factorize(h)
        where = np.empty(len(uniq), np.int64)
        where[code[::-1]] = np.arange(len(h))[::-1]  # first occurrence of each
        if not self.spaced:
            text = cp.tobytes().decode("utf-32-le")
        begin, end = starts[where].tolist(), ends[where].tolist()
        return cp, bounds, bad, starts, ends, code, uniq, lambda k: text[begin[k] : end[k]]

    # -- ids ---------------------------------------------------------------------------------

    def _model_ids(self, word: str) -> list[int]:
        raw = word if word.isascii() else word.encode().decode("latin-1")
        return [t.id for t in self.tok.model.tokenize(raw.translate(self.table))]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text (int32), without added special tokens."""
        if not len(texts):
            return []
        if len(self.index) > MAX_WORDS or self.used > MAX_IDS:
            self._reset()
        cp, bounds, bad, starts, ends, code, uniq, word = self._words(texts)
        at = np.empty(len(uniq), np.int64)
        for k, h in enumerate(uniq.tolist()):
            i = self.index.get(h)
            if i is None:
                i = len(self.index)
                ids = self._model_ids(word(k))
                if i == len(self.off):
                    self.off, self.len = np.resize(self.off, 2 * i), np.resize(self.len, 2 * i)
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.resize(self.flat, 2 * len(self.flat))
                self.flat[self.used : self.used + len(ids)] = ids
                self.off[i], self.len[i] = self.used, len(ids)
                self.used += len(ids)
                self.index[h] = i
            at[k] = i
        ids, ends_at = _gather(self.flat, self.off[at], self.len[at], code)
        doc = ends_at[np.searchsorted(starts, bounds)]
        out = [ids[a:b] for a, b in zip(doc[:-1].tolist(), doc[1:].tolist())]
        for i in bad:
            out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out

    # -- counts at prefixes --------------------------------------------------------------------

    def _stands(self, left: int, right: int, both: bytes) -> bool:
        """Does the encoding of both tokens' bytes leave them as they are?"""
        key = left << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = [t.id for t in self.tok.model.tokenize(both.decode("latin-1").translate(self.table))] == [left, right]
        return ok

    def prefix_counts(self, words: list[bytes]) -> list[list[int]]:
        """For each word, the token count of the encoding of its first i + 1 bytes, for each i. Words in ascending order share the work on common prefixes."""
        tails, stands, pairs = self.tails, self._stands, self.pairs
        count, last, start, before, out = [0], [-1], [0], b"", []
        for b in words:
            n = 0
            for x, y in zip(before, b):
                if x != y:
                    break
                n += 1
            del count[n + 1 :], last[n + 1 :], start[n + 1 :]
            for p in range(n + 1, len(b) + 1):
                ends, s = [], p - 1
                while s >= 0 and (t := tails.get(b[s:p])) is not None:
                    if t >= 0:
                        ends.append((t, s))
                    s -= 1
                for t, s in reversed(ends):
                    if s == 0:
                        break
                    ok = pairs.get(last[s] << 20 | t)
                    if ok or ok is None and stands(last[s], t, b[start[s] : p]):
                        break
                count.append(count[s] + 1)
                last.append(t)
                start.append(s)
            out.append(count[1:])
            before = b
        return out

    def count_prefixes(self, texts: Sequence[str], ordinary: bool = False) -> list[np.ndarray]:
        """For each text an int32 array: at i the token count of the encoding of text[:i], for 0 <= i <= len(text). ordinary: strings of special tokens are text like any other.

        Time and memory grow with the text, whatever its characters.
        """
        if not self.spaced:
            raise ValueError("prefix counts need a tokenizer that keeps white space")
        if not len(texts):
            return []
        if len(self.p_index) > MAX_WORDS or self.p_used > 2 * MAX_IDS:
            self._reset()
        cp, bounds, bad, starts, ends, code, uniq, word = self._words(texts)
        at = np.empty(len(uniq), np.int64)
        new = []
        for k, h in enumerate(uniq.tolist()):
            if h not in self.p_index:
                new.append((word(k).encode(), h))
        new.sort()
        fresh = {h: (b, got) for (b, h), got in zip(new, self.prefix_counts([b for b, _ in new]))}
        for k, h in enumerate(uniq.tolist()):
            i = self.p_index.get(h)
            if i is None:
                i = len(self.p_index)
                b, got = fresh[h]
                if not b.isascii():
                    got = [got[j] for j in range(len(b)) if j + 1 == len(b) or b[j + 1] & 0xC0 != 0x80]
                if i == len(self.p_off):
                    self.p_off, self.p_len = np.resize(self.p_off, 2 * i), np.resize(self.p_len, 2 * i)
                while self.p_used + len(got) > len(self.p_flat):
                    self.p_flat = np.resize(self.p_flat, 2 * len(self.p_flat))
                if got[-1] > 32_000:
                    self.p_flat = self.p_flat.astype(np.int32)
                self.p_flat[self.p_used : self.p_used + len(got)] = got
                self.p_off[i], self.p_len[i] = self.p_used, len(got)
                self.p_used += len(got)
                self.p_index[h] = i
            at[k] = i
        inside, _ = _gather(self.p_flat, self.p_off[at], self.p_len[at], code)
        inside = inside.astype(np.int64)
        whole = inside[ends - 1]
        total = np.concatenate([[0], np.cumsum(whole)])  # before each word, since the chunk's start
        lens = ends - starts
        run = np.repeat(total[:-1], lens) + inside
        base = total[np.searchsorted(starts, bounds)]
        self._amend(cp, bounds, starts, ends, total, run)
        out = []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            x = np.zeros(b - a + 1, np.int32)
            x[1:] = run[a:b] - base[i]
            out.append(x)
        for i in bad if not ordinary else ():
            out[i] = self._special_prefixes(texts[i])
        return out

    def _amend(self, cp, bounds, starts, ends, total, run) -> None:
        """Prefixes that end where the split of the prefix differs from that of the text: after the last of two or more white-space characters, and inside a contraction of three characters."""
        cls = self.cls[cp]
        first = np.zeros(len(cp) + 1, bool)
        first[bounds] = True
        goes_on = (cls[starts] == SPACE) & (cls[ends - 1] == SPACE) & (ends < len(cp)) & ~first[ends] & (np.append(cls, OTHER)[ends] == SPACE)
        for w in np.flatnonzero(goes_on).tolist():  # the run of white space has one more character
            s, e = int(starts[w]), int(ends[w])
            run[e] = total[w] + len(self._model_ids(cp[s : e + 1].tobytes().decode("utf-32-le")))
        three = np.flatnonzero((ends - starts == 3) & (cp[starts] == 39) & np.isin(cp[np.minimum(starts + 1, len(cp) - 1)], [114, 118, 108]) & (cls[np.minimum(starts + 2, len(cp) - 1)] == LETTER))
        for w in three.tolist():
            run[starts[w] + 1] = total[w] + 2

    def _special_prefixes(self, text: str) -> np.ndarray:
        """For a text with strings of special tokens: each is one token from its end on, and before that, ordinary text that follows what precedes it."""
        import regex

        ends = [m.end() for m in regex.finditer("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))), text)]
        starts = [0, *ends]
        stretches = [text[a:b] for a, b in zip(starts, [*ends, len(text)])]
        out, done = np.zeros(len(text) + 1, np.int32), 0
        for i, (a, part, counts) in enumerate(zip(starts, stretches, self.count_prefixes(stretches, ordinary=True))):
            out[a + 1 : a + len(part) + 1] = done + counts[1:]
            if i < len(ends):
                name = max((x for x in self.specials if part.endswith(x)), key=len)
                done += int(counts[len(part) - len(name)]) + 1
                out[ends[i]] = done
        return out


def _gather(flat: np.ndarray, off: np.ndarray, lens: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[off[c]:off[c]+lens[c]] for c in code, end to end; and where each starts, and the end."""
    n = lens[code]
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return flat[np.repeat(off[code] - ends[:-1], n) + np.arange(ends[-1])], ends


_encoders: dict[str, BatchEncoder] = {}
held(_encoders.clear, "bpe")


def encoder(path: str) -> BatchEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]
