"""Token ids of whole texts with the `tokenizers` library, memoised by unit.

A byte-level BPE vocabulary splits a text into pre-tokens with a fixed pattern before it merges anything.  A text
may be cut where every such split has a boundary: the ids of the whole are then the ids of the units, one after
the other.  Boundaries that need only two neighbouring bytes are used:

- in front of an ASCII blank or line end that a visible character follows (it is the last one of its run)
- between such a line end, which is no space, and that character
- between ASCII letters, digits and signs of different kinds, apostrophes excepted (they may begin a contraction)

All of it is done for a block of many texts at once.  A unit of up to 15 bytes is an exact pair of 64-bit words, its
bytes and its length, and is looked up in an open table of such pairs; units that are not there are encoded by the library, joined,
and taken apart again by the number of bytes each id stands for.  Longer units are memoised in a dictionary
or encoded as they come.  A text that holds the words of an added token is one unit, and with a
file of another kind each text is.
"""

from __future__ import annotations

import json
import os

import numpy as np

SPACE, LINE, LETTER, DIGIT, SIGN, QUOTE, LATIN = range(1, 8)
_KIND = np.zeros(256, np.uint8)
_KIND[0x20] = SPACE
_KIND[[0x09, 0x0A, 0x0D]] = LINE
_KIND[0x21:0x7F] = SIGN
_KIND[0x30:0x3A] = DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER
_KIND[0x27] = QUOTE
_KIND[0xC3:0xC9] = LATIN  # first byte of U+00C0 to U+023F, all visible
_VISIBLE = (LETTER, DIGIT, SIGN, QUOTE, LATIN)
#: what a pair of kinds says: 1, a unit begins with the first; 2, with the second
_PAIR = np.zeros((8, 8), np.uint8)
for _v in _VISIBLE:
    _PAIR[SPACE, _v] = 1
    _PAIR[LINE, _v] = 3
for _a in (LETTER, DIGIT, SIGN):
    for _b in (LETTER, DIGIT, SIGN):
        if _a != _b:
            _PAIR[_a, _b] = 2
_PAIR = _PAIR.ravel()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
SHORT = 15  # bytes of a unit that is a key by itself
UNITS = 1 << 17  # units that are looked up together


class UnitEncoder:
    """Encodes with a tokenizer's file; `limit` bounds the number of memoised units.

    A full memo keeps what it has, which are the frequent units, unless most of what comes is
    unknown to it: then it starts anew.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.limit = limit
        vocab = self.model.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.added = [x.encode() for x in added]
        self.size = max(vocab.values(), default=0) + 1
        self.width = np.zeros(self.size, np.int64)  # bytes of text that an id stands for
        for token, i in vocab.items():
            self.width[i] = len(token.encode()) if token in added else len(token)
        whole = json.loads(self.model.to_str())
        split = whole["pre_tokenizer"] or {}
        self.cuts = whole["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not whole["model"].get("dropout")
        self._clear()

    def _clear(self) -> None:
        self.count = 1  # the first entry stands for an empty slot
        self.slots = np.zeros(1 << max(10, (2 * self.limit).bit_length()), np.int32)
        self.shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        self.key1, self.key2 = np.zeros((2, 1 << 10), np.uint64)
        self.place, self.many = np.zeros((2, 1 << 10), np.int32)
        self.flat, self.used = np.zeros(1 << 12, np.uint16 if self.size <= 1 << 16 else np.uint32), 0
        self.spare: int | None = None  # where the store's part begins that is not memoised
        self.long: dict[bytes, tuple[int, int]] = {}

    def _keep(self, ids: np.ndarray) -> int:
        """Where `ids` are put in the store."""
        at, need = self.used, self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need - len(self.flat), len(self.flat) // 2), self.flat.dtype)])
        self.flat[at:need] = ids
        self.used = need
        return at

    def _units(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """First byte of each unit of a block of texts."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        if self.cuts and n > 1:
            kind = _KIND[data]
            pair = _PAIR[(kind[:-1] << 3) | kind[1:]]
            edge = off[1:-1]
            pair[edge[(edge > 0) & (edge < n)] - 1] = 0  # two texts' characters are no neighbours
            first[: n - 1] = pair & 1
            first[1:n] |= pair > 1
            raw = data.tobytes() if self.added else b""
            if any(x in raw for x in self.added):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    if any(x in raw[a:b] for x in self.added):
                        first[a:b] = False
        first[off[:-1]] = True
        return np.flatnonzero(first[:n])

    def encode_block(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts data[off[k] : off[k + 1]] in UTF-8: ids of all, one after the other, and
        where each text's begin, with a last one for the end; `end_id` closes each text.  No special tokens are added."""
        start = self._units(data, off)
        stop = np.append(start[1:], len(data))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        cut = np.searchsorted(start, off)  # first unit of each text
        out, many = [], np.zeros(len(start), np.int32)
        ends = np.diff(cut)
        for a in range(0, len(start), UNITS):
            b = min(a + UNITS, len(start))
            place, many[a:b] = self._find(padded, start[a:b], stop[a:b])
            n = many[a:b]
            shift = place - (np.cumsum(n, dtype=np.int32) - n)
            out.append(self.flat[np.repeat(shift, n) + np.arange(int(n.sum()), dtype=np.int32)])
            if self.spare is not None:
                self.used, self.spare = self.spare, None
        ids = np.concatenate(out) if out else np.zeros(0, self.flat.dtype)
        total = np.append(0, np.cumsum(many, dtype=np.int64))
        offsets = total[np.append(0, np.cumsum(ends))]
        if end_id is not None:
            texts = np.arange(len(off) - 1)
            whole = np.full(len(ids) + len(texts), end_id, np.uint32)
            more = np.ones(len(whole), bool)
            more[offsets[1:] + texts] = False
            whole[more] = ids
            return whole, offsets + np.arange(len(off))
        return ids.astype(np.uint32), offsets

    def _find(self, padded: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the store, number of ids) of each unit."""
        size = stop - start
        short = size <= SHORT
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        w1 = eight[start] & _MASK[np.minimum(size, 8)]
        w2 = (eight[start + 8 * (size > 8)] & _MASK[np.clip(size - 8, 0, 7)]) | (np.minimum(size, SHORT + 1).astype(np.uint64) << np.uint64(56))
        if not short.all():
            w1[~short] = w2[~short] = 0
        h = w1 * _K1 ^ w2 * _K2
        h = (h ^ (h >> _K3)) * _K1
        slot = (h >> self.shift).astype(np.int32)
        entry, lost = self._look(w1, w2, slot, short)
        if len(lost):
            order = lost[np.lexsort((w1[lost], w2[lost]))]
            new = np.append(True, (w1[order[1:]] != w1[order[:-1]]) | (w2[order[1:]] != w2[order[:-1]]))
            one, which = order[new], np.cumsum(new) - 1
            if self.count + len(one) > self.limit and 2 * len(lost) > len(start) and self.count > 1:
                self._clear()
                return self._find(padded, start, stop)
            place, many = self._learn(padded, start[one], size[one])
            got_place, got_many = place[which], many[which]
            self._memoise(w1[one], w2[one], slot[one], place, many)
        place, many = self.place[entry], self.many[entry]
        if len(lost):
            place[order], many[order] = got_place, got_many
        if not short.all():
            for k in np.flatnonzero(~short).tolist():
                place[k], many[k] = self._one(padded[start[k] : stop[k]].tobytes())
        return place, many

    def _look(self, w1: np.ndarray, w2: np.ndarray, slot: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each key, keys without one)."""
        entry = self.slots[slot]
        wrong = np.flatnonzero(((self.key1[entry] != w1) | (self.key2[entry] != w2)) & wanted)
        lost, at, mask = [], slot[wrong], len(self.slots) - 1
        while len(wrong):
            e = entry[wrong]
            lost.append(wrong[e == 0])
            wrong, at = wrong[e > 0], (at[e > 0] + 1) & mask
            entry[wrong] = e = self.slots[at]
            off = (self.key1[e] != w1[wrong]) | (self.key2[e] != w2[wrong])
            wrong, at = wrong[off], at[off]
        return entry, np.concatenate(lost) if lost else wrong

    def _memoise(self, w1: np.ndarray, w2: np.ndarray, slot: np.ndarray, place: np.ndarray, many: np.ndarray) -> None:
        """Enter distinct keys, if there is room."""
        a, b = self.count, self.count + len(w1)
        if b > self.limit:
            self.spare = int(place.min())
            return
        if b > len(self.key1):
            more = max(b, 2 * len(self.key1)) - len(self.key1)
            for name in ("key1", "key2", "place", "many"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(more, old.dtype)]))
        self.key1[a:b], self.key2[a:b], self.place[a:b], self.many[a:b] = w1, w2, place, many
        self.count = b
        entry, at, mask = np.arange(a, b, dtype=np.int32), slot, len(self.slots) - 1
        while len(entry):
            free = self.slots[at] == 0
            self.slots[at[free]] = entry[free]  # of several for one slot the last stays
            left = self.slots[at] != entry
            entry, at = entry[left], (at[left] + 1) & mask

    def _learn(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the ids of units, encoded now."""
        total = np.cumsum(size)
        at = np.repeat(start - (total - size), size) + np.arange(int(total[-1]))
        raw, ends = padded[at].tobytes(), total.tolist()
        units = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        # behind a blank, units may be joined and stay units
        blank = (size > 1) & (_KIND[padded[start]] == SPACE) & (_KIND[padded[start + 1]] >= LETTER) & self.cuts
        behind, alone = np.flatnonzero(blank), np.flatnonzero(~blank)
        texts = [b"".join([units[k] for k in behind[a : a + step].tolist()]).decode() for a in range(0, len(behind), step)]
        got = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast([*texts, *(units[k].decode() for k in alone.tolist())], add_special_tokens=False)]
        ids, many = np.concatenate(got), np.zeros(len(start), np.int32)
        many[alone] = [len(x) for x in got[len(texts) :]]
        if len(behind):
            last = np.searchsorted(np.cumsum(self.width[ids[: len(ids) - int(many.sum())]]), np.cumsum(size[behind])) + 1
            many[behind] = np.diff(last, prepend=0)
        order = np.concatenate([behind, alone])
        place = np.zeros(len(start), np.int32)
        place[order] = self._keep(ids) + np.cumsum(many[order]) - many[order]
        return place, many

    def _one(self, unit: bytes) -> tuple[int, int]:
        if unit in self.long:
            return self.long[unit]
        ids = np.array(self.model.encode(unit.decode(), add_special_tokens=False).ids, np.uint32)
        if self.spare is None and len(unit) <= 64 and len(self.long) < self.limit // 16:
            self.long[unit] = out = self._keep(ids), len(ids)
            return out
        if self.spare is None:
            self.spare = self.used
        return self._keep(ids), len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text."""
        raw = [x.encode() for x in texts]
        off = np.cumsum([0, *map(len, raw)])
        ids, at = self.encode_block(np.frombuffer(b"".join(raw), np.uint8), off)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    """Place of the byte-level BPE file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
