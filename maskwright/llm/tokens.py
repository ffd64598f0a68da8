"""Token ids of whole texts, by the tokenizers library, with each distinct piece of text encoded once.

Both kinds of tokenizer used here cut a text before its model runs, so that the ids of a text are those of
its segments in a row: words, for a model that drops white space; runs of white space with what follows
them, for a byte-level model. Segments are cut, hashed (64 bits) and counted with numpy; only those that a
worker does not remember go through the tokenizer. Added tokens of the file (<|endoftext|>) are found in
the raw text first, as the library does, and what stands between them is cut as texts of its own.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import LOWER, SPACE, span_hashes, text_pieces, word_spans

#: Distinct segments that a worker remembers, and text bytes that it takes at once.
REMEMBER, CHUNK = 600_000, 2 << 20
#: Places in the table of remembered segments.
_TABLE_BITS = 20
_TABLE_SHIFT = np.uint64(64 - _TABLE_BITS)

_OPEN: dict[str, "Encoder"] = {}
_RUN = np.zeros(256, bool)
_RUN[[0x20, 0x0A, 0x09, 0x0D]] = True
_RARE = np.zeros(256, bool)  # white space to some, or the last byte of such
_RARE[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation but the apostrophe, with which a contraction begins
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True


def _mark_cuts(data: np.ndarray) -> np.ndarray:
    """Where an ASCII letter and a mark meet: both models cut there."""
    letter, mark = _LETTER[data], _MARK[data]
    return (letter & np.roll(mark, 1)) | (mark & np.roll(letter, 1))


def _word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and their parts between letters and marks."""
    if not len(data):
        return word_spans(data, offs)
    inside = ~SPACE[data]
    cut = _mark_cuts(data)
    cut[offs[:-1][offs[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (cut | ~np.roll(inside, 1)))
    ends = np.flatnonzero(inside & (np.roll(cut, -1) | ~np.roll(inside, -1))) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _lead_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments that begin where a run of white space begins; never within a run of any white space."""
    space = _RUN[data]
    start = np.zeros(len(data), bool)
    if len(data):
        last = np.roll(data, 1)
        two, three = np.roll(data, 2), np.roll(data, 3)
        start = space & ~np.roll(space, 1) & ~_RARE[last] & ~((last >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
        start |= _mark_cuts(data)
        start[offs[:-1][offs[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, offs)


def _whole_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts."""
    some = np.diff(offs) > 0
    return offs[:-1][some], offs[1:][some], np.concatenate([[0], np.cumsum(some)])


class Encoder:
    """Texts to ids as with add_special_tokens=False: none are put around a text, those within it have their ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm, added = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("added_tokens") or []
        steps = pre.get("pretokenizers", [])
        # found here and not by the model if they are matched in the raw text just as they are
        plain = all(x["special"] and not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) for x in added)
        if plain and added:
            self.added = {x["content"].encode(): x["id"] for x in added}
            self.any_added = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)))
            self.model.encode_special_tokens = True
        if not plain:
            self.cut = _whole_spans
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            self.cut = _lead_spans
        elif steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
            self.cut, self.fold = _word_spans, any(x.get("type") == "Lowercase" for x in (norm or {}).get("normalizers", [norm or {}]))
        else:  # whole texts
            self.cut = _whole_spans
        self._forget()

    cut, fold, added, any_added = None, False, {}, None

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.near_hash, self.near_slot = np.zeros(1 << _TABLE_BITS, np.uint64), np.full(1 << _TABLE_BITS, -1, np.int64)
        self.starts, self.sizes, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.store = np.zeros(1 << 18, np.uint32)

    def _remember(self, hashes: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, have = len(self.slot), self.used
        while n + len(hashes) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts] * 2), np.concatenate([self.sizes] * 2)
        while have + len(ids) > len(self.store):
            self.store = np.concatenate([self.store] * 2)
        self.store[have : have + len(ids)] = ids
        self.sizes[n : n + len(hashes)] = sizes
        self.starts[n : n + len(hashes)] = have + np.cumsum(sizes) - sizes
        self.slot.update(zip(hashes, range(n, n + len(hashes)), strict=True))
        self.used += len(ids)

    def _model_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, is_pretokenized=True, add_special_tokens=False)
        at = np.array(found.word_ids, np.int64)
        return np.array(found.ids, np.uint32), np.bincount(at, minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of segments, and how many each has."""
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.store[np.arange(total) + np.repeat(self.starts[slots] - (ends - sizes), sizes)], sizes

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (bytes and offsets), and the place in them where each text begins (n + 1)."""
        raw = data.tobytes() if self.added else b""
        if not any(x in raw for x in self.added):
            return self._encode(data, offs)
        # within each text, as the end of one and the beginning of the next make no token
        found = [m for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for m in self.any_added.finditer(raw, a, b)]
        starts, sizes = np.array([m.start() for m in found], np.int64), np.array([len(m[0]) for m in found], np.int64)
        gone = np.concatenate([[0], np.cumsum(sizes)])
        left = np.ones(len(data), bool)
        for m in found:
            left[m.start() : m.end()] = False
        # the texts between are cut where a text begins or a token stood; at the same place the text begins first
        bounds = np.concatenate([offs, starts])
        order = np.argsort(bounds, kind="stable")
        ids, at = self._encode(data[left], (bounds - gone[np.searchsorted(starts, bounds)])[order])
        place = np.empty_like(at)
        place[order] = at
        ids = np.insert(ids, place[len(offs) :], np.array([self.added[m[0]] for m in found], np.uint32))
        return ids, place[: len(offs)] + np.searchsorted(starts, offs)

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        data = LOWER[data] if self.fold else data
        starts, ends, first = self.cut(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        every = span_hashes(data, starts, ends)
        # most segments are found in a table by the upper bits of their hash, without sorting
        if len(self.slot) <= REMEMBER:
            place = (every >> _TABLE_SHIFT).astype(np.int64)
            slots = np.where(self.near_hash[place] == every, self.near_slot[place], -1)
            rest = np.flatnonzero(slots < 0)
            if not len(rest):
                ids, sizes = self._gather(slots)
                return ids, np.concatenate([[0], np.cumsum(sizes)])[first]
        else:
            slots, rest = np.empty(len(every), np.int64), np.arange(len(every))
        hashes, one, back = np.unique(every[rest], return_index=True, return_inverse=True)
        one, keys = rest[one], hashes.tolist()
        if len(self.slot) > REMEMBER:  # keeps what this chunk holds too: the frequent segments
            kept = [(k, self.slot[k]) for k in keys if k in self.slot]
            ids, sizes = self._gather(np.array([s for _, s in kept], np.int64))
            self._forget()
            self._remember([k for k, _ in kept], ids, sizes)
        known = [self.slot.get(k, -1) for k in keys]
        new = [i for i, s in enumerate(known) if s < 0]
        if new:
            raw, a, b = data.tobytes(), starts[one], ends[one]
            self._remember([keys[i] for i in new], *self._model_ids([raw[a[i] : b[i]].decode() for i in new]))
            known = [self.slot[k] for k in keys]
        known = np.array(known, np.int64)
        place = (hashes >> _TABLE_SHIFT).astype(np.int64)
        self.near_hash[place], self.near_slot[place] = hashes, known  # of two in one place either will do
        slots[rest] = known[back]
        ids, sizes = self._gather(slots)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]

    def texts(self, column: pa.Array, end_id: int | None = None):
        """For each text of a column its ids, with the end id if there is one; null is empty."""
        for i, j, data, offs in text_pieces(column, CHUNK):
            ids, at = self.encode(data, offs)
            if end_id is not None:
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = at + np.arange(len(at))
            for k in range(j - i):
                yield ids[at[k] : at[k + 1]]


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file, opened once."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
