"""Token ids of whole texts, encoding every distinct piece of text once per process.

Texts are cut at places where the tokenizer's own splitting always ends a token; the ids of a text are
then the ids of its pieces in a row. Pieces repeat a lot, so a bounded table keeps the ids of pieces
already seen, keyed by a 64-bit hash (plus their length); others are encoded by the library each time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumeflux.llm.text import _SEPARATOR, chunks, span_hashes, string_buffers

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, dtype=bool)  # visible ASCII other than letters
_MARK[0x21:0x7F] = True
_MARK &= ~_LETTER
_APOSTROPHE = np.uint8(0x27)
# A byte pair that may end a white-space character outside ASCII, or a control character some classes count as space.
_SPACE_TAIL, _SPACE_LEAD = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE_TAIL[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_SPACE_LEAD[[0xC2, 0x80, 0x81, 0x9A]] = True
_CONTROL = np.zeros(256, dtype=bool)
_CONTROL[0x1C:0x20] = True

CHUNK_BYTES = 1 << 20
PIECES_KEPT = 1_000_000


def piece_bounds(offsets: np.ndarray, raw: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of the pieces of texts that lie back to back in ``raw``.

    Cuts: between two texts; before white space that follows something else (never inside a run that
    may be white space); between an ASCII letter and another visible ASCII character, but not after an
    apostrophe (contractions). Where special tokens may occur, only white space cuts. With ``spaces``
    white space leads the next piece, else ASCII white space between pieces is left out.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SEPARATOR[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    left, right = raw[:-1], raw[1:]
    doubtful = space[:-1] | _CONTROL[left]
    doubtful[1:] |= _SPACE_TAIL[left[1:]] & _SPACE_LEAD[raw[:-2]]
    cut[1:n] |= space[1:] & ~doubtful
    if b"<|" not in raw.tobytes():
        cut[1:n] |= (_LETTER[left] & _MARK[right]) | (_MARK[left] & (left != _APOSTROPHE) & _LETTER[right])
    if spaces:
        at = np.flatnonzero(cut)
        return at[:-1], at[1:]
    cut[1:n] |= space[1:] != space[:-1]  # ASCII white space vanishes anyway
    at = np.flatnonzero(cut)
    keep = ~space[at[:-1]]
    return at[:-1][keep], at[1:][keep]


class PieceEncoder:
    """Ids of pieces by one of the public vocabularies, with a bounded memory of pieces."""

    def __init__(self, path: str, kept: int = PIECES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # byte-level vocabularies write bytes without a visible character as U+0100 and on, in byte order
        hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
        self.shown = {b: chr(0x100 + k) for k, b in enumerate(hidden)}
        self.lowers = self.tokenizer.normalizer is not None
        self.kept = kept
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _plain(self, piece: str) -> bool:
        """Only Latin letters, perhaps after one space: one unit for the tokenizer's own splitting."""
        word = piece[1:] if piece[0] == " " else piece
        return word.isalpha() and (word.isascii() or (max(word) < "ɐ" and "İ" not in word))

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece as the library gives them; simple words skip its splitting steps."""
        out: list[list[int] | None] = [None] * len(pieces)
        rest, tokenize = [], self.model.tokenize
        for k, piece in enumerate(pieces):
            if self._plain(piece):
                text = piece.lower() if self.lowers else piece
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(self.shown)
                elif text[0] == " ":
                    text = self.shown[0x20] + text[1:]
                out[k] = [t.id for t in tokenize(text)]
            else:
                rest.append(k)
        if rest:
            encoded = self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)
            for k, e in zip(rest, encoded):
                out[k] = e.ids
        return out

    def lookup(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every span: its row in a table of ids, that table's bounds and its ids."""
        h = span_hashes(raw, starts, ends, lower=False)
        order = np.argsort(h)
        ordered = h[order]
        new = np.ones(len(h), dtype=bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        keys, first = ordered[new], order[new]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        missing = np.flatnonzero(~known)
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8") for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())]
        fresh = self.encode(texts)
        lengths = np.zeros(len(keys), np.int64)
        lengths[known] = (self.at[1:] - self.at[:-1])[where[known]]
        lengths[missing] = [len(x) for x in fresh]
        at = np.zeros(len(keys) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        ids = np.empty(at[-1], np.uint32)
        ids[spread(at[:-1][known], lengths[known])] = self.ids[spread(self.at[:-1][where[known]], lengths[known])]
        if len(missing):
            flat = np.fromiter((i for x in fresh for i in x), np.uint32, int(lengths[missing].sum()))
            ids[spread(at[:-1][missing], lengths[missing])] = flat
            self._keep(keys[missing], lengths[missing], flat)
        return inverse, at, ids

    def _keep(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        room = self.kept - len(self.keys)
        if room <= 0:
            return
        if len(keys) > room:
            keys, flat, lengths = keys[:room], flat[: int(lengths[:room].sum())], lengths[:room]
        all_keys = np.concatenate([self.keys, keys])
        all_lengths = np.concatenate([np.diff(self.at), lengths])
        starts = np.concatenate([self.at[:-1], len(self.ids) + np.cumsum(lengths) - lengths])
        order = np.argsort(all_keys, kind="stable")
        self.ids = np.concatenate([self.ids, flat])[spread(starts[order], all_lengths[order])]
        self.keys = all_keys[order]
        self.at = np.concatenate([[0], np.cumsum(all_lengths[order])])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    step = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return step + np.arange(total, dtype=np.int64)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _cut_long(offsets: np.ndarray, raw: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of parts of at most about ``limit`` bytes and the row of each; long rows end at a safe cut."""
    bounds, rows = [int(offsets[0])], []
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        while b - a > limit:
            window = raw[a : min(b, a + 2 * limit)]
            starts, _ = piece_bounds(np.array([0, len(window)]), window, True)
            # a space after an ASCII letter is a cut whatever surrounds the window
            safe = starts[(starts > limit // 2) & (raw[a + starts] == 0x20) & _LETTER[raw[a + starts - 1]]]
            if len(safe) == 0:
                if len(window) == b - a:
                    break
                limit_here = 2 * len(window)
                if limit_here >= b - a:
                    break
                more = raw[a:b]
                at = np.flatnonzero((more[1:] == 0x20) & _LETTER[more[:-1]]) + 1
                at = at[at > limit // 2]
                if len(at) == 0:
                    break
                a += int(at[0])
            else:
                a += int(safe[0])
            bounds.append(a)
            rows.append(row)
        bounds.append(b)
        rows.append(row)
    return np.array(bounds, np.int64), np.array(rows, np.int64)


def token_chunks(
    column: pa.Array, path: str, spaces: bool, limit: int = CHUNK_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of about ``limit`` bytes: row of each piece, its row in the table, table bounds, ids; bytes per row."""
    enc = encoder(path)
    offsets, raw = string_buffers(column)
    sizes = np.diff(offsets)
    if len(sizes) and int(sizes.max()) > limit:
        bounds, rows = _cut_long(offsets, raw, limit)
    else:
        bounds, rows = offsets, np.arange(len(sizes))
    for lo, hi in chunks(bounds, limit):
        base = bounds[lo]
        part = raw[base : bounds[hi]]
        starts, ends = piece_bounds(bounds[lo : hi + 1] - base, part, spaces)
        of = rows[lo + np.searchsorted(bounds[lo : hi + 1] - base, starts, "right") - 1] if len(starts) else rows[:0]
        inverse, at, ids = enc.lookup(part, starts, ends)
        yield of, inverse, at, ids, sizes
