"""Ids of whole texts by a tokenizers file, each distinct piece of text encoded once.

A byte-level pre-tokenizer scans from left to right and never joins what stands before and after
- a lone space between two other characters (the space opens the next piece),
- a lone newline (a piece of its own), and
- a letter and an ASCII mark behind it.
Texts are cut there and nowhere else, so the pieces' ids in a row are the text's. A tokenizer that drops white space and looks
at each word by itself is cut before each word and between a letter and an ASCII mark instead, A-Z in lower case, and new words of
Latin letters go straight to its model, as its normalizer would leave them. Pieces are cut, and repeats among them found, in Arrow and numpy; the
library gets each distinct piece of a slice that isn't remembered.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces that one worker remembers the ids of; longer pieces are not remembered.
MEMORY_BYTES, LONGEST = 6_000_000, 64
#: Pieces that the library gets as one text.
GROUP = 1000

_SPACE, _NEWLINE = 0x20, 0x0A
#: White space of one byte, with the separators 1C-1F: they only keep cuts away.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: The UTF-8 of Unicode's white space beyond ASCII.
_WIDE_BLANKS = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_LEADS = {size: np.isin(np.arange(256), [x[0] for x in _WIDE_BLANKS if len(x) == size]) for size in (2, 3)}
#: White space of one byte that every pattern of words stops at.
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: All of these, and a space and a newline, as bits of a byte's class: one look at a byte serves all questions.
_IS_BLANK, _IS_SPACE, _IS_NEWLINE, _IS_LETTER, _IS_MARK, _OPENS_2, _OPENS_3 = (1 << i for i in range(7))
_CLASS = (_BLANK * _IS_BLANK + _LETTER * _IS_LETTER + _MARK * _IS_MARK + _LEADS[2] * _OPENS_2 + _LEADS[3] * _OPENS_3).astype(np.uint8)
_CLASS[_SPACE] |= _IS_SPACE
_CLASS[_NEWLINE] |= _IS_NEWLINE
#: Kinds of pieces: a space and no other white space after it; no white space; all others; words and what follows them; those of Latin letters alone.
_SPACED, _BARE, _OTHER, _WORD, _LATIN = 0, 1, 2, 3, 4
#: Letters whose composed form and small letter stand in Latin-1.
_latin = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[ \t-\r]*").fullmatch

#: Of the bytes of those letters, the three that a byte-level vocabulary doesn't write as themselves, by its rule: the bytes
#: outside 21-7E, A1-AC and AE-FF get U+0100 and on, in order.
_MOVED = {chr(x): chr(0x100 + sum(not (0x21 <= y < 0x7F or 0xA1 <= y < 0xAD or y >= 0xAE) for y in range(x))) for x in (0x9F, 0xA0, 0xAD)}


def blanks(data: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space; kind: their classes, if they are at hand."""
    kind = _CLASS[data] if kind is None else kind
    out = (kind & _IS_BLANK).view(bool)
    wide = np.flatnonzero(kind >= _OPENS_2)
    for size, opens in ((2, _OPENS_2), (3, _OPENS_3)):
        at = wide[(kind[wide] & opens).astype(bool) & (wide <= len(data) - size)]
        if len(at):
            own = sum(data[at + i].astype(np.int32) << (8 * i) for i in range(size))
            at = at[np.isin(own, [int.from_bytes(x, "little") for x in _WIDE_BLANKS if len(x) == size])]
            for i in range(size):
                out[at + i] = True
    return out


def _latin_ends(data: np.ndarray, letter: np.ndarray) -> None:
    """Adds to `letter` the two-byte letters C3 80 to C3 BF, without the signs of multiplication and division."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    letter[at[(data[at] != 0x97) & (data[at] != 0xB7)]] = True


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First bytes of all pieces; edges: offsets of the texts (their first bytes and the end)."""
    n = len(data)
    kind = _CLASS[data]
    blank = blanks(data, kind)
    # Lone blanks: neither at an edge of a text nor beside another blank.
    lone = blank.copy()
    lone[1:] &= ~blank[:-1]
    lone[:-1] &= ~blank[1:]
    lone[edges[edges < n]] = False
    lone[edges[edges > 0] - 1] = False
    line = lone & (kind & _IS_NEWLINE).astype(bool)
    out = lone & (kind & _IS_SPACE).astype(bool)
    out |= line
    out[1:] |= line[:-1]
    letter = (kind & _IS_LETTER).astype(bool)
    _latin_ends(data, letter)
    out[1:] |= letter[:-1] & (kind[1:] & _IS_MARK).astype(bool)
    out[edges[edges < n]] = True
    return np.flatnonzero(out)


def word_cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First bytes of pieces of a word, or of marks, and the white space behind it."""
    gap, letter = _GAP[data], _LETTER[data]
    _latin_ends(data, letter)
    out = np.zeros(len(data) + 1, dtype=bool)
    out[edges] = True
    out[1:-1] |= (gap[:-1] & ~gap[1:]) | (letter[:-1] & _MARK[data[1:]])
    return np.flatnonzero(out[:-1])


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of a string array without nulls, and the offsets of its texts in it."""
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def _kinds(pieces: pa.Array) -> np.ndarray:
    data, edges = offsets(pieces)
    if not len(data):
        return np.full(len(pieces), _OTHER)
    blank = np.add.reduceat(blanks(data), edges[:-1], dtype=np.int64)
    return np.where(blank == 0, _BARE, np.where((blank == 1) & (data[edges[:-1]] == _SPACE) & (np.diff(edges) > 1), _SPACED, _OTHER))


def take(flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)]


class Encoder:
    """Encodes texts; pieces are remembered per process until release() or MEMORY_BYTES of them are there."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def release(cls) -> None:
        """Forget tokenizers and pieces: a reused worker starts its next task without them."""
        cls._made.clear()

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.words = _by_words(spec)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each piece is asked once
        if self.words:
            from tokenizers import pre_tokenizers

            mark, end = self.added[0], self.tokenizer.model.end_of_word_suffix
            self.mark, self.mark_id = f" {mark} ", self.tokenizer.token_to_id(mark)
            self.raw = Tokenizer(self.tokenizer.model)
            self.raw.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.ends = np.zeros(self.size, dtype=bool)
            self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(end)]] = True
        if self.cuts:
            space, line = (self.tokenizer.pre_tokenizer.pre_tokenize_str(x)[0][0] for x in " \n")
            self.opens = np.zeros(self.size, dtype=bool)
            self.opens[[i for x, i in self.tokenizer.get_vocab().items() if x.startswith(space)]] = True
            self.line = self.tokenizer.token_to_id(line)
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.chars = 0
        self.first, self.count, self.hits = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.flat = np.zeros(0, dtype=np.uint16 if self.size <= 1 << 16 else np.uint32)

    @property
    def place(self) -> list[str]:
        """The pieces remembered, in the order of first, count and hits."""
        return self.known.to_pylist()

    def encode(self, texts: pa.Array | pa.ChunkedArray | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; null is empty. Texts that hold an added token's string aren't cut."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.cuts and not self.words:
            ids = self._each(texts.to_pylist())
            return _joined(ids, self.flat.dtype).astype(np.uint32), np.array([len(x) for x in ids], dtype=np.int64)
        data, edges = offsets(texts)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.words:
            small = (data >= 0x41) & (data <= 0x5A) & np.repeat(~whole, np.diff(edges))
            data = np.where(small, data | 0x20, data).astype(np.uint8)
        starts = cuts(data, edges) if self.cuts else word_cuts(data, edges)
        if whole.any():
            of = np.searchsorted(edges, starts, side="right") - 1
            starts = starts[~whole[of] | (starts == edges[of])]
        at = np.concatenate((starts, [len(data)])).astype(np.int32)
        met = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        codes = met.indices.to_numpy()
        counts, ids = self._ids(met.dictionary, np.bincount(codes, minlength=len(met.dictionary)), bool(whole.any()))
        wide = self.flat.dtype.itemsize
        at = np.concatenate(([0], np.cumsum(counts * wide))).astype(np.int32)
        taken = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids)]).take(met.indices)
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(taken) + 1] // wide
        ids = np.frombuffer(taken.buffers()[2], dtype=self.flat.dtype)[ends[0] : ends[-1]].astype(np.uint32)
        return ids, np.diff((ends - ends[0])[np.searchsorted(starts, edges)]).astype(np.int64)

    def _ids(self, distinct: pa.StringArray, often: np.ndarray, added: bool) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each distinct piece has, and all of them. added: whether a piece may hold an added token's string."""
        codes = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        known = codes >= 0
        self.hits[codes[known]] += often[known]
        missing = np.flatnonzero(~known)
        order, new, new_counts, new_ids = self._learn(distinct.take(pa.array(missing)), added)
        missing = missing[order]
        counts, first = np.empty(len(codes), dtype=np.int64), np.empty(len(codes), dtype=np.int64)
        first[known], counts[known] = self.first[codes[known]], self.count[codes[known]]
        first[missing], counts[missing] = len(self.flat) + np.cumsum(new_counts) - new_counts, new_counts
        ids = take(np.concatenate((self.flat, new_ids)), first, counts)
        self._keep(new, new_counts, new_ids, often[missing])
        return counts, ids

    def _keep(self, pieces: pa.StringArray, counts: np.ndarray, ids: np.ndarray, often: np.ndarray) -> None:
        """Remember pieces; where there is no room for all of them, those that were met more than once."""
        size = np.diff(offsets(pieces)[1])
        for keep in (size <= LONGEST, often > 1):
            keep = keep[: len(size)]
            if not keep.all():
                pieces, ids = pieces.filter(pa.array(keep)), ids[np.repeat(keep, counts)]
                counts, often, size = counts[keep], often[keep], size[keep]
            more = int(size.sum())
            if self.chars + more > MEMORY_BYTES:
                self._shed()
            if self.chars + more <= MEMORY_BYTES:
                break
        else:
            return
        self.known = pa.concat_arrays([self.known, pieces])
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(counts) - counts))
        self.count, self.hits = np.concatenate((self.count, counts)), np.concatenate((self.hits, often))
        self.flat = np.concatenate((self.flat, ids))
        self.chars += more

    def _shed(self) -> None:
        """Forget the pieces met once since the last time; all of them if that leaves more than half of the memory full."""
        keep = self.hits > 1
        known = self.known.filter(pa.array(keep))
        if (chars := len(offsets(known)[0])) > MEMORY_BYTES // 2:
            return self._clear()
        counts = self.count[keep]
        self.flat = take(self.flat, self.first[keep], counts)
        self.known, self.chars = known, chars
        self.first, self.count, self.hits = np.cumsum(counts) - counts, counts, np.zeros(len(counts), dtype=np.int64)

    def _learn(self, pieces: pa.StringArray, added: bool) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
        """(order of the pieces, the pieces, how many ids each has, their ids), the last three in that order."""
        kinds = _kinds(pieces) if self.cuts else np.array([_LATIN if _latin(x) else _WORD for x in pieces.to_pylist()], dtype=np.int64)
        for token in self.added if added else []:
            kinds = np.where(pc.match_substring(pieces, token).to_numpy(zero_copy_only=False), _OTHER, kinds)
        order, counts, parts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [self.flat[:0]]
        for kind in (_SPACED, _BARE, _OTHER, _WORD, _LATIN):
            which = np.flatnonzero(kinds == kind)
            if not len(which):
                continue
            order.append(which)
            size = 1 if kind == _OTHER else GROUP
            own = pieces.take(pa.array(which))
            groups = [own.slice(at, size) for at in range(0, len(own), size)]
            if kind in (_SPACED, _BARE):
                joined = self._each(_texts(own, size, kind == _BARE))
            elif kind == _LATIN:
                joined = self._latin([g.to_pylist() for g in groups])
            else:
                joined = self._each([self.mark.join(g.to_pylist()) if kind == _WORD else g[0].as_py() for g in groups])
            for group, ids in zip(groups, joined):
                flat = np.array(ids, dtype=self.flat.dtype)
                if kind == _OTHER:
                    count = np.array([len(flat)])
                elif kind in (_BARE, _WORD):
                    gaps = np.flatnonzero(flat == (self.line if kind == _BARE else self.mark_id))
                    count = np.diff(np.concatenate(([-1], gaps, [len(flat)]))) - 1
                    flat = np.delete(flat, gaps)
                elif kind == _LATIN:
                    count = np.diff(np.concatenate(([-1], np.flatnonzero(self.ends[flat]))))
                else:
                    count = np.diff(np.concatenate((np.flatnonzero(self.opens[flat]), [len(flat)])))
                if len(count) != len(group):  # they can't be told apart
                    each = self._each(group.to_pylist())
                    count, flat = np.array([len(x) for x in each]), _joined(each, self.flat.dtype)
                counts.append(count)
                parts.append(flat)
        order = np.concatenate(order)
        return order, pieces.take(pa.array(order)), np.concatenate(counts), np.concatenate(parts)

    def _latin(self, groups: list[list[str]]) -> list[list[int]]:
        """Ids of words of Latin letters, each word's last one closes it."""
        texts = [" ".join([x.rstrip() for x in g]).lower().encode().decode("latin-1") for g in groups]
        for x, y in _MOVED.items():
            texts = [t.replace(x, y) for t in texts]
        return [x.ids for x in self.raw.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _texts(pieces: pa.StringArray, size: int, lines: bool) -> list[str]:
    """The pieces joined, `size` of them a text, with newlines between them if `lines`."""
    data, edges = offsets(pieces)
    if lines:
        data, edges = np.insert(data, edges[1:], _NEWLINE), edges + np.arange(len(edges))
    return [data[edges[at] : edges[min(at + size, len(pieces))] - lines].tobytes().decode() for at in range(0, len(pieces), size)]


def _by_words(spec: dict) -> bool:
    """Whether white space is dropped and parts words, and an added token may stand between words as a mark."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    split, *rest = pre.get("pretokenizers") or [{}]
    kinds = {x["type"] for x in norm.get("normalizers") or []}
    keeps_words = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s" in (split.get("pattern") or {}).get("Regex", "")
    bytewise = [(x["type"], x.get("use_regex"), x.get("add_prefix_space")) for x in rest] == [("ByteLevel", False, False)]
    added = [x for x in spec.get("added_tokens") or [] if x["special"] and not x["single_word"]]
    return bool(keeps_words and bytewise and kinds <= {"NFC", "Replace", "Lowercase"} and added)


def _joined(ids: list[list[int]], dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=dtype), *(np.array(x, dtype=dtype) for x in ids)])
