"""Token ids through a dictionary of pieces that the tokenizer may encode one by one.

A byte-pair tokenizer first cuts a text into pre-tokens. Where a cut is certain whatever stands
around it, both sides can be encoded apart. The pieces between certain cuts are mostly words, and
words repeat; each is encoded by the tokenizers library once and looked up from then on.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .common import Texts, ragged

#: Pieces kept by one Python worker; before it would hold more it starts anew.
KEPT_PIECES = 400_000
#: Strings given to the library at once (its results are large), and words joined to one string.
AT_ONCE, JOINED = 2000, 100
#: Bytes of text cut into words together.
PORTION = 1 << 20
#: Bytes of a piece that is one pre-token after white space in any tokenizer: Latin letters.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LOADED: dict[str, PieceIds] = {}


class PieceIds:
    """Ids of pieces, as the tokenizers library gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # the id ends a word
        self.begins = np.zeros_like(self.ends)  # the id begins with a space
        for token, k in vocabulary.items():
            self.ends[k], self.begins[k] = token.endswith("</w>"), token.startswith("Ġ")
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n_pool = 0
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)

    def _library(self, strings: list[bytes]) -> tuple[np.ndarray, list[int]]:
        ids, counts = [], []
        for a in range(0, len(strings), AT_ONCE):
            for found in self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in strings[a : a + AT_ONCE]], add_special_tokens=False):
                ids += found.ids
                counts.append(len(found))
        return np.array(ids, np.uint32), counts

    def _joined(self, words: list[bytes], glue: bytes, marks: np.ndarray, last: bool) -> None:
        """Encode words as few long strings; marks tell where each word's ids end (or begin)."""
        step = JOINED * AT_ONCE // 10
        for a in range(0, len(words), step):
            part = words[a : a + step]
            ids, _ = self._library([glue.join(part[k : k + JOINED]) for k in range(0, len(part), JOINED)])
            at = np.flatnonzero(marks[ids])
            if len(at) != len(part):
                raise ValueError("the tokenizer's words are not where its vocabulary says")
            lengths = np.diff(at, prepend=-1) if last else np.diff(at, append=len(ids))
            self._put(part, ids, lengths)

    def _add(self, pieces: list[bytes]) -> None:
        rest = pieces
        if self.ends.any():
            words = [p for p in pieces if _LETTERS.fullmatch(p)]
            rest = [p for p in pieces if not _LETTERS.fullmatch(p)]
            self._joined(words, b" ", self.ends, last=True)
        elif self.begins.any():
            words = [p for p in pieces if p[:1] == b" " and _LETTERS.fullmatch(p)]
            rest = [p for p in pieces if not (p[:1] == b" " and _LETTERS.fullmatch(p))]
            self._joined(words, b"", self.begins, last=False)
        for a in range(0, len(rest), AT_ONCE):
            ids, counts = self._library(rest[a : a + AT_ONCE])
            self._put(rest[a : a + AT_ONCE], ids, np.array(counts, np.int64))

    def _put(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(self.known), len(pieces)
        while k + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        while self.n_pool + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.n_pool : self.n_pool + len(ids)] = ids
        self.lengths[k : k + n] = lengths
        self.starts[k : k + n] = self.n_pool + np.cumsum(lengths) - lengths
        self.n_pool += len(ids)
        self.known.update(zip(pieces, range(k, k + n), strict=True))

    def encode_once(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library alone, for strings that are not worth remembering."""
        ids, counts = self._library(strings)
        return ids, np.array(counts, np.int64)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > KEPT_PIECES:
            self._reset()
            new = set(pieces)
        if new:
            self._add(sorted(new))
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.lengths[which]
        return ragged(self.pool, self.starts[which], lengths), lengths


def piece_ids(path: str) -> PieceIds:
    """One for each tokenizer file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceIds(path)
    return _LOADED[path]


def _kinds() -> np.ndarray:
    """1: ASCII letter or digit; 2: punctuation that stands in no special token or contraction."""
    kinds = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        kinds[b] = 1 if chr(b).isalnum() else 0 if chr(b) in "'<>|=" else 2
    return kinds


KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), np.arange(0x41, 0x5B)).astype(np.uint8)


def ends_letter(data: np.ndarray) -> np.ndarray:
    """Where an ASCII letter or digit, or a letter of U+00C0..U+00FF, ends."""
    found = KINDS[data] == 1
    found[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return found


def begins_letter(data: np.ndarray) -> np.ndarray:
    """Where such a letter or digit begins."""
    found = KINDS[data] == 1
    found[:-1] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return found


def simpler(texts: Texts) -> Texts:
    """Texts with the same ids for a tokenizer that lower-cases and drops white space, but fewer
    distinct words: A-Z lowered, letters and plain punctuation parted."""
    data, starts = texts.data, texts.starts
    if len(data) < 2 or b"<|" in data.tobytes():  # it may be a special token, whose case counts
        return texts
    plain = KINDS[data] == 2
    at = 1 + np.flatnonzero(ends_letter(data)[:-1] & plain[1:] | plain[:-1] & begins_letter(data)[1:])
    return Texts(_LOWER[np.insert(data, at, 0x20)], starts + np.searchsorted(at, starts, "left"))


def encode_words(texts: Texts, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts for a tokenizer that lower-cases and whose pre-tokens hold no white space.

    ASCII white space then always separates pre-tokens. Returns the ids of all texts one after
    another (each with end_id after it, if given) and the number of ids of each.
    """
    encoder = piece_ids(path)
    parts = [_encode_portion(simpler(part), encoder, end_id) for part in portions(texts)]
    if len(parts) == 1:
        return parts[0]
    ids, counts = zip(*parts, strict=True) if parts else ([np.empty(0, np.uint32)], [np.empty(0, np.int64)])
    return np.concatenate(ids), np.concatenate(counts)


def portions(texts: Texts) -> Iterator[Texts]:
    """Whole texts, about PORTION bytes together: a list of words takes some ten times their bytes."""
    starts, i = texts.starts, 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PORTION, "right")) - 1)
        yield Texts(texts.data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        i = j


def _encode_portion(texts: Texts, encoder: PieceIds, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    pieces: list[bytes] = []
    ends = []
    for text in texts:
        pieces += text.split()
        ends.append(len(pieces))
    ids, lengths = encoder.encode(pieces)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.diff(upto[np.array([0, *ends])])
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
