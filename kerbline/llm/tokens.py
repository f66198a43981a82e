"""Token ids of whole texts, piece by piece in arrays.

The tokenizer cuts a text into pieces (letters, single digits, marks, endings after an apostrophe) and encodes each by itself.  For words of
ASCII and Latin-1 letters the cuts are found here, on the bytes of many texts at once; a word with anything else is one piece, which the
tokenizer cuts.  Equal pieces are found by Arrow's dictionary encoding, so only distinct ones are looked up, and
only new ones are encoded, all in one call.  Ids are kept in one flat array.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa

from kerbline.llm.words import chunks

# What the tokenizer file must say for its pieces to be cut here.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BETWEEN = "<|endoftext|>"

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = [SPACE if chr(i) in " \t\n\v\f\r" else LETTER if chr(i).isalpha() else DIGIT if chr(i).isdigit() else MARK for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_APOSTROPHE, _LESS, _BAR, _LATIN = (int(c) for c in b"'<|\xc3")


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All pieces of the rows of one chunk, one after the other, and ``first`` with ``first[i] : first[i + 1]`` those of row i."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    kind, low = _KIND[data], _LOWER[data]
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    # letters of two bytes, U+00C0 to U+00FF but the signs for times and division
    lead = np.flatnonzero(data[:-1] == _LATIN)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7) & ~row[lead + 1]]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead[data[lead + 1] < 0x9F] + 1] += 0x20
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = SPACE, kind[:-1]
    solid = kind != SPACE
    word = solid & ((before == SPACE) | row[:n])
    starts = np.flatnonzero(word)
    # words that the tokenizer must cut itself: other letters and signs, and what may be one of its special tokens
    odd = kind == OTHER
    at = np.flatnonzero(data[:-1] == _LESS)
    odd[at[data[at + 1] == _BAR]] = True
    odd &= solid
    whole = np.zeros(n, bool)
    if odd.any():
        strange = np.add.reduceat(odd, starts, dtype=np.int64) > 0
        ends = np.append(starts[1:], n)
        whole = np.repeat(strange, ends - starts)
        whole = np.concatenate([np.zeros(starts[0], bool), whole])
    begin = word | (solid & ~whole & ((kind != before) | (kind == DIGIT)))
    # an apostrophe with an ending after it, if no other mark stands before it
    at = np.flatnonzero((data == _APOSTROPHE) & begin & ~whole)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~word[at + 1]]
    one = np.isin(low[at + 1], np.frombuffer(b"stmd", np.uint8))
    far = np.minimum(at + 2, n - 1)
    follows = (at + 2 < n) & (kind[far] == LETTER) & ~word[far]
    pair = low[at + 1].astype(np.int64) << 8 | low[far]
    two = ~one & follows & np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
    for at_, length in ((at[one], 2), (at[two], 3)):
        begin[at_ + 1] = False
        after = at_ + length
        after = after[after < n]
        begin[after[(kind[after] == LETTER) & ~word[after]]] = True
    pieces = np.flatnonzero(begin)
    place = np.concatenate([[0], np.cumsum(solid)])
    body = np.where(whole, data, low)[solid]
    bounds = np.append(place[pieces], len(body)).astype(np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return out, np.searchsorted(pieces, offsets)


def _windows(data: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """The distinct offsets and, in rows of more than ``most`` bytes, white space about every ``most`` bytes as further ones."""
    bounds = [offsets]
    for i in np.flatnonzero(np.diff(offsets) > most).tolist():
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        white = np.flatnonzero(_KIND[data[lo:hi]] == SPACE) + lo
        at = np.searchsorted(white, np.arange(lo + most, hi, most))
        bounds.append(white[at[at < len(white)]])
    return np.unique(np.concatenate(bounds))


class Encoder:
    """Ids by piece.  ``MOST`` pieces are kept; when there are more, half of them stay: those that came in most chunks since the last such time.

    Texts go through in windows of about ``WINDOW`` bytes, cut at white space, so memory follows neither the longest text nor the words ever seen.
    """

    MOST, WINDOW = 1 << 18, 1 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for pieces of letters in lower case, which need neither normal form nor cuts
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path) as f:
            rules = json.load(f)
        vocab = self.tokenizer.get_vocab()
        normal, split = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        cuts = split.get("pretokenizers", [split])
        model = rules.get("model", {})
        #: Whether pieces can be cut here; if not, whole texts go to the tokenizer.
        self.by_piece = (
            normal.get("normalizers") == NORMAL and cuts[0].get("pattern") == {"Regex": PIECES} and cuts[0].get("invert", False) and not rules.get("post_processor")
            and BETWEEN in vocab and {t["content"] for t in rules["added_tokens"]} <= {BETWEEN, "<|startoftext|>"} and not model.get("dropout")
        )
        self.between = vocab.get(BETWEEN, -1)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.begin = np.zeros(self.MOST, np.int64)
        self.length = np.zeros(self.MOST, np.int64)
        self.uses = np.zeros(self.MOST, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many are each one's.

        Pieces of small letters are encoded with a space between them: each ends with the one token that ends a word.  Between others stands
        a special token.
        """
        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain = np.fromiter((t.isalpha() and t.islower() and (t.isascii() or "\u00c0" <= max(t) < "\u0100" and "\u00aa" not in t and "\u00ba" not in t) for t in texts), bool, len(texts))
        ids, count, order = [], [], []
        for kind in (True, False):
            at = np.flatnonzero(plain == kind)
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                found, n = self._joined([texts[i] for i in some.tolist()], kind)
                ids.append(found)
                count.append(n)
                order.append(some)
        if not order:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        order, n = np.concatenate(order), np.concatenate(count)
        begin = np.empty(len(pieces), np.int64)
        length = np.empty(len(pieces), np.int64)
        begin[order], length[order] = np.cumsum(n) - n, n
        ends = np.cumsum(length)
        return np.concatenate(ids)[np.repeat(begin - ends + length, length) + np.arange(ends[-1])], length

    def _joined(self, texts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        if plain:
            found = np.array(self.bare.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(texts):
                return found, np.diff(ends, prepend=0)
        # a text that may hold special tokens itself is encoded alone
        alone = {i: np.array(self._ids(t), np.uint32) for i, t in enumerate(texts) if "<|" in t}
        found = np.array(self._ids(BETWEEN.join("" if i in alone else t for i, t in enumerate(texts))), np.uint32)
        edge = found == self.between
        n = np.diff(np.flatnonzero(np.concatenate([[True], edge, [True]]))) - 1
        parts = np.split(found[~edge], np.cumsum(n)[:-1])
        parts = [alone.get(i, part) for i, part in enumerate(parts)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _learn(self, new: list[bytes]) -> None:
        ids, count = self._encoded(new)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        n = len(self.place)
        if n + len(new) > len(self.begin):
            # a window of more than MOST pieces
            self.begin, self.length, self.uses = (np.concatenate([x, np.zeros(n + len(new) - len(x), np.int64)]) for x in (self.begin, self.length, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(new)] = self.used + np.cumsum(count) - count
        self.length[n : n + len(new)] = count
        self.place.update(zip(new, range(n, n + len(new)), strict=True))
        self.used += len(ids)

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of distinct pieces are, after all are known."""
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        known = np.flatnonzero(at >= 0)
        self.uses[at[known]] += 1
        if len(self.place) + len(new) > self.MOST:
            at[known] = self._forget(at[known])
        if len(new):
            at[new] = np.arange(len(self.place), len(self.place) + len(new))
            self._learn([pieces[i] for i in new.tolist()])
        return at

    def _forget(self, now: np.ndarray) -> np.ndarray:
        """Keeps the pieces at ``now`` and, up to half of MOST in all, the others that came most often; the new places of those at ``now``."""
        uses = self.uses[: len(self.place)]
        uses[now] += uses.max(initial=0)
        stay = np.argsort(-uses, kind="stable")[: max(len(now), self.MOST // 2)]
        stay = np.sort(stay[uses[stay] > 0])
        ids, count = self._gather(stay), self.length[stay]
        keep = np.zeros(len(uses), bool)
        keep[stay] = True
        pieces = list(compress(self.place, keep.tolist()))
        self._clear()
        self._keep(pieces, ids, count)
        return np.searchsorted(stay, now)

    def _keep(self, pieces: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        if len(ids) > len(self.flat):
            self.flat = np.zeros(2 * len(ids), np.uint32)
        self.flat[: len(ids)], self.used = ids, len(ids)
        if len(pieces) > len(self.begin):
            self.begin, self.length, self.uses = (np.zeros(len(pieces), np.int64) for _ in range(3))
        self.begin[: len(pieces)], self.length[: len(pieces)] = np.cumsum(count) - count, count
        self.place = dict(zip(pieces, range(len(pieces)), strict=True))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of pieces one after the other."""
        count = self.length[at]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.begin[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one chunk in a row, and the offsets of the rows."""
        if not self.by_piece:
            lists = [self._ids(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([i for x in lists for i in x], np.uint32), np.cumsum([0, *map(len, lists)])
        parts, ends = [], [0]
        bounds = _windows(data, offsets, self.WINDOW)
        for lo, hi in chunks(bounds, self.WINDOW):
            ids, first = self._encode(data, bounds[lo : hi + 1])
            parts.append(ids)
            ends.extend((ends[-1] + first[1:]).tolist())
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.array(ends, np.int64)[np.searchsorted(bounds, offsets)]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, for one window of whole words."""
        pieces, first = cut(data, offsets)
        coded = pieces.dictionary_encode()
        at = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.length[at])])
        return self._gather(at), ends[first]


_CACHE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file; workers outlive tasks."""
    if path not in _CACHE:
        _CACHE.clear()
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str, end: int = 0) -> Iterator[np.ndarray]:
    """Ids of every row of one chunk, then ``end``, as little-endian 32-bit numbers."""
    ids, first = encoder(path).encode(data, offsets)
    ids = np.insert(ids, first[1:], end).astype("<u4")
    first = first + np.arange(len(first))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield ids[a:b]
