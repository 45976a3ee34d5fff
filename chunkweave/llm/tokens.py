"""Tokenizer encoders that work a batch out word by word.

`path` names a file of the tokenizers library. A batch's texts are cut into words where the file's
pre-tokenizer is sure to end a pre-token; Arrow tells the batch's different words, each is looked up
or, if it is not remembered, encoded by the library's BPE model, and the ids of all texts are put
together by array operations. New words go to the model several to a call, with a byte between them
that UTF-8 doesn't have and no merge of the file has; where the file rules that out, one to a call. Texts and words for which the cut isn't sure, and those that hold an
added token's content, are encoded by the library whole. The shortest text of each batch is encoded
by the library as well and must agree. The memory of words is bounded and changes no result.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Remembered words of one Python worker, of up to WORD_BYTES bytes, about 90 bytes each.
CACHE_WORDS, WORD_BYTES = 1_000_000, 64
_FACTORS = np.random.default_rng(5).integers(0, 2**64, WORD_BYTES, np.uint64) | np.uint64(1)
#: Bytes of text that are worked out at once; a longer text is by itself.
PIECE_BYTES = 4 << 20
#: Pre-tokens that are translated at once, and of these the ones that go to the model in one call.
LEARN_WORDS, JOINED_WORDS = 4096, 8

# The patterns of the two pre-tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LINE = 32, 10
#: Kinds of bytes: 1 space or line feed, 2 other white space, 3 may begin other white space.
_KIND = np.zeros(256, np.uint8)
_KIND[[_SPACE, _LINE]] = 1
_KIND[[9, 11, 12, 13, 28, 29, 30, 31]] = 2
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 3
_WIDE_SPACE = regex.compile(r"[^\S\x00-\x7F]")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~""")] = True  # not the apostrophe, which may begin a pre-token with letters


def _alphabet() -> dict[int, str]:
    """Character of each byte in the byte-level alphabet: printable bytes are themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


class _Words:
    """Remembered words: their bytes, found by hashes and compared, and their ids."""

    def __init__(self, path: str, pattern: str) -> None:
        self.text, self.bounds = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.hashes, self.nth = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and whose each is
        self.ids, self.first, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.now = np.zeros(0, np.int64), 0  # the call of known() that last had each word
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.parts, self.shown = self.tokenizer.model, regex.compile(pattern), _alphabet()
        getattr(self.model, "_resize_cache", lambda n: None)(0)  # words are remembered here; the library's own memory only costs new ones
        self.wide = np.array([ord(self.shown[b]) for b in range(256)], "<u2")
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = [x["content"] for x in file["added_tokens"]]
        self.gap = self._gap(file["model"])

    def _gap(self, model: dict) -> int | None:
        """Id of byte 0xFF, which UTF-8 doesn't have, if pre-tokens with it between them have the ids that each has by itself."""
        alone = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return model["vocab"].get(self.shown[0xFF]) if alone and sum(self.shown[0xFF] in x for x in model["vocab"]) == 1 else None

    def whole(self, text: str) -> bytes:
        """By the library."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def bpe(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens in data between bounds, by the library's model, and how many each has."""
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(bounds) - 1, LEARN_WORDS):
            at = bounds[k : k + LEARN_WORDS + 1] - bounds[k]
            text = self.wide[np.insert(data[bounds[k] : bounds[k] + at[-1]], at[1:], 0xFF)].tobytes().decode("utf-16-le")
            if self.gap is None:
                tokens = list(map(self.model.tokenize, text.split(self.shown[0xFF])[:-1]))
                sizes.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
                ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), "<u4"))
                continue
            cut = [*(at + np.arange(len(at)))[:-1:JOINED_WORDS].tolist(), len(text)]
            some = np.fromiter(map(attrgetter("id"), chain.from_iterable(self.model.tokenize(text[a:z]) for a, z in zip(cut, cut[1:], strict=False))), "<u4")
            gaps = some == self.gap
            sizes.append(np.diff(np.flatnonzero(gaps), prepend=-1) - 1)
            ids.append(some[~gaps])
        out = np.concatenate(ids), np.concatenate(sizes)
        if len(out[1]) != len(bounds) - 1:
            raise ValueError("the model joined two pre-tokens")
        return out

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words, remembered or learned: an array, where in it each word's ids begin, and how many they are."""
        self.now += 1
        is_short = pc.binary_length(words).to_numpy() <= WORD_BYTES
        short, new = np.flatnonzero(is_short), np.flatnonzero(~is_short)
        data, bounds = _content(words if not len(new) else words.take(pa.array(short)))
        hashes = _hashes(data, bounds)
        at = np.full(len(words), -1)
        at[short] = found = self.find(data, bounds, hashes)
        self.used[found[found >= 0]] = self.now
        unseen = short[found < 0]
        at[unseen], at[new] = len(self.used) + np.arange(len(unseen)), len(self.used) + len(unseen) + np.arange(len(new))
        fresh = words.take(pa.array(unseen))
        learned = self.learn(fresh)
        ids, first, size = _after((self.ids, self.first, self.size), learned, self.learn(words.take(pa.array(new))))
        self.remember(fresh, hashes[found < 0], learned)
        return ids, first[at], size[at]

    def find(self, data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places of remembered words, -1 of others."""
        out, at, order = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64), np.argsort(hashes)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        k = np.flatnonzero(at < len(self.hashes))
        k = k[self.hashes[at[k]] == hashes[k]]
        nth, n = self.nth[at[k]], np.diff(bounds)[k]
        same = np.diff(self.bounds)[nth] == n
        k, nth, n = k[same], nth[same], n[same]
        if len(k):
            differ = self.text[_spans(self.bounds[nth], n)] != data[_spans(bounds[k], n)]
            same = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
            out[k[same]] = nth[same]
        return out

    def remember(self, words: pa.Array, hashes: np.ndarray, learned: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Add words; where there isn't room, the half that was used last stays."""
        if len(self.used) + len(words) > CACHE_WORDS:
            stay = np.sort(np.argsort(self.used, kind="stable")[max(len(self.used) - CACHE_WORDS // 2, 0) :])
            n = np.diff(self.bounds)[stay]
            self.text, self.bounds = self.text[_spans(self.bounds[stay], n)], np.append(0, np.cumsum(n))
            self.ids = self.ids[_spans(self.first[stay], self.size[stay])]
            nth = np.full(len(self.used), -1)
            nth[stay] = np.arange(len(stay))
            nth = nth[self.nth]
            self.hashes, self.nth = self.hashes[nth >= 0], nth[nth >= 0]
            self.size, self.used = self.size[stay], self.used[stay]
            self.first = np.cumsum(self.size) - self.size
        n, (data, bounds) = len(self.used), _content(words.slice(0, CACHE_WORDS - len(self.used)))
        many = len(bounds) - 1
        self.text, self.bounds = np.append(self.text, data), np.append(self.bounds, self.bounds[-1] + bounds[1:])
        order = np.argsort(hashes[:many])
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.nth = np.insert(self.hashes, at, hashes[order]), np.insert(self.nth, at, n + order)
        self.ids, first, size = _after((self.ids, self.first, self.size), learned)
        self.first, self.size = first[: n + many], size[: n + many]
        self.used = np.append(self.used, np.full(many, self.now))

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As known(), of words that aren't remembered, by their pre-tokens or whole."""
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(words):
            return np.zeros(0, "<u4"), first, size
        data, bounds = _content(words)
        length = np.diff(bounds)
        letters = _latin(data)
        letters[bounds[:-1]] |= (data[bounds[:-1]] == _SPACE) & (length > 1)
        one = np.logical_and.reduceat(letters, bounds[:-1])  # Latin letters after one space or none
        ids, size[one] = self.bpe(self.folded(data[np.repeat(one, length)]), np.append(0, np.cumsum(length[one])))
        first[one] = np.cumsum(size[one]) - size[one]
        parts, many, rest, whole = [], [0], [], []
        raw, at = data.tobytes(), bounds.tolist()
        for k in np.flatnonzero(~one).tolist():
            word = raw[at[k] : at[k + 1]]
            of = self.pre_tokens(word)
            if of is None:
                whole.append((k, np.frombuffer(self.whole(word.decode()), "<u4")))
            else:
                parts += of
                many.append(len(parts))
                rest.append(k)
        more, sizes = self.bpe(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        ends = np.append(0, np.cumsum(sizes))[many]
        first[rest], size[rest] = len(ids) + ends[:-1], np.diff(ends)
        most = [ids, more, *(x for _, x in whole)]
        for (k, x), before in zip(whole, np.cumsum(list(map(len, most)))[1:].tolist(), strict=False):
            first[k], size[k] = before, len(x)
        return np.concatenate(most), first, size

    def folded(self, data: np.ndarray) -> np.ndarray:
        """Latin letters as the pre-tokens have them."""
        return data

    def pre_tokens(self, word: bytes) -> list[bytes] | None:
        """Of another word; None where they aren't sure."""
        raise NotImplementedError

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in data, whose texts begin and end at bounds."""
        raise NotImplementedError

    def _with_added(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts hold an added token's content."""
        out, raw = np.zeros(len(bounds) - 1, bool), data.tobytes()
        for content in map(str.encode, self.added):
            at = raw.find(content)
            while at >= 0:
                out[np.searchsorted(bounds, at, "right") - 1] = True
                at = raw.find(content, at + 1)
        return out

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id after it, and where each text's ids begin and end; a null is an empty text."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        data, bounds = _content(texts)
        cut, ids, many = [0], [], []
        while cut[-1] < len(texts):
            cut.append(max(cut[-1] + 1, int(np.searchsorted(bounds, bounds[cut[-1]] + PIECE_BYTES, "right")) - 1))
        for a, z in zip(cut, cut[1:], strict=False):
            of, lengths = self._piece(data[bounds[a] : bounds[z]], bounds[a : z + 1] - bounds[a])
            ends = np.cumsum(lengths)
            ids.append(np.insert(of, ends, np.uint32(end_id)))
            many.append(lengths + 1)
        every, at = np.concatenate(ids) if len(ids) > 1 else ids[0], np.append(0, np.cumsum(np.concatenate(many)))
        self._probe(texts, every, at)
        return every, at

    def _piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        first, last = self.starts(data, bounds)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        if np.array_equal(first[1:], last[:-1]):
            buffers = np.append(first, last[-1]).astype(np.int64), data
        else:  # close the gaps between the words
            lengths = last - first
            at = np.cumsum(lengths) - lengths
            buffers = np.append(at, lengths.sum()).astype(np.int64), data[np.repeat(first - at, lengths) + np.arange(lengths.sum())]
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, *map(pa.py_buffer, buffers)]).dictionary_encode()
        flat, place, size = self.known(words.dictionary)
        kind = np.int32 if len(flat) + len(data) < 1 << 30 else np.int64
        place, size = place.astype(kind), size.astype(kind)
        nth = words.indices.to_numpy(zero_copy_only=False)
        size, place = size[nth], place[nth]
        ends = np.cumsum(size, dtype=kind)
        take = np.repeat(place - ends + size, size)
        take += np.arange(len(take), dtype=kind)
        ids = flat[take]
        before = np.append(0, ends)[np.searchsorted(first, bounds)]  # ids before each text's first word
        return ids, np.diff(before).astype(np.int64)

    def _probe(self, texts: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        length = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if length.any():
            k = int(np.argmin(np.where(length > 0, length, np.iinfo(np.int64).max)))
            if ids[at[k] : at[k + 1] - 1].astype("<u4").tobytes() != self.whole(texts[k].as_py()):
                raise ValueError("the words' ids are not the whole text's")

    def one(self, text: str) -> bytes:
        ids, at = self.encode(pa.array([text]), 0)
        return ids[: at[1] - 1].astype("<u4").tobytes()


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of large strings or binaries, and where each value begins and ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of words of 1 to WORD_BYTES bytes."""
    if len(bounds) < 2:
        return np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    return np.add.reduceat((data + np.uint64(1)) * _FACTORS[at], bounds[:-1])


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, … of each span."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _after(*groups: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of words (ids, where each word's begin, how many they are) as one."""
    ids, first, size = zip(*groups, strict=True)
    before = np.cumsum([0, *map(len, ids)])
    return np.concatenate(ids), np.concatenate([x + n for x, n in zip(first, before, strict=False)]), np.concatenate(size)


def _latin(data: np.ndarray) -> np.ndarray:
    """Which bytes are of a Latin letter below U+0100."""
    out = _LETTER[data]
    wide = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    out[:-1] |= wide
    out[1:] |= wide
    return out


def _marks(data: np.ndarray, space: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where one or more punctuation marks begin between a letter and white space or the text's end."""
    mark = _MARK[data]
    change = begins.copy()
    change[1:-1] |= mark[1:] != mark[:-1]
    at = np.flatnonzero(change[:-1])
    ends = np.append(at[1:], len(data))
    runs = mark[at] & ~begins[at]
    at, ends = at[runs], ends[runs]
    last, before = data[at - 1], data[np.maximum(at - 2, 0)]
    letter = _LETTER[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    return at[letter & (begins[ends] | space[np.minimum(ends, len(data) - 1)])]


class SpaceDroppingWords(_Words):
    """Word-end BPE that drops white space and lower-cases; a word is a run without ASCII white space."""

    def __init__(self, path: str) -> None:
        super().__init__(path, WORD_END_PATTERN)

    def folded(self, data: np.ndarray) -> np.ndarray:
        capital = (data >= 65) & (data <= 90)
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0x9F)
        return data + (capital * np.uint8(32))

    def pre_tokens(self, word: bytes) -> list[bytes] | None:
        text = word.decode()
        if max(text) > "ɏ" or any(x in text for x in self.added):  # beyond Latin letters, normalisation is the library's
            return None
        return [part.encode() for part in self.parts.findall(text.lower())]

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = (data == _SPACE) | ((data >= 9) & (data <= 13))
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~space
        edge = inside[1:] != inside[:-1]
        both = np.zeros(len(data) + 1, bool)  # where two words touch: a text's end, a punctuation mark behind a letter
        both[bounds] = True
        both[_marks(data, space, both)] = True
        both &= inside[1:] & inside[:-1]
        first, last = np.flatnonzero((edge & inside[1:]) | both), np.flatnonzero((edge & inside[:-1]) | both)
        for k in np.flatnonzero(self._with_added(data, bounds)).tolist():  # one word each
            a, z = bounds[k], bounds[k + 1]
            first, last = (np.sort(np.append(x[(x < a if x is first else x <= a) | (x >= z if x is first else x > z)], y)) for x, y in ((first, a), (last, z)))
        return first, last


class ByteLevelWords(_Words):
    """Byte-level BPE with the usual pattern; a word carries the one space before it.

    Without two white-space characters in a row a space starts a new pre-token and a line feed is
    one by itself; other texts are one word.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path, BYTE_LEVEL_PATTERN)

    def pre_tokens(self, word: bytes) -> list[bytes] | None:
        text = word.decode()
        if len(word) > WORD_BYTES or any(x in text for x in self.added):
            return None
        return [part.encode() for part in self.parts.findall(text)]

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, begins = _KIND[data], np.zeros(len(data) + 1, bool)
        begins[bounds] = True
        odd = kind == 2
        odd[1:] |= (kind[1:] == 1) & (kind[:-1] == 1) & ~begins[1:-1]
        unsure = self._with_added(data, bounds)
        unsure[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
        for k in np.unique(np.searchsorted(bounds, np.flatnonzero(kind == 3), "right") - 1).tolist():
            if not unsure[k] and _WIDE_SPACE.search(data[bounds[k] : bounds[k + 1]].tobytes().decode()):
                unsure[k] = True
        begins[_marks(data, kind == 1, begins)] = True
        begins[:-1] |= kind == 1
        begins[1:] |= data == _LINE
        if unsure.any():
            begins[:-1] &= ~np.repeat(unsure, np.diff(bounds))
            begins[bounds] = True
        first = np.flatnonzero(begins[:-1])
        return first, np.append(first[1:], len(data)) if len(first) else first


@lru_cache(maxsize=4)
def words_of(path: str, byte_level: bool) -> _Words:
    """One encoder for each file in a Python worker, kept between tasks."""
    return ByteLevelWords(path) if byte_level else SpaceDroppingWords(path)
