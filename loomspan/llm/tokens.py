"""Token ids of whole texts by a public tokenizer, with a bounded cache of the pieces between cuts.

A text is cut only where the tokenizer itself always cuts: where white space begins.  Ids of a
text are then the ids of its pieces in order, so a piece that returns (most words do) is
encoded once and kept in a bounded cache.  A piece of letters with ASCII punctuation after it needs only the library's
BPE model, as the other steps leave it alone; all other pieces take the whole pipeline.
Every id comes from the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Unicode White_Space, as \s in the tokenizers' own patterns (fixed values).
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: White space other than ASCII's, and characters at which str.split cuts though they aren't White_Space; for Arrow.
_OTHER = "[\x1c-\x1f\x85\xa0  -     　]"
#: Those characters alone.
_ODD = re.compile("[\x1c-\x1f]")
#: Letters that NFC leaves alone.
_CLASS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LETTERS = re.compile(f"[{_CLASS}]+").fullmatch
#: ASCII punctuation without the apostrophe.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_WORD = f"[{_CLASS}]+[{re.escape(_MARKS)}]*"
#: Two words with marks or none, and a line's end between them, for Arrow.
_LINED = f"^{_WORD}\n{_WORD}$"
#: White space before a space, for Arrow.
_TWICE = f"[{_SPACE}] "

#: Pieces that a generation of a cache holds at most, likewise where words have a cache of their own, and characters of a piece that is kept at most.
CACHE_PIECES, CACHE_MARKS, CACHE_CHARS = 130_000, 20_000, 48
#: Words that are kept as Arrow arrays at most.
CACHE_WORDS = 300_000
#: Characters that are encoded together, about.
PORTION = 2_000_000


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: itself where printable, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Ids by piece.  One that isn't there is encoded, and kept if that says so.

    Two generations: when one is full it grows old, and what isn't asked for again goes with it.
    """

    def __init__(self, encode: Callable[[str], tuple[bytes, bool]], most: int) -> None:
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids, keep = self.encode(piece)
            if not keep or len(piece) > CACHE_CHARS:
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def many(self, pieces: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of different pieces, those that aren't there encoded together; all are kept."""
        found = list(map(self.get, pieces))
        new = [k for k, x in enumerate(found) if x is None]
        if not new:
            return found
        names = [pieces[k] for k in new]
        ids = list(map(self.old.get, names))
        strange = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(strange, encode([names[k] for k in strange]), strict=True):
            ids[k] = x
        for k, x in zip(new, ids, strict=True):
            found[k] = x
        if max(map(len, names)) > CACHE_CHARS:
            short = [k for k, x in enumerate(names) if len(x) <= CACHE_CHARS]
            names, ids = [names[k] for k in short], [ids[k] for k in short]
        for a in range(0, len(names), self.most):
            rest = zip(names[a : a + self.most], ids[a : a + self.most], strict=True)
            self.update(islice(rest, self.most - len(self)))
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
                self.update(rest)
        return found

    def knows(self, piece: str) -> bool:
        return piece in self or piece in self.old


class _Words:
    """Ids of different words as Arrow arrays: far smaller than objects, and looked up all at once.

    Those asked for last are kept, `most` of them.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int) -> None:
        self.encode, self.most = encode, most
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.words)

    def many(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of each word, those that aren't here encoded together."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null()
        places = at.fill_null(0).to_numpy().astype(np.int64)
        unused = np.ones(len(self), bool)
        is_new = new.to_numpy(zero_copy_only=False)
        unused[places[~is_new]] = False
        places[is_new] = len(self) + np.arange(new.true_count)
        fresh = pa.array(self.encode(_split(words.filter(new))), pa.large_binary())
        found = pa.concat_arrays([self.ids, fresh]).take(pa.array(places))
        short, unused = pc.less_equal(pc.utf8_length(words), CACHE_CHARS), pa.array(unused)
        self.words = pa.concat_arrays([words.filter(short), self.words.filter(unused)])[: self.most]
        self.ids = pa.concat_arrays([found.filter(short), self.ids.filter(unused)])[: self.most]
        return found


def _split(pieces: pa.StringArray) -> list[str]:
    """Strings without white space as a list: far faster than one by one."""
    if not len(pieces):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_py().split(" ")


def _after_letters(words: pa.StringArray) -> pa.DictionaryArray:
    """The marks after words' letters."""
    return pc.replace_substring_regex(words, f"^[{_CLASS}]+", "").dictionary_encode()


def _joined(parts: pa.LargeBinaryArray, edges: np.ndarray) -> pa.LargeBinaryArray:
    """Neighbours put together: from each edge to the next.  No value is moved."""
    _, offsets, values = parts.buffers()
    ends = np.frombuffer(offsets, np.int64)[parts.offset :][edges]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(ends), values])


class Encoder:
    """ids() or arrays() of texts, and spans().  `spaced`: pieces keep the white space before them, and case counts."""

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.spaced = path, spaced
        self.tokenizer = Tokenizer.from_file(path)
        self._tokens = self.tokenizer.model.tokenize
        self._by_id = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self._letters = _byte_letters()
        # Pieces as they stand, and, of a tokenizer that keeps spaces, those after one space, without it.
        self._raw = _Kept(self._encode, CACHE_MARKS if spaced else CACHE_PIECES)
        self._after = _Kept(self._encode_after, CACHE_PIECES)
        self._known = _Words(self._after_space if spaced else self._words, CACHE_WORDS)
        self._lengths: np.ndarray | None = None

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, space: str = "") -> bytes:
        """Letters, with a space before them or none: the model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._letters)
        by_id = self._by_id
        return b"".join([by_id[t.id] for t in self._tokens(space + word)])

    def _words(self, words: list[str], space: str = "") -> list[bytes]:
        """Likewise of many."""
        tokens, by_id, join = self._tokens, self._by_id, b"".join
        as_written = [space + (w if w.isascii() else w.encode().decode("latin-1").translate(self._letters)) for w in words]
        return [join([by_id[t.id] for t in own]) for own in map(tokens, as_written)]

    def _encode_after(self, piece: str) -> tuple[bytes, bool]:
        """Ids of a space and a piece.  It is kept unless its word is new: most words that come once never return."""
        word = piece.rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or _LETTERS(word)):
            if len(word) == len(piece):
                return self._word(word, "\u0120"), True  # as _byte_letters() writes a space
            known = self._after.knows(word)
            return self._after[word] + self._raw[piece[len(word) :]], known
        cut = _PIECE.findall(" " + piece)
        if len(cut) > 1:
            return self._join(cut), False
        return self._whole(cut[0]), True

    def _encode(self, piece: str) -> tuple[bytes, bool]:
        """Likewise of a piece as it stands."""
        head = piece[: self.spaced and piece[:1] == "\n"]
        word = piece[len(head) :].rstrip(_MARKS)
        if word.isalpha() and (word.isascii() or _LETTERS(word)):
            low = word if self.spaced else word.lower()
            if low == piece:
                return self._word(low), True
            known = self._raw.knows(low)
            ids, rest = self._raw[low], piece[len(head) + len(word) :]
            if head:
                ids = self._raw[head] + ids
            return ids + self._raw[rest] if rest else ids, known
        cut = _PIECE.findall(piece) if self.spaced else [piece]
        if len(cut) > 1:
            return self._join(cut), False
        return self._whole(piece), True

    def _join(self, cut: list[str]) -> bytes:
        """Pieces as they stand; of those that begin with one space, the others' cache has more."""
        raw, after = self._raw, self._after
        return b"".join([after[c[1:]] if c[0] == " " and len(c) > 1 and not c[1].isspace() else raw[c] for c in cut])

    def _text(self, text: str) -> bytes:
        """Ids of a text with white space that isn't cut as most is."""
        if not self.spaced:
            return b"".join(map(self._raw.__getitem__, text.split(" ") if _ODD.search(text) else text.split()))
        return self._join(_PIECE.findall(text))

    def _usual(self, texts: pa.StringArray) -> pa.BooleanArray:
        """Whether cutting before each space, or at ASCII white space where spaces don't count, gives a text's pieces."""
        return pc.and_(pc.invert(pc.match_substring_regex(texts, _TWICE if self.spaced else _OTHER)), pc.greater(pc.binary_length(texts), 0))

    def _after_space(self, words: list[str]) -> list[bytes]:
        return self._words(words, "\u0120")  # as _byte_letters() writes a space

    def _together(self, texts: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of usual texts.

        Arrow tells their pieces apart, and words from the marks after them, also where a line ends
        between two of them; each different word is looked up once, and ids are put in order,
        first of pieces, then of texts.
        """
        cut = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        coded = cut.values.dictionary_encode()
        names, at, edges = coded.dictionary, coded.indices.to_numpy(), cut.offsets.to_numpy()
        begin, lined = names, pc.match_substring_regex(names, _LINED) if self.spaced else None
        if lined is not None:  # a line that ends, and the next one's first word, with no space before it
            lines = pc.split_pattern(names.filter(lined), "\n").values
            nexts = lines.take(pa.array(np.arange(1, len(lines), 2)))
            names = pc.replace_with_mask(names, lined, lines.take(pa.array(np.arange(0, len(lines), 2))))
        word = pc.ascii_rtrim(names, characters=_MARKS)
        plain = pc.match_substring_regex(word, f"^[{_CLASS}]+$")
        marked = pc.and_(plain, pc.not_equal(pc.binary_length(word), pc.binary_length(names)))
        cache = self._after if self.spaced else self._raw
        rests = _after_letters(names.filter(marked))
        odd = names.filter(pc.invert(plain)).to_pylist()
        word = word.filter(plain) if self.spaced else pc.utf8_lower(word.filter(plain))
        word = word.dictionary_encode()
        plain, marked = plain.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        # Units: words, nothing, other pieces, marks, a line's end, words after it and their marks.  A piece is up to five units.
        known = self._known.many(word.dictionary)
        nothing = len(known)
        units = [b"", *[cache[x] if x or self.spaced else b"" for x in odd]]
        places = np.full((len(names), 5 if self.spaced else 2), nothing, np.int64)
        places[plain, 0] = word.indices.to_numpy()
        places[~plain, 0] = nothing + 1 + np.arange(len(odd))
        places[marked, 1] = nothing + len(units) + rests.indices.to_numpy()
        units += map(self._raw.__getitem__, rests.dictionary.to_pylist())
        if lined is not None and len(nexts):
            word = pc.ascii_rtrim(nexts, characters=_MARKS)
            rests = _after_letters(nexts)
            word = word.dictionary_encode()
            lined = lined.to_numpy(zero_copy_only=False)
            places[lined, 2], places[lined, 3] = nothing + len(units), nothing + len(units) + 1 + word.indices.to_numpy()
            units += [self._raw["\n"], *self._raw.many(_split(word.dictionary), self._words)]
            places[lined, 4] = nothing + len(units) + rests.indices.to_numpy()
            units += [self._raw[x] if x else b"" for x in rests.dictionary.to_pylist()]
        if self.spaced:  # a text's first piece has no space before it
            first = edges[:-1]
            heads, of = np.unique(at[first], return_inverse=True)
            first_units = np.full((len(heads), places.shape[1]), nothing, np.int64)
            first_units[:, 0] = nothing + len(units) + np.arange(len(heads))
            places = np.concatenate([places, first_units])
            units += [self._raw[x] if x else b"" for x in begin.take(pa.array(heads)).to_pylist()]
            at = at.copy()
            at[first] = len(names) + of
        every = pa.concat_arrays([known, pa.array(units, pa.large_binary())]).take(pa.array(places.ravel()))
        pieces = _joined(every, np.arange(0, places.size + 1, places.shape[1]))
        return _joined(pieces.take(pa.array(at)), edges)

    def arrays(self, texts: pa.StringArray, as_text: Callable[[int], str] | None = None) -> pa.LargeBinaryArray:
        """Little-endian unsigned 32-bit ids of each text.  as_text: a text by its place, if that isn't in Arrow's."""
        usual = self._usual(texts)
        many = self._together(texts.filter(usual)) if usual.true_count else pa.array([], pa.large_binary())
        if usual.true_count == len(texts):
            return many
        usual = usual.to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~usual).tolist()
        single = pa.array([self._text(as_text(k) if as_text else texts[k].as_py()) for k in others], pa.large_binary())
        places = np.cumsum(usual) - 1
        places[others] = len(many) + np.arange(len(others))
        return pa.concat_arrays([many, single]).take(pa.array(places))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Likewise of objects."""
        whole = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
        return self.arrays(whole, texts.__getitem__).to_pylist()

    def spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Character starts and ends of a byte-level tokenizer's tokens; a token of part of a character has all of it."""
        if self._lengths is None:
            with open(self.path, encoding="utf-8") as f:
                said = json.load(f)
            added = {x["id"]: len(x["content"].encode()) for x in said["added_tokens"]}
            vocabulary = said["model"]["vocab"]
            self._lengths = np.zeros(max(*vocabulary.values(), *added) + 1, np.int64)
            for token, i in vocabulary.items():
                self._lengths[i] = len(token)
            for i, n in added.items():
                self._lengths[i] = n
        ends = np.cumsum(self._lengths[np.frombuffer(ids, "<u4")])
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return char[starts], char[ends - 1] + 1


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder a worker process."""
    return held(("tokens", path, spaced), lambda: Encoder(path, spaced))
