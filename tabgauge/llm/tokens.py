"""Token ids of whole texts, as a tokenizers file gives them, with remembered words.

A public tokenizer's pre-tokenization never joins what white space separates, so a text
is encoded piece by piece (white space and the characters after it), and the ids of
frequent pieces are remembered in a bounded table. Many texts are cut and put together
again by Arrow, so that Python sees each different piece once. The ids equal those of the
library's own encode() with add_special_tokens=False; tests hold both against each other.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: White space as Unicode defines it, which is what the tokenizers' \\s means.
_WHITE = "\t-\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_RUNS = re.compile(f"[{_WHITE}]{{2}}")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters below are composed already.
_COMBINING = "\u0300"
#: Pieces and words that a task remembers, some 200 bytes each.
_KNOWN = 300_000
#: Parts that a task remembers in Arrow, of so many bytes each at most.
_HELD = 500_000
_SHORT = 32
#: Texts of about so many bytes are cut into pieces together.
_TOGETHER = 8 << 20


class _Known(dict):
    """Remembers a bounded number of results of a function."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        found = self.compute(key)
        if len(self) < _KNOWN:
            self[key] = found
        return found


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str) -> None:
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        steps = settings["pre_tokenizer"].get("pretokenizers", [settings["pre_tokenizer"]])
        pattern = [step["pattern"]["Regex"] for step in steps if step["type"] == "Split"]
        #: Whether white space is dropped rather than made part of words.
        self.drops = bool(pattern)
        self.split = regex.compile(pattern[0] if pattern else public_tokenizers.PATTERN).findall
        norms = (settings["normalizer"] or {}).get("normalizers", [])
        self.folds = any(step["type"] == "Lowercase" for step in norms)
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = _Known(self._word)
        self.pieces = _Known(self._piece)
        self.spaced = _Known(lambda part: self._piece(self._spaced(part)))
        #: Parts of texts and their ids, for encode_all().
        self.held = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _piece(self, piece: str) -> bytes:
        words = self.words
        bare = piece[1:] if piece[:1] == " " else piece
        if bare.isascii() or max(bare) < _COMBINING:
            # nothing to compose; letters are one word, as the patterns say
            bare = bare.lower() if self.folds else bare
            start = bare if self.drops or bare is piece else " " + bare
            if bare.isalpha():
                return words[start]
            stem = bare.rstrip(string.punctuation)
            if bare and not stem:
                return words[start]
            if stem.isalpha():  # and the marks after them are another
                marks = bare[len(stem) :]
                return words[start[: -len(marks)]] + words[marks]
            at = bare.find("\n")
            if not at and not self.drops and bare is piece and bare[1:2].strip():
                return words["\n"] + self.pieces[bare[1:]]
            if at > 0 and not self.drops:
                return self.pieces[piece[: at - len(bare)]] + self.pieces[bare[at:]]
            if self.drops and bare.isprintable():  # the normalizer would leave it as it is
                return b"".join(map(words.__getitem__, self.split(bare)))
        if self.tokenizer.normalizer:
            piece = self.tokenizer.normalizer.normalize_str(piece)
        return b"".join(map(words.__getitem__, self.split(piece)))

    def _word(self, word: str) -> bytes:
        bare = word[1:] if word[:1] == " " else word
        if bare.isascii() and bare.isalnum():  # stand for themselves
            mapped = _LETTERS[0x20] + bare if bare is not word else word
        else:
            mapped = "".join(map(_LETTERS.__getitem__, word.encode("utf-8", "replace")))
        return b"".join([self.ids[t.id] for t in self.model.tokenize(mapped)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        if self.folds:  # fewer different pieces; the normalizer folds the rest
            text = text.encode("utf-8", "replace").lower().decode("utf-8")
        if self.drops:
            # split() also cuts at four separators that are not white space to the patterns
            parts = text.split(" ") if any(map(text.__contains__, _SEPARATORS)) else text.split()
            return b"".join(map(self.pieces.__getitem__, parts))
        if _RUNS.search(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        first, *rest = text.split(" ")
        return self.pieces[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """What encode() gives for each of many texts (null: empty)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            most = _TOGETHER + (ends[start - 1] if start else 0)
            stop = max(start + 1, int(np.searchsorted(ends, most, side="right")))
            yield from self._together(texts.slice(start, stop - start))
            start = stop

    def _together(self, texts: pa.Array) -> list[bytes]:
        if self.drops:
            for white in "\t\n\r":
                texts = pc.replace_substring(texts, white, " ")
            # only now: ascii_lower() misreads what cast() makes of a slice
            return self._joined(pc.ascii_lower(texts) if self.folds else texts)
        runs = pc.match_substring_regex(texts, _RUNS.pattern)
        plain = iter(self._joined(pc.replace_substring(texts.filter(pc.invert(runs)), "\n", " \n")))
        held = iter(texts.filter(runs).to_pylist())
        return [self.encode(next(held)) if run else next(plain) for run in runs.to_pylist()]

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts in which all that a single space separates is a piece."""
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        found, at, bounds = self._found(coded.dictionary), coded.indices.to_numpy(), parts.offsets.to_numpy()
        if not self.drops:  # no space stands before the first of a text
            at, firsts = at.copy(), bounds[:-1]
            more = [self.pieces[p] for p in coded.dictionary.take(pa.array(at[firsts])).to_pylist()]
            at[firsts] = np.arange(len(found), len(found) + len(more))
            found = pa.concat_arrays([found, pa.array(more, pa.large_binary())])
        _, ends, data = found.take(pa.array(at)).buffers()
        if data is None:
            return [b""] * len(texts)
        places = np.frombuffer(ends, np.int64)[bounds].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(places, places[1:])]

    def _found(self, parts: pa.Array) -> pa.Array:
        """The ids of different parts, most of which earlier texts had."""
        names, ids = self.held
        place = pc.index_in(parts, names)
        new = parts.filter(place.is_null())
        own = pa.array([self._piece(self._spaced(part)) for part in new.to_pylist()], pa.large_binary())
        if len(names) < _HELD:
            short = pc.less_equal(pc.binary_length(new), _SHORT)
            room = _HELD - len(names)
            self.held = (
                pa.concat_arrays([names, new.filter(short)[:room]]),
                pa.concat_arrays([ids, own.filter(short)[:room]]),
            )
        missing = place.is_null().to_numpy(zero_copy_only=False)
        known = ids.take(place.drop_null())
        order = np.where(missing, len(known) + np.cumsum(missing) - 1, np.cumsum(~missing) - 1)
        return pa.concat_arrays([known, own]).take(pa.array(order))

    def _spaced(self, part: str) -> str:
        """A part with the space before it that belongs to its piece."""
        return part if self.drops or part[:1] == "\n" else " " + part


def _byte_letters() -> list[str]:
    """For each byte the letter that byte-level vocabularies write for it.

    Printable bytes stand for themselves; the others take code points from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    places = {byte: 256 + place for place, byte in enumerate(others)}
    return [chr(places.get(byte, byte)) for byte in range(256)]


_LETTERS = _byte_letters()
_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of a tokenizer file, one per process."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
