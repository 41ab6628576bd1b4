"""Byte-level BPE ids of whole texts, word by word.

The vocabulary's own pattern cuts a text into words that are encoded one by one,
so the ids of a word can be remembered.  Most texts are cut at single blanks first:
a blank before any other character than white space begins a word, so the words
of the parts, each with its blank, are the words of the text.  Each worker keeps a
bounded memory of parts and words, in which each different part of a block of texts
is looked up once; the tokenizers library's model encodes what isn't there.  Texts
with characters outside the Latin blocks, or with a special token's string in them,
go to the library whole, so that the result is always the library's.
"""

from __future__ import annotations

import array
import codecs
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import remembered

#: Parts that a worker remembers; when full they are kept for a second turn.
MEMORY = 500_000
#: Characters whose parts are looked up together.
BLOCK = 1 << 20

#: Control characters that count as white space to some libraries only are left out.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-ɏ]*")
#: Letters and numbers among these characters.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: The vocabulary's pattern, for these characters.
_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_N}{_L}]+|\s+(?!\S)|\s+").findall
#: A blank before white space or the end belongs to no word's beginning.
_loose = re.compile(r" (?:\s|\Z)").search
_open: dict[str, "WordEncoder"] = remembered({})


def _byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    character = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return "".join(character[b] for b in range(256))


def version(path: str) -> str:
    """Digest of the tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.characters = self.library.model, _byte_characters()
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))).search if specials else lambda text: None
        #: ids of words without a blank, and of parts with theirs in front, now and before the memory was full
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def at(path: str) -> "WordEncoder":
        """The worker's own encoder of this file."""
        if path not in _open:
            _open[path] = WordEncoder(path)
        return _open[path]

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not self.special(text)

    def _cut(self, text: str) -> bytes:
        """Ids of a plain text, by its words."""
        return b"".join(map(self._of_word, _words(text)))

    def _of_word(self, word: str) -> bytes:
        if word[0] != " ":
            ids = self.known.get(word)
            if ids is None:
                ids = self.known[word] = self._word(word)
            return ids
        # a word with its blank is a part, too
        part = word[1:]
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = self.older.get(part) or self._word(word)
        return ids

    def _shown(self, text: str) -> str:
        """The characters that stand for the text's bytes."""
        return codecs.charmap_decode(text.encode(), "strict", self.characters)[0]

    def _word(self, word: str) -> bytes:
        """Ids of one word by the library's model."""
        return self._tokens(self._shown(word))

    def _tokens(self, shown: str) -> bytes:
        return array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _turn(self, more: int = 0) -> bool:
        """Whether the parts begin their second turn, to have room for more."""
        if len(self.known) > MEMORY:
            self.known.clear()
        if len(self.parts) + more <= MEMORY:
            return False
        self.older, self.parts = self.parts, {}
        return True

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts with their blanks, which are remembered."""
        found = list(map(self.parts.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        if self._turn(len(new)):
            self.parts.update((part, ids) for part, ids in zip(parts, found) if ids)
        old, now, unknown = self.older.get, self.parts, []
        for i in new:
            ids = old(parts[i])
            if ids is None:
                unknown.append(i)
            else:
                found[i] = now[parts[i]] = ids
        self._encode_parts([parts[i] for i in unknown])
        for i in unknown:
            found[i] = now[parts[i]]
        return found

    def _encode_parts(self, parts: list[str]) -> None:
        """Remembers the ids of new parts with their blanks; letters alone are one word with it."""
        letters, others, now = [], [], self.parts
        for part in parts:
            (letters if part.isalpha() else others).append(part)
        blank = self._shown(" ")
        for part, shown in zip(letters, self._shown(" ".join(letters)).split(blank)):
            now[part] = self._tokens(blank + shown)
        # words of all other parts at once: one with a blank begins a part
        words = _words(" " + " ".join(others)) if others else []
        known = self.known.get
        ids = [known(word) or self._of_word(word) for word in words]
        begins = [i for i, word in enumerate(words) if word[0] == " "]
        for part, begin, end in zip(others, begins, [*begins[1:], len(words)]):
            now[part] = b"".join(ids[begin:end])

    def _block(self, rests: list[str | None]) -> tuple[list[int], memoryview]:
        """Where each text's ids begin, and the last's end, among the ids of what follows the first blanks; these ids.

        Arrow finds the different parts and puts their ids in place.
        """
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        n = len(coded.dictionary)
        if not n:
            self._turn()
            return [0] * (len(rests) + 1), memoryview(b"")
        # parts hold no blanks; one long string is faster to take over than many short ones
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), pa.scalar(" ", pa.large_string()))
        found = pa.array(self._learn(joined[0].as_py().split(" ")), pa.large_binary()).take(coded.indices)
        _, places, ids = found.buffers()
        return np.frombuffer(places, "<i8")[cut.offsets.to_numpy()].tolist(), memoryview(ids)

    def _each(self, texts: list[str]):
        """(place, ids) of each text; the cut ones block by block."""
        places, begins, rests, size = [], [], [], 0
        for i, text in enumerate(texts):
            if not self._plain(text):
                ids = self.library.encode(text, add_special_tokens=False).ids
                yield i, array.array("I", ids).tobytes()
            elif _loose(text):
                self._turn()
                yield i, self._cut(text)
            else:
                first, blank, rest = text.partition(" ")
                places.append(i)
                begins.append(self._cut(first))
                rests.append(rest if blank else None)
                size += len(text)
            if places and (size >= BLOCK or i + 1 == len(texts)):
                ends, ids = self._block(rests)
                for place, begin, start, end in zip(places, begins, ends, ends[1:]):
                    yield place, begin + ids[start:end]
                places, begins, rests, size = [], [], [], 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        for place, ids in self._each(texts):
            out[place] = ids
        return out

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for place, ids in self._each(texts):
            out[place] = len(ids) // 4
        return out
