"""Part-wise access to the public tokenizers.

The word tokenizer works on one part of a word at a time, so a document's ids are its parts' ids in
a row. Each Python worker keeps a bounded dictionary from parts to ids (as little-endian 32-bit
bytes) for as long as it lives; only parts that it has not met lately reach the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa

from . import memory

#: Parts that a worker's newer generation holds; there are two. About 220 bytes each.
REMEMBERED = 250_000
#: Characters that are split at once.
GIANT = 4_000_000
BLANK = re.compile("[ \n]")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; a path to an existing file stands for itself."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Generations:
    """A dictionary of bounded size: what was asked for lately is in the newer half, the older half is dropped at once."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> set[str]:
        """What has to be learnt; what the older half holds moves into the newer one."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        wanted = wanted - self.new.keys()
        held = wanted & self.old.keys()
        self.new.update((w, self.old[w]) for w in held)
        return wanted - held


class WordTokenizer:
    """Ids of whole texts by a tokenizers file that drops white space and works word by word.

    A text of plain characters is split into the parts that the tokenizer works on; others are split
    at blanks first, and words that hold other characters go to the tokenizer as they are. New parts go
    to it together, as lines of one text, which costs a third of asking for each.
    """

    #: Lower-case letters and digits of Latin-1, and how word_bpe files split lower-cased text.
    LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
    PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^ \n{LETTERS}{DIGITS}]+")
    #: Characters that Unicode normalisation leaves alone and whose lower case is one character, and blanks.
    PLAIN = re.compile("[ \n!-~¡-ÿ]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(size)])
        self.parts, self.odd = Generations(REMEMBERED), Generations(REMEMBERED // 8)

    def ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        return "<|" not in text and self.PLAIN.fullmatch(text) is not None

    def _learn(self, new: list[str]) -> None:
        """Each part is one word of the tokenizer, so its last id is the next that ends a word."""
        known = self.parts.new
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                known.update((p, self.ask(p)) for p in some)
                continue
            raw, starts = ids.tobytes(), np.concatenate(([0], ends[:-1])) * 4
            known.update(zip(some, (raw[i:j] for i, j in zip(starts.tolist(), (ends * 4).tolist(), strict=True)), strict=True))

    def _mixed(self, text: str) -> bytes:
        """A text that holds other characters: word by word."""
        words = text.replace("\n", " ").split(" ")
        split = [self.PARTS.findall(w.lower()) if self.plain(w) else None for w in words]
        self._learn(list(self.parts.missing({p for own in split if own for p in own})))
        odd = self.odd.missing({w for w, own in zip(words, split, strict=True) if own is None})
        self.odd.new.update((w, self.ask(w)) for w in odd)
        known, asked = self.parts.new, self.odd.new
        return b"".join([asked[w] if own is None else b"".join([known[p] for p in own]) for w, own in zip(words, split, strict=True)])

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.PARTS.findall(t.lower()) if self.plain(t) else None for t in texts]
        self._learn(list(self.parts.missing(set().union(*[own for own in split if own]))))
        find = self.parts.new
        out = [None if own is None else b"".join(map(find.__getitem__, own)) for own in split]
        for text, ids in zip(texts, out, strict=True):
            yield self._mixed(text) if ids is None else ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as bytes. Giant texts are worked through in slices that end at blanks."""
        for some in by_size(texts):
            if len(some) == 1:
                yield b"".join([ids for part in slices(some[0]) for ids in self._ids([part])])
            else:
                yield from self._ids(some)


def by_size(texts: list[str], chars: int = GIANT) -> Iterator[list[str]]:
    """Runs of texts of so many characters at most, or of one longer text."""
    some, n = [], 0
    for t in texts:
        if some and n + len(t) > chars:
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


def slices(text: str, chars: int = GIANT) -> list[str]:
    """The text cut after blanks into slices of about so many characters; a longer word stays whole."""
    out, at = [], 0
    while len(text) - at > chars and (blank := BLANK.search(text, at + chars)):
        out.append(text[at : blank.end()])
        at = blank.end()
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)


memory.REMEMBERED["words"] = word_tokenizer.cache_clear


def id_lists(buffers: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit ids from their bytes."""
    offsets, total = [0], 0
    for b in buffers:
        total += len(b) // 4
        offsets.append(total)
    values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(buffers))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def checksum(ids: bytes) -> int:
    return crc32(ids)
