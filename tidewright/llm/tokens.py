"""Whole-text encoding with the tokenizers library, each distinct word encoded once a task.

Both vocabularies split a text into pieces before any merge, and a space before
a non-space always starts a new piece.  So a text is cut at its spaces, the
chunks are looked up in a bounded cache, and only new chunks go to the library.
A new word of plain letters is one piece that no normaliser changes, so it goes to
the library's model at once; other new chunks go through the whole library, in
batches.  Where the cut would not be exact (a space within a run of white space,
special tokens written out in a text) the library gets the whole text.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from .common import give_back  # noqa: E402

#: Words that a task remembers (some 200 bytes each).  Beyond, a new generation begins, and words met again move into it.
CACHE = 700_000
TAIL = ".,;:!?"
#: A space between white space: there a cut would be wrong.  The first pattern is quick to rule it out.
_GAP, _INNER = re.compile(r" \s"), re.compile(r"\s \s")
_WIDE = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: How byte-level vocabularies spell the bytes of UTF-8: printable ones as they are, the others as letters from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_SEEN))}
#: Makes bytes of few ids.
_BYTES = [struct.Struct(f"={n}I").pack for n in range(16)]

_open: dict[tuple[str, bool], "Encoder"] = {}


class Encoder:
    """keep_space: the space before a word belongs to its piece (byte-level), else spaces are dropped."""

    def __init__(self, path: str, keep_space: bool):
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        made["post_processor"] = None  # it only trims offsets, which are not used
        self.library = Tokenizer.from_str(json.dumps(made))
        self.library.no_truncation()
        self.library.no_padding()
        self.lowers = any(n["type"] == "Lowercase" for n in (made.get("normalizer") or {}).get("normalizers", []))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.space = " " if keep_space else ""
        self.lead = chr(_SPELT[32]) if keep_space else ""
        steps = made["pre_tokenizer"].get("pretokenizers", [made["pre_tokenizer"]])
        plain = steps[-1]["type"] == "ByteLevel" and not steps[-1]["add_prefix_space"] and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        self.model = self.library.model if plain else None
        self.forget()

    def forget(self) -> None:
        self.new, self.old = {}, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str, lead: str) -> bytes | None:
        """Ids of a word of letters below U+0250 that stay as they are when normalised, behind ``lead``; None for any other."""
        if self.model is None or not word.isalpha() or (self.lowers and word != word.lower()):
            return None
        if not word.isascii():
            if _WIDE.search(word):
                return None
            word = word.encode().decode("latin-1").translate(_SPELT)
        ids = [t.id for t in self.model.tokenize(lead + word)]
        return _BYTES[len(ids)](*ids) if len(ids) < len(_BYTES) else array("I", ids).tobytes()

    def _parts(self, chunk: str) -> tuple[str, ...]:
        """Pieces of a chunk that occur in other chunks too: the word and the marks behind it."""
        head, line, rest = chunk.partition("\n")
        if line and self.space and head.strip() and rest and not head[-1].isspace() and not rest[0].isspace():
            return (*self._parts(head), line, *self._parts(rest))
        word = chunk.rstrip(TAIL)
        if len(word) != len(chunk) and word.lstrip(" ").isalpha() and max(word) < "\u2000" and "\u0130" not in word:
            return word, chunk[len(word) :]
        return (chunk,)

    def _learn(self, keys: list) -> None:
        """Fills in keys that are not in ``new``, from ``old`` or from the library.

        A key is a word behind a space, or (text,) for a piece without one; where
        spaces are dropped it is the piece itself.
        """
        new, old, space = self.new, self.old, self.space
        wanted: dict = {}
        split = []
        for k in keys:
            if k in old:
                new[k] = old[k]
                continue
            word, lead = (k[0], "") if k.__class__ is tuple else (k, self.lead)
            ids = self._word(word, lead)
            if ids is not None:
                new[k] = ids
                continue
            piece = space + k if lead else word
            if k.__class__ is str and k.isalpha():
                wanted[k] = piece
                continue
            parts = self._parts(piece)
            if len(parts) == 1:
                wanted[k] = piece
                continue
            own = [p if not space else p[1:] if p[0] == " " else (p,) for p in parts]
            split.append((k, own))
            for p, piece in zip(own, parts):
                if p not in new:
                    if p in old:
                        new[p] = old[p]
                    elif (ids := self._word(p[0], "") if p.__class__ is tuple else self._word(p, self.lead)) is not None:
                        new[p] = ids
                    else:
                        wanted[p] = piece
        names, texts = list(wanted), list(wanted.values())
        for at in range(0, len(names), 4096):
            new.update(zip(names[at : at + 4096], self.whole(texts[at : at + 4096])))
        for k, own in split:
            new[k] = b"".join([new[p] for p in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        out: list[bytes | None] = [None] * len(texts)
        hard, waiting, missing = [], {}, set()
        get = self.new.get
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or (self.space and (text.endswith(" ") or (_GAP.search(text) and _INNER.search(text)))):
                hard.append(i)
                continue
            if self.space:
                keys: list = text.split(" ")
                keys[:1] = [(keys[0],)] if keys[0] else []
            else:
                if self.lowers and (text.isascii() or not _WIDE.search(text)):
                    text = text.lower()  # as the library would: these letters have no marks to compose and no rules of context
                keys = text.replace("\n", " ").split(" ")
            found = list(map(get, keys))
            at, gaps = -1, []
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                gaps.append(at)
            if gaps:
                lacking = [keys[at] for at in gaps]
                waiting[i] = found, gaps, lacking
                missing.update(lacking)
            else:
                out[i] = b"".join(found)
        if missing:
            self._learn(list(missing))
        for i, (found, gaps, lacking) in waiting.items():
            for at, k in zip(gaps, lacking):
                found[at] = self.new[k]
            out[i] = b"".join(found)
        for i, ids in zip(hard, self.whole([texts[i] for i in hard]) if hard else []):
            out[i] = ids
        return out


@contextmanager
def encoding(path: str, keep_space: bool) -> Iterator[Encoder]:
    """The encoder for one task.  Its words go when the task ends, so that a worker does not hold them through stages of other kinds."""
    enc = encoder(path, keep_space)
    try:
        yield enc
    finally:
        enc.forget()
        give_back()


def encoder(path: str, keep_space: bool) -> Encoder:
    """The encoder of this process, kept between tasks of a reused worker."""
    if (path, keep_space) not in _open:
        _open[path, keep_space] = Encoder(path, keep_space)
    return _open[path, keep_space]
