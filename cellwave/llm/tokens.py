"""Token ids of whole texts, with a bounded cache of word encodings per Python worker.

The tokenizers library spends most of its time on words it has seen before. In neither vocabulary does a
token cross a single space or line break between words, so the ids of a text are the ids of its words one
after another; a worker keeps the ids of words it met and asks the library for the rest, many in one call.
Texts where that does not hold (control strings, runs of white space) go to the library whole. The ids
equal ``Tokenizer.encode(text, add_special_tokens=False)`` in every case, which the tests check.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterable
from itertools import islice

import numpy as np

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 1
CACHE_WORDS = 500_000
CACHED_LENGTH = 64
JOINED = 500
MARKS = ".,;:!?"
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    """Place of a vocabulary: a path as it is, else the name of a public tokenizer file."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(vocabulary(name))
        table = self.tool.get_vocab(with_added_tokens=True)
        self.size = max(table.values()) + 1
        self.specials = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        # byte-level pieces take the space before them along; the other vocabulary marks the ends of words
        self.led = "Ġthe" in table
        self.edge = np.zeros(self.size, bool)
        for token, k in table.items():
            self.edge[k] = token.startswith("Ġ") if self.led else token.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.marks = {c: self._each([c])[0] for c in MARKS}
        # what comes before the model only lower-cases ASCII letters, as far as this vocabulary does no more
        trial = ["plain", "Words", "OF", "q", "zyxwvut"]
        self.bare = not self.led and self._bare(trial) == self._each(trial)

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.tool.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _split(self, text: str) -> list[str] | None:
        """Words; in the led form ``\\0`` marks those without a space before them and ``\\1`` is a line break.

        None unless single spaces and line breaks are all the white space there is.
        """
        words = text.split()
        breaks = text.count("\n")
        if (
            len(text) - len("".join(words)) != max(len(words) - 1, 0)
            or text.count(" ") + breaks != len(words) - 1
            or "\0" in text
            or "\1" in text
            or any(s in text for s in self.specials)
        ):
            return None
        if not self.led:
            return words
        return ("\0" + (text.replace("\n", " \1 \0") if breaks else text)).split(" ")

    def _bare(self, words: list[str]) -> list[bytes]:
        """Ids of words of ASCII letters from the vocabulary's model alone."""
        ids, ends, model = [], [0], self.tool.model
        for w in words:
            ids += [t.id for t in model.tokenize(w.lower())]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _letters(self, words: list[str], by: str) -> list[bytes]:
        """Ids of words of letters, encoded many at a time and cut where words begin or end."""
        out: list[bytes] = []
        lead = by if self.led and by == " " else ""
        for k in range(0, len(words), JOINED):
            some = words[k : k + JOINED]
            # the form that keeps no places of tokens in the text
            joined = self.tool.encode_batch_fast([lead + by.join(some)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, "<u4")
            if by == "\n":
                at = np.flatnonzero(ids == self.newline)
                cuts, ends = np.append(0, at + 1), np.append(at, len(ids))
            elif self.led:
                cuts = np.flatnonzero(self.edge[ids])
                ends = np.append(cuts[1:], len(ids))
            else:
                ends = np.flatnonzero(self.edge[ids]) + 1
                cuts = np.append(0, ends[:-1])
            if len(cuts) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip((cuts * 4).tolist(), (ends * 4).tolist(), strict=True)]
            else:  # a letter that the vocabulary's rules take apart
                out += self._each([lead + w for w in some])
        return out

    @property
    def newline(self) -> int:
        return int(np.frombuffer(self.marks.setdefault("\n", self._each(["\n"])[0]), "<u4")[0])

    def _fresh(self, missing: set[str]) -> dict[str, bytes]:
        known, stems, odd = self.words, {}, []
        fresh = {w for w in missing if w.isalpha()}  # the common case, and its own stem
        for w in missing.difference(fresh):
            stem = w[1:] if w[:1] == "\0" else w
            mark = stem[-1:] if stem[-1:] in self.marks and stem else ""
            stem = stem[: len(stem) - len(mark)]
            if stem.isalpha():
                stems[w] = (w[: len(w) - len(mark)], mark)
            else:
                odd.append(w)
        fresh.update({s for s, _ in stems.values()}.difference(known))
        first = [w for w in fresh if w[:1] == "\0"] if self.led else []
        plain = [w for w in fresh if w[:1] != "\0"] if first else list(fresh)
        ids = {}
        if self.bare:
            ascii_ = [w for w in plain if w.isascii()]
            plain = [w for w in plain if not w.isascii()]
            ids.update(zip(ascii_, self._bare(ascii_), strict=True))
        ids.update(zip(plain, self._letters(plain, " "), strict=True))
        ids.update(zip(first, self._letters([w[1:] for w in first], "\n"), strict=True))
        lead = " " if self.led else ""
        text = ["\n" if w == "\1" else w[1:] if w[:1] == "\0" else lead + w for w in odd]
        ids.update(zip(odd, self._each(text), strict=True))
        for w, (stem, mark) in stems.items():
            if mark:
                ids[w] = (ids.get(stem) or known[stem]) + self.marks[mark]
        return ids

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """One entry per text; null and empty texts give no ids.

        The words' lists hold no cycles, and scans for cycles took near a third of the time; they wait for the end.
        """
        scans = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if scans:
                gc.enable()

    def _encoded(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        split = [self._split(t) for t in texts]
        known, look = self.words, self.words.get
        # each word is looked up once; only those without ids are gathered and asked for
        found = [words and list(map(look, words)) for words in split]
        gaps = [ids and [k for k, raw in enumerate(ids) if raw is None] for ids in found]
        fresh = self._fresh({words[k] for words, at in zip(split, gaps, strict=True) for k in at or ()})
        whole = iter(self._each([t for t, words in zip(texts, split, strict=True) if words is None]))
        out = []
        for words, ids, at in zip(split, found, gaps, strict=True):
            for k in at or ():
                ids[k] = fresh[words[k]]
            out.append(next(whole) if words is None else b"".join(ids))
        room = CACHE_WORDS - len(known)
        if room > 0:
            known.update(islice(((w, raw) for w, raw in fresh.items() if len(w) <= CACHED_LENGTH), room))
        return out


def encoder(name: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
