"""Whole texts to token ids, with the ids of repeated words kept in a bounded cache.

The vocabularies used here cut a text at white space before they merge characters, so a text
can be encoded piece by piece: a piece starts at a space or line feed that follows another
character. Pieces that were not met before are encoded together in one call of the library. A text
that holds the string of an added token, such as an end mark, is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np

from linkcast.llm.common import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task is one core

CACHE_WORDS = 600_000
SEEN_MASK = (1 << 25) - 1  # bits that remember the pieces met once
PART_CHARS = 1 << 20
GROUP_CHARS = 1 << 18  # texts whose new words are encoded together; more take memory and no less time
JOINT = 128  # words in one call; longer texts cost more per word
CUT = re.compile(r"(?<=\S)(?=[ \n])")
# Two separators in a row, other white space, and the separator of a joint call.
DOUBLE = ("  ", "\n\n", " \n", "\n ")
RARE_ASCII = tuple(c for c in map(chr, range(128)) if c == "\x00" or c.isspace() and c not in " \n")
RARE = tuple(c for c in map(chr, range(128, 0x3001)) if c.isspace())


def usual(text: str) -> bool:
    """Whether single spaces and line feeds are the only white space."""
    tests = DOUBLE + RARE_ASCII + (() if text.isascii() else RARE)
    return not any(t in text for t in tests)


@lru_cache(1 << 14)
def plain_letter(c: str) -> bool:
    """A letter or digit that stays one when it is normalised and lower-cased."""
    if c.isascii():
        return c.isalnum()
    low = unicodedata.normalize("NFC", c).lower()
    return c.isalpha() and len(low) == 1 and low.isalpha()


# Signs that are tokens of their own after a letter or digit; an apostrophe must not come first.
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_")
SIGN_SET = frozenset(SIGNS)
CACHE_SIGNS = 10_000


def without_signs(word: str) -> str:
    """The word up to its last letter or digit if only signs follow, which are cut off before merging."""
    core = word.rstrip(SIGNS)
    apart = 0 < len(core) < len(word) and word[len(core)] != "'" and plain_letter(core[-1])
    return core if apart else word


PLAIN = re.compile(r"[ \n][^\s\x00]+\Z")
ALL_PLAIN = re.compile(r"(?:[ \n][^\s\x00]++(?:\x00|\Z))++\Z")  # words with the separator of a joint call


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str) -> list[str]:
    """The text in parts of about a million characters, cut where pieces may start."""
    if len(text) <= PART_CHARS:
        return [text]
    found, at = [], 0
    while at < len(text):
        cut = CUT.search(text, min(len(text), at + PART_CHARS))
        end = cut.start() if cut else len(text)
        found.append(text[at:end])
        at = end
    return found


class Encoder:
    """``encode`` gives little-endian unsigned 32-bit ids of whole texts, without special tokens.

    ``keeps_space`` says whether the vocabulary has tokens for white space (byte-level) or
    drops it. ``recent`` words that were met once are kept until as many newer ones have come
    twice over; without it a word is encoded anew when it comes for the second time.
    """

    def __init__(self, path: str, keeps_space: bool, recent: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        self.cache: dict[str, bytes] = {"": b""}
        self.seen = np.zeros((SEEN_MASK + 1) // 8, np.uint8)
        self.signs: dict[str, bytes] = {}
        self.recent, self.older, self.most_recent = {}, {}, recent
        self.mark = self._ids("\x00" if keeps_space else " \x00 ")
        self.glue = "\x00" if keeps_space else " \x00 "

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        if not usual(text):
            return CUT.split(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache does not have."""
        # Signs after a letter or digit are tokens of their own: the rest may be known.
        cores = {w: core for w in words if w[-1] in SIGN_SET and len(core := without_signs(w)) < len(w)}
        whole = dict.fromkeys([w for w in words if w not in cores])
        known = {c: ids for c in cores.values() if (ids := self.cache.get(c) or self.recent.get(c) or self.older.get(c))}
        whole.update(dict.fromkeys([c for c in cores.values() if c not in known]))
        fresh = self._encode_new(list(whole))
        for w, core in cores.items():
            fresh[w] = (known.get(core) or fresh[core]) + self._signs(w[len(core):])
        return fresh

    def _signs(self, signs: str) -> bytes:
        ids = self.signs.get(signs)
        if ids is None:
            ids = np.array(self._ids(signs), "<u4").tobytes()
            if len(self.signs) < CACHE_SIGNS:
                self.signs[signs] = ids
        return ids

    def _encode_new(self, words: list[str]) -> dict[str, bytes]:
        joint, alone, found = words, [], {}
        if self.keeps_space:
            usual_words = ALL_PLAIN.match("\x00".join(words))
        else:
            usual_words = "\x00" not in "".join(words) and not any(map(str.isspace, words))
        if not usual_words:
            joint = []
            for w in words:
                plain = PLAIN.match(w) if self.keeps_space else "\x00" not in w and not w.isspace()
                (joint if plain else alone).append(w)
        for at in range(0, len(joint), JOINT):
            some = joint[at: at + JOINT]
            text = self.glue.join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) != 1 or len(ends) != len(some) - 1:
                alone += some
                continue
            raw = ids.tobytes()
            starts = [0, *(4 * (ends + 1)).tolist()]
            found.update(zip(some, [raw[a:b] for a, b in zip(starts, [*(4 * ends).tolist(), len(raw)])]))
        for w in alone:
            found[w] = np.array(self._ids(w), "<u4").tobytes()
        return found

    def _admit(self, fresh: dict[str, bytes]) -> None:
        """Keep pieces that come for the second time; most never do."""
        room = CACHE_WORDS - len(self.cache)
        if room <= 0:
            return
        words = list(fresh)
        at = np.fromiter(map(hash, words), np.int64, len(words)) & SEEN_MASK
        place, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
        for k in np.flatnonzero(self.seen[place] & bit)[:room].tolist():
            self.cache[words[k]] = fresh[words[k]]
        np.bitwise_or.at(self.seen, place, bit)

    def _found(self, words: dict[str, None]) -> dict[str, bytes]:
        """Ids of pieces that the cache does not have; those met lately enter it."""
        again = {}
        if self.most_recent:
            again = {w: ids for w in words if (ids := self.recent.get(w) or self.older.get(w))}
            self.cache.update(islice(again.items(), max(0, CACHE_WORDS - len(self.cache))))
        fresh = self._learn([w for w in words if w not in again])
        self._admit(fresh)
        if self.most_recent:
            self.recent.update(fresh)
            if len(self.recent) > self.most_recent:
                self.older, self.recent = self.recent, {}
        return fresh | again if again else fresh

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; a null text has none."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            found = parts(text or "")
            if len(found) > 1 or any(t in found[0] for t in self.added):  # by itself, part by part
                out += self._join(group)
                group, size = [], 0
                out.append(b"".join(map(self._part, found)))
                continue
            group.append(self.pieces(found[0]))
            size += len(text or "")
            if size >= GROUP_CHARS:
                out += self._join(group)
                group, size = [], 0
        return out + self._join(group)

    def _part(self, part: str) -> bytes:
        # Parts begin at white space, which added tokens do not hold.
        if any(t in part for t in self.added):
            return np.array(self._ids(part), "<u4").tobytes()
        return self._join([self.pieces(part)])[0]

    def _join(self, group: list[list[str]]) -> list[bytes]:
        look = self.cache.get
        found = [list(map(look, pieces)) for pieces in group]
        holes = [[i for i, ids in enumerate(each) if ids is None] for each in found]
        new = dict.fromkeys([pieces[i] for pieces, at in zip(group, holes) for i in at])
        fresh = self._found(new)
        for pieces, each, at in zip(group, found, holes):
            for i in at:
                each[i] = fresh[pieces[i]]
        return [b"".join(each) for each in found]


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, keeps_space: bool, recent: int = 0) -> Encoder:
    """One per worker process, so that the cache outlives a task."""
    key = (path, keeps_space, recent)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def forget() -> None:
    """Let the encoders of this worker process go, in steps that come after the last encoding."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()
