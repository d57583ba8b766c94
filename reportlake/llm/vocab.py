"""Ids of a tokenizer that drops white space and case, word by word.

Such a tokenizer (NFC, lower case, runs of letters apart from marks and white space, byte-level merges with word ends) gives a text the ids of its
words in a row, so the ids of a word are kept and looked up again, and words that differ in case or a mark at the end are looked up by their stem.
"""

from __future__ import annotations

import gc
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice
from operator import add

import numpy as np

#: Words that a worker keeps ids of, and their bytes together.
KEPT = 500_000
KEPT_BYTES = 1 << 25
#: Words that are encoded as one text.
JOINED = 256
#: Marks that are tokens of their own after a letter.
MARKS = frozenset(".,;:!?")
#: Letters below are NFC as they are, and each has its lower case by itself (but for U+0130, which becomes two characters).
PLAIN_BELOW = "\u0250"
#: Bytes of a text that are encoded at a time.
SLICE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def public_path(name: str) -> str:
    """Place of a public vocabulary on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(word: str) -> bool:
    """Whether all is letters whose lower case is sure to be the tokenizer's."""
    return word.isalpha() and (word.isascii() or max(word) < PLAIN_BELOW and "\u0130" not in word)


class WordIds:
    """Ids as little-endian unsigned 32-bit numbers, without the tokenizer's special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # what the tokenizer does with letters in lower case
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab()
        #: Whether an id ends a run of letters.
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for n, i in names.items() if n.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Numbers of words, and their ids by number; ids of stems."""
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[bytes] = []
        self.stems: dict[str, bytes] = {"": b""}
        self.bytes = 0

    def _learn(self, words: list[bytes]) -> None:
        stems, marks, plain, others = [], [], set(), set()
        for w in words:
            word, mark = w.decode(), ""
            letters = _plain(word)
            if not letters and word[-1] in MARKS and _plain(word[:-1]):
                word, mark, letters = word[:-1], word[-1], True
            if letters:
                word = word.lower()
            if word not in self.stems:
                (plain if letters else others).add(word)
            stems.append(word)
            marks.append(mark)
        encode = lambda with_, texts: [np.array(e.ids, "<u4") for e in with_.encode_batch_fast(texts, add_special_tokens=False)]
        # a word of letters has one end, so that many can be encoded as one text and told apart
        plain, others = list(plain), [*others, *(set(marks) - self.stems.keys())]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, encode(self.letters, [" ".join(g) for g in groups]), strict=True):
            raw, at = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            self.stems.update(zip(group, [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], strict=True))
        self.stems.update((s, ids.tobytes()) for s, ids in zip(others, encode(self.tokenizer, others), strict=True))
        ids = self.stems.__getitem__
        self.ids += map(add, map(ids, stems), map(ids, marks))
        self.bytes += sum(map(len, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of several texts."""
        if len(self.numbers) > KEPT or self.bytes > KEPT_BYTES:
            self.forget()
        # nothing here is cyclic, and the collector would go through all kept words again and again
        gc.disable()
        try:
            number = self.numbers.__getitem__
            found = [list(map(number, t.split())) for t in texts]
            self._learn(list(islice(self.numbers, len(self.ids), None)))
            ids = self.ids.__getitem__
            return [b"".join(map(ids, f)) for f in found]
        finally:
            gc.enable()

    def stream(self, text: bytes) -> Iterator[bytes]:
        """Ids of a text of any length, part by part; a part ends at a blank."""
        at = 0
        while at < len(text):
            end = len(text)
            if at + SLICE < end:
                blank = BLANK.search(text, at + SLICE)
                end = blank.start() if blank else end
            yield self.encode([text[at:end]])[0]
            at = end


@cache
def word_ids(path: str) -> WordIds:
    """The encoder of this worker."""
    return WordIds(path)
