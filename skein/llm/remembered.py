"""Token ids of texts by way of a tokenizer of the tokenizers library that is asked once per distinct word.

A single space between two characters that are not white space always starts a new piece of a byte-level or
metaspace tokenizer, so a text's ids are those of its words, each with the space before it, in a row. Arrow splits a batch of
texts and numbers its distinct words; numpy puts the ids of each text together by those numbers. A worker
keeps the ids of the words it met lately, up to a bound; new words of a batch are encoded in a few long texts and cut where a
token starts with the space. Texts with other white space next to a space, and words that cannot be cut
that way, are encoded as they stand.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skein.llm.common import release

os.environ.setdefault("RAYON_NUM_THREADS", "2")

#: Words per long text.
TOGETHER = 4096
#: Bytes of text that are worked on together.
BATCH = 1 << 21


def threads(on: bool) -> None:
    """Whether the tokenizers library shares a batch among threads; it looks this up at every call."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"


def slices(texts: pa.Array, most: int = BATCH) -> Iterator[pa.Array]:
    """Runs of neighbouring texts with about ``most`` bytes together; a longer text stands alone."""
    sizes = np.asarray(pc.binary_length(texts)).tolist()
    low, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield texts[low:at]
            low, held = at, 0
        held += size
    if low < len(sizes):
        yield texts[low:]


class Words:
    """``ids`` gives whole texts' ids; ``starts[id]`` tells which tokens start with the space.

    ``prefix``: the tokenizer itself puts a space before a text, so a text's first word is like any other.
    ``tails``: ids of signs that the tokenizer always parts from letters before them.
    ``check`` may tell of words (a list) which ones fail a test; texts with such a word are reported.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], starts: np.ndarray, dtype: str, marker: str, prefix: bool,
                 check: Callable[[list[str], list[bytes]], list[bool]] | None = None, tails: dict[str, bytes] | None = None, most: int = 300_000) -> None:
        self.encode, self.starts, self.dtype, self.marker, self.prefix, self.check, self.most = encode, starts, np.dtype(dtype), marker, prefix, check, most
        self.tails = tails or {}
        self.known: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}
        self.failed: set[str] = set()

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words; None marks what is no word: empty, with white space at an end, or with the marker inside."""
        good = []
        for word in words:
            if word.isalpha() and self.marker not in word or word and not word[0].isspace() and not word[-1].isspace() and self.marker not in word:
                good.append(word)
            else:
                self.known[word] = None
        groups = [good[at : at + TOGETHER] for at in range(0, len(good), TOGETHER)]
        size = self.dtype.itemsize
        lead = "" if self.prefix else " "
        for group, ids in zip(groups, self.encode([lead + " ".join(group) for group in groups])):
            array = np.array(ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.starts[array])
            if len(cuts) == len(group):
                raw = array.tobytes()
                places = [*(cuts * size).tolist(), len(raw)]
                self.known.update(zip(group, [raw[a:b] for a, b in zip(places, places[1:])]))
            else:
                self.known.update(zip(group, map(self._bytes, self.encode([lead + w for w in group]))))
        if self.check and good:
            self.failed.update(w for w, fine in zip(good, self.check(good, [self.known[w] for w in good])) if not fine)

    def _known(self, words: list[str]) -> list[bytes | None]:
        if len(self.known) > self.most:  # words in use move on from the one before, the others go with it
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        if before:
            known.update((w, before[w]) for w in new if w in before)
            new = [w for w in new if w not in before]
        tailed = [w for w in new if w[-1:] in self.tails and w[:-1].isalpha()] if self.tails else []
        if tailed:
            bare = [w for w in {w[:-1] for w in tailed}.union(new).difference(tailed) if w not in known]
            known.update((w, before[w]) for w in bare if w in before)
            new = [w for w in bare if w not in before]
        self._learn(new)
        known.update((w, known[w[:-1]] + self.tails[w[-1]]) for w in tailed)
        return list(map(known.__getitem__, words))

    def of(self, words: list[str]) -> list[bytes | None]:
        """The ids of distinct words, each with the space before it, as bytes of ``dtype``; None for what must not be cut from its text."""
        return self._known(words)

    def forget(self) -> None:
        """Frees the words, at the end of a task: the worker may have other work next."""
        self.known, self.before, self.failed = {}, {}, set()
        release()

    def ids(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text (none of them null), and whether all its words passed the check."""
        out, fine = [], []
        for part in slices(texts):
            found = self._part(part)
            out += found[0]
            fine += found[1]
        pa.default_memory_pool().release_unused()
        return out, fine

    def _part(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bool]]:
        split = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(split.flatten())
        offsets = np.asarray(split.offsets, dtype="i8")
        offsets = offsets - offsets[0]
        words, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype("i8")
        heads = offsets[:-1]
        if self.prefix:
            first = []
            used = np.ones(len(words), dtype=bool)
        else:  # a text's first word has no space before it: a word of its own, not to be learnt with the others
            first = [words[i] for i in number[heads].tolist()]
            number[heads] = len(words) + np.arange(len(texts))
            used = np.zeros(len(words) + len(texts), dtype=bool)
            used[number] = True
            used = used[: len(words)]
        places = np.flatnonzero(used).tolist()
        values: list[bytes | None] = [b""] * len(words)
        for i, value in zip(places, self._known([words[i] for i in places])):
            values[i] = value
        if first:
            values += [None if head[-1:].isspace() or not head and n > 1 else self._bytes(ids) for head, n, ids in zip(first, np.diff(offsets).tolist(), self.encode(first))]
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        odd = np.zeros(len(texts), dtype=bool)
        odd[owner[np.array([v is None for v in values])[number]]] = True
        flat = np.frombuffer(b"".join([v or b"" for v in values]), self.dtype)
        sizes = np.array([len(v or b"") for v in values]) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        long = sizes[number]
        ends = np.cumsum(long)
        ids = flat[np.repeat(starts[number] - ends + long, long) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.r_[0, ends][offsets]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        fine = np.ones(len(texts), dtype=bool)
        if self.failed:
            fine[owner[np.array([w in self.failed for w in words] + [False] * len(first))[number]]] = False
        whole = np.flatnonzero(odd).tolist()
        if whole:
            entire = [texts[i].as_py() for i in whole]
            for i, text, found in zip(whole, entire, self.encode(entire)):
                out[i] = np.array(found, dtype=self.dtype)
                if self.check:
                    fine[i] = self.check([text], [out[i].tobytes()])[0]
        return out, fine.tolist()
