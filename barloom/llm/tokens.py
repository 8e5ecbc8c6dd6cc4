"""Token ids of texts by a public tokenizer file, with a bounded cache by white-space word.

The tokenizer normalises and splits inside runs of non-space characters only, so a text's ids are the
concatenation of its words' ids. Words are cut at ASCII white space on the UTF-8 bytes; ids are kept
as little-endian unsigned 32-bit bytes. Unknown words go to the library in large joined batches. Those of Latin
letters come to its merges alone: composition leaves such letters as they are, and lower-casing goes letter by letter.
"""

from __future__ import annotations

import codecs
import json
import operator
import os
import re
from itertools import compress, repeat

import numpy as np

#: Words in each of the two generations of the cache, and bytes of text split at once.
CACHE_WORDS = 250_000
SPLIT_BYTES = 1 << 21
JOINED = 2_000
#: ASCII punctuation but the apostrophe, which may begin a contraction.
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Letters below U+0180, but the dotted capital I, whose lower case has a mark.
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: Bytes as the characters that stand for them in byte-level vocabularies; a space stays.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTES = "".join(" " if b == 32 else chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
#: How a file must normalise and split for its merges to be used alone.
_NORMALISED = ["NFC", "Replace", "Lowercase"]
_SPLIT = [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}), ("ByteLevel", None)]

_open: dict[str, "WordIds"] = {}


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.merges = self._merges()

    def _merges(self):
        """The tokenizer of lower-cased words in byte-level characters, parted by spaces; None where the file works otherwise."""
        from tokenizers import Tokenizer

        spec = json.loads(self.tokenizer.to_str())
        before, cut = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        normalised = [x["type"] for x in before.get("normalizers", [])]
        split = [(x["type"], x.get("pattern")) for x in cut.get("pretokenizers", [])]
        if normalised != _NORMALISED or split != _SPLIT or cut["pretokenizers"][1]["add_prefix_space"] or any(a["content"].isalpha() for a in spec["added_tokens"]):
            return None
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, words: list[str], latin: bool) -> dict[str, bytes]:
        """Ids of words of letters only: each ends with the one token that ends a word."""
        found: dict[str, bytes] = {}
        chunks = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        texts = [" ".join(c) for c in chunks]
        if latin:
            texts = [t if t.isascii() else codecs.charmap_decode(t.encode(), "strict", _BYTES)[0] for t in texts]
        for chunk, got in zip(chunks, (self.merges if latin else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(chunk) or (len(ids) and ends[-1] != len(ids)):
                found.update((w, self._alone(w)) for w in chunk)
                continue
            ends = (4 * ends).tolist()
            found.update(zip(chunk, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends)), strict=False))
        return found

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """A word of letters and then punctuation is two runs to the tokenizer, else it goes alone."""
        strings = b" ".join(words).decode("utf-8").split(" ") if words else []
        cores: list[str | None] = list(map(str.rstrip, strings, repeat(_TAIL)))
        found: dict[bytes, bytes] = {}
        have: dict[str, bytes | None] = {"": b""}
        tails: dict[str, bytes] = {"": b""}
        unknown: tuple[list[str], list[str]] = ([], [])
        for i, (core, s) in enumerate(zip(cores, strings, strict=True)):
            latin = self.merges is not None and (core.isascii() or _LATIN(core) is not None)
            lower = core.lower()
            # lower-casing may leave a mark that is no letter
            if (core and not (core.isalpha() and lower.isalpha())) or (len(core) < len(s) and "<|" in s):
                found[words[i]], cores[i] = self._alone(s), None
                continue
            if latin:
                cores[i] = core = lower
            if core not in have:
                # the words themselves are not known
                have[core] = ids = None if core == s else self._known(core.encode())
                if ids is None:
                    unknown[latin].append(core)
        for latin, some in enumerate(unknown):
            have.update(self._letters(some, bool(latin)) if some else {})
        for w, s, core in zip(words, strings, cores, strict=True):
            if core is not None:
                tail = s[len(core) :]
                if tail not in tails:
                    tails[tail] = self._alone(tail)
                found[w] = have[core] + tails[tail] if tail else have[core]
        return found

    def _known(self, word: bytes) -> bytes | None:
        ids = self.young.get(word)
        return self.old.get(word) if ids is None else ids

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes; null is empty."""
        out: list[bytes] = []
        part, size = [], 0
        for t in texts:
            part.append(t or b"")
            size += len(part[-1])
            if size > SPLIT_BYTES:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        got = [list(map(self.young.get, words)) for words in split]
        fresh: set[bytes] = set()
        for words, ids in zip(split, got, strict=True):
            fresh.update(compress(words, map(operator.is_, ids, repeat(None))))
        again = {w: self.old[w] for w in fresh if w in self.old}
        if len(self.young) + len(fresh) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young.update(again)
        self.young.update(self._learn([w for w in fresh if w not in again]))
        now = self.young
        return [b"".join([now[w] if x is None else x for w, x in zip(words, ids, strict=True)]) for words, ids in zip(split, got, strict=True)]


def word_ids(path: str) -> WordIds:
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]
