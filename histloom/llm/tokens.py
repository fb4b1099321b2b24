"""Token ids of whole documents by a public tokenizer file, with words' ids remembered."""

from __future__ import annotations

import os
import re
import sys
from struct import pack
from types import ModuleType

import numpy as np
from tokenizers import Tokenizer

from histloom.llm.common import by_value

by_value(__name__)

END_ID = 1
# Words whose ids a worker remembers. Only speed depends on it.
_REMEMBERED = 400_000
# Words of a text that are looked up at a time; fewer than are remembered.
_PART = 100_000

# How the tokenizer cuts text into words, for Latin letters in lower case. There its
# normal form is the text itself; letters, digits and signs never share a word.
_LETTERS = "a-zªµºß-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_WORDS = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|[^\\t\\n\\r {_LETTERS}{_NUMBERS}]+")
# Whatever might be cut or lower-cased in another way: control characters, contractions, capital
# I with dot, anything beyond Latin.
_UNSAFE = re.compile("[^\\t\\n\\r -&(-~¡-įı-ɏ]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies are written in."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False).ids`` plus END_ID.

    The tokenizer encodes word by word, so the ids of a text are those of its words, which repeat
    and are looked up. Texts whose words are not plain to see are cut at spaces only.
    """

    def __init__(self, path: str):
        # Spark runs one task per core; the library's own threads would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens are cut out of a text before anything else is done to it.
        added = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._added = {text: i.to_bytes(4, "little") for text, i in added.items()}
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self._cut = re.compile(f"({'|'.join(longest)})") if added else None
        self._seen: dict[str, bytes] = {}
        self._letters = _byte_letters()

    def _encoded(self, words: list[str], plain: bool) -> list[list[int]]:
        if not plain:
            found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
            return [encoding.ids for encoding in found]
        # Already a word in normal form: only the vocabulary's merges are left to do.
        merge, letters = self._tokenizer.model.tokenize, self._letters
        forms = (w.encode("utf-8").decode("latin-1").translate(letters) for w in words)
        return [[token.id for token in merge(form)] for form in forms]

    def _learn(self, words: set[str], plain: bool) -> None:
        new = [w for w in words if w not in self._seen]
        if len(self._seen) + len(new) > _REMEMBERED:
            self._seen.clear()
            new = list(words)
        for word, ids in zip(new, self._encoded(new, plain), strict=True):
            self._seen[word] = pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> list[bytes]:
        """Ids of a text without added tokens."""
        plain = not _UNSAFE.search(text)
        words = _WORDS.findall(text.lower()) if plain else text.replace("\n", " ").split(" ")
        parts = []
        for at in range(0, len(words), _PART):
            some = words[at : at + _PART]
            try:
                parts.append(b"".join(map(self._seen.__getitem__, some)))
            except KeyError:
                self._learn(set(some), plain)
                parts.append(b"".join(map(self._seen.__getitem__, some)))
        return parts

    def ids(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text, END_ID last; null is the empty text."""
        text = text or ""
        parts = []
        pieces = self._cut.split(text) if self._cut and self._cut.search(text) else [text]
        for n, piece in enumerate(pieces):
            parts += [self._added[piece]] if n % 2 else self._plain(piece)
        parts.append(END_ID.to_bytes(4, "little"))
        return np.frombuffer(b"".join(parts), dtype="<u4")


def encoder(path: str) -> Encoder:
    """The worker process's encoder of this file: what one task learnt serves the next."""
    home = sys.modules.setdefault("histloom_worker", ModuleType("histloom_worker"))
    held = vars(home).setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
