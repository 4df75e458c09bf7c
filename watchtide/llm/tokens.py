"""Token ids of whole texts by a tokenizer file, word by word with a bounded cache."""

from __future__ import annotations

import re
import struct

#: Words of a cache generation; two generations are kept.
CACHE_WORDS = 300_000


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_words(path: str) -> bool:
    """Whether a tokenizer file's ids of a text are those of its lower-cased words, parted by white space: what WordIds needs."""
    import json

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = [told.get("normalizer") or {}, *(told.get("normalizer") or {}).get("normalizers", [])]
    parts = [told.get("pre_tokenizer") or {}, *(told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return any(s.get("type") == "Lowercase" or s.get("lowercase") for s in steps) and any(x.get("type") in ("Whitespace", "WhitespaceSplit", "Split") for x in parts)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte: itself if printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes, for tokenizers that drop white space and lower-case.

    Such a tokenizer's ids of a text are those of its space-separated words, one after another. Plain lower-case
    words go straight to the tokenizer's BPE model; anything else through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._plain(word)
            if found is None and word[-1:] in (".", ",") and word[:-1].isalpha() and (head := self._plain(word[:-1])) is not None:
                found = head + self[word[-1]]
            if found is None:
                ids = self.whole.encode(word, add_special_tokens=False).ids
                found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found

    def _plain(self, word: str) -> bytes | None:
        if not word.isalpha() or word != word.lower() or max(word) > "\xff":
            return None
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none)."""
        if not text:
            return b""
        if "<|" not in text:  # marks of special tokens are case-sensitive
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        for space in "\n\t\r":
            text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's encoder; kept between tasks."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]


def space_parted(path: str) -> bool:
    """Whether a tokenizer file parts texts where white space follows something else, whatever stands around: what SpaceCounts needs."""
    import json

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    alike = {k: (told.get("pre_tokenizer") or {}).get(k) for k in plain} == plain
    return alike and not told.get("normalizer") and not told.get("truncation") and not told.get("padding") and all(t.get("special") for t in told.get("added_tokens") or [])


class SpaceCounts(dict):
    """White space with the word after it -> its number of tokens, for tokenizers that space_parted knows.

    Byte-level BPE's pattern has no token that goes on from a word into white space, so a text's tokens are those of its
    white spaces and words, one after another. White space is Unicode's, without the four separators that Python adds.
    """

    PARTS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
    #: A line's end or none, a space or none with letters, and marks after them: the pattern takes each as one piece. An apostrophe is no such mark, as it may begin an ending.
    PLAIN = re.compile(r"(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?)\]\"#$%&*|-]*)")
    #: Longer parts are counted, but not kept.
    LONGEST = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.tokenize, self.letters = self.whole.model.tokenize, _byte_letters()
        self.old: dict[str, int] = {}

    def __missing__(self, part: str) -> int:
        found = self.old.get(part)
        if found is None and (plain := self.PLAIN.fullmatch(part)):
            line, word, marks = plain.groups()
            if line or marks:
                found = (self[line] if line else 0) + self[word] + (self[marks] if marks else 0)
            else:
                found = len(self.tokenize(word.encode().decode("latin-1").translate(self.letters)))
        if found is None:
            found = len(self.whole.encode(part, add_special_tokens=False))
        if len(part) <= self.LONGEST:
            self[part] = found
        return found

    def text(self, text: str | None) -> int:
        """Tokens of a whole text (null: none)."""
        if not text:
            return 0
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        return sum(map(self.__getitem__, self.PARTS.findall(text)))


_counts: dict[str, SpaceCounts] = {}


def space_counts(path: str) -> SpaceCounts:
    """This worker's counter; kept between tasks."""
    if path not in _counts:
        _counts[path] = SpaceCounts(path)
    return _counts[path]
