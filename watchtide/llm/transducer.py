"""BPE encoding and decoding as streaming transducers of constant memory.

Encoding: how far a text's continuation can reach back is computed from the merge list (`sufficient_lookahead`). A
window of symbols is merged, tokens that end further than that from the window's end are stable and emitted, the rest
waits for more symbols. Whatever the length of a word, no more than a window of it is held. Decoding: ids pass through
a state machine that holds at most one unfinished character.

The tokenizer file is a merge list over bytes, with a mark at word ends, after NFC, lower case and a pattern of words.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from watchtide.llm.common import slices
from watchtide.llm.tokens import _byte_letters, default_path

#: Characters of a text that are looked at together; symbols of a word that are merged together besides the lookahead.
BLOCK, WINDOW = 1 << 16, 4096
#: Symbols of a short word.
SHORT = 64
#: Pieces between white space that a worker remembers the ids of, in each of two generations.
CACHE = 400_000
#: White space to Python's str.split, but not to the tokenizer's pattern.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: How the supported files write words (fixed values of the file format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]


def _newer(path: str) -> tuple[str, dict[int, str]]:
    """What the library's Unicode tables say of characters that Python's don't know: those that aren't letters or numbers to it, and lower cases."""
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) if unicodedata.category(c) == "Cn"]
    other = [c for c in newer if len(library.pre_tokenizer.pre_tokenize_str(f"!{c}")) == 1]
    return "".join(other), {ord(c): low for c in newer if (low := library.normalizer.normalize_str(c)) != c}


def _ranges(characters: str) -> str:
    """A pattern's set of sorted characters."""
    ranges: list[list[int]] = []
    for c in map(ord, characters):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a token's end that settle it, whatever follows; length(token): its symbols.

    Two texts that agree up to a border are merged in step, rank by rank. The place from which their tokens differ
    moves back over token u only by a merge (u, v) where v begins at that place, so v has the token swallowed before
    on its left edge, and by one merge of each rank. The longest such chain of growing ranks is the reach. One symbol
    more, as the last one has another form at a word's end. A list in which a merge's parts are not made before it, or
    that makes a token in two ways, is refused: there merges don't come in the order of ranks.
    """
    left: dict[str, str] = {}
    reach: dict[str, int] = {}
    for u, v in merges:
        if any(length(x) > 1 and x not in left for x in (u, v)) or u + v in left:
            raise ValueError("the merge list is not in the order of its tokens")
        at, most = v, reach.get(v, 0)
        while at in left:
            at = left[at]
            most = max(most, reach.get(at, 0))
        reach[u] = max(reach.get(u, 0), length(u) + most)
        left[u + v] = u
    return 1 + max(reach.values(), default=0)


class BPE:
    """A tokenizer file's vocabulary, merges and lookahead. Files of another kind are refused with ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.vocab, model = told["model"]["vocab"], told["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = (told.get("normalizer") or {}).get("normalizers", [])
        self.encodes = bool(
            [n.get("type") for n in normal] == NORMAL and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": WORDS} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        )
        self.joined = told.get("decoder") is None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(self.end)) if self.end else len(t))
        self.ranks = {(self.vocab[u], self.vocab[v]): rank for rank, (u, v) in enumerate(merges)}
        self.made = [self.vocab[u + v] for u, v in merges]
        letters = _byte_letters()
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.end] for b in range(256)]
        names = [(i, t) for t, i in self.vocab.items()] + [(i, t) for t, i in self.special.items()]
        self.names = [""] * (max(i for i, _ in names) + 1)
        self.bytes: list[bytes] = [b""] * len(self.names)
        back = {c: b for b, c in letters.items()}
        for i, t in names:
            self.names[i] = t
            word = t.removesuffix(self.end) if self.end else t
            self.bytes[i] = t.encode() if t in self.special else bytes(back[c] for c in word) + b" " * (word != t)

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of symbols: the pair of least rank, leftmost first, is merged until none is left. A window's pairs wait in a heap."""
        if len(symbols) <= SHORT:
            return self._merge_short(symbols)
        n, rank_of = len(symbols), self.ranks.get
        after, before, own = [*range(1, n + 1)], [*range(-1, n - 1)], list(symbols)
        heap = [(rank, i) for i in range(n - 1) if (rank := rank_of((own[i], own[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if own[i] < 0 or j >= n or rank_of((own[i], own[j])) != rank:
                continue
            own[i], own[j], after[i] = self.made[rank], -1, after[j]
            if (j := after[j]) < n:
                before[j] = i
                if (rank := rank_of((own[i], own[j]))) is not None:
                    heapq.heappush(heap, (rank, i))
            if (k := before[i]) >= 0 and (rank := rank_of((own[k], own[i]))) is not None:
                heapq.heappush(heap, (rank, k))
        return [t for t in own if t >= 0]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        own, rank_of, never = list(symbols), self.ranks.get, len(self.made)
        ranks = [rank_of(pair, never) for pair in zip(own, own[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            own[i : i + 2] = (self.made[best],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((own[i], own[i + 1]), never)
            if i:
                ranks[i - 1] = rank_of((own[i - 1], own[i]), never)
        return own

    def word(self, symbols: bytes) -> bytes:
        """The ids of a whole short word, given by its bytes."""
        return _little(array("I", self.merge([*map(self.inner.__getitem__, symbols[:-1]), self.last[symbols[-1]]])))


class Run:
    """One word, fed piece by piece: tokens are emitted as soon as nothing that follows can change them."""

    def __init__(self, bpe: BPE, sizes: list[int]):
        self.bpe, self.sizes, self.held = bpe, sizes, []

    def feed(self, piece: str) -> Iterator[bytes]:
        inner = self.bpe.inner
        for at in range(0, len(piece), WINDOW):
            self.held += map(inner.__getitem__, piece[at : at + WINDOW].encode())
            if len(self.held) >= self.bpe.lookahead + WINDOW:
                yield self._emit(self.bpe.merge(self.held))

    def _emit(self, tokens: list[int]) -> bytes:
        settled, at, out = len(self.held) - self.bpe.lookahead, 0, array("I")
        for t in tokens:
            if at + self.sizes[t] > settled:
                break
            at += self.sizes[t]
            out.append(t)
        del self.held[:at]
        return _little(out)

    def finish(self) -> bytes:
        if not self.held:
            return b""
        last = self.bpe.inner.index(self.held[-1])
        return _little(array("I", self.bpe.merge([*self.held[:-1], self.bpe.last[last]])))


def _little(ids: array) -> bytes:
    if array("I", [1]).tobytes()[0] != 1:
        ids.byteswap()
    return ids.tobytes()


class Encoder:
    """Encodes texts; ids come as bytes, little-endian unsigned 32-bit. Remembers the ids of pieces between white space."""

    def __init__(self, path: str):
        import regex

        bpe = BPE(path)
        if not bpe.encodes:
            raise ValueError("a tokenizer file of another kind")
        self.bpe = bpe
        other, self.lower = _newer(path)
        self.newer = re.compile(f"[{chr(min(self.lower))}-\U0010ffff]") if self.lower else None
        letter, number = (rf"[\p{{{c}}}--{_ranges(other)}]" if other else rf"\p{{{c}}}" for c in "LN")
        self.words = regex.compile(WORDS.replace(r"\p{L}", letter).replace(r"\p{N}", number), regex.V1)
        self.runs = regex.compile(f"[{letter}]*", regex.V1), regex.compile(rf"[^\s{letter}{number}]*", regex.V1)
        self.specials = re.compile("|".join(map(re.escape, sorted(bpe.special, key=len, reverse=True))) or r"(?!)")
        self.sizes = [len(b) - (bpe.names[i] not in bpe.special and bool(bpe.end) and bpe.names[i].endswith(bpe.end)) for i, b in enumerate(bpe.bytes)]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def text(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, a block after another; marks of special tokens are such tokens."""
        at = 0
        for mark in self.specials.finditer(text):
            yield from self.stream(_blocks(text, at, mark.start()))
            yield _little(array("I", [self.bpe.special[mark[0]]]))
            at = mark.end()
        yield from self.stream(_blocks(text, at, len(text)))

    def stream(self, blocks: Iterator[str]) -> Iterator[bytes]:
        """The ids of a text that comes in blocks, cut where NFC allows."""
        open_, run, kind = "", None, None
        for block in blocks:
            block = self.normal(block)
            if run is not None:
                head = kind.match(block)[0]
                yield from run.feed(head)
                block = block[len(head) :]
                if not block:
                    continue
                yield run.finish()
                run = None
            block, open_ = open_ + block, ""
            last = self._tail(block)
            if last < len(block):  # the last word may go on
                block, open_ = block[:last], block[last:]
            yield self._pieces(block)
            if len(open_) > WINDOW:
                kind = next((k for k in self.runs if k.fullmatch(open_)), None)
                if kind is None:  # several words without white space between them: all but the last are whole
                    *_, word = self.words.finditer(open_)
                    yield self._pieces(open_[: word.start()])
                    open_ = word[0]
                    kind = next((k for k in self.runs if k.fullmatch(open_)), None)
                if kind is not None and len(open_) > WINDOW:
                    run, waiting, open_ = Run(self.bpe, self.sizes), open_, ""
                    yield from run.feed(waiting)
        yield run.finish() if run is not None else self._pieces(open_)

    def normal(self, block: str) -> str:
        """NFC and lower case, a character at a time: a sigma has one lower case wherever it stands."""
        block = unicodedata.normalize("NFC", block)
        if not block.isascii() and self.newer and self.newer.search(block):
            block = block.translate(self.lower)
        return block.replace("Σ", "σ").lower()

    def _tail(self, block: str) -> int:
        """Where the piece after the last white space begins."""
        at = len(block)
        while at and (not block[at - 1].isspace() or block[at - 1] in SEPARATORS):
            at -= 1
        return at

    def _pieces(self, block: str) -> bytes:
        if any(c in block for c in SEPARATORS):
            return b"".join(map(self._word, self.words.findall(block)))
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        pieces = block.split()
        found = [*map(self.known.get, pieces)]
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._piece(pieces[i])
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        """The ids of what stands between white space, remembered if short, as is a word before a stop or comma."""
        ids = self.known.get(piece) or self.old.get(piece)
        if ids is None:
            word = piece[:-1] if piece[-1] in ".,;:" else piece
            if not word.isalpha():
                ids = b"".join(map(self._word, self.words.findall(piece)))
            else:
                ids = self._word(piece) if word is piece else self._piece(word) + self._word(piece[-1])
        if len(piece) <= SHORT:
            self.known[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if len(word) <= SHORT:
            return self.bpe.word(word.encode())
        run = Run(self.bpe, self.sizes)
        return b"".join([*run.feed(word), run.finish()])


def _blocks(text: str, start: int, end: int) -> Iterator[str]:
    """text[start:end] in blocks, cut where normalising the parts is normalising the whole; a longer run of marks stays in one."""
    while end - start > BLOCK:
        at = start + BLOCK
        while at < end and not _apart(text, at):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:end]


def _apart(text: str, at: int) -> bool:
    a, b = text[at - 1], text[at]
    return b < "\x80" or not unicodedata.combining(b) and unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)


class Decoder:
    """Ids to text, fed in pieces. Joined: the file has no decoder, so names of tokens are parted by spaces, as the library does.

    Otherwise ids are bytes and word ends; a character comes once its last byte has, and bytes that are none become
    replacement characters. An id that the file doesn't have raises IndexError, as far as joined an empty name.
    """

    def __init__(self, bpe: BPE, joined: bool):
        self.bpe, self.joined = bpe, joined
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: bytes) -> str:
        found = array("I")
        found.frombytes(ids)
        if not found:
            return ""
        if self.joined:
            said = " ".join(map(self.bpe.names.__getitem__, found))
            begun, self.begun = self.begun, True
            return f" {said}" if begun else said
        return self.state.decode(b"".join(map(self.bpe.bytes.__getitem__, found)))

    def finish(self) -> str:
        return "" if self.joined else self.state.decode(b"", True)


_open: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """This worker's encoder; kept between tasks."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids): a whole text's ids as little-endian unsigned 32-bit bytes. A null text is empty; every row has its own, repeated ones too; other columns are ignored."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in slices(batches, 1):
            ids = pa.array([b"".join(encoder.text(t or "")) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return own.mapInArrow(run, f"key {dict(own.dtypes)['key']}, ids binary").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids", joined: bool = False) -> DataFrame:
    """Rows (key, text) of ids as `encode` gives them: readable text, or as the library joins it. Null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path).bpe
        for batch in slices(batches, None):
            out = []
            for own in batch.column(1).to_pylist():
                machine = Decoder(bpe, joined)
                out.append(machine.feed(own or b"") + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    own = rows.select(rows[key].alias("key"), rows[ids].alias("ids"))
    return own.mapInArrow(run, f"key {dict(own.dtypes)['key']}, text string").withColumnRenamed("key", key)


def round_trips(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): both machines coupled, so that neither ids nor decoded text of a document are held whole. Rows as `encode` says."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in slices(batches, 1):
            rows = []
            for own in batch.column(1):
                machine, n, ids, said = Decoder(encoder.bpe, encoder.bpe.joined), 0, hashlib.sha256(), hashlib.sha256()
                for piece in encoder.text(own.as_py() or ""):
                    n += len(piece) // 4
                    ids.update(piece)
                    said.update(machine.feed(piece).encode())
                said.update(machine.finish().encode())
                rows.append((n, ids.hexdigest(), said.hexdigest()))
            n, ids, said = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(said)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return own.mapInArrow(run, f"key {dict(own.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
