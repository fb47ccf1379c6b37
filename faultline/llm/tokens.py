"""Token ids of whole texts with a public tokenizer; words are encoded once per worker."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 300_000
CHUNK_BYTES = 4 << 20
#: A space before white space or at the end: fixed list of the white space characters of Unicode.
_UNSAFE = r" (?:[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|$)"
#: Punctuation that never joins the letters before it; an apostrophe may.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes texts exactly as the library does, with a table of pieces already seen.

    A byte-level vocabulary starts a new unit at every space that a visible
    character follows, so the text is cut there and each distinct piece is
    encoded by the library once; a text with another kind of space run is
    encoded whole.  The table, which holds words with and without the marks
    after them, is dropped when it has ``CACHE_PIECES`` entries; this bounds
    memory and never changes an id.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        codes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(codes)]
        self.printable = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}  # a piece that follows a space is its own key, one at a start has a space before it
        self.marks: dict[str, list[int]] = {}
        self.ids, self.bounds, self.n = array("I"), array("q", [0]), 0

    def _add(self, key: str, ids: list[int]) -> None:
        self.ids.extend(ids)
        self.bounds.append(len(self.ids))
        self.index[key] = self.n
        self.n += 1

    def _encode(self, text: str) -> list[int]:
        """One piece: a space and letters are a single unit of the vocabulary's model, and so is punctuation after them."""
        core = text.rstrip(_MARKS)
        word, key = (core[1:], core[1:]) if core[:1] == " " else (core, " " + core)
        if not word.isalpha():
            left, line, right = text.partition("\n")
            if line and left and right and not left[-1].isspace() and not right[0].isspace():
                return self._encode(left) + self._punctuation("\n") + self._encode(right)
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        at = self.index.get(key)
        if at is not None:
            ids = self.ids[self.bounds[at] : self.bounds[at + 1]].tolist()
        else:
            if core.isascii():
                shown = core.replace(" ", "\u0120")
            else:
                shown = core.encode().decode("latin-1").translate(self.printable)
            ids = [t.id for t in self.model.tokenize(shown)]
            self._add(key, ids)
        return ids + self._punctuation(text[len(core) :]) if len(core) < len(text) else ids

    def _punctuation(self, text: str) -> list[int]:
        if text not in self.marks:
            self.marks[text] = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.marks[text]

    def _places(self, pieces: list[str], lead: str) -> np.ndarray:
        """Table places of distinct pieces that follow ``lead`` (a space, or nothing at the start of a text)."""
        mark = "" if lead else " "
        get = self.index.get
        at = list(map(get, pieces)) if lead else [get(mark + p) for p in pieces]
        for k, found in enumerate(at):
            if found is None:
                key = mark + pieces[k]
                ids = self._encode(lead + pieces[k])
                if key not in self.index:  # a word is added with its first piece
                    self._add(key, ids)
                at[k] = self.index[key]
        return np.array(at, np.int64)

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids as unsigned 32-bit integers and the bounds of each text (null: empty), ``end_id`` after each."""
        if self.n > CACHE_PIECES:
            self.reset()
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
        lists = pc.split_pattern(pc.if_else(pa.array(unsafe), "", texts) if unsafe.any() else texts, " ")
        offsets = np.asarray(lists.offsets)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        first = offsets[:-1]
        codes = np.asarray(flat.indices).astype(np.int64)
        words = flat.dictionary.to_pylist()
        place = self._places(words, " ")[codes]
        heads, back = np.unique(codes[first], return_inverse=True)
        place[first] = self._places([words[c] for c in heads], "")[back]
        ids, bounds = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), np.frombuffer(self.bounds, np.int64)
        size = bounds[place + 1] - bounds[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(upto[-1]) + np.repeat(bounds[place] - upto[:-1], size)
        out, cuts = ids[where], upto[offsets]
        ids = bounds = None
        if unsafe.any() or end_id is not None:
            whole = {int(d): np.array(self.tokenizer.encode(texts[int(d)].as_py(), add_special_tokens=False).ids, np.uint32) for d in np.flatnonzero(unsafe)}
            end = np.array([] if end_id is None else [end_id], np.uint32)
            if whole:
                out = np.concatenate([p for d in range(n) for p in (whole.get(d, out[cuts[d] : cuts[d + 1]]), end)])
                sizes = np.diff(cuts) + len(end)
                for d, x in whole.items():
                    sizes[d] = len(x) + len(end)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
            else:
                out = np.insert(out, cuts[1:], end_id).astype(np.uint32)
                cuts = cuts + np.arange(n + 1)
        return out, cuts


def text_slices(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, slice) of some ``limit`` bytes, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    row, done = 0, 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield row, texts.slice(row, to - row)
        row, done = to, int(size[to - 1])


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for this vocabulary file, made at first use."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
