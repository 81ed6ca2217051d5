"""Tokenizer front end: ids of whole texts, with each distinct piece of text encoded once per worker.

Both vocabularies split a text at white space before any merge is applied, so a text's ids are the
ids of its pieces in order.  Pieces repeat (Zipf's law), so a bounded cache saves most of the work.
Pieces that are a word of Latin letters, with ASCII punctuation behind it at most, need none of the
library's normalizing and pattern matching: many of them are merged by its model in one call.  All other
pieces go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in each of a worker's two cache generations; a full one becomes the old one, which changes no result.
CACHE_PIECES = 600_000
#: Words merged in one call.
_CALL = 256

_SPACED = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: What keeps a text from being words with single spaces or line feeds between them (for Arrow, whose \\s knows ASCII only).
_UNEVEN = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORD = re.compile(r"(\0\n?|)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


_MAPPED = {b: c for b, c in enumerate(byte_characters())}
#: Words one a line are mapped at once.
_IN_LINES = {b: c for b, c in _MAPPED.items() if b != 10}


class PieceEncoder:
    """``encode_many(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    ``white_space_dropped``: the vocabulary lowers its text and drops white space, so ASCII white space separates
    pieces.  Otherwise a piece begins at a single space or line feed between two non-space characters, where
    the byte-level pattern always begins a new match.
    ``special_as_text``: strings of special tokens inside a text are ordinary text; else they get their ids, as the
    library does by itself.
    """

    def __init__(self, path: str, white_space_dropped: bool, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.dropped = white_space_dropped
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(suffix))
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _merged(self, keys: list, before: str) -> dict:
        """Ids of pieces that are a word of Latin letters, ``before`` being a space or nothing before each of them."""
        out: dict = {}
        for i in range(0, len(keys), _CALL):
            part = keys[i : i + _CALL]
            plain = (before + ("\n" + before).join(part)).encode().decode("latin-1")
            plain = plain.replace(" ", _MAPPED[32]) if plain.isascii() else plain.translate(_IN_LINES)
            ids = np.array(self.merger.encode_batch_fast([plain], add_special_tokens=False)[0].ids, dtype="<u4")
            end = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w) for w in plain.split("\n")])) + 1
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, (4 * end).tolist(), strict=True):
                out[w] = raw[at:e]
                at = e
        return out

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list) -> dict:
        """Ids of pieces that are in no cache, and of the words in them, which are pieces too."""
        new: dict = {}
        parts, odd, wanted = [], [], set()
        cache, old, dropped, match = self.cache, self.old, self.dropped, _WORD.fullmatch
        for p in pieces:
            m = match(p)
            if m is None or dropped and p[0] == "\0":
                odd.append(p)
                continue
            before, word, after = m.groups()
            key = word.lower() if dropped else "\0" + word if before else word
            if key in cache:
                new[key] = cache[key]
            elif key in old:
                new[key] = old[key]
            else:
                wanted.add(key)
            if key != p:
                parts.append((p, before[1:], key, after))
        if dropped:
            new |= self._merged(list(wanted), "")
        else:
            new |= self._merged([w for w in wanted if w[0] != "\0"], " ")
            bare = [w[1:] for w in wanted if w[0] == "\0"]
            new |= {"\0" + w: ids for w, ids in self._merged(bare, "").items()}
        marks = {x for _, a, _, b in parts for x in (a, b) if x}
        mark = dict(zip(marks, self._whole(list(marks)), strict=True)) | {"": b""}
        for p, before, key, after in parts:
            new[p] = mark[before] + new[key] + mark[after]
        for k in range(0, len(odd), 4096):
            part = odd[k : k + 4096]
            new.update(zip(part, self._whole([self._text(p) for p in part]), strict=True))
        return new

    def _text(self, piece: str) -> str:
        if self.dropped:
            return piece
        return piece[1:] if piece[0] == "\0" else " " + piece

    def _lowered(self, text: str) -> str:
        """``text`` in lower case, which makes fewer pieces; as it is where a mark may combine with a letter or a special token would appear."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(t in low for t in self.special) else low

    def _pieces(self, texts: list[str | None]) -> pa.Array:
        """A list of pieces for each text; an empty piece has no ids.

        Where white space counts, a piece stands for one after a space, or with ``\\0`` before it for itself.
        """
        if self.dropped:
            return pc.ascii_split_whitespace(pa.array([self._lowered(t) if t else "" for t in texts], pa.large_string()))
        uneven = pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNEVEN).to_pylist()
        even = ["" if odd or not t else "\0" + t.replace("\n", " \0\n") for t, odd in zip(texts, uneven, strict=True)]
        lists = pc.split_pattern(pa.array(even, pa.large_string()), " ")
        if all(e or not t for e, t in zip(even, texts, strict=True)):
            return lists
        # what is not between single spaces or line feeds is cut by pattern; pieces after a space lose it
        cut = [None if e or not t else [p[1:] if k and p[0] == " " else "\0" + p for k, p in enumerate([t] if "\0" in t else _SPACED.split(t))] for e, t in zip(even, texts, strict=True)]
        return pc.coalesce(pa.array(cut, lists.type), lists)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        lists = self._pieces(texts)
        pieces = lists.flatten().dictionary_encode()
        if len(self.cache) > CACHE_PIECES:
            self.old, self.cache = self.cache, {"": b""}
        cache, old = self.cache, self.old
        names, missing = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), []
        for p in names:
            if p not in cache:
                if p in old:
                    cache[p] = old[p]
                else:
                    missing.append(p)
        for i in range(0, len(missing), 20_000):
            cache.update(self._learn(missing[i : i + 20_000]))
        ids = pa.array([cache[p] for p in names], pa.large_binary()).take(pieces.indices)
        if not len(ids):
            return [b""] * len(texts)
        _, ends, raw = ids.buffers()
        edge = np.frombuffer(ends, np.int64)[ids.offset :][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        raw = memoryview(raw) if raw else b""
        return [bytes(raw[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, white_space_dropped: bool) -> PieceEncoder:
    """The worker's encoder for this vocabulary; it outlives tasks when workers are reused."""
    key = (path, white_space_dropped)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def text_groups(texts: list[str | None], chars: int = 2_000_000):
    """Index ranges of about ``chars`` characters, so that a batch's pieces are never all in memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
