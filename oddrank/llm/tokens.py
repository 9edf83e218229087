"""Token ids of whole texts by the tokenizers library, a portion of texts at a time.

The byte-level tokenizer splits a text by its pattern before it merges bytes.
No match of that pattern spans a space followed by a non-space, except that the
space itself leads the match. So a text cut at its single spaces gives the same
ids piece by piece, and pieces repeat: the pieces of a portion are told apart in
Arrow's memory, each distinct one goes through the library's merge model once
and is remembered by the worker for a while, and the ids are put together by a
gather. Texts whose pieces begin or end with other white space, and texts with
one of the tokenizer's added tokens in them, go through the library whole.
"""

from __future__ import annotations

import zlib
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces and their ids that a worker remembers; beyond that it goes on
#: with those of the last portion.
MEMORY_BYTES = 48 << 20
#: Pre-tokens of pieces with other characters than letters that it remembers.
MEMORY_PARTS = 50_000
#: Characters from which a text is encoded in parts.
LONG = 1 << 22

_encoders: dict[str, "PieceEncoder"] = {}


def default_tokenizer() -> str:
    """File of the public byte-level tokenizer with 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "PieceEncoder":
    """The worker's encoder for a tokenizer file; made once per process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level models."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceEncoder:
    """Ids of pieces with the space before them; learns what is missing.

    A piece that can't be cut off from what is around it has null.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        alphabet = _byte_alphabet()
        self.alphabet = "".join(alphabet[b] for b in range(256))
        self.pieces, self.raws = pa.array([], pa.string()), pa.array([], pa.binary())
        self.merged: dict[str, bytes] = {}

    def _learn(self, pre: str) -> bytes:
        word = charmap_decode(pre.encode("utf-8", "surrogatepass"), "strict", self.alphabet)[0]
        return array(self.dtype.char, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _merge(self, pre: str) -> bytes:
        raw = self.merged.get(pre)
        if raw is None:
            if len(self.merged) >= MEMORY_PARTS:
                self.merged.clear()
            raw = self.merged[pre] = self._learn(pre)
        return raw

    def _piece(self, piece: str) -> bytes | None:
        if piece.isalpha():  # letters only: the pattern takes them whole
            return self._learn(" " + piece)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if piece[-1] in ",." and piece[:-1].isalpha():
            return self._learn(" " + piece[:-1]) + self._merge(piece[-1])
        return b"".join(map(self._merge, self.pattern.findall(" " + piece)))

    def _ids_of(self, pieces: pa.Array) -> pa.Array:
        """Ids, as bytes, of different pieces."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(pc.is_null(at))
        learned = pa.array(list(map(self._piece, new.to_pylist())), pa.binary())
        known = pa.concat_arrays([self.raws, learned])
        place = at.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(place), 0, place).astype(np.int64) if at.null_count else place.astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.raws) + np.arange(len(new))
        raws = known.take(pa.array(place))
        self.pieces, self.raws = pa.concat_arrays([self.pieces, new]), known
        if self.pieces.nbytes + self.raws.nbytes > MEMORY_BYTES:
            self.pieces, self.raws = pieces, raws
        return raws

    def _head(self, piece: str) -> bytes | None:
        """Ids of a text's first piece, which no space leads."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return b"".join(map(self._merge, self.pattern.findall(piece)))

    def batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, each text's followed by ``end_id``, and how many each has.

        Null and empty texts have no ids of their own. The ids are in the narrow
        type that the tokenizer's vocabulary allows.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts, whole = [], pc.utf8_length(texts).to_numpy(zero_copy_only=False) > LONG
        ids, sizes = self._short(texts.filter(pa.array(~whole)) if whole.any() else texts, end_id)
        if not whole.any():
            return ids, sizes
        ends, done = np.cumsum(sizes), 0
        all_sizes = np.zeros(len(texts), np.int64)
        for i, long in enumerate(whole.tolist()):
            if long:
                parts.append(self._long(texts[i].as_py(), end_id))
            else:
                parts.append(ids[ends[done] - sizes[done] : ends[done]])
                done += 1
            all_sizes[i] = len(parts[-1])
        return np.concatenate(parts), all_sizes

    def _short(self, texts: pa.Array, end_id: int | None, follows: bool = False) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        lists = pc.split_pattern(texts, " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        coded = flat.dictionary_encode()
        raws = [self._ids_of(coded.dictionary)]
        codes, known = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        if not follows:
            codes[offsets[:-1]] = known + np.arange(n)
            known += n
            raws.append(pa.array(list(map(self._head, flat.take(pa.array(offsets[:-1])).to_pylist())), pa.binary()))
        apart = np.concatenate([r.is_null().to_numpy(zero_copy_only=False) for r in raws])
        library = np.logical_or.reduceat(apart[codes], offsets[:-1])
        for token in self.added:
            library |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        library &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        if end_id is not None:
            codes = np.insert(codes, offsets[1:], known)
            raws.append(pa.array([np.array([end_id], self.dtype).tobytes()], pa.binary()))
            offsets = offsets + np.arange(n + 1)
        taken = pa.concat_arrays(raws).cast(pa.large_binary()).take(pa.array(codes))
        bounds = np.frombuffer(taken.buffers()[1], np.int64, len(codes) + 1)[offsets] // self.dtype.itemsize
        ids = np.frombuffer(taken.buffers()[2] or b"", self.dtype, bounds[-1])
        sizes = np.diff(bounds)
        if not library.any():
            return ids, sizes
        parts = np.split(ids, bounds[1:-1])
        end = [] if end_id is None else [end_id]
        for i in np.flatnonzero(library):
            text = (" " if follows else "") + texts[int(i)].as_py()
            parts[i] = np.array(self.library.encode(text, add_special_tokens=False).ids + end, self.dtype)
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _long(self, text: str, end_id: int | None) -> np.ndarray:
        """A long text, cut at single spaces between letters, which no match and no added token spans."""
        parts: list[np.ndarray] = []
        at = 0
        while at < len(text):
            cut = text.find(" ", at + LONG // 4) if len(text) - at > LONG // 4 else -1
            while cut > 0 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
                cut = text.find(" ", cut + 1)
            stop = cut if cut > 0 else len(text)
            parts.append(self._short(pa.array([text[at:stop]], pa.string()), None, follows=at > 0)[0])
            at = stop + 1
        return np.concatenate([*parts, np.array([] if end_id is None else [end_id], self.dtype)])

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids of one whole text; none for null or empty text."""
        return self.batch(pa.array([text], pa.string()))[0]


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
