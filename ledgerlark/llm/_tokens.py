"""Token ids by the tokenizers library, in tasks."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, to the library or to Python.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Where a space stands between white space, pieces of white space cross the cuts.
_CROSSES = rf"{_WHITE} (?:{_WHITE}|\z)"
#: Longer chunks aren't kept.
LONGEST = 64
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks of ASCII characters and Latin-1 letters split here as they do in the library, which gets their pieces; others go to it whole.
_OTHER = re.compile(f"[^\t-\r -~{_LETTERS}]")
_MARKS = r"!-/:-@\[-`{-~"
_KEEPS_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\s+(?!\S)|\s+")
_DROPS_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


class ChunkEncoder:
    """Ids of whole texts.

    The vocabularies split a text into pieces before any merge, and no piece goes across a space but at its start. So a text's ids are
    those of its chunks between spaces, one after another, and a chunk's those of its pieces. The library merges each piece once in a worker, as
    long as it is in use; the caches are bounded. ``drops_space``: the vocabulary lowers its text and drops white space; otherwise a space
    belongs to the chunk after it. Texts in
    which the cuts could differ from the library's go to it whole; very long chunks aren't kept.
    """

    def __init__(self, path: str, drops_space: bool, chunks: int = 60_000, pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        some = "".join(map(chr, range(0x100)))
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(some)[0][0]
        # The library's letter for each byte of these characters, if it isn't the character of the same number.
        self.alphabet = {b: c for b, c in zip(some.encode(), shown, strict=True) if chr(b) != c}
        self.space = self.alphabet[0x20]
        self.drops_space = drops_space
        # Two generations each: what is asked for again stays, what two generations don't ask for goes.
        self.limits, self.chunks, self.pieces, self.old_chunks, self.old_pieces = (chunks, pieces), {}, {}, {}, {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, piece: str) -> bytes:
        """Ids of a piece of ASCII characters and Latin-1 letters."""
        ids = self.old_pieces.get(piece)
        if ids is None:
            shown = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self.pieces[piece] = ids
        return ids

    def _encoded(self, chunk: str) -> bytes:
        own = chunk if self.drops_space else chunk[1:] if chunk[:1] == " " else " " + chunk
        if not own.isascii() and _OTHER.search(own) or not own.isprintable() and _OTHER.search(own):
            return self.library([own])[0]
        pieces = _DROPS_SPACE.findall(own.lower()) if self.drops_space else _KEEPS_SPACE.findall(own)
        known = self.pieces.get
        if len(pieces) == 1:
            return known(pieces[0]) or self._merged(pieces[0])
        return b"".join([known(p) or self._merged(p) for p in pieces])

    def _known(self, chunks: list[str]) -> list[bytes]:
        out = list(map(self.chunks.get, chunks))
        for i, ids in enumerate(out):
            if ids is None:
                chunk = chunks[i]
                ids = self.old_chunks.get(chunk)
                out[i] = ids = self._encoded(chunk) if ids is None else ids
                if len(chunk) <= LONGEST:
                    self.chunks[chunk] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (with the end of the last)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.empty(0, np.int64)
        if not self.drops_space:
            crosses = pc.match_substring_regex(texts, _CROSSES)
            whole = np.flatnonzero(crosses.to_numpy(zero_copy_only=False))
            texts_split = pc.if_else(crosses, "", texts) if len(whole) else texts
        else:
            texts_split = texts
        lists = pc.split_pattern(texts_split, " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        index = np.array(flat.indices)
        chunks = flat.dictionary.to_pylist()
        ids = self._known(chunks)
        if not self.drops_space:
            # A text's first chunk has no space before it: " " and the chunk, a name that no other chunk has, stands for it.
            firsts: dict[int, int] = {}
            for at in offsets[:-1].tolist():
                k = int(index[at])
                if k not in firsts:
                    firsts[k] = len(ids)
                    ids += self._known([" " + chunks[k]]) if chunks[k] else [b""]
                index[at] = firsts[k]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        of_chunk = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        own = of_chunk.take(pa.array(index))
        found, begins = own.flatten().to_numpy(), own.offsets.to_numpy()[offsets].astype(np.int64)
        if len(whole):
            parts = np.split(found, begins[1:-1])
            for i in whole.tolist():
                parts[i] = np.frombuffer(self.library([texts[i].as_py()])[0], "<u4")
            found, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
        if len(self.chunks) > self.limits[0]:
            self.old_chunks, self.chunks = self.chunks, {}
        if len(self.pieces) > self.limits[1]:
            self.old_pieces, self.pieces = self.pieces, {}
        return found, begins


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool) -> ChunkEncoder:
    """One for each worker process, so that its caches serve all of the worker's tasks."""
    return ChunkEncoder(path, drops_space)
