"""Word-wise use of a byte-level BPE tokenizer, with the same ids as encoding the whole text.

The pre-tokenizer never joins anything across a single space that is followed by a non-space: no alternative of its
pattern holds a space after its first character, except white-space runs. So a text is the concatenation of its pieces
between single spaces, each led by its space, as long as no piece is empty or begins with white space. Texts that have
such a piece, or a special token's string, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from itertools import islice

LONGEST_KEPT = 64
#: What byte-level pre-tokenizers split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN_END = "\u0250"
UNSAFE = 1 << 40
#: Characters that some version of the pattern's \\s takes as white space though Python does not.
_ODD_SPACE = "᠎​﻿"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def core(path: str):
    """The same merges without the library's cost a call (for Latin text, of which all versions of the pattern agree);
    None if that isn't certain.

    It is certain if the model is a plain byte-level BPE whose merges stand in the order of the ids they make: then
    merging the lowest id first is merging by rank.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    vocab, merges = model["vocab"], model["merges"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    if None in made or made != sorted(set(made)) or len(vocab) - len(made) != 256:
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe


def specials(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def safe(piece: str) -> bool:
    return bool(piece) and not piece[0].isspace() and piece[0] not in _ODD_SPACE


class Pieces(dict):
    """piece -> what `value(ids)` makes of the ids of " " + piece; the dict is a bounded cache.

    seed holds entries known beforehand. A piece that ends in one comma or full stop after a letter is put together
    from the piece without it, which is far more often known.
    """

    def __init__(self, tok, value, join, unsafe, most: int, seed: dict | None = None, single=None):
        super().__init__(seed or {})
        self.single = single and single.encode_single_piece
        self.tok, self.value, self.join, self.unsafe, self.most = tok, value, join, unsafe, most
        self.heads: dict = {}
        self.tails = {c: self.bare(c) for c in ",."}

    def bare(self, text: str):
        return self.value(self.tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str):
        if self.single and piece.isalpha() and (piece.isascii() or max(piece) < _LATIN_END):  # letters for any version of the pattern
            got = self.value(self.single(b" " + piece.encode()))
        elif not safe(piece):
            return self.unsafe
        elif piece[-1] in self.tails and len(piece) > 1 and piece[-2].isascii() and piece[-2].isalpha():
            got = self.join(self[piece[:-1]], self.tails[piece[-1]])
        else:
            got = self.bare(" " + piece)
        if len(self) < self.most and len(piece) <= LONGEST_KEPT:
            self[piece] = got
        return got

    def head(self, piece: str):
        """The first piece of a text, which no space precedes."""
        got = self.heads.get(piece)
        if got is None:
            got = self.bare(piece)
            if len(piece) <= LONGEST_KEPT and len(self.heads) < self.most // 4:
                self.heads[piece] = got
        return got


class Counter:
    """Numbers of tokens of texts."""

    def __init__(self, path: str, seed: dict[str, int] | None = None, most: int = 400_000):
        self.tok = load(path)
        self.special = specials(self.tok)
        self.pieces = Pieces(self.tok, len, int.__add__, UNSAFE, most, seed, core(path))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not any(s in text for s in self.special):
            pieces = text.split(" ")
            n = sum(map(self.pieces.__getitem__, islice(pieces, 1, None)))
            if n < UNSAFE:
                return n + self.pieces.head(pieces[0])
        return len(self.tok.encode(text, add_special_tokens=False).ids)


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Unsafe(Exception):
    pass


class Encoder:
    """Ids of texts as little-endian bytes of the given width (2 or 4)."""

    def __init__(self, path: str, most: int = 250_000):
        import numpy as np


        self.tok = load(path)
        self.special = specials(self.tok)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        code = "H" if self.width == 2 else "I"
        self.narrow = lambda ids: np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes()
        self.core, self.leads = core(path), None
        if sys.byteorder != "little":
            raise RuntimeError("the file format is little-endian")
        self.value = lambda ids: array(code, ids).tobytes()
        outer = self

        class Bytes(Pieces):
            def __missing__(self, piece):
                if not safe(piece):
                    raise _Unsafe
                return super().__missing__(piece)

        self.pieces = Bytes(self.tok, outer.value, bytes.__add__, None, most, None, self.core)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.special):
            if self.core and _latin1(text):
                return self.narrow(self.core.encode_to_tiktoken_buffer(text, set()))
            pieces = text.split(" ")
            try:
                rest = b"".join(map(self.pieces.__getitem__, islice(pieces, 1, None)))
                return self.pieces.head(pieces[0]) + rest
            except _Unsafe:
                pass
        return self.value(self.tok.encode(text, add_special_tokens=False).ids)

    def batch(self, texts, end_id: int):
        """The ids of all texts (an Arrow array of strings), end_id after each, as one array, and each text's number of
        them. Every distinct piece of the batch is encoded once; the pieces' ids are put together as they stand."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kind, n = np.dtype(f"<u{self.width}"), len(texts)
        end = np.array([end_id], kind).tobytes()
        alone = np.array([not _latin1(t) or any(s in t for s in self.special) for t in texts.to_pylist()], bool)
        if not self.core or alone.all():
            blobs = [self(t) + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(blobs), kind), np.array([len(b) // self.width for b in blobs], np.int64)
        parts = pc.split_pattern(pc.if_else(pa.array(alone), "", texts), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, coded = offsets - offsets[0], parts.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        sound = np.array([safe(p) for p in distinct], bool)
        first = offsets[:-1]
        unsafe = ~sound[index]
        unsafe[first] = False  # a text's first piece has no space before it
        alone |= np.logical_or.reduceat(unsafe, first)
        got = self._led([p for p, ok in zip(distinct, sound.tolist(), strict=True) if ok])
        plain, odd = np.flatnonzero(~alone), np.flatnonzero(alone)
        heads = [self.pieces.head(p) if p else b"" for p in map(distinct.__getitem__, index[first[plain]].tolist())]
        whole = [self(texts[k].as_py()) for k in odd.tolist()]
        # values: the distinct pieces' ids, the first pieces', the odd texts', nothing, the end id
        tail = [*heads, *whole, b"", end]
        size = np.zeros(len(distinct) + len(tail), np.int64)
        size[np.flatnonzero(sound)] = got[1]
        size[len(distinct) :] = [len(b) // self.width for b in tail]
        flat = got[0].astype(kind).tobytes() + b"".join(tail)
        ends = np.concatenate(([0], np.cumsum(size * self.width))).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        # every text's values: its pieces, the end id
        word = np.empty(len(index) + n, np.int32)
        last = offsets[1:] + np.arange(n)
        own = np.ones(len(word), bool)
        own[last] = False
        word[own] = index
        word[last] = len(size) - 1
        begin = first + np.arange(n)
        for k in odd.tolist():
            word[begin[k] : last[k]] = len(size) - 2
        word[begin[plain]] = len(distinct) + np.arange(len(plain))
        word[begin[odd]] = len(distinct) + len(plain) + np.arange(len(odd))
        data = values.take(pa.array(word)).buffers()[2]
        each = np.add.reduceat(size[word], begin)
        return np.frombuffer(data, kind, int(each.sum())), each

    def _led(self, pieces: list[str]):
        """The ids of each piece (safe ones) with a space before it, one after another, and their numbers: one call of the
        core, as a token that begins with a space begins a piece."""
        import numpy as np

        if self.leads is None:
            texts = self.core.token_byte_values()
            self.leads = np.zeros(self.tok.get_vocab_size(), bool)
            self.leads[[self.core.encode_single_token(t) for t in texts if t[:1] == b" "]] = True
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.frombuffer(self.core.encode_to_tiktoken_buffer(" " + " ".join(pieces), set()), "<u4")
        at = np.flatnonzero(self.leads[ids])
        if len(at) != len(pieces):
            raise AssertionError("a piece begins with its space, and holds no other")
        return ids, np.diff(np.append(at, len(ids)))


def in_bytes(batch, most: int):
    """The same rows (with a column text) in batches of at most `most` bytes of text, or of one row."""
    import numpy as np

    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
