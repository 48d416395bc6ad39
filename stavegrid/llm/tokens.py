"""Token ids of whole texts through a table of distinct chunks.

A text is cut at single spaces; for the two vocabularies used here the ids of a
text are the ids of its chunks in order, each later chunk taking its space
along.  So only distinct chunks meet an encoder and everything else is array
work.  A chunk that is empty or has white space at an edge would break the
rule for vocabularies that keep white space; such texts are cut by the
vocabulary's own pattern instead.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stavegrid.llm.common import ragged, text_bytes

#: Entries of a worker's table, and characters in them, before it starts anew; bounds its memory.
TABLE_ENTRIES, TABLE_CHARACTERS = 800_000, 32 << 20


#: White space as the library's patterns mean it; Python's also has U+001C to U+001F.
_SPACE = r"\t-\r \x85\p{Z}"


def _exact_space(pattern: str) -> str:
    pattern = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return pattern.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER_SPACED = np.arange(256, dtype=np.uint8)
_LOWER_SPACED[65:91] += 32
_LOWER_SPACED[9:14] = 32
#: Letters and digits of ASCII are 1, marks that end clauses 2.
_SIDE = np.zeros(256, np.uint8)
_SIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_SIDE[list(b".,;:!?")] = 2


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts for a vocabulary that folds case and drops white space: ASCII
    letters folded, line ends as spaces, and a space between a letter or digit
    and a mark that ends clauses, where such vocabularies cut anyway.  So far
    fewer chunks differ.  Special tokens need their text as it is."""
    raw, at = text_bytes(texts)
    if len(raw) < 2 or pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    side = _SIDE[raw]
    cut = side[1:] * side[:-1] == 2
    inner = at[1:-1]
    cut[inner[(inner > 0) & (inner < len(raw))] - 1] = False
    where = np.flatnonzero(cut) + 1
    out = np.insert(_LOWER_SPACED[raw], where, 32)
    moved = (at + np.searchsorted(where, at)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(out))


class ChunkEncoder:
    """``encode(keys)`` gives the ids of all keys end to end and each key's count.

    pieces: for vocabularies that keep white space, cuts a text into keys that
    can be encoded on their own; None for those that drop it.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pieces: Callable[[str], list[str]] | None):
        self._encode, self._pieces = encode, pieces
        self._clear()

    def _clear(self) -> None:
        self._table: dict[str, int] = {}
        self._pool, self._used = np.zeros(1 << 16, np.uint16), 0
        self._start, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._characters = 0

    def _rows(self, keys: list[str]) -> np.ndarray:
        missing = [k for k in keys if k not in self._table]
        if missing:
            if self._table and (len(self._table) + len(missing) > TABLE_ENTRIES or self._characters > TABLE_CHARACTERS):
                self._clear()
                missing = keys
            ids, size = self._encode(missing)
            while len(self._pool) < self._used + len(ids):
                self._pool = np.r_[self._pool, np.zeros_like(self._pool)]
            self._pool[self._used : self._used + len(ids)] = ids
            self._start = np.r_[self._start, self._used + np.cumsum(size) - size]
            self._size = np.r_[self._size, size]
            self._used += len(ids)
            self._characters += sum(map(len, missing))
            self._table.update(zip(missing, range(len(self._table), len(self._table) + len(missing))))
        return np.fromiter(map(self._table.__getitem__, keys), np.int64, len(keys))

    def _whole(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = flat.dictionary_encode()
        row = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        return self._start[row], self._size[row]

    def __call__(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint16) of all texts end to end, and the n + 1 offsets.

        A null is an empty text.  ``end`` is appended to each text's ids.
        """
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts if self._pieces else _spaced(texts), " ")
        at = lists.offsets.to_numpy()
        at, flat = at - at[0], lists.flatten()
        first = np.zeros(len(flat), bool)
        first[at[:-1]] = True
        if self._pieces:
            edge = pc.or_(pc.equal(flat, ""), pc.match_substring_regex(flat, r"^[\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}]$")).to_numpy(zero_copy_only=False)
            edge[at[:-1]] &= (np.diff(at) > 1) & (pc.not_equal(flat.take(pa.array(at[:-1])), "").to_numpy(zero_copy_only=False))
            odd = np.add.reduceat(edge, at[:-1]) > 0
            keys = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), flat, pa.scalar(" ", pa.large_string())))
            if odd.any():
                parts = [pa.array(self._pieces(texts[int(i)].as_py()), pa.large_string()) for i in np.flatnonzero(odd)]
                count = np.diff(at)
                keep = np.repeat(~odd, count)
                source = pa.concat_arrays([keys.filter(pa.array(keep)), *parts])
                size = count.copy()
                size[odd] = [len(p) for p in parts]
                begin = np.empty(n, np.int64)
                begin[~odd] = np.cumsum(count[~odd]) - count[~odd]
                begin[odd] = int(keep.sum()) + np.cumsum(size[odd]) - size[odd]
                keys, at = source.take(pa.array(ragged(size, begin))), np.r_[0, np.cumsum(size)]
        else:
            keys = flat
        start, size = self._whole(keys)
        ids = self._pool[ragged(size, start)]
        offsets = np.r_[0, np.cumsum(size)][at]
        if end is not None:
            ids = np.insert(ids, offsets[1:], end)
            offsets = offsets + np.arange(n + 1)
        return ids, offsets


@lru_cache(1)
def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in visible else spare))
        spare += byte not in visible
    return letters


@lru_cache(1)
def _fresh() -> frozenset[str]:
    """Code points that Python's Unicode has not assigned and regex's
    newer one calls letters or numbers; there the library cuts the text."""
    import sys
    import unicodedata

    import regex

    known = regex.compile(r"[\p{L}\p{N}]")
    found = [c for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 and unicodedata.category(c := chr(k)) == "Cn" and known.match(c)]
    return frozenset(found)


@lru_cache(4)
def word_end_encoder(path: str) -> ChunkEncoder:
    """Ids of a vocabulary with word ends, by the library's normalizer and model.

    A chunk's pieces go to the model one by one, each distinct piece once.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    special = [t["content"] for t in described["added_tokens"]]
    pattern = regex.compile(_exact_space(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]))
    fresh = _fresh()
    normalize, tokenize, letters = tokenizer.normalizer.normalize_str, tokenizer.model.tokenize, _byte_letters()
    known: dict[str, list[int]] = {}

    def piece_ids(piece: str) -> list[int]:
        if (ids := known.get(piece)) is None:
            shown = piece if piece.isascii() and piece.isprintable() else "".join(letters[b] for b in piece.encode())
            ids = [t.id for t in tokenize(shown)]
            if len(known) < TABLE_ENTRIES // 4:
                known[piece] = ids
        return ids

    def encode(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[int] = []
        size = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys):
            before = len(out)
            if ("<|" in key and any(s in key for s in special)) or (not key.isascii() and not fresh.isdisjoint(key)):
                out += tokenizer.encode(key, add_special_tokens=False).ids
            else:
                plain = key.lower() if key.isascii() else normalize(key)
                if plain.isalpha() and plain.isascii():
                    out += [t.id for t in tokenize(plain)]
                else:
                    for piece in pattern.findall(plain):
                        out += piece_ids(piece)
            size[k] = len(out) - before
        return np.array(out, np.uint16), size

    return ChunkEncoder(encode, None)


@lru_cache(4)
def byte_level_encoding(path: str):
    """A byte-level vocabulary file as tiktoken's encoder: the same merges in
    the same order, checked on loading, and several times as fast.

    Ids equal merge order there, so its ranks are the file's ids.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    byte = {letter: b for b, letter in enumerate(_byte_letters())}
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    vocabulary = described["model"]["vocab"]
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in described["model"]["merges"]]
    if [vocabulary[m] for m in joined] != list(range(256, 256 + len(joined))):
        raise ValueError(f"{path}: ids are not in the order of the merges")
    ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def space_keeping_pieces(path: str) -> Callable[[str], list[str]]:
    """The pre-tokenizer's pieces; special tokens' strings stay whole."""
    import json

    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    pattern = regex.compile(_exact_space(public_tokenizers.PATTERN))
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    split, fresh = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str, _fresh()

    def plain(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in split(text)] if not fresh.isdisjoint(text) else pattern.findall(text)

    def pieces(text: str) -> list[str]:
        if cut is None or not cut.search(text):
            return plain(text)
        out: list[str] = []
        for k, part in enumerate(cut.split(text)):
            out += [part] if k % 2 else plain(part)
        return out

    return pieces
