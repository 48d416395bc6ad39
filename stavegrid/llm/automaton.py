"""BPE encoding and decoding with a deterministic tokenization automaton.

Compilation.  The automaton starts as one state with an arc for each byte.
Merges enter in order; the gadget of a merge (u, v) -> w takes the arc v away
from the state behind u, gives w a state that copies the one behind v, and
lays an arc w beside every arc u.  Its paths are then exactly the token
sequences that BPE yields.  What changes is kept sparsely: for the state
behind a token, the arcs that are missing and the merge that took them.  A
copy inherits what was taken before it was made, and an arc w that starts with
a missing arc u is missing too; so one ascending pass over the merges compiles
the whole automaton.  Equal states and equal arcs are then joined into one bit
table.

Encoding.  A trie of arc labels and that table drive many words at a time:
each prefix of a word has one path, so a position holds one state.  A long word
is walked in lanes that start a little early and must agree with the lane before
them over the longest label, beyond which no arc looks back.  Decoding writes
the arcs' labels.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavegrid.llm.common import batch_of, column, ragged, slices, text_bytes
from stavegrid.llm.tokens import ChunkEncoder, _byte_letters, space_keeping_pieces


#: States whose arcs are unpacked at once on compiling; a multiple of 8.
_STATES = 512
#: Bytes of a long word that a lane settles, and those it starts early.  Multiples
#: of 384, so that runs of a repeated letter of 1 to 4 bytes come out in phase.
_LANE, _EARLY = 768, 384
#: Lanes walked at once, and lanes in sequence whose outcome is kept for equal ones.
_LANES, _KEPT = 2048, 64


class TokenAutomaton:
    """Tables of one byte-level vocabulary; see the module's text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary, merges = described["model"]["vocab"], described["model"]["merges"]
        letters = _byte_letters()
        byte = {letter: b for b, letter in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        node = {letter: b for b, letter in enumerate(letters)}
        labels = [bytes([b]) for b in range(256)]
        self.ids = np.zeros(256 + len(merges), np.uint16)
        self.ids[:256] = [vocabulary[letter] for letter in letters]
        left, right = np.full(256 + len(merges), -1, np.int64), np.full(256 + len(merges), -1, np.int64)
        for k, merge in enumerate(merges, 256):
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            left[k], right[k] = node[u], node[v]
            node.setdefault(u + v, k)
            labels.append(bytes(byte[c] for c in u + v))
            self.ids[k] = vocabulary[u + v]
        self._compile(left, right)
        self._label(labels)

    def __getstate__(self) -> dict:
        """The sparse tables shortened: each executor keeps copies of what is sent."""
        at = np.flatnonzero(self.next)
        return self.__dict__ | {"next": (self.next.shape, at.astype(np.int32), self.next.ravel()[at]), "missing": (self.missing.shape, zlib.compress(self.missing.tobytes(), 1))}

    def __setstate__(self, held: dict) -> None:
        self.__dict__.update(held)
        shape, at, to = held["next"]
        self.next = np.zeros(shape, np.int32)
        self.next.ravel()[at] = to
        shape, bits = held["missing"]
        self.missing = np.frombuffer(zlib.decompress(bits), np.uint8).reshape(shape)

    # ------------------------------------------------------------ compilation
    def _compile(self, left: np.ndarray, right: np.ndarray) -> None:
        n = len(left)
        begins: list[list[int]] = [[] for _ in range(n)]
        for w in range(256, n):
            begins[left[w]].append(w)
        longer: list[np.ndarray] = [np.zeros(0, np.int32)] * n  # all arcs that start with an arc, by way of left parts
        for u in range(n - 1, -1, -1):
            if begins[u]:
                longer[u] = np.sort(np.concatenate([np.array(begins[u], np.int32), *(longer[w] for w in begins[u])]))
        taken: list[np.ndarray] = []
        since: list[np.ndarray] = []
        shared: list[np.ndarray] = []
        none = np.zeros(0, np.int32)
        state, rows = np.empty(n, np.int32), {}
        for t in range(n):
            arcs, cause = (taken[right[t]], since[right[t]]) if t >= 256 else (none, none)
            held = cause < t
            arcs, cause = arcs[held], cause[held]
            more_arcs, more_cause = [arcs], [cause]
            for w in begins[t]:
                v = right[w]
                late = begins[v][bisect_left(begins[v], w) :]
                after = np.concatenate([np.array([v, *late], np.int32), *(longer[x] for x in late)])
                more_arcs.append(after)
                more_cause.append(np.full(len(after), w, np.int32))
            if len(more_arcs) > 1:
                arcs, cause = np.concatenate(more_arcs), np.concatenate(more_cause)
                order = np.lexsort((cause, arcs))
                arcs, cause = arcs[order], cause[order]
                first = np.r_[True, arcs[1:] != arcs[:-1]]
                arcs, cause = arcs[first], cause[first]
            state[t] = rows.setdefault(spelled := arcs.tobytes(), len(rows))
            if state[t] == len(shared):
                shared.append(np.frombuffer(spelled, np.int32))
            taken.append(shared[state[t]])  # equal states hold one array
            since.append(cause.astype(np.int32))
        del longer, taken, since, shared
        packed = np.zeros((n, -(-len(rows) // 8)), np.uint8)  # by arc, a bit for each state
        every = list(rows)
        for low in range(0, len(every), _STATES):
            missing = np.zeros((min(_STATES, len(every) - low), n), bool)
            for k, arcs in enumerate(every[low : low + _STATES]):
                missing[k, np.frombuffer(arcs, np.int32)] = True
            packed[:, low // 8 : -(-(low + len(missing)) // 8)] = np.packbits(missing.T, axis=1)
        joined: dict[bytes, int] = {}
        self.arc = np.fromiter((joined.setdefault(row.tobytes(), len(joined)) for row in packed), np.int32, n)
        distinct = np.zeros(len(joined), np.int64)
        distinct[self.arc] = np.arange(n)
        packed = packed[distinct]
        self.state, self.missing = state, np.zeros((len(rows), -(-len(joined) // 8)), np.uint8)
        for low in range(0, len(every), _STATES):
            block = np.unpackbits(packed[:, low // 8 : (low + _STATES) // 8], axis=1)[:, : len(every) - low]
            self.missing[low : low + _STATES] = np.packbits(block.T, axis=1)

    def _label(self, labels: list[bytes]) -> None:
        """The trie of arc labels, and the labels by id for decoding."""
        child: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for t, label in enumerate(labels):
            at = 0
            for b in label:
                at = child.setdefault((at, b), len(child) + 1)
            ends[at] = t
        self.next = np.zeros((len(child) + 1, 256), np.int32)
        for (at, b), to in child.items():
            self.next[at, b] = to
        self.token = np.full(len(child) + 1, -1, np.int32)
        self.token[list(ends)] = list(ends.values())
        self.length = np.array([len(x) for x in labels], np.int64)
        self.reach = int(self.length.max())
        spelled = [b""] * (1 + max([int(self.ids.max()), *self.special.values()]))
        for t, label in enumerate(labels):
            spelled[self.ids[t]] = label
        for content, k in self.special.items():
            spelled[k] = content.encode()
        self.label_size = np.array([len(x) for x in spelled], np.int64)
        self.label_start = np.cumsum(self.label_size) - self.label_size
        self.label_pool = np.frombuffer(b"".join(spelled), np.uint8)

    # --------------------------------------------------------------- encoding
    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pre-split words end to end, and their counts."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        order = np.argsort(size, kind="stable")
        parts: list[np.ndarray] = []
        low, end = np.searchsorted(size[order], [1, 2 * max(_LANE, self.reach)]).tolist()
        while low < end:  # words of like length together
            longest = max(8, int(size[order[low]] * 1.5))
            high = min(int(np.searchsorted(size[order[:end]], longest, "right")), low + max(1, (1 << 21) // longest))
            group = order[low:high]
            ids, counts[group] = self._walk([words[k] for k in group], size[group])
            parts.append(ids)
            low = high
        for k in order[end:].tolist():
            parts.append(self._long(words[k]))
            counts[k] = len(parts[-1])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(counts, start)], counts

    def _walk(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(size.max())
        text = np.zeros((width, n), np.uint8)
        pool = np.frombuffer(b"".join(words), np.uint8)
        text[ragged(size, np.zeros(n, np.int64)), np.repeat(np.arange(n), size)] = pool
        last = self._advance(text, size, np.full((1, n), -1, np.int32))
        where, which, found = size.copy(), np.arange(n), []
        while len(which):
            token = last[where[which], which]
            found.append((which, token))
            where[which] -= self.length[token]
            which = which[where[which] > 0]
        word = np.concatenate([w for w, _ in found])
        order = np.lexsort((-np.repeat(np.arange(len(found)), [len(w) for w, _ in found]), word))
        return self.ids[np.concatenate([t for _, t in found])[order]], np.bincount(word, minlength=n)

    def _advance(self, text: np.ndarray, size: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The arc by which each position of the columns of ``text`` is reached.
        ``known``: arcs of the first positions, of which -1 begins a word."""
        width, n = text.shape
        last = np.full((width + 1, n), -1, np.int32)
        last[: len(known)] = known
        for i in range(width):
            row = np.flatnonzero(size > i)
            fresh = i == 0 and known[0, 0] < 0
            if not fresh:
                behind = self.state[last[i, row]]
            at, j = self.next[0, text[i, row]], i
            while len(row):
                j += 1
                token = self.token[at]
                ok = token >= 0
                if not fresh:
                    arc = self.arc[token]
                    ok &= (self.missing[behind, arc >> 3] >> (7 - (arc & 7))) & 1 == 0
                if j >= len(known):
                    last[j, row[ok]] = token[ok]
                on = size[row] > j
                row, at = row[on], at[on]
                if not fresh:
                    behind = behind[on]
                if not len(row):
                    break
                at = self.next[at, text[j, row]]
                on = at > 0
                row, at = row[on], at[on]
                if not fresh:
                    behind = behind[on]
        return last

    def _long(self, word: bytes) -> np.ndarray:
        """ids of one long word.

        Lanes that do not agree with the one before them walk on from it, first
        all at once and then in order; equal lanes with equal arcs before them
        are walked once.  So the cost follows the length of the word, and steps
        that NumPy takes for many lanes at once are few unless a word falls
        into no common phase within a lane and does not repeat either.
        """
        raw, reach = np.frombuffer(word, np.uint8), self.reach
        lane, early = max(_LANE, reach), max(_EARLY, reach)
        last = np.full(len(raw) + 1, -1, np.int32)  # by position, as all lanes leave it
        starts = np.arange(0, len(raw), lane)
        warm = np.full((len(starts), reach), -1, np.int32)  # what a lane takes for the arcs before it

        def walk(k: np.ndarray, back: int, known: np.ndarray) -> None:
            low, high = starts[k] - back, np.minimum(starts[k] + lane, len(raw))
            seen: dict[tuple[bytes, bytes], int] = {}  # equal lanes are walked once
            of = [seen.setdefault((word[a:b], arcs.tobytes()), len(seen)) for a, b, arcs in zip(low.tolist(), high.tolist(), known.T)]
            one = np.zeros(len(seen), np.int64)
            one[of] = np.arange(len(k))
            size = (high - low)[one]
            text = raw[np.minimum(low[one] + np.arange(int(size.max()))[:, None], len(raw) - 1)]
            found = self._advance(text, size, known[:, one])
            if back:
                warm[k] = found[back - reach + 1 : back + 1, of].T
            for c, begin, end in zip(of, starts[k].tolist(), high.tolist()):
                last[begin + 1 : end + 1] = found[back + 1 : back + 1 + end - begin, c]

        def before(k: np.ndarray) -> np.ndarray:
            return last[starts[k][:, None] - reach + 1 + np.arange(reach)]

        walk(np.array([0]), 0, np.full((1, 1), -1, np.int32))
        rest = np.arange(1, len(starts))
        for k in np.split(rest, range(_LANES, len(rest), _LANES)):
            if len(k):
                walk(k, early, np.full((1, len(k)), -1, np.int32))
        off = rest[(before(rest) != warm[rest]).any(1)]
        for k in np.split(off, range(_LANES, len(off), _LANES)):
            if len(k):
                walk(k, reach, last[starts[k] - reach + np.arange(reach + 1)[:, None]])
        kept: dict[tuple[bytes, bytes], np.ndarray] = {}
        for k in rest.tolist():
            low = int(starts[k])
            if (last[low - reach + 1 : low + 1] == warm[k]).all():
                continue
            same = (last[low - reach : low + 1].tobytes(), word[low - reach : low + lane])
            if same in kept:
                last[low + 1 : low + lane + 1] = kept[same]
                continue
            walk(np.array([k]), reach, last[low - reach : low + 1, None].copy())
            if len(kept) == _KEPT:
                kept.clear()
            kept[same] = last[low + 1 : low + lane + 1].copy()
        arcs, length, at, out = memoryview(last), self.length.tolist(), len(raw), []
        while at:
            out.append(arcs[at])
            at -= length[out[-1]]
        return self.ids[np.array(out[::-1], np.int64)]

    # --------------------------------------------------------------- decoding
    def labels(self, ids: np.ndarray) -> np.ndarray:
        return self.label_pool[ragged(self.label_size[ids], self.label_start[ids])]


@lru_cache(2)
def automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(path)


def chunk_encoder(tables: TokenAutomaton, path: str) -> ChunkEncoder:
    """Texts by way of the automaton; strings of special tokens are their ids."""
    pieces = space_keeping_pieces(path)

    def encode(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [pieces(k) for k in keys]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for c in cut for w in c))}
        ids, size = tables.encode_words([w.encode() for w in words])
        start = np.cumsum(size) - size
        for w in tables.special:
            if w in words:
                at = words[w]
                ids = np.r_[ids, np.uint16(tables.special[w])]
                start[at], size[at] = len(ids) - 1, 1
        row = np.fromiter((words[w] for c in cut for w in c), np.int64)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        edge = np.r_[0, np.cumsum(size[row])][np.r_[0, np.cumsum(many)]]
        return ids[ragged(size[row], start[row])], np.diff(edge)

    return ChunkEncoder(encode, pieces)


_encoders: dict[str, ChunkEncoder] = {}


def encode_decode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``ids`` (little-endian uint32), and the text decoded from them.

    A null text is empty; repeated rows and null keys are rows like others.
    The tables are compiled once on the driver (their size is the
    vocabulary's, not the data's) and broadcast; there is no shuffle.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(automaton(path))
    rows = docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        if path not in _encoders:
            _encoders[path] = chunk_encoder(tables.value, path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = _encoders[path](batch.column("text"))
                decoded = tables.value.labels(ids)
                edge = np.r_[0, np.cumsum(tables.value.label_size[ids])][at]
                wide = ids.astype("<u4")
                yield batch_of(
                    schema,
                    doc_id=batch.column("doc_id"),
                    ids=[wide[a:b].tobytes() for a, b in zip(at[:-1], at[1:])],
                    decoded=[decoded[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])],
                )

    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_decode_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of :func:`encode_decode`."""
    return encode_decode(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
