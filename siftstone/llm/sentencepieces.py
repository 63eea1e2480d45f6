"""SentencePiece encoding and decoding: segmentations sampled by forward filtering and backward sampling.

Blanks are written as U+2581 and one stands before a text, as in the model's own encoder. No piece has U+2581 behind
another character, so the piece lattice of a text falls into those of its words, and sampling each of them on its own
samples the whole. For the distinct words of a slice of rows the forward pass fills, for each end of a prefix, the weights of
the pieces that may end there (probability of the prefix before it times the piece's); the backward pass then draws
pieces from the end; both go over all words at once in numpy. Draws come from a counter-based hash of
(seed, row key, number of the word, step): a row's segmentation depends on nothing else, wherever and however
often it is made. Characters that are no piece become their UTF-8 bytes as byte pieces, U+2581 of the text itself too, so
decoding gives every text back. With temperature 0 it is the likeliest segmentation.

A piece's probability is that of the model's score; scores that are merge ranks are read as 1 / (rank + 2), normalised.

Defined results: a null or empty text has no pieces; repeated rows have equal segmentations; equal texts of different keys have their
own; an empty table gives no row; other columns are ignored. Memory is bounded by the words of ROWS rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import portions

#: Words up to this many characters go through the forward pass together, longer ones one by one.
SHORT, ROWS, _BITS = 32, 512, 18
#: No share is nearer to 0 or 1, so only a state's last option lies on a whole number.
_EDGE = 1e-9
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLANK, _LITERAL = "▁", "\udce2"
_WORD = re.compile("\n|▁*[^▁\n]+|▁+")


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_STEP) + (ord(c) + 1) * int(_MIX)) % (1 << 64)
    return h


class Lattice:
    """The pieces of a model and the sampling tables of the words seen so far."""

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = np.array([m.get_score(i) for i in plain], dtype=float)
        if len(scores) and (scores == np.round(scores)).all():  # merge ranks
            scores = -np.log(-scores - (-scores).min() + 2.0)
        scores = scores - np.log(np.exp(scores).sum()) if len(scores) else scores
        self.greedy = temperature == 0
        power = 1.0 if self.greedy else 1.0 / temperature
        self.pieces = {names[i]: (i, float(np.exp(s * power))) for i, s in zip(plain, scores, strict=True)}
        self.longest = max(map(len, self.pieces), default=1)
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.rare = float(np.exp((scores.min() - 5.0) * power)) if len(scores) else 1.0
        self.bytes = [b"" for _ in range(n)]
        for i in plain:
            self.bytes[i] = names[i].replace(_BLANK, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        if any(_BLANK in p.lstrip(_BLANK) for p in self.pieces) or any("\n" in p and p != "\n" for p in self.pieces):
            raise ValueError("a piece of this model runs over the end of a word")
        if len(self.byte) != 256:
            raise ValueError("a model without byte pieces cannot give every text back")
        # open addressing over the hashes of all pieces; 0 is an empty place
        keys = np.array([_hash_of(p) for p in self.pieces], dtype=np.uint64)
        self.keys, self.entry = np.zeros(1 << _BITS, dtype=np.uint64), np.zeros(1 << _BITS, dtype=np.int32)
        for k, key in enumerate(keys):
            at = int(key >> np.uint64(64 - _BITS))
            while self.keys[at]:
                at = (at + 1) % (1 << _BITS)
            self.keys[at], self.entry[at] = key, k
        self.ids = np.array([i for i, _ in self.pieces.values()], dtype=np.int32)
        self.weights = np.array([w for _, w in self.pieces.values()])
        self.single = set("".join(p for p in self.pieces if len(p) == 1))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h that are pieces, their entries)."""
        at = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        here = self.keys[at]
        hit = here == h
        found, entries = [np.flatnonzero(hit)], [self.entry[at[hit]]]
        left = np.flatnonzero(~hit & (here != 0))
        while len(left):
            at[left] = (at[left] + 1) % (1 << _BITS)
            here = self.keys[at[left]]
            hit = here == h[left]
            found.append(left[hit])
            entries.append(self.entry[at[left[hit]]])
            left = left[~hit & (here != 0)]
        return np.concatenate(found), np.concatenate(entries)

    def tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state of each word's end; place, piece and back of the options in order of place).

        A state is the end of a prefix of a word, 0 all starts. An option is a piece that may end there; its place is the
        state's number plus the share of the prefix's weight up to it, and back is the state before it.
        """
        plain = [len(w) <= SHORT and self.single.issuperset(w) for w in words]
        ends = np.zeros(len(words), dtype=np.int64)
        mine = np.flatnonzero(plain)
        place, piece, back = np.zeros(0), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        states = 1
        if len(mine):
            ends[mine], place, piece, back = self._forward([words[i] for i in mine])
            states = int(ends[mine].max()) + 1
        if len(mine) < len(words):
            self.states, self.cum, self.piece, self.back = states, [], [], []
            for i in np.flatnonzero(~np.array(plain)):
                ends[i] = self._add(words[i])
            place, piece, back = np.append(place, self.cum), np.append(piece, np.array(self.piece, dtype=np.int32)), np.append(back, np.array(self.back, dtype=np.int64))
        return ends, place, piece, back

    def _forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass for all words at once, longest first: the words that reach step e are the first of all.

        Step e looks at the pieces that end at a word's e-th character; its states follow those of the step before.
        """
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        codes = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        first = np.cumsum(size) - size
        ends = np.empty(len(words), dtype=np.int64)
        alphas, bases, hashes = [np.ones(len(words))], [-1], np.zeros((0, len(words)), dtype=np.uint64)
        base, places, pieces, backs = 1, [], [], []
        for e in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -e, side="right"))
            width = min(e, self.longest)
            with np.errstate(over="ignore"):
                own = (codes[first[:n] + e - 1] + np.uint64(1)) * _MIX
                hashes = np.vstack([own, hashes[: width - 1, :n] * _STEP + own])
            hit, entry = self._find(hashes.ravel())
            weight, found = np.zeros(width * n), np.zeros(width * n, dtype=np.int32)
            weight[hit], found[hit] = self.weights[entry], self.ids[entry]
            weight, found = weight.reshape(width, n), found.reshape(width, n)
            for k in range(width):  # pieces of k + 1 characters
                weight[k] *= alphas[e - k - 1][:n]
            alphas.append(weight.max(axis=0) if self.greedy else weight.sum(axis=0))
            bases.append(base)
            shares = np.ascontiguousarray(weight.T)
            keep = shares > 0
            if self.greedy:
                keep &= np.arange(width) == shares.argmax(axis=1)[:, None]
            row, k = np.nonzero(keep)
            place = row + base + np.clip(np.cumsum(shares, axis=1)[row, k] / alphas[e][row], _EDGE, 1 - _EDGE)
            last = np.append(row[1:] != row[:-1], True)
            place[last] = row[last] + base + 1.0
            places.append(place)
            pieces.append(found[k, row])
            starts = np.array(bases)[e - 1 - k]
            backs.append(np.where(k + 1 == e, 0, starts + row))
            done = size[:n] == e
            ends[order[:n][done]] = base + np.flatnonzero(done)
            base += n
        return ends, np.concatenate(places), np.concatenate(pieces), np.concatenate(backs)

    def _state(self, options: list[tuple[float, int, int]]) -> int:
        state = self.states
        self.states += 1
        if self.greedy:
            options = [max(options)]
        if len(options) > 1:
            total, acc = sum([o[0] for o in options]), 0.0
            for w, piece, back in options[:-1]:
                acc += w
                self.cum.append(state + min(max(acc / total, _EDGE), 1 - _EDGE))
                self.piece.append(piece)
                self.back.append(back)
        _, piece, back = options[-1]
        self.cum.append(state + 1.0)
        self.piece.append(piece)
        self.back.append(back)
        return state

    def _add(self, word: str) -> int:
        """The forward pass; the state of the word's end."""
        n, pieces = len(word), self.pieces
        alpha, states = [1.0] + [0.0] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            found = [(s, hit) for s in range(e - 1, max(-1, e - self.longest - 1), -1) if (hit := pieces.get(word[s:e])) is not None]
            options = [(alpha[s] * w, piece, states[s]) for s, (piece, w) in found]
            if word[e - 1] not in pieces:
                raw, back = (_BLANK if word[e - 1] == _LITERAL else word[e - 1]).encode("utf-8", "replace"), states[e - 1]
                for b in raw[:-1]:
                    back = self._state([(1.0, self.byte[b], back)])
                options.append((alpha[e - 1] * self.rare ** len(raw), self.byte[raw[-1]], back))
            total = alpha[e] = (max if self.greedy else sum)([o[0] for o in options])
            states[e] = self._state(options)
            if total < 1e-150:  # only ratios within reach of a piece matter
                for s in range(max(0, e - self.longest), e + 1):
                    alpha[s] *= 1e150
        return states[n]

    def words(self, text: str) -> list[str]:
        return _WORD.findall((_BLANK + text.replace(_BLANK, _LITERAL).replace(" ", _BLANK))) if text else []

    def sample(self, texts: list[str | None], keys: list, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each)."""
        number: dict[str, int] = {}
        split = [self.words(t or "") for t in texts]
        for ws in split:
            for w in ws:
                if w not in number:
                    number[w] = len(number)
        ends, place, piece, back = self.tables(list(number))
        counts = np.array([len(ws) for ws in split], dtype=np.int64)
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        state = ends[which]
        row_seed = np.array([xxhash.xxh64_intdigest(b"" if k is None else str(k).encode(), seed=seed) for k in keys], dtype=np.uint64)
        first = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            nth = (np.arange(len(state)) - np.repeat(first, counts)).astype(np.uint64)
            base = np.repeat(row_seed, counts) + nth * _MIX
        # every state has an option: where each one's options begin
        begin = _begins(place)
        live, steps, drawn = np.arange(len(state)), np.zeros(len(state), dtype=np.int64), []
        turn = 0
        while len(live):
            now = state[live]
            goal, at = now + _uniform(base[live], turn), begin[now - 1]
            more = np.flatnonzero(place[at] <= goal)
            while len(more):
                at[more] += 1
                more = more[place[at[more]] <= goal[more]]
            drawn.append((live, piece[at]))
            steps[live] += 1
            state[live] = back[at]
            live = live[state[live] != 0]
            turn += 1
        stop = np.cumsum(steps)
        ids = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.int32)
        for t, (who, what) in enumerate(drawn):
            ids[stop[who] - 1 - t] = what
        return ids, np.concatenate([[0], stop])[np.append(first, len(steps))] if len(steps) else np.zeros(len(texts) + 1, dtype=np.int64)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _begins(place: np.ndarray) -> np.ndarray:
    """Positions of the states' first options: the last option of state k has place k + 1."""
    return np.append(0, np.flatnonzero(place == np.floor(place)) + 1)


def _uniform(base: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = base + np.uint64((turn * 0xD1B54A32D192ED03) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(12)).astype(float) / float(1 << 52) * (1 - 1e-9)


@lru_cache(maxsize=2)
def lattice(path: str, temperature: float) -> Lattice:
    return Lattice(path, temperature)


def encode(docs: DataFrame, path: str, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless, ids for each row of docs (doc_id, text); doc_id is the row's key.

    lossless: whether decoding the ids gave the text again.
    """
    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean, ids array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, temperature)
        for b in portions(batches, ROWS):
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            ids, at = model.sample(texts, keys, seed)
            parts = [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            same = [model.decode(p.tolist()) == (t or "") for p, t in zip(parts, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                    pa.array(same, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id, ids); null ids give the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, 1.0)
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
