"""Encoding and decoding with a piece vocabulary by unigram Viterbi over a double-array trie.

A text gets a leading space, spaces become the marker, and the segmentation with the highest sum of the pieces' log scores wins.
A character that no piece covers costs UNKNOWN less than the worst piece and is written as byte pieces.
No piece worth using holds a marker behind another character, so every marker begins a segment of its own, and each distinct segment of a slice is solved
once, many of them at the same time: one step of the trie for all segments, then one comparison of scores.

Vocabularies trained by pair merging carry ranks in place of log probabilities; those become log scores by Zipf's law, -log(rank + 2).
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_columns, in_batches, slices

MARK = "▁"
UNKNOWN = 10.0
#: Merges' scores below this stand for pieces that are never chosen.
NEVER = -1e6


class DoubleArray:
    """State s has a child by code c if check[base[s] + c] == s; the child is base[s] + c, and 1 is the root."""

    def __init__(self, keys: list[list[int]]) -> None:
        root: dict = {}
        for n, key in enumerate(keys):
            at = root
            for c in key:
                at = at.setdefault(c, {})
            at[0] = n
        size = 1024 + 4 * sum(map(len, keys))
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[:2] = 0
        todo, start = [(1, root)], 2
        while todo:
            state, node = todo.pop()
            value[state] = node.get(0, -1)
            children = sorted(c for c in node if c)
            if not children:
                continue
            offsets = np.array(children)
            while check[start] >= 0:
                start += 1
            first = start
            while True:  # the next free place for the first child, where all others are free too
                b = first - children[0]
                if b + children[-1] >= len(check):
                    grow = len(check) + children[-1]
                    base, check, value = (np.concatenate([a, np.full(grow, f, np.int64)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                if b >= 0 and (check[b + offsets] < 0).all():
                    break
                first += 1
                while first < len(check) and check[first] >= 0:
                    first += 1
            base[state] = b
            check[b + offsets] = state
            todo += [(b + c, node[c]) for c in children]
        self.base, self.check, self.value = base, check, value
        # A code may lead past the end: pad by the largest one.
        most = max((c for k in keys for c in k), default=0) + 1
        self.check = np.concatenate([self.check, np.full(most, -1, np.int64)])
        self.value = np.concatenate([self.value, np.full(most, -1, np.int64)])
        self.base = np.concatenate([self.base, np.zeros(most, np.int64)])

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Children of states by codes, 0 where there is none (state 0 has none)."""
        child = self.base[state] + code
        return np.where((state > 0) & (code > 0) & (self.check[child] == state), child, 0)


def log_scores(raw: list[float], pieces: list[str], special: set[int]) -> list[float]:
    """A file's scores as log scores: merge ranks (whole numbers, another one for each piece in use) by Zipf's law, true log scores as they are.

    A vocabulary of true log scores whose pieces reach across white space is a ValueError, as its segments can't be solved one by one.
    """
    used = [i for i in range(len(raw)) if i not in special and raw[i] > NEVER]
    if all(float(raw[i]).is_integer() for i in used) and len({raw[i] for i in used}) == len(used) > 1:
        scores = [s if s <= NEVER else -float(np.log(2 - s)) for s in raw]
        # The marker itself has no rank, as it is no merge: it ranks last.
        if MARK in pieces:
            scores[pieces.index(MARK)] = min(scores[i] for i in used)
        return scores
    if across := [pieces[i] for i in used if MARK in pieces[i][1:]]:
        raise ValueError(f"pieces across white space: {across[:3]}")
    return [float(s) for s in raw]


class Unigram:
    _made: dict[str, Unigram] = {}
    _lock = threading.Lock()

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int] | None, special: set[int]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        self.used = [i for i, (p, s) in enumerate(zip(pieces, scores)) if i not in special and p and s > NEVER and MARK not in p[1:]]
        alphabet = sorted({c for i in self.used for c in pieces[i]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.trie = DoubleArray([self.code[[ord(c) for c in pieces[i]]].tolist() for i in self.used])
        self.score = np.array([scores[i] for i in self.used])
        self.id = np.array(self.used, np.int64)
        self.unknown = float(self.score.min()) - UNKNOWN
        self.longest = max(len(pieces[i]) for i in self.used)
        self.unk_id = next(iter(sorted(special)), 0)

    @classmethod
    def at(cls, path: str) -> Unigram:
        """The vocabulary of a model file; made once in each process."""
        with cls._lock:
            if path not in cls._made:
                m = sentencepiece.SentencePieceProcessor(model_file=path)
                n = m.get_piece_size()
                special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)}
                scores = log_scores([m.get_score(i) for i in range(n)], [m.id_to_piece(i) for i in range(n)], special)
                bytes_ = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
                cls._made[path] = cls([m.id_to_piece(i) for i in range(n)], scores, bytes_ if all(m.is_byte(i) for i in bytes_) else None, special)
            return cls._made[path]

    def segment(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment by Viterbi."""
        out: list[list[int]] = [[] for _ in segments]
        by: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by.setdefault(max(8, 1 << max(0, len(s) - 1).bit_length()), []).append(i)
        for width, rows in by.items():
            step = max(1, (1 << 20) // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._solve([segments[i] for i in part])):
                    out[i] = ids
        return out

    def _solve(self, segments: list[str]) -> list[list[int]]:
        size = np.array([len(s) for s in segments])
        n, width = len(segments), int(size.max())
        points = np.zeros((n, width), np.int64)
        flat = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        points[np.arange(width) < size[:, None]] = flat
        code = self.code[points].astype(np.int64)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1, np.int64)
        for i in range(width):
            rows = np.flatnonzero(size > i)
            state = np.ones(len(rows), np.int64)
            for j in range(i, min(width, i + self.longest)):
                state = self.trie.step(state, code[rows, j])
                alive = state > 0
                if not alive.all():
                    if j == i:
                        self._offer(best, came, piece, rows[~alive], i, i + 1, self.unknown, -1)
                    rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                v = self.trie.value[state]
                hit = v >= 0
                if j == i and not hit.all():
                    self._offer(best, came, piece, rows[~hit], i, i + 1, self.unknown, -1)
                if hit.any():
                    self._offer(best, came, piece, rows[hit], i, j + 1, self.score[v[hit]], v[hit])
        out = []
        for k, s in enumerate(segments):
            at, ids = len(s), []
            while at:
                p, c = int(piece[k, at]), int(came[k, at])
                if p >= 0:
                    ids.append(int(self.id[p]))
                elif self.byte_ids is None:
                    ids.append(self.unk_id)
                else:
                    ids += [self.byte_ids[b] for b in reversed(s[c:at].encode("utf-8", "surrogatepass"))]
                at = c
            out.append(ids[::-1])
        return out

    @staticmethod
    def _offer(best, came, piece, rows, i, end, score, value) -> None:
        total = best[rows, i] + score
        better = total > best[rows, end]
        at = rows[better]
        best[at, end], came[at, end] = total[better], i
        piece[at, end] = value[better] if isinstance(value, np.ndarray) else value

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's begin (and the end). Empty texts have none."""
        text = pc.fill_null(text, "")
        some = pc.greater(pc.binary_length(text), 0)
        marked = pc.replace_substring(pc.if_else(some, pc.binary_join_element_wise("", text, " "), ""), " ", " " + MARK)
        lists = pc.split_pattern(marked, " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        flat = flat.filter(pa.array(full))
        at = np.concatenate([[0], np.cumsum(full)])[offsets]
        coded = flat.dictionary_encode()
        each = self.segment(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each))
        pool = np.fromiter((i for x in each for i in x), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size[code])])
        ids = pool[np.repeat(first[code] - ends[:-1], size[code]) + np.arange(ends[-1])] if len(code) else np.empty(0, np.int64)
        return ids, ends[at]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of runs of ids: byte pieces join to characters, markers become spaces and the leading one goes."""
        words = self.__dict__.get("_words")
        if words is None:
            words = [p.replace(MARK, " ").encode() for p in self.pieces]
            for b, i in enumerate(self.byte_ids or []):
                words[i] = bytes([b])
            self._words = words
        out = []
        for a, b in zip(at.tolist(), at[1:].tolist()):
            text = b"".join([words[i] for i in ids[a:b].tolist()]).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def _codec(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.at(path)
        for part in slices(batches, "text", 2 << 20):
            ids, at = model.encode(part.column("text"))
            back = model.decode(ids, at)
            same = [x == y for x, y in zip(back, pc.fill_null(part.column("text"), "").to_pylist())]
            small = ids.astype("<u4")
            crc = [zlib.crc32(small[a:b].tobytes()) for a, b in zip(at.tolist(), at[1:].tolist())]
            decoded = [zlib.crc32(x.encode()) for x in back]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array(decoded, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "same"]
            )

    return run


def _encode_all(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            ids, at = Unigram.at(path).encode(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def _decode_all(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(Unigram.at(path).decode(np.array([i for x in lists for i in x], np.int64), at), pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of each row of ``docs`` (doc_id, text); a null or empty text has no ids."""
    has_columns(docs, "doc_id", "text")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(in_batches, _encode_all(model), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row (doc_id, ids)."""
    has_columns(encoded, "doc_id", "ids")
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).transform(in_batches, _decode_all(model), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes each row of ``docs`` (doc_id, text): doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32 and same.

    A null text is as an empty one, which has no ids. Rows are independent of each other: repeated rows, null ids and further columns don't matter.
    An empty table gives an empty result.
    """
    has_columns(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_batches, _codec(model), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean")
