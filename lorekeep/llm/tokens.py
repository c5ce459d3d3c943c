"""Tokenizing whole columns with a word-level BPE file: each distinct word of a slice is encoded once.

Rules of a kind (RULES) make this exact: their normalizer and their splitter never look across white space, and their model never looks across
the pieces that the splitter makes. A file with any other rules has its whole texts encoded by the tokenizer itself. Words of Latin letters, ASCII digits and marks are split by the same pattern here and
their pieces go straight to the model; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import threading
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import words

#: Entries of a worker's piece cache; a full cache is emptied, which costs time and no results.
CACHE = 300_000
_LATIN = "a-zß-öø-ÿ"
#: One piece of a plain word in lower case, with a space behind it.
_PIECE, _SPACED = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s0-9{_LATIN}]+)", r"\1 "
#: Printable ASCII and Latin letters: no combining marks, no white space, no other numbers or letters. A '<' may open an added token.
_PLAIN = "^[!-;=-~ßà-öø-ÿÀ-ÖØ-Þ]+$"

#: The normalizer, splitter and kind of model that words may be encoded one by one under.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def by_words(rules: dict) -> bool:
    """True if a tokenizer's file has RULES, a merging model without chance in it, and no added token that white space or lower case could reach into."""
    model, added = rules.get("model") or {}, rules.get("added_tokens") or []
    exact = model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token")
    plain = all(t["content"].startswith("<") and not t["content"].isspace() and " " not in t["content"] and not any(t[k] for k in ("lstrip", "rstrip", "normalized", "single_word")) for t in added)
    return exact and plain and all(rules.get(k) == v for k, v in RULES.items())


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    _made: dict[str, WordTokenizer] = {}
    _lock = threading.Lock()

    def __init__(self, path: str) -> None:
        self.full = Tokenizer.from_file(path)
        self.by_words = by_words(json.loads(self.full.to_str()))
        self.model = self.full.model
        self.letters = _byte_letters()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(self.full.get_vocab_size()))  # one object for each id, shared by all cached pieces

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        with cls._lock:
            if path not in cls._made:
                cls._made[path] = cls(path)
            return cls._made[path]

    def _piece(self, piece: str) -> tuple[int, ...]:
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        numbers = self.numbers
        ids = self.cache[piece] = tuple([numbers[t.id] for t in self.model.tokenize(text)])
        return ids

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and the number of each word's. Splitting is done by Arrow; Python sees distinct pieces only."""
        plain = pc.match_substring_regex(distinct, _PLAIN)
        known = plain.to_numpy(zero_copy_only=False)
        if len(self.cache) > CACHE:
            self.cache.clear()
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(distinct.filter(plain)), _PIECE, _SPACED))
        flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        cache, piece = self.cache, self._piece
        each = [cache.get(p) or piece(p) for p in coded.dictionary.to_pylist()]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.empty(0, np.int64)
        ids, ends = _gathered(each, code)
        sizes = np.zeros(len(distinct), np.int64)
        sizes[known] = np.diff(ends[bounds])
        if known.all():
            return ids, sizes
        odd = [self.full.encode(w, add_special_tokens=False).ids for w in distinct.filter(pc.invert(plain)).to_pylist()]
        sizes[~known] = [len(x) for x in odd]
        out = np.empty(int(sizes.sum()), np.int64)
        of_plain = np.repeat(known, sizes)
        out[of_plain] = ids
        out[~of_plain] = [i for x in odd for i in x]
        return out, sizes

    def encode(self, text: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's begin (and the end)."""
        if not self.by_words:
            each = [self.full.encode(t or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id]) for t in text.to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            return np.fromiter(chain.from_iterable(each), np.int64, int(bounds[-1])), bounds
        flat, at = words(text)
        coded = flat.dictionary_encode()
        pool, size = self._words(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
        ids, ends = _expanded(pool, size, code)
        bounds = ends[at]
        if end_id is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def _expanded(pool: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` (of the given sizes) that ``code`` names, one behind the other, and where each begins (and the end)."""
    first, n = np.cumsum(size) - size, size[code]
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pool[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])] if len(code) else np.empty(0, np.int64), ends


def _gathered(each: list[tuple[int, ...]], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, each), np.int64, len(each))
    return _expanded(np.fromiter(chain.from_iterable(each), np.int64, int(size.sum())), size, code)
