"""Token ids of whole texts with a public tokenizer, through a bounded cache of word ids."""

from __future__ import annotations

import gc
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
# Entries of one generation of a cache; two generations are held.
CACHE_WORDS = 120_000

# Letters of which each lower-cases to one letter and is its own composed form, then closing marks.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = ".,;:!?|)#$%&*"
_PLAIN = f"^[{_LETTERS}]+[{_MARKS}]*$"
_LONG = 200
_JOINED = 256


class Generations(dict):
    """A cache of two generations: what is used again moves on, the rest is dropped with the older one."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys that must be computed; room is made before, and keys of the older generation are kept."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = keys - self.keys()
        kept = new & self.old.keys()
        self.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        return new - kept


class WordEncoder:
    """Encodes texts as the tokenizer does, word by word.

    The tokenizer drops white space before it merges, so the ids of a text are those of its pieces
    between spaces and line feeds, joined. Arrow finds the distinct pieces of a batch and cuts plain
    ones into a word and closing marks; distinct words meet the cache, new ones are encoded many at
    a time and told apart by the tokens that end a word. Other pieces go to the tokenizer alone.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words = Generations(cache_words)
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._ends = np.zeros(self.vocabulary, dtype=bool)
        self._ends[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one uint32 array, and where each text starts (one offset more than texts).

        Null texts have no ids, no special tokens are added.
        """
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and passes over a large cache are slow
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        plain = pc.and_(pc.match_substring_regex(pieces, _PLAIN), pc.less(pc.binary_length(pieces), _LONG))
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        chosen = pieces.filter(pa.array(plain))
        words = pc.utf8_lower(pc.utf8_rtrim(chosen, _MARKS)).dictionary_encode()
        marks = pc.replace_substring_regex(chosen, f"^[{_LETTERS}]+", "").dictionary_encode()
        others = pieces.filter(pa.array(~plain)).to_pylist()

        known, closing, alone = (
            self._known(words.dictionary.to_pylist()),
            self._alone(marks.dictionary.to_pylist()),
            self._alone(others),
        )
        units = [b"", *known, *closing, *alone]
        of_piece = np.zeros((len(pieces), 2), dtype=np.int32)
        of_piece[plain, 0] = words.indices.to_numpy(zero_copy_only=False) + 1
        of_piece[plain, 1] = marks.indices.to_numpy(zero_copy_only=False) + (1 + len(known))
        of_piece[~plain, 0] = np.arange(len(others), dtype=np.int32) + (1 + len(known) + len(closing))
        sizes = np.fromiter(map(len, units), dtype=np.int32, count=len(units)) // 4
        ids, ends = _joined(np.frombuffer(b"".join(units), dtype="<u4"), sizes, of_piece.ravel())
        ids, ends = _joined(ids, np.diff(ends[::2]), codes)
        return ids, ends[lists.offsets.to_numpy()].astype(np.int64)

    def _known(self, words: list[str]) -> list[bytes]:
        unknown = sorted(self._words.missing(set(words)))
        groups = [unknown[i : i + _JOINED] for i in range(0, len(unknown), _JOINED)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            data, cuts = ids.tobytes(), (np.flatnonzero(self._ends[ids]) + 1) * 4
            starts = [0, *cuts[:-1].tolist()]
            self._words.update(zip(group, (data[a:b] for a, b in zip(starts, cuts.tolist(), strict=True)), strict=True))
        return list(map(self._words.__getitem__, words))

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self._ids(pieces)]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, dtype="<u4") for f in found]


def _joined(ids: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` named by ``used``, one after the other, and their ends after a leading zero."""
    starts = np.zeros(len(sizes), dtype=np.int32)
    np.cumsum(sizes[:-1], out=starts[1:])
    taken = sizes[used]
    ends = np.zeros(len(taken) + 1, dtype=np.int32)
    np.cumsum(taken, out=ends[1:])
    at = np.repeat(starts[used] - ends[:-1], taken)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], ends


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for ``path``; its cache lives on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
