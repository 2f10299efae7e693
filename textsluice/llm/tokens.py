"""Token ids of whole texts by a public tokenizer, word by word from a cache.

The tokenizer's own rules never join characters across white space, so a text's
ids are its words' ids in a row. Distinct words of a batch are found by Arrow's
dictionary encoding; only words not met before go through the tokenizer.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
CACHE_WORDS = 200_000
CHUNK_BYTES = 4_000_000


#: Marks that always stand apart from the letters before them.
MARKS = ".,;:!?"


def _plain(word: str) -> bool:
    """Letters only, before and after lower-casing, and in composed form."""
    return word.isalpha() and (word.isascii() or (word.lower().isalpha() and unicodedata.is_normalized("NFC", word)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most`` bytes, with the row each begins at; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield begin, texts.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if len(texts) > begin:
        yield begin, texts.slice(begin)


class WordEncoder:
    """Encodes string arrays; null counts as empty. One per worker process.

    Tokenizers without word ends see texts whole. With word ends, plain words
    (letters only, in composed form) are encoded many at a time, since each gives
    exactly one id that ends a word; one closing mark is encoded on its own; all
    other words go through the tokenizer one by one.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words of the time before, until met again or dropped
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.by_word = suffix == "</w>"
        vocab = self.tokenizer.get_vocab()
        self.marks = dict(zip(MARKS, self._each(list(MARKS)), strict=True))
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Puts plain words into the cache."""
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            (e,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) != len(some) or cut[-1] != 4 * len(ids):
                self.cache.update(zip(some, self._each(some), strict=True))
                continue
            data, begin = ids.tobytes(), 0
            for w, end in zip(some, cut.tolist(), strict=True):
                self.cache[w] = data[begin:end]
                begin = end

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.cache) > self.cache_words:
            self.older, self.cache = self.cache, {}
        cache, older, plain, other, ended = self.cache, self.older, {}, [], []
        for w in words:
            if w in cache:
                continue
            if w in older:
                cache[w] = older[w]
                continue
            core, mark = (w[:-1], w[-1]) if w and w[-1] in MARKS else (w, "")
            if _plain(core):
                if core not in cache and core not in plain:
                    if core in older:
                        cache[core] = older[core]
                    else:
                        plain[core] = None
                if mark:
                    ended.append(w)
            else:
                other.append(w)
        self._learn(list(plain))
        for i in range(0, len(other), 10_000):
            some = other[i : i + 10_000]
            cache.update(zip(some, self._each(some), strict=True))
        for w in ended:
            cache[w] = cache[w[:-1]] + self.marks[w[-1]]
        return [cache[w] for w in words]

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        end = np.array([END_ID], "<u4")
        lengths = np.array([len(x) + 1 for x in found], np.int64)
        return np.concatenate([x for ids in found for x in (ids, end)] or [end[:0]]), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and the number of each text's ids."""
        if not self.by_word:
            return self._whole(pc.fill_null(texts, ""))
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        known = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = size[code] if len(code) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((begin[code] if len(code) else n) - upto[:-1], n) + np.arange(upto[-1])]
        lengths = upto[offsets[1:]] - upto[offsets[:-1]] + 1
        out = np.full(len(ids) + len(lengths), END_ID, "<u4")
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = ids
        return out, lengths


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The encoder of this worker process, kept with its cache from task to task."""
    return WordEncoder(path, cache_words)
