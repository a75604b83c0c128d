"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

The tokenizer of ``word_bpe_49k.json`` never merges across white space, so the ids of a text are the ids of its
white-space words in order; a worker keeps the ids of the words it has met (at most ``CACHE_WORDS``, then it
starts anew) as Arrow and NumPy arrays, some 40 bytes a word. ``Encoder(path, by_word=False)`` encodes whole texts, for tokenizers without that property.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 600_000
CLOSING = ".,;:!?|#$%&*()"
#: A word that closes with punctuation behind a letter: a pre-token ends between the two, so they are encoded apart.
CLOSED = rf"^(?P<base>.*\p{{L}})(?P<tail>[{CLOSING}]+)$"
#: The characters that stand for bytes in the tokenizer's vocabulary: printable Latin-1 as it is, the others from 256 on in turn.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)

    def add(self, words: pa.Array, ids: list[list[int]]) -> None:
        n, sizes = len(self.words), np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(sizes.sum())
        while n + len(words) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.words = pa.concat_arrays([self.words, words])
        self.size[n : n + len(words)] = sizes
        self.first[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.used += total

    def learn(self, words: pa.Array) -> np.ndarray:
        """Places of the distinct words; those not met yet are encoded."""
        place = pc.index_in(words, self.words)
        if place.null_count:
            if len(self.words) and len(self.words) + place.null_count > CACHE_WORDS:
                self.clear()
                place = pa.nulls(len(words), pa.int32())
            at = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
            n, fresh = len(self.words), words.take(pa.array(at))
            self.add(fresh, self.encode_words(fresh.to_pylist()))
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).copy()
            place[at] = n + np.arange(len(at))
            return place
        return place.to_numpy(zero_copy_only=False)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. A word of letters alone, lower-case and composed, is one pre-token that normalisation leaves as it is: its bytes go
        straight to the model."""
        tokenize, shown, out, rest = self.tokenizer.model.tokenize, BYTE_CHARACTERS, [None] * len(words), []
        for i, w in enumerate(words):
            if w.isalpha() and (w.isascii() and w.islower() or w == w.lower() and unicodedata.is_normalized("NFC", w)):
                out[i] = [t.id for t in tokenize(w if w.isascii() else "".join([shown[b] for b in w.encode()]))]
            else:
                rest.append(i)
        for k in range(0, len(rest), 5000):
            part = rest[k : k + 5000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, ``end`` after each, and the position where each text's ids start (one more at the end)."""
        if not self.by_word:
            each = [np.array([*e.ids, end], np.int32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(each or [np.empty(0, np.int32)]), np.concatenate(([0], np.cumsum([len(e) for e in each]))).astype(np.int64)
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))  # letter case is lost anyway
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        # punctuation at the end is set apart only where there is some
        open_at = np.flatnonzero(pc.not_equal(pc.ascii_rtrim(words, CLOSING), words).to_numpy(zero_copy_only=False))
        closed = pc.extract_regex(words.take(pa.array(open_at)), CLOSED)
        split = closed.is_valid().to_numpy(zero_copy_only=False)
        open_at, closed = open_at[split], closed.filter(pa.array(split))
        mask = np.zeros(len(words), bool)
        mask[open_at] = True
        bases = pc.replace_with_mask(words, pa.array(mask), pc.struct_field(closed, "base")).dictionary_encode()
        tails = pc.struct_field(closed, "tail").dictionary_encode()
        both = pa.concat_arrays([bases.dictionary, tails.dictionary, pa.array([""])]).dictionary_encode()
        index = self.learn(both.dictionary)[both.indices.to_numpy()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        base = index[: len(bases.dictionary)][bases.indices.to_numpy()]
        tail = np.full(len(words), index[-1])  # the empty word
        tail[open_at] = index[len(bases.dictionary) : -1][tails.indices.to_numpy()]
        # the ids of each dictionary word, side by side; the last "word" is the end id
        first, size = (np.stack([x[base], x[tail]], axis=1).ravel() for x in (self.first, self.size))
        ids = np.append(self.ids[ragged(first, size)], np.int32(end))
        size = np.append(size.reshape(-1, 2).sum(axis=1), 1).astype(np.int32)
        first = np.cumsum(size, dtype=np.int64) - size
        word = np.insert(codes, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)), len(words))
        flat = ids[ragged(first[word], size[word])]
        starts = np.concatenate(([0], np.cumsum(size[word], dtype=np.int64)))
        return flat, np.concatenate(([0], starts[1:][word == len(words)]))


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] places, for every i in turn."""
    ends = np.cumsum(size, dtype=np.int64)
    out = np.repeat(first - ends + size, size)
    out += np.arange(len(out))
    return out


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool = True) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path, by_word)
