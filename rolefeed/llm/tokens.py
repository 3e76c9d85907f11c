"""Token ids of many texts with the word-level tokenizer of a vocabulary file.

A word that occurs again is not encoded again. Texts are cut at spaces and line feeds, where the
vocabulary's pre-tokenizer cuts in any case. A word of Latin letters with punctuation behind it is
cut there too and goes straight to the vocabulary's merges; any other word takes the whole way.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Entries of a store that are certain to be kept; twice as many are held at most.
KEPT_WORDS = 100_000
TAIL = ".,!?;:$%&*#|"
# Text cut into words at once; bounds a task's memory, not what is read.
BLOCK_BYTES = 2 << 20


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable,
    else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class Store(dict):
    """What was looked up lately; the oldest half goes when it is full."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def tidy(self) -> None:
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()


class WordEncoder:
    """``encode(text)`` gives the ids that ``tokenizers`` gives for the text, without those it
    adds at the ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        # The short way holds for this kind of vocabulary only.
        steps = [s["type"] for s in made["pre_tokenizer"].get("pretokenizers", [])]
        cleans = [s["type"] for s in (made.get("normalizer") or {}).get("normalizers", [])]
        self.short = steps == ["Split", "ByteLevel"] and cleans == ["NFC", "Replace", "Lowercase"]
        self.letters = {chr(c): "".join(_byte_characters()[b] for b in chr(c).encode())
                        for c in range(0x100) if chr(c).isalpha()}
        self.latin = str.maketrans({k: v for k, v in self.letters.items() if not k.isascii()})
        self.tails = Store(self._whole)
        self.runs = Store(self._run)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, letters: str) -> bytes:
        mapped = letters if letters.isascii() else letters.translate(self.latin)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        head = word.rstrip(TAIL)
        if not (self.short and head.isalpha() and (head.isascii() or max(head) < "Ā")):
            return self._whole(word)
        ids = self.runs[head.lower()]
        return ids + self.tails[word[len(head):]] if len(head) < len(word) else ids

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.large_string())))[1]

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of whole texts: index of the first, their ids (uint32), where each begins and
        the end. NULL is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
            yield low, *self._block(texts.slice(low, high - low))
            low = high

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.short and not pc.any(pc.match_substring(texts, "<|")).as_py():
            # Upper case makes no difference, but in names of special tokens.
            texts = pc.ascii_lower(texts)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        pieces = list(map(self._word, coded.dictionary.to_pylist()))
        self.runs.tidy()
        self.tails.tidy()
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        heads = np.cumsum(lengths) - lengths
        each = coded.indices.to_numpy()
        counts = lengths[each]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        place = np.repeat(heads[each] - (stops - counts), counts) + np.arange(total)
        ids = np.frombuffer(b"".join(pieces), dtype="<u4")[place]
        return ids, _bounds(words, stops)


def _bounds(words: pa.Array, stops: np.ndarray) -> np.ndarray:
    """Where each text's ids begin, and the end, from where its words end."""
    last = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
    return np.r_[0, np.r_[0, stops][last]].astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
