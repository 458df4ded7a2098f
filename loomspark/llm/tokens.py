"""Encoding of whole texts with a public tokenizer file, by distinct chunk.

A vocabulary file that lower-cases a text and splits it by `WORDS` makes letter runs, digits and punctuation runs, none of which
crosses white space. The text can therefore be cut at ASCII white space, and between an ASCII letter or digit and punctuation
other than an apostrophe, without changing its ids. Each distinct chunk is encoded once per worker and
kept in a bounded table, which a worker drops once it has been idle for a while. Texts with "<|" may hold special tokens and are encoded in one piece, as is every text for any other kind of file.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a worker keeps, and characters of them; beyond either the table starts anew.
CHUNKS, CHARACTERS = 600_000, 16_000_000
#: Seconds without use after which a worker drops an encoder: workers outlive their stage, and what runs next needs the memory.
IDLE = 4.0
#: Fixed value: the pattern by which a file must split for the chunks below to be right.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_open: dict[str, "Encoder"] = {}


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        steps = (told.get("normalizer") or {}).get("normalizers", [])
        splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_chunk = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex") == WORDS and splits[0].get("behavior") == "Removed"
        self.last = time.monotonic()
        self._clear()

    def _clear(self) -> None:
        self.number, self.used, self.characters = _Numbers(), 0, 0
        self.flat, self.size, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        self.characters += sum(map(len, new))
        first, ids, owner = len(self.number) - len(new), [], []
        for b in range(0, len(new), 512):
            e = self.tokenizer.encode(new[b : b + 512], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            owner.append(np.array(e.word_ids, np.int64) + b)
        ids = np.concatenate(ids)
        count = np.bincount(np.concatenate(owner), minlength=len(new))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.number) > len(self.size):
            self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.at))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + len(new)] = count
        self.at[first : first + len(new)] = self.used + np.cumsum(count) - count
        self.used += len(ids)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none), without special tokens of the library's own."""
        self.last = time.monotonic()
        whole = {i for i, t in enumerate(texts) if t and ("<|" in t or not self.by_chunk)}
        plain = pa.array(["" if t is None or i in whole else re.sub(r"[\n\t\r]", " ", t) for i, t in enumerate(texts)], pa.large_string())
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z0-9])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        split = pc.split_pattern(plain, " ")
        coded = pc.dictionary_encode(split.values)
        if len(self.number) > CHUNKS or self.characters > CHARACTERS:
            self._clear()
        words = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.new:
            self._learn()
        word = number[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[word]
        start = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(start[-1]) + np.repeat(self.at[word] - start[:-1], size)]
        cut = start[split.offsets.to_numpy()]
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if i in whole else ids[cut[i] : cut[i + 1]]
            for i, t in enumerate(texts)
        ]


def _drop_when_idle(path: str) -> None:
    """Waits until the encoder of a file is idle and lets go of it. A task that still holds it is not disturbed."""
    while (e := _open.get(path)) and time.monotonic() - e.last < IDLE:
        del e
        time.sleep(IDLE / 4)
    _open.pop(path, None)
    pa.default_memory_pool().release_unused()


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by the worker from task to task until it is idle."""
    e = _open.get(path)
    if e is None:
        e = _open[path] = Encoder(path)
        threading.Thread(target=_drop_when_idle, args=(path,), daemon=True).start()
    e.last = time.monotonic()
    return e


def pieces_of(texts: list[str | None], limit: int = 3_000_000):
    """(index of the first, texts) of about limit characters at most, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
