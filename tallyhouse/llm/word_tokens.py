"""Ids of a lower-casing word vocabulary, by the tokenizer library, each distinct match asked for once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from tallyhouse.llm.units import Memory

CHUNK = 1 << 19  # characters that are cut at a time; a longer text is cut at spaces
_encoders: dict[str, WordEncoder] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]  # ids of their own, wherever they stand
        words = self.library.get_vocab()
        if len(words) > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        self.closes = np.zeros(1 << 16, bool)  # ids that end a match
        self.closes[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.memory = Memory(self._learn, join_space=False, dtype=np.uint16)

    def _learn(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Matches are encoded side by side, many to a call; each ends with an id that closes it."""
        out = []
        for at in range(0, len(matches), 2000):
            line = b" ".join(matches[at : at + 2000]).decode("latin-1")
            out.append(np.array(self.library.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint16))
        ids = np.concatenate(out)
        ends = np.flatnonzero(self.closes[ids])
        if len(ends) != len(matches):
            raise ValueError("a match was split further than the pattern says")
        return ids, np.diff(ends, prepend=-1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 16-bit integers."""
        packed: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if held:
                flat, counts = self.memory.encode([x for _, x in held])
                raw, at = flat.astype("<u2").tobytes(), 0
                for (i, _), n in zip(held, counts.tolist(), strict=True):
                    packed[i].append(raw[2 * at : 2 * (at + n)])
                    at += n
                held.clear()

        for i, text in enumerate(texts):
            for part in _parts(text):
                try:
                    if any(word in part for word in self.special):
                        raise ValueError
                    held.append((i, part.lower().encode("latin-1")))
                except ValueError:  # special spellings, or any other letters: the library sees the text as it is
                    flush()
                    ids = self.library.encode(part, add_special_tokens=False).ids
                    packed[i].append(np.array(ids, "<u2").tobytes())
                size += len(part)
                if size > CHUNK:
                    flush()
                    size = 0
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in packed]


def _parts(text: str) -> Iterator[str]:
    """The text, or what lies between some of its spaces, as no id reaches across one."""
    at = 0
    while len(text) - at > CHUNK and (end := text.find(" ", at + CHUNK)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text
