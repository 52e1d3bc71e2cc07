"""Token ids of whole texts, each distinct piece between ASCII blanks encoded once per worker.

For a tokenizer that drops white space before anything else, the ids of a text are those of its
blank-separated pieces one after another, and most pieces come again and again.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from flowlake.llm.rows import once_per_worker

# Pieces and runs a worker remembers before it starts afresh (about 200 bytes each); pieces are soon put together from runs.
_PIECES = 300_000
_RUNS_KEPT = 400_000
# Texts are encoded in groups of about so many bytes.
_GROUP = 2_000_000
# Printable ASCII and the composed Latin letters of one code page: normalising them is lower-casing.
_PLAIN = re.compile(r"[\n!-~À-ÖØ-öø-ÿ]*")
# The pre-tokenizer's pattern for such text, lower-cased (fixed by the vocabulary file), and the piece break.
_RUNS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
# Stands for the break among ids, which all have zero upper bytes.
_BREAK = b"\xff\xff\xff\xff"


def _is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


class _Runs(dict):
    """Lower-cased run of letters or signs -> ids as bytes."""

    def __init__(self, tokens, spelled):
        super().__init__({"\n": _BREAK})
        self._tokens = tokens
        self._spelled = spelled

    def __missing__(self, run: str) -> bytes:
        spelled = run if run.isascii() else run.translate(self._spelled)
        ids = self[run] = array("I", [t.id for t in self._tokens(spelled)]).tobytes()
        return ids


class PieceCodec:
    """Encoder for a lower-casing word-end BPE of the ``word_bpe`` kind; ids are little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._spelled = {n: spell(chr(n))[0][0] for n in range(0xC0, 0x100)}
        self._known: dict[bytes, bytes] = {}
        self._forget()
        self.sentence_end = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for token, number in self._tokenizer.get_vocab().items():
            self.sentence_end[number] = token.removesuffix("</w>").endswith((".", "!", "?"))

    def _forget(self) -> None:
        self._runs = _Runs(self._tokenizer.model.tokenize, self._spelled)

    def _learn(self, pieces: list[bytes]) -> None:
        joined = b"\n".join(pieces).decode()
        if not _is_plain(joined):
            texts = joined.split("\n")
            for piece, text in zip(pieces, texts):
                if not _is_plain(text):
                    ids = self._tokenizer.encode(text, add_special_tokens=False).ids
                    self._known[piece] = np.array(ids, "<u4").tobytes()
            pieces = [p for p in pieces if p not in self._known]
            joined = b"\n".join(pieces).decode()
        if pieces:
            ids = b"".join(map(self._runs.__getitem__, _RUNS.findall(joined.lower())))
            self._known.update(zip(pieces, ids.split(_BREAK), strict=True))

    def _group(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        pieces = set().union(*split)
        new = pieces.difference(self._known)
        if len(self._known) + len(new) > _PIECES:
            self._known.clear()
            new = pieces
        if len(self._runs) > _RUNS_KEPT:
            self._forget()
        self._learn(list(new))
        find = self._known.__getitem__
        return [b"".join(map(find, s)) for s in split]

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > _GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


def codec(path: str) -> PieceCodec:
    return once_per_worker(("piece codec", path), lambda: PieceCodec(path))
