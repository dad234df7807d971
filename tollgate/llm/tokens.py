"""Token ids of many texts with a public word-level BPE vocabulary.

Such a tokenizer never looks across white space, so a text's ids are those of
its chunks between ASCII white space, one after the other; nor does it look
from an ASCII word into the punctuation behind it.  Each worker keeps the ids of
the short chunks that it has met of late; what is not kept is encoded again, so
the bound ``KEPT`` changes no result."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from tollgate.llm.common import UPPER

#: entries of a generation
KEPT = 120_000
#: chunks up to this many characters are kept
SHORT = 40
#: letters below are cut alike by every tokenizer version
LATIN_END = "\u0250"
VOCABULARY = "word_bpe_49k.json"
#: white space to blanks and A-Z to a-z, which the tokenizer itself does first
_PLAIN = bytes(range(256)).translate(bytes.maketrans(b"\n\t\r" + UPPER.encode(), b"   " + UPPER.lower().encode()))
#: ASCII punctuation behind an ASCII letter and before white space, where the tokenizer always
#: cuts (but for the apostrophe, which may open a word's ending)
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?= |$)", re.S)


class Kept:
    """The latest entries: a full generation is put aside, and what is met again
    there moves into the new one."""

    def __init__(self) -> None:
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def recall(self, keys: set[bytes], turn: bool = True) -> set[bytes]:
        """Makes what is known of ``keys`` available in ``new``; the others.
        A full generation is only put aside where ``turn`` allows it."""
        if turn and len(self.new) > KEPT:
            self.old, self.new = self.new, {b"": b""}
        missing = keys.difference(self.new)
        again = self.old.keys() & missing
        self.new.update((k, self.old[k]) for k in again)
        return missing - again


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kept = Kept()

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts.  Words of letters are encoded many at a time, as one
        text; the tokenizer says which of its words an id belongs to."""
        texts = [x.decode() for x in parts]
        plain = [i for i, x in enumerate(texts) if x.isalpha() and (x.isascii() or max(x) < LATIN_END)]
        out: list[bytes] = [b""] * len(parts)
        single = sorted(set(range(len(parts))).difference(plain))
        for at in range(0, len(plain), 2000):
            some = plain[at:at + 2000]
            e = self.tokenizer.encode(" ".join([texts[i] for i in some]), add_special_tokens=False)
            ids, owner = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
            ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
            if len(ends) != len(some):  # not one word each after all
                single += some
                continue
            raw, start = ids.tobytes(), 0
            for i, end in zip(some, (ends * 4).tolist(), strict=True):
                out[i] = raw[start:end]
                start = end
        for i, e in zip(single, self.tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False),
                        strict=True):
            out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def chunks(self, raw: bytes) -> list[bytes]:
        return raw.translate(_PLAIN).split(b" ")

    def _each(self, lists: list[list[bytes]], turn: bool = True) -> list[list[bytes]]:
        """Ids of each chunk of each list."""
        new = list(self.kept.recall(set().union(*lists), turn))
        known = self.kept.new
        known.update(zip(new, self._ids(new), strict=True))
        out = [list(map(known.__getitem__, x)) for x in lists]
        for c in new:
            if len(c) > SHORT:
                del known[c]
        return out

    def _cut(self, text: bytes) -> list[bytes]:
        """Chunks with the punctuation behind words apart (a text that may hold
        a control string is left as it is)."""
        plain = text.translate(_PLAIN)
        return (plain if b"<|" in plain else _TAIL.sub(rb" \g<0>", plain)).split(b" ")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit numbers."""
        return [b"".join(x) for x in self._each([self._cut(t if isinstance(t, bytes) else t.encode()) for t in texts])]

    def chunk_counts(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        """Number of ids of each chunk between white space (``chunks``) of each text."""
        new = list(self.kept.recall(set().union(*lists)))
        known = self.kept.new
        whole, rest = [], []
        for c in new:
            (whole if c[-1:].isalpha() else rest).append(c)
        known.update(zip(whole, self._ids(whole), strict=True))
        ids = self._each([self._cut(c) for c in rest], turn=False)
        known.update((c, b"".join(x)) for c, x in zip(rest, ids, strict=True))
        out = [np.fromiter(map(len, map(known.__getitem__, x)), np.int64, len(x)) // 4 for x in lists]
        for c in new:
            if len(c) > SHORT:
                known.pop(c, None)
        return out


def encoder(path: str | None = None) -> ChunkEncoder:
    """The encoder of a vocabulary file, loaded once a worker.  This package
    travels to the workers by value, so its own globals last for one task;
    what a worker keeps hangs on the installed library's module."""
    import tokenizers
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    loaded = vars(tokenizers).setdefault("_chunk_encoders", {})
    if path not in loaded:
        loaded[path] = ChunkEncoder(path)
    return loaded[path]
