"""Byte-level BPE encoding and decoding by a pair occurrence index.

A vocabulary file gives ranked merges.  Texts are cut into chunks by the public
byte-level pattern; merges never cross a chunk.  Every task works through its
partition in slices of bounded size: the chunks of a slice that it does not know
yet stand one after the other in one array of symbols, and an index maps each
pair that has a rank to all positions where it stands.  The ranks that have
positions are applied in ascending order: all places of the pair are merged at
once, and only the pairs at both sides of these places enter the lists anew.  In
a trained vocabulary every pair ranks behind the merges that made its parts
(checked when the file is loaded), so this gives what merging one place at a
time gives.

What is known of short chunks is kept in bounded generations; what is not kept
is worked out again, so the bound changes no result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.tokens import SHORT, Kept

VOCABULARY = "byte_bpe_50k.json"
#: characters of a slice
SLICE = 4_000_000
#: what byte-level vocabularies split at (fixed value of the public pattern)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same for texts of characters up to U+024F, letters, numbers and white space written out
LATIN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
         r"| ?[^\t-\r \x85\xa00-9\xb2\xb3\xb9\xbc-\xbeA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
         r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
#: characters whose classes no Unicode version changed since; a text with others is cut by the library
STEADY = "\\x00-\u0557\u2010-\u2064\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where it is a printable Latin-1 character, else the next one from
    U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id of a vocabulary file's content, control strings included."""
    vocab, added, byte_of = spec["model"]["vocab"], spec["added_tokens"], printable_bytes()
    out = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token)
    for t in added:
        out[t["id"]] = t["content"].encode()
    return out


def decode_ids(bytes_of: list[bytes], ids: bytes) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class PairIndexEncoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.bytes_of = token_bytes(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in printable_bytes().items():
            self.byte_id[b] = vocab[c]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        first = np.full(len(self.bytes_of), -1, np.int64)
        first[self.made[::-1]] = np.arange(len(merges))[::-1]
        rank = np.arange(len(merges))
        if (np.maximum(first[self.left], first[self.right]) >= rank).any():
            raise ValueError("a pair ranks before a merge that makes one of its parts")
        order = np.argsort(self.left << 32 | self.right, kind="stable")
        self.keys, self.rank_of = (self.left << 32 | self.right)[order], rank[order]
        self.split, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.beyond_latin = re.compile("[^\x00-\u024f]").search
        self.unsteady = regex.compile(f"[^{STEADY}]").search
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                        ).split if self.special else None
        self.cut_at = regex.compile(r"\S(?=\s)").search
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.kept = Kept()

    # ------------------------------------------------------------- chunks ---
    def pieces(self, text: str, size: int = SLICE) -> Iterator[str]:
        """The text in pieces of about ``size`` characters, cut before white
        space, where chunks always end."""
        at = 0
        while len(text) - at > size:
            found = self.cut_at(text, at + size)
            if not found:
                break
            yield text[at:found.end()]
            at = found.end()
        yield text[at:]

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text, its control strings as chunks of their own."""
        if self.special_at and any(s in text for s in self.special):
            return [c for i, part in enumerate(self.special_at(text))
                    for c in ([part] if i % 2 else self._plain_chunks(part))]
        return self._plain_chunks(text)

    def _plain_chunks(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond_latin(text):
            return self.split_latin(text)
        if self.unsteady(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.split(text)

    # ----------------------------------------------------------- encoding ---
    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks (none empty) as little-endian unsigned 32-bit numbers."""
        if not chunks:
            return []
        ends = np.cumsum([len(c) for c in chunks])
        starts = np.concatenate(([0], ends[:-1]))
        n = int(ends[-1])
        # position n stands for "nothing": its symbol is in no pair
        sym = np.append(self.byte_id[np.frombuffer(b"".join(chunks), np.uint8)], -1)
        nxt, prv = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
        nxt[ends - 1], prv[starts] = n, n
        mark = np.zeros(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that start at these positions into the lists of their ranks."""
            key = sym[at] << 32 | sym[nxt[at]]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            if not hit.any():
                return
            ranks, at = self.rank_of[place[hit]], at[hit]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            edge = np.flatnonzero(np.diff(ranks)) + 1
            lo = 0
            for hi in (*edge.tolist(), len(ranks)):
                r = int(ranks[lo])
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)
                lo = hi

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            left, right = self.left[r], self.right[r]
            at = at[(sym[at] == left) & (sym[nxt[at]] == right)]   # what earlier ranks took is no longer there
            if left == right and len(at) > 1:
                # in a row of equal symbols every second place is merged, from the left
                at = np.sort(at)
                fresh = np.append(True, nxt[at[:-1]] != at[1:])
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(fresh, i, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.made[r], -2
            nxt[at], prv[after] = after, at
            prv[n] = n
            before = prv[at]
            mark[at] = True     # a place before that was merged as well is among these places already
            enter(np.concatenate((before[(before < n) & ~mark[before]], at)))
            mark[at] = False
        alive = sym[:n] >= 0
        counts = np.add.reduceat(alive, starts, dtype=np.int64)
        raw = sym[:n][alive].astype("<u4").tobytes()
        to = (np.cumsum(counts) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text of a slice."""
        lists = [self.chunks(t) for t in texts]
        new = [c for c in self.kept.recall(set().union(*lists)) if c]
        known = self.kept.new
        control = [c for c in new if c in self.special]
        plain = [c for c in new if c not in self.special]
        known.update(zip(plain, self.encode_chunks([c.encode() for c in plain]), strict=True))
        known.update((c, self.special[c].to_bytes(4, "little")) for c in control)
        out = [b"".join(map(known.__getitem__, x)) for x in lists]
        for c in new:
            if len(c) > SHORT:
                del known[c]
        return out

    def decode(self, ids: bytes) -> str:
        return decode_ids(self.bytes_of, ids)


def vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    return path


def bytes_by_id(path: str | None = None) -> list[bytes]:
    """``token_bytes`` of a vocabulary file, loaded once a worker."""
    import tokenizers
    path = vocabulary_path(path)
    loaded = vars(tokenizers).setdefault("_token_bytes", {})
    if path not in loaded:
        with open(path, encoding="utf-8") as f:
            loaded[path] = token_bytes(json.load(f))
    return loaded[path]


def encoder(path: str | None = None) -> PairIndexEncoder:
    """The encoder of a vocabulary file, loaded once a worker (it hangs on an
    installed module, as this package travels to the workers by value)."""
    import tokenizers
    path = vocabulary_path(path)
    loaded = vars(tokenizers).setdefault("_pair_index_encoders", {})
    if path not in loaded:
        loaded[path] = PairIndexEncoder(path)
    return loaded[path]


def _slices(batch: pa.RecordBatch, sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` by the sizes of their rows."""
    at, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= limit:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids`` in place of ``text``: the ids as
    little-endian unsigned 32-bit numbers, as the vocabulary's own library gives
    them for the whole text without added control ids.

    Null and empty texts have no ids (an empty binary).  A very long text is
    encoded in pieces cut before white space, which changes no id; a run of a
    single chunk is held at once.  Repeated rows and ties are rows like any
    other, an empty table gives an empty one, and other columns go through
    unchanged whatever their names; a column named ``ids`` is replaced."""
    keep = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*keep).schema.add(ids, "binary", False)
    inner = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for lo, hi in _slices(batch, sizes, SLICE):
                done: list[bytes] = []
                some = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                if sum(map(len, some)) <= 2 * SLICE:
                    done = enc.encode(some)
                else:
                    done = [b"".join(enc.encode([p])[0] for p in enc.pieces(t)) for t in some]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)),
                     pa.array(done, pa.binary())], names=[*keep, ids])

    return inner.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a string column ``text``: what the ids say.  Null ids
    give null, no ids the empty text; other columns stay, and one named as
    ``text`` is replaced."""
    keep = [c for c in encoded.columns if c != text]
    schema = encoded.select(*keep).schema.add(text, "string")
    at = keep.index(ids)

    def run(batches):
        bytes_of = bytes_by_id(path)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
            for lo, hi in _slices(batch, sizes, 2 * SLICE):
                part = batch.slice(lo, hi - lo)
                said = [None if x is None else decode_ids(bytes_of, x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=[*keep, text])

    return encoded.select(*keep).mapInArrow(run, schema)
