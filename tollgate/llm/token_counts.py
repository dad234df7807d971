"""Edit-aware token counts.

A document's text is cut, at white space, into leaves of about ``LEAF`` chunks;
a tokenizer of words never looks across such a cut.  A segment tree over the
leaves holds the characters and tokens of every subtree, and is kept per
document as a row of arrays.  An edit is found by descending the tree; the
leaves it touches, with the one that ends just before it and the one it may grow
into, are marked.  When all edits of a slice of documents are in, the marked
leaves of all of them are encoded together, and the sums above them are updated.
The rest of the text is never tokenized again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.tokens import _PLAIN, ChunkEncoder, encoder

LEAF = 32
#: bytes that end a chunk
BLANK = np.frombuffer(_PLAIN, np.uint8) == 0x20


def leaves_of_all(enc: ChunkEncoder, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Characters and tokens of the leaves, of ``LEAF`` chunks each, of texts."""
    return [_leaves(*x, None) for x in encode_regions(enc, texts)]


def leaves_of(enc: ChunkEncoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of the leaves of a text."""
    return leaves_of_all(enc, [text])[0]


def _leaves(raw: bytes, tokens: np.ndarray, parts: int | None) -> tuple[np.ndarray, np.ndarray]:
    first = (np.arange(0, len(tokens), LEAF) if parts is None
             else np.arange(parts) * len(tokens) // max(parts, 1))
    ends = np.append(first[1:], len(tokens))
    total = np.concatenate(([0], np.cumsum(tokens)))
    codes = np.frombuffer(raw, np.uint8)
    at = np.concatenate(([0], np.flatnonzero(BLANK[codes]) + 1, [len(raw)]))
    if raw.isascii():
        return at[ends] - at[first], total[ends] - total[first]
    chars = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
    return chars[at[ends]] - chars[at[first]], total[ends] - total[first]


class CountTree:
    """Sums of characters and tokens over leaves: node 1 is the root, node i has
    the children 2i and 2i + 1, and leaf k is node ``width + k``."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.n = len(chars)
        self.width = 1 << max(0, (self.n - 1).bit_length())
        self.chars = np.zeros(2 * self.width, np.int64)
        self.tokens = np.zeros(2 * self.width, np.int64)
        for sums, leaves in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.width:self.width + self.n] = leaves
            at = self.width
            while at > 1:
                sums[at // 2:at] = sums[at:2 * at].reshape(-1, 2).sum(axis=1)
                at //= 2

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one behind the end) and
        the characters before that leaf."""
        at, before = 1, 0
        while at < self.width:
            at *= 2
            if char >= before + self.chars[at] and before + self.chars[at] < self.chars[1]:
                before += int(self.chars[at])
                at += 1
        return min(at - self.width, self.n - 1), before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """New sums of a leaf, and of all subtrees that hold it."""
        at = leaf + self.width
        more_chars, more_tokens = chars - int(self.chars[at]), tokens - int(self.tokens[at])
        while at:
            self.chars[at] += more_chars
            self.tokens[at] += more_tokens
            at //= 2

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return self.chars[self.width:self.width + self.n], self.tokens[self.width:self.width + self.n]


class Edited:
    """A tree with the edits that were made to its text and not encoded yet.
    The leaves keep their places while edits come in; ``stale`` are those to be
    worked out anew."""

    def __init__(self, tree: CountTree, text: str):
        self.tree, self.text = tree, text
        self.stale = np.zeros(tree.n, bool)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters start .. end by ``new`` (positions beyond the
        text mean its end).  The leaves from the one that ends just before the
        edit to the one it may grow into are marked; the first of them takes all
        their characters, so that later edits find their places."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        a, _ = self.tree.find(max(start - 1, 0))
        b, _ = self.tree.find(end)
        self.text = self.text[:start] + new + self.text[end:]
        chars, tokens = self.tree.leaves()
        grown = int(chars[a:b + 1].sum()) + len(new) - (end - start)
        for k in np.flatnonzero(chars[a + 1:b + 1]).tolist():
            self.tree.put(a + 1 + k, 0, int(tokens[a + 1 + k]))
        self.tree.put(a, grown, int(tokens[a]))
        self.stale[a:b + 1] = True

    def regions(self) -> list[tuple[int, int, str]]:
        """Runs of marked leaves (first, behind the last) and their texts."""
        edge = np.flatnonzero(np.diff(np.concatenate(([False], self.stale, [False]))))
        chars, _ = self.tree.leaves()
        at = np.concatenate(([0], np.cumsum(chars)))
        return [(a, b, self.text[at[a]:at[b]]) for a, b in edge.reshape(-1, 2).tolist()]

    def close(self, regions: list[tuple[int, int, str]], encoded: list[tuple[bytes, np.ndarray]]) -> CountTree:
        """The tree with the sums of all regions, given their chunks' tokens.
        A region that has outgrown its leaves gets more of them."""
        grown = []
        for (a, b, text), (raw, tokens) in zip(regions, encoded, strict=True):
            fits = len(text) <= 32 * LEAF * (b - a)
            chars, counts = _leaves(raw, tokens, b - a if fits else None)
            if fits:
                for k, (c, t) in enumerate(zip(chars.tolist(), counts.tolist(), strict=True)):
                    self.tree.put(a + k, c, t)
            else:
                grown.append((a, b, chars, counts))
        self.stale[:] = False
        if not grown:
            return self.tree
        old_chars, old_tokens = self.tree.leaves()
        parts_c, parts_t, at = [], [], 0
        for a, b, chars, counts in [*grown, (self.tree.n, self.tree.n, old_chars[:0], old_tokens[:0])]:
            parts_c += [old_chars[at:a], chars]
            parts_t += [old_tokens[at:a], counts]
            at = b
        return CountTree(np.concatenate(parts_c), np.concatenate(parts_t))


def encode_regions(enc: ChunkEncoder, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
    """The bytes and the tokens of each chunk of many texts, encoded together."""
    raws = [t.encode() for t in texts]
    return list(zip(raws, enc.chunk_counts([enc.chunks(x) for x in raws]), strict=True))


def edit(enc: ChunkEncoder, tree: CountTree, text: str, start: int, end: int, new: str) -> tuple[CountTree, str, int]:
    """One edit of one text: the tree, the text and the characters that were
    encoded again."""
    e = Edited(tree, text)
    e.edit(start, end, new)
    regions = e.regions()
    return e.close(regions, encode_regions(enc, [x for *_, x in regions])), e.text, sum(len(x) for *_, x in regions)


#: characters of the texts of a slice
SLICE = 2_000_000


def a_few_rows(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, or one longer
    text: few texts are in memory at a time."""
    for batch in batches:
        total = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


def build(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The trees: doc_id, text_key (hash of the text), n_tokens, and the arrays
    leaf_chars and leaf_tokens.  Null texts are empty; repeated rows have one
    tree, rows of one doc_id with different texts one each."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in a_few_rows(batches):
            both = leaves_of_all(enc, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([int(t.sum()) for _, t in both], pa.int64()),
                 pa.array([c for c, _ in both], pa.list_(pa.int64())), pa.array([t for _, t in both], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_tokens", "leaf_chars", "leaf_tokens"])

    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_key long, n_tokens long, leaf_chars array<long>, leaf_tokens array<long>")
    return out.dropDuplicates(["doc_id", "text_key"])


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document and text: doc_id, n_edits, old_tokens, n_tokens,
    n_chars, encoded_chars (characters tokenized again), text, and the new
    leaf_chars and leaf_tokens.

    ``edits`` has doc_id, seq, start, end, new: code points start .. end of the
    text as it is after the edits of lower seq (ties: by the other columns) become ``new``
    (null: nothing).  Documents without edits come back as they are; edits of
    unknown documents are ignored.  Edits of one document build on each other,
    so they are one task's work."""
    kind = dict(docs.dtypes)["doc_id"]
    listed = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(
        "seq", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("end", "start", F.lit(0)).cast("long").alias("end"),
        F.coalesce("new", F.lit("")).alias("new")))).alias("edits"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    # edits meet the trees first, so that the texts are shuffled once
    same = trees.join(listed, "doc_id", "left").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n_tokens", "leaf_chars", "leaf_tokens", "edits")
    rows = rows.join(same, rows["doc_id"].eqNullSafe(same["__id"]) & (rows["text_key"] == same["__key"]))
    rows = rows.drop("__id", "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in a_few_rows(batches):
            out: dict[str, list] = {k: [] for k in ("n_edits", "n_tokens", "n_chars", "encoded_chars", "text", "leaf_chars", "leaf_tokens")}
            cols = [batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")]
            # all edits first, then the regions of all texts are encoded together
            edited = []
            for now, chars, tokens, todo in zip(*cols, strict=True):
                edited.append(Edited(CountTree(np.array(chars, np.int64), np.array(tokens, np.int64)), now))
                for e in todo or ():
                    edited[-1].edit(e["start"], e["end"], e["new"])
            regions = [e.regions() for e in edited]
            done = iter(encode_regions(enc, [x for r in regions for *_, x in r]))
            for e, r, todo in zip(edited, regions, cols[3], strict=True):
                tree = e.close(r, [next(done) for _ in r])
                chars, tokens = tree.leaves()
                for k, v in zip(out, (len(todo or ()), int(tree.tokens[1]), int(tree.chars[1]), sum(len(x) for *_, x in r), e.text,
                                      chars, tokens), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens")]
                + [pa.array(out[k], pa.int64()) for k in ("n_edits", "n_tokens", "n_chars", "encoded_chars")]
                + [pa.array(out["text"], pa.string())]
                + [pa.array(out[k], pa.list_(pa.int64())) for k in ("leaf_chars", "leaf_tokens")],
                names=["doc_id", "old_tokens", "n_edits", "n_tokens", "n_chars", "encoded_chars", "text",
                       "leaf_chars", "leaf_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, old_tokens long, n_edits long, n_tokens long, n_chars long, "
                                "encoded_chars long, text string, leaf_chars array<long>, leaf_tokens array<long>")
