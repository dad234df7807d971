r"""Phrase collocations: counts in a HAT-trie, exact scores.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\x0A-\x0D]`` into pieces and these
into words ``[^\x20\x09]+``; phrases are 2 or 3 neighbouring words of a piece.

Counting.  A task gives the words it meets ids and counts phrases in a shallow
trie over word ids.  A node deals the next word's id to containers, hash tables
that each hold a range of ids; a container that grows beyond ``BURST`` entries
bursts into containers of smaller ranges, and an id that fills one alone becomes
a node for the next word.  Where the trie holds more than ``MOST`` entries, whole subtrees leave
it as sorted runs, the largest first.  The runs are written to the shared folder,
dealt to partitions by ranges of their prefixes (so that a frequent first word is
split by what follows it) and added up there.

Two passes do: words and pairs first, then triples whose two pairs both reach the
least count, as no other triple can.  The second pass asks a bit table of the
frequent pairs that has no false negatives; its size is bounded, and what it lets
through in vain is only counted and left out later.
"""

from __future__ import annotations

import math
import operator
import re
import uuid
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import stored
from tollgate.llm.words import mix
from tollgate.operators.keyed import top_k_per_key
from tollgate.session import ensure_checkpoint_dir

LEAST = 10
TOP = 2000
#: a phrase goes if a longer one around it has this share of its count, in hundredths
SHARE = 50
#: entries of a container, and of a trie
BURST = 8192
MOST = 700_000
#: words that a task gives ids before it starts anew (an id has 21 bits of a code)
WORDS = 600_000
ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1
#: word ids that are counted at a time
FLUSH = 500_000
#: most bits of the table of frequent pairs
TABLE_BITS = 1 << 28
UNKNOWN = "und"
_TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
_K = np.uint64(0xD6E8FEB86659FD93)


class Node:
    """A node of the trie: it deals codes by the id at ``shift`` to containers
    and nodes, each for the ids from its entry of ``starts`` on."""

    __slots__ = ("shift", "starts", "held")

    def __init__(self, shift: int):
        self.shift, self.starts, self.held = shift, [0], [{}]

    def add(self, codes: np.ndarray, counts: np.ndarray) -> int:
        """Adds sorted codes; the number of new entries."""
        ids = codes >> self.shift & ID_MASK
        cuts = np.searchsorted(ids, self.starts).tolist() + [len(codes)]
        new, burst = 0, []
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if lo == hi:
                continue
            held = self.held[i]
            if isinstance(held, Node):
                new += held.add(codes[lo:hi], counts[lo:hi])
                continue
            before, keys = len(held), codes[lo:hi].tolist()
            held.update(zip(keys, map(operator.add, map(held.get, keys, repeat(0)), counts[lo:hi].tolist()), strict=True))
            new += len(held) - before
            if len(held) > BURST:
                burst.append(i)
        for i in reversed(burst):
            self._burst(i)
        return new

    def _burst(self, i: int) -> None:
        """Cuts a full container into ranges of about half of ``BURST`` entries,
        between ids; an id with more than that becomes a node of its own."""
        codes, counts = sorted_entries(self.held[i])
        ids = codes >> self.shift & ID_MASK
        edges = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]))
        full = np.flatnonzero(np.diff(edges) > BURST // 2)
        even = edges[np.searchsorted(edges, np.arange(0, len(ids), BURST // 2))]
        cuts = np.unique(np.concatenate((even, edges[full], edges[full + 1], [len(ids)])))
        pieces, free = [], self.starts[i]      # free: the first id that no piece covers yet
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first, last = int(ids[lo]), int(ids[hi - 1])
            if first == last and hi - lo > BURST // 2 and self.shift:
                if free < first:
                    pieces.append((free, {}))
                pieces.append((first, Node(self.shift - ID_BITS)))
                pieces[-1][1].add(codes[lo:hi], counts[lo:hi])
            else:
                pieces.append((free, dict(zip(codes[lo:hi].tolist(), counts[lo:hi].tolist(), strict=True))))
            free = last + 1
        if isinstance(pieces[-1][1], Node) and free not in self.starts[i + 1:i + 2]:
            pieces.append((free, {}))
        self.starts[i:i + 1], self.held[i:i + 1] = zip(*pieces, strict=True)

    def __len__(self) -> int:
        return sum(map(len, self.held))

    def entries(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries in the order of their codes, a container at a time."""
        for held in self.held:
            if isinstance(held, Node):
                yield from held.entries()
            elif held:
                yield sorted_entries(held)

    def take(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes whole subtrees out, the largest, until at most ``keep``
        entries stay; they come in the order of their codes."""
        sizes = np.array([len(x) for x in self.held])
        largest = np.argsort(-sizes, kind="stable")
        left = sizes.sum() - np.cumsum(sizes[largest])
        for i in sorted(largest[:int(np.searchsorted(-left, -keep)) + 1].tolist()):
            held, self.held[i] = self.held[i], {}
            if isinstance(held, Node):
                yield from held.entries()
            elif held:
                yield sorted_entries(held)


def sorted_entries(held: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.fromiter(held.keys(), np.int64, len(held))
    order = np.argsort(codes)
    return codes[order], np.fromiter(held.values(), np.int64, len(held))[order]


class PairTable(NamedTuple):
    """Bits of the hashes of frequent pairs."""
    bits: np.ndarray     # 64-bit words
    size: int            # number of bits, a power of 2

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64(self.size - 1)
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def word_hash(lang: bytes, word: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(lang + b"\t" + word)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _K + second)


class Ids(dict):
    """Ids of a language's words; a new word gets the next one when it is asked for."""

    def __init__(self, lang: bytes, counter: Counter):
        super().__init__((bytes([c]), 0) for c in b".,;:!?\n\x0b\x0c\r")
        self.lang, self.counter = lang, counter

    def __missing__(self, word: bytes) -> int:
        self[word] = i = self.counter.new_word(self.lang, word)
        return i


class Counter:
    """Counts the phrases of one task's texts and gives them out as runs of
    (key, n): the words, a tab and the language."""

    def __init__(self, pairs: PairTable | None):
        self.pairs = pairs
        self.carry: list[np.ndarray] = []
        self.waiting = 0
        self.tail = np.zeros(0, np.int64)
        self._fresh()

    def _fresh(self) -> None:
        self.trie = Node(2 * ID_BITS)
        self.size = 0
        self.ids: dict[bytes, Ids] = {}
        self.words: list[bytes] = [b""]
        self.langs: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def _ids_of(self, lang: bytes, tokens: list[bytes]) -> np.ndarray:
        """Ids of words, 0 for what ends a piece."""
        known = self.ids.get(lang)
        if known is None:
            known = self.ids[lang] = Ids(lang, self)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def new_word(self, lang: bytes, word: bytes) -> int:
        self.words.append(word)
        self.langs.append(lang)
        if self.pairs is not None:
            self.hashes.append(word_hash(lang, word))
        return len(self.words) - 1

    def add(self, lang: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        """Counts a text; what had to leave the trie on the way."""
        for piece in cut_at_blanks(text):
            ids = self._ids_of(lang, _TOKEN.findall(piece.lower()))
            self.carry.append(ids)
            self.waiting += len(ids)
            if self.waiting >= FLUSH or len(self.words) > WORDS:
                yield from self._flush()
        self.carry.append(np.zeros(1, np.int64))

    def _flush(self) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([self.tail, *self.carry]) if self.carry else self.tail
        old = len(self.tail)
        self.carry, self.waiting = [], 0
        self.tail = new[-2:]
        codes = self._triples(new, old) if self.pairs is not None else self._words_and_pairs(new, old)
        if len(codes):
            self.size += self.trie.add(*np.unique(codes, return_counts=True))
        if len(self.words) > WORDS:
            words = [(self.langs[i], self.words[i]) for i in self.tail.tolist()]
            yield from self._run(self.trie.take(0))
            self._fresh()
            self.tail = np.array([int(self._ids_of(lang, [w])[0]) if w else 0 for lang, w in words], np.int64)
        elif self.size > MOST:
            yield from self._run(self.trie.take(MOST // 2))
            self.size = len(self.trie)

    def _words_and_pairs(self, a: np.ndarray, old: int) -> np.ndarray:
        """Codes of the words and pairs that end behind the first ``old`` ids."""
        words = a[old:]
        first, second = a[max(old - 1, 0):-1], a[max(old, 1):]
        both = (first > 0) & (second > 0)
        return np.concatenate((words[words > 0] << 2 * ID_BITS, first[both] << 2 * ID_BITS | second[both] << ID_BITS))

    def _triples(self, a: np.ndarray, old: int) -> np.ndarray:
        """Codes of the triples that end behind the first ``old`` ids and whose pairs may be frequent."""
        if len(a) < 3:
            return a[:0]
        h = np.array(self.hashes, np.uint64)[a]
        pair = (a[:-1] > 0) & (a[1:] > 0)
        pair[pair] = self.pairs.may_hold(pair_hashes(h[:-1][pair], h[1:][pair]))
        at = np.flatnonzero(pair[:-1] & pair[1:])
        at = at[at + 2 >= old]
        return a[at] << 2 * ID_BITS | a[at + 1] << ID_BITS | a[at + 2]

    def _run(self, subtrees: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Subtrees, in the order of their codes, as a run of words."""
        parts = list(subtrees)
        if not parts:
            return
        codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = [codes >> k * ID_BITS & ID_MASK for k in (2, 1, 0)]
        words, langs = pa.array(self.words, pa.binary()), pa.array(self.langs, pa.binary())
        for at in range(0, len(codes), 100_000):
            some = slice(at, at + 100_000)
            key = words.take(pa.array(ids[0][some]))
            for x in ids[1:]:
                x = x[some]
                there = pa.array(x > 0)
                longer = pa.compute.binary_join_element_wise(key, words.take(pa.array(x)), pa.scalar(b" ", pa.binary()))
                key = pa.compute.if_else(there, longer, key)
            key = pa.compute.binary_join_element_wise(key, langs.take(pa.array(ids[0][some])), pa.scalar(b"\t", pa.binary()))
            yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(counts[some])], names=["key", "n"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._flush()
        yield from self._run(self.trie.take(0))


def cut_at_blanks(text: bytes, size: int = 1_000_000) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut where no word is cut."""
    at = 0
    while len(text) - at > size:
        found = _END.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


_END = re.compile(rb"[ \t.,;:!?\n-\r]")


def count_runs(docs: DataFrame, pairs: PairTable | None = None) -> DataFrame:
    """(key, n): partial counts of words and pairs, or, where a table of
    frequent pairs is given, of the triples made of them."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).cast("binary").alias("lang"),
                        F.col("text").cast("binary").alias("text"))
    table = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        counter = Counter(None if table is None else table.value)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    yield from counter.add(lang.as_py(), text.as_py())
        yield from counter.rest()

    return texts.mapInArrow(run, "key string, n bigint")


def _merged(runs: DataFrame, name: str) -> DataFrame:
    """Runs written to the shared folder, dealt by ranges of their keys and added up."""
    spark = runs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    runs.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(runs.schema).parquet(path)
    return back.repartitionByRange("key").groupBy("key").agg(F.sum("n").alias("n"))


def _split_key(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, n): a word holds no tab, so the first one ends the phrase."""
    phrase = F.substring_index("key", "\t", 1)
    return counts.select(F.substr("key", F.char_length(phrase) + 2).alias("lang"), phrase.alias("phrase"),
                         F.split(phrase, " ").alias("words"), "n")


def _pair_table(pairs: DataFrame, most_bits: int = TABLE_BITS) -> PairTable:
    """The bits of all pairs (lang, words), as a partial aggregate of 64-bit words."""
    n = pairs.count()
    size = 1 << min(max(16, (16 * n).bit_length()), int(math.log2(most_bits)))

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            words = batch.column(1).to_pylist()
            first = np.array([word_hash(a.encode(), w[0].encode()) for a, w in zip(langs, words, strict=True)], np.uint64)
            second = np.array([word_hash(a.encode(), w[1].encode()) for a, w in zip(langs, words, strict=True)], np.uint64)
            slot = pair_hashes(first, second) & np.uint64(size - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((slot >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = (pairs.select("lang", "words").mapInArrow(run, "at bigint, bits bigint")
            .groupBy("at").agg(F.bit_or("bits").alias("bits")))
    bits = np.zeros(size >> 6, np.uint64)
    for batch in rows.toArrow().to_batches():      # at most size / 64 rows
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return PairTable(bits, size)


class Counts(NamedTuple):
    words: DataFrame      # lang, phrase, words, n: every word
    pairs: DataFrame      # those of the least count or more
    triples: DataFrame


def count(docs: DataFrame, least: int = LEAST) -> Counts:
    """Counts of all words, and of the pairs and triples that occur ``least``
    times or more, per language (null: ``und``)."""
    merged = _merged(count_runs(docs), "phrase-runs-2")
    blank = F.locate(" ", "key")      # of a single word's key only the language may hold one
    short = stored(_split_key(merged.where((F.col("n") >= least) | (blank == 0) | (blank > F.locate("\t", "key")))), "phrases-2")
    words, pairs = short.where(F.size("words") == 1), short.where(F.size("words") == 2)
    triples = _split_key(_merged(count_runs(docs, _pair_table(pairs)), "phrase-runs-3"))
    return Counts(words, pairs, stored(triples.where(F.col("n") >= least), "phrases-3"))


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in whole numbers of up to 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))"
                  f" div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def scored(counts: Counts, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates that no longer phrase covers."""
    words = counts.words.where(F.col("n") >= least)
    part = lambda df, name, n: df.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    pairs = counts.pairs.select("lang", "phrase", F.col("n").alias("a"), F.get("words", F.lit(0)).alias("w1"),
                                F.get("words", F.lit(1)).alias("w2"))
    triples = counts.triples.select("lang", "phrase", F.col("n").alias("a"), F.get("words", F.lit(0)).alias("w1"),
                                    F.get("words", F.lit(2)).alias("w3"),
                                    F.array_join(F.slice("words", 1, 2), " ").alias("p1"),
                                    F.array_join(F.slice("words", 2, 2), " ").alias("p2"))
    covered = (triples.select("lang", "a", F.explode(F.array("p1", "p2")).alias("phrase"))
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    pairs = (pairs.join(covered, ["lang", "phrase"], "left")
             .where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))))
    two = (pairs.join(part(words, "w1", "l"), ["lang", "w1"]).join(part(words, "w2", "r"), ["lang", "w2"])
           .select("lang", "phrase", "a", "l", "r", score_of("a", "l", "r").alias("score")))
    three = (triples.join(part(words, "w1", "l1"), ["lang", "w1"]).join(part(counts.pairs, "p2", "r1"), ["lang", "p2"])
             .join(part(counts.pairs, "p1", "l2"), ["lang", "p1"]).join(part(words, "w3", "r2"), ["lang", "w3"]))
    lowest = F.least(*[F.struct(score_of("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"),
                                F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    three = three.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return two.unionByName(three)


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score, then count (both
    descending), then phrase: lang, rank, phrase, a, l, r, n, score, where n is
    the number of all words of the language.

    Null and empty texts have no words; a null lang counts as ``und``.  Repeated
    rows count again.  A very long text is worked through in pieces, and phrases
    over their borders are counted.  Ties are told apart by the phrase, in UTF-8
    byte order; an empty table gives no rows; other columns are not read."""
    found = count(docs, least)
    totals = found.words.groupBy("lang").agg(F.sum("n").alias("n"))
    best = top_k_per_key(scored(found, least, share), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")],
                         top, salt_col="phrase")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                            "score")
