"""Best-fit packing of tokenised documents by a plan over the histogram of lengths.

Texts are tokenised once; each piece's length and checksum are staged with its rank among the pieces of its length in its
task. The histogram of lengths has at most `capacity` entries, whatever the corpus, and best-fit decreasing runs over its
counts on the driver: k bins with the same remaining room are one entry. Pieces then take planned slots by their rank
within their length. The plan has a few rows per split of such an entry, so its size depends on the lengths that occur,
not on the number of documents.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import storage
from waymark.llm.kernels import doc_blocks, span_hashes, text_buffer

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Distinct pieces that a worker remembers before it starts afresh; a matter of speed and memory only.
MEMORY_PIECES = 200_000
#: Pieces that are encoded at once.
ENCODE_ROWS = 4096
OTHER, LETTER, NUMBER, SPACE = range(4)
CONTRACTED = np.frombuffer(b"strvmld", np.uint8)


class PieceTokenizer:
    """Byte-level BPE of many texts at once.

    Splitting into pre-tokens is done on arrays of code points; equal pre-tokens, found by a 64-bit hash and compared code
    point by code point, are encoded once. Their merges run in tiktoken, with the ranks of the same file, as that takes a
    tenth of the time; a check on loading holds it against `tokenizers`, which else does all. A text with an apostrophe
    before a contraction's first letter, with an added token of the file (such as an end mark written out), or with two
    pre-tokens of one hash is left to `tokenizers` as a whole.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        kinds = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = LETTER
            elif k == "N":
                kinds[c] = NUMBER
        kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        self.kinds = kinds
        self.merge = self._merger()
        self.forget()

    def _merger(self):
        """A function from a pre-token's bytes to its ids, or None if tiktoken can't stand in for this file."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        try:
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            pairs = ["".join(p) for p in zip(list(vocabulary)[:1500], list(vocabulary)[7000:8500], strict=False)]
            probes = [x for x in (bytes(byte_of[c] for c in p).decode("utf-8", "ignore") for p in pairs) if x.isalpha()]
            same = all(list(merge(x.encode())) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in probes)
        except (KeyError, ValueError, AttributeError, TypeError):
            return None
        return merge if same and probes else None

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.points, self.point_ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.n = 0

    def _learn(self, pieces: list[str], hashes: list[int]) -> None:
        ids: list[list[int]] = [self.merge(x.encode()) for x in pieces] if self.merge else []
        for k in range(len(ids), len(pieces), ENCODE_ROWS):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k : k + ENCODE_ROWS], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat, self.ends = self._grown(self.flat, self.ends, np.fromiter(chain.from_iterable(ids), np.uint32, sizes.sum()), sizes)
        widths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.points, self.point_ends = self._grown(self.points, self.point_ends, np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32), widths)
        self.known.update(zip(hashes, range(self.n, self.n + len(ids)), strict=True))
        self.n += len(ids)

    def _grown(self, flat: np.ndarray, ends: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays with further values behind those of the n pieces known, in place where there is room."""
        at = ends[self.n - 1] if self.n else 0
        while len(flat) < at + len(more):
            flat = np.concatenate([flat, np.zeros_like(flat)])
        while len(ends) < self.n + len(sizes):
            ends = np.concatenate([ends, np.zeros_like(ends)])
        flat[at : at + len(more)] = more
        ends[self.n : self.n + len(sizes)] = at + np.cumsum(sizes)
        return flat, ends

    def _left_whole(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with what only the tokenizer as a whole gets right: contractions and added tokens."""
        quote = np.flatnonzero(raw[:-1] == 39)
        at = [quote[np.isin(raw[quote + 1], CONTRACTED)]]
        for token in self.added:
            found = np.flatnonzero(raw == token[0])
            for k in range(1, len(token)):
                found = found[found + k < len(raw)]
                found = found[raw[found + k] == token[k]]
            at.append(found)
        return np.unique(np.searchsorted(offsets, np.concatenate(at), "right") - 1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a text buffer."""
        if self.n > MEMORY_PIECES:
            self.forget()
        n = len(offsets) - 1
        text = raw.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return [np.zeros(0, np.uint32)] * n
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = heads[offsets]
        kind = self.kinds[cp]
        edge = np.zeros(len(cp) + 1, bool)
        edge[bounds] = True
        edge[0] = True
        change = edge[:-1].copy()
        change[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        next_solid = np.zeros(len(cp), bool)
        next_solid[:-1] = ~space[1:] & ~edge[1:-1]
        after_blank = np.zeros(len(cp), bool)
        after_blank[1:] = (cp[:-1] == 32) & ~edge[1:-1]
        start = (space & (change | next_solid)) | (~space & change & ~after_blank) | edge[:-1]
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(cp))
        h = span_hashes(cp, s, e)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if fresh := [k for k, x in enumerate(keys) if x not in self.known]:
            f = first[fresh]
            self._learn([text[a:b] for a, b in zip(s[f].tolist(), e[f].tolist(), strict=True)], [keys[k] for k in fresh])
        idx = np.fromiter((self.known[x] for x in keys), np.int64, len(keys))
        stop = self.ends[idx]
        begin = np.where(idx > 0, self.ends[idx - 1], 0)
        size = (stop - begin)[inv]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin[inv] - total[:-1], size) + np.arange(total[-1])]
        cut = total[np.searchsorted(s, bounds)]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        # Pieces tile the text, so the pieces remembered for them, laid end to end, are the text unless hashes clash.
        held = np.where(idx > 0, self.point_ends[idx - 1], 0)
        clash = (self.point_ends[idx] - held)[inv] != e - s
        same = self.points[np.minimum(np.repeat(held[inv] - s, e - s) + np.arange(len(cp)), len(self.points) - 1)] == cp
        clash |= np.add.reduceat(~same, s) > 0
        odd = np.searchsorted(bounds, s[clash], "right") - 1
        for k in np.union1d(self._left_whole(raw, offsets), odd).tolist():
            whole = raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8")
            out[k] = np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32)
        return out


_CODERS: dict[str | None, PieceTokenizer] = {}


def coder_of(path: str | None) -> PieceTokenizer:
    """The worker's one tokenizer for this file, with what it has learned."""
    if path not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODERS[path] = PieceTokenizer(path)
    return _CODERS[path]


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full pieces after a first one with the rest."""
    if n <= capacity:
        return [n]
    return [n % capacity] * bool(n % capacity) + [capacity] * (n // capacity)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, run int, rank long"


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its rank among the pieces of its length that its task (run) made."""
    storage.small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        coder = coder_of(path)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            ids, rows = batch.column(0), []
            for i, j in doc_blocks(offsets):
                part = coder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, tokens in enumerate(part, i):
                    tokens = np.append(tokens, np.uint32(END_ID)).astype("<u4")
                    at = 0
                    for piece, length in enumerate(cut_lengths(len(tokens), capacity)):
                        rows.append((k, piece, at, length, zlib.crc32(tokens[at : at + length].tobytes()), seen[length]))
                        seen[length] += 1
                        at += length
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array([run] * len(rows), pa.int32()), pa.array(cols[5], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "run", "rank"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(work, PIECES)


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts.

    Rows (length, first rank, ranks, first sequence, offset): the pieces of that length with ranks from the first on, so
    many of them, go to sequences from the first on, one each, at the offset.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # remaining -> (first sequence, sequences)
    plan: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def fill(length: int, rank: int, first: int, bins: int, remaining: int, most: int) -> int:
        """Up to `most` pieces into these bins, each bin filled before the next; returns how many."""
        each = remaining // length
        full, odd = min(bins, most // each), 0
        if full < bins and full * each < most:
            odd = most - full * each
        for slot in range(each if full else 0):
            plan.append((length, rank + slot * full, full, first, capacity - remaining + slot * length))
        if full:
            room[remaining - each * length].append((first, full))
        for slot in range(odd):
            plan.append((length, rank + full * each + slot, 1, first + full, capacity - remaining + slot * length))
        if odd:
            room[remaining - odd * length].append((first + full, 1))
        left = bins - full - bool(odd)
        if left:
            room[remaining].append((first + full + bool(odd), left))
        return full * each + odd

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        remaining = length
        while left:
            while remaining <= capacity and not room[remaining]:
                remaining += 1
            if remaining > capacity:
                bins = -(-left // (capacity // length))
                took = fill(length, rank, fresh, bins, capacity, left)
                fresh += bins
            else:
                took = fill(length, rank, *room[remaining].pop(), remaining, left)
            rank, left = rank + took, left - took
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is one piece of the end id alone. Repeated rows and equal ids are packed as often as they occur.
    Texts of any length are cut, never dropped. An empty table gives no rows; further columns take no part.
    """
    pieces = storage.staged(tokenised(docs, path, capacity), "pieces")
    runs = pieces.groupBy("length", "run").agg(F.count("*").alias("n"))
    counts = runs.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan = best_fit({r.length: r.n for r in counts}, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(F.col("length").alias("l"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, (F.col("length") == F.col("l")) & (F.col("run") == F.col("r")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("nth"))
    # One number orders (length, rank): lengths take the high bits.
    keys = (plan[:, 0].astype(np.uint64) << np.uint64(48)) + plan[:, 1].astype(np.uint64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            slot = np.searchsorted(keys, (length.astype(np.uint64) << np.uint64(48)) + nth.astype(np.uint64), "right") - 1
            seq, off = plan[slot, 3] + nth - plan[slot, 1], plan[slot, 4]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents."""
    return pack(storage.read(spark, sf_dir, "documents"))
