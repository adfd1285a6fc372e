"""Secrets by fixed patterns and a linear-chain conditional random field.

Patterns give the base spans. A chain over a text's tokens tags each as secret begin, inside or outside from its shape, the
words next to it and the file's traits; it finds, in every whole text, secrets that the patterns don't describe. It is fitted
to texts of a bounded sample: to the values in their base spans, and to copies of the texts with secrets of other forms put
in, after other words or none, and with long words, numbers, dates and addresses put in that are none. Decoding is Viterbi's. Tokens whose score for `outside` exceeds any gain that a neighbour could bring are
outside in every best path, so the chain falls apart there and only the stretches between are decoded: the result is the
same as that of one pass over all tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import storage
from waymark.llm.kernels import doc_blocks, span_hashes, text_buffer

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
FOUND = "crf"
#: The chain is fitted to at most so many distinct texts with base spans, and as many without: those with the least hashes of id
#: and text, out of about MOST_SAMPLED documents with hashes below a bound.
MOST_TEXTS, MOST_SAMPLED = 300, 20_000
#: Windows of 2 * WINDOW tokens that are fitted to: those around spans, evenly thinned out above a number, and PLAIN of each text.
WINDOW, MOST_WINDOWS, PLAIN = 10, 2000, 2
ROUNDS, STEP, DECAY = 50, 0.2, 1e-3
#: A secret by the chain has at least so many characters.
LEAST = 8
#: Words before a made-up secret; the patterns' own are not among them.
BEFORE = ("pwd", "pass", "passphrase", "passcode", "key", "auth", "bearer", "authorization", "credential", "credentials", "login", "access_key", "private_key", "signing_key", "client_id", "pat", "apikey is", "my key", "the code is", "use")
B, I, O = range(3)  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # Runs are maximal, so those that are long enough can be asked for at once.
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{32,}", text)]
    return sorted(out)


_TOKEN, _DIGIT, _UPPER, _LOWER, _HEX = (np.zeros(256, bool) for _ in range(5))
for _table, _chars in (
    (_TOKEN, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"),
    (_DIGIT, b"0123456789"),
    (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (_LOWER, b"abcdefghijklmnopqrstuvwxyz"),
    (_HEX, b"0123456789abcdef"),
):
    _table[list(_chars)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LENGTHS = np.array([1, 4, 8, 12, 16, 24, 32, 48])
_WORD_SLOTS = 512
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
#: Sizes of the feature families: shape, length x digits, case, previous word, next word, previous length, next length, mark between, file,
#: length x changes of case, length x vowels.
FAMILIES = (8 * 5 * 2 * 4, 8 * 5, 5, _WORD_SLOTS, _WORD_SLOTS, 9, 9, 4, 6, 8 * 5, 8 * 5)
_AT = np.concatenate([[0], np.cumsum(FAMILIES)])
FEATURES = int(_AT[-1])


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of maximal runs of the characters that secrets are written in."""
    n = len(raw)
    solid = _TOKEN[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    s = np.flatnonzero(solid & (~before | edge[:-1]))
    e = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def features(raw: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray) -> np.ndarray:
    """tokens x families: each family's feature of a token, as a number below FEATURES."""
    n, docs = len(s), len(offsets) - 1
    total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    within = lambda c: c[e] - c[s]
    size = (e - s).astype(np.int64)
    digit, upper, lower = _DIGIT[raw], _UPPER[raw], _LOWER[raw]
    digits, uppers, lowers = total(digit), total(upper), total(lower)
    d, u, w = within(digits), within(uppers), within(lowers)
    switch = np.zeros(len(raw), bool)
    switch[1:] = digit[1:] != digit[:-1]
    turns = total(switch)
    length = np.searchsorted(_LENGTHS, size, "right") - 1
    share = np.where(d == 0, 0, np.where(d == size, 4, 1 + (d * 5 >= size).astype(int) + (d * 5 >= 3 * size)))
    case = np.where(u + w == 0, 0, np.where(u == 0, 1, np.where(w == 0, 2, np.where((u == 1) & _UPPER[raw[s]], 3, 4))))
    sw = np.searchsorted([1, 3, 6], turns[e] - turns[np.minimum(s + 1, len(raw))], "right")
    hexed = (within(total(_HEX[raw])) == size).astype(int)
    word = (span_hashes(_FOLD[raw], s, e) % np.uint64(_WORD_SLOTS)).astype(np.int64)
    inner, outer = np.zeros(n, bool), np.zeros(n, bool)
    inner[1:], outer[:-1] = row[1:] == row[:-1], row[1:] == row[:-1]
    shift = lambda v, by, has, none: np.where(has, np.roll(v, by), none)
    mark = total((raw == 58) | (raw == 61))
    gap_from = np.where(inner, np.roll(e, 1), s)
    between = (mark[s] - mark[gap_from] > 0).astype(int) + 2 * (s - gap_from > 1)
    per = np.diff(offsets)
    share_d = np.where(per > 0, (digits[offsets[1:]] - digits[offsets[:-1]]) / np.maximum(per, 1), 0)
    marks = mark[offsets[1:]] - mark[offsets[:-1]]
    file = np.searchsorted([0.005, 0.05], share_d, "right") * 2 + (marks * 200 > per)
    change = np.zeros(len(raw), bool)
    change[1:] = (lower[:-1] & upper[1:]) | (upper[:-1] & lower[1:])
    cases = total(change)
    turned = np.searchsorted([1, 3, 6, 10], cases[e] - cases[np.minimum(s + 1, len(raw))], "right")
    letters = u + w
    vowels = np.where(letters < 4, 0, 1 + np.searchsorted([0.12, 0.22, 0.32], within(total(_VOWEL[raw])) / np.maximum(letters, 1), "right"))
    cols = (((length * 5 + share) * 2 + hexed) * 4 + sw, length * 5 + share, case, shift(word, 1, inner, 0), shift(word, -1, outer, 0), shift(length, 1, inner, 8), shift(length, -1, outer, 8), between, file[row] if docs else row, length * 5 + turned, length * 5 + vowels)
    return np.stack([c + a for c, a in zip(cols, _AT[:-1], strict=True)], axis=1) if n else np.zeros((0, len(FAMILIES)), np.int64)


@dataclass
class Chain:
    """Weights of features by tag, and of steps from tag to tag."""

    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 3))
        for f in range(x.shape[1]):
            out += self.weights[x[:, f]]
        return out

    def marginals(self, e: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of tags and the expected number of each step from tag to tag, for n x length x 3 emissions, and the
        logarithms of the sequences' normalisers. Where `real` is not set, at the ends, there is nothing."""
        n, size, _ = e.shape
        steps = self.steps
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        lse = lambda z, ax: z.max(axis=ax) + np.log(np.exp(z - np.expand_dims(z.max(axis=ax), ax)).sum(axis=ax))
        for t in range(1, size):
            fwd[:, t] = np.where(real[:, t, None], lse(fwd[:, t - 1, :, None] + steps, 1) + e[:, t], fwd[:, t - 1])
            u = size - 1 - t
            bwd[:, u] = np.where(real[:, u + 1, None], lse(steps + (bwd[:, u + 1] + e[:, u + 1])[:, None, :], 2), 0.0)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + steps + (bwd + e)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        return p, pair.sum(axis=(0, 1)), z

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of sequences, n x length x 3 emissions."""
        n, size, _ = e.shape
        best, back = e[:, 0], np.zeros((n, size, 3), np.int64)
        for t in range(1, size):
            ways = best[:, :, None] + self.steps[None]
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[:, t]
        tags = np.zeros((n, size), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def decode(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Best tags of all tokens; rows are texts of their own."""
        e = self.emissions(x)
        t = self.steps
        gain = max((t[:, y] - t[:, O]).max() + (t[y] - t[O]).max() for y in (B, I))
        gain = max(gain, max((t[:, y] - t[:, O]).max() for y in (B, I)), max((t[y] - t[O]).max() for y in (B, I)), 0.0)
        open_ = np.flatnonzero(e[:, O] - e[:, :O].max(axis=1) <= gain)
        tags = np.full(len(x), O)
        if not len(open_):
            return tags
        first = np.flatnonzero(np.concatenate([[True], (np.diff(open_) != 1) | (row[open_[1:]] != row[open_[:-1]])]))
        starts, sizes = open_[first], np.diff(np.append(first, len(open_)))
        ends = starts + sizes
        # A stretch is decoded with the outside tokens next to it, where the text has them.
        left = (starts > 0) & (row[np.maximum(starts - 1, 0)] == row[starts])
        right = (ends < len(x)) & (row[np.minimum(ends, len(x) - 1)] == row[ends - 1])
        starts, sizes = starts - left, sizes + left + right
        for size in np.unique(sizes):
            at = starts[sizes == size]
            for k in range(0, len(at), 1 + 2_000_000 // int(size)):
                idx = at[k : k + 1 + 2_000_000 // int(size), None] + np.arange(size)
                tags[idx] = self.viterbi(e[idx])
        return tags

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, real: np.ndarray | None = None) -> Chain:
        """Maximum likelihood of tags y (n x length) given features x (n x length x families), by Adam on all sequences.

        real: where a sequence has tokens; behind its last one it is filled up with what counts for nothing.
        """
        n, size = y.shape
        real = np.ones(y.shape, bool) if real is None else real
        both = real[:, 1:]
        weights, steps = np.zeros((FEATURES, 3)), np.zeros((3, 3))
        chain = cls(weights, steps)
        seen = np.zeros_like(weights)
        np.add.at(seen, (x[real], y[real][:, None]), 1.0)
        seen_steps = np.zeros((3, 3))
        np.add.at(seen_steps, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        m, v = [np.zeros_like(weights), np.zeros_like(steps)], [np.zeros_like(weights), np.zeros_like(steps)]
        flat = x.reshape(-1, x.shape[2])
        for r in range(1, ROUNDS + 1):
            e = chain.emissions(flat).reshape(n, size, 3)
            p, pair, _ = chain.marginals(e, real)
            p = p.reshape(-1, 3)
            expected = np.stack([sum(np.bincount(flat[:, f], p[:, c], FEATURES) for f in range(flat.shape[1])) for c in range(3)], axis=1)
            for k, (w, g) in enumerate(((weights, (seen - expected) / n - DECAY * weights), (steps, (seen_steps - pair) / n - DECAY * steps))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w += STEP * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.999**r)) + 1e-8)
        return chain


def _code_points(raw: np.ndarray, start: int, at: np.ndarray) -> np.ndarray:
    """Code points from byte `start` to each byte of `at`."""
    if not len(at):
        return at
    heads = np.concatenate([[0], np.cumsum((raw[start : int(at.max()) + 1] & 0xC0) != 0x80)])
    return heads[at - start]


def made_up(rng: np.random.Generator) -> tuple[str, str]:
    """What comes before a made-up secret, and the secret."""
    draw = lambda letters, n: "".join(rng.choice(list(letters), int(n)))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kind = int(rng.integers(0, 6))
    if kind == 0:
        value = draw(digits + lower + upper, rng.integers(16, 44))
    elif kind == 1:
        value = draw(digits + lower + upper + "+/", rng.integers(20, 60)) + "=" * int(rng.integers(0, 3))
    elif kind == 2:
        value = draw(lower, rng.integers(2, 5)) + str(rng.choice(["_", "-"])) + draw(digits + lower + upper, rng.integers(16, 40))
    elif kind == 3:
        value = draw(digits + "abcdef", rng.integers(16, 32))
    elif kind == 4:
        value = draw(digits + upper, rng.integers(16, 32))
    else:
        value = draw(lower + upper, rng.integers(4, 8)) + draw(digits, rng.integers(2, 6)) + draw(lower + upper + digits, rng.integers(2, 6))
    named = kind == 5 or rng.random() < 0.6
    word = str(rng.choice(BEFORE))
    if named and rng.random() < 0.4:
        word = word.upper() if rng.random() < 0.5 else word.capitalize()
    return (word + str(rng.choice([" ", ": ", " = ", "=\"", ": '"])) if named else ""), value


def harmless(rng: np.random.Generator) -> str:
    """A long token that is no secret."""
    n = lambda a, b: int(rng.integers(a, b))
    word = lambda: "".join(str(rng.choice(list("bcdfglmnprst"))) + str(rng.choice(list("aeiou"))) for _ in range(n(2, 5)))
    made = (
        lambda: f"{n(1990, 2040)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}.{n(10, 60)}",
        lambda: str(n(10**9, 10**17)),
        lambda: "-".join(word() for _ in range(n(2, 6))),
        lambda: "_".join(word() for _ in range(n(2, 6))),
        lambda: "".join(word().capitalize() for _ in range(n(2, 5))),
        lambda: "/".join(["www." + word() + ".org", *(word() for _ in range(n(1, 5)))]) + ".html",
        lambda: str(rng.choice(list("=-._"))) * n(8, 50),
        lambda: "".join(word() for _ in range(n(2, 5))),
        lambda: f"{word()}-{n(1, 20)}.{n(0, 20)}.{n(0, 20)}",
        lambda: "".join(word() for _ in range(n(2, 4))).upper(),
        lambda: "-".join(str(n(100, 10_000)) for _ in range(n(2, 6))),
    )
    return str(made[n(0, len(made))]())


def exercises(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int]], list[int]]:
    """A text with made-up secrets and harmless tokens put in: the text, the places of all secrets, and places of the harmless."""
    gaps = [m.start() for m in re.finditer(r" ", text)] or [len(text)]
    spots = sorted(rng.choice(gaps, min(len(gaps), int(rng.integers(2, 7))), replace=False).tolist())
    out, secrets, others, size, last = [], [], [], 0, 0
    for k, at in enumerate(spots):
        before, value = made_up(rng) if k % 2 == 0 else ("", harmless(rng))
        out += [text[last:at], " ", before, value]
        size += at - last + 1 + len(before)
        (secrets if k % 2 == 0 else others).append((size, size + len(value)))
        size, last = size + len(value), at
    new = "".join([*out, text[last:]])
    return new, secrets + values(new), [a for a, _ in others]


def values(text: str) -> list[tuple[int, int]]:
    """Places of the secrets themselves in the base spans: of an assignment, what is assigned."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    return found + [(a, z) for a, kind, z in base_spans(text) if kind]


def sampled(docs: DataFrame) -> list[str]:
    """Texts to fit to: with base spans, then without; bounded by MOST_TEXTS each."""
    rows = docs.count()
    some = docs.where("text is not null and text != ''").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    if rows > MOST_SAMPLED:
        some = some.where(F.col("h") < int(-(2**63) + 2**64 * (MOST_SAMPLED / rows)))
    hit = F.col("text").rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]{8}") | F.col("text").rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    # Of equal texts one counts, so that a text that a third of all rows have does not stand for all.
    small = storage.staged(some.groupBy("h").agg(F.min("text").alias("text")).withColumn("hit", hit), "secret-texts")
    out = [[r.text for r in small.where(cond).orderBy("h", "text").limit(MOST_TEXTS).collect()] for cond in ("hit", "not hit")]
    storage.discard(small)
    return out[0] + out[1]


def windows(text: str, spans: list[tuple[int, int]], centres: list[int], plain: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """Features and tags of 2 * WINDOW tokens around each span and each centre (code points), and of others spread over the text,
    with the number of tokens that are real and whether a span is in the middle."""
    raw, offsets = text_buffer(pa.array([text]))
    if not len(raw):
        return
    s, e, row = tokens(raw, offsets)
    if not len(s):
        return
    y = np.full(len(s), O)
    start, end = _code_points(raw, 0, s), _code_points(raw, 0, e - 1) + 1
    middle = []
    for a, z in sorted(spans):
        first, last = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, z, "left"))
        if first < last:
            y[first:last] = I
            y[first] = B
            middle.append(first)
    x = features(raw, offsets, s, e, row)
    calm = [int(np.searchsorted(end, c, "right")) for c in centres] + np.linspace(0, len(s) - 1, plain).astype(int).tolist()
    for c, around in [(c, True) for c in middle] + [(c, False) for c in calm]:
        a = max(0, min(c - WINDOW, len(s) - 2 * WINDOW))
        n = min(2 * WINDOW, len(s) - a)
        fill = ((0, 2 * WINDOW - n), (0, 0))
        yield np.pad(x[a : a + n], fill), np.pad(y[a : a + n], fill[:1], constant_values=O), n, around


def fitted(texts: list[str]) -> Chain | None:
    """A chain fitted to texts with and without base spans; None without texts. Equal texts in equal order give an equal chain."""
    rng = np.random.default_rng(0)
    around, others = [], []
    for text in texts:
        changed, spans, calm = exercises(text, rng)
        for found in (windows(text, values(text), [], PLAIN), windows(changed, spans, calm, PLAIN)):
            for w in found:
                (around if w[3] else others).append(w)
    around = around[:: -(-len(around) // MOST_WINDOWS) or 1]
    if not around:
        return None
    every = around + others
    real = np.arange(2 * WINDOW) < np.array([w[2] for w in every])[:, None]
    return Chain.fit(np.array([w[0] for w in every]), np.array([w[1] for w in every]), real)


def train(docs: DataFrame) -> Chain | None:
    """A chain fitted to sampled() texts; None if there are none with words."""
    return fitted(sampled(docs))


def chain_spans(raw: np.ndarray, offsets: np.ndarray, chain: Chain) -> dict[int, list[tuple[int, int]]]:
    """By row, (start, end) in code points of what the chain tags."""
    if not len(raw):
        return {}
    s, e, row = tokens(raw, offsets)
    if not len(s):
        return {}
    tags = chain.decode(features(raw, offsets, s, e, row), row)
    hot = np.flatnonzero(tags != O)
    if not len(hot):
        return {}
    first = np.concatenate([[True], (np.diff(hot) != 1) | (row[hot[1:]] != row[hot[:-1]]) | (tags[hot[1:]] == B)])
    begin = hot[first]
    last = np.append(hot[np.flatnonzero(first)[1:] - 1], hot[-1])
    out: dict[int, list[tuple[int, int]]] = {}
    for k in np.unique(row[begin]).tolist():
        mine = row[begin] == k
        a, z = _code_points(raw, int(offsets[k]), s[begin[mine]]), _code_points(raw, int(offsets[k]), e[last[mine]] - 1) + 1
        out[k] = [(p, q) for p, q in zip(a.tolist(), z.tolist(), strict=True) if q - p >= LEAST]
    return out


def _worth_matching(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may have base spans: a run of 32 hex digits, "AKIA", or a keyword followed by a colon or equals sign."""
    n = len(offsets) - 1
    out = np.zeros(n, bool)
    folded = _FOLD[raw]
    run = np.concatenate([[0], np.cumsum(_HEX[raw], dtype=np.int32)])
    if len(raw) >= 32:
        out[np.searchsorted(offsets, np.flatnonzero(run[32:] - run[:-32] == 32), "right") - 1] = True
    for word, text in ((b"AKIA", raw), *((k.encode(), folded) for k in KEYWORDS)):
        whole, at = text.tobytes(), -1
        while (at := whole.find(word, at + 1)) >= 0:
            out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf: one row per document, repeated rows included.

    spans: kind:start:end in code points, by start, then kind. The chain's spans have the kind "crf"; those that touch a
    base span, or are shorter than LEAST, are left out. A null or empty text has no spans; without any text there is no chain.
    """
    storage.small_batches(docs.sparkSession)
    chain = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            counts, sums, spans = np.zeros((b.num_rows, 4), np.int64), [nothing] * b.num_rows, [""] * b.num_rows
            for i, j in doc_blocks(offsets):
                part, cut = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                more = chain_spans(part, cut, model) if model is not None else {}
                for k in {*np.flatnonzero(_worth_matching(part, cut)).tolist(), *more}:
                    base = base_spans(part[cut[k] : cut[k + 1]].tobytes().decode())
                    extra = [(a, 3, z) for a, z in more.get(k, []) if all(z <= p or a >= q for p, _, q in base)]
                    kinds = (*BASE, FOUND)
                    show = lambda found, kinds=kinds: ",".join(f"{kinds[c]}:{a}:{z}" for a, c, z in sorted(found))
                    sums[i + k], spans[i + k] = hashlib.sha256(show(base).encode()).hexdigest(), show(base + extra)
                    counts[i + k] = np.bincount([c for _, c, _ in base + extra], minlength=4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, c]) for c in range(3)), pa.array(sums), pa.array(spans), pa.array(counts[:, 3])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find() of all documents."""
    return find(storage.read(spark, sf_dir, "documents"))
