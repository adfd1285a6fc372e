"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Terms are whole words and word beginnings that mark toxic texts among the labelled ones. They form a trie. Each distinct
word of a document is met with the trie by walking it together with the word's Levenshtein automaton, so misspelled terms
are found at a bounded edit distance: letters changed, missing, added, or swapped with their neighbour. A hit's probability
depends on its term, its distance and the window of words around it: inside quotation marks or after a verb of reporting it
weighs less, next to a second-person pronoun more. Learning looks at the same windows: texts that only quote or report a term
don't count for it, neither toxic nor clean ones. A document's score joins its hits' probabilities.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import storage
from waymark.llm.quality import remainder, sample

#: At most so many labelled texts are learned from: those with the least hashes of doc_id.
MOST_LABELLED = 4000
PREFIX_LENGTHS = range(3, 9)
#: Terms of at least so many letters are found at edit distance 1, and 2; word beginnings and shorter terms must be exact, and
#: so must terms of more than LONGEST_FUZZY letters.
FUZZY_FROM, TWO_FROM, LONGEST_FUZZY = 5, 12, 40
#: How many times as frequent in toxic texts a term is at least, with both counts one standard error to its disadvantage, and
#: how surprising that is (nats of log-likelihood).
RATIO, SURPRISE = 15, 16
#: A beginning gives way to a longer term that has this share of its texts.
COVERED = 0.85
WINDOW = 5
EDGE = ".,;:!?…*%&$#|\"'`´()[]{}<>«»“”„‘’-_~=+/\\"
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says saying wrote writes called calls quote quoted quoting means word term dijo dice escribió palabra sagte sagt schrieb wort dit disait écrit mot".split())
PERSONS = frozenset("you your you're youre u du dich dir ihr tú tu te usted vous toi ton".split())
#: Words that a worker remembers before it starts afresh; a matter of speed and memory only.
CACHED_WORDS = 250_000
#: Factors of a hit's log-odds by context: plain, quoted or reported, aimed at a person.
CONTEXT = {"plain": 1.0, "quoted": 0.35, "aimed": 1.3}
#: By how much less than the log-odds of a text without hits may lie, of which the labelled texts choose.
CALMER = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5)


def norm(token: str) -> str:
    return token.strip(EDGE)


def unquoted(text: str | None) -> set[str]:
    """The words of a text that occur in it outside quotations and reports."""
    tokens = (text or "").lower().split()
    asked: set[int] = set()
    for i, t in enumerate(tokens):
        if t[0] in QUOTES:
            asked.update(range(i, i + WINDOW + 1))
        if norm(t) in REPORTING:
            asked.update((i + 1, i + 2))
    skip = {i for i in asked if i < len(tokens) and context(tokens, i) == "quoted"}
    return {w for i, t in enumerate(tokens) if i not in skip and (w := norm(t))}


def edits_allowed(term: str) -> int:
    """At how many edits a whole-word term is still found."""
    return 0 if not FUZZY_FROM <= len(term) <= LONGEST_FUZZY else 1 if len(term) < TWO_FROM else 2


def shortened(word: str, most: int) -> set[str]:
    """The word without up to `most` of its letters. Words within `most` edits of each other have such a string in common."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Levenshtein:
    """The automaton of a word; a swap of neighbouring letters is one edit.

    States are sets of (place, edits), kept as the least edits per place within `most`; place -1 - i is that of a swap of
    letters i and i + 1 of which the first half is read.
    """

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most
        self.moves: dict[tuple, tuple] = {}

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.most, len(self.word)) + 1))

    def step(self, state: tuple, c: str) -> tuple:
        key = (state, c)
        if key not in self.moves:
            best: dict[int, int] = {}
            n, word = len(self.word), self.word

            def put(i: int, e: int) -> None:
                while i <= n and e <= self.most and best.get(i, self.most + 1) > e:
                    best[i] = e
                    i, e = i + 1, e + 1  # a letter of the word is left out

            for i, e in state:
                if i < 0:
                    if word[-1 - i] == c:
                        put(1 - i, e)
                    continue
                if i < n:
                    put(i + 1, e + (word[i] != c))
                put(i, e + 1)
                if i + 1 < n and word[i + 1] == c and e < self.most:
                    best[-1 - i] = min(e + 1, best.get(-1 - i, self.most))
            self.moves[key] = tuple(sorted(best.items()))
        return self.moves[key]

    def distance(self, state: tuple) -> int | None:
        """Edits with which the whole word is read; None if too many."""
        return next((e for i, e in state if i == len(self.word)), None)


@dataclass
class Lexicon:
    """terms: (text, whole word?) to log-odds; bias: log-odds of a text without hits; fuzzy_odds: (term, distance) to log-odds."""

    terms: dict[tuple[str, bool], float]
    bias: float
    fuzzy_odds: dict[tuple[str, int], float] = field(default_factory=dict)

    def __post_init__(self):
        self.trie: dict = {}
        # Per number of edits: what is left of the terms found at so many, and the lengths of words that can be near them.
        self.left: dict[int, set[str]] = {1: set(), 2: set()}
        self.sizes: dict[int, set[int]] = {1: set(), 2: set()}
        for text, whole in self.terms:
            if whole:
                node = self.trie
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = text
                if k := edits_allowed(text):
                    self.left[k] |= shortened(text, k)
                    self.sizes[k].update(range(len(text) - k, len(text) + k + 1))
        self.prefixes = {t for t, whole in self.terms if not whole}
        self.cache: dict[str, tuple | None] = {}
        self.met: set[str] = set()
        self.hot: dict[str, tuple] = {}
        # Most words have neither the first nor the last two letters of a term and need no lookup. One edit leaves either of
        # these as they are; where two spoil both, the letters between stay, moved by one place at most.
        whole = [t for t, w in self.terms if w]
        self.first_two = {t[:2] for t in whole}
        self.last_two = {t[-2:] for t in whole if edits_allowed(t)}
        self.middles = {t[3:6] for t in whole if edits_allowed(t) == 2}
        self.first_three = {t[:3] for t in self.prefixes}

    def near(self, word: str) -> list[tuple[str, int]]:
        """(term, distance) of the whole-word terms within the distance allowed: trie and automaton, walked together."""
        auto = Levenshtein(word, 2 if len(word) in self.sizes[2] else 1)
        found, todo = [], [(self.trie, auto.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    d = auto.distance(state)
                    if d is not None and (d == 0 or d <= edits_allowed(child)):
                        found.append((child, d))
                elif after := auto.step(state, c):
                    todo.append((child, after))
        return found

    def may_match(self, w: str) -> bool:
        return (
            w[:2] in self.first_two
            or w[-2:] in self.last_two
            or w[:3] in self.first_three
            or len(w) >= TWO_FROM - 2
            and (w[3:6] in self.middles or w[2:5] in self.middles or w[4:7] in self.middles)
        )

    def lookup(self, word: str) -> tuple | None:
        """(term, whole word?, distance) of the likeliest match, or None."""
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        found = None
        if (word, True) in self.terms:
            found = (word, True, 0)
        elif self.may_match(word):
            hits = [(self.terms[p, False], p, False, 0) for k in PREFIX_LENGTHS if len(word) >= k and (p := word[:k]) in self.prefixes]
            if not hits and any(len(word) in self.sizes[k] and not self.left[k].isdisjoint(shortened(word, k)) for k in (1, 2)):
                hits = [(self.odds((t, True, d)), t, True, d) for t, d in self.near(word)]
            if hits:
                found = max(hits)[1:]
        self.cache[word] = found
        return found

    def odds(self, hit: tuple) -> float:
        term, whole, distance = hit
        return self.fuzzy_odds.get((term, distance), 0.8**distance * self.terms[term, True]) if distance else self.terms[term, whole]

    def score(self, text: str) -> tuple[float, int]:
        """Probability that a text is toxic, and the number of hits."""
        tokens = text.lower().split()
        each = set(tokens)
        new = each - self.met
        if new:
            for t in new:
                w = t.strip(EDGE)
                if self.may_match(w) and (h := self.lookup(w)):
                    self.hot[t] = h
            if len(self.met) > CACHED_WORDS:
                self.met.clear()
            self.met |= new
        hot = {t: self.hot[t] for t in each & self.hot.keys()}
        calm = 1 / (1 + math.exp(-self.bias))
        if not hot:
            return calm, 0
        at = [(i, hot[t]) for i, t in enumerate(tokens) if t in hot]
        clean = 1 - calm
        for i, h in at:
            p = 1 / (1 + math.exp(-(self.bias + self.odds(h) * CONTEXT[context(tokens, i)])))
            clean *= 1 - max(p, 0.0)
        return 1 - clean, len(at)


def context(tokens: list[str], i: int) -> str:
    """Whether the token stands in a quotation, is aimed at a person, or neither."""
    before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
    opened = any(t[0] in QUOTES for t in [*before, tokens[i]]) and not any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?")[-1:] for t in before if t[0] not in QUOTES)
    closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?") != "" for t in [tokens[i], *after])
    if opened and closed or any(norm(t) in REPORTING for t in before[-2:]):
        return "quoted"
    if any(norm(t) in PERSONS for t in [*before[-3:], *after[:3]]):
        return "aimed"
    return "plain"


def learn(docs: DataFrame, labels: DataFrame, which: Column, most: int = MOST_LABELLED) -> Lexicon:
    """The lexicon of the labelled texts; without toxic ones it is empty.

    Counts of texts per term are grouped on the executors; the terms that pass come to the driver, which the bounded number of
    labelled texts bounds as well.
    """
    spark = docs.sparkSession
    storage.small_batches(spark)
    ids = sample(labels, "toxic", which, most)
    toxic = sum(y for _, y in ids)
    clean = len(ids) - toxic
    known = spark.createDataFrame(ids, "__id long, y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("y", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, c = Counter(), Counter()
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                each = unquoted(text)
                n = t if y else c
                n.update((w, True) for w in each)
                n.update({(w[:k], False) for w in each for k in PREFIX_LENGTHS if len(w) > k})
            keys = list(t.keys() | c.keys())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.bool_()), pa.array([t[k] for k in keys], pa.int64()), pa.array([c[k] for k in keys], pa.int64())], ["term", "whole", "t", "c"])

    per = rows.mapInArrow(terms, "term string, whole boolean, t long, c long").groupBy("term", "whole").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # A term marks toxic texts if it is RATIO times as frequent in them, and chance would hardly have it so.
    n, share, base = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c")), max(toxic, 1) / max(len(ids), 1)
    other = F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base + 1e-9))).otherwise(0.0)
    per = per.where((F.col("t") > 0) & ((F.col("t") - F.sqrt("t") + 0.5) * (clean + 1) > (F.col("c") + F.sqrt("c") + 0.5) * (toxic + 1) * RATIO) & (F.col("t") * F.log(share / base) + other > SURPRISE) & (n > 0))
    lexicon = Lexicon(*choose([(r.term, r.whole, r.t, r.c) for r in per.collect()], toxic, clean))
    lexicon.fuzzy_odds = misspelt(rows, lexicon, toxic, clean)
    lexicon.bias -= calmer(rows, lexicon)
    return lexicon


def calmer(rows: DataFrame, lexicon: Lexicon) -> float:
    """The least step of CALMER that predicts about as few labelled texts wrongly as the best one: within a standard error, as
    the terms come from the same texts. How much evidence a document needs depends on how often clean ones hit a term by chance."""
    shared = (lexicon.terms, lexicon.bias, lexicon.fuzzy_odds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared)
        for b in batches:
            wrong = [0] * len(CALMER)
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, less in enumerate(CALMER):
                    lex.bias = shared[1] - less
                    wrong[k] += (lex.score(text or "")[0] >= 0.5) != bool(y)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(CALMER)), pa.int32()), pa.array(wrong, pa.int64())], ["k", "wrong"])

    found = rows.mapInArrow(work, "k int, wrong long").groupBy("k").agg(F.sum("wrong").alias("wrong")).collect()
    fewest = min((r.wrong for r in found), default=0)
    return CALMER[min((r.k for r in found if r.wrong <= fewest + math.sqrt(fewest)), default=0)]


def misspelt(rows: DataFrame, lexicon: Lexicon, toxic: int, clean: int) -> dict[tuple[str, int], float]:
    """Log-odds of a term at each distance, from the labelled texts in which words so near it occur; without any, nearly its own."""
    shared = (lexicon.terms, lexicon.bias)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared)
        for b in batches:
            out = []
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = {lex.lookup(w) for w in unquoted(text)} - {None}
                out += [(h[0], h[2], y) for h in hits if h[2]]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in out], pa.string()), pa.array([d for _, d, _ in out], pa.int32()), pa.array([y for _, _, y in out], pa.int32())], ["term", "d", "y"])

    met = {(r.term, r.d): (r.t, r.c) for r in rows.mapInArrow(near, "term string, d int, y int").groupBy("term", "d").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).collect()}
    out = {}
    for (term, whole), odds in lexicon.terms.items():
        for d in range(1, edits_allowed(term) + 1) if whole else ():
            t, c = met.get((term, d), (0, 0))
            unseen = math.exp(-(0.8**d) * odds) * (clean + 1) / (toxic + 1)
            out[term, d] = min(odds, math.log((t + 1) / (toxic + 1)) - math.log((c + unseen) / (clean + 1)))
    return out


def choose(found: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> tuple[dict[tuple[str, bool], float], float]:
    """The terms worth keeping: of a beginning and what extends it, the longest that nearly all its texts have.

    Whole words for which a beginning stands are kept besides: beginnings match exactly only, misspellings need the words.
    """
    bias = min(-3.0, math.log((toxic + 1) / (clean + 1)))
    longer: dict[str, int] = {}  # the most texts of anything that extends a beginning
    for term, whole, t, _ in found:
        for k in PREFIX_LENGTHS:
            if k < len(term) + whole:
                longer[term[:k]] = max(longer.get(term[:k], 0), t)
    kept: dict[tuple[str, bool], float] = {}
    wide: set[str] = set()
    begun: set[str] = set()  # beginnings of what is kept
    for term, whole, t, c in sorted(found, key=lambda x: (-x[2], not x[1], -len(x[0]), x[0])):
        if not whole:
            if any(term[:k] in wide for k in PREFIX_LENGTHS if k < len(term)):
                continue  # a shorter beginning stands for it
            if term in begun:
                continue  # something longer has nearly as many texts, or covers it
            if longer.get(term, 0) >= COVERED * t:
                continue
            wide.add(term)
        kept[term, whole] = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        begun.update(term[:k] for k in PREFIX_LENGTHS if k <= len(term))
    return kept, bias


_LEXICONS: dict[str, Lexicon] = {}


def lexicon_of(name: str, parts: tuple) -> Lexicon:
    """The worker's one lexicon of this name, with the words that it has met."""
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(*parts)
    return _LEXICONS[name]


def scored(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns named, then score and hits; a null text is an empty one."""
    storage.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.bias, lexicon.fuzzy_odds))
    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at, wide, name = rows.columns.index("text"), len(keep), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon_of(name, shared.value)
        for b in batches:
            s = [lex.score(x.as_py() or "") for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], pa.array([x for x, _ in s], pa.float64()), pa.array([n for _, n in s], pa.int64())], [*keep, "__score", "__hits"])

    return rows.mapInArrow(work, rows.select(*keep).schema.add("__score", "double").add("__hits", "long"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, hits of every document. Repeated rows are scored as often as they occur; a null
    id is not held out; a text without hits, empty ones too, has the score of the bias alone."""
    docs, labels = storage.read(spark, sf_dir, "documents"), storage.read(spark, sf_dir, "labels")
    out = scored(docs, learn(docs, labels, remainder(5) != 0), ["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), F.col("__hits").alias("hits"))
