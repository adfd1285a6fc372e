"""Personal data by regular expressions, checksum validators and context words, in built-in functions only.

A pattern's matches and their places come from two scans: regexp_extract_all gives the matches and split the texts between
them, so a match starts where the lengths before it end. Patterns are written with possessive quantifiers and bounded
repeats; they match what the plain forms in KINDS say, without deep recursion or long backtracking on odd texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import storage

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (characters without which there is no match, pattern, context words). Order breaks ties of equal starts.
KINDS = {
    "email": (r"@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "e-?mail|mail|contact|write|correo|courriel"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\bip\b|address|host|server|dirección|adresse"),
    # A maximal run of digits with single separators; only those of 12 to 19 digits can pass.
    "card": (r"[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])", "card|visa|credit|debit|tarjeta|carte|karte|pay"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", "phone|tel|call|mobile|fax|llam|appel|anruf"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban|account|bank|cuenta|compte|konto"),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span without and with a context word among the characters before it.
PLAIN_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
CONTEXT_BONUS, CONTEXT_CHARS = 0.1, 40
#: Code points of a chunk of text, and elements of a scan's block; matters of speed only.
CHUNK, SCAN_BLOCK = 1024, 256
SPANS = "array<struct<start:int,kind_order:int,kind:string,end:int,match:string,score:double>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def scan(values: Column, step) -> Column:
    """array<int>: at i, what `step` makes of 0 and all values before i.

    Values are scanned in blocks: growing one array by one element after the other would take time with the square of
    their number, and here only the blocks' results are scanned so.
    """
    none = F.array().cast("array<int>")
    grow = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    plain = lambda v, base: F.aggregate(v, F.struct(base.alias("at"), none.alias("out")), grow, lambda acc: acc["out"])
    block = lambda v, k: F.slice(v, k * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / SCAN_BLOCK), F.lit(0)).cast("int")), lambda k: block(v, k))
    bases = lambda blocks: plain(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), step)), F.lit(0))
    return let(values, lambda v: let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, bases(blocks), plain))))


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points: any part of it is near the beginning of a piece, as cut() finds it."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def cut(pieces: Column, at: Column, n: Column) -> Column:
    """n code points from the place `at` (from 0) of a text in chunks()."""
    first, last = F.floor(at / CHUNK).cast("int"), F.floor((at + F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")
    return F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), at - first * CHUNK + 1, n)


def located(text: Column) -> Column:
    """array<struct<start, kind_order, kind, end, match>>: the leftmost non-overlapping matches of each kind, in code points."""
    none = F.array().cast("array<string>")

    def scanned(order: int, kind: str) -> Column:
        needs, pattern, _ = KINDS[kind]
        found = F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
        between = lambda f: F.when(F.size(f) > 0, F.slice(F.split(text, pattern, -1), 1, F.size(f))).otherwise(none)
        return let(found, lambda f: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), f.alias("found"), between(f).alias("between")))

    def spans(k: Column) -> Column:
        pairs = F.zip_with(k["between"], k["found"], lambda a, b: F.struct(F.length(a).alias("skip"), F.length(b).alias("size"), b.alias("match")))
        starts = lambda p: scan(F.transform(p, lambda x: x["skip"] + x["size"]), lambda a, b: a + b)
        place = lambda x, at: F.struct((at + x["skip"]).alias("start"), k["order"].alias("kind_order"), k["kind"].alias("kind"), (at + x["skip"] + x["size"]).alias("end"), x["match"].alias("match"))
        return let(pairs, lambda p: F.zip_with(p, starts(p), place))

    every = F.array(*[scanned(order, kind) for order, kind in enumerate(KINDS)])
    return F.flatten(F.transform(F.filter(every, lambda k: F.size(k["found"]) > 0), spans))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)
    worth = lambda i: F.substr(number, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(worth(i) > 9, worth(i) - 9).otherwise(worth(i))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check: four characters moved to the end, letters as 10 to 35, rest 1."""
    bare = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    value = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(turned, i, F.lit(1))) - 1
    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda acc, i: (acc * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97)
    return (rest == 1) & F.length(bare).between(15, 34)


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match passes the validator of its kind."""
    octet = lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")
    return (
        F.when(kind == "ip", F.forall(F.split(m, r"\."), octet))
        .when(kind == "card", luhn(digits(m)))
        .when(kind == "phone", F.length(digits(m)).between(9, 15))
        .when(kind == "iban", mod97(m))
        .otherwise(F.lit(True))
    )


def _scored(pieces: Column, s: Column) -> Column:
    """A span with its score, from its kind and the characters before it."""
    before = F.lower(cut(pieces, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), F.least(s["start"], F.lit(CONTEXT_CHARS))))
    value = F.lit(None).cast("double")
    for kind, (_, _, near) in KINDS.items():
        value = F.when(s["kind"] == kind, F.lit(PLAIN_SCORE[kind]) + F.when(before.rlike(near), CONTEXT_BONUS).otherwise(0.0)).otherwise(value)
    return F.struct(*[s[c].alias(c) for c in ("start", "kind_order", "kind", "end", "match")], value.alias("score"))


def find(docs: DataFrame, to: str = "pii") -> DataFrame:
    """docs with one more column, named by `to`: array<struct<start, kind_order, kind, end, match, score>> by start, then kind.

    Starts and ends are code points of the whole text, ends exclusive. A null or empty text has no spans. Time is linear in
    the length of a text and in the number of its spans.
    """
    text = F.coalesce("text", F.lit(""))
    spans = F.array_sort(F.filter(located(text), lambda s: _valid(s["kind"], s["match"])))
    none = F.array().cast(SPANS)
    scored = lambda found: F.when(F.size(found) == 0, none).otherwise(let(chunks(text), lambda pieces: F.transform(found, lambda s: _scored(pieces, s))))
    return docs.withColumn(to, let(spans, scored))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, sha256 of the base spans, all spans, then n_iban and the highest score (null: no span).

    One row per document, repeated rows included; a null or empty text has no spans and the digest of an empty list. Spans
    of equal starts follow the order of KINDS. An empty table gives no rows; other columns take no part.
    """
    base = lambda s: s["kind"].isin(*BASE)
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(F.filter("pii", base)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        count("iban"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by [KIND] and n_chars put right; a span that begins inside another is part of it.

    Rows without spans stay as they are, null texts too; columns and their order stay.
    """
    names = docs.columns
    found = find(docs, "__pii")

    def rewritten(spans: Column) -> Column:
        label = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        reach = scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        put = lambda pieces: F.zip_with(spans, reach, lambda s, at: F.when(s["start"] >= at, F.concat(cut(pieces, at, s["start"] - at), label(s))).otherwise(F.lit("")))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return let(chunks(F.col("text")), lambda pieces: F.concat(F.array_join(put(pieces), ""), cut(pieces, end, F.length("text") - end)))

    clean = let(F.col("__pii"), rewritten)
    out = found.withColumn("text", F.when(F.size("__pii") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of all documents."""
    return digest(storage.read(spark, sf_dir, "documents"))
