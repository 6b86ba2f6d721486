"""Information-theoretic sanitisation of personal data, with DataFrame and SQL functions only.

Patterns find protected entities (e-mail and IP addresses, card and phone
numbers). Then the corpus says how much the other words of their documents reveal: of
the log2(N / n(e)) bits that tell which of N documents hold entity e, the word t gives
log2(N n(t,e) / (n(t) n(e))), where n counts whole documents. A word that reveals at least
``generalise`` of the bits in at least ``support`` documents is generalised to its class
(name, acronym, other word) wherever it stands in them, one that reveals at least ``remove`` of them goes.

Places are running sums over a text's matches, taken in groups, so a text's cost is
in proportion to its length and matches, up to millions of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.peaks import let
from .common import Scratch, pick, skewed_join

#: Kinds in order, and patterns (fixed values). They find what the plain patterns in README.md find: possessive
#: quantifiers and a look-behind only spare the matcher deep recursion and vain starts within a run.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}{4,}+"
#: So many elements are scanned at once; so many characters are a block of a text that is put together again.
GROUP, PIECE = 128, 1024
SPANS = "array<struct<start:int,end:int,value:string>>"


@dataclass(frozen=True)
class DisclosureSpec:
    """support: in so many documents with an entity a word must stand. generalise, remove: shares of the entity's bits."""

    support: int = 3
    generalise: float = 0.75
    remove: float = 0.9


def _for(kind: str, f: Callable[[str, Column], Column]) -> Callable[[Column], Column]:
    return lambda s: f(kind, s)


def _scanned(items: Column, first: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """out(what came before, item) for each item, where step adds an item to what came before.

    Adding to an array copies it, so that is only done within groups, and once for each group.
    """
    none = F.array().cast(kind)

    def within(part: Column, before: Column) -> Column:
        add = lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(out(a["at"], x))).alias("out"))
        return F.aggregate(part, F.struct(before.alias("at"), none.alias("out")), add, lambda a: a["out"])

    def by_groups(parts: Column) -> Column:
        carry = lambda a, p: F.struct(F.aggregate(p, a["at"], step).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        before = F.aggregate(parts, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), carry, lambda a: a["out"])
        return F.flatten(F.zip_with(parts, before, within))

    groups = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / GROUP).cast("int")), lambda g: F.slice(x, g * GROUP + 1, F.lit(GROUP)))
    return let(items, lambda x: F.when(F.size(x) > 0, let(groups(x), by_groups)).otherwise(none))


def _located(text: Column, found: Column, pattern: str) -> Column:
    """Structs (start, end, value) of the matches found, in code points: match and gap lengths summed up."""
    both = F.when(F.size(found) > 0, F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value")), F.lit(1), F.size(found)))
    both = F.coalesce(both, F.array().cast("array<struct<gap:string,value:string>>"))

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    return _scanned(both, F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["value"]), span, SPANS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes Luhn's check."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return _luhn(_digits(value))
    return F.length(_digits(value)).between(9, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds __text (null: empty) and a column of (start, end, value) structs for each kind to the rows."""
    df = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    found = {}
    for k in KINDS:
        every = F.regexp_extract_all("__text", F.lit(PATTERNS[k]), F.lit(0))
        none = F.array().cast("array<string>")
        found[f"__m_{k}"] = F.when(F.contains("__text", F.lit(NEEDS[k])), every).otherwise(none) if k in NEEDS else every
    df = df.withColumns(found)
    df = df.withColumns({f"__s_{k}": _located(F.col("__text"), F.col(f"__m_{k}"), PATTERNS[k]) for k in KINDS})
    df = df.withColumns({k: F.filter(f"__s_{k}", _for(k, lambda k, s: _valid(k, s["value"]))) for k in KINDS})
    return df.drop(*[f"__{p}_{k}" for p in "ms" for k in KINDS])


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind in ("email", "ip") else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _terms(text: Column) -> Column:
    """The distinct words of a text, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def held_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, entity): the distinct entities of each row; mark tells rows of one id apart."""
    df = base_spans(docs).withColumn("mark", F.xxhash64("__text"))
    entities = F.array_distinct(F.concat(*[F.transform(k, _for(k, lambda k, s: _entity(k, s["value"]))) for k in KINDS]))
    return df.select("doc_id", "mark", F.explode(entities).alias("entity"))


def holding_texts(docs: DataFrame, held: DataFrame, spec: DisclosureSpec) -> DataFrame:
    """(doc_id, mark, __text, es): rows with an entity that ``support`` rows hold, and structs (entity, n_e) of these.

    No word can stand in ``support`` rows of an entity that fewer rows hold.
    """
    holders = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= spec.support)
    own = skewed_join(held, holders, ["entity"]).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("entity", "n_e")).alias("es"))
    own = own.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).withColumn("mark", F.xxhash64("__text"))
    df = texts.join(own, texts["doc_id"].eqNullSafe(own["__id"]) & (texts["mark"] == own["__mark"]))
    return df.select("doc_id", "mark", "__text", "es")


def shared_terms(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, entity, n_e, term): for each row all words of its text, with each of its entities."""
    df = texts.select("doc_id", "mark", "es", F.explode(_terms(F.col("__text"))).alias("term"))
    return df.select("doc_id", "mark", "term", F.explode("es").alias("e")).select("doc_id", "mark", "e.entity", "e.n_e", "term")


def disclosures(docs: DataFrame, both: DataFrame, spec: DisclosureSpec) -> DataFrame:
    """(entity, term, share): words that reveal at least ``generalise`` of an entity's bits; documents are rows."""
    total = docs.count()
    seen = both.groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= spec.support)
    words = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    known = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    df = skewed_join(seen, known, ["term"])
    bits = F.log2(F.lit(float(total)) / F.col("n_e"))
    share = 1 - F.log2(F.greatest(F.col("n_t"), F.col("n_te")) / F.col("n_te")) / bits
    return df.where(bits > 0).select("entity", "term", F.round(share, 9).alias("share")).where(F.col("share") >= spec.generalise)


def _class(word: Column) -> Column:
    """What a word is generalised to: all its capitals, its first one, or none tell the class."""
    initial = F.substring(word, 1, 1)
    return F.when(word == F.upper(word), F.lit("[ACRONYM]")).when(initial != F.lower(initial), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))


def _marked(text: Column, shares: Column) -> Column:
    """(start, end, share, class) of each word of the text that has a share."""
    every = _located(text, F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), TERM)
    known = F.transform(every, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at(shares, F.lower(w["value"])).alias("share"), _class(w["value"]).alias("class")))
    return F.filter(known, lambda w: w["share"].isNotNull())


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, as) replaced, first come first; overlaps go with the earlier one.

    What stands between spans is taken from short blocks, since a substring is looked for from its text's start.
    """

    def between(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(blocks, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a % PIECE + 1, b - a)).otherwise(F.lit(""))

    def put(blocks: Column, sorted_spans: Column) -> Column:
        pairs = _scanned(
            sorted_spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]),
            lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["as"].alias("as")), "array<struct<at:int,start:int,as:string>>",
        )
        head = F.transform(F.filter(pairs, lambda p: p["start"] >= p["at"]), lambda p: F.concat(between(blocks, p["at"], p["start"]), p["as"]))
        last = F.array_max(F.transform(sorted_spans, lambda s: s["end"]))
        return F.concat(F.array_join(head, ""), between(blocks, last, F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = let(F.array_sort(spans), lambda s: let(blocks, lambda b: put(b, s)))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def sanitise(docs: DataFrame, spec: DisclosureSpec = DisclosureSpec()) -> DataFrame:
    """doc_id, email, ip, card, phone, term (arrays of spans), text (sanitised) for each row.

    Spans are (start, end, ...) in code points, end exclusive; those of the base kinds are
    what the patterns find, less matches that fail their checks. ``term`` spans are
    words the corpus says reveal an entity of the document, wherever they stand in it
    (but for those within a span of the base kinds), with the share they reveal and their class.
    A null text is empty. Rows count as documents, repeated ones too; null ids are
    kept apart by their texts. Texts are whole, however long: a million matches in one
    are located in linear time. An empty table gives an empty one; other columns are ignored.
    """
    rows = pick(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession, "pii")
    held = scratch.write(held_entities(rows))
    texts = scratch.write(holding_texts(rows, held, spec))  # so that only these move again
    both = scratch.write(shared_terms(texts))
    told = scratch.write(disclosures(rows, both, spec))
    hits = skewed_join(both, told, ["entity", "term"])
    hits = hits.groupBy("doc_id", "mark", "term").agg(F.max("share").alias("share"))
    hits = hits.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    hits = texts.select("doc_id", "mark", "__text").dropDuplicates(["doc_id", "mark"]).withColumnsRenamed({"doc_id": "__id", "mark": "__mark"}).join(
        hits, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__mark") == F.col("mark"))
    )
    hits = hits.select("doc_id", "mark", _marked(F.col("__text"), F.col("shares")).alias("term"))
    hits = hits.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    df = base_spans(rows).withColumn("mark", F.xxhash64("__text"))
    df = df.join(hits, df["doc_id"].eqNullSafe(hits["__id"]) & (df["mark"] == hits["__mark"]), "left")
    places = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    apart = F.filter("term", lambda w: ~F.exists(places, lambda s: (s["start"] <= w["start"]) & (w["end"] <= s["end"])))
    df = df.withColumn("term", F.coalesce(apart, F.array().cast("array<struct<start:int,end:int,share:double,class:string>>")))
    marks = [F.transform(k, _for(k, lambda k, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("as")))) for k in KINDS]
    marks.append(F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= spec.remove, F.lit("")).otherwise(s["class"]).alias("as"))))
    return df.select("doc_id", *KINDS, "term", _sanitised(F.col("__text"), F.concat(*marks)).alias("text"))


def span_text(kinds: list[str]) -> Column:
    """kind:start:end of all spans by kind as listed, then start, joined by commas."""
    each = [F.transform(F.array_sort(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), _for(k, lambda k, s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))) for k in kinds]
    return F.array_join(F.concat(*each), ",")
