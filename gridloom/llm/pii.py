"""Bootstrapped contextual extraction of personal data, with DataFrame functions only.

Seeds are what five expressions find: emails, IP addresses, card numbers with a valid check digit, phone numbers, and secrets, which
are keys of 32 or more lower-case hexadecimal digits. The one and the two words before a seed are lexical patterns. Patterns and
instances form a bipartite graph: a pattern's confidence for a kind is the mean score of the different values that follow it
(tokens with a digit or an @ which no seed overlaps are values of score 0 at first; of these, such as have the kind's shape weigh
half in the mean, since they may yet be found), the score of an instance of the kind's shape is its best pattern's confidence. Rounds of joins carry scores along the graph, so that instances found in one round
support patterns that hold no seed; patterns that reach the confidence and the support, a sum of scores, mark the
unseen tokens of a fitting shape as identifiers of their kind. Of the five kinds, the first four are the base.

Positions are code points, ends exclusive. Java's split and extract give the pieces between matches and the matches, so a
running sum of lengths gives positions; possessive expressions with a look-behind find the same matches as the plain ones in
linear time (\\G lets a match begin where the last one ended). Running values are carried block by block, and pieces are cut
from an array of chunks, so a text of very many matches costs little more than in proportion to its length. Contexts have no
limit: two words are read from a short piece, or, where it doesn't hold them, from the whole text before.

One pass over the texts writes seeds, tokens and contexts, a few dozen bytes a match; graph joins are on patterns and values
after partial aggregation, and only learned spans travel back to their documents.

Defined cases: a null text counts as empty and stays null when masked; repeated rows and equal texts get equal spans; a null
doc_id is an id like others; an empty table gives no rows; spans of one kind may touch but seeds of a kind never overlap; of
several patterns the most confident decides, ties go to the kind that sorts last; other columns, whatever their names, are
carried in a struct and come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut, small

#: The base kinds in order, and their expressions.
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])",
}
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "secret": "[0-9]"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Shapes that a learned value of a kind, in lower case, has.
SHAPES = {
    "email": r"^[^\s@]{2,}@[^\s@]{2,}$",
    "ip": r"^(?=.*[.:].*[.:])[0-9a-f.:]{6,}$",
    "card": r"^(?:[0-9][x*\x20-]?){12,19}$",
    "phone": r"^[+(]?[0-9](?:[().-]?[0-9]){6,14}$",
    "secret": r"^(?=.*[0-9])[a-z0-9_+/=-]{16,}$",
}
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 5.0
#: What an unknown value of the kind's shape counts for in a pattern's mean; any other value counts for one.
OPEN = 0.5
#: Code points of a chunk of a text, and of the piece that contexts are first sought in.
CHUNK, NEAR = 1024, 64
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def running(items: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array, a plain column, the number that add has made of zero and the items before it.

    Blocks of about the square root of the items keep the copying of growing arrays small.
    """
    n = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    state = "array<struct<acc:bigint,outs:array<bigint>>>"

    def block(done: Column, k: Column) -> Column:
        start = F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["acc"], zero.cast("long")).alias("acc"), F.array().cast("array<bigint>").alias("outs"))
        step = lambda t, x: F.struct(add(t["acc"], x).cast("long").alias("acc"), F.concat(t["outs"], F.array(t["acc"])).alias("outs"))
        return F.concat(done, F.array(F.aggregate(F.slice(items, k * width + 1, width), start, step)))

    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), F.array().cast(state), block)
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda x: x["outs"]))).otherwise(F.array().cast("array<bigint>"))


def with_located(rows: DataFrame, name: str, expression: str, needs: str = "") -> DataFrame:
    """rows with the column name: structs (start, end, value) of the matches in the column text, in order.

    needs: an expression, quick to seek, that every text with a match has.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn(name, F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(expression), F.lit(0))).otherwise(F.array().cast("array<string>")))
    gaps = F.slice(F.split(text, expression, -1), F.lit(1), F.size(name))
    pairs = F.zip_with(gaps, F.col(name), lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("n"), v.alias("value")))
    rows = rows.withColumn(name, F.when(F.size(name) > 0, pairs).otherwise(F.array().cast("array<struct<gap:int,n:int,value:string>>")))
    rows = rows.withColumn("_at", running(F.col(name), F.lit(0), lambda acc, x: acc + x["gap"] + x["n"]))
    span = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"))
    return rows.withColumn(name, F.zip_with(name, "_at", span)).drop("_at")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(parts: Column, a: Column, b: Column) -> Column:
    """The text from code point a to b, from its chunks."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    at = lambda k: F.coalesce(F.try_element_at(parts, k + 1), F.lit(""))
    begin = F.pmod(a, F.lit(CHUNK)).cast("int") + 1
    one = F.substring(at(i), begin, (b - a).cast("int"))
    many = F.concat(F.substring(at(i), begin, F.lit(CHUNK)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), F.substring(at(j), F.lit(1), F.pmod(b - 1, F.lit(CHUNK)).cast("int") + 1))
    return F.when(b <= a, F.lit("")).when(i == j, one).otherwise(many)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def share(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(F.pmod(i, F.lit(2)) == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + share(i))
    return F.length(digits).between(13, 19) & (F.when(F.length(digits).between(13, 19), F.pmod(total, F.lit(10)) == 0).otherwise(False))


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def with_seeds(rows: DataFrame) -> DataFrame:
    """rows with seeds, structs (kind, start, end, value) in the order of kinds, then of starts."""

    def seeds(kind: str) -> Column:
        good = F.filter(f"_{kind}", lambda x: _holds(kind, x["value"]))
        return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    for kind, expression in EXPRESSIONS.items():
        rows = with_located(rows, f"_{kind}", expression, NEEDS[kind])
    return rows.withColumn("seeds", F.concat(*map(seeds, EXPRESSIONS))).drop(*(f"_{kind}" for kind in EXPRESSIONS))


def with_tokens(rows: DataFrame) -> DataFrame:
    """rows with tokens, structs (kind, start, end, value): tokens with a digit or an @, bare of outer punctuation, that no seed overlaps."""

    def bare(x: Column) -> Column:
        rest = F.regexp_replace(x["value"], r"^[\"'(\[<{]+", "")
        begin = x["start"] + F.length(x["value"]) - F.length(rest)
        value = F.regexp_replace(rest, r"[\"',;:.!?)\]>}]+$", "")
        return F.struct(begin.alias("start"), F.lit(1).alias("turn"), (begin + F.length(value)).alias("end"), value.alias("value"))

    rows = with_located(rows, "_tokens", TOKEN, "[0-9@]")
    own = F.filter(F.transform("_tokens", bare), lambda x: F.length(x["value"]) > 0)
    known = F.transform("seeds", lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("turn"), x["end"].alias("end"), x["value"].alias("value")))
    # in order of starts a token meets a seed if one that began before ends after its start, or the next one begins before its end
    rows = rows.withColumn("_all", F.array_sort(F.concat(known, own)))
    rows = rows.withColumn("_back", F.reverse("_all"))
    rows = rows.withColumn("_past", running(F.col("_all"), F.lit(-1), lambda acc, x: F.when(x["turn"] == 0, F.greatest(acc, x["end"])).otherwise(acc)))
    rows = rows.withColumn("_next", F.reverse(running(F.col("_back"), F.lit(1 << 60), lambda acc, x: F.when(x["turn"] == 0, x["start"]).otherwise(acc))))
    free = F.filter(F.arrays_zip(F.col("_all").alias("x"), F.col("_past").alias("past"), F.col("_next").alias("next")), lambda z: (z["x"]["turn"] == 1) & (z["past"] <= z["x"]["start"]) & (z["next"] >= z["x"]["end"]))
    tokens = F.transform(free, lambda z: F.struct(F.lit(None).cast("string").alias("kind"), z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["value"].alias("value")))
    return rows.withColumn("tokens", tokens).drop("_tokens", "_all", "_back", "_past", "_next")


def extracted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, seeds, uses) for each row; uses: structs (kind or null, start, end, value, before)."""
    rows = with_tokens(with_seeds(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))))
    rows = rows.withColumn("uses", F.concat("seeds", "tokens"))
    rows = rows.withColumn("_chunks", F.when(F.size("uses") > 0, chunks(F.col("text"))))

    def used(x: Column) -> Column:
        near = piece(F.col("_chunks"), F.greatest(x["start"] - NEAR, F.lit(0)), x["start"])
        holds = (x["start"] <= NEAR) | near.rlike(r"\s\S+\s+\S+\s*$")
        left = F.when(holds, near).otherwise(piece(F.col("_chunks"), F.lit(0).cast("long"), x["start"]))
        words = F.lower(F.regexp_replace(F.regexp_extract(left, r"((?:\S+\s+)?\S+\s*)$", 1), r"\s+", " "))
        return x.withField("before", F.trim(F.regexp_replace(words, "[0-9]", "0")))

    return rows.select("doc_id", F.xxhash64("text").alias("h"), "seeds", F.transform("uses", used).alias("uses"))


def learn(rows: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """(doc_id, h, kind, start, end): identifiers that no seed covers, by patterns learned from all rows."""
    uses = rows.select("doc_id", "h", F.explode("uses").alias("u")).select("doc_id", "h", "u.*").where("before != ''")
    last = F.regexp_extract("before", r"(\S+)$", 1)
    patterns = F.array_distinct(F.array(F.concat(F.lit("1 "), last), F.concat(F.lit("2 "), F.col("before"))))
    uses = uses.withColumn("value", F.lower("value")).withColumn("pattern", F.explode(patterns))
    uses = cut(uses.select("doc_id", "h", "kind", "start", "end", "value", "pattern"))
    edges = uses.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    open_ = [F.sum(F.when(F.col("kind").isNull() & F.col("value").rlike(shape), 1).otherwise(0)).alias(f"open_{kind}") for kind, shape in SHAPES.items()]
    sized = edges.groupBy("pattern").agg(F.count("*").alias("n"), *open_)
    # the sum of scores is at most the number of values, so patterns of fewer can't reach the support in any round
    edges = cut(edges.join(sized.where(F.col("n") >= support), "pattern"))
    seeds = edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    fits = F.lit(False)
    for kind, shape in SHAPES.items():
        fits = fits | ((F.col("kind") == kind) & F.col("value").rlike(shape))
    unknown = F.coalesce(*(F.when(F.col("kind") == kind, F.col(f"open_{kind}")) for kind in SHAPES)) - F.col("found")
    known, trusted = seeds, None
    for _ in range(rounds):
        own = known.select(F.col("value").alias("_v"), F.col("kind").alias("_k"), "score")
        met = edges.join(own, F.col("value") == F.col("_v")).withColumn("new", F.col("kind").isNull().cast("long")).withColumn("kind", F.col("_k"))
        weighed = met.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.sum("new").alias("found"), *(F.first(c).alias(c) for c in ("n", *(f"open_{k}" for k in SHAPES))))
        trusted = weighed.select("pattern", "kind", "s", (F.col("s") / (F.col("n") - (1 - OPEN) * unknown)).alias("confidence"))
        trusted = cut(trusted.where((F.col("confidence") >= confidence) & (F.col("s") >= support)))
        met = edges.where("kind is null").select("pattern", "value").join(trusted, "pattern").where(fits)
        found = met.groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        known = cut(seeds.unionByName(found).groupBy("value", "kind").agg(F.max("score").alias("score")))
    hits = uses.where("kind is null").drop("kind").join(trusted.select("pattern", "kind", "confidence"), "pattern")
    best = F.max_by("kind", F.struct("confidence", "kind")).alias("kind")
    return hits.where(fits).groupBy("doc_id", "h", "start", "end").agg(best)


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _by_kind(spans: Column) -> Column:
    """Spans in the order of kinds, then of starts."""
    place = lambda x: F.array_position(F.array(*map(F.lit, EXPRESSIONS)), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(place(x).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def with_learned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows, of doc_id and h, with learned: their spans of found, which learn gives."""
    spans = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("kind", "start", "end")).alias("learned"))
    spans = cut(spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "learned"))
    out = rows.join(small(spans), rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["h"] == spans["_h"]), "left")
    return out.drop("_id", "_h").withColumn("learned", F.coalesce("learned", F.array().cast(_SPANS)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """One row for each document: counts and digest of the base spans, all spans in the order of kinds, and how many are
    secrets' seeds, how many learned, how many there are in all."""
    rows = cut(extracted(docs, id_col, text_col))
    out = with_learned(rows.drop("uses"), learn(rows, rounds, confidence, support))
    count = lambda kind: F.size(F.filter("seeds", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("seeds", lambda x: x["kind"] != "secret")
    seeds = F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    spans = F.when(F.size("learned") > 0, _listing(_by_kind(F.concat(seeds, F.col("learned"))))).otherwise(_listing(F.col("seeds")))
    more = (count("secret"), F.size("learned").cast("long").alias("n_learned"), (F.size("seeds") + F.size("learned")).cast("long").alias("n_spans"))
    return out.select("doc_id", *map(count, KINDS), F.sha2(_listing(base), 256).alias("base_sha256"), spans.alias("spans"), *more)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; overlapping spans become one."""
    found = learn(cut(extracted(docs, id_col, text_col)))
    own = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = with_seeds(docs.select(own, docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h")))
    rows = with_learned(rows, found)
    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    rows = rows.withColumn("_spans", F.array_sort(F.concat(F.transform("seeds", plain), F.transform("learned", plain))))
    rows = rows.withColumn("_past", running(F.col("_spans"), F.lit(0), lambda acc, x: F.greatest(acc, x["end"])))
    rows = rows.withColumn("_chunks", F.when(F.size("_spans") > 0, chunks(F.col("text"))))
    parts = F.zip_with("_spans", "_past", lambda x, at: F.when(x["start"] >= at, F.concat(piece(F.col("_chunks"), at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
    last = F.array_max(F.transform("_spans", lambda x: x["end"]))
    clean = F.concat(F.array_join(parts, ""), piece(F.col("_chunks"), last, F.length("text").cast("long")))
    rows = rows.select("row", F.when(F.size("_spans") > 0, clean).otherwise(F.col("text")).alias("clean"))
    return rows.select(*(F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
