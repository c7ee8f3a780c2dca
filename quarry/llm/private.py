"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss (DataFrame functions only).

Base matches (e-mail, IP, card and phone numbers, checked as the contract says) are the seeds; a fifth kind, secrets, has
seeds of its own (long runs of hexadecimal digits) and is reported apart. Candidates are the matches that fail their kind's
check, and every other token with a digit or an at sign. Each occurrence, seed or candidate, has lexical patterns, from special
to general: the two words before it; the word before it and its own shape; the classes of the words on both sides and its shape;
its shape. (In words and shapes, digits are 9; in shapes, runs of letters are one letter, digits keep their number.)

Spark scores the graph of patterns and instances in turns. A pattern that LEAST_KNOWN different known instances of a kind
have scores, for that kind, the share of its known instances that are of the kind (instances of other kinds count against
it, and half an instance for chance). An instance's score is the noisy-or of its patterns; one that reaches
LEAST_SCORE, and looks like the kind, becomes known, and so supports further patterns. The turns end when no instance is
added. Occurrences of candidates at patterns that score LEAST_SCORE are new spans. Base spans stay: what overlaps one is
dropped, and of new spans that overlap the first, longest one stays.

Regular expressions never go back over a run (possessive, and only from a run's first character or the end of the last
match, which finds the same matches), so long runs and very long texts cost linear time; no length is capped. Places come
from the pieces between matches. Everything is keyed by a hash of the text, so copies are worked on alike, and rows that
repeat a doc_id don't mix. Null and empty texts have no spans; other columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import discard, store

#: Kinds in the order of the contract, with their patterns and what a text must hold to be searched at all.
KINDS = ("email", "ip", "card", "phone")
#: The kind besides them.
SECRET = "secret"
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    SECRET: r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])",
}
_NEEDS = {"email": "@", "phone": "+"}
#: A token with a digit or an at sign; what it begins or ends with besides its core.
_TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
_LEAD, _CORE = r"^[^A-Za-z0-9+(@]*+", r"[A-Za-z0-9+(@](?:\S*[A-Za-z0-9)@])?"
_SHAPE = {
    "email": r"^[^\s@]++@[^\s@]++$", "ip": r"^[0-9]+([.:][0-9]+)+$", "card": r"^([0-9][-. ]?){9,}$", "phone": r"^[+(]?([0-9][-.() ]*){7,}$",
    SECRET: r"^(?=.*[0-9])[A-Za-z0-9+/_=-]{16,}$",
}
LEAST_SCORE, LEAST_KNOWN = 0.8, 3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    backwards = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    parts = F.transform(F.sequence(F.lit(1), F.length(digits)), part)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    small = F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(12, 19), luhn(_digits(match))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == SECRET, match.rlike("[0-9]") & match.rlike("[A-Fa-f]"))
        .otherwise(True)
    )


def _found(d: DataFrame, kinds: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """From (th, arrays <kind> of matches and <kind>_gaps of the lengths of the pieces before them): (th, kind, start, end, value) of
    each, with `extra` columns of the array's item `i`."""

    def zipped(k: str) -> Column:
        item = lambda m, i: F.struct(F.lit(k).alias("kind"), i.alias("no"), F.get(F.col(f"{k}_gaps"), i).alias("gap"), m.alias("value"), *(f(i).alias(n) for n, f in (extra or {}).items()))
        return F.when(F.size(k) > 0, F.transform(F.col(k), item))

    d = d.select("th", F.explode(F.array(*(zipped(k) for k in kinds))).alias("found")).select("th", F.explode("found").alias("f")).select("th", "f.*")
    d = d.dropDuplicates(["th", "kind", "no"])
    w = W.partitionBy("th", "kind").orderBy("no")
    end = F.sum(F.col("gap") + F.length("value")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")
    return d.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("no", "gap")


def _keyed(docs: DataFrame) -> DataFrame:
    """(th, text) of the texts that can hold anything."""
    return docs.select(F.md5("text").alias("th"), "text").filter(F.col("text").rlike("[0-9@]"))


def matches(docs: DataFrame) -> DataFrame:
    """Every match of each kind's pattern in each different text: (th, kind, start, end, value, valid)."""
    kinds = list(_PATTERN)
    found = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in _PATTERN.items()}
    found = {k: F.when(F.contains("text", F.lit(_NEEDS[k])), f) if k in _NEEDS else f for k, f in found.items()}
    d = _keyed(docs).select("th", "text", *(found[k].alias(k) for k in kinds)).filter(" or ".join(f"size({k}) > 0" for k in kinds))
    # worked out once a text: within a lambda it would be once a match
    gaps = {k: F.transform(F.when(F.size(k) > 0, F.split("text", _PATTERN[k], -1)), F.length) for k in kinds}
    d = _found(d.select("th", *kinds, *(g.alias(f"{k}_gaps") for k, g in gaps.items())), kinds)
    return d.withColumn("valid", F.coalesce(_valid(F.col("kind"), F.col("value")), F.lit(False)))


def base(docs: DataFrame) -> DataFrame:
    """Base spans of each different text: (th, kind, start, end, value)."""
    return matches(docs).filter(F.col("valid") & (F.col("kind") != SECRET)).drop("valid")


def _same(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[0-9]", "9")


def tokens(docs: DataFrame) -> DataFrame:
    """Tokens with a digit or an at sign: (th, start, end, value, before2, before, after), the words around them as they are."""
    tail, head = r"(?<!\S)(?:\S++\s++)?\S++\s*+$", r"\S++"
    d = _keyed(docs).select("th", F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("token"), F.split("text", _TOKEN, -1).alias("pieces"))
    pieces = F.transform("pieces", lambda p: F.struct(F.length(p).alias("gap"), F.regexp_extract(p, tail, 0).alias("tail"), F.regexp_extract(p, head, 0).alias("head")))
    d = d.select("th", "token", pieces.alias("pieces")).select("th", "token", "pieces", F.col("pieces.gap").alias("token_gaps"))
    token, piece = lambda i: F.get(F.col("token"), i), lambda i, c: F.get(F.col("pieces"), i)[c]
    extra = {
        "words": lambda i: F.concat_ws(" ", token(i - 2), piece(i - 1, "tail"), token(i - 1), piece(i, "tail")),
        "after": lambda i: F.coalesce(F.nullif(piece(i + 1, "head"), F.lit("")), token(i + 1)),
    }
    d = _found(d, ["token"], extra).drop("kind")
    two = F.split(F.btrim(F.regexp_extract("words", tail, 0)), r"\s+")
    d = d.withColumn("two", two)
    return d.select("th", "start", "end", "value", F.when(F.size("two") > 1, F.get("two", F.lit(0))).alias("before2"), F.nullif(F.element_at("two", -1), F.lit("")).alias("before"), "after")


def _class(word: Column) -> Column:
    """Class of a word: none, of a token with digits, its last character if that isn't a letter, capitalised or plain."""
    return (
        F.when(word.isNull(), "none")
        .when(word.rlike("[0-9@]"), "token")
        .when(word.rlike(r"[^\p{L}]$"), F.right(word, F.lit(1)))
        .when(word.rlike(r"^\p{Lu}"), "Word")
        .otherwise("word")
    )


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-z]+", "a"), "[A-Z]+", "A")


def _patterns() -> Column:
    """Keys of an occurrence's patterns, from its words and its value; as hashes, for words have any length."""
    shape = _shape(F.col("value"))
    special = F.when(F.col("before2").isNotNull(), F.concat_ws(" ", F.lit("words"), _same(F.col("before2")), _same(F.col("before"))))
    word = F.when(F.col("before").isNotNull(), F.concat_ws(" ", F.lit("word"), _same(F.col("before")), shape))
    sides = F.concat_ws(" ", F.lit("sides"), _class(F.col("before")), shape, _class(F.col("after")))
    return F.filter(F.array(*(F.md5(p) for p in (special, word, sides, F.concat_ws(" ", F.lit("shape"), shape)))), lambda p: p.isNotNull())


def occurrences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Seeds and candidates: (th, start, end, kind (null of a token), value, valid, patterns). A match has the words around the
    tokens that it begins and ends in."""
    t = tokens(docs)
    m = found.select("th", "start", "end", "kind", "value", "valid")
    # the token that a match begins in is the last that begins no later; likewise at its end
    first = F.struct("start", "before2", "before")
    none = F.lit(None)
    marks = t.select("th", F.col("start").alias("at"), F.lit(0).alias("side"), first.alias("own"), F.col("after").alias("next"), none.cast("long").alias("start"), none.cast("long").alias("end"), none.cast("string").alias("kind"), none.cast("string").alias("value"), none.cast("boolean").alias("valid"))
    kind = marks.schema["own"].dataType
    asks = m.select("th", F.col("start").alias("at"), F.lit(1).alias("side"), none.cast(kind).alias("own"), none.cast("string").alias("next"), "start", "end", "kind", "value", "valid")
    w = W.partitionBy("th").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    begun = marks.unionByName(asks).withColumn("own", F.last("own", ignorenulls=True).over(w))
    again = begun.withColumn("at", F.when(F.col("side") == 1, F.col("end") - 1).otherwise(F.col("at")))
    again = again.withColumn("next", F.last(F.when(F.col("side") == 0, F.struct("next")), ignorenulls=True).over(w)["next"]).filter("side = 1")
    placed = again.select("th", "start", "end", "kind", "value", "valid", F.col("own.before2").alias("before2"), F.col("own.before").alias("before"), F.col("next").alias("after"))
    lead = F.length(F.regexp_extract("value", _LEAD, 0))
    core = t.select("th", F.col("start") + lead, "value", "before2", "before", "after").toDF("th", "start", "value", "before2", "before", "after")
    core = core.withColumn("value", F.regexp_extract("value", _CORE, 0)).filter("value <> ''")
    core = core.select("th", "start", (F.col("start") + F.length("value")).alias("end"), F.lit(None).cast("string").alias("kind"), "value", F.lit(False).alias("valid"), "before2", "before", "after")
    return placed.unionByName(core).select("th", "start", "end", "kind", F.lower("value").alias("value"), "valid", _patterns().alias("patterns"))


def _looks(kind: Column, value: Column) -> Column:
    looks = F.lit(False)
    for k, p in _SHAPE.items():
        looks = F.when(kind == k, value.rlike(p)).otherwise(looks)
    return looks


def score(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, weight) of the patterns that reach LEAST_SCORE, and (value, kind, score) of known instances, at the end of
    the turns."""
    edges = store(seen.select("value", F.explode("patterns").alias("pattern")).distinct(), "pii-graph")
    known = store(seen.filter("valid").groupBy("value", "kind").agg(F.lit(1.0).alias("score")), "pii-known")
    count = known.count()
    while True:
        by_kind = edges.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("sum"))
        total = F.sum("sum").over(W.partitionBy("pattern"))  # a row a kind
        scored = by_kind.withColumn("weight", (F.col("sum") + 0.5) / (total + 1)).filter(F.col("n") >= LEAST_KNOWN)
        patterns = store(scored.filter(F.col("weight") >= LEAST_SCORE).select("pattern", "kind", "weight"), "pii-patterns")
        made = edges.join(patterns, "pattern").filter(_looks(F.col("kind"), F.col("value")))
        made = made.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("weight"), F.lit(0.999)))))).alias("score"))
        best = made.withColumn("nth", F.row_number().over(W.partitionBy("value").orderBy(F.col("score").desc(), "kind"))).filter("nth = 1").drop("nth")
        more = best.join(known.select("value"), "value", "left_anti").filter(F.col("score") >= LEAST_SCORE)
        following = store(known.unionByName(more.select(*known.columns)), "pii-known")
        before, count = count, following.count()
        discard(known)
        known = following
        if count == before:
            discard(edges)
            return patterns, known
        discard(patterns)


def discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Further spans (th, kind, start, end) that high-confidence patterns find."""
    seen = store(occurrences(docs, found), "pii-occurrences")
    patterns, known = score(seen)
    new = seen.filter(~F.col("valid")).select("th", "start", "end", "value", F.explode("patterns").alias("pattern"))
    new = new.join(patterns, "pattern").filter(_looks(F.col("kind"), F.col("value"))).join(known.select("value", "kind"), ["value", "kind"], "left_semi")
    new = new.select("th", "kind", "start", "end", "weight").groupBy("th", "start", "end").agg(F.max_by("kind", F.struct("weight", "kind")).alias("kind"))
    # overlaps: base spans go first, then the leftmost, longest; the furthest end so far tells whether a span begins inside one
    taken = found.filter("valid").select("th", "start", "end", "kind", F.lit(True).alias("own"))
    both = taken.unionByName(new.withColumn("own", F.lit(False)))
    before = W.partitionBy("th").orderBy("start", F.col("own").desc(), F.col("end").desc(), "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("th").orderBy("start", F.col("own").desc(), F.col("end").desc(), "kind").rowsBetween(1, W.unboundedFollowing)
    both = both.withColumn("reach", F.max("end").over(before)).withColumn("next", F.min(F.when(F.col("own"), F.col("start"))).over(after))
    kept = both.filter(~F.col("own") & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    out = store(kept.select("th", "kind", "start", "end"), "pii-discovered")
    for table in (seen, patterns, known):
        discard(table)
    return out


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, (*KINDS, SECRET)))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts and joined spans of the base matches, all spans of their kinds joined, n_discovered (spans
    added to the base), and secrets and n_found (secrets and all spans)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = store(matches(d), "pii-matches")
    own = found.filter("valid").select("th", "kind", "start", "end", F.lit(True).alias("base"))
    both = own.unionByName(discovered(d, found).withColumn("base", F.lit(False)))
    order = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind")).cast("int") - 1
    span, listed = F.struct("start", order.alias("order"), "end"), F.col("kind") != SECRET
    per_text = both.groupBy("th").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        F.collect_list(F.when(F.col("base") & listed, span)).alias("own"),
        F.collect_list(F.when(listed, span)).alias("every"),
        F.collect_list(F.when(~listed, span)).alias("other"),
        F.count_if(~F.col("base") & listed).alias("n_discovered"),
        F.count("*").alias("n_found"),
    )
    numbers = [*(f"n_{k}" for k in KINDS), "n_discovered", "n_found"]
    texts = {"base_spans": "own", "spans": "every", "secrets": "other"}
    # a table of its own, so that a join with many copies of one text can be split
    per_text = store(per_text.select("th", *numbers, *(_joined(F.col(c)).alias(n) for n, c in texts.items())), "pii-texts")
    discard(found)
    out = d.select("doc_id", F.md5("text").alias("th")).join(per_text, "th", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), *(F.coalesce(c, F.lit("")).alias(c) for c in texts))
