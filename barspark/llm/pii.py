"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Base spans come from four expressions and their checks (Luhn, digit counts, octets). A span's place is found without a
row-at-a-time function: the text is split at the matches, and the lengths of gaps and matches add up to code points. The
expressions are possessive where nothing needs to be given back, and do not start inside a run that they have just refused,
so each runs in linear time and constant stack on any text.

Seeds then induce lexical patterns: the word on the left or right of an identifier. A pattern's confidence for a kind is the
score of the identifiers seen there over all occurrences of that word in the corpus, alone or glued to an identifier or
candidate (a glued mark: to any word), so that common words weigh nothing and candidates that score low pull it down; it
needs at least ``support`` different identifiers. Unseen candidates (tokens and runs of numbers with at least four digits, and malformed or obfuscated addresses, of
any length and outside every base span) score by the patterns around them (noisy or), raise or lower the patterns' confidence, and are accepted as that kind at
``accept`` or more. Accepted values induce patterns as seeds do, until a round (``rounds`` at most, if given) accepts none; then every
place where an accepted value stands is a span, whatever is beside it. All of this is joins and groupings of (word, identifier) edges.

Defined results: null text counts as empty; a null ``doc_id`` is carried; repeated rows each get their spans; an empty table
gives an empty table. ``personal_data`` reads only ``doc_id`` and ``text``; ``masked`` passes all columns through, whatever their
names. Rows are numbered once and stored with their spans (``masked``: with the whole row), so a number never means two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: The wanted expressions, with possessive repeats (same matches, no backtracking).
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Tokens of six characters or more with four digits, cut at white space and at marks that do not belong to identifiers.
_OUT = r"\s\"',;()<>="
CANDIDATE = rf"(?<![^{_OUT}])(?=[^{_OUT}]{{6}})(?=(?:[^{_OUT}0-9]*+[0-9]){{4}})[^{_OUT}]++"
#: Digit runs joined by at most two blanks, brackets, dots or hyphens (phones without a country code, cards that fail Luhn).
NUMBERS = r"(?<![\p{L}0-9])[+]?+[(]?+[0-9]++(?:[ ().-]{1,2}+[0-9]++)*+"
#: Addresses with a written-out "at" or "dot", and any other token with an @.
_AT, _DOT = r" ?+(?:@|[(\[]at[)\]]) ?+", r" ?+(?:\.|[(\[]dot[)\]]) ?+"
ADDRESSES = rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)*+|(?<![^{_OUT}])[^{_OUT}@]*+@[^{_OUT}]*+"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string,left:string,right:string,glued_left:boolean,glued_right:boolean>>"


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches as (start, kind, end, value, the word before, the word after, whether these touch something), by start."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    # one array goes in, so that the text is split once and not for each match
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("value"), F.slice(gaps, 2, F.size(gaps)).alias("after"))

    def add(acc: Column, x: Column) -> Column:
        gap, value, after = x["gap"], x["value"], x["after"]
        start = acc["at"] + F.length(gap)
        end = start + F.length(value)
        near, then = F.substring(gap, -80, 80), F.substring(after, 1, 80)
        left = F.lower(F.regexp_extract(near, r"(\S++)\s*+$", 1))
        right = F.lower(F.regexp_extract(then, r"^\s*+(\S++)", 1))
        # no word of its own between white space: it touches the match, the match beyond, or is cut at 80 characters
        glued_left = near.rlike(r"\S$") | (near.rlike(r"^\S++\s*+$") & ((start > F.length(gap)) | (F.length(gap) > 80)))
        glued_right = then.rlike(r"^\S") | (then.rlike(r"^\s*+\S++$") & ((end + F.length(after) < F.length(text)) | (F.length(after) > 80)))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"), left.alias("left"), right.alias("right"), glued_left.alias("glued_left"), glued_right.alias("glued_right"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.from_json(F.lit("[]"), _SPAN)
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    # in runs of 256: appending copies what is there, so a long list is put together from short ones
    hit = F.filter(zipped, lambda x: x["value"].isNotNull())
    sliced = lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / 256).cast("int")), lambda i: F.slice(h, i * 256 + 1, 256))
    runs = F.get(F.transform(F.array(hit), sliced), F.lit(0))

    def add_run(acc: Column, run: Column) -> Column:
        empty = F.struct(acc["at"].alias("at"), none.alias("spans"))
        return F.aggregate(run, empty, add, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["spans"], x["spans"]).alias("spans")))

    every = F.aggregate(runs, start, add_run, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), every).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    twice = lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), twice), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds that pass their checks, by start and then by kind."""
    checks = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda v: (F.length(_digits(v)) <= 19) & luhn(_digits(v)),
        "phone": lambda v: F.length(_digits(v)).between(10, 15),
    }
    parts = []
    for i, kind in enumerate(KINDS):
        check = checks[kind]
        spans = F.filter(found(text, PATTERNS[kind], i), lambda s: check(s["value"]))  # noqa: B023
        parts.append(F.when(text.contains("@"), spans).otherwise(F.from_json(F.lit("[]"), _SPAN)) if kind == "email" else spans)
    return F.array_sort(F.concat(*parts))


def mentions(docs: DataFrame) -> DataFrame:
    """row, doc_id, doc (the row as it came), base (spans) and candidates (tokens, runs of numbers and addresses that touch no base span)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("doc"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    numbers = F.filter(found(F.col("text"), NUMBERS, -1), lambda c: F.length(_digits(c["value"])) >= 4)
    tokens = F.filter(found(F.col("text"), CANDIDATE, -1), lambda c: c["value"].rlike("[^0-9().+-]"))  # the others are runs of numbers
    every = F.array_distinct(F.concat(numbers, found(F.col("text"), ADDRESSES, -1), tokens))
    return rows.select("row", "doc_id", "doc", "base", F.filter(every, free).alias("candidates"))


def totals(docs: DataFrame, places: DataFrame) -> DataFrame:
    """side, word, total of every word beside an identifier or candidate: how often it stands between white space, or glued to one
    of these; marks count wherever they are glued to a letter or digit. So no word is seen more often than its total."""
    text = F.lower("text")
    marks = {"L": r"(?<!\S)[^\p{L}0-9\s]++(?=[\p{L}0-9])", "R": r"(?<=[\p{L}0-9])[^\p{L}0-9\s]++(?!\S)"}
    alone = docs.select(F.explode(F.split(text, r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    beside = [docs.select(F.lit(side).alias("side"), F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("word")).groupBy("side", "word").agg(F.count("*").alias("n")) for side, p in marks.items()]
    glued = places.groupBy("side", "word").agg(F.sum(F.col("glued").cast("long")).alias("n"))
    words = glued.select("side", "word")
    parts = [glued, *(words.join(x, ["side", "word"]).select("side", "word", "n") for x in beside), words.join(alone, "word").select("side", "word", "n")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("side", "word").agg(F.sum("n").alias("total"))


def discovered(docs: DataFrame, spans: DataFrame, support: int, confidence: float, accept: float, rounds: int | None) -> DataFrame:
    """row, start, end, kind of the identifiers that the patterns find."""

    def edges(column: str) -> DataFrame:
        one = spans.select("row", F.explode(column).alias("s")).select("row", "s.*")
        sides = F.array(*[F.struct(F.lit(x[0].upper()).alias("side"), F.col(x).alias("word"), F.col(f"glued_{x}").alias("glued")) for x in ("left", "right")])
        return one.select("row", "start", "end", "kind", "value", F.explode(sides).alias("c")).select("row", "start", "end", "kind", "value", "c.*").filter("word <> ''")

    base, every = edges("base"), written(edges("candidates"), "candidates")
    seeds = base.groupBy("side", "word", "kind", "value").agg(F.count("*").alias("n"))
    links = written(every.groupBy("side", "word", "value").agg(F.count("*").alias("n")), "links")
    count = written(totals(docs, base.unionByName(every)), "totals")
    accepted = docs.sparkSession.createDataFrame([], "value string, kind int")
    n_accepted, turn = 0, 0
    while rounds is None or turn < rounds:
        turn += 1
        # patterns with enough different identifiers, and how often their word stands anywhere
        known = seeds.unionByName(links.join(accepted, "value").select("side", "word", "kind", "value", "n"))
        some = known.groupBy("side", "word", "kind").agg(F.count("*").alias("values"), F.sum("n").alias("seen")).filter(F.col("values") >= support)
        # candidates may add to a pattern what identifiers do not reach, so the first cut asks for half the confidence
        patterns = some.join(count, ["side", "word"]).filter(F.col("seen") >= confidence / 2 * F.col("total"))
        patterns = written(patterns.select("side", "word", "kind", "seen", "total"), "patterns")
        weight = lambda seen: F.least(F.lit(0.999), seen / F.col("total"))

        def score(sure: DataFrame) -> DataFrame:
            sure = sure.filter(F.col("weight") >= confidence)
            return links.join(sure, ["side", "word"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("weight"))))).alias("score"))

        first = score(patterns.withColumn("weight", weight(F.col("seen"))))
        more = links.join(first.join(accepted, "value", "left_anti"), "value").groupBy("side", "word", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("gain"))
        trusted = patterns.join(more, ["side", "word", "kind"], "left").withColumn("weight", weight(F.col("seen") + F.coalesce("gain", F.lit(0.0))))
        best = score(trusted).filter(F.col("score") >= accept).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        # a value stays once it is accepted, so the turns end
        accepted = written(accepted.unionByName(best.join(accepted, "value", "left_anti")), "accepted")
        n_before, n_accepted = n_accepted, accepted.count()
        if n_accepted == n_before:
            break
    # wherever an accepted value stands, beside a pattern or not
    places = spans.select("row", F.explode("candidates").alias("s")).select("row", "s.start", "s.end", "s.value")
    return places.join(accepted, "value").select("row", "start", "end", "kind").distinct()


def personal_data(docs: DataFrame, support: int = 3, confidence: float = 0.5, accept: float = 0.8, rounds: int | None = None) -> DataFrame:
    """row, doc_id, base and spans (base and found ones): arrays of (start, kind, end), by start and kind; kind indexes KINDS."""
    return spans_of(docs, written(mentions(docs).drop("doc"), "mentions"), support, confidence, accept, rounds)


def spans_of(docs: DataFrame, held: DataFrame, support: int = 3, confidence: float = 0.5, accept: float = 0.8, rounds: int | None = None) -> DataFrame:
    """The same from stored ``mentions``, with ``doc`` where they hold it. Found spans are stored before they are joined, so that
    Spark knows their size: few are broadcast, and no text is shuffled."""
    new = discovered(docs, held, support, confidence, accept, rounds).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    out = held.withColumn("base", plain).join(written(new, "found"), "row", "left")
    spans = F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "found")))
    return out.select("row", "doc_id", *[c for c in held.columns if c == "doc"], "base", spans.alias("spans"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in angle brackets; overlapping spans become one."""
    rows = spans_of(docs, written(mentions(docs), "mentions"), **options).select("doc", "spans")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col("doc.text")

    def step(acc: Column, s: Column) -> Column:
        cut = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], cut, F.get(names, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    new = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    masked_text = F.when(F.size("spans") == 0, text).otherwise(new)
    return rows.select(*(masked_text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
