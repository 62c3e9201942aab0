"""Personal data: patterns, and terms that give protected entities away.

Addresses, IP numbers, card numbers and telephone numbers are found by pattern
and checked (parts, digits, Luhn).  Each value so found is a protected entity.
Candidates are the words (runs of letters, ``MIN_TERM`` or more, lower-cased) among the
``NEAR_WORDS`` on either side of its mentions that lie wholly within ``NEAR_CHARS``
characters.  Over the whole corpus, a term's disclosure of an entity is the pointwise
mutual information ``log2 p(entity | term) / p(entity)``.  All its counts are of distinct
texts: those in which the term is near the entity, those that have the term anywhere,
those that have the entity, and all; copies of a document count once in each.  A term
with at least ``MIN_CONTEXTS`` texts near the entity, a share ``p(entity | term)`` of at
least ``MIN_SHARE`` and at least ``MIN_BITS`` bits discloses it and is a span of its own
wherever it stands in any document.

From a share of ``REMOVE_SHARE`` a term is removed (kind ``term``).  Below that it is
generalised (kind ``general``): to its longest beginning, of ``MIN_STEM`` letters or more,
that discloses none of the entities that the term does, where the counts are of texts
with any word of that beginning.  A term without such a beginning is removed.

Everything is DataFrame expressions; texts stay in the JVM.

Cases: a null or empty text has no spans; repeated rows each get their spans;
a null ``doc_id`` is kept; an empty table gives an empty result; extra columns
are ignored.  Spans of different kinds may overlap, those of a kind do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import durable, release

KINDS = ("email", "ip", "card", "phone", "term", "general")
# Each pattern finds the leftmost longest matches of its plain form.  The guards
# before it skip starts inside a run that its first character has already failed
# from, which keeps long runs linear; possessive repeats keep them off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Letters that some match of the kind must have: others are not searched.
MUST_HAVE = {"email": "@", "ip": ".", "phone": "+"}

#: Words on either side of a mention, and characters in which they are looked for.
NEAR_WORDS, NEAR_CHARS = 3, 120
MIN_TERM, MIN_STEM = 3, 2
MIN_CONTEXTS, MIN_SHARE, MIN_BITS, REMOVE_SHARE = 3, 0.5, 4.0, 0.9
#: Candidate terms, and documents with revealing ones, are broadcast up to this
#: many (some 100 bytes each), joined by shuffle beyond.
BROADCAST_TERMS = 200_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(match)), ""), lambda c: c != "")
    twice = F.transform(digits, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(_digits(match)).between(14, 19), _luhn(match)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string,put:string>"


def _spans(text: Column, kind: str, pattern: Column | str) -> Column:
    """Spans of all matches, in code points: what lies between matches gives their places."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.split(text, regex, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value"), F.lit(f"<{kind.upper()}>").alias("put"))
        kept = F.concat(acc["spans"], F.array(span.cast(SPAN))) if kind in ("email", "term") else F.when(_valid(kind, pair["value"]), F.concat(acc["spans"], F.array(span.cast(SPAN)))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, empty, step)["spans"])


def base_spans(text: Column) -> Column:
    """All spans by pattern, ordered by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for kind, pattern in PATTERNS.items():
        spans = _spans(text, kind, pattern)
        if kind in MUST_HAVE:
            spans = F.when(F.contains(text, F.lit(MUST_HAVE[kind])), spans)
        parts.append(F.coalesce(spans, none))
    return F.array_sort(F.concat(*parts))


def _entity(span: Column) -> Column:
    """A value as an entity: telephone and card numbers without their punctuation."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def _discloses(both: Column, has: Column, total: int) -> Column:
    """Whether ``both`` of the ``has`` texts with a term are near an entity that ``with_entity`` texts have: enough of them."""
    share = both / has
    return (share >= MIN_SHARE) & (F.log2(share * total / F.col("with_entity")) >= MIN_BITS)


def _beginnings(over: DataFrame, near: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(term, stem): the longest beginning of each term that discloses none of its entities.

    ``over`` is (term, entity, with_entity), ``near`` (row, entity, term) and ``words`` (row, term).
    """
    step = over.where(F.length("term") > MIN_STEM).withColumn("k", F.explode(F.sequence(F.lit(MIN_STEM), F.length("term") - 1)))
    step = durable(step.withColumn("stem", F.expr("substring(term, 1, k)")), "pii-stems")
    stems = _small(step.select("stem", F.expr(f"substring(stem, 1, {MIN_STEM})").alias("start")).distinct())

    def of(rows: DataFrame, *by: str) -> DataFrame:
        start = rows.withColumn("start", F.expr(f"substring(term, 1, {MIN_STEM})"))
        return start.join(stems, "start").where(F.col("term").startswith(F.col("stem"))).select("row", *by, "stem").distinct().groupBy(*by, "stem")

    both = of(near, "entity").agg(F.count("*").alias("both"))
    has = of(words).agg(F.count("*").alias("has"))
    rated = step.join(both, ["entity", "stem"]).join(has, "stem").withColumn("bad", _discloses(F.col("both"), F.greatest("both", "has"), total))
    fit = rated.groupBy("term", "stem").agg(F.max("bad").alias("bad")).where("not bad").groupBy("term").agg(F.max_by("stem", F.length("stem")).alias("stem"))
    out = durable(fit, "pii-generalised")
    release(step)
    return out


def revealing_terms(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(doc_id, row, terms) of documents that have terms over the thresholds; None where there is none.

    ``terms`` is an array of (term, share, stem), stem null for terms to remove.
    ``found`` has (doc_id, row, mentions).
    """
    near = found.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.entity", F.explode(F.concat("m.left", "m.right")).alias("term")).where(F.length("term") >= MIN_TERM).distinct()
    by_pair = near.groupBy("term", "entity").agg(F.count("*").alias("both")).where(F.col("both") >= MIN_CONTEXTS)
    by_term = near.select("term", "row").distinct().groupBy("term").agg(F.count("*").alias("near"))
    # a term is in all texts in which it is near some entity
    candidates = durable(by_pair.join(by_term, "term").where(F.col("both") >= MIN_SHARE * F.col("near")), "pii-candidates")
    if candidates.isEmpty():
        release(candidates)
        return None
    terms = candidates.select("term").distinct()
    words = docs.select("doc_id", "row", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    have = durable(words.join(_small(terms), "term"), "pii-terms")
    total = found.select("row").distinct().count()
    entities = found.select("row", F.explode(F.transform("mentions", lambda m: m["entity"])).alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    counts = have.select("term", "row").distinct().groupBy("term").agg(F.count("*").alias("with_term"))
    rated = candidates.join(counts, "term").join(entities, "entity")
    has = F.greatest("near", "with_term")
    over = durable(rated.where(_discloses(F.col("both"), has, total)).select("term", "entity", "with_entity", (F.col("both") / has).alias("share")), "pii-disclosing")
    worst = over.groupBy("term").agg(F.max("share").alias("share"))
    soft = over.join(worst.where(F.col("share") < REMOVE_SHARE).select("term"), "term")
    stems = None if soft.isEmpty() else _beginnings(soft.select("term", "entity", "with_entity"), near, words.select("row", "term"), total)
    rated = worst.withColumn("stem", F.lit(None).cast("string")) if stems is None else worst.join(stems, "term", "left")
    out = durable(have.join(rated, "term").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("term", "share", "stem"))).alias("terms")), "pii-documents")
    release(candidates, have, over, *([] if stems is None else [stems]))
    if out.isEmpty():
        release(out)
        return None
    return out


def _mentions(text: Column, spans: Column) -> Column:
    """Each span's entity with the words on either side; words that the limit of characters cuts are none."""

    def one(span: Column) -> Column:
        first = F.greatest(span["start"] - NEAR_CHARS, F.lit(0))
        before = F.substring(text, first + 1, span["start"] - first)
        after = F.substring(text, span["end"] + 1, F.lit(NEAR_CHARS))
        cut_first = (first > 0) & F.substring(text, first, F.lit(1)).rlike(r"\p{L}")
        cut_last = F.substring(text, span["end"] + NEAR_CHARS + 1, F.lit(1)).rlike(r"\p{L}")
        left = _words(F.when(cut_first, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before))
        right = _words(F.when(cut_last, F.regexp_replace(after, r"\p{L}+\z", "")).otherwise(after))
        return F.struct(_entity(span).alias("entity"), F.slice(left, F.greatest(F.size(left) - NEAR_WORDS, F.lit(0)) + 1, NEAR_WORDS).alias("left"), F.slice(right, 1, NEAR_WORDS).alias("right"))

    return F.transform(spans, one)


def _named(span: Column, terms: Column) -> Column:
    """A term's span by what becomes of the term."""
    stem = F.get(F.filter(terms, lambda t: t["term"] == F.lower(span["value"])), F.lit(0))["stem"]
    general = F.struct(span["start"].alias("start"), F.lit(KINDS.index("general")).alias("rank"), F.lit("general").alias("kind"), span["end"].alias("end"), span["value"].alias("value"), F.concat(stem, F.lit("*")).alias("put"))
    return F.when(stem.isNotNull(), general.cast(SPAN)).otherwise(span)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, terms): spans by pattern, and of revealing terms, with what ``sanitise`` puts there.

    ``row`` is a hash of the text, which tells rows of one ``doc_id`` apart.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    based = source.withColumn("base", base_spans(F.col("text")))
    found = durable(based.select("doc_id", "row", "base", F.when(F.size("base") > 0, _mentions(F.col("text"), F.col("base"))).otherwise(F.array()).alias("mentions")), "pii-spans")
    none = F.array().cast(f"array<{SPAN}>")
    terms = revealing_terms(found, source)
    if terms is None:
        return found.select("doc_id", "row", "base", none.alias("terms"))
    same = ["doc_id", "row"]
    texts = source.alias("s").join(_small(terms).alias("t"), F.expr("s.doc_id <=> t.doc_id and s.row = t.row")).select("s.doc_id", "s.row", "s.text", "t.terms")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    spans = texts.select(*same, "terms", F.coalesce(_spans(F.col("text"), "term", pattern), none).alias("spans"))
    spans = spans.select(*same, F.transform("spans", lambda x: _named(x, F.col("terms"))).alias("terms")).dropDuplicates(same)
    return found.alias("f").join(spans.alias("p"), F.expr("f.doc_id <=> p.doc_id and f.row = p.row"), "left").select("f.doc_id", "f.row", "f.base", F.coalesce("p.terms", none).alias("terms"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): spans by pattern and terms to remove are replaced by their kind in brackets, others by their beginning and ``*``.

    A span that begins inside an earlier one goes with it.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    found = find(docs).dropDuplicates(["doc_id", "row"])
    joined = source.alias("s").join(found.alias("f"), F.expr("s.doc_id <=> f.doc_id and s.row = f.row"), "left").select("s.doc_id", "s.text", F.array_sort(F.concat("f.base", "f.terms")).alias("spans"))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, span["start"] - acc["at"]), span["put"])
        return F.when(span["start"] >= acc["at"], F.struct(span["end"].alias("at"), put.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], span["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("spans", start, step)
    clean = F.when(F.size("spans") > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
    return joined.select("doc_id", clean.alias("text"))
