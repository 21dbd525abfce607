"""Information-theoretic sanitisation: personal data by pattern, and the terms that give an entity away.

Only DataFrame functions. Matches are marked in the text with two control characters and the text is cut
at the marks, which yields places without a function of its own; other uses of the two characters are
replaced first, and no pattern can match either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.tables import WORD, read, written

# The patterns asked for. Possessive forms match the same text in one pass, whatever its
# length: a run of characters is only tried from its start, or from the end of the match before.
LOCAL, HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CUE = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
MIN_JOINT = 3  # different texts in which a term meets an entity; one is enough for a term that is part of it
MIN_SHARE = 0.5  # of the different texts with the term, those that hold the entity
MIN_BITS = 4.0  # pointwise mutual information of term and entity
STEP = 64  # elements folded at once; lists of n elements take about n * (STEP + n / STEP ** 2) steps
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def luhn(digits: Column) -> Column:
    """Check sum of a string of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The tests a match must pass; there is no second try inside a match that fails."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def passes(kind: str):
    return lambda span: valid(kind, span["value"])


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_steps(items: Column, kind: str, start: Column, step) -> Column:
    """Running values of a list: step(value before, item), as an array of `kind`.

    Short lists are folded one after the other and the lists then joined, because a list that grows by one
    element at a time is copied each time.
    """
    empty = F.array().cast(f"array<{kind}>")

    def piece(list_, state, at):
        part = F.slice(list_, at + 1, STEP)
        begun = F.struct(state["v"].alias("v"), empty.alias("l"))
        done = F.aggregate(part, begun, lambda a, x: let(step(a["v"], x), lambda v: F.struct(v.alias("v"), F.concat(a["l"], F.array(v)).alias("l"))))
        return let(done, lambda d: F.struct(d["v"].alias("v"), F.concat(state["l"], F.array(d["l"])).alias("l")))

    offsets = lambda list_: F.sequence(F.lit(0), F.greatest(F.size(list_) - 1, F.lit(0)), F.lit(STEP))
    begun = F.struct(start.cast(kind).alias("v"), F.array().cast(f"array<array<{kind}>>").alias("l"))
    return let(items, lambda list_: F.flatten(F.aggregate(offsets(list_), begun, lambda state, at: piece(list_, state, at))["l"]))


def marked_spans(kind: str, marked: Column) -> Column:
    """Spans (kind, start, end, value) of the marked stretches of a text, in code points."""
    def cut(pieces):
        ends = in_steps(F.transform(pieces, F.length), "bigint", F.lit(0), lambda at, n: at + n)
        return F.zip_with(pieces, ends, lambda p, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(p)).cast("bigint").alias("start"), e.alias("end"), p.alias("value")))

    return F.filter(let(F.split(marked, f"[{OPEN}{CLOSE}]", -1), cut), lambda _, i: i % 2 == 1)


def replaced(text: Column, spans: Column, filling) -> Column:
    """The text with filling(kind, length) in place of the spans; overlapping ones are replaced as one, under the
    kind of the first. Texts are cut in stretches of STEP spans, so that no cut walks through the whole text."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def segments(order, reach):
        both = F.zip_with(order, F.concat(F.array(F.lit(-1).cast("bigint")), reach), lambda s, r: F.struct(s.alias("s"), r.alias("before")))
        return F.filter(both, lambda x: x["s"].isNotNull() & (x["s"]["start"] >= x["before"]))

    def bounded(first, reach):
        ends = F.concat(F.transform(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), lambda x: x["before"]), F.slice(reach, F.size(reach), 1))
        return let(ends, lambda e: F.filter(F.zip_with(F.zip_with(first, e, lambda x, y: F.struct(x["s"]["start"].alias("start"), y.alias("end"), x["s"]["kind"].alias("kind"))),
                                                       F.concat(F.array(F.lit(0).cast("bigint")), e), lambda x, b: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), b.alias("from"))),
                                            lambda x: x["start"].isNotNull()))  # zip_with pads the shorter list

    def stretch(whole, part):
        """One stretch of segments: cut out of the text once, then taken apart."""
        origin = part[0]["from"]
        cut = F.struct(part.alias("p"), origin.alias("o"), F.substring(whole, (origin + 1).cast("int"), (F.element_at(part, -1)["end"] - origin).cast("int")).alias("t"))
        return let(cut, lambda c: F.array_join(F.transform(c["p"], lambda x: F.concat(
            F.substring(c["t"], (x["from"] - c["o"] + 1).cast("int"), (x["start"] - x["from"]).cast("int")), filling(x["kind"], x["end"] - x["start"]))), ""))

    def filled(whole, found):
        cuts = F.transform(F.sequence(F.lit(0), F.size(found) - 1, F.lit(STEP)), lambda at: let(F.slice(found, at + 1, STEP), lambda part: stretch(whole, part)))
        return F.concat(F.array_join(cuts, ""), F.substring(whole, (F.element_at(found, -1)["end"] + 1).cast("int"), F.length(whole)))

    def worked(order):
        reach = in_steps(F.transform(order, lambda s: s["end"]), "bigint", F.lit(0), lambda at, e: F.greatest(at, e))
        return let(reach, lambda r: let(segments(order, r), lambda first: let(bounded(first, r), lambda found: filled(text, found))))

    return F.when(F.size(spans) > 0, let(ordered, worked)).otherwise(text)


def base_spans(text: Column) -> Column:
    """All personal data of a text, by kind as listed, then by start."""
    found = []
    for kind, pattern in PATTERNS.items():
        cue = F.contains(text, F.lit(CUE[kind])) if CUE[kind] else text.rlike("[0-9](?:[ -]?[0-9]){15}")
        spans = marked_spans(kind, F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"))
        found.append(F.when(cue, F.filter(spans, passes(kind))).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, OTHER + OTHER)


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans; every other place stays where it is."""
    return replaced(text, spans, lambda kind, n: F.repeat(F.lit(" "), n.cast("int")))


def terms(text: Column) -> Column:
    """Different words of a text in lower case, two characters or longer."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+")), lambda w: F.length(w) >= 2)


def parts(span: Column) -> Column:
    """What is protected about a match: itself, and the parts that a rare one shares with others: host and name
    parts of an address, the network of an IP number, the leading digits of a card or phone number."""
    value, digits = F.lower(span["value"]), F.regexp_replace(span["value"], "[^0-9]", "")
    words = F.filter(F.split(F.substring_index(value, "@", 1), "[^a-z]+"), lambda w: F.length(w) >= 3)
    more = F.when(span["kind"] == "email", F.concat(F.array(F.concat(F.lit("host:"), F.substring_index(value, "@", -1))), F.transform(words, lambda w: F.concat(F.lit("name:"), w)))).when(
        span["kind"] == "ip", F.array(F.concat(F.lit("net:"), F.substring_index(value, ".", 3)))).when(
        span["kind"] == "card", F.array(F.concat(F.lit("issuer:"), F.substring(digits, 1, 6)))).otherwise(F.array(F.concat(F.lit("line:"), F.substring(digits, 1, 7))))
    return F.concat(F.array(F.concat_ws(":", span["kind"], value)), more)


def hash_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def disclosing(docs: DataFrame, base: DataFrame, text: str) -> DataFrame | None:
    """(_hash, terms): for each text with personal data, its terms that give one of its entities away; None if no
    term comes into question.

    Entities are the matches and their parts, see `parts`. A term t gives entity e away if at least MIN_JOINT
    different texts hold both (or t is a name part of the address e itself), at least MIN_SHARE of the texts
    with t hold e, and log2 P(t, e) / (P(t) P(e)) is at least MIN_BITS. All counts are of different texts,
    so copying a text neither makes a term suspicious nor clears it. They cover all documents: terms of texts
    without personal data are only counted, and only those that came into question before.
    """
    entity = F.array_distinct(F.flatten(F.transform("spans", parts)))
    holders = base.where("_hash IS NOT NULL").groupBy("_hash").agg(F.first("_blanked").alias("_blanked"), F.first(entity).alias("entities"))
    holders = written(holders.select("_hash", terms(F.col("_blanked")).alias("terms"), "entities"), "pii_holders")
    spread = holders.select("_hash", F.explode("entities").alias("entity"))
    entities = written(spread.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "pii_entities")
    often = spread.join(entities.where(F.col("n_entity") >= MIN_JOINT), "entity").join(holders.select("_hash", "terms"), "_hash")
    met = often.select("entity", "n_entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_joint"), F.first("n_entity").alias("n_entity")).where(F.col("n_joint") >= MIN_JOINT)
    named = holders.select(F.explode("entities").alias("entity"), "terms").where("entity LIKE 'name:%'").withColumn("term", F.substring("entity", 6, 1 << 30))
    named = named.where(F.array_contains("terms", F.col("term"))).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_joint")).join(entities, "entity")
    joint = written(met.unionByName(named).groupBy("entity", "term").agg(F.max("n_joint").alias("n_joint"), F.max("n_entity").alias("n_entity")), "pii_joint")
    suspects = written(joint.groupBy("term").agg(F.max("n_joint").alias("_most")), "pii_suspects")
    if suspects.isEmpty():
        return None
    # Texts with a term: all of them, less the second and further copies.
    whole = plain(F.col(text))
    groups = written(docs.select(hash_of(whole).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_copies")), "pii_texts")
    total, extra = groups.count(), groups.where("_copies > 1")
    every = docs.select(F.explode(terms(whole)).alias("term")).join(suspects.select("term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if not extra.isEmpty():
        copied = docs.select(hash_of(whole).alias("_hash"), whole.alias("_whole")).join(extra, "_hash").groupBy("_hash").agg(F.first("_whole").alias("_whole"), F.first("_copies").alias("_copies"))
        again = copied.select(F.explode(terms(F.col("_whole"))).alias("term"), "_copies").join(suspects.select("term"), "term").groupBy("term").agg(F.sum(1 - F.col("_copies")).alias("n"))
        every = every.unionByName(again)
    words = every.groupBy("term").agg(F.sum("n").alias("n_term"))
    bits = F.log2(F.col("n_joint") * float(total) / (F.col("n_term") * F.col("n_entity")))
    given = written(joint.join(words, "term").where((F.col("n_joint") >= F.col("n_term") * MIN_SHARE) & (bits >= MIN_BITS)).select("entity", "term"), "pii_given")
    hits = spread.join(given.groupBy("entity").agg(F.collect_set("term").alias("_given")), "entity").join(holders.select("_hash", "terms"), "_hash")
    return written(hits.groupBy("_hash").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("_given", "terms")))).alias("terms")).where("size(terms) > 0"), "pii_terms")


def term_spans(blank: Column, found: Column) -> Column:
    """Places of the given terms among the words of a text, in any case."""
    any_of = F.concat(F.lit(r"(?iu)(?<![^\x20\x09-\x0D])(?:"), F.array_join(F.transform(found, lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), "|"), F.lit(r")(?![^\x20\x09-\x0D])"))
    return marked_spans("term", F.regexp_replace(blank, any_of, F.lit(f"{OPEN}$0{CLOSE}")))


def examined(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every document (or its columns `carry`) packed as `_row`, with `spans` (personal data) and
    `term_spans` (disclosing terms), both arrays of (kind, start, end, value) in code points.

    A null text is empty and has no spans. Repeated rows are alike. Terms never overlap base spans.
    """
    named = [F.col(f"`{c}`") for c in carry or docs.columns]
    packed = docs.select(F.struct(*named).alias("_row"), plain(F.col(text)).alias("_plain"))
    spans = packed.withColumn("spans", base_spans(F.col("_plain")))
    has = F.size("spans") > 0
    base = written(spans.select("_row", "spans", F.when(has, hash_of(F.col("_plain"))).alias("_hash"),
                                F.when(has, blanked(F.col("_plain"), F.col("spans"))).alias("_blanked")), "pii_base")
    given, none = disclosing(docs, base, text), F.array().cast(SPAN)
    if given is None:
        return base.select("_row", "spans", none.alias("term_spans"))
    found = base.where("_hash IS NOT NULL").join(given, "_hash", "left")
    found = found.select("_row", "spans", F.when(F.col("terms").isNotNull(), term_spans(F.col("_blanked"), F.col("terms"))).otherwise(none).alias("term_spans"))
    return found.unionByName(base.where("_hash IS NULL").select("_row", "spans", none.alias("term_spans")))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data generalised to their kind and disclosing terms to [TERM]; a null
    text stays null. Overlapping spans are replaced once, the first one naming the kind."""
    rows = examined(docs, text)
    whole = F.col("_row").getField(text)
    clean = F.when(whole.isNotNull(), replaced(whole, F.concat("spans", "term_spans"), lambda kind, n: F.concat(F.lit("["), F.upper(kind), F.lit("]"))))
    return rows.select(*[(clean.alias(c) if c == text else F.col(f"_row.`{c}`")) for c in docs.columns])


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(spark, sf_dir: str) -> DataFrame:
    rows = examined(read(spark, sf_dir, "documents"), carry=["doc_id"])
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return rows.select("_row.doc_id", *counts, F.sha2(joined_spans(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
                       joined_spans(F.concat("spans", "term_spans")).alias("spans"))
