r"""Personal data: patterns, and terms that give a protected value away; DataFrame functions only.

Base kinds are e-mail and IP addresses, card and phone numbers, found by pattern and then checked. The method adds spans of kind
``term``: with every value found being a protected entity e, a term t of the same document discloses it to the degree
``PMI(t, e) / IC(e)``, where PMI = log(N P(e|t) / n(e)) and IC = log(N / n(e)) come from document counts over the whole corpus and whole texts.
1 means that the term never occurs without the value. P(e|t) is not the bare share n(t,e) / n(t) but the lower end of its Wilson interval (``Z``), so a
term seen once tells less than one seen often, and no pair is left out for being rare. Values also share evidence by class (mail domain, first half of an IP
address, issuer of a card, first digits of a phone number): what a term tells of the class counts towards every value in it, again as a share of IC(e), and the
greater of both holds. From ``GENERALISE_AT`` on, the term is replaced by a general placeholder wherever it stands in a document that holds the value, from
``REMOVE_AT`` on it is removed. Terms are runs of letters, digits and underscores of any length, lower-cased; those within a base span are evidence, but
get no span of their own. A value that every document holds can't be disclosed. Base spans are always replaced by the name of their kind.

Patterns are written so that matching is linear: possessive runs that begin only where a run can begin.

A null text counts as empty: no spans. Each row is judged by itself, repeated rows alike (they count in the corpus).
Spans count code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewise.llm.common import cut, fresh, write_table

# The kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    # A run of name characters can only begin after another character or right after the last match.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    # Fourteen digits or more; a shorter run is no card and can't overlap a longer one.
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MAYBE = r"@|\+[0-9]|[0-9]\.[0-9]|[0-9](?:[ -]?[0-9]){13}"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"
TERM = r"[\p{L}\p{N}_]+"
Z = 1.645
GENERALISE_AT, REMOVE_AT = 0.7, 0.9
SPAN = "struct<kind:string,start:bigint,stop:bigint,value:string>"


def _places(text: Column, pattern: str, kind: Column, offset: Column, keep=None) -> Column:
    """All matches of a pattern (that ``keep`` is true for) as spans: what stands between the matches gives their places."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(offset.cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(seen, pair):
        begin = seen["at"] + F.char_length(pair["gap"])
        stop = begin + F.char_length(pair["match"])
        span = F.struct(kind.alias("kind"), begin.alias("start"), stop.alias("stop"), pair["match"].alias("value"))
        more = F.concat(seen["spans"], F.array(span))
        return F.struct(stop.alias("at"), (F.when(keep(pair["match"]), more).otherwise(seen["spans"]) if keep else more).alias("spans"))

    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda seen: seen["spans"])


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, nine taken off what exceeds nine; the sum divides by ten."""
    def value(d, i):
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(ADDRESS)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid spans of the base kinds, kind by kind."""
    test = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "card": F.lit(True), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast(f"array<{SPAN}>")

    def found(kind, pattern):
        spans = F.filter(_places(text, pattern, F.lit(kind), F.lit(0)), lambda s: _valid(kind, s["value"]))
        return F.when(test[kind], spans).otherwise(none)

    return F.concat(*(found(kind, pattern) for kind, pattern in PATTERNS.items()))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def _class(value: Column) -> Column:
    """What values of an entity ``kind:value`` share evidence by."""
    kind = F.substring_index(value, ":", 1)
    return F.when(kind == "email", F.concat(F.lit("email@"), F.substring_index(value, "@", -1))).when(
        kind == "ip", F.concat(F.lit("ip/"), F.substring_index(F.substring_index(value, ":", -1), ".", 2))).when(
        kind == "card", F.concat(F.lit("card/"), F.substring(F.substring_index(value, ":", -1), 1, 6))).otherwise(
        F.concat(F.lit("phone/"), F.substring(F.substring_index(value, ":", -1), 1, 4)))


def _standing(texts: DataFrame) -> DataFrame:
    """(row, most, term, places) of (row, most, text): where each distinct term of a text stands. Gaps and terms alternate; their lengths add up to places.

    Texts are dealt out by row once, what is taken from them stays in its task."""
    text = F.col("text")
    pairs = F.arrays_zip(F.split(text, TERM, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("term"))
    runs = texts.repartition("row").select("row", "most", F.posexplode(pairs).alias("at", "pair")).select(
        "row", "most", "at", F.char_length("pair.gap").alias("gap"), F.col("pair.term").alias("term")).where("term IS NOT NULL")
    so_far = W.partitionBy("row").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    stop = F.sum((F.col("gap") + F.char_length("term")).cast("long")).over(so_far)
    placed = runs.select("row", "most", F.lower("term").alias("lowered"), (stop - F.char_length("term")).alias("start"), stop.alias("stop"))
    return placed.groupBy("row", "most", F.col("lowered").alias("term")).agg(F.collect_list(F.struct("start", "stop")).alias("places"))


def _lower_share(hits: Column, n: Column, z: float = Z) -> Column:
    """The lower end of the Wilson interval of a share."""
    share, z2 = hits / n, z * z
    return (share + z2 / (2 * n) - z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing_terms(docs: DataFrame, texts: DataFrame, held: DataFrame, text: str, at: float = GENERALISE_AT) -> DataFrame:
    """(row, places, disclosure) of the terms that give away a value of their document, and where they stand.

    ``texts``: (row, text) of documents with values; ``held``: (row, entity), distinct; ``docs`` give the corpus counts.
    As P(e|t) is at most n(e) / n(t) and at most 1, PMI can't reach ``at`` times IC where n(t) or n(e) exceeds N exp(-at IC): such pairs, nearly all, are
    left out before any are counted, which changes no result. Terms and values of a document meet in a join on its row."""
    total = float(docs.count())
    of_entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    known = held.join(of_entity, "entity").select("row", "entity", F.log(F.lit(total) / F.col("n")).alias("content")).where("content > 0")
    # Every value stands for itself and for its class; a class counts once a document, by the least content it has to reach there.
    both = known.select("row", F.explode(F.array("entity", _class(F.col("entity")))).alias("holder"), "content")
    holders = cut(both.groupBy("row", "holder").agg(F.min("content").alias("content")))
    of_all = held.select("row", F.explode(F.array("entity", _class(F.col("entity")))).alias("holder")).distinct()
    of_holder = of_all.groupBy("holder").agg(F.count(F.lit(1)).alias("n_holder")).join(
        holders.groupBy("holder").agg(F.min("content").alias("least")), "holder")
    reach = F.lit(total * (1 + 1e-9)) * F.exp(F.lit(-at) * F.col("least"))
    able = cut(holders.join(of_holder.withColumn("reach", reach).where("n_holder <= reach"), "holder"))
    bound = able.groupBy("row").agg(F.max("reach").alias("most"))
    words = docs.select(F.explode(_terms(F.col(text))).alias("term"))
    seen = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))  # added up in each task before it is shuffled
    standing = _standing(texts.join(bound, "row"))
    rare = write_table(standing.join(seen, "term").where("n_term <= most").select("row", "term", "n_term", "places"))
    pairs = rare.select("row", "term", "n_term").join(able, "row").where("n_term <= reach")
    counted = pairs.groupBy("holder", "term", "n_holder", "n_term", "least").agg(F.count(F.lit(1)).alias("both"))
    pmi = F.log(F.lit(total) / F.col("n_holder")) + F.log(_lower_share(F.col("both"), F.col("n_term")))
    telling = counted.withColumn("pmi", pmi).where(F.col("pmi") >= at * F.col("least")).select("holder", "term", "pmi")
    told = pairs.select("row", "holder", "term", "content").join(telling, ["holder", "term"]).withColumn(
        "disclosure", F.col("pmi") / F.col("content")).where(F.col("disclosure") >= at)
    return rare.join(told.groupBy("row", "term").agg(F.max("disclosure").alias("disclosure")), ["row", "term"]).select("row", "places", "disclosure")


def find_private(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """``docs`` as two tables: rows with a digit or sign that private data need, with a new column of spans, and all other rows.

    Returns (rows with spans, the others unchanged, the column's name). Spans: (start, place of the kind in ``KINDS``, stop, remove)."""
    maybe = F.coalesce(F.col(text).rlike(MAYBE), F.lit(False))
    spans, row = fresh(docs, "_spans"), fresh(docs, "_row")
    found = docs.filter(maybe).withColumn(row, F.monotonically_increasing_id()).withColumn(spans, base_spans(F.col(text)))
    found = cut(found)
    # Numbers are the same however they are grouped.
    bare = lambda s: F.when(s["kind"].isin("card", "phone"), F.regexp_replace(s["value"], "[^0-9]", "")).otherwise(F.lower(s["value"]))
    entities = F.array_distinct(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), bare(s))))
    held = found.select(F.col(row).alias("row"), F.explode(entities).alias("entity"))
    texts = found.where(F.size(spans) > 0).select(F.col(row).alias("row"), F.col(text).alias("text"))
    flagged = disclosing_terms(docs, texts, held, text)
    name, kind = fresh(docs, "_added"), "array<struct<start:bigint,kind:int,stop:bigint,remove:boolean>>"
    places = flagged.select("row", F.explode("places").alias("p"), (F.col("disclosure") >= REMOVE_AT).alias("remove"))
    as_span = F.struct(F.col("p.start").alias("start"), F.lit(KINDS.index("term")).alias("kind"), F.col("p.stop").alias("stop"), F.col("remove").alias("remove"))
    by_row = places.groupBy(F.col("row").alias(row)).agg(F.collect_list(as_span).cast(kind).alias(name))
    added = F.filter(name, lambda t: ~F.exists(spans, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    place = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    base = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("kind"), s["stop"].alias("stop"), F.lit(False).alias("remove")))
    both = F.array_sort(F.concat(base.cast(kind), F.coalesce(added, F.array().cast(kind))))
    with_spans = found.join(by_row, row, "left").select(*docs.columns, both.alias(spans))
    return with_spans, docs.filter(~maybe), spans


def spans_text(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < KINDS.index("term")) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def private_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts by base kind, a digest of the base spans, and all spans as text."""
    some, others, spans = find_private(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,remove:boolean>>")
    both = some.unionByName(others.withColumn(spans, none))
    count = lambda i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    return both.select(
        F.col("key").alias(key), *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(spans_text(F.col(spans), True).cast("binary"), 256).alias("base_sha256"), spans_text(F.col(spans)).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with private data replaced in ``text``; other columns, and texts without any, unchanged."""
    some, others, spans = find_private(docs, text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    source = F.col(text)

    def step(seen, s):
        between = F.substr(source, (seen["at"] + 1).cast("int"), F.greatest(s["start"] - seen["at"], F.lit(0)).cast("int"))
        held = F.when(s["remove"], F.lit("")).otherwise(F.get(names, s["kind"]))
        return F.when(s["stop"] <= seen["at"], seen).otherwise(F.struct(s["stop"].alias("at"), F.concat(seen["out"], between, held).alias("out")))

    rest = lambda seen: F.concat(seen["out"], F.substr(source, (seen["at"] + 1).cast("int"), F.char_length(source)))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(source)
    changed = some.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
    return changed.unionByName(others)
