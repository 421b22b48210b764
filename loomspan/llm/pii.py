"""Personal data: pattern spans, and terms whose co-occurrence gives protected values away. DataFrame operations only.

The base finds e-mail addresses, IP addresses, card and phone numbers. Each
distinct value is a protected entity, and so is what it can be generalised to:
the domain of an address, the network of an ip, the issuer of a card, the
country of a phone, which many values share. The corpus says how much a term
near an entity, a run of letters within REACH code points, reveals of it. All
counts are of different texts, so copies of a text count once: N of all, n(e) of
those with the entity, n(t) with the term and n(e, t) with the term near the
entity. With I(e) = log2(N / n(e)) the information of an entity, what the term
tells of it is estimated as log2(N (n(e, t) - DISCOUNT) / (n(e) n(t))). Half a
text is taken off each count of meetings, so that a term has to tell a bit more
where it met the entity once than where it met it often; a word that no other
text has gives a value away that no other text has, once the corpus is large
enough for that bit to be a tenth of the information. A term that tells at
least disclosure * I(e) nearly names the entity. In documents that hold the
entity such terms become spans too. Sanitised text has values generalised, to
what at least COMMON texts share or else to their kind, and disclosing terms
removed.

The patterns below accept the same strings as the plain ones of the contract.
They start only where a run of the leading class starts (or the last match
ended) and never give back what they took, so a long run costs linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}+"
REACH = 80  # code points of context on either side of a value
TERM_KIND = len(KINDS)
#: Taken off the number of texts in which a term is near an entity.
DISCOUNT = 0.5
#: Texts that share what a value is generalised to.
COMMON = 5


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, 2 * d).otherwise(d)
        return total + d - F.when(d > 9, 9).otherwise(0)

    n = F.length(digits)
    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")) <= 255))
    return F.when(kind == 1, ip).when(kind == 2, _luhn(digits)).when(kind == 3, F.length(digits).between(9, 15)).otherwise(True)


def _matched(docs: DataFrame) -> DataFrame:
    """row, doc_id, and for rows with any match the text, the matches and the lengths between them of each kind."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    for kind in KINDS:
        hint = F.contains("text", F.lit(HINTS[kind])) if kind == "email" else F.col("text").rlike(HINTS[kind])
        out = out.withColumn(f"m_{kind}", F.when(hint, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))))
    some = {k: F.size(F.coalesce(f"m_{k}", F.array().cast("array<string>"))) > 0 for k in KINDS}
    for kind in KINDS:
        out = out.withColumn(f"l_{kind}", F.when(some[kind], F.transform(F.split("text", PATTERNS[kind], -1), F.length)))
    anything = some["email"] | some["ip"] | some["card"] | some["phone"]
    return out.withColumn("text", F.when(anything, F.col("text")))


def _base_spans(matched: DataFrame) -> DataFrame:
    """row, kind (its place in KINDS), start, end, value. An offset is the running sum of the lengths before it, in code points."""
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"m_{k}").alias("m"), F.col(f"l_{k}").alias("l")) for i, k in enumerate(KINDS)])
    long = matched.where("text is not null").select("row", F.explode(each).alias("x")).where("x.l is not null")
    long = long.select("row", "x.kind", F.posexplode(F.arrays_zip(F.col("x.m").alias("m"), F.slice("x.l", 1, F.size("x.m")).alias("l"))))
    long = long.select("row", "kind", "pos", F.col("col.m").alias("value"), F.col("col.l").alias("gap"))
    w = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    long = long.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(w)).where(_valid(F.col("kind"), F.col("value")))
    return long.select("row", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def _terms(text: Column) -> Column:
    """The distinct runs of letters of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def general_form(kind: Column, value: Column) -> Column:
    """What a value is generalised to: domain, first half of an ip, first six digits, the digits after the plus (three at most)."""
    value = F.lower(value)
    return (
        F.when(kind == 0, F.regexp_extract(value, "@(.*)$", 1))
        .when(kind == 1, F.regexp_extract(value, r"^[0-9]+\.[0-9]+", 0))
        .when(kind == 2, F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 6))
        .otherwise(F.regexp_extract(value, r"^\+[0-9]{1,3}", 0))
    )


def disclosing_terms(docs: DataFrame, contexts: DataFrame, entities: DataFrame, n_texts: int, *, disclosure: float) -> DataFrame:
    """entity, term: the terms that disclose each entity.

    contexts: row, id, entity, around; id is the hash of the row's text.
    entities: entity, n_e. An entity that is in every text has no information,
    and no term discloses it.
    """
    near = contexts.select("entity", "id", F.explode(_terms(F.col("around"))).alias("term")).distinct()
    pairs = written(near.groupBy("entity", "term").agg(F.count("*").alias("both")), "pairs")
    # counts of all terms are summed in each task and then joined, so the join makes a row for each pair and no more;
    # both sides are tables, so that Spark can split a term or entity that very many pairs have
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    df = written(texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    n = F.lit(float(n_texts))
    told = F.log2(n * (F.col("both") - DISCOUNT) / (F.col("n_e") * F.col("n_t")))
    information = F.log2(n / F.col("n_e"))
    joined = pairs.join(entities, "entity").join(df, "term")
    return joined.where((information > 0) & (told >= F.lit(disclosure) * information)).select("entity", "term")


def found(docs: DataFrame, *, disclosure: float = 0.9, common: int = COMMON) -> DataFrame:
    """row, doc_id, text (null where nothing was found), spans: array of (kind, start, end, value, general), sorted.

    One row for each row of docs, repeated ones too; a null text counts as
    empty, and texts may have any length. Offsets are in code points, end
    exclusive. Kinds are places in KINDS, and TERM_KIND. general is what a value
    is generalised to where at least `common` different texts have it, else
    null. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    matched = written(_matched(docs), "pii")
    base = written(_base_spans(matched), "spans")
    identity = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = matched.where("text is not null").select("row", "text")
    own = base.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("spans"))
    around = lambda s: F.concat(  # noqa: E731  a word cut by the edge of the reach is no word
        F.regexp_replace(F.substring("text", F.greatest(s["start"] - REACH + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(REACH)).cast("int")), r"^\p{L}+", ""),
        F.lit(" \n "),
        F.regexp_replace(F.substring("text", (s["end"] + 1).cast("int"), F.lit(REACH)), r"\p{L}+$", ""),
    )
    named = lambda kind, mark, value: F.concat(kind.cast("string"), F.lit(mark), value)
    both = lambda s: F.array(named(s["kind"], ":", F.lower(s["value"])), named(s["kind"], "~", general_form(s["kind"], s["value"])))
    contexts = own.join(texts, "row").select("row", identity.alias("id"), F.explode(F.transform("spans", lambda s: F.struct(both(s).alias("entities"), around(s).alias("around")))).alias("x"))
    contexts = written(contexts.select("row", "id", F.explode("x.entities").alias("entity"), "x.around"), "contexts")
    entities = written(contexts.select("entity", "id").distinct().groupBy("entity").agg(F.count("*").alias("n_e")), "entities")
    n_texts = docs.select(identity.alias("id")).distinct().count()
    flagged = written(disclosing_terms(docs, contexts, entities, n_texts, disclosure=disclosure), "flagged")
    # a row looks for those of its own terms that disclose one of its entities, and for no others
    terms_of = written(texts.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(flagged.select("term").distinct(), "term", "left_semi"), "telling")
    entities_of = written(contexts.select("row", "entity").distinct().join(flagged.select("entity").distinct(), "entity", "left_semi"), "held")
    listed = entities_of.join(flagged, "entity").select("row", "term").distinct().join(terms_of, ["row", "term"]).groupBy("row").agg(F.collect_set("term").alias("terms"))
    # one pattern for all the terms of a row, so its text is searched once
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    at = listed.join(texts, "row").select("row", "text", pattern.alias("pattern"))
    hits = F.arrays_zip(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("m"), F.transform(F.split("text", F.col("pattern"), -1), F.length).alias("l"))
    cut = at.select("row", F.posexplode(hits)).where("col.m is not null")
    w = W.partitionBy("row").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    cut = cut.withColumn("end", F.sum(F.col("col.l") + F.length("col.m")).over(w))
    terms = cut.select("row", F.lit(TERM_KIND).alias("kind"), (F.col("end") - F.length("col.m")).alias("start"), "end", F.col("col.m").alias("value"), F.lit(None).cast("string").alias("general"))
    shared = entities.where(F.contains("entity", F.lit("~")) & (F.col("n_e") >= common)).select("entity")
    form = general_form(F.col("kind"), F.col("value"))
    values = base.withColumn("entity", named(F.col("kind"), "~", form)).join(shared.withColumn("general", F.substring_index("entity", "~", -1)), "entity", "left").drop("entity")
    item = F.struct("kind", "start", "end", "value", "general")
    spans = values.select("row", item.alias("s")).unionByName(terms.select("row", item.alias("s"))).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return matched.select("row", "doc_id", "text").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(spans: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, digest of the base spans, and all spans, from found()."""
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < TERM_KIND)
    return spans.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(spans: DataFrame) -> DataFrame:
    """doc_id, text of the rows with spans, from found(): values become their kind in brackets, with what they are generalised to where there is that; disclosing terms are removed. Overlapping spans are replaced once."""
    names = F.array(*map(F.lit, [k.upper() for k in KINDS]))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["general"].alias("general"))))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    shown = lambda s: F.when(s["kind"] == TERM_KIND, F.lit("")).otherwise(F.concat(F.lit("["), F.concat_ws(" ", F.get(names, s["kind"]), s["general"]), F.lit("]")))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), shown(s))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, none, step, lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return spans.where(F.size("spans") > 0).select("doc_id", done.alias("text"))
