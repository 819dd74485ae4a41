"""PII: patterns, and terms whose co-occurrence with a protected entity discloses it.

Base spans come from four patterns. For every entity they find, all words of the texts that hold it are
candidate terms. Over the whole corpus, ``PMI(t; e) / IC(e) = 1 + log(p(e | t)) / IC(e)`` says which share of the
entity's information a term gives away: 1 if the term stands in no text without it. Terms that reach
the disclosure limit, with the same entity in enough different texts, are removed at all their places in its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import joined, only
from packetloom.session import materialise, settled

KINDS = ("email", "ip", "card", "phone", "term")
# Patterns of the base spans. Possessive loops and a start at a run's edge (or at the end of the match
# before) give the same matches as the plain forms, in linear time on long runs.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}[\p{L}\p{N}'-]*+"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda span: _holds(kind, span["value"])


def _of_kind(k: int):
    return lambda span: span["kind"] == k


def _located(gaps: Column, found: Column, kind: int) -> Column:
    """Spans (start, kind, end, value) of matches, from the texts between them and the matches."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        a = acc["at"] + F.length(F.get(gaps, i))
        b = a + F.length(F.get(found, i))
        one = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), F.get(found, i).alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    last = F.size(found) - 1
    index = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(index, start, step, lambda acc: acc["out"])


def may_hold(text: Column) -> Column:
    """False where no base pattern can match."""
    return F.coalesce(F.contains(text, F.lit("@")) | text.rlike("[0-9]"), F.lit(False))


def base_spans(texts: DataFrame) -> DataFrame:
    """``texts`` with ``base``: spans of the four patterns by start, then kind."""
    columns = texts.columns
    for k, kind in enumerate(KINDS[:4]):
        texts = texts.withColumn(f"f{k}", F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).withColumn(
            f"g{k}", F.when(F.size(f"f{k}") > 0, F.split("text", PATTERNS[kind], -1)))
    held = [F.filter(_located(F.col(f"g{k}"), F.col(f"f{k}"), k), _checked(kind)) for k, kind in enumerate(KINDS[:4])]
    return texts.select(*columns, F.array_sort(F.concat(*held)).alias("base"))


def _entities(hits: DataFrame) -> DataFrame:
    """(key, rows, entity), each entity of a text once."""
    one = hits.select("key", "rows", F.explode("base").alias("s"))
    return one.select("key", "rows", F.concat_ws(":", F.col("s.kind").cast("string"), F.lower(F.regexp_replace(F.col("s.value"), r"[^\p{L}\p{N}@.]", ""))).alias("entity")).distinct()


def _outside(text: Column, base: Column) -> Column:
    """``text`` with a digit for each base span: what is left of a word cut by a span stays no word of its own."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(base, start, step, lambda acc: F.concat(F.array_join(acc["out"], "0"), F.lit("0"), F.substring(text, acc["at"] + 1, F.length(text))))


def _places(gaps: Column, found: Column, terms: Column) -> Column:
    """Spans of the words in ``found`` that are among ``terms``, from the texts between the words and the words."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        a = acc["at"] + F.length(F.get(gaps, i))
        b = a + F.length(F.get(found, i))
        one = F.array(F.struct(a.alias("start"), F.lit(4).alias("kind"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(F.array_contains(terms, F.lower(F.get(found, i))), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])


def found_spans(docs: DataFrame, limit: float = 0.85, support: int = 3) -> DataFrame:
    """(key, rows, base, terms) per distinct text with a base span; key is the text's MD5.

    ``support`` counts different texts, so copies of one text prove nothing by themselves.
    """
    texts = only(docs, "text").where(may_hold(F.col("text")))
    hits = base_spans(texts).where(F.size("base") > 0).withColumn("key", F.md5("text"))
    hits = materialise(hits.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("text").alias("text"), F.first("base").alias("base")), "pii-hits")
    n = docs.count()
    words = only(docs, "text").where("text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    df = words.groupBy(F.xxhash64("term").alias("h")).agg(F.count(F.lit(1)).alias("df"))
    each = _entities(hits)
    content = -F.log(F.col("of") / F.lit(float(max(n, 1))))
    whole = each.groupBy("entity").agg(F.sum("rows").alias("of"), F.count(F.lit(1)).alias("texts")).where((F.col("texts") >= support) & (content > 0))
    # a term that stands in more texts cannot reach the limit, even if it stands in all of the entity's
    whole = whole.select("entity", "of", (F.col("of") * F.exp((1 - limit) * content) * (1 + 1e-9)).alias("most"))
    each = materialise(each.join(whole, "entity"), "pii-entities")
    some = hits.join(each.select("key").distinct(), "key", "left_semi")
    held = some.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_outside(F.col("text"), F.col("base"))), F.lit(TERM), F.lit(0)))).alias("term"))
    held = held.withColumn("h", F.xxhash64("term")).join(df.where(F.col("df") >= support), "h").select("key", "term", "df")
    near = materialise(held.join(each, "key").where(F.col("df") <= F.col("most")).select("key", "rows", "entity", "of", "term", "df"), "pii-near")
    both = near.groupBy("entity", "term").agg(
        F.sum("rows").alias("both"), F.count(F.lit(1)).alias("texts"), F.first("of").alias("of"), F.first("df").alias("df")).where(F.col("texts") >= support)
    share = 1 + F.log(F.col("both") / F.greatest("df", "both")) / content
    told = both.where(share >= limit).select("entity", "term")
    flagged = near.select("key", "entity", "term").join(told, ["entity", "term"]).groupBy("key").agg(F.collect_set("term").alias("flagged"))
    placed = hits.join(flagged, "key").withColumn("found", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("gaps", F.split("text", TERM, -1))
    free = F.filter(_places(F.col("gaps"), F.col("found"), F.col("flagged")), lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    terms = placed.where(F.size("found") > 0).select("key", free.alias("terms"))
    return hits.select("key", "rows", "base").join(terms, "key", "left").select(
        "key", "rows", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"),
        F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("terms"))


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return joined(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def pii_spans(docs: DataFrame, limit: float = 0.85, support: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); columns as in the query.

    Null and empty texts have no spans. Repeated rows get the same spans each; a null doc_id is kept;
    extra columns are ignored; an empty table gives no rows.
    """
    rows = only(docs, "doc_id", "text")
    found = settled(docs.sparkSession, lambda: found_spans(docs, limit, support), "pii-spans")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    clean = rows.where(~may_hold(F.col("text"))).select("doc_id", none.alias("base"), none.alias("terms"))
    held = rows.where(may_hold(F.col("text"))).select("doc_id", F.md5("text").alias("key")).join(found, "key", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))
    both = clean.union(held)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return both.select("doc_id", *counts, F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _named(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, limit: float = 0.85, support: int = 3) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; all columns kept.

    Overlapping spans are replaced as one. Texts without spans, null ones included, stay as they are
    and are not shuffled.
    """
    found = settled(docs.sparkSession, lambda: found_spans(docs, limit, support), "pii-spans").select(
        F.col("key").alias("_key"), F.array_sort(F.concat("base", "terms")).alias("_spans"))
    columns = docs.columns
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.array(gap, F.get(kinds, s["kind"])))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rewritten = F.aggregate("_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    hit = docs.where(may_hold(F.col("text"))).withColumn("_key", F.md5("text")).join(found, "_key", "left")
    hit = hit.withColumn("text", F.when(F.col("_spans").isNotNull(), rewritten).otherwise(F.col("text")))
    return docs.where(~may_hold(F.col("text"))).union(hit.select(*[F.col(f"`{c}`") for c in columns]))
