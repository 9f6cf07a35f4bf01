"""Personal data: fixed patterns, and information-theoretic sanitisation of revealing terms. DataFrame functions only.

Protected entities are the values that the patterns find. Terms (words of letters) of the documents with an entity are
compared with the whole corpus: with n_te documents that hold term t and entity e, n_t with t and n_e with e out of N, t
reveals e if they meet in texts that are no near copies of one another, P(e|t) = n_te / n_t >= ``MIN_DISCLOSURE`` and the
pointwise mutual information log2(N n_te / (n_t n_e)) >= ``MIN_BITS``. Every occurrence of such a term, in every document,
is reported (kind ``term``) and removed, whether the entity is spelled out there or not.

Copies are no evidence: documents with one entity that share one of ``FEATURES`` features of ``HASHES`` least shingle hashes
are one class (texts of similarity 0.8 do with a probability of 0.9998, those of 0.1 with one of 0.012), and a term needs two
classes.

Defined cases: a null or empty text has no spans; rows are kept apart by a number of their own, so null or repeated ids
and repeated rows are safe; matches of one kind don't overlap, those of different kinds may, but a term inside a match of a
pattern is not reported; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semweave.llm.shared import broadcast_if_small, stage_table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "term")

#: Java forms of the patterns. The possessive and look-behind parts only keep matching linear: they give the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{4,}+"
MIN_DISCLOSURE = 0.5
MIN_BITS = 3.0
#: Copies are told by this many features of so many least hashes of three-word shingles.
FEATURES, HASHES = 12, 3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.split(F.reverse(number), "")
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d.cast("int"), F.lit(0))) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """What a match must pass beside its pattern."""
    if kind == "ip":
        value = lambda part: F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 4).try_cast("int"), F.lit(0))
        return F.forall(F.split(match, r"\."), lambda part: value(part) <= 255)
    if kind == "card":
        n = digits(match)
        return F.when(F.length(n).between(14, 19), luhn(n)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def of_match(kind: str):
    return lambda match: holds(kind, match)


def of_span(kind: str):
    return lambda span: holds(kind, span["value"])


NO_SPANS = "cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"


def placed(kind: str, text: Column, pattern: str | Column, matches: Column) -> Column:
    """Spans of ``matches`` (all matches of ``pattern`` in ``text``): the pieces between them give their places."""
    pieces = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(pieces, F.lit(1), F.size(matches)), F.length).alias("gap"), matches.alias("value"))
    none = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["0"]
        end = start + F.length(pair["1"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["1"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.transform(pairs, lambda p: F.struct(p["gap"].alias("0"), p["value"].alias("1")))
    return F.aggregate(zipped, none, step, lambda acc: acc["out"])


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and ``found``: the spans of the fixed patterns that pass, by start, then kind."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    hint = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+"), "ip": F.lit(True), "card": F.lit(True)}
    for kind, pattern in PATTERNS.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        rows = rows.withColumn(f"m_{kind}", F.when(hint[kind], hits).otherwise(F.expr("cast(array() as array<string>)")))
    for kind, pattern in PATTERNS.items():
        m = F.col(f"m_{kind}")
        spans = placed(kind, F.col("text"), pattern, m)
        passed = F.filter(spans, of_span(kind))
        rows = rows.withColumn(f"s_{kind}", F.when(F.exists(m, of_match(kind)), passed).otherwise(F.expr(NO_SPANS)))
    return rows.select("doc_id", "text", in_order(F.concat(*(F.col(f"s_{k}") for k in BASE_KINDS)), BASE_KINDS).alias("found"))


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(rank, s["kind"]).alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def entity(span: Column) -> Column:
    """What is protected: one value in all its spellings."""
    return F.when(span["kind"].isin("card", "phone"), F.concat(span["kind"], F.lit(":"), digits(span["value"]))).otherwise(
        F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))
    )


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= 4)


def features(texts: DataFrame) -> DataFrame:
    """(row, k, f): ``FEATURES`` features of each text of ``texts`` (row, words), a written table."""
    shingle = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    least = [F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(FEATURES * HASHES)]
    found = texts.select("row", F.explode(shingle).alias("h")).groupBy("row").agg(*least)
    own = F.array(*(F.xxhash64(F.lit(b), *(f"m{b * HASHES + i}" for i in range(HASHES))) for b in range(FEATURES)))
    return found.select("row", F.posexplode(own).alias("k", "f"))


def revealing_terms(rows: DataFrame) -> DataFrame:
    """(term): the terms that reveal an entity, from ``rows`` (row, text, entities).

    No group is ever gathered: all figures are sums and extremes, made of partial ones before they are exchanged."""
    total = rows.count()
    with_any = rows.where("size(entities) > 0")
    each = with_any.select("row", F.xxhash64("text").alias("h"), F.explode("entities").alias("entity"))
    known = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.min("h").alias("low"), F.max("h").alias("high"))
    # an entity of one text has no evidence but copies; one of over N / 2^MIN_BITS documents can't tell that many bits
    known = stage_table(known.where((F.col("low") != F.col("high")) & (F.col("n_e") * 2**MIN_BITS <= total)).select("entity", "n_e"), "entities")
    links = stage_table(each.select("row", "entity").join(broadcast_if_small(known.select("entity")), "entity"), "entity-rows")
    hit = broadcast_if_small(stage_table(links.select("row").distinct(), "rows-with-entities"))
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    texts = stage_table(with_any.join(hit, "row", "left_semi").select("row", terms_of(F.col("text")).alias("terms"), words.alias("words")), "entity-texts")

    # classes of copies: the smallest row with one of the row's features
    marks = stage_table(links.join(features(texts), "row"), "entity-features")
    first = stage_table(marks.groupBy("entity", "k", "f").agg(F.min("row").alias("first")), "first-copies")
    classes = stage_table(marks.join(first, ["entity", "k", "f"]).groupBy("entity", "row").agg(F.min("first").alias("class")), "copies")

    met = classes.join(texts, "row").select("entity", "class", F.explode("terms").alias("term"))
    pairs = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"), F.min("class").alias("low"), F.max("class").alias("high"))
    pairs = stage_table(pairs.where("low <> high").drop("low", "high"), "entity-terms")
    n_t = rows.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = pairs.join(n_t, "term").join(known, "entity")
    disclosed = (F.col("n_te") >= MIN_DISCLOSURE * F.col("n_t")) & (F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) >= MIN_BITS)
    return stage_table(scored.where(disclosed).select("term").distinct(), "revealing")


def outside(span: Column, base: Column) -> Column:
    """The span overlaps none of ``base``."""
    return ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end; code points, end exclusive; by start, then kind), of the fixed patterns
    and of the terms that reveal what they found. ``keep_text`` adds the text."""
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = base_spans(docs, id_col, text_col)
    told = found.select(
        "doc_id",
        "text",
        bare(F.col("found")).alias("base"),
        F.when(F.size("found") > 0, F.array_distinct(F.transform("found", entity))).otherwise(F.expr("cast(array() as array<string>)")).alias("entities"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage_table(told, "pii")  # from here on each row has its own fixed number
    reveals = broadcast_if_small(revealing_terms(rows.select("row", "text", "entities")))
    hits = rows.select("row", F.explode(terms_of(F.col("text"))).alias("term")).join(reveals, "term")
    by_row = stage_table(hits.groupBy("row").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms")), "rows-with-terms")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("terms"), F.lit(r")(?!\p{L})"))
    spans = placed("term", F.col("text"), pattern, F.regexp_extract_all("text", pattern, F.lit(0)))
    terms = F.filter(bare(spans), lambda s: outside(s, F.col("base")))
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(in_order(F.concat("base", terms), KINDS))
    return rows.join(broadcast_if_small(by_row), "row", "left").select("doc_id", *(["text"] if keep_text else []), every.alias("spans"))


def sanitize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the sanitised ``text``: fixed-pattern spans are generalised to their kind, revealing terms removed.
    Overlapping spans are replaced once, by the first of them."""
    rows = pii_spans(docs, id_col=id_col, text_col=text_col, keep_text=True)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] < acc["at"], "").when(s["kind"] == "term", "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before, mark).alias("out"))

    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return rows.select("doc_id", done.alias("text"))
