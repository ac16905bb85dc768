"""Personal data, found and sanitised with DataFrame operations alone.

Base spans are the matches of four patterns. Beside them stands an information-theoretic test: a protected entity is a
value that the patterns matched, and a term reveals it as far as the corpus shows them together. With p the share of
documents, a term t exceeds the disclosure threshold of an entity c when

    log2(p(c, t) / (p(c) p(t))) >= log2(1 / p(c)) / alpha

that is, when knowing t gives at least 1/alpha of the information that c itself carries. A pair needs ``min_texts`` distinct
texts, for one text alone shows nothing. Terms are words and numbers of the whole document, of any length, that stand in no span; wherever a
revealing term stands, with the entity or without it, it is a span of kind ``term``.
In sanitised text base spans are generalised to their kind, terms to theirs where they have one (numbers, capitalised words: so many
documents have some that the kind says nothing), and all other terms are removed (replaced by a mark).

Null and empty texts have no spans. Spans count in code points, the end exclusive. Null and repeated ids stay. Counts are
over all documents and whole texts of the table. Patterns are possessive where nothing can be given back, and start at the head of a
run or the end of the last match, so very long runs take linear time and no stack; many matches in a text take n log n, for
offsets are running sums by doubling steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut

#: The patterns of the base kinds, in their order, as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, for the engine's regular expressions.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: A cheap condition that every text with a valid match of the kind meets.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
ALPHA, MIN_TEXTS = 1.1, 2
SPLIT = r"[^\p{L}\p{N}]++"
#: Stands for a span, so that words which it cuts are no terms.
HIDDEN = "\ue000"
TERM = rf"(?<![\p{{L}}\p{{N}}{HIDDEN}])[\p{{L}}\p{{N}}]++(?!{HIDDEN})"
#: Code points of a piece that a text is cut into before stretches of it are taken.
PIECE = 512


#: The doubling steps of a running result; 2**30 values at most have one.
STEPS = 30


def _running(values: Column, join) -> Column:
    """The running result of ``join`` (a sum, a maximum) over an array of longs, in steps that double the reach."""
    none = F.lit(None).cast("long")

    def step(acc: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2.0), k).cast("int")
        back = F.concat(F.array_repeat(none, reach), F.slice(acc, F.lit(1), F.size(acc) - reach))
        return F.when(reach < F.size(acc), F.zip_with(acc, back, lambda x, y: F.when(y.isNull(), x).otherwise(join(x, y)))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), values, step)


def _sum(x: Column, y: Column) -> Column:
    return x + y


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, pattern: str | Column) -> Column:
    """struct<found, gaps>: all matches, and what stands before, between and after them."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))


def _pieces(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> of all matches of ``pattern`` in ``text``, offsets in code points from 0."""
    def placed(cut: Column) -> Column:
        sizes = F.zip_with(F.slice(cut["gaps"], F.lit(1), F.size(cut["found"])), cut["found"], lambda g, v: (F.char_length(g) + F.char_length(v)).cast("long"))
        return F.zip_with(_running(sizes, _sum), cut["found"], lambda e, v: F.struct((e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return _let(_cut(text, pattern), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")

    def doubled(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 1, F.when(n > 4, n * 2 - 9).otherwise(n * 2)).otherwise(n)

    marks = F.transform(F.filter(digits, lambda d: d != ""), doubled)
    return F.aggregate(marks, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(bare, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.char_length(_digits(value)).between(12, 19) & _luhn(value)
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array<struct<start, end, value>> of the valid matches."""
    empty = F.expr("cast(array() as array<struct<start:long,end:long,value:string>>)")

    def valid(kind: str) -> Column:
        return F.filter(_pieces(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))

    return {k: F.when(text.rlike(HINTS[k]), valid(k)).otherwise(empty) for k in PATTERNS}


def _labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ",")


def _without(kind: str):
    """A function that puts HIDDEN for each span of a kind in a text."""

    def hidden(v: Column) -> Column:
        return F.when(_valid(kind, v), HIDDEN).otherwise(v)

    def joined(cut: Column) -> Column:
        bare = F.concat(F.transform(cut["found"], hidden), F.array(F.lit("")))
        return F.array_join(F.zip_with(cut["gaps"], bare, lambda g, v: F.concat(g, v)), "")

    return lambda text: F.when(text.rlike(HINTS[kind]), _let(_cut(text, PATTERNS[kind]), joined)).otherwise(text)


def _terms(text: Column) -> Column:
    """The distinct words of a text that stand in no span, in lower case. The kinds are taken out one after the other."""
    for kind in PATTERNS:
        text = _let(text, _without(kind))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _apart(base: Column, terms: Column) -> Column:
    """The spans of ``terms`` that touch none of ``base``; both with start, k and end, and those of terms have the greatest k."""
    last = len(KINDS) - 1

    def kept(spans: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: F.when(s["k"] < last, s["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest)
        ahead = _running(F.reverse(F.transform(spans, lambda s: F.when(s["k"] < last, -s["start"]).otherwise(F.lit(-(2**62)).cast("long")))), F.greatest)
        near = F.zip_with(reach, F.reverse(ahead), lambda a, b: F.struct(a.alias("before"), (-b).alias("after")))
        marked = F.zip_with(spans, near, lambda s, n: F.struct(s.alias("s"), ((s["k"] == last) & (n["before"] <= s["start"]) & (n["after"] >= s["end"])).alias("good")))
        return F.transform(F.filter(marked, lambda x: x["good"]), lambda x: x["s"])

    return _let(F.array_sort(F.concat(base, terms)), kept)


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_texts: int = MIN_TEXTS, keep_text: bool = False) -> DataFrame:
    """(row, id, base, terms[, text]) for every row of ``documents``: labelled base spans, and spans of revealing terms.

    One pass over the texts writes the spans, entities and terms; a second counts in how many documents each word stands, and a
    third finds the documents of the revealing terms. ``row`` numbers the rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = rows.withColumns(base_spans(text)).withColumn("all", F.flatten(F.array(*PATTERNS)))
    some = F.size("all") > 0
    none = F.expr("cast(array() as array<string>)")
    base = F.concat(*(_labelled(F.col(k), k) for k in PATTERNS))
    named = F.array_distinct(F.transform("all", lambda s: F.lower(s["value"])))
    table = cut(spans.select(F.monotonically_increasing_id().alias("row"), "id", "text", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), base.alias("base"), F.when(some, F.xxhash64("text")).alias("key"), F.when(some, named).otherwise(none).alias("entities"), F.when(some, _terms(text)).otherwise(none).alias("near")), "spans")
    total = float(table.count())
    every = table.select("row", F.explode(F.array_distinct(F.split(F.lower(F.col("text")), SPLIT))).alias("term"))
    mentions = table.select("row", "key", F.explode("entities").alias("entity"))
    # in two steps, so that an entity in very many texts is spread over them
    entities = mentions.groupBy("entity", "key").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts).select("entity", "n_entity")
    entities = cut(entities, "entities")
    # n_both is at most n_entity, so terms in more documents than this cannot exceed the threshold
    most = F.col("n_entity") * F.pow(F.lit(total) / F.col("n_entity"), F.lit(1 - 1 / alpha)) * 1.000001
    bound = entities.agg(F.max(most)).first()[0] or 0.0
    counted = every.select(F.xxhash64("term").alias("h")).groupBy("h").agg(F.count("*").alias("n_term")).where((F.col("n_term") >= min_texts) & (F.col("n_term") <= bound))
    near = table.select("row", F.explode("near").alias("term")).select("row", F.xxhash64("term").alias("h")).join(counted, "h")
    pairs = mentions.join(entities, "entity").join(near, "row").where(F.col("n_term") <= most)
    joint = pairs.groupBy("entity", "h", "key").agg(F.count("*").alias("n"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    joint = joint.groupBy("entity", "h").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")).where(F.col("texts") >= min_texts)
    information = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col("n_term")))
    telling = cut(joint.where(information >= F.log2(F.lit(total) / F.col("n_entity")) / alpha).select("h").distinct(), "telling")
    words = every.withColumn("h", F.xxhash64("term")).join(telling, "h").groupBy("row").agg(F.collect_set("term").alias("words"))
    # the words have letters and digits alone
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    met = F.filter(_pieces(F.col("text"), pattern), lambda t: F.array_contains(F.col("words"), F.lower(t["value"])))
    general = F.transform(met, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("k"), t["end"].alias("end"), F.when(t["value"].rlike(r"^\p{N}+$"), 1).when(t["value"].rlike(r"^\p{Lu}"), 2).otherwise(0).alias("g")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), F.lit(0).alias("g")))
    empty = F.expr("cast(array() as array<struct<start:long,k:int,end:long,g:int>>)")
    out = table.drop("key", "entities", "near").join(words, "row", "left").withColumn("terms", F.when(F.col("words").isNull(), empty).otherwise(_apart(base, general))).drop("words")
    return out if keep_text else out.drop("text")


def _plain(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))


def report(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_generalised): counts, digest and spans of each row."""
    found = find(documents, id_col, **options)
    general = F.size(F.filter("terms", lambda s: s["g"] > 0)).cast("long").alias("n_generalised")
    return found.select(F.col("id").alias(id_col), *(f"n_{k}" for k in PATTERNS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", _plain("terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"), general)


def _stretch(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` out of its pieces of PIECE code points."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    within = F.substring(at(a), (start - a * PIECE + 1).cast("int"), (end - start).cast("int"))
    whole = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    across = F.concat(F.substring(at(a), (start - a * PIECE + 1).cast("int"), F.lit(PIECE)), whole, F.substring(at(b), F.lit(1), (end - b * PIECE).cast("int")))
    return F.when(end <= start, "").when(a == b, within).otherwise(across)


def sanitise(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, text): base spans generalised to ``[KIND]``, revealing terms to ``[NUMBER]`` or ``[NAME]``, or removed (``[...]``). Null text stays null."""
    found = find(documents, id_col, keep_text=True, **options)
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in PATTERNS), F.lit("[...]"), F.lit("[NUMBER]"), F.lit("[NAME]"))
    text = F.col("text")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), F.lit(0).alias("g")))
    parts = found.withColumn("__s", F.array_sort(F.concat(base, "terms"))).withColumn("__p", F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))
    parts = parts.withColumn("__e", _running(F.transform("__s", lambda s: s["end"]), F.greatest))
    # the end of all spans before each span
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("__e"))
    both = F.zip_with("__s", F.slice(before, F.lit(1), F.size("__s")), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    new = F.transform(both, lambda x: F.when(x["s"]["start"] >= x["e"], F.concat(_stretch(F.col("__p"), x["e"], x["s"]["start"]), F.element_at(marks, x["s"]["k"] + x["s"]["g"] + 1))).otherwise(""))
    tail = _stretch(F.col("__p"), F.element_at(before, -1), F.char_length(text).cast("long"))
    clean = F.concat(F.array_join(new, ""), tail)
    return parts.select(F.col("id").alias(id_col), F.when(text.isNull(), None).when(F.size("__s") == 0, text).otherwise(clean).alias("text"))
