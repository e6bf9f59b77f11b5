"""Operator 1: information-theoretic sanitisation of personal data, SQL functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by pattern
and check.  Each distinct value is a protected entity.  Over the corpus, a term t (a word
of letters within ``NEAR`` words of an entity c) reveals c by its pointwise mutual
information, log2(N n(c,t) / (n(c) n(t))), out of the entity's information, log2(N / n(c)).
With n(c,t) of ``SUPPORT`` documents or more, a term whose share is at least ``REMOVE``
is removed, at least ``GENERALISE`` generalised, wherever it is a word of a document that
holds the entity.  Base spans are always generalised to their kind.

N and n(t) count all documents, n(c,t) the documents with t near c.  Null texts count as
empty.  Repeated rows and null ids each give a row; documents that agree in id and text
count once for n(c) and n(c,t).  Only doc_id and text are read; ``sanitised`` keeps other
columns.  Patterns use possessive repeats, so a text costs time in proportion to its
length, but for entities with fewer than ``NEAR`` words in the last of ``CONTEXTS``, each of
which reads the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, same, text_key

KINDS = ["email", "ip", "card", "phone"]
# A match may start where the last one ended or where no character of its first run
# stands before; both rule out only starts that can't give a leftmost match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"(?<!\p{L})\p{L}{3,}+"
NEAR = 5
# Code points on each side of an entity in which its NEAR words are looked for first; the
# rest of the text is read only where these hold fewer whole ones.
CONTEXTS = (160, 4096)
SUPPORT, GENERALISE, REMOVE = 3, 0.6, 0.8

KEY = ["doc_id", "h1", "h2"]


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["m"])


def _located(text: Column, pattern: Column, kind: int, n: int = -1) -> Column:
    """Array of (s, k, e, m): code points of each match, kind number, match.

    The parts between matches and the matches alternate, so sums of their lengths
    are the offsets.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, text (null as empty), base: the checked spans by start, then kind."""
    docs = docs.select("doc_id", *text_key(), F.coalesce("text", F.lit("")).alias("text"))
    t, none = F.col("text"), F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    for i, kind in enumerate(KINDS):
        may = F.contains(t, F.lit(MARK[kind])) if MARK[kind] else t.rlike("[0-9]")
        docs = docs.withColumn(kind, F.when(may & t.rlike(PATTERNS[kind]), _located(t, F.lit(PATTERNS[kind]), i)).otherwise(none))
    for kind in KINDS:
        docs = docs.withColumn(kind, F.filter(kind, _check(kind)))
    return docs.select(*KEY, "text", F.array_sort(F.concat(*KINDS)).alias("base"))


def disclosures(found: DataFrame, docs: DataFrame) -> DataFrame:
    """k, m (an entity), term, share (of its information that the term reveals)."""
    spans = found.where(F.size("base") > 0).select(*KEY, "text", F.explode("base").alias("x")).select(*KEY, "text", "x.*")

    def words(t: Column) -> Column:
        return F.regexp_extract_all(F.lower(t), F.lit(TERM), F.lit(0))

    text, length = F.col("text"), F.length("text")
    before, after = F.slice(F.reverse(words(F.substring(text, F.lit(1), F.col("s")))), 1, NEAR), F.slice(words(F.substring(text, F.col("e") + 1, length)), 1, NEAR)
    for size in reversed(CONTEXTS):  # a run of letters at the edge may be a part of a word
        left = F.regexp_replace(F.substring(text, F.col("s") - size + 1, F.lit(size)), r"^\p{L}++", "")
        right = F.regexp_replace(F.substring(text, F.col("e") + 1, F.lit(size)), r"(?<!\p{L})\p{L}++$", "")
        near_left, near_right = F.slice(F.reverse(words(left)), 1, NEAR), F.slice(words(right), 1, NEAR)
        before = F.when((F.col("s") > size) & (F.size(near_left) == NEAR), near_left).otherwise(before)
        after = F.when((length - F.col("e") > size) & (F.size(near_right) == NEAR), near_right).otherwise(after)
    entity = [F.col("k"), F.lower("m").alias("c")]
    near = spans.select(*KEY, *entity, F.concat(before, after).alias("near"))
    near = materialise(near, "pii_near")
    n_c = near.select(*KEY, "k", "c").distinct().groupBy("k", "c").agg(F.count("*").alias("n_c"))
    n_ct = (near.select(*KEY, "k", "c", F.explode("near").alias("term")).distinct()
            .groupBy("k", "c", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= SUPPORT))
    n_ct = materialise(n_ct, "pii_pairs")
    n_t = (docs.select(F.explode(F.array_distinct(words(F.coalesce("text", F.lit(""))))).alias("term"))
           .groupBy("term").agg(F.count("*").alias("n_t")))
    n = F.lit(docs.count())
    known = F.log2(n / F.col("n_c"))
    pmi = F.log2(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    return (n_ct.join(n_t, "term").join(n_c, ["k", "c"])
            .select("k", "c", "term", (pmi / known).alias("share")).where(F.col("share") >= GENERALISE))


def sanitise(docs: DataFrame) -> DataFrame:
    """One row per document row: key, text (null without base spans), base, terms, spans.

    ``terms`` are the revealing words' spans (s, k, e, m; k is len(KINDS) for removed ones,
    one more for generalised ones), ``spans`` all spans by start, then kind.
    """
    found = materialise(base_spans(docs).select(*KEY, F.when(F.size("base") > 0, F.col("text")).alias("text"), "base"), "pii_base")
    strong = materialise(disclosures(found, docs), "pii_strong")
    entities = found.where(F.size("base") > 0).select(*KEY, F.explode("base").alias("x")).select(*KEY, F.col("x.k").alias("k"), F.lower("x.m").alias("c")).distinct()
    words = entities.join(strong, ["k", "c"]).groupBy(*KEY, "term").agg(F.max("share").alias("share"))
    # terms are letters only, so they need no quoting in a pattern
    listed = words.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("words"),
                                     F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone"))
    holds = found.where(F.size("base") > 0)
    with_terms = holds.join(listed, same(holds, listed, KEY), "left").select(*[holds[c] for c in holds.columns], "words", "gone")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("words"), F.lit(r")(?!\p{L})"))
    raw = F.when(F.col("words").isNotNull(), _located(F.col("text"), pattern, len(KINDS))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string>>"))
    apart = F.filter(raw, lambda x: ~F.exists("base", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    named = F.transform(apart, lambda x: F.struct(
        x["s"].alias("s"), F.when(F.array_contains("gone", F.lower(x["m"])), x["k"]).otherwise(x["k"] + 1).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
    done = with_terms.withColumn("terms", named).drop("words", "gone")
    rest = found.where(F.size("base") == 0).withColumn("terms", F.array().cast("array<struct<s:int,k:int,e:int,m:string>>"))
    return done.unionByName(rest).withColumn("spans", F.array_sort(F.concat("base", "terms")))


def count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def printed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in [*KINDS, "removed_term", "term"]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def cleaned(text: Column, spans: Column) -> Column:
    """The text with each span replaced: base spans and generalised terms by their kind in
    brackets, removed terms by nothing; of overlapping spans the first stands for all."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""), F.lit("[TERM]"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        add = F.when(x["s"] >= acc["at"], F.array(gap, F.get(labels, x["k"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with personal data and revealing terms replaced."""
    got = sanitise(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(
        *[F.col(c).alias(f"__{c}") for c in KEY], F.col("spans").alias("__spans")).dropDuplicates([f"__{c}" for c in KEY])
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(text_key(), ("__k1", "__k2"), strict=True)])
    cond = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__k1") == F.col("__h1")) & (F.col("__k2") == F.col("__h2"))
    joined = keyed.join(got, cond, "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cleaned(F.col("text"), F.col("__spans")))).select(*docs.columns)
