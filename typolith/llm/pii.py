"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

1. Direct identifiers (email, ip, card, phone) are found in whole texts; each distinct value is a protected entity.
2. Words outside direct identifiers give document frequencies, and co-occurrence counts with every entity that the same
   document names. Both count whole documents, copies included; a word is a run of letters of any length.
3. A word discloses an entity when it predicts the entity (co-occurrence / document frequency) and carries enough pointwise
   mutual information; an entity named in a single document can be disclosed too. Every
   occurrence of such words, in any document, becomes a span of kind `term`: removed when they predict an entity almost
   surely, generalised otherwise.

The pattern of each kind matches the same leftmost, non-overlapping strings as its plain form; possessive
quantifiers and lookbehinds only spare backtracking, so long runs take linear time; places of n matches take n * sqrt(n) small steps.

Edge cases: a null text is empty; empty texts have no spans; equal spans of repeated rows count once per row; rows with one
id and different texts are kept apart by a hash of the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Kind, linear form of its pattern, a character that any match holds.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+", None),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
)
#: A run of letters with their marks.
WORD = r"\p{L}[\p{L}\p{M}]*+"
#: The rows of 64 bits that a filter before a join is sent as, and the most rows of a table that is sent whole.
BIT_WORDS, FEW = 1 << 20, 1 << 20
MIN_PREDICTION, SURE, MIN_BITS = 0.5, 0.9, 4.0
_SPAN = "array<struct<start:int,end:int,value:string>>"
_TERMS = "array<struct<start:int,end:int,sure:boolean>>"


def running(lengths: Column) -> Column:
    """Running sums of an array of integers.

    Appending to an array copies it, so sums are built in about sqrt(n) blocks of sqrt(n) values.
    """

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))

    def whole(values: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(values))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(values), block)
        blocks = F.transform(firsts, lambda i: sums(F.slice(values, i, block)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        moved = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(x["out"], lambda v: v + acc["at"]))).alias("out"))
        return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.aggregate(blocks, start, moved, lambda acc: acc["out"])))

    return F.transform(F.array(lengths), whole)[0]


def _parts(text: Column, pattern: str) -> Column:
    """Every match with what stands between it and the match before: (gap, value)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.array(hits), lambda h: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)), h, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))))[0]


def located(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches in code points, left to right."""

    def placed(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: F.length(x["gap"]) + F.length(x["value"])))
        return F.zip_with(parts, ends, lambda x, e: F.struct((e - F.length(x["value"])).alias("start"), e.alias("end"), x["value"].alias("value")))

    return F.transform(F.array(_parts(text, pattern)), placed)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    parts = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(parts, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans_of(text: Column, kind: str, pattern: str, needs: str | None) -> Column:
    spans = F.filter(located(text, pattern), lambda s: _valid(kind, s["value"]))
    if needs:
        spans = F.when(F.contains(text, F.lit(needs)), spans).otherwise(F.array().cast(_SPAN))
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def direct_spans(text: Column) -> Column:
    """All base spans: (kind, start, end, value) by kind as listed, then start."""
    return F.concat(*[_spans_of(text, *kind) for kind in KINDS])


def masked(text: Column) -> Column:
    """The text with a zero for every character of an email, so that places in it stay. Other direct identifiers hold no letter."""
    _, pattern, needs = KINDS[0]
    kept = F.array_join(F.transform(_parts(text, pattern), lambda x: F.concat(x["gap"], F.repeat(F.lit("0"), F.length(x["value"])))), "")
    return F.when(F.contains(text, F.lit(needs)), F.concat(kept, F.element_at(F.split(text, pattern, -1), -1))).otherwise(text)


def terms_of(text: Column) -> Column:
    """The distinct lower-case words of a text outside emails."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(masked(text), F.lit(WORD), F.lit(0))), F.lower))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans, terms): direct spans, and in texts that have any their words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the lambda's variable and the generator keep the spans from being found once for each use
    both = F.transform(F.array(direct_spans(F.col("text"))), lambda s: F.struct(s.alias("spans"), F.when(F.size(s) > 0, terms_of(F.col("text"))).alias("terms")))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(both))


def _place(key: Column) -> tuple[Column, Column]:
    """A word of a bitmap of 64 * BIT_WORDS bits, and a bit of that word."""
    bit = F.pmod(F.xxhash64(key), F.lit(64 * BIT_WORDS))
    return F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")


def _thinned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of left whose key may be in right, by a broadcast bitmap of at most BIT_WORDS rows; a join still decides."""
    word, bit = _place(F.col(key))
    bits = right.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    kept = left.join(F.broadcast(bits), (word == F.col("_word")) & (F.expr("shiftright(_bits, CAST(pmod(pmod(xxhash64(" + key + "), " + str(64 * BIT_WORDS) + "), 64) AS INT)) & 1") == 1))
    return kept.select(*left.columns)


def disclosing_terms(docs: DataFrame, base: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, prediction, bits): words over the disclosure thresholds for an entity, counted over whole documents."""
    n_docs = max(base.count(), 1)
    # as strings, which Spark tells apart by hash; structs it compares one with another
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))
    named = base.filter(F.size("spans") > 0).select("terms", F.explode(entities).alias("entity"))
    counts = named.groupBy("entity").agg(F.count(F.lit(1)).alias("ce"))
    both = named.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("cte"))
    frequencies = docs.select(F.explode(terms_of(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    likely = both.join(frequencies, "term").withColumn("prediction", F.col("cte") / F.col("df")).filter(F.col("prediction") >= MIN_PREDICTION)
    bits = F.log2(F.col("cte") * F.lit(float(n_docs)) / (F.col("df") * F.col("ce")))
    return likely.join(counts, "entity").select("entity", "term", "prediction", bits.alias("bits")).filter(F.col("bits") >= MIN_BITS)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, added) for every row: direct spans, and every word that discloses an entity of any document."""
    base = materialise(identified(docs), "pii")
    guilty = materialise(disclosing_terms(docs, base).groupBy("term").agg((F.max("prediction") >= SURE).alias("sure")), "pii-guilty")
    sent = F.broadcast(guilty) if guilty.count() <= FEW else guilty
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(located(masked(F.col("text")), WORD)))
    words = words.select("doc_id", "text_hash", "start", "end", F.lower("value").alias("term"))
    # equal places of repeated rows are one
    added = _thinned(words, guilty, "term").join(sent, "term").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    added = added.agg(F.sort_array(F.collect_set(F.struct("start", "end", "sure"))).alias("added"))
    out = base.select("doc_id", "text_hash", "spans").join(added, base["doc_id"].eqNullSafe(F.col("_id")) & (base["text_hash"] == F.col("_hash")), "left")
    return out.select("doc_id", "text_hash", F.col("spans").alias("base"), F.coalesce("added", F.array().cast(_TERMS)).alias("added"))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): identifiers become their kind in brackets; sure terms go, others become [TERM]."""
    found = find(docs).select("doc_id", "text_hash", "base", "added").dropDuplicates(["doc_id", "text_hash"])
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_hash")))
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["sure"], "").otherwise("[TERM]").alias("put"))),
    )
    # marks that begin inside the one before are covered by it; what is left is cut at the marks, which are in order
    def open_marks(ordered: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,put:string>>").alias("out"))
        kept = lambda acc, m: F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(m["start"] >= acc["at"], F.concat(acc["out"], F.array(m))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(ordered, start, kept, lambda acc: acc["out"])

    def written(kept: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(kept, i - 1)["end"])
        pieces = F.transform(kept, lambda m, i: F.concat(F.substring(F.col("text"), before(i) + 1, m["start"] - before(i)), m["put"]))
        last = F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), last + 1, F.lit(1 << 30)))

    body = F.transform(F.array(open_marks(F.sort_array(marks))), written)[0]
    return joined.select("doc_id", body.alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    added = F.transform("added", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    return found.select(
        "doc_id",
        *[count(kind) for kind, _, _ in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"),
        F.size("added").cast("long").alias("n_term"),
    )
