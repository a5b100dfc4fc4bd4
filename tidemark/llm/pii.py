"""Personal data in text: exact base patterns, and further spans chosen by boosted trees over candidate features.

Base spans (leftmost, non-overlapping per kind): e-mail addresses, dotted quads with parts up to 255, card numbers of 16
to 19 digits that pass Luhn, and phone numbers with a plus and 8 to 15 digits. They always stay.

Candidates: generators of high recall propose spans that may overlap: spelled-out addresses, digit groups in phone or
card shape, bracketed or hexadecimal network addresses, and long mixed tokens. Candidates and base spans that overlap
form an island. Each candidate has format and context features on small fixed scales; a combination of their values
is a pattern. Counts by pattern, over all documents, are the training rows, so they number at most as many as the scales
allow, whatever the corpus.

Weak labels say which candidates to learn from. Positive: those that share an island with a base span of their own kind;
those whose canonical form (brackets and "at" or "dot" undone, bare digits) is valid and that follow a word for their kind
or leave no other reading (both signs of an address spelled out or bracketed, octets up to 255, 8 hexadecimal groups or 6
pairs with a letter, Luhn on 16 digits or more); and tokens assigned to a name such as "token" or "password" (those words
are no feature of tokens). Negative: those whose canonical form fails, that lie in a base span of another kind, that
follow a word such as "order" or "version", prose such as "look at example.com", and tokens that are words joined by
hyphens or parts of a path. All others are unlabelled: left out of training and calibration, but scored.

Gradient-boosted trees are fitted on labelled candidates of documents of one hash half. On the other half, each kind's
threshold is the least score at which the labelled candidates above it are positive with at least ``precision``. Negatives are never added, so those whose form fails only stand for
look-alikes that pass by chance, as one random run of digits in ten passes Luhn: nine of them count as one there, and as
two in training, on the strict side. Of an island without a base span, the candidate of best score above its threshold is
added.

All of it is DataFrame operations: matches and gaps of a pattern alternate, so a running sum of their lengths gives
positions in code points (a doubling scan, n log n). Patterns use possessive runs, so long runs cost linear time.

Null text is empty. Rows that agree in doc_id and text share their spans, null ids included. Without a positive in both
halves only base spans are returned; without a negative every score is 1. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import base

KINDS = ["email", "ip", "card", "phone", "secret"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: A spelled-out "at" with a name behind it that goes on after a dot.
_AT = r"[(\[ ]at[)\] ] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]| ?[(\[]dot[)\]]| dot )"

#: Generators: kind, pattern, and a cheap test that must hold for the pattern to match at all.
GENERATORS: list[tuple[int, str, Callable[[Column], Column]]] = [
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?@ ?| ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]++)++", lambda t: t.contains("@") | t.rlike(_AT)),
    (1, r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}(?:\[\.\]|\.)){3}[0-9]{1,3}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9](?:\[\.\]|\.)[0-9]")),
    (1, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", lambda t: t.rlike(r":[0-9A-Fa-f]{1,4}:")),
    (2, r"(?<![0-9A-Za-z])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9](?:[ ./-]{0,2}[0-9]){12}")),
    (3, r"(?<![0-9A-Za-z])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9]\)?[ .-]{1,2}[0-9]{3}")),
    (4, r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+", lambda t: t.rlike(r"[A-Za-z0-9_-]{16}")),
]
SECRET_NAMES = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\"' ]*[=:][\"' ]*$"
#: Words before a candidate that name its kind, in the order of ``KINDS``; then words that name something else.
_FILLER = r"(?:\W+(?:no|nr|number|is|me|us|at|on|to|under))*(?:\W*\+[0-9]{1,3})?\W*$"
CUES = [
    r"(?i)\b(?:mail|contact|write)" + _FILLER,
    r"(?i)\b(?:host|server|addr(?:ess)?|ip|ipv[46]|mac)" + _FILLER,
    r"(?i)\b(?:card|visa|mastercard|iban|account)" + _FILLER,
    r"(?i)\b(?:(?:tele)?phone|tel|call|fax|mobile)" + _FILLER,
]
OTHER_CUE = r"(?i)\b(?:order|invoice|isbn|serial|version|part|sku|ticket|tracking|article|build)" + _FILLER
_TOP_LEVEL = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ch|nl|pl|ca|au|jp|br|in|co|dev|app|biz|example|test|invalid)$"
_WORDS = r"(?:^|[_-])[A-Za-z]?[a-z]{3,}[_-](?:.*[_-])?[A-Za-z]?[a-z]{3,}(?:[_-]|$)"
FEATURES = ["kind", "size", "digits", "capitals", "separators", "before", "after", "variety", "cue", "form"]
_SCAN_ROUNDS = 26


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sum(numbers: Column) -> Column:
    """Inclusive sums of an array of ints, by doubling steps."""

    def step(power: int) -> Callable[[Column], Column]:
        def add(a: Column) -> Column:
            zeros = F.array_repeat(F.lit(0), F.least(F.size(a), F.lit(power)))
            moved = F.concat(zeros, F.slice(a, 1, F.greatest(F.size(a) - power, F.lit(0))))
            return F.when(F.size(a) > power, F.zip_with(a, moved, lambda x, y: x + y)).otherwise(a)

        return add

    return reduce(lambda out, k: let(out, step(1 << k)), range(_SCAN_ROUNDS), numbers)


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """All matches of a pattern: array of (start, end, value, before, after), places in code points.

    ``before`` holds up to 24 characters before the match, ``after`` the first two of the gap behind it.
    """

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def build(g: Column) -> Column:
            lengths = F.zip_with(F.slice(g, 1, F.size(found)), found, lambda a, b: F.char_length(a) + F.char_length(b))
            earlier = F.transform(F.concat(F.array(F.lit("")), F.slice(found, 1, F.size(found) - 1)), lambda v: F.right(v, F.lit(24)))
            befores = F.zip_with(earlier, F.slice(g, 1, F.size(found)), lambda v, a: F.right(F.concat(v, F.right(a, F.lit(24))), F.lit(24)))
            sides = F.zip_with(befores, F.slice(g, 2, F.size(found)), lambda a, b: F.struct(a.alias("before"), F.left(b, F.lit(2)).alias("after")))
            spans = F.zip_with(found, running_sum(lengths), lambda v, e: F.struct((e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))
            return F.zip_with(spans, sides, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after")))

        return F.when(F.size(found) > 0, let(gaps, build)).otherwise(none)

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(gate, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def _on_value(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: test(s["value"])


def _of_kind(kind: int, *fields: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[f].alias(f) for f in fields])


def of_kind(kind: int) -> Callable[[Column], Column]:
    """A test for spans of one kind."""
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end) of the base patterns, by kind as listed, then start."""

    def digits(v: Column) -> Column:
        return F.regexp_replace(v, "[^0-9]", "")

    def card(v: Column) -> Column:
        return let(digits(v), lambda d: F.char_length(d).between(16, 19) & F.call_function("luhn_check", d))

    tests = [
        (EMAIL, text.contains("@"), None),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        (CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), card),
        (PHONE, text.contains("+"), lambda v: F.char_length(digits(v)).between(8, 15)),
    ]
    found = []
    for kind, (pattern, gate, test) in enumerate(tests):
        spans = matches(text, pattern, gate)
        if test is not None:
            spans = F.filter(spans, _on_value(test))
        found.append(F.transform(spans, _of_kind(kind, "start", "end")))
    return F.concat(*found)


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, value, before, after) that the generators propose."""
    found = []
    for kind, pattern, gate in GENERATORS:
        spans = matches(text, pattern, gate(text))
        found.append(F.transform(spans, _of_kind(kind, "start", "end", "value", "before", "after")))
    return F.concat(*found)


def _valid(kind: Column, value: Column, before: Column, after: Column, cued: Column) -> Column:
    """Whether the canonical form of a candidate can be of its kind."""
    bare, digits = F.regexp_replace(value, r"[\[\]]", ""), F.regexp_replace(value, "[^0-9]", "")
    undone = F.regexp_replace(F.regexp_replace(value, r" ?[(\[]at[)\]] ?| at | ?@ ?", "@"), r" ?[(\[]dot[)\]] ?| dot ", ".")
    address = undone.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++$") & undone.rlike(r"\.[A-Za-z]{2,24}$") & ~undone.rlike(r"^\.|\.\.|\.@|@[.-]|@[^@]*(?:-\.|\.-)")
    address &= ~value.contains(" dot ") | undone.rlike(_TOP_LEVEL) | cued
    network = bare.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$") | value.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$")
    beside = after.rlike("^ [0-9]") | before.rlike(r"[0-9]{4,}[ ./-]{1,2}$|[0-9][ ./-]{1,2}[0-9]+[ ./-]{1,2}$")
    grouped = value.rlike(r"^[0-9]{2,3}([ .])[0-9]{3}\1[0-9]{3}$|^(?:(?:19|20)[0-9]{2}[ .-]{0,2}){3}$")
    phone = F.char_length(digits).between(8, 15) & ~after.rlike("^[./-][0-9]") & (cued | (~grouped & (value.startswith("(") | ~beside)))
    card = F.char_length(digits).between(13, 19) & ~after.rlike(r"^[ ./-]?[0-9]") & F.call_function("luhn_check", digits)
    return F.when(kind == 0, address).when(kind == 1, network).when(kind == 2, card).when(kind == 3, phone).otherwise(True)


def _with_features(spans: DataFrame) -> DataFrame:
    """The pattern of each candidate, small whole numbers in ``FEATURES``, and its weak ``label``: 1, 0 or null."""
    kind, value, before, after = F.col("kind"), F.col("value"), F.col("before"), F.col("after")
    n = F.greatest(F.char_length(value), F.lit(1))
    count = lambda pattern: F.char_length(F.regexp_replace(value, pattern, ""))
    kinds = lambda pattern: value.rlike(pattern).cast("int")
    own = reduce(lambda out, k: out.when(kind == k, before.rlike(CUES[k])), range(1, 4), F.when(kind == 0, before.rlike(CUES[0]))).otherwise(False)
    other = (kind != 4) & before.rlike(OTHER_CUE)
    wrong = kind.isin(2, 3) & ~own & reduce(lambda out, c: out | before.rlike(c), CUES[1:], F.lit(False))
    halfway = ~value.rlike(r"[@(\[]") & ~value.rlike(" dot ")
    plain = value.rlike("^[A-Za-z]+ ")
    email = F.when(value.contains("@"), 0).when(value.rlike(r"[(\[]"), 1).when(~halfway, 2).when(~plain | own, 3).otherwise(4)
    network = F.when(value.contains("["), 1).when(value.contains(":") & value.rlike("[A-Fa-f]"), 2).when(value.contains(":"), 3).otherwise(0)
    form = F.when(kind == 0, email).when(kind == 1, network).when(kind == 3, kinds(r"[(]") + 2 * kinds(r"^[0-9]{2,3}([ .])[0-9]{3}\1[0-9]{3}$")).when(kind == 4, kinds(_WORDS)).otherwise(0)
    spans = spans.withColumns({"own": own, "form": form, "valid": _valid(kind, value, before, after, own)}).withColumns({
        "size": F.least(F.floor(n / 4), F.lit(16)).cast("int"),
        "digits": F.floor(4 * count("[^0-9]") / n).cast("int"),
        "capitals": F.floor(2 * count("[^A-Z]") / n).cast("int"),
        "separators": kinds(" ") + 2 * kinds(r"[./-]") + 4 * kinds(r"[@(\[:]"),
        "before": F.when(before.rlike(r"[=:][\"' ]*$"), 1).when(before.rlike(r"[\"']$"), 2).when(before.rlike(r"[(+#]\s*$"), 3).when(before.rlike(r"[A-Za-z0-9]$"), 4).when(before.rlike(r"[/\\.]$"), 5).otherwise(0),
        "after": F.when(after.rlike(r"^[\"']"), 1).when(after.rlike(r"^[A-Za-z0-9]"), 2).when(after.rlike(r"^[.,;:!?)]"), 3).otherwise(0),
        "variety": F.least(F.floor(F.size(F.array_distinct(F.split(value, ""))) / 4), F.lit(5)).cast("int"),
        "cue": F.when(F.col("own"), 1).when(other, 2).when(wrong, 3).otherwise(0),
        "clear": F.when(kind == 0, F.col("form") < 4).when(kind == 1, F.col("form").isin(1, 2)).when(kind == 2, count("[^0-9]") >= 16).otherwise(False),
        "named": (kind == 4) & before.rlike(SECRET_NAMES),
        "apart": F.when(kind == 0, F.col("form") == 4).when(kind == 4, (F.col("form") == 1) | before.rlike(r"[/\\.]$")).otherwise(False),
    })
    good = F.col("of_kind") | F.col("named") | (F.col("valid") & ~F.col("covered") & (F.col("own") | (F.col("clear") & (F.col("cue") == 0))))
    bad = F.col("covered") | ~F.col("valid") | (F.col("cue") >= 2) | F.col("apart")
    return spans.withColumn("label", F.when(good, 1).when(bad, 0))


def _spans(found: DataFrame) -> DataFrame:
    """One row for each candidate, each once, with its island and whether that holds a base span, and one of its kind."""
    of_base = found.select("doc_id", "key", F.explode("base").alias("s")).select("doc_id", "key", "s.*").withColumns({"is_base": F.lit(True), "value": F.lit(""), "before": F.lit(""), "after": F.lit("")})
    proposed = found.select("doc_id", "key", F.explode("proposed").alias("s")).select("doc_id", "key", "s.*").withColumn("is_base", F.lit(False))
    spans = of_base.unionByName(proposed).distinct()
    row = Window.partitionBy("doc_id", "key").orderBy("start", "end", "kind", "is_base")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("island", F.sum("opens").over(row))
    island = Window.partitionBy("doc_id", "key", "island")
    spans = spans.withColumns({"covered": F.max("is_base").over(island), "of_kind": F.max("is_base").over(Window.partitionBy("doc_id", "key", "island", "kind"))})
    return _with_features(spans.where(~F.col("is_base"))).select("doc_id", "key", "island", "covered", "start", "end", "valid", "label", *FEATURES)


def _scores(spans: DataFrame, precision: float, trees: int, depth: int) -> DataFrame | None:
    """(pattern, score) above the threshold of each kind; None where nothing can be learned."""
    half = F.pmod(F.xxhash64("doc_id", "key"), F.lit(2))
    label = F.col("label")
    weights = [F.when((label == 0) & ~F.col("valid"), w).otherwise(9) for w in (2, 1)]  # in ninths, by half
    counts = [F.sum(F.when((half == h) & (label == y), weights[h]).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]
    patterns = base.stage(spans.groupBy(*FEATURES).agg(*counts), "patterns")
    seen = patterns.agg(F.sum("n00"), F.sum("n01")).first()
    if not seen[1]:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(patterns)
    rows = assembled.select("features", F.explode(F.array(*[F.struct(F.lit(float(y)).alias("label"), (F.col(f"n0{y}") / 9).alias("weight")) for y in (0, 1)])).alias("r")).select("features", "r.*").where("weight > 0")
    if seen[0]:
        model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, cacheNodeIds=False).fit(rows.coalesce(1))
        scored = model.transform(assembled).select(*FEATURES, "n10", "n11", vector_to_array("probability")[1].alias("score"))
    else:
        scored = patterns.select(*FEATURES, "n10", "n11", F.lit(1.0).alias("score"))
    down = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = scored.withColumns({"above": F.sum(F.col("n10") + F.col("n11")).over(down), "hits": F.sum("n11").over(down)})
    limits = held.where(F.col("hits") > 0).where(F.col("hits") >= precision * F.col("above")).groupBy("kind").agg(F.greatest(F.min("score"), F.lit(0.5)).alias("limit"))
    return base.stage(scored.join(limits, "kind").where("score >= limit").select(*FEATURES, "score"), "pattern-scores")


def find_personal_data(docs: DataFrame, precision: float = 0.9, trees: int = 12, depth: int = 4) -> DataFrame:
    """(doc_id, key, base, added): arrays of (kind, start, end) for each row; kinds number ``KINDS``.

    ``base`` and ``added`` do not overlap each other; spans of different base kinds may.
    """
    rows = base.pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    found = base.stage(rows.select("doc_id", base.text_key(F.col("text")).alias("key"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("proposed")), "spans")
    spans = base.stage(_spans(found), "candidates")
    scores = _scores(spans, precision, trees, depth)
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if scores is None:
        return found.select("doc_id", "key", "base", none.alias("added"))
    best = Window.partitionBy("doc_id", "key", "island").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    chosen = spans.where(~F.col("covered") & F.coalesce(F.col("label") == 1, F.lit(True))).join(scores, FEATURES).withColumn("place", F.row_number().over(best)).where("place = 1")
    added = chosen.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    a, b = found.alias("a"), added.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return joined.select("a.doc_id", "a.key", "a.base", F.coalesce("b.added", none).alias("added"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans count as the first of them."""
    names = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.when(s["start"] >= state["at"], F.struct(piece.alias("out"), s["end"].alias("at"))).otherwise(state)

    ordered = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]))
    return F.aggregate(ordered, start, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))


def joined_names(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
