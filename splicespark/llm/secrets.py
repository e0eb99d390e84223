"""Secret scans: patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, narrowed, text_of

# The patterns of the base.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are taken whole, so a shorter one holds no longer match
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

# Character classes: a pattern that the whole candidate matches, its window, and the bits a character that count as random.
CLASSES = {"hex": (r"[0-9A-Fa-f]+", 32, 3.2), "base64": (r"[A-Za-z0-9+/_=-]+", 24, 3.9)}
# A candidate that one of these matches is no secret: words joined by - or _, paths, one case of letters only, runs of one sign.
ALLOWED = (r"[A-Z]?[a-z]+([-_/][A-Z]?[a-z]+)*", r"[A-Za-z]+", r"[0-9]+", r"[=_/+-]+.{0,8}", r"(?i)[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", r"(?i).*(example|sample|dummy|placeholder).*")


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches, leftmost first, as structs start, end (code points, end exclusive) and value (the group).

    The gaps between matches and the matches alternate, so the places are running sums of their lengths.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    found = F.aggregate(F.filter(parts, lambda x: x["hit"].isNotNull()), start, step, lambda a: a["spans"])
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def most_entropy(value: Column, window: int) -> Column:
    """The greatest Shannon entropy, in bits a character, of any `window` characters in a row (of all, if fewer).

    Counts are kept in a map from character to count. As the window moves, the sum of c log c changes by the terms of the
    character that enters and the one that leaves only.
    """
    term = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    counts = "map<string,int>"

    def changed(a: Column, sign: Column, by: int) -> Column:
        """a with the count of a character changed."""
        old = F.coalesce(F.try_element_at(a["counts"], sign), F.lit(0))
        rest = F.map_filter(a["counts"], lambda k, _: k != sign)
        return F.struct(F.map_concat(rest, F.create_map(sign, old + by)).alias("counts"), (a["s"] + term(old + by) - term(old)).alias("s"), a["n"].alias("n"), a["best"].alias("best"))

    def run(signs: Column) -> Column:
        n = F.least(F.size(signs), F.lit(window)).cast("double")
        start = F.struct(F.create_map().cast(counts).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

        def step(a: Column, sign: Column) -> Column:
            grown = changed(a, sign, 1)
            moved = let(grown, lambda b: F.when(b["n"] >= window, changed(b, F.get(signs, b["n"] - window), -1)).otherwise(b))
            bits = lambda b: F.log2(n) - b["s"] / n
            return let(moved, lambda b: F.struct(b["counts"].alias("counts"), b["s"].alias("s"), (b["n"] + 1).alias("n"), F.when(b["n"] + 1 >= n, F.greatest(b["best"], bits(b))).otherwise(b["best"]).alias("best")))

        return F.aggregate(signs, start, step, lambda a: a["best"])

    return let(F.split(value, ""), run)


def entropy_spans(text: Column) -> Column:
    """Spans of random-looking candidates, by class: kind `entropy_<class>`, the first class that fits."""
    allowed = lambda v: F.lit(False) if not ALLOWED else v.rlike("|".join(f"(?:^(?:{x})$)" for x in ALLOWED))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    candidates = F.filter(spans_of(text, CANDIDATE), lambda x: mixed(x["value"]) & ~allowed(x["value"]))

    def kind(x: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for name, (whole, window, bits) in reversed(CLASSES.items()):
            chosen = F.when(x["value"].rlike(f"^(?:{whole})$"), F.when(most_entropy(x["value"], window) >= bits, F.lit(f"entropy_{name}"))).otherwise(chosen)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), chosen.alias("kind"))

    return F.filter(F.transform(candidates, kind), lambda x: x["kind"].isNotNull())


def scan(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Secrets of each document: doc_id and the arrays base and found of structs start, end, rank, kind, in order.

    `base` are the pattern matches: assignments whose value has 6 characters or more, access keys, long hex runs. `found`
    adds the candidates whose entropy in some window reaches the bound of their character class and that no allow-list
    pattern matches; base spans always stay, and an added span that a base span covers is left out. Null texts have no
    secrets. Null and repeated doc_ids are documents of their own; other columns are ignored,
    unless `whole` asks for the row of docs in the struct `row`.
    """
    text = F.col("_text")
    kinds = ("assign", "access", "hex")
    named = lambda spans, k: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kinds.index(k)).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind")))
    assigned = F.filter(spans_of(text, ASSIGN, 1), lambda x: F.length(x["value"]) >= 6)
    base = F.array_sort(F.concat(named(assigned, "assign"), named(spans_of(text, ACCESS), "access"), named(spans_of(text, HEX), "hex")))
    names = ["doc_id", "row"] if whole else ["doc_id"]
    rows = narrowed(docs, "doc_id", "text", whole=whole).select(*names, text_of().alias("_text")).select(*names, base.alias("base"), entropy_spans(text).alias("_added"))
    uncovered = F.filter("_added", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))
    added = F.transform(uncovered, lambda x: F.struct(x["start"].alias("start"), F.lit(len(kinds)).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return rows.withColumn("found", F.array_sort(F.concat("base", added))).drop("_added")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked_documents(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with each secret of their texts replaced by the mask; overlapping secrets by one mask. Null texts stay
    null, empty ones empty; long texts are scanned whole; repeated rows and doc_ids stay as they are, and so does an empty
    table."""
    found = scan(docs, whole=True)
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.when(x["start"] < a["at"], F.lit("")).otherwise(F.concat(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask)))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    clean = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.size("found") > 0, clean).otherwise(text)
    return found.withColumn("_clean", masked).select(*(F.col("_clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
