"""Operator 5, secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found by regular expressions; each candidate's hash is counted over the corpus by distinct
repositories and distinct owners. Both are columns of the caller's choice; the given tables name no repository, so there
a document stands for one, and the source is the owner. A value that many owners or many repositories hold is a widely
copied example; a value of one owner in at most MAX_DOCS repositories looks live. Long mixed tokens count as secrets only
if they are owner-specific in this way.

Work on one text is in proportion to its length: offsets are running sums and cover is a running maximum, both taken
in stretches of STRETCH matches.

Defined results: a null text is empty; a null owner is an owner of its own; a null repository is one of its own for each
row; repeated rows are one document and are judged alike; offsets are code points, end exclusive; an empty table
gives an empty result; columns other than doc_id, text, owner and repository are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of the contract.
KINDS = {
    "assign": "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
}
#: A long token; it must have both letters and digits.
OWNED = "[A-Za-z0-9+/_-]{32,}"
MIN_VALUE = 6
SPANS = "array<struct<start:int,kind:int,end:int,hash:string>>"
MAX_OWNERS = 1
#: A credential stands in a few documents of its owner; what stands in more is an example.
MAX_DOCS = 10
#: Matches whose running figures are built one from another; stretches are then put together.
STRETCH = 256


def running(d: DataFrame, name: str, values: Column, op: Callable[[Column, Column], Column]) -> DataFrame:
    """d with an array: the sum, or another associative op on numbers from 0 up, of the entries of values up to each one."""
    zero = F.array(F.lit(0))
    grow = lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v)))
    d = d.withColumn("_values", values)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_values"), F.lit(1)), F.lit(STRETCH))
    # each stretch on its own, after a zero; then what stands before each
    d = d.withColumn("_inner", F.transform(starts, lambda k: F.aggregate(F.slice("_values", k, F.lit(STRETCH)), zero, grow)))
    d = d.withColumn("_before", F.aggregate(F.transform("_inner", lambda part: F.element_at(part, -1)), zero, grow))
    put = lambda part, base: F.transform(F.slice(part, F.lit(2), F.size(part) - 1), lambda v: op(base, v))
    # zipped: a column named in a lambda may be worked out anew for each entry
    return d.withColumn(name, F.flatten(F.zip_with("_inner", F.slice("_before", F.lit(1), F.size("_inner")), put))).drop("_values", "_inner", "_before")


def spans(d: DataFrame, name: str, kind: int, pattern: str, value_group: int = 0, least: int = 0, mixed: bool = False) -> DataFrame:
    """d with an array of start, kind, end and hash of the value of each match in text, leftmost and non-overlapping.

    The pieces between matches and the matches alternate, so running lengths give the offsets.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    some = lambda x: F.when(text.rlike(pattern), x).otherwise(none)
    d = d.withColumn("_hits", some(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).withColumn("_gaps", some(F.split(text, pattern, -1)))
    d = d.withColumn("_found", some(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))) if value_group else F.col("_hits"))
    d = d.withColumn("_lengths", F.transform("_hits", F.char_length))
    d = running(d, "_ends", F.zip_with(F.slice("_gaps", F.lit(1), F.size("_hits")), "_lengths", lambda g, n: F.char_length(g) + n), lambda x, y: x + y)
    ok = (lambda x: x["_found"].rlike("[0-9]") & x["_found"].rlike("[A-Za-z]")) if mixed else (lambda x: F.char_length(x["_found"]) >= least)
    row = lambda x: F.struct((x["_ends"] - x["_lengths"]).alias("start"), F.lit(kind).alias("kind"), x["_ends"].alias("end"), F.sha2(x["_found"], 256).alias("hash"))
    return d.withColumn(name, F.transform(F.filter(F.arrays_zip("_ends", "_lengths", "_found"), ok), row)).drop("_hits", "_gaps", "_found", "_lengths", "_ends")


def outside(d: DataFrame, name: str, more: str, base: str) -> DataFrame:
    """d with the spans of more that no span of base holds: in order of start, the base's largest end so far says it."""
    both = (F.size(more) > 0) & (F.size(base) > 0)
    tagged = lambda c, k: F.transform(c, lambda x: F.struct(x["start"].alias("at"), F.lit(k).alias("is_more"), x.alias("span")))
    d = d.withColumn("_ordered", F.when(both, F.sort_array(F.concat(tagged(base, 0), tagged(more, 1)))))  # of equal starts, the base's come first
    d = running(d, "_reach", F.transform("_ordered", lambda x: F.when(x["is_more"] == 0, x["span"]["end"]).otherwise(0)), lambda x, y: F.greatest(x, y))
    free = F.filter(F.arrays_zip("_ordered", "_reach"), lambda z: (z["_ordered"]["is_more"] == 1) & (z["_ordered"]["span"]["end"] > z["_reach"]))
    return d.withColumn(name, F.when(both, F.transform(free, lambda z: z["_ordered"]["span"])).otherwise(F.col(more))).drop("_ordered", "_reach")


def _joined(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "owned")])
    return F.array_join(F.transform(F.sort_array(array), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """row, doc_id, owner, repository, base and more (candidates) of each document, as a table in the shared folder (no texts)."""
    names = F.monotonically_increasing_id().alias("row"), docs["doc_id"], docs[owner].alias("owner"), docs[repository].alias("repository")
    d = docs.select(*names, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    for k, (n, p) in enumerate(KINDS.items()):
        d = spans(d, n, k, p, 2 if n == "assign" else 0, MIN_VALUE if n == "assign" else 0)
    d = spans(d, "all_more", len(KINDS), OWNED, mixed=True).withColumn("base", F.concat(*KINDS))
    return written(outside(d, "more", "all_more", "base").select("row", "doc_id", "owner", "repository", "base", "more", "all_more"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_docs (repositories) and n_owners over the corpus, both distinct. A value's rows are made one by repository, then summed by owner, before they meet."""
    unnamed = F.when(F.col("repository").isNull(), F.col("row")).alias("unnamed")
    each = found.select("owner", "repository", unnamed, F.explode(F.concat("base", "all_more")).alias("x")).select("x.hash", "owner", "repository", "unnamed").distinct()
    return each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document: base spans, live (owner-specific) spans of the base, and added owner-specific tokens (none inside a base span)."""
    found = scanned(docs, owner, repository)
    copied = ownership(found).filter((F.col("n_owners") > max_owners) | (F.col("n_docs") > max_docs)).select("hash")
    each = found.select("row", F.explode(F.concat("base", "more")).alias("x")).select("row", "x", "x.hash")
    live = each.join(copied, "hash", "left_anti").groupBy("row").agg(F.collect_list("x").alias("live"))
    out = found.join(live, "row", "left")
    live_or_none = F.coalesce("live", F.array().cast(SPANS))
    return out.select("doc_id", "base", *[F.filter(live_or_none, keep).alias(n) for n, keep in (("added", lambda x: x["kind"] == len(KINDS)), ("live", lambda x: x["kind"] < len(KINDS)))])


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )
