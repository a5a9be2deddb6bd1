"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of every text is addressed by its SHA-256. The ledger holds the pairs (blob, rule version) scanned so far
with their findings. A scan deduplicates the incoming texts by address, removes the pairs that the ledger holds, matches
only the rest, appends them, and joins the findings of all pairs back to every path that carries the blob.

Positions are found without Python: ``\\G(?s)(.*?)(rule)`` splits a text into gaps and leftmost non-overlapping matches,
and running sums of their lengths, in code points, are the spans. ``\\G`` holds a search to the end of the last match, so
the tail after it is read once. Only texts that contain the rule at all are split.

Cases: a null text counts as the empty text; an empty text has no findings; repeated rows keep their number of rows;
an empty table gives an empty result and an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """A kind, its Java pattern, a cheap test that any match passes, and what a match must satisfy.

    The test is a pattern, or literals of which one must occur, in the lower-cased text where the pattern ignores case.
    """

    kind: str
    pattern: str
    probe: str | tuple[str, ...]
    value_group: int | None = None  # group of the pattern whose length counts, else the whole match
    least: int = 0
    base: bool = False


#: The base kinds and their patterns, then the shapes of widely used credentials.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "api_key", "apikey"), 1, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", ("AKIA",), None, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}", None, 32, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ("eyJ",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", ("://",)),
)
RULE_VERSION = "1"


def may_match(text: Column, rule: Rule) -> Column:
    if isinstance(rule.probe, str):
        return text.rlike(rule.probe)
    folded = F.lower(text) if rule.pattern.startswith("(?i") else text
    return reduce(or_, [folded.contains(x) for x in rule.probe])


def rule_spans(text: Column, rule: Rule, ord_: int) -> Column:
    """Array of the rule's spans in ``text``."""
    split = rf"\G(?s)(.*?)({rule.pattern})"
    gaps, found = F.regexp_extract_all(text, F.lit(split), F.lit(1)), F.regexp_extract_all(text, F.lit(split), F.lit(2))
    parts = [gaps.alias("g"), found.alias("m")]
    value = F.regexp_extract_all(text, F.lit(split), F.lit(2 + rule.value_group)) if rule.value_group else found
    pairs = F.arrays_zip(*parts, value.alias("v"))

    def fold(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"]).cast("long")
        end = start + F.length(p["m"]).cast("long")
        one = F.array(F.struct(start.alias("start"), F.lit(ord_).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        keep = F.length(p["v"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    spans = F.aggregate(pairs, zero, fold, lambda acc: acc["spans"])
    return F.when(may_match(text, rule), spans).otherwise(F.array().cast(SPAN))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.sort_array(F.concat(*[rule_spans(text, r, i) for i, r in enumerate(rules)]))



def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", T._parse_datatype_string(SPAN))]))


def scan(docs: DataFrame, *, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(new ledger entries, documents with ``_blob``): scans only pairs that ``ledger`` lacks.

    The entries are written to the shared folder; appending them to the ledger is one write of that frame. A copy of a
    text is dropped before it is scanned, by an aggregation that combines copies within each task before the shuffle.
    Only texts that may match some rule travel; the others are clean and enter the ledger by their address alone.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    addressed = docs.withColumn("_blob", F.sha2(text.cast("binary"), 256))
    suspect = F.when(reduce(or_, [may_match(text, r) for r in rules]), text)
    blobs = addressed.select("_blob", suspect.alias("_suspect"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select(F.col("blob").alias("_blob")).distinct()
        blobs = blobs.join(seen, "_blob", "left_anti")
    blobs = blobs.groupBy("_blob").agg(F.first("_suspect", ignorenulls=True).alias("_suspect"))
    # spans are computed once: the array is written before anything reads its parts
    entries = blobs.select(F.col("_blob").alias("blob"), F.lit(rule_version).alias("rule_version"), F.when(F.col("_suspect").isNull(), F.array().cast(SPAN)).otherwise(find_spans(F.col("_suspect"), rules)).alias("spans"))
    return materialize(entries, "secret-ledger"), addressed


def findings_by_path(addressed: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """All rows of ``addressed`` with ``_spans``. A blob that a third of the paths carry is joined by salted keys."""
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("_spans"))
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("blob", "_blob")
    salted = addressed.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in addressed.columns if c != "_blob"]), F.lit(SALTS)).cast("int"))
    out = salted.join(found, ["_blob", "_salt"], "left").drop("_salt")
    return out.withColumn("_spans", F.coalesce("_spans", F.array().cast(SPAN)))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    entries, addressed = scan(docs)
    rows = findings_by_path(addressed.select("doc_id", "_blob"), entries)
    base = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in base], F.sha2(span_list(F.filter("_spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), span_list(F.col("_spans")).alias("spans"))
