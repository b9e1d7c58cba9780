"""Secret scanning with a ledger of what has been scanned.

Every version of every text is a blob named by its SHA-256. A ledger, a folder of
Parquet files, holds for each blob which versions of which rules have scanned it,
and what they found. Only (blob, rule version) pairs that it lacks are scanned:
all rules on a blob that is new, one rule on every blob when that rule changes,
nothing when nothing is new; each once however many rows share the blob. Spans
are joined back to all rows, whichever run found them.

Only DataFrame functions run here. Offsets come from splitting a text by a rule
and adding up the lengths of the gaps and of the matches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import folder_exists, shared_folder
from .common import apart, column, drop_table, staged, text_of

SPAN = "struct<start:int,rank:int,end:int,kind:string,rule:string>"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, its least length, a cheap test that every text with a finding passes, and a version, which changes with any of them."""

    pattern: str
    group: int
    least: int
    probe: str
    version: int = 1


#: By kind; base kinds first.
RULES = {
    "assign": Rule(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    "access": Rule(r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": Rule(r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    "private_key": Rule(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "jwt": Rule(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10}"),
    "forge_token": Rule(r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_[A-Za-z0-9]{36}"),
    "chat_token": Rule(r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, r"xox[abprs]-[A-Za-z0-9-]{10}"),
}
BASE = ("assign", "access", "hex")
#: Where a length is counted on the whole match, a run shorter than that can't hold a match, so only longer runs are looked for.
SEARCH = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def rule_key(kind: str, rule: Rule) -> str:
    return f"{kind}@{rule.version}"


def _spans(kind: str, rank: int, rule: Rule, text: str) -> Column:
    """The spans of one rule over the column ``text``."""
    pattern = SEARCH.get(kind, rule.pattern) if rule is RULES.get(kind) else rule.pattern
    quoted = F.lit(pattern)
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.char_length)
    whole = F.regexp_extract_all(F.col(text), quoted, F.lit(0))
    counted = F.regexp_extract_all(F.col(text), quoted, F.lit(rule.group)) if rule.group else whole
    pieces = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.char_length).alias("len"), F.transform(counted, F.char_length).alias("val"))
    # The last gap follows the last match: its len and val are null and no span comes of it.
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(rule_key(kind, rule)).alias("rule"))
        return F.struct(end.alias("at"), F.when(x["val"] >= rule.least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    wanted = F.array_contains("missing", rule_key(kind, rule)) & F.regexp_like(F.col(text), F.lit(rule.probe))
    return F.when(wanted, F.aggregate(pieces, state, step)["out"]).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``blob, rules, spans``: a row for each blob and run that scanned it, with the rules that it ran."""
    schema = f"blob string, rules array<string>, spans array<{SPAN}>"
    if not folder_exists(spark, path):
        return spark.sql(f"SELECT CAST(NULL AS STRING) AS blob, CAST(NULL AS array<string>) AS rules, CAST(NULL AS array<{SPAN}>) AS spans WHERE false")
    return spark.read.schema(schema).parquet(path)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("blob", F.sha2(F.col("_text").cast("binary"), 256))


def update_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None) -> int:
    """Scan what the ledger at ``path`` lacks and append it; how many blobs were scanned.

    A run that dies before it has appended is run again; one that dies while it
    appends leaves whole files or none, and spans that come twice count once.
    """
    rules, spark = rules or RULES, docs.sparkSession
    keys = F.array(*[F.lit(rule_key(k, r)) for k, r in rules.items()])
    ledger = read_ledger(spark, path)
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("have")).withColumnRenamed("blob", "_known")
    texts = _named(docs, id_col, text_col)
    # One row stands for each blob, so a text shared by thousands of rows is moved and scanned once.
    ones = texts.select("blob", "_id").groupBy("blob").agg(F.min("_id").alias("_one"))
    todo = ones.join(known, F.col("blob") == F.col("_known"), "left").withColumn("missing", F.array_except(keys, F.coalesce("have", F.expr("cast(array() as array<string>)")))).where(F.size("missing") > 0)
    todo = staged(todo.select(F.col("blob").alias("_todo"), "_one", "missing"), "todo")
    n = todo.count()
    if n:
        _, some = apart(texts, F.xxhash64("blob", "_id"), todo, F.xxhash64("_todo", "_one"))
        unseen = some.join(todo, (F.col("blob") == F.col("_todo")) & F.col("_id").eqNullSafe(F.col("_one"))).dropDuplicates(["blob"])
        found = F.concat(*[_spans(kind, rank, rule, "_text") for rank, (kind, rule) in enumerate(rules.items())])
        fresh = staged(unseen.select("blob", F.col("missing").alias("rules"), found.alias("spans")), "scanned")
        fresh.write.mode("append").parquet(path)
        drop_table(fresh)
    drop_table(todo)
    return n


def findings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """``id_col, blob, spans`` for every row: what the ledger has on its text under the rules as they are, by start and then by the rules' order."""
    rules = rules or RULES
    current = F.array(*[F.lit(rule_key(k, r)) for k, r in rules.items()])
    ranks = F.create_map(*[x for rank, kind in enumerate(rules) for x in (F.lit(kind), F.lit(rank))])
    ranked = F.transform(F.filter("spans", lambda s: F.array_contains(current, s["rule"])), lambda s: F.struct(s["start"].alias("start"), F.element_at(ranks, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["rule"].alias("rule")))
    hits = read_ledger(docs.sparkSession, path).where(F.size("spans") > 0).select("blob", ranked.alias("spans"))
    hits = hits.groupBy(F.col("blob").alias("_hit")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    paths = _named(docs, id_col, text_col).select("_id", "blob")
    return paths.join(hits, F.col("blob") == F.col("_hit"), "left").select(F.col("_id").alias(id_col), "blob", F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))


def new_ledger(spark: SparkSession) -> str:
    """A path for a ledger that lasts as long as this application's staged tables."""
    return f"{shared_folder(spark)}/weft/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-ledger"


def scan_secrets(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """Brings the ledger (a path; a new one if none is given) up to date and gives ``findings``.

    * null text is the empty blob
    * rows with a null id, and rows that repeat an id or a text (an id's rows are
      its versions), each get the spans of their own text
    * an empty table gives an empty result; other columns, of any name, are ignored
    """
    path = ledger or new_ledger(docs.sparkSession)
    update_ledger(docs, path, id_col, text_col, rules)
    return findings(docs, path, id_col, text_col, rules)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
