"""Secret scanning over a ledger of content-addressed blobs, in DataFrame functions.

Each version of a file is a blob, addressed by the SHA-256 of its text. The ledger has a row for
every scan of a blob: which rule versions it applied and what each found. Only pairs of blob and
rule version that no row covers are scanned. Findings of the rule versions in force, and of no others,
are then joined to every path of the blob; paths of one blob are as many as they are, and findings few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """A regular expression whose matches count if ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In this order spans of equal start are listed. The first three are the base rules.
RULES = [
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
]
BASE = 3
#: In the ledger a span has the name of its rule version; in the findings its place in today's list.
SPANS, FOUND = "array<struct<start:int,rule:string,end:int>>", "array<struct<start:int,rule:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, found {SPANS}"


def _maximal(rule: Rule) -> str:
    """The pattern of runs of one class needs no check of its length if it asks for it at once."""
    return rule.pattern[:-1] + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    Matches and the pieces between them alternate, so their lengths add up to the positions.
    """
    pattern = _maximal(rule)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(found: Column) -> Column:
        def fold(gaps: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                start = state["at"] + F.length(F.get(gaps, i))
                match = F.get(found, i)
                end = start + F.length(match)
                counted = match if rule.group == 0 else F.regexp_extract(match, pattern, rule.group)
                span = F.array(F.struct(start.alias("start"), F.lit(rule.name).alias("rule"), end.alias("end")))
                kept = F.when(F.length(counted) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"])
                return F.struct(end.alias("at"), kept.alias("spans"))

            empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), empty, step, lambda s: s["spans"])

        # a lambda over an array of one binds the pieces once
        return F.get(F.transform(F.array(F.split(text, pattern, -1)), fold), F.lit(0))

    bound = F.get(F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, place(m))), F.lit(0))
    return F.coalesce(F.when(text.rlike(pattern), bound), F.array().cast(SPANS))


def scan(versions: DataFrame, ledger: DataFrame | None, rules: list[Rule], scratch: Scratch) -> DataFrame:
    """New ledger rows ``(blob, rules, found)`` for what ``ledger`` does not cover.

    ``versions`` has ``(path, text)``. One path of each blob is scanned. ``found`` says for each span which rule version found it.
    """
    named = F.array(*[F.lit(r.name) for r in rules])
    seen = versions.select("path", F.unhex(F.sha2("text", 256)).alias("blob"))
    blobs = seen.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        todo = blobs.withColumn("rules", named)
    else:
        done = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("rules", F.array_except(named, F.coalesce("done", F.array().cast("array<string>"))))
        todo = todo.where(F.size("rules") > 0).drop("done")
    # In the join null paths meet null paths; the blob is compared too, as paths may have several texts.
    text = versions.select(F.col("path").alias("p"), "text")
    rows = text.join(todo, F.col("p").eqNullSafe(F.col("path"))).where(F.unhex(F.sha2("text", 256)) == F.col("blob"))
    found = [F.when(F.array_contains("rules", r.name), spans(F.col("text"), r)).otherwise(F.array().cast(SPANS)) for r in rules]
    rows = rows.select("blob", "rules", F.concat(*found).alias("found"))
    return scratch.table(rows.dropDuplicates(["blob"]), "ledger")


def in_force(ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows ``(blob, found)`` of blobs in which ``rules`` found something, sorted by start, then by the order of the rules.

    What other rules or other versions of them found is left out, and so is what a blob's rows repeat.
    """
    named = F.array(*[F.lit(r.name) for r in rules])
    found = ledger.where(F.size("found") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    own = F.filter("found", lambda s: F.array_contains(named, s["rule"]))
    own = F.transform(own, lambda s: F.struct(s["start"], (F.array_position(named, s["rule"]) - 1).cast("int").alias("rule"), s["end"]))
    return found.select("blob", F.sort_array(own).cast(FOUND).alias("found")).where(F.size("found") > 0)


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``docs`` and the new ledger rows.

    The first table has ``(key, found)``, with ``found`` an array of ``(start, rule, end)``, empty where nothing
    is found; ``rule`` is the place in ``rules``. A null text is an empty one. Rows that repeat a key or text each get their row.
    Other columns are not read. Matches of overlapping rules are all kept. Ledger rows of rules that are not in ``rules`` in
    the same version are not reported; rules may come in any order.
    """
    rules, scratch = rules or RULES, Scratch(docs.sparkSession, "secrets")
    versions = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    new = scan(versions, ledger, rules, scratch)
    known = new if ledger is None else ledger.select(new.columns).unionByName(new)
    # Written, so that in the join only the paths are dealt anew where one blob has very many.
    hits = scratch.table(in_force(known, rules), "hits")
    paths = versions.select("path", F.unhex(F.sha2("text", 256)).alias("blob")).join(hits, "blob", "left")
    return paths.select(F.col("path").alias(key), F.coalesce("found", F.array().cast(FOUND)).alias("found")), new


def commit(docs: DataFrame, folder: str, first: bool = False, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Findings of every row of ``docs`` by the ledger in ``folder``, to which the scans of what was new are added.

    ``first``: there is no ledger yet. The folder must be one that the cluster shares and keeps.
    """
    ledger = None if first else docs.sparkSession.read.schema(LEDGER).parquet(folder)
    found, new = findings(docs, key, text, ledger, rules)
    new.write.mode("append").parquet(folder)
    return found


def digest(found: DataFrame, key: str = "doc_id", rules: list[Rule] | None = None) -> DataFrame:
    """Counts of the base rules and the spans as text."""
    rules = rules or RULES
    kind = F.array(*[F.lit(r.kind) for r in rules])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("found", lambda s: s["rule"] == i)).cast("bigint")
    n = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:BASE])]
    base = F.filter("found", lambda s: s["rule"] < BASE)
    return found.select(key, *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
