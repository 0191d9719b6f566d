"""Secret scans by an incremental ledger of blobs.

Every version of every path is content-addressed: a blob is the SHA-256 of a text's UTF-8 bytes. The ledger is a table of what has been
scanned: blob, and for each rule version (a digest of the rule's definition) the spans found. A scan joins the blobs at hand to the ledger, reads
only blobs with a rule version they haven't met, by those rules alone, appends the spans, and joins the ledger's findings back
to all rows. So a copy is scanned once, a second run scans nothing, and a new or changed rule is run over old blobs without repeating the others.

Base rules: ``assign`` (a name such as password, a sign, then a value of 12 characters or more), ``access`` (AKIA and more, 18 characters or more)
and ``hex`` (16 digits or more). Further rules: ``pem`` (the opening line of a private key), ``jwt`` (three dotted base64url parts, the first
two beginning with eyJ) and ``url`` (a user and a password before the host of an address). A rule's matches are leftmost and don't overlap; those whose
measured group is too short are dropped after they have taken their place. Spans count code points, the end exclusive.

Cases: null texts count as empty and have no spans; a null doc_id or path is kept; rows that repeat are each given the blob's
findings; an empty table gives an empty result and leaves the ledger alone; columns other than those named aren't read. Runs that append the
same pair twice are harmless: the spans are equal and one is taken. A text is scanned whole, whatever its length. Rows by the thousand with one
blob are joined to a single row of findings, which skew joins split.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, spread, stored

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, findings map<string,{SPANS}>"


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and the least length of the group that is measured (0: the whole match)."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: str = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "version", hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group)).encode()).hexdigest()[:16])

    def find(self, text: str, compiled: dict[str, re.Pattern] = {}) -> list[tuple[int, int]]:  # noqa: B006  a cache
        pattern = compiled.get(self.pattern) or compiled.setdefault(self.pattern, re.compile(self.pattern))
        return [m.span() for m in pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


def any_case(words: str) -> str:
    """A pattern of letters that matches them in either case, ASCII only."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


BASE = (
    Rule("assign", f"({any_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]+", 16),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1),
    Rule("url", r"[a-z][a-z0-9+.-]{0,15}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", 1),
)
RULES = BASE + MORE


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The pairs scanned so far; empty where no ledger has been begun. A ledger that can't be read is an error."""
    return stored(spark, ledger, LEDGER)


def blobs(rows: DataFrame, content: str = "text") -> DataFrame:
    """The rows with their content as ``_content`` (null: empty) and its address as ``_blob``."""
    text = F.coalesce(F.col(content), F.lit(""))
    return rows.withColumns({"_content": text, "_blob": F.sha2(text.cast("binary"), 256)})


def scan_unseen(rows: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scans the distinct blobs of ``rows`` (_row, _blob, _content) by the rules whose versions they haven't met, and appends the findings."""
    versions = {r.version: r for r in rules}
    wanted = F.array(*[F.lit(v) for v in versions])
    known = read_ledger(rows.sparkSession, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.map_keys("findings")))).alias("met"))
    firsts = rows.groupBy("_blob").agg(F.min("_row").alias("_row")).join(known, F.col("_blob") == F.col("blob"), "left")
    todo = firsts.select(F.col("_blob").alias("blob"), F.col("_row").alias("first"), F.array_except(wanted, F.coalesce("met", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    texts = rows.join(todo.hint("shuffle_hash"), (rows["_blob"] == todo["blob"]) & rows["_row"].eqNullSafe(todo["first"])).select("blob", "todo", "_content")
    kind = pa.map_(pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[(v, [{"start": s, "end": e} for s, e in versions[v].find(text)]) for v in own] for own, text in zip(b.column("todo").to_pylist(), b.column("_content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, kind)], ["blob", "findings"])

    texts.mapInArrow(scan, LEDGER).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and a list of spans for each rule of ``rules``, in columns named by kind."""
    stored = read_ledger(spark, ledger)
    return stored.groupBy("blob").agg(*[F.first(F.col("findings")[r.version], True).alias(r.kind) for r in rules])


def scan(rows: DataFrame, ledger: str, name: str = "doc_id", content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``name`` and a list of spans (start, end) for each rule, by kind, for every row of ``rows``; the ledger is brought up to date first."""
    spark = rows.sparkSession
    ready(spark)
    keyed = blobs(spread(rows).select(F.col(name).alias("_row"), F.col(content).alias("_text")), "_text")
    if not keyed.isEmpty():
        scan_unseen(keyed, ledger, rules)
    found = findings(spark, ledger, rules)
    return keyed.select("_row", "_blob").join(found, F.col("_blob") == F.col("blob")).select(F.col("_row").alias(name), *[r.kind for r in rules])


def joined(kinds: list[str]) -> F.Column:
    """kind:start:end of all spans, by start and then by kind in the order given."""
    def marked(i: int, kind: str) -> F.Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("at"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text")))

    return F.array_join(F.transform(F.array_sort(F.concat(*[marked(i, k) for i, k in enumerate(kinds)])), lambda s: s["text"]), ",")


def report(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans of each base rule counted, the digest of the base spans, and all spans."""
    base = [r.kind for r in BASE]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return scan(docs, ledger, rules=rules).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined([r.kind for r in rules]).alias("spans"))
