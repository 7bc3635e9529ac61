"""Secret scans with an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its bytes, and every rule by its kind and a digest of what it
matches. The ledger says which rules have read which blob and what they found. A scan reads only blobs with a rule that has not read them
yet, and only with those rules: a moved or copied text costs a look-up, a changed rule reads every blob once
more, the other rules none. Findings belong to blobs and are joined back to all rows that hold them.

A run writes its own folder of the ledger, so the same run again replaces what it wrote.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.llm.base import chunks, map_arrow, query, table
from talktally.session import scratch_path

SALTS = 8  # copies of one text are dealt to so many tasks when they meet their findings
SPAN = "struct<kind:string,start:int,stop:int>"
ENTRY = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,stop:int>>"


@dataclass(frozen=True)
class Rule:
    """What counts as a secret: leftmost matches of `pattern` that do not overlap, if `group` has `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()  # a text without any of these has no match; in lower case where `any_case`

    @property
    def version(self) -> str:
        """The kind with a digest of everything a match depends on."""
        content = "\0".join([self.pattern, str(self.least), str(self.group), str(self.any_case)])
        return f"{self.kind}-{hashlib.sha256(content.encode()).hexdigest()[:16]}"

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of the matches in code points, ends exclusive; only A-Z and a-z are alike in `any_case`."""
        plain = text.lower() if self.any_case else text
        if self.needs and not any(x in plain for x in self.needs):
            return
        for match in re.finditer(self.pattern, text, re.ASCII | (re.IGNORECASE if self.any_case else 0)):
            if match.end(self.group) - match.start(self.group) >= self.least:
                yield match.span()


# Fixed patterns and lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are taken whole, so shorter ones need not be matched first
BASE = (
    Rule("assign", ASSIGN, 6, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", ACCESS, 20, needs=("AKIA",)),
    Rule("hex", HEX),
)
# Keys, signed tokens and passwords in addresses.
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs=("eyJ",)),
    Rule("address_password", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", needs=("://",)),
)


def address(text: Column) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(text, 256))


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a ledger with their `run`; none where there is no ledger yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"{ENTRY}, run string"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def unread(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """`blob`, `text` and the versions of the rules that have not read it, for blobs with any."""
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    every = F.array(*(F.lit(r.version) for r in rules))
    left = F.array_except(every, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    rows = blobs.join(seen, "blob", "left").select("blob", "text", left.alias("rules"))
    return rows.where(F.size("rules") > 0)


def findings_of(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger entries of blobs: what their unread rules find."""
    by_version = {r.version: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = []
            for text, versions in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                spans = ((v, *span) for v in versions for span in by_version[v].spans(text))
                found.append([{"rule": v, "start": a, "stop": b} for v, a, b in spans])
            entry = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, entry)], ["blob", "rules", "findings"])

    return map_arrow(blobs, run, ENTRY)


def spans_by_blob(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per blob with findings of the given rules: its spans, by start and then by the order of the rules.

    Entries of other rules, and of earlier versions of these, are left out.
    """
    entries = ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("found"))
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.version, k))) if rules else F.create_map().cast("map<string,int>")
    kinds = F.array(*(F.lit(r.kind) for r in rules)).cast("array<string>")
    current = F.filter("found", lambda x: F.map_contains_key(order, x["rule"]))
    placed = F.transform(current, lambda x: F.struct(x["start"].alias("start"), order[x["rule"]].alias("place"), x["stop"].alias("stop")))
    spans = F.transform(F.array_sort(placed), lambda x: F.struct(F.get(kinds, x["place"]).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return entries.select("blob", spans.alias("spans")).where(F.size("spans") > 0)


def scan(
    rows: DataFrame,
    ledger: str,
    run: str,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns `keep` of `rows` (all by default) with `blob` and `spans` (array<struct<kind, start, stop>>).

    Blobs and rules that `ledger` has not seen are scanned and entered under `run`; the same run again replaces its entries. Rows may be
    versions of one path or paths of one version: each gets the findings of its own text. A null text is an empty
    one, and has no findings. Ends are exclusive, places count code points. Repeated rows are returned each; a column already
    named `blob` or `spans` is replaced. An empty table enters nothing and gives no rows.
    """
    spark = rows.sparkSession
    keep = [c for c in (rows.columns if keep is None else keep) if c not in ("blob", "spans")]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    versions = rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), address(whole).alias("blob"), whole.alias("text"))
    # Copies within a task meet before the shuffle, so a text that is everywhere moves once a task.
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    earlier = ledger_rows(spark, ledger).where(F.col("run") != run)
    new = findings_of(unread(blobs, earlier, rules), rules)
    new.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/run={run}")

    found = spans_by_blob(ledger_rows(spark, ledger), rules)
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = versions.select("row", "blob", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    back = paths.join(salted, ["blob", "salt"], "left")
    spans = F.coalesce(F.col("spans"), F.array().cast(f"array<{SPAN}>"))
    return back.select(*(F.col("row").getField(c).alias(c) for c in keep), "blob", spans.alias("spans"))


def of_kinds(*kinds: str) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:stop of spans, separated by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


@query("op13_secret_scan")
def op13_secret_scan(spark, sf_dir):
    """Secrets of every text, through a ledger that begins empty."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, scratch_path(spark, "secret-ledger"), "documents", keep=["doc_id"])
    counts = [F.size(of_kinds(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = joined(of_kinds(*(r.kind for r in BASE)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
