"""Secret scans over an incremental blob ledger, without Python.

A text version is a blob, addressed by the SHA-256 of its bytes. The ledger is a Parquet table
in which each (blob, rules version) pair has one row with its findings. A scan takes the
distinct blobs, drops the pairs that the ledger has, scans the rest once each, appends them,
and joins the findings back to every path (document) that holds the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import shared_folder, staged, text_or_empty


@dataclass(frozen=True)
class Rule:
    """One kind of secret: the pattern, and which group must have how many characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which findings at one place are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Only runs of 16 or more matter and a greedy match is a whole run, so the run is asked for at once.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds that the base has not: private key headers and prefixed platform tokens.
MORE_RULES = (
    # Words in capitals may stand before, with any spaces between: a repeated group would recurse once for each word.
    Rule("pem", r"-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----", 0, 27),
    Rule("platform", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE_RULES + MORE_RULES
#: Changes whenever the rules do, so that old ledger rows no longer count as seen.
RULES_VERSION = "2"
#: Code points of the blocks in which found spans are replaced.
REDACT_CHARS = 1024
SIZES = "array<struct<gap: int, match: int, tested: int, least: int>>"
LEDGER_SCHEMA = "blob binary, rules_version string, findings array<struct<start: int, kind: int, end: int>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _parts(text: Column, rules: tuple[Rule, ...]) -> Column:
    """For each rule with a match, the lengths of gap, match and tested group, match by match."""
    rows = []
    for number, rule in enumerate(rules):
        gaps = F.split(text, rule.pattern, -1)
        matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        tested = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        sizes = F.zip_with(
            F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("match"))),
            tested,
            lambda s, t: F.struct(s["gap"].alias("gap"), s["match"].alias("match"), F.char_length(t).alias("tested"), F.lit(rule.least).alias("least")),
        )
        empty = F.array().cast(SIZES)
        rows.append(F.struct(F.lit(number).alias("kind"), F.when(text.rlike(rule.pattern), sizes).otherwise(empty).alias("sizes")))
    return F.filter(F.array(*rows), lambda r: F.size(r["sizes"]) > 0)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> (blob, findings) for every blob, an empty list where nothing is found.

    Spans are in code points, end exclusive, sorted by (start, kind). A match's place is the
    running sum of the gaps and matches before it, so the work is linear in the text even where
    one text holds very many matches. All steps stay in the partitioning by blob.
    """
    miss = F.struct(F.lit(-1).alias("kind"), F.lit(None).cast(SIZES).alias("sizes"))
    hits = blobs.select("blob", F.explode(F.concat(F.array(miss), _parts(F.col("text"), rules))).alias("r"))
    each = hits.select("blob", "r.kind", F.posexplode_outer("r.sizes").alias("at", "size"))
    so_far = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("stop", F.sum(F.col("size.gap") + F.col("size.match")).over(so_far))
    finding = F.struct(
        (F.col("stop") - F.col("size.match")).cast("int").alias("start"), F.col("kind"), F.col("stop").cast("int").alias("end")
    )
    good = F.when(F.col("size.tested") >= F.col("size.least"), finding)
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(good)).alias("findings"))


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    """The ledger's rows; none where nothing was written yet."""
    spark = docs.sparkSession
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """Scan the blobs of ``docs`` that the ledger lacks under ``version``, append, and return the ledger's rows for it.

    Scans at the same time, or one repeated after a failure, may append a blob twice with the
    same findings; ``findings_by_blob`` has each once.
    """
    blobs = docs.select(blob_id(text_or_empty()).alias("blob"), text_or_empty().alias("text"))
    distinct = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    seen = read_ledger(docs, ledger).where(F.col("rules_version") == version).select("blob")
    unseen = distinct.join(seen, "blob", "left_anti")
    scan_blobs(unseen, rules).select("blob", F.lit(version).alias("rules_version"), "findings").write.mode("append").parquet(ledger)
    return read_ledger(docs, ledger).where(F.col("rules_version") == version)


def findings_by_blob(rows: DataFrame) -> DataFrame:
    """Ledger rows of one version -> one row for each blob that has findings."""
    return rows.where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """``docs`` with ``findings``: array<struct<start, kind, end>> for each row, by (start, kind).

    ``kind`` is an index into ``rules``. Spans count code points, the end is exclusive, and the
    matches of one rule never overlap. ``ledger`` is a folder that persists between runs; a new
    one in the shared folder is made if none is given.

    Null text is scanned as empty and has no findings. Repeated rows, repeated ids and null ids
    each keep their row. Texts have no length limit. An empty table gives an empty result. A
    column named findings is replaced, all others stay.
    """
    ledger = ledger or f"{shared_folder(docs.sparkSession)}/secret-ledger-{uuid.uuid4().hex}"
    found = findings_by_blob(update_ledger(docs, ledger, rules, version))
    # Staged, so that both sides of the join are plain shuffles and a hot blob's rows can be split there.
    found = staged(found.select(F.col("blob").alias("_blob"), "findings"), "blob-findings").hint("shuffle_hash")
    # Paths go to the join as they are read, so that a hot blob's rows can be split there.
    paths = docs.drop("findings").withColumn("_id", blob_id(text_or_empty()))
    joined = paths.join(found, F.col("_id") == F.col("_blob"), "left").drop("_id", "_blob")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<start: int, kind: int, end: int>>")))


def span_list(findings: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            findings,
            lambda f: F.concat_ws(":", F.element_at(names, f["kind"] + 1), f["start"].cast("string"), f["end"].cast("string")),
        ),
        ",",
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``findings``) with every found span of text replaced by [SECRET]; spans that overlap become one.

    Texts with findings are cut into blocks of REDACT_CHARS, and each block gets the spans that
    reach into it, so the work is linear in texts and findings. Texts without stay where they
    are. Column findings is dropped. Cases as in ``scan_secrets``.
    """
    docs = staged(docs, "scanned")  # read twice, scanned once
    clean = docs.where(F.size("findings") == 0).drop("findings")
    hit = staged(docs.where(F.size("findings") > 0).withColumn("_row", F.monotonically_increasing_id()), "with-secrets")
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{REDACT_CHARS}}}"), F.lit(0))
    blocks = hit.select("_row", F.posexplode(cut).alias("_block", "_part"))

    spans = hit.select("_row", F.explode("findings").alias("f")).select("_row", "f.start", "f.end")
    earlier = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("fresh", F.col("start") >= F.coalesce(F.max("end").over(earlier), F.lit(0)))
    first, last = (F.floor(place / REDACT_CHARS).cast("int") for place in (F.col("start"), F.col("end") - 1))
    spans = spans.withColumn("first", first).withColumn("_block", F.explode(F.sequence(first, last)))
    base = F.col("_block") * REDACT_CHARS
    inside = F.struct(
        F.greatest(F.col("start") - base, F.lit(0)).alias("start"),
        F.least(F.col("end") - base, F.lit(REDACT_CHARS)).alias("end"),
        (F.col("fresh") & (F.col("_block") == F.col("first"))).alias("fresh"),
    )
    own = spans.groupBy("_row", "_block").agg(F.array_sort(F.collect_list(inside)).alias("_spans"))

    kept = F.aggregate(
        F.coalesce("_spans", F.array().cast("array<struct<start: int, end: int, fresh: boolean>>")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, f: F.struct(
            F.greatest(acc["at"], f["end"]).alias("at"),
            F.concat(acc["out"], F.substring(F.col("_part"), acc["at"] + 1, F.greatest(f["start"] - acc["at"], F.lit(0))), F.when(f["fresh"], "[SECRET]").otherwise("")).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("_part"), acc["at"] + 1, F.lit(REDACT_CHARS))),
    )
    done = blocks.join(own, ["_row", "_block"], "left").select("_row", F.struct("_block", kept.alias("part")).alias("p"))
    done = done.groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("_parts"))
    texts = hit.join(done, "_row").withColumn("text", F.array_join(F.col("_parts.part"), "")).drop("findings")
    return clean.unionByName(texts.select(*clean.columns))
