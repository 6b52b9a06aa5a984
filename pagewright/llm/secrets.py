"""Operator 8: secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger table holds one row for each blob and rule
version that was scanned, with what was found. A run scans only blobs that the ledger doesn't have under the present
rule version, for each the rows of one path (rows equal in path and text are scanned as often as they occur), appends what it finds, and
joins the ledger back to all paths and versions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import keep_matching, materialise

#: The rules, in the order in which spans of one start are listed. Changing a rule needs a new version.
RULE_VERSION = "base-1"
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

LEDGER = "sha string, rule_version string, n_assign long, n_access long, n_hex long, spans string"


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, in code points, by start and then kind as listed.

    Of the assignments the matches whose value is shorter than 12 are dropped after matching: what they cover isn't
    searched again. For the other two a run is matched from its start or not at all, so the length is in the pattern.
    """
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def blobs(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, sha) of every row; a null text counts as the empty blob, and a null path stays null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return versions.select(F.col(path_col).cast("string").alias("path"), F.sha2(text, 256).alias("sha"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`; an empty one if there is none yet. A blob that two runs have scanned is there once."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
    return rows.dropDuplicates(["sha", "rule_version"])


def scan(texts: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for (sha, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find_secrets(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[2] == kind for s in own) for own in spans], pa.int64()) for kind in KINDS]
            lines = pa.array([",".join(f"{kind}:{start}:{end}" for start, end, kind in own) for own in spans], pa.string())
            version = pa.array([rule_version] * len(spans), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), version, *counts, lines], [c.split()[0] for c in LEDGER.split(", ")])

    return texts.select("sha", "text").mapInArrow(run, LEDGER)


def update_ledger(versions: DataFrame, ledger_path: str, path_col: str = "path", text_col: str = "text", rule_version: str = RULE_VERSION, scan_rows: int = 20_000, skip_rows: int = 500_000) -> DataFrame:
    """Scan what the ledger lacks, append it, and return (path, sha, n_assign, n_access, n_hex, spans) of every row.

    Rows are kept as they come: repeated rows, null paths and extra columns of any name don't matter. A null or empty
    text is the empty blob, without findings. Texts are read where they lie; only ids and hashes are shuffled as long as
    either the blobs to scan (`scan_rows`) or the rows to skip (`skip_rows`) are few enough to broadcast; otherwise the texts are shuffled once.
    A run that is lost before its append leaves the ledger as it was; one that ran twice leaves equal rows, read once.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version).select("sha")
    addressed = materialise(blobs(versions, path_col, text_col))
    first = addressed.groupBy("sha").agg(F.min("path").alias("path"))
    todo = materialise(first.join(known, "sha", "left_anti").select(F.col("sha").alias("todo_sha"), F.col("path").alias("todo_path")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(path_col).cast("string").alias("path"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    wanted = (F.col("sha") == F.col("todo_sha")) & F.col("path").eqNullSafe(F.col("todo_path"))
    n_todo = todo.count()
    if n_todo <= scan_rows:
        rows = keep_matching(rows, todo, wanted, "left_semi", n_todo)
    else:
        marks = [F.xxhash64("path", "sha"), F.xxhash64(F.lit(1), "path", "sha")]  # 128 bits, so that no blob is skipped for another
        skip = materialise(addressed.join(todo, wanted, "left_anti").select(marks[0].alias("skip"), marks[1].alias("skip_too")).distinct())
        n_skip = skip.count()
        if n_skip <= skip_rows:
            rows = keep_matching(rows, skip, (marks[0] == F.col("skip")) & (marks[1] == F.col("skip_too")), "left_anti", n_skip)
        else:
            rows = rows.join(todo.hint("shuffle_hash"), wanted, "left_semi")
    if n_todo:
        scan(rows, rule_version).write.mode("append").parquet(ledger_path)
    found = read_ledger(spark, ledger_path).filter((F.col("rule_version") == rule_version) & (F.col("spans") != ""))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return addressed.join(found.drop("rule_version"), "sha", "left").select("path", "sha", *zero, F.coalesce("spans", F.lit("")).alias("spans"))


def digest(spans: str) -> str:
    """The SHA-256, in hex, of a spans string."""
    return hashlib.sha256(spans.encode()).hexdigest()
