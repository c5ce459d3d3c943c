"""Records that other systems feed in become immutable, content-addressed advisory evidence.

Validation, documents, names and log rows are columns; a batch splits into receipts and refused records, so one bad record stops no other.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import text as T
from ..sources import log
from ..storage import durable
from .artifacts import built

FIELDS = ("kind", "work_unit_id", "source_ref", "summary", "sha256", "produced_at", "emitted_by", "freshness", "custody_note")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)
REQUIRED = ("kind", "work_unit_id", "source_ref", "sha256")
TAG = "lorekeep/feed-evidence@1"
NOTE = "advisory copy of a record that another system is the authority for; to be recalled as context, never taken for the truth"


class FeedError(ValueError):
    """A record that can't be stored as evidence."""


@dataclass(frozen=True)
class Custody:
    """Where evidence goes, where it is logged, and what is known about the handing over. Staged candidates are never promoted by themselves."""

    cold_root: str
    manifest_dir: str
    candidate_root: str | None = None
    received_from: str = ""
    received_at: str = ""
    path_style: str = "native"
    tag: str = TAG


_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
_ESCAPES += [(chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in "\n\r\t\b\f"]


def json_text(value: Column) -> Column:
    """A JSON string literal; characters outside ASCII stay."""
    # Other control characters are rare, so texts without one skip their 27 replacements.
    common, rare = value, value
    for i, (a, b) in enumerate(_ESCAPES):
        rare = F.replace(rare, F.lit(a), F.lit(b))
        common = rare if i == 6 else common
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(common), F.lit('"'))


def problem(unknown: bool = False) -> Column:
    """Why a record (its fields as columns) is refused; null if it is fine. The link must be a whole SHA-256."""
    sha = T.stripped(F.coalesce("sha256", F.lit("")))
    out = F.when(F.col("summary").isNull() | F.greatest(*(F.col(f).isNull().cast("int") for f in REQUIRED)).cast("boolean"), "missing field")
    out = out.when(~sha.rlike("^[0-9a-fA-F]{64}$"), "no sha256 link")
    for f in REQUIRED:
        out = out.when(T.stripped(F.col(f)) == "", f"blank {f}")
    return out


def evidence(records: DataFrame, tag: str = TAG) -> DataFrame:
    """``records`` with problem, link_sha256, document (canonical JSON: sorted keys, two spaces, a final line feed), evidence_sha256 and name."""
    rows = records.select(*(F.col(f).cast("string") if f in records.columns else F.lit(None).cast("string").alias(f) for f in FIELDS))
    rows = rows.withColumn("problem", problem()).fillna("", [f for f in FIELDS if f not in (*REQUIRED, "summary")])
    link = F.upper(T.stripped(F.col("sha256")))
    note = F.when(F.col("custody_note") == "", NOTE).otherwise(F.col("custody_note"))
    t = lambda c: json_text(F.col(c) if isinstance(c, str) else c)
    document = F.concat(
        F.lit('{\n  "advisory": true,\n  "custody_note": '), t(note), F.lit(',\n  "emitted_by": '), t("emitted_by"), F.lit(',\n  "freshness": '), t("freshness"),
        F.lit(',\n  "is_truth_source": false,\n  "kind": '), t("kind"), F.lit(',\n  "produced_at": '), t("produced_at"), F.lit(f',\n  "schema": "{tag}",\n  "source_ref": '), t("source_ref"),
        F.lit(',\n  "sources": [\n    {\n      "ref": '), t("source_ref"), F.lit(',\n      "role": "' + v.EVIDENCE_ROLE + '",\n      "sha256": "'), link,
        F.lit('"\n    }\n  ],\n  "summary": '), t("summary"), F.lit(',\n  "work_unit_id": '), t("work_unit_id"), F.lit("\n}\n"),
    )
    rows = rows.withColumns({"link_sha256": link, "document": document}).withColumn("evidence_sha256", T.sha(F.col("document")))
    return rows.withColumn("name", file_name(F.col("evidence_sha256"), "json"))


def file_name(sha: Column, ext: str) -> Column:
    """kind.work-unit.hash.ext with only safe characters."""
    part = lambda c, empty: F.coalesce(F.nullif(T.safe_name(F.col(c)), F.lit("")), F.lit(empty))
    return F.concat_ws(".", part("kind", "feed"), part("work_unit_id", "wu"), F.left(sha, F.lit(16)), F.lit(ext))


def reason(custody: Custody) -> Column:
    given = lambda label, c: F.when(c != "", F.concat(F.lit(label + "="), c))
    return F.concat_ws(
        "; ", F.concat(F.lit(v.REASONS["evidence"]), "kind"), F.concat(F.lit("work_unit="), "work_unit_id"), F.concat(F.lit("link="), "link_sha256"), given("emitted_by", F.col("emitted_by")),
        given("received_from", F.lit(custody.received_from)), given("received_at", F.lit(custody.received_at)), given("freshness", F.col("freshness")),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Ungated drafts for people to look at: ``rows`` with candidate, candidate_sha256 and candidate_name."""
    text = F.concat(F.lit("# "), "kind", F.lit(": "), "work_unit_id", F.lit("\n\n"), "summary", F.lit("\n"))
    id_ = F.lower(T.safe_name(F.concat(F.lit("FEED-"), "kind", F.lit("-"), "work_unit_id")))
    made = built(text, sha256=F.col("link_sha256"), title=F.concat_ws(" ", "kind", "work_unit_id"), path=F.col("source_ref"), type_=F.lit("reference-note"), id_=id_, status="draft")
    rows = rows.withColumn("candidate", F.when(F.endswith(made, F.lit("\n")), made).otherwise(F.concat(made, F.lit("\n"))))
    return rows.withColumn("candidate_sha256", T.sha(F.col("candidate"))).withColumn("candidate_name", file_name(F.col("candidate_sha256"), "md"))


def _store(folder: str, name: str, text: str, sha: str, flag: str):
    """Writes each row's document unless a file with these bytes is there; idempotent, so tasks may run again."""

    def run(batches):
        from ..sources.tree import sha256_file

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            there = []
            for n, body, digest in zip(*(batch.column(c).to_pylist() for c in (name, text, sha))):
                path = os.path.join(folder, n)
                old = os.path.exists(path) and sha256_file(path) == digest
                there.append(old)
                if not old:
                    partial = f"{path}.{os.getpid()}.part"
                    with open(partial, "wb") as f:
                        f.write(body.encode())
                    os.replace(partial, path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(there, pa.bool_())], names=[*batch.schema.names, flag])

    return run


def ingest(records: DataFrame, custody: Custody) -> tuple[DataFrame, DataFrame]:
    """Stores ``records``; returns receipts (kind, work_unit_id, cold_path, link_sha256, evidence_sha256, advisory, duplicate, hot_candidate_path, place: in order of the records) and refused records.

    A document that the log holds already, or that comes twice in a batch, is a duplicate: neither written nor logged again.
    """
    spark = records.sparkSession
    rows = durable(evidence(records, custody.tag).withColumn("n", F.monotonically_increasing_id()), "feed")
    good, refused = rows.where("problem is null"), rows.where("problem is not null").select(*FIELDS, "problem")
    known = log.read(spark, custody.manifest_dir).where("op = 'ingest'").select(F.col("sha256").alias("evidence_sha256"), F.lit(True).alias("duplicate")).distinct()
    once = good.groupBy("evidence_sha256", "name").agg(F.min("n").alias("first"), *(F.first(c).alias(c) for c in ("document", "kind", "work_unit_id", "link_sha256", "emitted_by", "freshness")))
    once = durable(once, "once")
    new = once.drop("first").join(known.select("evidence_sha256"), "evidence_sha256", "left_anti")
    names = [f"{n} {t}" for n, t in new.dtypes]
    written = durable(new.mapInArrow(_store(custody.cold_root, "name", "document", "evidence_sha256", "there"), ", ".join([*names, "there boolean"])), "written")
    cold = F.concat(F.lit(custody.cold_root.rstrip("/") + "/"), "name")
    _append(spark, written.where("not there").select("evidence_sha256", F.octet_length("document").alias("size"), cold.alias("dst"), reason(custody).alias("why")), "ingest", custody)
    out = good.join(once.select("evidence_sha256", "first"), "evidence_sha256").join(known, "evidence_sha256", "left").join(written.select("evidence_sha256", "there"), "evidence_sha256", "left")
    out = out.withColumn("duplicate", F.coalesce("duplicate", F.lit(False)) | F.coalesce("there", F.lit(False)) | (F.col("n") > F.col("first")))
    hot = F.lit(None).cast("string")
    if custody.candidate_root:
        drafts = candidates(good.dropDuplicates(["evidence_sha256"]))
        drafts = drafts.select("evidence_sha256", "candidate", "candidate_sha256", "candidate_name", "kind", "work_unit_id", "link_sha256")
        types = ", ".join(f"{n} {t}" for n, t in drafts.dtypes)
        staged = durable(drafts.mapInArrow(_store(custody.candidate_root, "candidate_name", "candidate", "candidate_sha256", "staged"), types + ", staged boolean"), "staged")
        path = F.concat(F.lit(custody.candidate_root.rstrip("/") + "/"), "candidate_name")
        why = F.concat(F.lit(v.REASONS["candidate"]), "kind", F.lit("; work_unit="), "work_unit_id", F.lit("; link="), "link_sha256", F.lit(v.REASONS["candidate_end"]))
        _append(spark, staged.where("not staged").select(F.col("candidate_sha256").alias("evidence_sha256"), F.octet_length("candidate").alias("size"), path.alias("dst"), why.alias("why")), "ingest-hot-candidate", custody)
        out = out.join(staged.select("evidence_sha256", path.alias("hot")), "evidence_sha256", "left")
        hot = F.col("hot")
    receipts = out.select("kind", "work_unit_id", cold.alias("cold_path"), "link_sha256", "evidence_sha256", F.lit(True).alias("advisory"), "duplicate", hot.alias("hot_candidate_path"), F.col("n").alias("place"))
    return receipts, refused


def _append(spark: SparkSession, rows: DataFrame, op: str, custody: Custody) -> None:
    now = F.lit(log.now_utc())
    log.append_batch(
        rows.select(
            F.lit(op).alias("op"), F.lit(None).cast("string").alias("src_abs"), T.stored_path(F.col("dst"), custody.path_style).alias("dst_abs"), F.col("evidence_sha256").alias("sha256"),
            F.col("size").alias("size_bytes"), now.alias("mtime_utc"), now.alias("ts_utc"), F.lit("ingest").alias("stage"), F.lit(True).alias("reversible"), F.col("why").alias("reason"),
        ), custody.manifest_dir,
    )


def ingest_records(spark: SparkSession, records: list, custody: Custody) -> list[dict]:
    """``ingest`` for records at hand (mappings; unknown keys are ignored). All are checked before any is stored; the first bad one raises FeedError."""
    for r in records:
        if not hasattr(r, "get"):
            raise FeedError(f"a record must be a mapping, not {type(r).__name__}")
    rows = spark.createDataFrame([tuple(None if r.get(f) is None else str(r.get(f)) for f in FIELDS) for r in records], SCHEMA)
    if bad := evidence(rows, custody.tag).where("problem is not null").first():
        raise FeedError(f"record of work unit {bad['work_unit_id']!r}: {bad['problem']}")
    return [r.asDict() for r in ingest(rows, custody)[0].orderBy("place").drop("place").collect()]
