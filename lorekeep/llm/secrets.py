"""Secret scans with corpus-wide ownership frequency.

One pass over whole texts finds the base spans and further candidates: long tokens with letters and digits that no keyword
announces. Candidate values go on as hashes only. Each hash is aggregated to the number of distinct repositories and owners that
hold it: a value that many owners hold is a copied example, a random-looking value that few hold is taken for live. Announced
spans always stay; an unannounced candidate becomes a span (kind ``owned``) only if it is live.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, has_columns, in_batches, release, slices

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: As the contract's greedy runs: a run that is too short has no long enough part.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LOOSE = re.compile(r"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{20,}")
WORDS = ("passw", "secret", "token", "api")
PLACEHOLDER = re.compile(r"(?i)example|sample|changeme|placeholder|dummy|your[_-]?|x{4,}|\*{3,}|1234567|abcdef0|(.)\1{5,}")

#: Spans of 16 bytes (and keys, which count as two) that may be broadcast: 16 MB at most.
BROADCAST_SPANS = 1_000_000
FOUND = "array<struct<s:long,k:int,e:long>>"
CANDIDATES = "array<struct<s:long,k:int,e:long,h:string,random:boolean>>"


def looks_random(value: str) -> bool:
    """Long, mixed and of high entropy, and no known placeholder."""
    if len(value) < 16 or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value) or PLACEHOLDER.search(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.0


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, bool]]]:
    """Base spans (start, kind, end), sorted, and candidates with the hash of their value."""
    base, cands = [], []

    def candidate(s: int, k: int, e: int, value: str) -> None:
        cands.append((s, k, e, xxhash.xxh3_128_hexdigest(value.encode()), looks_random(value)))

    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                base.append((m.start(), 0, m.end()))
                candidate(m.start(), 0, m.end(), m[2])
    for k, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            base.append((m.start(), k, m.end()))
            candidate(m.start(), k, m.end(), m[0])
    base.sort()
    starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    for m in LOOSE.finditer(text):
        # The base spans that begin before its end: none may reach into it.
        before = bisect_left(starts, m.end())
        if (not before or ends[before - 1] <= m.start()) and looks_random(m[0]):
            candidate(m.start(), 3, m.end(), m[0])
    return base, cands


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found, cands = [], []
        for text in pc.fill_null(part.column("text"), "").to_pylist():
            base, more = scan(text)
            found.append([{"s": s, "k": k, "e": e} for s, k, e in base])
            cands.append([{"s": s, "k": k, "e": e, "h": h, "random": x} for s, k, e, h, x in more])
        span = [("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*map(part.column, ("doc_id", "key", "repository", "owner")), pa.array(found, pa.list_(pa.struct(span))), pa.array(cands, pa.list_(pa.struct([*span, ("h", pa.string()), ("random", pa.bool_())])))],
            names=["doc_id", "key", "repository", "owner", "found", "cands"],
        )


def _key() -> Column:
    """Tells rows apart whose doc_id is null or repeated; copies of a row have the same. 128 bits over doc_id and text, so no other row is cut by chance."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(20), text, doc_id).alias("b"))


def findings(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """A durable row for each document: row, doc_id, repository, owner, found and cands."""
    has_columns(docs, "doc_id", "text", repository, owner)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text").cast("string").alias("text"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    out = docs.transform(in_batches, _scan_all, f"doc_id long, key struct<a:long,b:long>, repository string, owner string, found {FOUND}, cands {CANDIDATES}")
    return durable(out.withColumn("row", F.monotonically_increasing_id()), "findings")


def ownership(found: DataFrame) -> DataFrame:
    """hash -> number of distinct owners and repositories (those of unknown owners or repositories count as one)."""
    held = found.where(F.size("cands") > 0).select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), F.explode(F.array_distinct("cands.h")).alias("h"))
    by_owner = held.distinct().groupBy("h", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def verdicts(found: DataFrame, max_owners: int = 2) -> DataFrame:
    """row -> cands of that row, each with owners, repositories and verdict: live, copied or plain."""
    c = found.where(F.size("cands") > 0).select("row", F.explode("cands").alias("c")).select("row", "c.*")
    verdict = F.when(F.col("owners") > max_owners, "copied").when(F.col("random"), "live").otherwise("plain")
    c = c.join(ownership(found), "h").withColumn("verdict", verdict)
    return c.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "h", "owners", "repositories", "verdict"))).alias("judged"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = 2) -> DataFrame:
    """Secrets of each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied and live_repositories.

    live_repositories is how far its live values have spread: the most repositories that hold one of them, 0 if there is none.

    A null or empty text has no spans and the digest of the empty string. Repeated rows, null ids and null owners are rows like
    others (nulls of a kind count as one owner). An empty table gives an empty result.
    """
    found = findings(docs, repository, owner)
    out = found.join(verdicts(found, max_owners), "row", "left")
    judged = F.coalesce("judged", F.expr("array()").cast("array<struct<s:long,k:int,e:long,h:string,owners:long,repositories:long,verdict:string>>"))
    added = F.transform(F.filter(judged, lambda x: (x["k"] == 3) & (x["verdict"] == "live")), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    many = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    of = lambda v: F.size(F.filter(judged, lambda x: x["verdict"] == v)).cast("long")
    return out.select(
        "doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"),
        F.sha2(spelled(F.col("found")).cast("binary"), 256).alias("base_sha256"), spelled(F.array_sort(F.concat("found", added))).alias("spans"),
        of("live").alias("n_live"), of("copied").alias("n_copied"), F.coalesce(F.array_max(F.transform(F.filter(judged, lambda x: x["verdict"] == "live"), lambda x: x["repositories"])), F.lit(0)).cast("long").alias("live_repositories"),
    )


def redact(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = 2, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret masked that isn't a copied example; same columns, n_chars (if any) follows the text.

    All rows stay. Rows without a secret are untouched; the texts of the others are cut at their spans.
    """
    found = findings(docs, repository, owner)
    judged = verdicts(found, max_owners).withColumn("cut", F.expr("transform(filter(judged, x -> x.verdict <> 'copied' and (x.k < 3 or x.verdict = 'live')), x -> struct(x.s as s, x.e as e))"))
    cuts = found.select("row", "key").join(judged.where(F.size("cut") > 0).select("row", "cut"), "row")
    cuts = durable(cuts.groupBy(F.col("key.a").alias("__mask_a"), F.col("key.b").alias("__mask_b")).agg(F.first("cut").alias("__mask_cut")), "cuts")
    names, types = docs.columns, dict(docs.dtypes)
    spans = cuts.agg(F.sum(F.size("__mask_cut") + 2)).first()[0] or 0
    keyed = docs.withColumn("__mask_key", _key()).withColumns({"__mask_a": F.col("__mask_key.a"), "__mask_b": F.col("__mask_key.b")})
    work = keyed.join(F.broadcast(cuts) if spans <= BROADCAST_SPANS else cuts, ["__mask_a", "__mask_b"], "left")
    cut = work.where("__mask_cut is not null").select(*names, "__mask_cut")
    whole = work.where("__mask_cut is null").select(*names)
    release(found)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names)
    return whole.unionByName(cut.transform(in_batches, _mask_all(mask, names), schema))


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _mask_all(mask: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = []
            for text, cut in zip(part.column("text").to_pylist(), part.column("__mask_cut").to_pylist()):
                texts.append(None if text is None else masked(text, [(x["s"], x["e"]) for x in cut], mask))
            new = pa.array(texts, part.schema.field("text").type)
            cols = {n: part.column(n) for n in names} | {"text": new}
            if "n_chars" in cols:
                cols["n_chars"] = pc.utf8_length(new).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return run
