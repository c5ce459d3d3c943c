"""Further queries of the document-memory operators: over whole texts, over trees of files and over the whole pipeline, each with its SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import vocabulary as v
from ..config import EngineConfig, PackRequest, RecallConfig
from ..functions import archetypes, facts
from ..functions import sections as S
from ..functions import text as T
from ..operators import artifacts, audit, duplicates, feed, gates, neardup, packs, provenance, recall
from ..sources import frontmatter, log, tree
from ..storage import durable, shared_path
from ..streaming import feeds as stream_feeds
from . import curation
from .catalog import _BM25, _CHAT, _FILES, _INDEX, _KIND, _LOG, _NEAR, _PATH, _TOP, _cold, _hot, _numbered, _NUMBERED, action_index, action_log, chats, corpus, query, rendered, table

# Facts of whole texts. RE2's \b and \w are ASCII: letters beyond it become _ for what looks at bounds, and runs of word characters are looked at whole for capitals.

_DECIDES = "\\b(?:decided|decide|chose|chosen|rejected|adopt(?:ed)?|selected|will|must|shall|deferred|settled)\\b"


def _fact_lists(t: str) -> dict[str, str]:
    """SQL for the facts of each kind in the text ``t``, which holds no fence."""
    # Letters, digits and marks beyond ASCII are word characters that no pattern names.
    low = f"regexp_replace({t}, '[^\\x00-\\x7F]', '_', 'g')"
    return {
        "dates": f"regexp_extract_all({low}, '\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}\\b')",
        "money": f"regexp_extract_all({t}, '\\$\\d[\\d,]*\\d(?:\\.\\d+)?|\\$\\d(?:\\.\\d+)?')",
        "percents": f"regexp_extract_all({low}, '\\b\\d+(?:\\.\\d+)?%')",
        "capitals": f"list_filter(regexp_extract_all({t}, '[\\pL\\pN_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9_]{{2,}}'))",
        "names": f"regexp_extract_all({low}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')",
        "decisions": f"list_transform(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(regexp_replace(x, '[^\\x00-\\x7F]', '_', 'g'), '(?i){_DECIDES}')), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))",
        "numbers": f"regexp_extract_all({low}, '\\b\\d+(?:,\\d{{3}})*(?:\\.\\d+)?\\b')",
    }


def _distinct(source: str, name: str, kinds: list[str], t: str, lead: str = "[]") -> str:
    """CTEs that give ``name`` (doc_id, f): the facts of those kinds in order, the first of each key."""
    lists = _fact_lists(t)
    both = " || ".join([lead, *(f"coalesce({lists[k]}, [])" for k in kinds)])
    key = "lower(trim(regexp_replace(f, '\\s+', ' ', 'g')))"
    return f"""{name}_all AS (SELECT doc_id, {both} AS fs FROM {source}), {name}_rows AS (SELECT doc_id, trim(unnest(fs)) AS f, unnest(range(1, len(fs) + 1)) AS i FROM {name}_all),
{name}_first AS (SELECT doc_id, f, i, {key} AS k, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY i) AS again FROM {name}_rows WHERE trim(f) <> ''),
{name} AS (SELECT d.doc_id, coalesce(list(r.f ORDER BY r.i) FILTER (r.f IS NOT NULL), []) AS f FROM {source} d LEFT JOIN {name}_first r ON r.doc_id = d.doc_id AND r.again = 1 GROUP BY d.doc_id)"""


_STATED = ["dates", "money", "capitals", "names", "decisions", "numbers"]
_CHECKED = ["money", "percents", "dates", "capitals", "names"]
_SAID = "'Paid $1,200.50 on 3/14/2024, 12.5% of ACME_7.' || chr(10) || 'We MUST keep it for Ada Lovelace.' || chr(10) || ' ' || chr(10)"
_SAYS = "Paid $1,200.50 on 3/14/2024, 12.5% of ACME_7.\nWe MUST keep it for Ada Lovelace.\n```py\nx = 1\n```\n"


@query(f"WITH src AS (SELECT doc_id, {_SAID} || text AS t FROM documents), {_distinct('src', 'st', _STATED, 't', chr(91) + chr(39) + 'x = 1' + chr(39) + chr(93))} SELECT doc_id, CAST(len(f) AS INTEGER) AS n_facts, sha256(array_to_string(f, chr(10))) AS facts_sha FROM st")
def facts_stated(spark, sf):
    found = facts.stated(F.concat(F.lit(_SAYS), F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(found).alias("n_facts"), F.sha2(F.array_join(found, "\n"), 256).alias("facts_sha"))


_KEY = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
_HALVES = f"""h AS (SELECT doc_id, {_SAID} || text AS whole, left(text, length(text) // 2) || ' Then Grace Hopper left for 4/5/2021 with $77 and 3%.' AS half FROM documents), w AS (SELECT doc_id, whole AS t FROM h), a AS (SELECT doc_id, half AS t FROM h)"""
_MEASURED = f"""{_HALVES}, {_distinct('w', 'st', _STATED, 't')}, {_distinct('a', 'ck', _CHECKED, 't')},
m AS (SELECT h.doc_id, st.f AS facts, ck.f AS checks, list_filter(st.f, lambda x: NOT contains({_KEY.format(x='h.half')}, {_KEY.format(x='x')})) AS missing, list_filter(ck.f, lambda x: NOT contains({_KEY.format(x='h.whole')}, {_KEY.format(x='x')})) AS unsupported FROM h JOIN st USING (doc_id) JOIN ck USING (doc_id)),
r AS (SELECT *, CASE WHEN len(facts) = 0 THEN 1.0 ELSE (len(facts) - len(missing)) / len(facts) END AS coverage, CASE WHEN len(checks) = 0 THEN 1.0 ELSE (len(checks) - len(unsupported)) / len(checks) END AS faithfulness FROM m)"""


def _halves(spark, sf):
    """Each text with some facts in front, and an artifact that keeps half of it and makes some up."""
    text = F.col("text")
    half = F.concat(F.left(text, F.floor(F.length(text) / 2).cast("int")), F.lit(" Then Grace Hopper left for 4/5/2021 with $77 and 3%."))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit(_SAYS.split("```")[0] + " \n"), text).alias("source"), half.alias("artifact"))


@query(f"WITH RECURSIVE {_MEASURED} SELECT doc_id, round(coverage, 9) AS coverage, CAST(len(missing) AS INTEGER) AS n_missing, sha256(array_to_string(missing, chr(10))) AS missing_sha FROM r".replace("RECURSIVE ", ""))
def coverage(spark, sf):
    """How much of each whole text its half keeps."""
    return gates.measured(_halves(spark, sf)).select("doc_id", F.round("coverage", 9).alias("coverage"), F.size("missing").alias("n_missing"), F.sha2(F.array_join("missing", "\n"), 256).alias("missing_sha"))


@query(f"WITH {_MEASURED} SELECT doc_id, round(faithfulness, 9) AS faithfulness, array_to_string(unsupported, '|') AS unsupported FROM r")
def faithfulness(spark, sf):
    """What each half claims that the whole text doesn't."""
    return gates.measured(_halves(spark, sf)).select("doc_id", F.round("faithfulness", 9).alias("faithfulness"), F.array_join("unsupported", "|").alias("unsupported"))


@query(f"""WITH {_MEASURED}, k AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'EXPLORATORY_CHAT' WHEN 1 THEN 'DECISION_LOG' ELSE 'REFERENCE_NOTE' END AS archetype FROM r WHERE doc_id % 5 <> 4)
SELECT '/in/' || CAST(doc_id AS VARCHAR) || '.md' AS path, archetype, CASE WHEN doc_id % 3 <> 0 THEN round(coverage, 9) END AS coverage, CASE WHEN doc_id % 3 = 0 THEN round(faithfulness, 9) END AS faithfulness, CASE WHEN doc_id % 3 <> 0 THEN CAST(len(missing) AS INTEGER) END AS n_missing, CASE WHEN doc_id % 3 = 0 THEN CAST(len(unsupported) AS INTEGER) END AS n_unsupported FROM k""")
def gate_reports(spark, sf):
    """Reports of artifacts whose source is found by the hash they cite, or else by the path they state; a fifth cites nothing that can be read."""
    k = F.col("doc_id")
    halves = _halves(spark, sf)
    sha = F.concat(F.lit("AB"), F.translate(F.lpad(k.cast("string"), 62, "0"), "0123456789", "GHIJKLMNOP"))
    at = F.concat(F.lit("/src/"), F.translate(k.cast("string"), "0123456789", "ghijklmnop"))
    cite = F.when(k % 5 == 4, "- sha256: none\n").when(k % 5 == 3, F.concat(F.lit("- path: "), at, F.lit("\n"))).otherwise(F.concat(F.lit("- sha256: "), F.lower(sha), F.lit("\n")))
    head = F.concat(F.lit("---\nsources:\n"), cite, F.lit("---\n"))
    arts = halves.select(F.concat(F.lit("/in/"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(head, "artifact").alias("text"), F.when(k % 3 == 0, "EXPLORATORY_CHAT").when(k % 3 == 1, "DECISION_LOG").otherwise("REFERENCE_NOTE").alias("archetype"), k)
    index = halves.where(k % 5 < 3).select(sha.alias("sha256"), at.alias("path"), F.lit(1).alias("current"))
    files = halves.select(at.alias("path"), F.col("source").alias("text"))
    # The header serves to find the source and is not measured: its "sha256" alone would hide that a text's 256 or 6 is lost.
    found = gates.reports(arts.select("path", S.body(F.col("text")).alias("text"), "archetype"), gates.cited(arts, index, files))
    return found.select("path", "archetype", F.round("coverage", 9).alias("coverage"), F.round("faithfulness", 9).alias("faithfulness"), F.when(F.col("missing").isNotNull(), F.size("missing")).alias("n_missing"), F.when(F.col("unsupported").isNotNull(), F.size("unsupported")).alias("n_unsupported"))


@query("""WITH r AS (SELECT doc_id, doc_id % 9 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'chunk_lint' WHEN 1 THEN 'chunk_lint' WHEN 2 THEN 'no_ledger' WHEN 3 THEN 'no_confidence' WHEN 4 THEN 'bad_confidence' WHEN 5 THEN 'coverage' WHEN 7 THEN 'name_taken' END AS reject_reason,
CASE k WHEN 2 THEN 'decisions' WHEN 3 THEN 'governance' WHEN 4 THEN 'governance' WHEN 8 THEN 'governance' ELSE 'reference' END AS domain FROM r""")
def gate_chain(spark, sf):
    """The gates that ``gate_outcomes`` doesn't reach: shape, ledger, both about confidence; and who passes."""
    k = F.col("doc_id") % 9
    type_ = F.when(k == 2, "decision-record").when(k.isin(3, 4, 8), "Governance").otherwise("doctrine")
    sure = F.when(k == 4, "confidence: perhaps\n").when(k == 8, "confidence: High\n").otherwise("")
    sha = F.sha2("text", 256)
    head = F.concat(F.lit("---\nid: KB-x\ntype: "), type_, F.lit("\n"), sure, F.lit("sources:\n- sha256: "), sha, F.lit("\n---\n# T\n\n"))
    body = F.when(k == 0, F.concat(F.lit("## Part\n"), F.repeat(F.lit("word "), 800))).when(k == 1, "no heading\n").otherwise("## Part\nok\n")
    text = F.concat(head, body, F.when(k == 2, "").otherwise("\n## Stripping Ledger\ndropped: talk\n"))
    arts = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/inbox/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), F.lit(True).alias("reported"), F.when(k.isin(2, 6), "EXPLORATORY_CHAT").otherwise("REFERENCE_NOTE").alias("archetype"),
        F.when(k == 5, 0.9499).otherwise(0.95).alias("coverage"), F.lit(0.9).alias("faithfulness"), F.array().cast("array<string>").alias("missing"), F.array().cast("array<string>").alias("unsupported"),
    )
    policy = gates.Policy(confidence_for=("governance",), confidences=("low", "medium", "high"))
    hot = arts.where(k == 7).select(F.concat(F.lit("reference/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"))
    return gates.decided(gates.free_names(arts, hot, policy), policy).select("doc_id", "reject_reason", "domain")


@query("""WITH a AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS n, upper(sha256(text)) AS sha, text AS t, chr(10) AS e FROM documents),
h AS (SELECT *, '---' || e || 'id: KB-' || n || e || CASE WHEN k % 4 = 1 THEN '' ELSE 'status: seeded' || e END || 'type: ' || CASE WHEN k % 6 = 0 THEN 'Mystery' ELSE 'doctrine' END || e || CASE k % 5 WHEN 1 THEN 'sources: []' WHEN 2 THEN 'sources:' || e || '- path: x.md' ELSE 'sources:' || e || '- sha256: ' || sha || e || '  title: t' END || e || CASE WHEN k % 4 = 1 THEN 'status: seeded' || e ELSE '' END || 'distill: 3' || e || '---' || e || e AS head,
CASE WHEN k % 3 = 0 THEN '' ELSE '# Title' || e END || e || '## Part' || e || t || e || e || '## Stripping Ledger' || e || 'REF_' || left(sha, 6) || e AS body FROM a)
SELECT k AS doc_id, n AS slug, sha256(CASE WHEN k % 7 = 0 THEN '---' || e || ': [' || e || '---' || e || body ELSE head || regexp_replace(body, '^\\n+', '') END) AS normalized_sha FROM h""")
def normalized_texts(spark, sf):
    """The whole text of each artifact after normalization: conventional id and status, a distill level, the same body."""
    return artifacts.normalization(rendered(spark, sf)).select("doc_id", "slug", F.sha2("normalized", 256).alias("normalized_sha"))


_TITLED = _NEAR.replace(_PATH, "'/notes/' || CASE WHEN doc_id % 50 = 7 THEN CAST(doc_id AS VARCHAR) || '/README' ELSE CASE doc_id % 4 WHEN 0 THEN 'Claude-' WHEN 1 THEN 'x' ELSE '' END || source || '-Note (' || CAST(doc_id AS VARCHAR) || ')' END || '.md'").replace("FROM documents)", "FROM documents WHERE doc_id % 50 <> 7)", 1)


def titled(spark, sf):
    """Documents as files whose titles are those of their source once prefixes, numbers and marks have gone; some have a generic name."""
    k = F.col("doc_id")
    head = F.when(k % 4 == 0, "Claude-").when(k % 4 == 1, "x").otherwise("")
    name = F.when(k % 50 == 7, F.concat(k.cast("string"), F.lit("/README"))).otherwise(F.concat(head, "source", F.lit("-Note ("), k.cast("string"), F.lit(")")))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/notes/"), name, F.lit(".md")).alias("path"), "text", F.octet_length("text").cast("long").alias("size"), T.sha(F.col("text")).alias("sha256"))


@query(_TITLED + " SELECT cluster, path FROM c")
def near_dup_by_title(spark, sf):
    return neardup.clusters(titled(spark, sf), 0.8)


@query(_TITLED + """, f AS (SELECT w.path, CAST(octet_length(encode(d.text)) AS BIGINT) AS size FROM w JOIN documents d ON d.doc_id = CAST(regexp_extract(w.path, '\\(([0-9]+)\\)', 1) AS BIGINT)), m AS (SELECT cluster, path, size FROM c JOIN f USING (path)),
k AS (SELECT *, first_value(path) OVER (PARTITION BY cluster ORDER BY starts_with(regexp_extract(path, '[^/]*$'), 'x'), size DESC, path) AS canonical FROM m) SELECT path, canonical, '/cold/near' || substr(path, length('/notes') + 1) AS dst FROM k WHERE path <> canonical""")
def near_dup_moves(spark, sf):
    """Where near-duplicates go: their place below the common folder is kept below the cold one."""
    files = titled(spark, sf)
    plan = neardup.keepers(neardup.clusters(files, 0.8).join(files.select("path", "size"), "path"))
    return neardup.moves(plan, files, "/cold/near/").select("path", "canonical", "dst")


@query(f"""WITH p AS ({_NUMBERED}), f AS (SELECT path, min(struct_pack(s := sha256, z := size)) AS m FROM p GROUP BY path), g AS (SELECT path, m.s AS sha256, m.z AS size FROM f),
o AS (SELECT *, list_position(['/d3', '/d1', '/d5'], left(path, 3)) AS r, CAST(regexp_matches(path, ' \\([0-9]+\\)\\.md$') AS INTEGER) AS numbered FROM g WHERE left(path, 3) IN ('/d3', '/d1', '/d5')),
l AS (SELECT *, row_number() OVER w AS k, first_value(path) OVER w AS keeper FROM o WINDOW w AS (PARTITION BY sha256 ORDER BY r, numbered, path)), d AS (SELECT * FROM l WHERE k > 1),
x AS (SELECT v.path, v.sha256, v.size, b.path AS base FROM o v JOIN o b ON b.path = regexp_replace(v.path, ' \\([0-9]+\\)\\.md$', '.md') WHERE v.numbered = 1 AND v.sha256 <> b.sha256)
SELECT 'live_delete' AS action, path, sha256, size, keeper FROM d UNION ALL SELECT 'lineage_move', path, sha256, size, base FROM x WHERE path NOT IN (SELECT path FROM d)""")
def cleanup_lineage(spark, sf):
    """The clean-up of numbered files: copies go, older revisions that aren't copies move."""
    files = _numbered(spark, sf).groupBy("path").agg(F.min(F.struct("sha256", "size")).alias("m")).select("path", "m.sha256", "m.size")
    return duplicates.cleanup(files, ["/d3", "/d1", "/d5"], "/held")


@query("""WITH p AS (SELECT p_partkey AS k, p_name FROM part), n AS (SELECT k, '/a/' || p_name || '/' || CASE k % 5 WHEN 0 THEN 'README.md' WHEN 1 THEN 'summary.md' WHEN 2 THEN 'ReadMe.txt' WHEN 3 THEN 'todo' ELSE p_name || '.md' END AS path, p_name FROM p)
SELECT k, k % 5 IN (0, 1, 2, 3) AS generic, CASE WHEN k % 5 IN (0, 1) THEN p_name || '__' ELSE '' END || regexp_extract(path, '[^/]*$') AS artifact, CASE WHEN k % 2 = 0 THEN path ELSE path || '?x=1' END AS asked, path AS bare, '/mnt/q' || path AS local,
CASE WHEN k % 3 = 0 THEN 'GOVERNANCE_PROMPT' ELSE 'REFERENCE_NOTE' END AS archetype, CASE WHEN k % 5 = 3 THEN 'hot' WHEN k % 5 = 1 THEN 'cold' ELSE 'live' END AS tier FROM n""")
def name_rules(spark, sf):
    """Generic names, names of artifacts, paths without their query part, paths of other hosts, another governance token, and tiers by the roots that are set."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "README.md").when(k % 5 == 1, "summary.md").when(k % 5 == 2, "ReadMe.txt").when(k % 5 == 3, "todo").otherwise(F.concat("p_name", F.lit(".md")))
    path = F.concat(F.lit("/a/"), "p_name", F.lit("/"), name)
    asked = F.when(k % 2 == 0, path).otherwise(F.concat(path, F.lit("?x=1")))
    cfg = EngineConfig(hot_root="/HOT/s", held_root="D:\\cold")
    root = F.when(k % 5 == 3, "/hot/s").when(k % 5 == 1, "/mnt/d/COLD").otherwise("")
    return table(spark, sf, "part").select(
        k.alias("k"), T.is_generic(T.base_name(path)).alias("generic"), T.artifact_name(path).alias("artifact"), asked.alias("asked"), T.without_query(asked).alias("bare"), T.local_path(F.concat(F.lit("Q:"), F.replace(path, F.lit("/"), F.lit("\\")))).alias("local"),
        archetypes.archetype(F.when(k % 3 == 0, "an own_token here").otherwise("SYSTEM_PROMPT"), "own_token").alias("archetype"), T.tier(F.concat(root, path), cfg.effective_tier_rules()).alias("tier"),
    )


@query(f"""WITH {_LOG} SELECT upper(op) AS op, src_abs, dst_abs, upper(sha256) AS sha256, event_id AS size_bytes, 's' AS stage, op <> 'delete' AS reversible, 'r ü' AS reason FROM log""")
def log_records(spark, sf):
    """Records written into the log by the executors and read again from its files."""
    e = table(spark, sf, "events").select("event_id")
    folder = shared_path(spark, "log")
    rows = action_log(spark, sf).withColumn("size_bytes", F.regexp_extract("src_abs", r"(\d+)\.md$", 1).cast("long")).join(e.withColumnRenamed("event_id", "size_bytes"), "size_bytes")
    rows = rows.withColumns({"sha256": F.upper("sha256"), "mtime_utc": F.lit(log.now_utc()), "ts_utc": F.lit(log.now_utc()), "stage": F.lit("s"), "reversible": F.col("op") != "delete", "reason": F.lit("r ü")})
    log.append_batch(rows, folder)
    return log.read(spark, folder).select(F.upper("op").alias("op"), "src_abs", "dst_abs", "sha256", "size_bytes", "stage", "reversible", "reason")


@query(f"""WITH {_INDEX}, cited AS (SELECT DISTINCT upper(sha256(text)) AS sha256 FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 NOT IN (1, 2)) SELECT sha256 FROM files WHERE op <> 'delete' UNION SELECT sha256 FROM cited""")
def seen_by_artifacts(spark, sf):
    """Hashes that were dealt with: those of the log and those that curated artifacts cite."""
    arts = rendered(spark, sf).select(frontmatter.parsed(F.col("text"))["sources"].alias("sources"))
    return provenance.seen(action_index(spark, sf), arts)


def _tree(spark, sf, rows, label):
    """``rows`` (rel, text) as files below a new folder that driver and executors share."""
    top = shared_path(spark, label).removeprefix("file://")
    tree.write_texts(rows.select(F.concat(F.lit(f"{top}/"), "rel").alias("path"), "text")).write.format("noop").mode("append").save()
    return top


@query("""WITH f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN '.venv/' WHEN doc_id % 11 = 1 THEN '_x/.y/' ELSE '' END || source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 13 = 0 THEN '.MD' WHEN doc_id % 13 = 1 THEN '.txt' ELSE '.md' END AS rel, doc_id, text FROM documents)
SELECT rel, upper(sha256(text)) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM f WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 1 AND NOT starts_with(rel, 'src3/')""")
def tree_scan(spark, sf):
    """Whole texts written as a tree of files and found again: odd folders are entered, skipped and excluded ones aren't, and only Markdown counts."""
    k = F.col("doc_id")
    rel = F.concat(F.when(k % 11 == 0, ".venv/").when(k % 11 == 1, "_x/.y/").otherwise(""), "source", F.lit("/"), k.cast("string"), F.when(k % 13 == 0, ".MD").when(k % 13 == 1, ".txt").otherwise(".md"))
    top = _tree(spark, sf, table(spark, sf, "documents").select(rel.alias("rel"), "text"), "tree")
    return durable(tree.files(spark, [top], globs=["src3/**"], content=False).select("rel", "sha256", "size"), "found")


@query(f"""WITH f AS (SELECT upper(sha256(text)) AS sha256, list('/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' ORDER BY '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md') AS p FROM documents GROUP BY 1) SELECT sha256, array_to_string(p, ' ') AS paths FROM f""")
def tree_duplicate_index(spark, sf):
    """The paths of each hash in a tree, its bytes read by the executors."""
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    top = _tree(spark, sf, table(spark, sf, "documents").select(rel.alias("rel"), "text"), "tree")
    found = tree.duplicate_index(tree.files(spark, [top]))
    return durable(found.select("sha256", F.array_join(F.transform("paths", lambda p: F.substring(p, F.lit(len(top) + 1), F.length(p))), " ").alias("paths")), "found")


_CADENCE = f"""{_CHAT}, notes AS (SELECT 'live/n' || CAST(doc_id AS VARCHAR) || '.md' AS rel, '# T' || chr(10) || chr(10) || '## S' || chr(10) || text || chr(10) AS text FROM documents), conv AS (SELECT 'live/c' || CAST(conv_id AS VARCHAR) || '.md' AS rel, text FROM chats),
f AS (SELECT * FROM notes UNION ALL SELECT * FROM conv), s AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY rel) AS k FROM f), n AS (SELECT text, rel, {_KIND} AS kind FROM s WHERE k = 1)"""


@query(f"""WITH {_CADENCE}, x AS (SELECT count(*) FILTER (k > 1) AS gone FROM s), y AS (SELECT count(*) AS n, count(*) FILTER (kind = 'EXPLORATORY_CHAT') AS queued FROM n)
SELECT unnest(['live_delete', 'lineage_move', 'new', 'queued', 'seeded', 'new_again', 'deleted_files', 'log_seen', 'log_delete']) AS metric, unnest([gone, 0, n, queued, n - queued, 0, gone, n, gone]) AS n FROM x, y""")
def cadence_run(spark, sf):
    """The whole pipeline over a tree of all documents and conversations, and once more: copies deleted, new files seeded or queued, nothing new the second time."""
    notes = table(spark, sf, "documents").select(F.concat(F.lit("live/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"), F.concat(F.lit("# T\n\n## S\n"), "text", F.lit("\n")).alias("text"))
    talk = chats(spark, sf).select(F.concat(F.lit("live/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("rel"), "text")
    files = durable(notes.unionAll(talk), "files")
    top = _tree(spark, sf, files, "corpus")
    for d in ("_hot/_inbox/_queue", "_held", "_provenance"):
        os.makedirs(f"{top}/{d}", exist_ok=True)
    cfg = EngineConfig(org_root=top, live_roots=[f"{top}/live"], hot_root=f"{top}/_hot", inbox_dir=f"{top}/_hot/_inbox", held_root=f"{top}/_held", index_db=f"{top}/_provenance/index", manifests_dir=f"{top}/_provenance")
    first = curation.run(spark, cfg, apply=True, runner=lambda args: "done")
    again = curation.detect(spark, cfg)[0].count()
    ops = {r["op"]: r["count"] for r in log.read(spark, cfg.manifests_dir).groupBy("op").count().collect()}
    left = tree.files(spark, cfg.live_roots, content=False).count()
    out = {"live_delete": first["layer0"]["live_delete"], "lineage_move": first["layer0"]["lineage_move"], "new": first["new"], "queued": first["queued"], "seeded": first["seeded"], "new_again": again, "deleted_files": files.count() - left, "log_seen": ops["cadence-seen"], "log_delete": ops.get("delete", 0)}
    return spark.createDataFrame(list(out.items()), "metric string, n long")


@query(_TITLED + """, bad AS (SELECT path FROM w WHERE CAST(regexp_extract(path, '\\(([0-9]+)\\)', 1) AS BIGINT) % 40 = 3), g AS (SELECT cluster, string_agg(path, ', ' ORDER BY path) AS p FROM c GROUP BY cluster)
SELECT path, 'read_error' AS rule, 'denied' AS detail FROM bad UNION ALL SELECT w.path, 'oversize', CAST(octet_length(encode(d.text)) AS VARCHAR) || ' bytes > 4000' FROM w JOIN documents d ON d.doc_id = CAST(regexp_extract(w.path, '\\(([0-9]+)\\)', 1) AS BIGINT) WHERE octet_length(encode(d.text)) > 4000
UNION ALL SELECT cluster, 'near_duplicate', 'near-dup cluster: ' || p FROM g UNION ALL SELECT path, 'frontmatter_invalid', 'missing or unparseable YAML frontmatter' FROM w WHERE path NOT IN (SELECT path FROM bad)""".replace("FROM documents WHERE doc_id % 50 <> 7)", "FROM documents WHERE doc_id % 50 <> 7)"))
def audit_surface(spark, sf):
    """All findings over the documents as artifacts: without headers, some unreadable, some too large, some alike."""
    rows = titled(spark, sf).where("doc_id % 50 <> 7").withColumn("error", F.when(F.col("doc_id") % 40 == 3, "denied"))
    # A file that can't be read has no text that could be like another's.
    return audit.surface(rows, oversize=4000, threshold=0.8)


def _md(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _pack_sql(role: packs.Role, task: str, project: str) -> str:
    """SQL for the Markdown of a pack, from the CTEs h (hot) and c (cold)."""
    line = "'- `' || path || '` — score ' || printf('%.3f', score) || ' — sha256 `' || left(upper(sha256(path)), 16) || '…`'"
    cold = "'- `' || path || '` — score ' || printf('%.3f', score)"
    bullets = lambda xs: _md("\n".join(f"- {x}" for x in xs) or "_(none)_")
    head = f"# Context Pack — {project} / {role.name}\n\n> A view of governed memory for one role. Sources are identified by sha256; paths are hints. Leave the raw corpus closed unless this pack says otherwise.\n\n## Objective\n\nGive whoever has the {role.name} role what the task needs, from governed memory.\n\n## Role\n\n{role.framing}\n\n## Task\n\n{task}\n\n"
    tail = f"## Verification requirements\n\n' || {bullets(role.verification)} || '\n\n## Next action\n\n{role.next_action.format(task=task, project=project)}\n"
    return f"""SELECT {_md(head)} || '## Included hot artifacts (' || CAST(hn AS VARCHAR) || ')' || chr(10) || chr(10) || ht || chr(10) || chr(10) || '## Cold evidence (' || CAST(cn AS VARCHAR) || ')' || chr(10) || chr(10) || ct || chr(10) || chr(10) || '## Exclusions' || chr(10) || chr(10) || {bullets(role.exclusions)} || chr(10) || chr(10) || '## Assumptions' || chr(10) || chr(10) || '_(none)_' || chr(10) || chr(10) || '## Risks' || chr(10) || chr(10) || '_(none)_' || chr(10) || chr(10) || '{tail.replace(chr(10), "' || chr(10) || '")}' AS pack
FROM (SELECT count(*) AS hn, string_agg({line}, chr(10) ORDER BY score DESC, path) AS ht FROM (SELECT * FROM h ORDER BY score DESC, path LIMIT 8)), (SELECT count(*) AS cn, string_agg({cold}, chr(10) ORDER BY score DESC, path) AS ct FROM (SELECT * FROM c ORDER BY score DESC, path LIMIT 3))"""


@query(_BM25 + _TOP.replace("WITH q", ", q") + ", c AS (SELECT * FROM cold WHERE path NOT IN (SELECT path FROM h) ORDER BY score DESC, path LIMIT 5) " + _pack_sql(packs.ROLES["verification"], "The das", "tables"))
def context_pack(spark, sf):
    """One pack over recall on the tables: verification of the words 'The das'."""
    hot = _hot(spark, sf).withColumns({"sha256": T.sha(F.col("path")), "admissibility": F.lit("internal")})
    hits = recall.two_tiers(hot, _cold(spark, sf))
    text = packs.compile_pack(spark, PackRequest("tables", "verification", "The das"), hits=hits, weak_hot=recall.weak(hot).first()["weak_hot"])
    return spark.createDataFrame([(text,)], "pack string")


@query(_BM25 + " SELECT path, score FROM cold")
def term_index_recall(spark, sf):
    """The same question as ``cold_bm25`` asks, of a stored term index: only the postings of its words are read."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("path"), F.lit(None).cast("string").alias("sha256"), "text")
    folder = shared_path(spark, "terms")
    recall.write_terms(docs, folder)
    return recall.search_terms(spark, folder, "The das", 10).select("path", F.round("score", 9).alias("score"))


@query(_BM25.replace("LIMIT 10)", "LIMIT 40)") + """, l AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS place, CASE CAST(substr(path, 2) AS BIGINT) % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'private' ELSE 'proprietary' END AS level FROM cold)
SELECT 'cold' AS tier, path, level FROM (SELECT *, row_number() OVER (ORDER BY place) AS n FROM l WHERE level <> 'proprietary') WHERE n <= 6""")
def pack_caps(spark, sf):
    """The first admitted hits of a tier: what admissibility shuts out leaves its place to the next."""
    k = F.substring(F.col("path"), F.lit(2), F.length("path")).cast("long")
    docs = table(spark, sf, "documents").withColumn("path", F.concat(F.lit("v"), F.col("doc_id").cast("string")))
    hits = recall.bm25(docs, "The das", 40).withColumns({"tier": F.lit("cold"), "admissibility": F.when(k % 4 == 0, "public").when(k % 4 == 1, None).when(k % 4 == 2, "Private").otherwise("secret"), "score": F.round("score", 9)})
    hits = hits.withColumn("place", F.row_number().over(packs.Window.partitionBy("tier").orderBy(F.desc("score"), "path")))
    return packs.within_caps(packs.admitted(hits, "private"), 9, 6).select("tier", "path", "level")


@query("""SELECT * FROM (VALUES ('hot', 'query|--json|it''s'), ('cold', 'search|--json|--index|cold|it''s'), ('update', 'update'), ('embed', 'embed|-c|hot'), ('status', 'status'), ('shell', 'cd ''/a b'' && rec query --json ''it''"''"''s'''), ('probe', 'no backend is configured'), ('said', 'rec 1.2'), ('gone', 'false')) t(name, line)""")
def backend_calls(spark, sf):
    """What is asked of an outside recall backend, how it is quoted for a shell, and what a probe makes of its answer."""
    cfg = RecallConfig(cwd="/a b", bin="rec")
    rows = [("hot", recall.hot_command("it's", cfg)), ("cold", recall.cold_command("it's", cfg)), *recall.reindex_commands(cfg).items(), ("shell", [recall.shell_command(cfg, recall.hot_command("it's", cfg))])]
    rows += [("probe", [recall.probe(RecallConfig())["detail"]]), ("said", [recall.probe(cfg, lambda a: "rec 1.2\nmore")["detail"]]), ("gone", [str(recall.probe(cfg, lambda a: "rec: command not found")["available"]).lower()])]
    return spark.createDataFrame([(n, "|".join(x)) for n, x in rows], "name string, line string")


@query("""WITH e AS (SELECT event_id, event_type AS kind, 'user ' || CAST(user_id AS VARCHAR) AS wu, upper(sha256(props)) AS link, props FROM events),
t AS (SELECT *, '---' || chr(10) || 'id: feed-' || kind || '-' || replace(wu, ' ', '_') || chr(10) || 'type: reference-note' || chr(10) || 'status: draft' || chr(10) || 'sources:' || chr(10) || '- sha256: X' || link || chr(10) || '  title: ' || kind || ' ' || wu || chr(10) || '  path: ev-' || CAST(event_id AS VARCHAR) || chr(10) || '---' || chr(10) || chr(10) || '# ' || kind || ': ' || wu || chr(10) || chr(10) || props || chr(10) AS body FROM e)
SELECT event_id, upper(sha256(body)) AS candidate_sha256, kind || '.' || replace(wu, ' ', '_') || '.' || left(upper(sha256(body)), 16) || '.md' AS candidate_name, 'advisory ingested feed evidence: kind=' || kind || '; work_unit=' || wu || '; link=X' || link || '; received_from=desk; freshness=f' AS reason FROM t""")
def feed_candidates(spark, sf):
    """Ungated drafts of fed records, and the log's reason for each. The hash has a letter in front, so that YAML never takes it for a number."""
    e = table(spark, sf, "events")
    rows = e.select(
        "event_id", F.col("event_type").alias("kind"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("work_unit_id"), F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("source_ref"), F.col("props").alias("summary"),
        F.concat(F.lit("X"), T.sha(F.col("props"))).alias("link_sha256"), F.lit("").alias("emitted_by"), F.lit("f").alias("freshness"),
    )
    why = feed.reason(feed.Custody("/cold", "/log", received_from="desk"))
    return feed.candidates(rows).select("event_id", "candidate_sha256", "candidate_name", why.alias("reason"))


@query(f"""WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS k FROM files WHERE sha256 NOT IN (SELECT upper(sha256(text)) FROM documents WHERE source = 'src2')) SELECT sha256, path FROM r WHERE k = 1""")
def stream_unseen(spark, sf):
    """Files that arrive as a stream, against a ledger that a baseline has filled: each new hash is handed over once, however often the stream is run."""
    arrived, ledger, handed, state = (shared_path(spark, n) for n in ("arrived", "ledger", "handed", "state"))
    corpus(spark, sf).select(F.lit(0).alias("root_idx"), "path", "sha256", "size").repartition(3).write.parquet(arrived)
    corpus(spark, sf).where("source = 'src2'").select("sha256").distinct().write.parquet(ledger)

    def handle(rows):
        rows.select("sha256", "path").write.mode("append").parquet(handed)

    for _ in range(2):
        stream = spark.readStream.schema("root_idx int, path string, sha256 string, size long").parquet(arrived)
        stream_feeds.unseen(stream, ledger, handle, state, once=True).awaitTermination()
    return spark.read.schema("sha256 string, path string").parquet(handed)


@query(f"""WITH {_CHAT} SELECT conv_id, CAST(length(text) // 4 AS BIGINT) AS est_tokens, regexp_matches(text, '(^|\\n)# ') AS titled FROM chats""")
def chat_shapes(spark, sf):
    t = F.col("text")
    return chats(spark, sf).select("conv_id", F.floor(F.length(t) / 4).cast("long").alias("est_tokens"), S.has_title(S.body(t)).alias("titled"))
