"""Queries of the document-memory operators over the shared tables, each over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import archetypes, facts
from ..functions import sections as S
from ..functions import text as T
from ..functions.shingles import plain, shingles, tokens
from ..operators import artifacts, audit, duplicates, feed, gates, neardup, packs, provenance, recall
from ..sources import frontmatter
from ..streaming import events as stream_events
from ..streaming import feeds as stream_feeds

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Query]:
    from . import evidence  # noqa: F401  registers its own

    return {name: q[0] for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: q[1] for name, q in _QUERIES.items() if q[1]}


# Files that the tables stand for: a document is a file in the folder of its source.

_PATH = "'/corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md'"
_FILES = f"files AS (SELECT CASE WHEN source < 'src10' THEN 0 ELSE 1 END AS root_idx, {_PATH} AS path, doc_id, source, upper(sha256(text)) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size, text FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.when(F.col("source") < "src10", 0).otherwise(1).alias("root_idx"), path.alias("path"), "doc_id", "source", T.sha(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "text")


# Hashes, copies, versions


@query("SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents")
def content_sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sha(F.col("text")).alias("sha256"))


@query(f"""WITH {_FILES}, r AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS copies, row_number() OVER (PARTITION BY sha256 ORDER BY root_idx, path) AS keeper_rank FROM files)
SELECT sha256, path, copies, keeper_rank FROM r WHERE copies > 1""")
def keeper_rank(spark, sf):
    return duplicates.ranked(corpus(spark, sf), "sha256", [F.col("root_idx"), F.col("path")]).select("sha256", "path", "copies", "keeper_rank")


@query(f"""WITH {_FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY root_idx, path) AS k FROM files)
SELECT r.sha256, k.path AS canonical, r.path AS redundant, r.size AS size_bytes FROM r JOIN r k ON k.sha256 = r.sha256 AND k.k = 1 WHERE r.k > 1""")
def exact_duplicates(spark, sf):
    return duplicates.plan(corpus(spark, sf), [F.col("root_idx"), F.col("path")])


@query(f"""WITH {_FILES}, g AS (SELECT sha256, count(*) AS c, max(size) AS s FROM files GROUP BY sha256)
SELECT count(*) AS hashes, CAST(sum(c) AS BIGINT) AS files, count(*) FILTER (c > 1) AS duplicated, CAST(sum(c - 1) AS BIGINT) AS redundant, CAST(sum((c - 1) * s) AS BIGINT) AS redundant_bytes FROM g""")
def duplicate_summary(spark, sf):
    g = corpus(spark, sf).groupBy("sha256").agg(F.count("*").alias("c"), F.max("size").alias("s"))
    return g.agg(F.count("*").alias("hashes"), F.sum("c").alias("files"), F.count_if(F.col("c") > 1).alias("duplicated"), F.sum(F.col("c") - 1).alias("redundant"), F.sum((F.col("c") - 1) * F.col("s")).alias("redundant_bytes"))


_NUMBERED = "SELECT p_partkey, '/d' || CAST(p_partkey % 7 AS VARCHAR) || '/' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (' || CAST(p_partkey % 4 AS VARCHAR) || ')' ELSE '' END || '.md' AS path, upper(sha256(p_brand)) AS sha256, CAST(p_size AS BIGINT) AS size FROM part"


def _numbered(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("/d"), (k % 7).cast("string"), F.lit("/"), "p_name", F.when(k % 3 == 0, F.concat(F.lit(" ("), (k % 4).cast("string"), F.lit(")"))).otherwise(""), F.lit(".md"))
    return p.select(name.alias("path"), T.sha(F.col("p_brand")).alias("sha256"), F.col("p_size").cast("long").alias("size"))


@query(f"""WITH f AS (SELECT path, min(sha256) AS sha256 FROM ({_NUMBERED}) GROUP BY path),
v AS (SELECT path, sha256, regexp_replace(path, ' \\([0-9]+\\)\\.md$', '.md') AS base, CAST(regexp_extract(path, ' \\(([0-9]+)\\)\\.md$', 1) AS INTEGER) AS n FROM f WHERE regexp_matches(path, ' \\([0-9]+\\)\\.md$'))
SELECT v.base, v.path AS variant, v.n, CASE WHEN v.sha256 = b.sha256 THEN 'accidental' ELSE 'lineage' END AS kind, b.sha256 AS base_sha, v.sha256 AS variant_sha FROM v JOIN f b ON b.path = v.base""")
def version_pairs(spark, sf):
    return duplicates.versions(_numbered(spark, sf).groupBy("path").agg(F.min("sha256").alias("sha256")))


_ROOTS = ("src18", "src11", "src13", "src7", "src1")


@query(f"""WITH {_FILES}, live AS (SELECT *, list_position({list(_ROOTS)}, source) AS pr FROM files WHERE source IN {_ROOTS}),
l AS (SELECT sha256, path, size, row_number() OVER (PARTITION BY sha256 ORDER BY pr, path) AS k, first_value(path) OVER (PARTITION BY sha256 ORDER BY pr, path) AS keeper FROM live),
h AS (SELECT sha256, path, size, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS k, first_value(path) OVER (PARTITION BY sha256 ORDER BY path) AS keeper FROM files WHERE source IN ('src8', 'src9'))
SELECT 'live_delete' AS action, path, sha256, size, keeper FROM l WHERE k > 1 UNION ALL SELECT 'held_delete', path, sha256, size, keeper FROM h WHERE k > 1""")
def cleanup_plan(spark, sf):
    files = corpus(spark, sf).withColumn("path", F.when(F.col("source").isin("src8", "src9"), F.concat(F.lit("/held"), "path")).otherwise(F.col("path")))
    plan = duplicates.cleanup(files, [f"/corpus/{s}" for s in _ROOTS], "/held")
    return plan.withColumns({c: F.regexp_replace(c, "^/held", "") for c in ("path", "keeper")})


# Log, index, unseen files

_LOG = f"""log AS (SELECT CASE event_type WHEN 'click' THEN 'delete' WHEN 'view' THEN 'move' ELSE 'cadence-seen' END AS op, '/corpus/live/' || CAST(event_id AS VARCHAR) || '.md' AS src_abs,
CASE WHEN event_type = 'view' THEN 'C:\\corpus\\_held\\' || CAST(user_id AS VARCHAR) || '.md' END AS dst_abs, CASE WHEN event_id % 50 = 0 THEN 'withheld-' || CAST(event_id AS VARCHAR) ELSE sha256(CAST(user_id AS VARCHAR)) END AS sha256, event_id FROM events)"""
_INDEX = f"""{_LOG}, idx AS (SELECT upper(sha256) AS sha256, unnest([dst_abs, src_abs]) AS path, event_id, op FROM log WHERE upper(sha256) NOT LIKE 'WITHHELD%'),
files AS (SELECT sha256, path, CAST(path LIKE '%7.md' AS INTEGER) AS current, CASE WHEN contains(lower(replace(path, '\\', '/')), '/corpus/_held/') THEN 'cold' WHEN contains(lower(path), '/live/1') THEN 'hot' ELSE 'live' END AS tier, op FROM idx WHERE path IS NOT NULL)"""


def action_log(spark, sf):
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "click", "delete").when(F.col("event_type") == "view", "move").otherwise("cadence-seen")
    held = F.when(F.col("event_type") == "view", F.concat(F.lit("C:\\corpus\\_held\\"), F.col("user_id").cast("string"), F.lit(".md")))
    sha = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("withheld-"), F.col("event_id").cast("string"))).otherwise(F.sha2(F.col("user_id").cast("string"), 256))
    return e.select(op.alias("op"), F.concat(F.lit("/corpus/live/"), F.col("event_id").cast("string"), F.lit(".md")).alias("src_abs"), held.alias("dst_abs"), sha.alias("sha256"))


def action_index(spark, sf):
    return provenance.index(action_log(spark, sf), [("/mnt/c/corpus/_HELD/", "cold"), ("/live/1", "hot")], F.endswith(F.col("path"), F.lit("7.md")))


@query(f"WITH {_INDEX} SELECT sha256, path, current, tier, op FROM files")
def manifest_index(spark, sf):
    return action_index(spark, sf)


@query(f"""WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY current DESC, path, tier) AS k, count(*) OVER (PARTITION BY sha256) AS n_paths FROM files)
SELECT sha256, path, current = 1 AS current, tier, n_paths FROM r WHERE k = 1""")
def resolve_best(spark, sf):
    return provenance.best(action_index(spark, sf))


@query(f"""WITH {_INDEX}, asked AS (SELECT DISTINCT upper(sha256(CAST(c_custkey AS VARCHAR))) AS sha256 FROM customer),
r AS (SELECT sha256, string_agg(path, ' ' ORDER BY current DESC, path) AS paths, max(current) = 1 AS current FROM files GROUP BY sha256)
SELECT a.sha256, coalesce(r.paths, '') AS paths, coalesce(r.current, false) AS current FROM asked a LEFT JOIN r USING (sha256)""")
def resolve_shas(spark, sf):
    asked = table(spark, sf, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"))
    return provenance.resolve(asked, action_index(spark, sf)).select("sha256", F.array_join("paths", " ").alias("paths"), "current")


@query(f"""WITH {_INDEX}, asked AS (SELECT '/gone/' || CASE WHEN p_partkey % 40 = 1 THEN '_' WHEN p_partkey % 40 = 2 THEN '%ve_' ELSE '' END || CAST(p_partkey AS VARCHAR) || '.md' AS path, p_partkey % 5 = 0 AS exists FROM part),
low AS (SELECT DISTINCT lower(path) AS path FROM files WHERE current = 1), r AS (SELECT a.path, a.exists, NOT a.exists AND EXISTS (SELECT 1 FROM low f WHERE f.path LIKE '%' || regexp_extract(a.path, '[^/]*$') || '%') AS recoverable_by_name FROM asked a)
SELECT path, exists, recoverable_by_name, NOT exists AND NOT recoverable_by_name AS dangling FROM r""")
def dangling_paths(spark, sf):
    k = F.col("p_partkey")
    wild = F.when(k % 40 == 1, "_").when(k % 40 == 2, "%ve_").otherwise("")
    asked = table(spark, sf, "part").select(F.concat(F.lit("/gone/"), wild, k.cast("string"), F.lit(".md")).alias("path"), (k % 5 == 0).alias("exists"))
    return provenance.dangling(asked, action_index(spark, sf))


@query(f"""WITH {_INDEX} SELECT DISTINCT sha256 FROM files WHERE op <> 'delete'""")
def seen_shas(spark, sf):
    return provenance.seen(action_index(spark, sf))


@query(f"""WITH {_FILES}, seen AS (SELECT sha256 FROM files WHERE source IN ('src11', 'src7')), r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY root_idx, path) AS k FROM files WHERE sha256 NOT IN (SELECT sha256 FROM seen))
SELECT path, sha256, size, root_idx FROM r WHERE k = 1""")
def delta_unseen(spark, sf):
    files = corpus(spark, sf)
    return provenance.unseen(files.drop("text"), files.where("source in ('src11', 'src7')").select("sha256").distinct())


@query(f"""WITH {_FILES}, idx AS (SELECT regexp_extract(path, '[^/]*$') AS base, min(struct_pack(p := path, s := sha256)) AS f FROM files GROUP BY 1)
SELECT item_id, idx.f.s AS sha256 FROM benchmark LEFT JOIN idx ON idx.base = CAST(item_id AS VARCHAR) || '.md'""")
def sources_by_name(spark, sf):
    entries = table(spark, sf, "benchmark").select("item_id", F.lit("none").alias("name"), F.concat(F.lit("D:\\old\\"), F.col("item_id").cast("string"), F.lit(".MD")).alias("path"))
    return provenance.by_name(entries, corpus(spark, sf)).select("item_id", "sha256")


# Names and paths


@query("SELECT page_id, url, CASE WHEN contains(lower(url), '.org/') THEN 'hot' WHEN contains(lower(url), 'www.') THEN 'cold' ELSE 'live' END AS tier FROM pages")
def tier_of_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", T.tier(F.col("url"), [(".ORG/", "hot"), ("www.", "cold")]).alias("tier"))


_TITLE = """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Claude-' WHEN p_partkey % 4 = 1 THEN 'x' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (2)' ELSE '' END AS stem FROM part),
a AS (SELECT p_partkey, stem, lower(regexp_replace(stem, '\\s*\\([0-9]+\\)$', '')) AS t FROM n), b AS (SELECT p_partkey, stem, CASE WHEN t LIKE 'x_%' THEN substr(t, 2) ELSE t END AS t FROM a)"""


@query(_TITLE + """ SELECT p_partkey, trim(regexp_replace(CASE WHEN t LIKE 'claude-%' THEN substr(t, 8) ELSE t END, '[^a-z0-9]+', ' ', 'g')) AS title,
trim(regexp_replace(CASE WHEN lower(stem) LIKE 'claude-%' THEN substr(lower(stem), 8) ELSE lower(stem) END, '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'KB-' || left(replace(lower(stem), ' ', '-'), 60) AS id FROM b""")
def titles_and_slugs(spark, sf):
    k = F.col("p_partkey")
    stem = F.concat(F.when(k % 4 == 0, "Claude-").when(k % 4 == 1, "x").otherwise(""), "p_name", F.when(k % 3 == 0, " (2)").otherwise(""))
    name = F.concat(stem, F.lit(".md"))
    return table(spark, sf, "part").select("p_partkey", T.title(name).alias("title"), T.slug(F.concat(F.lit("/a/b.c/"), name)).alias("slug"), T.artifact_id(stem).alias("id"))


@query("""SELECT page_id, '/mnt/d/' || replace(url, '\\', '/') AS posix, 'D:\\' || replace(url, '/', '\\') AS windows FROM pages""")
def path_styles(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.stored_path(F.concat(F.lit("D:\\"), "url"), "posix").alias("posix"), T.stored_path(F.concat(F.lit("/mnt/d/"), "url"), "windows").alias("windows"))


@query("""SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'draft' ELSE 'seeded' END AS status, 'KB-' || lower(c_name) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'governance' ELSE 'reference' END AS domain FROM customer""")
def conventions(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.when(F.col("c_mktsegment") == "BUILDING", " WIP ").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", T.status(raw).alias("status"), T.conventional_id(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lower("c_name")).alias("id"), T.domain(F.when(F.col("c_custkey") % 2 == 0, "System-Prompt").otherwise("?")).alias("domain"))


@query("SELECT doc_id, upper(sha256(text)) AS repaired_sha, true AS unchanged FROM documents")
def mojibake_repair(spark, sf):
    # Each text is broken as a wrong decoder breaks the repairable letters, then repaired.
    t = F.col("text")
    broken = t
    for wrong, right in [(w, r) for w, r in v.MOJIBAKE if len(r) == 1 and r not in "  " and ord(r) < 0x100]:
        broken = F.replace(broken, F.lit(right), F.lit(wrong))
    return table(spark, sf, "documents").select("doc_id", T.sha(T.repaired(broken)).alias("repaired_sha"), (T.repaired(t) == t).alias("unchanged"))


# Kinds, facts, shingles

_CHAT = "chats AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '## Prompt' WHEN 'assistant' THEN '## Response' ELSE '# ' || role END || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def chats(spark, sf):
    c = table(spark, sf, "conversations")
    head = F.when(F.col("role") == "user", "## Prompt").when(F.col("role") == "assistant", "## Response").otherwise(F.concat(F.lit("# "), "role"))
    part = F.concat(head, F.lit("\n"), "text", F.lit("\n"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text"))


_KIND = """CASE WHEN contains(text, 'SYSTEM_PROMPT') THEN 'GOVERNANCE_PROMPT' WHEN regexp_matches(text, '(?i)<turn\\b') THEN 'CODE_SPEC'
WHEN regexp_matches(text, '(?im)^#{1,3}\\s*decision\\s+[0-9]') OR (regexp_matches(text, '(?im)^#{1,3}\\s*reading order\\b') AND regexp_matches(text, '(?i)\\baudit trail\\b')) THEN 'DECISION_LOG'
WHEN regexp_matches(text, '(?i)\\b(eval(uation)? (harness|bundle)|runbook bundle|test matrix)\\b') THEN 'EVAL_BUNDLE'
WHEN len(regexp_extract_all(text, '(?m)^##\\s*Response')) = 1 AND len(regexp_extract_all(text, '(?m)^##\\s*Prompt')) <= 1 THEN 'WRAPPED_DELIVERABLE'
WHEN regexp_matches(text, '(?m)^##\\s*Response') THEN 'EXPLORATORY_CHAT' WHEN regexp_matches(text, '(?im)^#{1,3}\\s+(table of )?contents\\b') THEN 'FINISHED_REPORT' ELSE 'REFERENCE_NOTE' END"""


@query(f"WITH {_CHAT} SELECT conv_id, {_KIND} AS archetype FROM chats")
def archetype_chats(spark, sf):
    return chats(spark, sf).select("conv_id", archetypes.archetype(F.col("text")).alias("archetype"))


@query(f"WITH d AS (SELECT CASE doc_id % 6 WHEN 0 THEN '## Decision 7' WHEN 1 THEN '# Contents' WHEN 2 THEN 'an EVAL harness' WHEN 3 THEN '<TURN id=1>' WHEN 4 THEN 'SYSTEM_PROMPT' ELSE '' END || chr(10) || text AS text FROM documents) SELECT {_KIND} AS archetype, count(*) AS n FROM d GROUP BY 1")
def archetype_counts(spark, sf):
    signs = ["## Decision 7", "# Contents", "an EVAL harness", "<TURN id=1>", "SYSTEM_PROMPT", ""]
    head = F.element_at(F.array(*map(F.lit, signs)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").groupBy(archetypes.archetype(F.concat(head, F.lit("\n"), "text")).alias("archetype")).agg(F.count("*").alias("n"))


# RE2's \b and \w are ASCII, so SQL takes runs of letters, digits and _ and looks at them whole.
_CAPS = "list_filter(regexp_extract_all(text, '[\\pL\\pN_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9_]{2,}'))"


@query(f"SELECT doc_id, array_to_string(list_distinct_ordered, ' ') AS capitals FROM (SELECT doc_id, list_transform(list_filter(list_zip({_CAPS}, range(1, 1000000)[1:len({_CAPS})]), lambda p: list_position({_CAPS}, p[1]) = p[2]), lambda p: p[1]) AS list_distinct_ordered FROM documents)")
def facts_capitals(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(facts.first_of_each(facts.found(F.col("text"), facts.CAPITALS)), " ").alias("capitals"))


_WORDS = "list_filter(string_split_regex(lower(text), '[\\s\\x1c-\\x1f\\x0b]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, CAST(CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS INTEGER) AS n_shingles FROM w")
def shingle_counts(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", tokens(plain(F.col("text"))).alias("w"))
    return words.select("doc_id", F.size(shingles(F.col("w"))).alias("n_shingles"))


_NEAR = f"""WITH RECURSIVE w AS (SELECT {_PATH} AS path, source, {_WORDS} AS w FROM documents),
s AS (SELECT path, source, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM w WHERE len(w) >= 5), n AS (SELECT path, count(*) AS n FROM s GROUP BY path),
e AS (SELECT a.path AS a, b.path AS b FROM s a JOIN s b ON a.source = b.source AND a.g = b.g AND a.path < b.path JOIN n x ON x.path = a.path JOIN n y ON y.path = b.path GROUP BY a.path, b.path HAVING count(*) >= 0.8 * (max(x.n) + max(y.n) - count(*))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b), c AS (SELECT a AS path, min(b) AS cluster FROM reach GROUP BY a)"""


@query(_NEAR + " SELECT cluster, path FROM c")
def near_dup_clusters(spark, sf):
    return neardup.clusters(corpus(spark, sf), 0.8, bucket=F.col("source"))


@query(_NEAR + f""", {_FILES}, m AS (SELECT c.cluster, c.path, f.size, f.doc_id % 3 = 0 AS old FROM c JOIN files f USING (path)),
k AS (SELECT *, first_value(path) OVER (PARTITION BY cluster ORDER BY old DESC, size DESC, path) AS canonical, bool_or(old) OVER (PARTITION BY cluster) AS any_old FROM m)
SELECT cluster, path, canonical, path <> canonical AND NOT (any_old AND old) AS loser FROM k""")
def near_dup_keepers(spark, sf):
    files = corpus(spark, sf)
    members = neardup.clusters(files, 0.8, bucket=F.col("source")).join(files.select("path", "size", (F.col("doc_id") % 3 == 0).alias("established")), "path")
    return neardup.keepers(members).select("cluster", "path", "canonical", "loser")


# Sections, gates, audit

_SECTIONS = f"""{_CHAT}, lines AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS n FROM chats),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(ltrim(line), '^###? ') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS sec FROM lines),
sec AS (SELECT conv_id, sec, sum(length(line) + CASE WHEN i < n THEN 1 ELSE 0 END) AS chars, min(CASE WHEN regexp_matches(ltrim(line), '^###? ') THEN trim(line) END) AS head, bool_or(trim(line) <> '' AND NOT starts_with(trim(line), '# ')) AS content, bool_or(trim(line) <> '') AS full_ FROM marked GROUP BY conv_id, sec),
kept AS (SELECT conv_id, chars, content, coalesce(head, '<section #0 (no heading)>') AS section, head IS NULL AS bare FROM sec WHERE head IS NOT NULL OR full_)"""
_FLAGS = _SECTIONS + """, flags AS (SELECT conv_id, 'missing_leading_heading' AS rule, section, 'section has no leading H2/H3 heading' AS detail FROM kept WHERE bare AND content
UNION ALL SELECT conv_id, 'over_est_tokens', section, CAST(chars // 4 AS VARCHAR) || ' est-tokens (chars/4) > 50' FROM kept WHERE chars // 4 > 50 UNION ALL SELECT conv_id, 'over_chars', section, CAST(chars AS VARCHAR) || ' chars > 180' FROM kept WHERE chars > 180)"""


@query(f"WITH {_FLAGS} SELECT conv_id, rule, section, detail FROM flags")
def section_lint(spark, sf):
    return chats(spark, sf).select("conv_id", F.explode(S.flags(F.col("text"), 50, 180)).alias("f")).select("conv_id", "f.*")


@query(f"WITH {_FLAGS} SELECT rule, count(*) AS n FROM flags GROUP BY rule")
def lint_by_rule(spark, sf):
    return section_lint(spark, sf).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {_SECTIONS} SELECT conv_id, count(*) AS n_sections, CAST(sum(chars) AS BIGINT) AS chars, max(CAST(chars AS BIGINT)) AS longest FROM kept GROUP BY conv_id")
def section_sizes(spark, sf):
    parts = chats(spark, sf).select("conv_id", F.explode(S.sections(F.col("text"))).alias("s"))
    return parts.groupBy("conv_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("s")).cast("long").alias("chars"), F.max(F.length("s")).cast("long").alias("longest"))


def rendered(spark, sf):
    """Artifacts that hold documents whole: some without header, hash, title or a known type."""
    k = F.col("doc_id")
    sha = F.upper(F.sha2("text", 256))
    sources = F.when(k % 5 == 1, "sources: []\n").when(k % 5 == 2, "sources:\n- path: x.md\n").otherwise(F.concat(F.lit("sources:\n- sha256: "), sha, F.lit("\n  title: t\n")))
    head = F.concat(F.lit("---\nid: KB-"), k.cast("string"), F.lit("\n"), F.when(k % 4 == 1, "").otherwise("status: seeded\n"), F.lit("type: "), F.when(k % 6 == 0, "Mystery").otherwise("doctrine"), F.lit("\n"), sources, F.lit("---\n"))
    head = F.when(k % 7 == 0, "---\n: [\n---\n").otherwise(head)
    body = F.concat(F.when(k % 3 == 0, "").otherwise("# Title\n"), F.lit("\n## Part\n"), "text", F.lit("\n\n## Stripping Ledger\nREF_"), F.left(sha, F.lit(6)), F.lit("\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/inbox/"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(head, body).alias("text"))


#: What stands in the section of a rendered artifact besides the text.
_AROUND = len("## Part\n\n\n")
_AUDIT = f"""WITH a AS (SELECT doc_id AS k, doc_id % 7 = 0 AS bad, length(text) + {_AROUND} AS n FROM documents), f AS (
SELECT k, 'chunk:over_est_tokens' AS rule, '## Part: ' || CAST(n // 4 AS VARCHAR) || ' est-tokens (chars/4) > 850' AS detail FROM a WHERE NOT bad AND n // 4 > 850 UNION ALL SELECT k, 'chunk:over_chars', '## Part: ' || CAST(n AS VARCHAR) || ' chars > 3600' FROM a WHERE NOT bad AND n > 3600 UNION ALL
SELECT k, 'frontmatter_invalid' AS rule, 'missing or unparseable YAML frontmatter' AS detail FROM a WHERE bad
UNION ALL SELECT k, 'missing_field', 'required field ''status'' absent or empty' FROM a WHERE NOT bad AND k % 4 = 1 UNION ALL SELECT k, 'missing_field', 'required field ''sources'' absent or empty' FROM a WHERE NOT bad AND k % 5 = 1
UNION ALL SELECT k, 'missing_sha256_linkback', 'no sources[].sha256 provenance link-back' FROM a WHERE NOT bad AND k % 5 = 2 UNION ALL SELECT k, 'unknown_type', 'type ''mystery'' not in domain map' FROM a WHERE NOT bad AND k % 6 = 0
UNION ALL SELECT k, 'missing_h1_title', 'no H1 (''# Title'') heading in body' FROM a WHERE NOT bad AND k % 3 = 0)"""


@query(_AUDIT + " SELECT k AS doc_id, rule, detail FROM f")
def audit_findings(spark, sf):
    rows = rendered(spark, sf).withColumn("fm", frontmatter.parsed(F.col("text")))
    return rows.select("doc_id", F.explode(audit.findings(F.col("fm"), F.col("text"))).alias("x")).select("doc_id", "x.rule", "x.detail")


@query(_AUDIT + " SELECT rule, count(*) AS count FROM f GROUP BY rule")
def audit_by_rule(spark, sf):
    return audit.by_rule(audit_findings(spark, sf))


@query(f"""WITH r AS (SELECT doc_id AS k, doc_id % 2 = 0 AS free, (doc_id % 11) / 10.0 AS m, doc_id % 13 <> 0 AS reported, doc_id % 7 <> 0 AND doc_id % 5 NOT IN (1, 2) AS linked, (length(text) + {_AROUND}) // 4 > 850 OR length(text) + {_AROUND} > 3600 AS long FROM documents)
SELECT k AS doc_id, CASE WHEN long THEN 'chunk_lint' WHEN NOT reported THEN 'no_gate_report' WHEN free AND m < 0.9 THEN 'faithfulness' WHEN NOT free AND m < 0.8 THEN 'coverage' WHEN NOT free AND k % 3 = 1 THEN 'unexplained_loss'
WHEN NOT linked THEN 'no_link_back' WHEN k % 17 = 0 THEN 'name_taken' END AS reject_reason FROM r""")
def gate_outcomes(spark, sf):
    k = F.col("doc_id")
    free, m, ref = k % 2 == 0, (k % 11) / F.lit(10.0), F.regexp_extract("text", "REF_[0-9A-F]+", 0)
    missing = F.when(k % 3 == 1, F.array(ref, F.lit("LOST"))).otherwise(F.array(ref))
    arts = rendered(spark, sf).withColumns({
        "reported": k % 13 != 0, "archetype": F.when(free, "EXPLORATORY_CHAT").otherwise("FINISHED_REPORT"), "coverage": m, "faithfulness": m, "missing": missing, "unsupported": F.array(F.lit("X")), "taken": k % 17 == 0,
    })
    return gates.decided(arts).select("doc_id", "reject_reason")


@query("SELECT doc_id, doc_id % 7 <> 0 AS usable, CASE WHEN doc_id % 7 <> 0 THEN 'KB-' || CAST(doc_id AS VARCHAR) END AS id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 4 <> 1 THEN 'seeded' END AS status, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 1 THEN 0 ELSE 1 END AS n_sources FROM documents")
def frontmatter_fields(spark, sf):
    rows = rendered(spark, sf).select("doc_id", frontmatter.parsed(F.col("text")).alias("fm"))
    return rows.select("doc_id", F.col("fm.ok").alias("usable"), "fm.id", "fm.status", "fm.n_sources")


@query("""SELECT doc_id, sha256('---' || chr(10) || 'id: KB-' || CAST(doc_id AS VARCHAR) || chr(10) || 'type: reference-note' || chr(10) || 'status: seeded' || chr(10) || 'sources:' || chr(10) || '- sha256: H' || upper(sha256(text)) || chr(10) || '  title: t' || chr(10) || '  path: /a.md' || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(text, '^\\s+', '')) AS artifact_sha FROM documents""")
def artifact_build(spark, sf):
    d = table(spark, sf, "documents")
    id_ = F.concat(F.lit("KB-"), F.col("doc_id").cast("string"))
    art = artifacts.built(F.concat(F.lit("\n \n"), "text"), sha256=F.concat(F.lit("H"), T.sha(F.col("text"))), title=F.lit("t"), path=F.lit("/a.md"), type_=F.lit("reference-note"), id_=id_)
    return d.select("doc_id", F.sha2(art, 256).alias("artifact_sha"))


@query(f"""WITH s AS (SELECT doc_id, source, upper(sha256(text)) AS sha FROM documents), f AS (SELECT min(doc_id) AS doc_id, sha FROM s WHERE source <> 'src5' AND sha NOT IN (SELECT sha FROM s WHERE source = 'src5') GROUP BY sha)
SELECT sha AS source_sha256, CASE WHEN row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) = 1 THEN 'chat-' || CAST(doc_id % 10 AS VARCHAR) ELSE 'chat-' || CAST(doc_id % 10 AS VARCHAR) || '-' || lower(left(sha, 8)) END || '.distill.json' AS filename FROM f""")
def distill_queue(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("root_idx"), F.concat(F.lit("/x/claude-Chat_"), (F.col("doc_id") % 10).cast("string"), F.lit(".md")).alias("path"), T.sha(F.col("text")).alias("sha256"), F.lit("EXPLORATORY_CHAT").alias("archetype"), "source")
    queued = rows.where("source = 'src5'").select(F.concat(F.lit("old-"), "sha256", F.lit(".distill.json")).alias("filename"), F.col("sha256").alias("source_sha256"))
    return artifacts.distill_queue(rows.where("source <> 'src5'").drop("source"), queued, "/inbox").select("source_sha256", "filename")


# Recall, packs, feeds

_TOP = """WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT 'v' || CAST(vec_id AS VARCHAR) AS path, vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])) AS score FROM embeddings e, q),
h AS (SELECT path, score FROM s ORDER BY score DESC, path LIMIT 10)"""


def _hot(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()["embedding"]  # one row: the query
    return recall.nearest(e.withColumn("path", F.concat(F.lit("v"), F.col("vec_id").cast("string"))), q, 10)


@query(_TOP + " SELECT path, round(score, 9) AS score FROM h")
def hot_top10(spark, sf):
    return _hot(spark, sf).select("path", F.round("score", 9).alias("score"))


_BM25 = """WITH w AS (SELECT 'v' || CAST(doc_id AS VARCHAR) AS path, list_filter(string_split_regex(lower(text), '[\\s\\x1c-\\x1f\\x0b]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT path, len(w) AS n, len(list_filter(w, lambda x: x = 'das')) AS t0, len(list_filter(w, lambda x: x = 'the')) AS t1 FROM w), g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM t),
b AS (SELECT path, ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM t, g WHERE t0 > 0 OR t1 > 0),
cold AS (SELECT path, round(score, 9) AS score FROM b ORDER BY round(score, 9) DESC, path LIMIT 10)"""


def _cold(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.concat(F.lit("v"), F.col("doc_id").cast("string")))
    return recall.bm25(docs, "The das", 10).select("path", F.round("score", 9).alias("score"))


@query(_BM25 + " SELECT path, score FROM cold")
def cold_bm25(spark, sf):
    return _cold(spark, sf)


@query(_BM25 + _TOP.replace("WITH q", ", q") + """, c AS (SELECT * FROM cold WHERE path NOT IN (SELECT path FROM h) ORDER BY score DESC, path LIMIT 5), b2 AS (SELECT 'hot' AS tier, path, round(score, 9) AS score FROM h UNION ALL SELECT 'cold', path, score FROM c)
SELECT tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY score DESC, path) AS INTEGER) AS place, path, score FROM b2""")
def two_tier_recall(spark, sf):
    hot = _hot(spark, sf).select("path", F.round("score", 9).alias("score"))
    return recall.two_tiers(hot, _cold(spark, sf)).select("tier", "place", "path", "score")


@query(_TOP + " SELECT coalesce(max(score) < 0.3, true) AS weak_hot FROM h WHERE path <> 'v0'")
def weak_hot(spark, sf):
    return recall.weak(_hot(spark, sf).where("path <> 'v0'"))


@query("""SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) || '.md' AS path, CAST(doc_id % 10 AS DOUBLE) / 10 AS score FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, 'e.md', 0.25 FROM documents WHERE doc_id % 4 IN (0, 1)""")
def backend_hits(spark, sf):
    k = F.col("doc_id")
    id_, s = F.concat(F.lit("d"), k.cast("string"), F.lit(".md")), F.concat(F.lit("0."), (k % 10).cast("string"))
    json_ = F.concat(F.lit('progress\n[{"file": "'), id_, F.lit('", "score": '), s, F.lit('}, 7, {"file": "n.md", "score": null}, {"score": "0.25", "file": "e.md"}] done'))
    lines = F.concat(F.lit("result: "), id_, F.lit("  Score: "), s, F.lit("\nresult: e.md score: .25\nnothing here"))
    out = F.when(k % 4 == 0, json_).when(k % 4 == 1, lines).when(k % 4 == 2, F.concat(F.lit("result: "), id_, F.lit(" score: "), s)).otherwise(F.concat(F.lit("No results\n"), json_))
    return table(spark, sf, "documents").select("doc_id", F.explode(recall.hits(out)).alias("h")).select("doc_id", "h.path", "h.score")


@query("""WITH h AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'public' WHEN 2 THEN 'internal' WHEN 3 THEN 'private' WHEN 4 THEN 'proprietary' ELSE 'proprietary' END AS l FROM documents), r AS (SELECT doc_id, coalesce(l, 'internal') AS level FROM h)
SELECT doc_id, level, level IN ('public', 'internal') AS admitted, CASE WHEN level NOT IN ('public', 'internal') THEN 'Excluded `' || CAST(doc_id AS VARCHAR) || '` because admissibility ' || level || ' exceeds max internal.' END AS exclusion FROM r""")
def admissibility(spark, sf):
    k = F.col("doc_id")
    raw = F.element_at(F.array(F.lit(None), F.lit("Public "), F.lit("INTERNAL"), F.lit("private"), F.lit("proprietary"), F.lit("?")), (k % 6 + 1).cast("int"))
    hits = table(spark, sf, "documents").select("doc_id", k.cast("string").alias("path"), raw.alias("admissibility"))
    return packs.admitted(hits).select("doc_id", "level", "admitted", "exclusion")


@query("SELECT role, include_cold FROM (VALUES ('orchestration', false), ('execution', false), ('verification', true), ('research', true), ('synthesis', false), ('handoff', false)) t(role, include_cold)")
def pack_roles(spark, sf):
    return packs.roles(spark).select("role", "include_cold")


_EVIDENCE = """WITH e AS (SELECT event_id, event_type AS kind, 'user ' || CAST(user_id AS VARCHAR) AS wu, 'ev:' || CAST(event_id AS VARCHAR) AS ref, replace(replace(props, '\\', '\\\\'), '"', '\\"') AS summary, upper(sha256(props)) AS link FROM events),
d AS (SELECT event_id, kind, wu, link, '{' || chr(10) || '  "advisory": true,' || chr(10) || '  "custody_note": "n",' || chr(10) || '  "emitted_by": "",' || chr(10) || '  "freshness": "",' || chr(10) || '  "is_truth_source": false,' || chr(10) || '  "kind": "' || kind || '",' || chr(10) || '  "produced_at": "",' || chr(10) || '  "schema": "lorekeep/feed-evidence@1",' || chr(10) || '  "source_ref": "' || ref || '",' || chr(10) || '  "sources": [' || chr(10) || '    {' || chr(10) || '      "ref": "' || ref || '",' || chr(10) || '      "role": "substrate-authoritative-record",' || chr(10) || '      "sha256": "' || link || '"' || chr(10) || '    }' || chr(10) || '  ],' || chr(10) || '  "summary": "' || summary || '",' || chr(10) || '  "work_unit_id": "' || wu || '"' || chr(10) || '}' || chr(10) AS document FROM e)"""


@query(_EVIDENCE + " SELECT link AS link_sha256, upper(sha256(document)) AS evidence_sha256, kind || '.' || replace(wu, ' ', '_') || '.' || left(upper(sha256(document)), 16) || '.json' AS name FROM d")
def feed_evidence(spark, sf):
    return feed.evidence(feed_records(spark, sf)).where("problem is null").select("link_sha256", "evidence_sha256", "name")


def feed_records(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("kind"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("work_unit_id"), F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("source_ref"),
        F.col("props").alias("summary"), F.concat(F.lit(" "), F.sha2("props", 256)).alias("sha256"), F.lit("n").alias("custody_note"), F.lit("x").alias("unknown"),
    )


@query("SELECT CASE WHEN event_id % 4 = 1 THEN 'no sha256 link' WHEN event_id % 4 = 2 THEN 'blank source_ref' WHEN event_id % 4 = 3 THEN 'missing field' END AS problem, count(*) AS n FROM events GROUP BY 1")
def feed_refusals(spark, sf):
    k = table(spark, sf, "events").select(F.col("event_id").alias("k"), F.lit("a").alias("kind"), F.lit("w").alias("work_unit_id"))
    rows = k.withColumns({"sha256": F.left(F.sha2(F.col("k").cast("string"), 256), F.when(F.col("k") % 4 == 1, 63).otherwise(64)), "source_ref": F.when(F.col("k") % 4 == 2, " ").otherwise("r"), "summary": F.when(F.col("k") % 4 != 3, "s")})
    return feed.evidence(rows).groupBy("problem").agg(F.count("*").alias("n"))


# Streams: the same operators over arriving files; each reads what is there and stops.


_STREAMED = _EVIDENCE.replace("'ev:' || CAST(event_id AS VARCHAR)", "CAST(event_id AS VARCHAR)").replace('"custody_note": "n"', f'"custody_note": "{feed.NOTE}"')


@query(_STREAMED + " SELECT DISTINCT kind, wu AS work_unit_id, upper(sha256(document)) AS evidence_sha256 FROM d")
def stream_feed(spark, sf):
    """The hash of each evidence document that a stream of records makes, once each."""
    return stream_feeds.ingested_once(spark, f"{sf}/events.parquet").select("kind", "work_unit_id", "evidence_sha256")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    return stream_events.hourly_once(spark, f"{sf}/events.parquet")
