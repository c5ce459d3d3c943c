import fnmatch
import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep import vocabulary as v
from lorekeep.functions import archetypes, facts
from lorekeep.functions import sections as S
from lorekeep.functions import text as T
from lorekeep.functions.shingles import plain, shingles, tokens


def apply(spark, values, *columns, name="x"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, {name} string")
    rows = df.select("i", *(c.alias(f"c{j}") for j, c in enumerate(columns))).collect()
    out = [tuple(r)[1:] for r in sorted(rows)]
    return [r[0] for r in out] if len(columns) == 1 else out


X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_hashes(spark):
    assert apply(spark, ["abc", "é", ""], T.sha(X)) == [hashlib.sha256(s.encode()).hexdigest().upper() for s in ("abc", "é", "")]


def test_decoding(spark):
    raw = [b"a\r\nb\rc", b"\xff\xfeok", b"\xe2\x82", b"\xc3\xa9\xed\xa0\x80", b""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, x binary")
    got = [r.t for r in df.select("i", T.decoded(X).alias("t")).orderBy("i").collect()]
    assert got == [r.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for r in raw]


@pytest.mark.parametrize(
    "name,title",
    [("Claude-My Plan (2).md", "my plan"), ("xNotes.md", "notes"), ("x.md", "x"), ("chatgpt-claude-a.md", "claude a"), ("plain", "plain"), (".md", "md"), ("A--B__c.tar.md", "a b c tar"), ("xylophone (1).md", "ylophone"), ("Über.md", "ber")],
)
def test_titles(spark, name, title):
    assert apply(spark, [name], T.title(X)) == [title]


def test_slugs_stems_and_names(spark):
    assert apply(spark, ["/a.b/Claude-Big Plan!.md", "/a/.hidden", "/q/x (3).md", "chatgpt-Ä.md"], T.slug(X)) == ["big-plan", "hidden", "x-3", ""]
    assert apply(spark, ["a.b.md", ".x", "x", "..a.md", "a."], T.stem(X)) == ["a.b", ".x", "x", "..a", "a"]
    assert apply(spark, ["/p/q/README.md", "/p/q/readme.md"], T.artifact_name(X)) == ["q__README.md", "readme.md"]
    assert apply(spark, ["README.md", "notes.txt", "Plan.md", "_index"], T.is_generic(X)) == [True, True, False, True]
    assert apply(spark, ["a (2).md", "a(2).md", "a (2)", "a (1) (2).md"], T.unnumbered(X), T.number(X)) == [("a.md", 2), (None, None), (None, None), ("a (1).md", 2)]


def test_paths(spark):
    assert apply(spark, ["C:\\Corpus\\a.md", "/mnt/c/a", "d:/x//y", "a\\b"], T.posix_path(X)) == ["/mnt/c/Corpus/a.md", "/mnt/c/a", "/mnt/d/x//y", "a/b"]
    assert apply(spark, ["/mnt/c/a/b.md", "/c/x", "c:/q", "/home/x"], T.windows_path(X)) == ["C:\\a\\b.md", "C:\\x", "C:\\q", "\\home\\x"]
    assert apply(spark, ["C:\\a", "/b\\c"], T.local_path(X)) == ["/mnt/c/a", "/b\\c"]
    with pytest.raises(ValueError):
        T.stored_path(X, "odd")
    rules = [("/corpus/_hot/", "hot"), ("C:\\Held", "cold"), ("", "never")]
    assert apply(spark, ["C:\\corpus\\_HOT\\x", "/mnt/c/held/y", "/z"], T.tier(X, rules)) == ["hot", "cold", "live"]
    assert apply(spark, ["/a/b", "/ab", "/c/d"], T.root_rank(X, ["/c", "/a/"])) == [1, 2, 0]


GLOBS = ["**/.git/**", "_provenance/**", "*.tmp", "a?c/[xy]*", "d[!e]f"]


def test_excluded_paths(spark):
    paths = [".git/x", "p/.git/y", "_provenance/a/b", "q/_provenance/a", "a/b.tmp", "abc/xq", "abc/zq", "dgf", "def", "plain.md", "x\ny.tmp"]
    want = [any(fnmatch.fnmatchcase(p, g) for w in GLOBS for g in ((w, w[3:]) if w.startswith("**/") else (w,))) for p in paths]
    assert apply(spark, paths, T.excluded(X, GLOBS)) == want == [T.matches(p, GLOBS) for p in paths]
    assert apply(spark, ["a"], T.excluded(X, [])) == [False]


def test_conventions(spark):
    assert apply(spark, ["ACTIVE ", "stable", "weird", None, "WIP"], T.status(X)) == ["reviewed", "stable", "seeded", "seeded", "draft"]
    assert apply(spark, ["KB-Old", "New", "", None], T.conventional_id(X, F.lit("Fall"))) == ["KB-Old", "KB-new", "KB-fall", "KB-fall"]
    assert apply(spark, ["Doctrine", "nope", None], T.domain(X)) == [v.DOMAINS["doctrine"], "reference", "reference"]
    assert apply(spark, ["a b/c!", "..x--", "", "é"], T.safe_name(X)) == ["a_b_c", "x", "", ""]
    assert apply(spark, [None, " Private", "??", ""], T.level(X)) == ["internal", "private", "proprietary", "proprietary"]


def test_repair(spark):
    bad = "dash \xe2\x80\x94 caf\xc3\xa9\xc2\xa0x \xe2\x80\x8b�"
    once = apply(spark, [bad, "fine — é"], T.repaired(X))
    assert once == ["dash — café x ", "fine — é"] and apply(spark, once, T.repaired(X)) == once


@pytest.mark.parametrize(
    "text,kind",
    [
        ("## Decision 3\n## Response", "DECISION_LOG"), ("see SYSTEM_PROMPT <turn>", "GOVERNANCE_PROMPT"), ("a <Turn x>", "CODE_SPEC"), ("<turnip>", "REFERENCE_NOTE"), ("### reading order\nan Audit Trail", "DECISION_LOG"),
        ("# Reading order only", "REFERENCE_NOTE"), ("our eval bundle", "EVAL_BUNDLE"), ("a Test Matrix here", "EVAL_BUNDLE"), ("## Prompt\nx\n## Response\ny", "WRAPPED_DELIVERABLE"), ("## Response\n## Responses", "EXPLORATORY_CHAT"),
        ("## Prompt\n## Prompt\n## Response", "EXPLORATORY_CHAT"), ("## Prompt", "REFERENCE_NOTE"), ("##\n\nResponse", "WRAPPED_DELIVERABLE"), ("## response", "REFERENCE_NOTE"), ("## Table of Contents", "FINISHED_REPORT"), ("#Contents", "REFERENCE_NOTE"), ("", "REFERENCE_NOTE"),
    ],
)
def test_archetypes(spark, text, kind):
    assert apply(spark, [text], archetypes.archetype(X)) == [kind]


def test_own_governance_token(spark):
    assert apply(spark, ["MY_TOKEN", "SYSTEM_PROMPT"], archetypes.archetype(X, "MY_TOKEN")) == ["GOVERNANCE_PROMPT", "REFERENCE_NOTE"]
    assert apply(spark, ["SYSTEM_PROMPT"], archetypes.archetype(X, "")) == ["REFERENCE_NOTE"]


# Facts against an independent version with Python's own patterns.

FENCE = re.compile("```[a-zA-Z0-9_-]*\n(.*?)```", re.S)
SIGNALS = {
    "date": r"\b\d{1,2}/\d{1,2}/\d{4}\b", "money": r"\$\d[\d,]*\d(?:\.\d+)?|\$\d(?:\.\d+)?", "percent": r"\b\d+(?:\.\d+)?%", "caps": r"\b[A-Z][A-Z0-9_]{2,}\b",
    "name": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", "number": r"\b\d+(?:,\d{3})*(?:\.\d+)?\b",
}
DECIDES = re.compile(r"\b(decided?|chose|chosen|rejected|adopt|adopted|selected|will|must|shall|deferred|settled)\b", re.I)


def norm(s):
    return " ".join(s.split())


def once(found):
    out = {}
    for f in found:
        if f.strip():
            out.setdefault(norm(f).lower(), f.strip())
    return list(out.values())


def hits(kind, text):
    return [m.group(0) for m in re.finditer(SIGNALS[kind], text)]


def stated(text):
    rest = FENCE.sub(" ", text)
    lines = [norm(x) for x in rest.split("\n") if DECIDES.search(x)]
    return once(FENCE.findall(text) + hits("date", rest) + hits("money", rest) + hits("caps", rest) + hits("name", rest) + lines + hits("number", rest))


def checkable(text):
    rest = FENCE.sub(" ", text)
    return once([h for k in ("money", "percent", "date", "caps", "name") for h in hits(k, rest)])


WORDS = ["$5", "$1,200.50", "12/3/2024", "12.5%", "ABC", "ABC_9", "Ab Cd", "Ab", "we must", "WILL", "3", "1,000", "x9", "\n", "\n", " ", "```py\ncode 7\n```", "```", "Ünder Way", "é", " ", "٣", "abc", "$9,", "5/5/55"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=14).map(" ".join), min_size=1, max_size=40))
def test_facts_equal_brute_force(spark, texts):
    got = apply(spark, texts, facts.stated(X), facts.checkable(X))
    assert [(list(a), list(b)) for a, b in got] == [(stated(t), checkable(t)) for t in texts]


def test_loss_and_invention(spark):
    source, artifact = "Paid $1,200 to Ada Lovelace; CODE_X must stay.", "ada lovelace got $1,200 and $999"
    f = facts.stated(F.lit(source))
    missing = facts.absent(f, facts.key(F.lit(artifact)))
    row = spark.range(1).select(missing.alias("m"), facts.kept_share(f, missing).alias("s"), facts.absent(facts.checkable(F.lit(artifact)), facts.key(F.lit(source))).alias("u"), facts.kept_share(facts.stated(F.lit("nothing")), facts.stated(F.lit(""))).alias("n")).first()
    assert row.m == ["CODE_X", source] and row.s == 0.6 and row.u == ["$999"] and row.n == 1.0


# Sections against an independent version over lines.


def flags(text, max_tokens, max_chars):
    parts, cur, head = [], [], None
    for line in text.splitlines(keepends=True):
        if re.match("###? ", line.lstrip()):
            if head is not None or "".join(cur).strip():
                parts.append((head, "".join(cur)))
            cur, head = [], line
        cur.append(line)
    if head is not None or "".join(cur).strip():
        parts.append((head, "".join(cur)))
    out = []
    for i, (h, body) in enumerate(parts):
        label = h.strip() if h else f"<section #{i} (no heading)>"
        rest = body
        if rest.startswith("---\n") and "\n---\n" in rest[4:]:
            rest = rest[rest.index("\n---\n", 4) + 5 :]
        if h is None and any(x.strip() and not x.strip().startswith("# ") for x in rest.splitlines()):
            out.append(("missing_leading_heading", label))
        if len(body) // 4 > max_tokens:
            out.append(("over_est_tokens", label))
        if len(body) > max_chars:
            out.append(("over_chars", label))
    return out


LINES = ["## A", "### B  ", "  ## C", "# Title", "text", "", " ", "---", "id: x", "##no", "#### D", "a much longer line of text than the others", "é x", "\x0b## E"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(LINES), max_size=9), st.sampled_from(["", "---\nid: x\n---\n"]), st.sampled_from(["\n", ""])).map(lambda t: t[1] + "\n".join(t[0]) + t[2]), min_size=1, max_size=40))
def test_lint_equals_brute_force(spark, texts):
    got = apply(spark, texts, S.flags(X, 8, 40))
    assert [[(f["rule"], f["section"]) for f in r] for r in got] == [flags(t, 8, 40) for t in texts]


def test_header_ledger_title(spark):
    text = "---\nid: a\n---\n# T\nx\n## Stripping Ledger  \nDropped: a\n### More\nb\n## Next\nc"
    assert apply(spark, [text, "---\nno end", "x"], S.header(X), S.body(X)) == [("id: a", text[14:]), (None, "---\nno end"), (None, "x")]
    assert apply(spark, [text, "## stripping ledger\nlast", "## Ledger\nx"], S.ledger(X)) == ["Dropped: a\n### More\nb\n", "last", ""]
    assert apply(spark, ["a\n# T", "## T", "#T", "# "], S.has_title(X)) == [True, False, False, True]


def test_shingles(spark):
    text = "---\na: 1\n---\nOne two  three\nfour five ```x\ncode\n``` six ONE two three four five"
    words = "one two three four five six one two three four five".split()
    df = spark.createDataFrame([(text,), ("a b c",), ("",)], "x string").select(tokens(plain(X)).alias("w"))
    got = [set(r[0]) for r in df.select(shingles(F.col("w"))).collect()]
    assert got == [{" ".join(words[i : i + 5]) for i in range(7)}, set(), set()]
