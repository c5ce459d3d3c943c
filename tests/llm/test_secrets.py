import hashlib
import random
import re

from lorekeep.llm import queries, secrets

SCHEMA = "doc_id long, text string, source string"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    """Base spans as the contract says them: match, then drop what is too short."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def spelled(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check(rows, out):
    assert len(rows) == len(out)
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r)
    for d, text in rows:
        b = base(text)
        r = next(r for r in found[d] if r.base_sha256 == hashlib.sha256(spelled(b).encode()).hexdigest())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in b) for i in range(3))
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert [x for x in spans if x[0] != "owned"] == [[secrets.KINDS[k], str(s), str(e)] for s, k, e in b]
        assert all(0 <= int(s) < int(e) <= len(text or "") for _, s, e in spans)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op4_ownership(spark, sf).collect()
    check(rows, out)
    assert sum(r.n_assign for r in out) > 0


def test_odd_texts(spark):
    rng = random.Random(2)
    bits = ["password", "PassWord", "ſecret", "tokKen", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "abcdefgh", "A1b2C3d4", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "𝄞", "\n", "passwd"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "token=" + "x" * 200_000), (None, "secret: abcdefgh1"), (1, "token: 12345678"), (1, "token: 12345678")]
    df = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA).selectExpr("*", "1 as spans", "2 as row", "'k' as key")
    check(rows, secrets.find(df).collect())
    assert secrets.find(df.limit(0)).collect() == []


LIVE, COPIED = "Zx81kQm2Lp9Rt4Vw7Yb3Nc6Hd", "Qw4Er7Ty2Ui9Op3As6Df1Gh8J"


def corpus(spark):
    rows = [(i, f"how to: token = {COPIED} and {COPIED}x{i % 2} seen", f"owner{i}") for i in range(6)] + [(10, f"key {LIVE} here, token = {LIVE}9", "owner1"), (11, f"again {LIVE}", "owner1"), (12, "password: changeme1234567", "owner2")]
    return spark.createDataFrame(rows, SCHEMA)


def test_ownership_tells_copied_examples_from_live_ones(spark):
    out = {r.doc_id: r for r in secrets.find(corpus(spark)).collect()}
    assert out[0].n_copied >= 1 and out[0].n_live == 0 and "owned" not in out[0].spans
    assert out[10].spans == f"owned:4:{4 + len(LIVE)},assign:{4 + len(LIVE) + 7}:{4 + len(LIVE) + 7 + 8 + len(LIVE) + 1}" and out[10].n_live == 2
    assert out[11].n_live == 1 and out[12].n_live == 0 and out[12].n_assign == 1
    held = {r.owners: r.repositories for r in secrets.ownership(secrets.findings(corpus(spark))).collect()}
    assert held[6] == 6 and held[1] in (1, 2)


def judged(rows, max_owners=2):
    """doc_id -> (spans, n_live, n_copied, live_repositories) by the definition, from all rows at once."""
    values, held = {}, {}
    for d, text, source in rows:
        b = base(text)
        found = [(s, k, e, ASSIGN.match(text, s)[2] if k == 0 else text[s:e]) for s, k, e in b]
        for m in re.finditer("[A-Za-z0-9+_-]+", text or ""):
            if len(m[0]) >= 20 and secrets.looks_random(m[0]) and not any(s < m.end() and e > m.start() for s, _, e in b):
                found.append((m.start(), 3, m.end(), m[0]))
        values[d] = found
        for *_, x in found:
            held.setdefault(x, set()).add((d, source))
    out = {}
    for d, found in values.items():
        owners = lambda x: len({s for _, s in held[x]})
        live = [f for f in found if owners(f[3]) <= max_owners and secrets.looks_random(f[3])]
        spans = sorted([f[:3] for f in found if f[1] < 3] + [f[:3] for f in live if f[1] == 3])
        out[d] = (spelled(spans), len(live), sum(owners(f[3]) > max_owners for f in found), max((len({i for i, _ in held[f[3]]}) for f in live), default=0))
    return out


def test_added_spans_and_counts_equal_the_definition(spark):
    """Spans that the method adds, verdicts and the spread of live values, over whole tables."""
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rng.randint(18, 40))) for _ in range(12)] + ["0123456789abcdef" * 2, "AKIA" + "Z9Y8X7W6V5U4" * 2, "changeme1234567890abcdef"]
    texts = [" ".join(rng.choice(["see", "token=", "secret: ", "key"]) + " " * rng.randint(0, 1) + rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(150)]
    rows = [(i, t, f"owner{rng.choice([1, 1, 1, 2, 3, 4])}") for i, t in enumerate(texts)]
    rows += [(1000 + r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = judged(rows)
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied, r.live_repositories) for r in secrets.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want
    assert any("owned" in x[0] for x in want.values()) and any(x[2] for x in want.values()) and any(x[3] > 1 for x in want.values())


def test_redaction(spark):
    df = corpus(spark).selectExpr("*", "length(text) as n_chars", "'en' as lang")
    out = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert secrets.redact(df).columns == df.columns and len(out) == df.count()
    assert out[10].text == "key [secret] here, [secret]" and out[10].n_chars == len(out[10].text) and out[11].text == "again [secret]"
    assert COPIED in out[0].text and out[12].text == "[secret]"
    odd = spark.createDataFrame([(None, None, None), (1, "", "o"), (2, f"a {LIVE}", "o"), (2, f"a {LIVE}", "o")], SCHEMA)
    assert sorted(map(str, (r.text for r in secrets.redact(odd).collect()))) == ["", "None", "a [secret]", "a [secret]"]


def test_masking_overlaps():
    assert secrets.masked("abcdefgh", [(1, 3), (2, 5), (7, 8)], "*") == "a*fg*"
