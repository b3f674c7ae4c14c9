import hashlib
import re

from lorespark.llm.queries import op4_secret_scan
from lorespark.llm.secrets import BASE_RULES, MORE_RULES, scan_secrets, trigram_query, trigrams_of


def brute(text, more=False):
    """The contract's patterns, read plainly."""
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    letters = re.sub(r"(password|passwd|secret|token|api_\?key)", lambda m: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in m[0]), assign)
    out += [("assign", m.start(), m.end()) for m in re.finditer(letters, text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


TEXTS = [
    "", None, "token: abcdefgh", "token: abcdefg", "TOKEN='x' secret = \"abc/def+ghi=\" apikey:aaaaaaaaaa", "secret: token: abcdefghij", "token:secret=abcdefgh1", "api_key\n=abcdefghij", "API_KEY = abcdefghij",
    "漢字 password=漢字 password=abcdefghi 🙂 token=ABCDEFGH", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "xAKIAAKIA" + "B" * 12 + "c", "AKIA", "a" * 31, "f" * 32, "0" * 31 + "g" + "1" * 40, "passwd=" + "ab" * 20,
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "token=a token=bbbbbbbbbb " * 300, "PASSWORD\"  :  'hunter2hunter2'", "passwordtoken=12345678",
]


def test_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, "token: abcdefgh"), (None, "token: abcdefgh")], "doc_id long, text string")
    out = scan_secrets(df, rules=BASE_RULES).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        text = "token: abcdefgh" if r.doc_id is None else TEXTS[r.doc_id]
        assert [tuple(s) for s in r.spans] == brute(text or "")
    assert scan_secrets(df.limit(0)).count() == 0


def test_rules_that_the_method_adds(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    kinds = {s.kind for r in scan_secrets(df).collect() for s in r.spans}
    assert {r.kind for r in MORE_RULES} <= kinds


def test_query_over_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_secret_scan(spark, sf_dir).collect():
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in spans) for x in ("assign", "access", "hex"))


def test_trigram_queries():
    assert trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert trigram_query("(abc|xyzw)[0-9]+") == [frozenset({"abc"}), frozenset({"xyz", "yzw"})]
    assert trigram_query("ab?cd") == [frozenset({"abc", "bcd"}), frozenset({"acd"})]
    assert trigram_query("[0-9a-f]{32,}") is None and trigram_query("(abc)?") is None
    assert trigram_query("abc.*def") == [frozenset({"abc", "def"})]


def test_trigrams_of_a_text(spark):
    from pyspark.sql import functions as F

    texts = ["", "tokentoken", "aaaa", "a.c|b", "漢字漢字漢", "xab\nabc"]
    wanted = ["tok", "ken", "nto", "aaa", "a.c", "c|b", "漢字漢", "b\na", "abc", "zzz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = {r.text: set(r.found) for r in df.select("text", trigrams_of(F.col("text"), wanted).alias("found")).collect()}
    assert out == {t: {t[i : i + 3] for i in range(len(t) - 2)} & set(wanted) for t in texts}
