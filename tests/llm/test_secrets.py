"""Fixed patterns against a plain reading of their definition, random strings against hand cases."""

import hashlib
import random
import re
import string

from hazardline.llm.secrets import secret_scan

PLAIN = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [s for _, _, s in sorted(found)]


def test_base_spans_and_counts(spark):
    rng = random.Random(0)
    parts = ["token", "Secret", "API_KEY", "apikey", "PassWord", "passwd", "toKen", "Key", "=", ": ", ' = "', "':", "abc", "a1b2c3d4e5", "AKIA", "ABCD1234EFGH5678", "AKIA", "é", " ", "\n", "0123456789abcdef", "-", "x" * 5]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))) for i in range(400)] + [(1, None), (None, ""), (2, "token:token:abcdef")]
    got = secret_scan(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string").repartition(3), mask="[secret]").collect()
    want = sorted(((d, *(sum(s.startswith(k) for s in brute(t)) for k in PLAIN), hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == want
    for r in got:
        kept = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256
        assert r.masked is None or not brute(r.masked) or "[secret]" in r.masked


def test_random_strings_and_exceptions(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(20)]
    fine = ["5d41402abc4b2a76b9719d911017c592"[:23].upper() + "Q" * 0, "123e4567-e89b-12d3-a456-426614174000", "internationalization2024", "getUserAccountName2", "some_long_snake_case_name_v2", "1234567890123456", "Donaudampfschifffahrt", "onthhehandthhaanere"]
    fine[0] = "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709"
    df = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {k} there") for i, k in enumerate(fine)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan(df, mask="*").collect()}
    assert sum(got[i].n_random for i in range(20)) >= 19
    assert [got[100 + i].n_random for i in range(len(fine))] == [0] * len(fine)
    assert got[0].masked == "see * there" and got[0].spans == "random:4:36"
    assert secret_scan(df.limit(0)).count() == 0


def test_long_runs_take_linear_time(spark):
    runs = ["x" * 5000 + "A1", "ab" * 3000 + "1-", "1" * 4000 + "a"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "doc_id long, text string")
    assert secret_scan(df).count() == 3
    assert all(r.n_random in (0, 1) for r in secret_scan(df).collect())


def test_keys_beside_words_and_base_spans_are_found(spark):
    rng = random.Random(4)
    new = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    before = ["database_connection_credentials_value=", "/en/articles/archive/files/downloads/public/", "authorization_value="]
    keys = [(w, new(n)) for w in before for n in (16, 20, 24, 32) for _ in range(25)]
    rows = [(i, f"see {w}{k} there") for i, (w, k) in enumerate(keys)]
    half = [f"AKIA{'Q7' * 8}/{new(40)}", f"/{new(32)}/token=abcdef"]
    letters = ["".join(rng.choice(string.ascii_letters) for _ in range(32)) for _ in range(20)]
    fine = ["/files/123e4567-e89b-12d3-a456-426614174000", "/a/DA39A3EE5E6B4B0D3255BFEF95601890AFD80709/x", "/en/articles/2024/01/15/some-long-title-of-words/"]
    rows += [(1000 + i, t) for i, t in enumerate(half)] + [(2000 + i, t) for i, t in enumerate(letters)] + [(3000 + i, t) for i, t in enumerate(fine)]
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string"), mask="*").collect()}
    hit = [k not in got[i].masked for i, (_, k) in enumerate(keys)]
    assert sum(hit) >= 0.97 * len(keys), sum(hit)
    assert got[1000].n_random == got[1001].n_random == 1
    assert sum(got[2000 + i].n_random for i in range(20)) >= 18
    assert [got[3000 + i].n_random for i in range(len(fine))] == [0] * len(fine)
