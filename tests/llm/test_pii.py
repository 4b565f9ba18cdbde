import hashlib
import re

from quarrykit.llm import pii

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
HOSTILE = [
    "😀 é a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 1.1.1 0000255.1.1.1 4111 1111-1111 1111 x 4111111111111111 12 +1 (22) 333-4444 5 +9 .",
    " ".join(f"user{i}@h.com" for i in range(1500)),
    "4111111111111111 4111111111111111", "4111-1111-1111-1111--4111 1111 1111 1111", "+12345678\n+123456789 +1234567890123456", "a@b..c @ a@b a@b.c.",
]


def luhn(hit):
    d = [int(c) for c in hit if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = sum(c.isdigit() for c in m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= digits <= 19 and luhn(m[0])) or kind == "phone" and not 9 <= digits <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(out))


def test_base_equals_brute_force(spark, docs, rows):
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(HOSTILE)], "doc_id long, text string"))
    got = pii.report(every).collect()
    assert len(got) == len(rows) + len(HOSTILE)
    texts = {r[0]: r[1] for r in rows} | {10**6 + i: t for i, t in enumerate(HOSTILE)}
    for r in got:
        if r["doc_id"] is not None:
            want = brute(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (r["doc_id"], r["spans"], want)
            assert r["n_email"] == want.count("email:") and set(want.split(",")) <= set(r["spans"].split(","))


def test_patterns_find_unseen_identifiers(spark):
    seen = [(i, f"Note {i}. Please reach our desk at id: user{i}@mail.org today") for i in range(8)]
    unseen = [(20, "Note. Please reach our desk at id: QX-99812-7 today"), (21, "Chapter number 12345678 begins"), (22, "Please reach our desk at id: nobody today")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(seen + unseen, "doc_id long, text string")).collect()}
    at = unseen[0][1].index("QX")
    assert got[20] == f"context:{at}:{at + 10}" and got[21] == "" and got[22] == "" and got[0].startswith("email:")


def test_short_digit_tails_are_candidates(spark):
    seen = [(i, f"Note {i}. Please reach our desk at id: user{i}@mail.org today") for i in range(8)]
    ids = ["EMP1234", "CASE-4471", "ABCDE12", "user.name7", "1ABCD", "12345"]
    unseen = [(20 + i, f"Note. Please reach our desk at id: {x} today") for i, x in enumerate([*ids, "abc1", "nobody", "12-4"])]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(seen + unseen, "doc_id long, text string")).collect()}
    at = unseen[0][1].index("EMP")
    assert [got[20 + i] for i in range(len(unseen))] == [f"context:{at}:{at + len(x)}" for x in ids] + ["", "", ""]
    whole = re.compile(r"[A-Za-z0-9._%+@-]+")
    for text in HOSTILE + ["aa1 a1 abc-1 _x12y. é1234é x" + "a" * 3000 + " " + "a" * 3000 + "1 1a"]:
        assert [m[0] for m in re.finditer(pii.CANDIDATE, text)] == [t for t in whole.findall(text) if len(t) >= 5 and re.search("[0-9]", t)]


def test_empty(empty):
    assert pii.report(empty).count() == 0


def test_shapes_and_words_after_find_unseen_identifiers(spark):
    seen = [(i, f"x{i} +1 (55{i}) 555-000{i} rest") for i in range(8)]
    unseen = [(20, "so +1 (550) 555-0101 1.2.3.4 5 and"), (21, "the 300.2.3.4 and 1234567890123456")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(seen + unseen, "doc_id long, text string")).collect()}
    assert got[20].startswith("context:12:20,") and got[21] == "" and got[3] == "phone:3:20"


def test_long_runs_end(spark):
    texts = ["a@b" + ".c" * 100_000, "a" * 1_000_000, "1" * 200_000, "+1" * 50_000, "+1" + "." * 100_000, "ab1cd " * 30_000, "a@" * 50_000]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["spans"] == "email:0:200003" and not got[1]["spans"] and not got[2]["spans"]
