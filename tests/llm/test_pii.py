import hashlib
import random
import re

import regex

from girder.llm import pii

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CASES = [
    None, "", "nothing here", "a@b.c", "a@b.c_x@d.e", "a@b.c@d.e f@g", ".@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.0.0.1", "999999999999.1.1.1 1.1.1.0000000000000000001",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4", "5 5", "+1 (017) 555-7713", "+1", "+12345678", "+1(((((", "+49 30 1234567890123456", "é漢😀 x@y.zz +44 20 7946 0958",
    "1" * 5000, "1-" * 4000 + "1", "a" * 60000 + "@", "1." * 3000,
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(RX[k], text or "", re.A) if valid(k, m[0])]


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    bits = ["a", "7", "42", "255", "4111", "1111", "@", ".", "-", " ", "+", "(", ")", "mail.com", "é", "\n", "_", "%"]
    texts = CASES + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 70))) for _ in range(1500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.op2_personal_data(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in spans) for k in pii.KINDS), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), texts[r.doc_id]
        assert not text or set(text.split(",")) <= set(r.spans.split(","))


def test_bootstrap_discovers_by_context(spark):
    rows = [(i, f"Please call me at +1 (017) 555-{1000 + i} today") for i in range(8)]
    rows += [(100, "please CALL me at 017 555 4242 today"), (101, "the lot number 017 555 4343 is here"), (101, "the lot number 017 555 4343 is here"), (102, None)]
    rows += [(200 + i, f"write to me at user{i}@mail{i}.example.com ok") for i in range(8)] + [(300, "write to me at someone@localhost ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, [(s.kind, s.start, s.stop) for s in r.spans if s not in r.base]) for r in pii.personal_data(df).collect()]
    assert len(out) == len(rows)
    found = {d: s for d, s in out if s}
    # "me at" leads to phone numbers and addresses alike, so neither kind is trusted on it
    assert found == {}
    rows = [(i, t.replace("me at +", "me under +")) for i, t in rows if t] + [(400, "me under 017 555 4242")]
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if s not in r.base] for r in pii.personal_data(spark.createDataFrame(rows, df.schema)).collect()}
    assert found[400] == [("phone", 9, 21)] and found[100] == [("phone", 18, 30)]
    assert found[300] == [("email", 15, 32)] and found[101] == []


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string, base int")).count() == 0


def test_occurrences_without_two_words_in_the_gap_are_marked_too(spark):
    rows = [(i, f"Please call me under +1 (017) 555-{1000 + i} today") for i in range(8)] + [(100, "please call me under 017 555 4242 today")]
    long = "x" * 90
    rows += [(200, "017 555 4242 at the start"), (201, "call 017 555 4242"), (202, "the lots 017 555 9999, 017 555 4242"), (203, f"see {long} 017 555 4242")]
    # contexts that hold a long word or another candidate are patterns too
    rows += [(300 + i, f"{long} under +1 (017) 555-{3000 + i}") for i in range(8)] + [(400, f"{long} under 017 555 4343")]
    rows += [(500 + i, f"room 11111 or +1 (017) 555-{5000 + i}") for i in range(8)] + [(600, "room 11111 or 017 555 4444")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans if s not in r.base] for r in pii.personal_data(df).collect()}
    text = dict(rows)
    for doc, number in [(100, "017 555 4242"), (200, "017 555 4242"), (201, "017 555 4242"), (202, "017 555 4242"), (203, "017 555 4242"), (400, "017 555 4343"), (600, "017 555 4444")]:
        at = text[doc].index(number)
        assert found[doc] == [("phone", at, at + 12)], doc


ASKED = regex.compile(pii.CANDIDATE, regex.A)


def plain_spans(texts):
    """All spans of each text: the base ones, and what the bootstrap finds, by loops over dictionaries."""
    base, met, edges = {}, [], set()
    for d, text in texts.items():
        text = text or ""
        base[d] = [(pii.KINDS.index(k), a, k, b) for k, a, b in brute(text)]
        for m in ASKED.finditer(text):
            a, b = m.span()
            exact = [k for _, x, k, y in base[d] if (x, y) == (a, b)]
            if not exact and any(x < b and a < y for _, x, _, y in base[d]):
                continue
            before = re.sub(r" [\"'(]*$", "", re.sub(r"\s+", " ", text[:a], flags=re.A))
            two = " ".join(before.split(" ")[-2:]).lstrip(" ")
            kind = exact[0] if exact else None
            met.append((d, a, b, m[0].lower(), kind))
            if " " in two:
                edges.add((two.lower(), m[0].lower(), kind))
    known = {(i, k): 1.0 for _, i, k in edges if k}
    members, unknown = {}, {}
    for p, i, k in edges:
        members.setdefault(p, set()).add(i)
        if k is None:
            unknown.setdefault(i, set()).add(p)
    scores = dict(known)
    for _ in range(pii.ROUNDS):
        by_instance, trusted = {}, {}
        for (i, k), s in scores.items():
            by_instance.setdefault(i, []).append((k, s))
        for p, own in members.items():
            mass, support = {}, {}
            for k, s in (x for i in own for x in by_instance.get(i, ())):
                mass[k] = mass.get(k, 0) + s
                support[k] = support.get(k, 0) + (s >= pii.ACCEPT)
            trusted[p] = {k: m / len(own) for k, m in mass.items() if support[k] >= pii.MIN_SUPPORT and m / len(own) >= pii.TRUST}
        scores = dict(known)
        for i, patterns in unknown.items():
            doubt = {}
            for k, c in (x for p in patterns for x in trusted[p].items()):
                doubt[k] = doubt.get(k, 1.0) * max(1e-9, 1 - c)
            if doubt:
                s, k = max((1 - x, k) for k, x in doubt.items())
                scores[i, k] = max(s, scores.get((i, k), 0))
    seeds = {i for i, _ in known}
    new = {i: k for (i, k), s in scores.items() if i not in seeds and s >= pii.ACCEPT and ("@" in i or sum("0" <= c <= "9" for c in i) >= pii.MIN_DIGITS)}
    for d, a, b, i, kind in met:
        if kind is None and i in new:
            base[d].append((pii.KINDS.index(new[i]), a, new[i], b))
    return {d: ",".join(f"{k}:{a}:{b}" for _, a, k, b in sorted(set(own))) for d, own in base.items()}, new


def test_all_spans_against_a_plain_bootstrap(spark, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.spans for r in pii.op2_personal_data(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_spans(texts)[0]
    # contexts that share instances, some known and some not, over several rounds
    rnd = random.Random(6)
    numbers = [f"+1 (017) 555-{1000 + i}" for i in range(40)] + [f"017 555 {2000 + i}" for i in range(40)] + [f"lot {i:07d}" for i in range(10)]
    ways = ["call me under", "phone, office:", "room 12345 (", "reach us on", "see", "order no"]
    texts = {i: " and ".join(f"{rnd.choice(ways[: 2 + i % 5])} {rnd.choice(numbers[: 10 + i])}" for _ in range(rnd.randrange(1, 5))) for i in range(80)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, new = plain_spans(texts)
    assert {r.doc_id: r.spans for r in pii.op2_personal_data(spark, str(tmp_path)).collect()} == want
    assert len(new) > 5
