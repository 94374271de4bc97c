"""Base patterns against the plain regular expressions, and what the field adds."""

import hashlib
import random
import re

from stackroom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda t: re.sub("[^0-9]", "", t)

    def luhn(d):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_base_patterns_equal_the_plain_expressions():
    rng = random.Random(11)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "255.255.255.256", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "+12", ".", "-", " ", "  ", "9", "12", "é", "٣", "z", "@@", "..", "\n", "(", ")"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_base_patterns_on_the_documents_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in pii.find_personal_data(rows).collect():
        base = plain(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        names = [f"{pii.KINDS[k]}:{lo}:{hi}" for k, lo, hi in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",")) or not names


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 50_000, "1." * 100_000, "+1" * 50_000, "1 " * 100_000):
        pii.base_spans(text)


def weights(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_facts_spread_to_similar_tokens_and_no_further(spark):
    w = weights(spark)
    text = "Call +1 (988) 555-2485 today. Later: 988-555-2485, order 7731 2290 118 of 1234567. Write to jo.42@mail8.example.com, or jo.42 at mail8 dot example dot com, not al at home dot example dot org"
    base, spans = pii.find(text, w)
    assert base == plain(text)
    added = [text[lo:hi] for k, lo, hi in spans if (k, lo, hi) not in base]
    assert added == ["jo.42 at mail8 dot example dot com", "988-555-2485"]
    assert [k for k, lo, hi in spans if (k, lo, hi) not in base] == [0, 3]
    assert pii.mask(text, spans).startswith("Call <PHONE> today. Later: <PHONE>, order 7731 2290 118 of 1234567. Write to <EMAIL>, or <EMAIL>")
    for alone in ("988-555-2485 and 988-555-2485", "at 5.203.196.18 5755695738806562 and jo@a.b 0007687199101951"):
        base, spans = pii.find(alone, w)
        assert spans == base == plain(alone)


def test_a_repeated_number_makes_a_chain():
    text = "+1 (988) 555-2485 " + "9885552485 , " * 2000
    nodes = pii.nodes_of(text, pii.base_spans(text))
    assert len(pii.skip_edges(nodes)) <= 2 * len(nodes)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.c"), (2, "")], "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = sorted((str(r.doc_id), r.n_email, r.spans) for r in pii.find_personal_data(df).collect())
    assert got == [("1", 0, ""), ("2", 0, ""), ("2", 0, ""), ("None", 1, "email:0:5")]
    assert pii.find_personal_data(df.limit(0)).count() == 0
    assert sorted(str(r.text) for r in pii.redact(df).collect()) == ["", "", "<EMAIL>", "None"]


def test_the_last_equal_token_keeps_its_edge():
    # The equal one first, then one that shares nine digits and one that shares seven.
    keys = ["15551234567", "925551234567", "38881234567", "15551234567"]
    nodes = [pii.Node(k, k + 1, None, key, []) for k, key in enumerate(keys)]
    assert pii.skip_edges(nodes)[-3:] == [(0, 3), (1, 3), (2, 3)]


def test_repeats_inside_longer_runs_of_digits(spark):
    w = weights(spark)
    known = "Call +1 555 123 4567 or +44 20 7946 0958 now. "
    for rest, masked in (
        ("Later 1 555 123 4567 7731 2290 and so on", "Later <PHONE> 7731 2290 and so on"),
        ("List 555 123 4567 44 20 7946 0958 7731 2290 1184 end", "List <PHONE> <PHONE> 7731 2290 1184 end"),
        ("Order 90 000 118 (555) 123-4567 it was", "Order 90 000 118 <PHONE> it was"),
        ("Only 7731 2290 118 7731 2290 118 7731 2290 118 here", "Only 7731 2290 118 7731 2290 118 7731 2290 118 here"),
    ):
        assert pii.mask(known + rest, pii.find(known + rest, w)[1]) == "Call <PHONE> or <PHONE> now. " + masked


def test_learning_counts_every_candidate(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "train", lambda counts: seen.append(counts))
    texts = [" , ".join(f"{k} +1 555 {k:03d} 4567" for k in range(300)), "7731 2290 118 " * 40, None]
    pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = sum((pii.tally(pii.nodes_of(t, pii.base_spans(t), False)) for t in texts if t), pii.Counter())
    assert seen == [want]
    assert sum(n for (what, kind, _, _), n in want.items() if what == "node" and kind == 3) == 300
