import hashlib
import re

import pytest

from vicinage.llm import pii, queries
from vicinage.llm.common import Scratch

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()  # noqa: B023
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "a@b.c", "a@b.c_d@e.f.g x@y.z-", "a@b @c.d e@f..g", "%@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.0255 1.2.3", "999.1.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111111 41111111111111112222",
    "4111  1111 1111 1111 1234", "0000000000000000 00000000000000000000", "+1 (234) 555-0199. +123 +1-2 +49 30 1234567890123456 +1+2+33 444 5555", "é😀 a@b.co 😀 +33 1 23 45 67 89 ü 10.0.0.1", "x" * 20000 + "@" + "y" * 10, "a.b." * 6000 + "@x.y", "u@" + "a." * 6000 + "b", "1 " * 5000, "+1" + " " * 5000 + "2", "user@mail.com," * 1500, "12.34.56.78\n9.9.9.9",
    "mail me: john [at] site [dot] com or jane(at)corp.org", "call (415) 555-2671 now, tel 415-555-2671, ssn 123-45-6789 part 555 123 4567",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_base_spans_equal_the_rules(spark, frame):
    got = {r.doc_id: r.spans for r in pii.find(frame, Scratch(spark, "t").save).collect()}
    for i, text in enumerate(TEXTS):
        assert [(pii.KINDS[x.kind], x.s, x.e) for x in got[i] if x.kind < 4] == base(text), text and text[:60]


def test_added_spans_do_not_touch_base_ones(spark, frame):
    more = spark.createDataFrame([(100 + i, f"phone: (415) 555-{1000 + i}, mail a{i} [at] b.com") for i in range(40)], "doc_id long, text string")
    got = pii.find(frame.unionByName(more), Scratch(spark, "t").save).collect()
    added = [(r.doc_id, x) for r in got for x in r.spans if x.kind >= 4]
    assert len([1 for i, _ in added if i >= 100]) == 80
    for i, x in added:
        if i < 100:
            assert all(x.e <= s or e <= x.s for _, s, e in base(TEXTS[i]))


def test_query_digests(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op3_pii(spark, str(tmp_path)).collect():
        want = base(TEXTS[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, *_ in want) for n in RULES)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and (r.spans + ",").startswith(listed)


def test_main_path_is_native(spark, frame):
    plan = pii.with_spans(pii.candidates(pii.extract(frame, frame["text"])), pii.Model({}, {}, {("bias",): 0.0}))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction(spark, awkward, nothing):
    docs = spark.createDataFrame([(1, "write a@b.com or +1 (234) 555-0199!", 5, "z"), (2, None, 6, "z"), (3, "plain", 7, "z"), (None, "1.2.3.4", 7, "z"), (4, "a@1.2.3.4", 7, "z")], "doc_id long, text string, n_chars long, spans string")
    out = pii.redact(docs, Scratch(spark, "t").save)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars, r.spans) for r in out.collect()}
    assert got == {1: ("write [EMAIL] or [PHONE]!", 25, "z"), 2: (None, 0, "z"), 3: ("plain", 5, "z"), None: ("[IP]", 4, "z"), 4: ("[EMAIL]", 7, "z")}
    assert pii.redact(awkward, Scratch(spark, "t").save).count() == awkward.count() and pii.redact(nothing, Scratch(spark, "t").save).count() == 0


def test_redaction_masks_partly_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "+49 30 1234 567 12john@x.com"), (2, "x a@1.2.3.4 y")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs, Scratch(spark, "t").save).collect()}
    assert "john" not in got[1] and "x.com" not in got[1] and got[1].endswith("[EMAIL]") and got[2] == "x [EMAIL] y"


def test_many_spans_in_one_text(spark, nothing):
    """20,000 spans of base and added kinds, alternating: every added one is free, the masked text holds none."""
    line = "phone +49 30 {a}, mail a{b}@b.com, tel 415-555-{c:04d}"
    text = "\n".join(line.format(a=1_000_000 + i, b=i, c=1000 + i % 9000) for i in range(6667))
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs, Scratch(spark, "t").save).collect()}
    assert [(pii.KINDS[x.kind], x.s, x.e) for x in spans[1] if x.kind < 4] == base(text)
    more = [(pii.KINDS[x.kind], text[x.s : x.e]) for x in spans[1] if x.kind >= 4]
    assert more == [("phone_like", f"415-555-{1000 + i % 9000:04d}") for i in range(6667)]
    masked = {r.doc_id: r.text for r in pii.redact(docs, Scratch(spark, "t").save).collect()}
    assert masked[1] == "\n".join(["phone [PHONE], mail [EMAIL], tel [PHONE_LIKE]"] * 6667) and masked[2] == ""
    assert pii.find(nothing, Scratch(spark, "t").save).count() == 0


def test_dropped_matches_are_decided_by_the_votes(spark):
    """Numbers that fail their check are rejected, but for those that everything else speaks for."""
    rows = [(i, f"Anea thand {9999111111111112 + 10 * i} onthe, 300.1.2.{i % 256} of") for i in range(60)]
    rows = [r for r in rows if not base(r[1])] + [(1000 + i, "pay by visa card 4111111111111112 now") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Scratch(spark, "t").save(pii.candidates(pii.extract(docs, docs["text"])).select("doc_id", "_cands"))
    model = pii.learn(found)
    got = {r.doc_id: r._spans for r in pii.with_spans(found, model).collect()}
    offered = sum(len(r._cands) for r in found.collect())
    taken = {i for i, spans in got.items() if spans}
    assert offered > 100 and taken == {1000 + i for i in range(12)}
    card, ip = (pii.KINDS.index(k) for k in ("card_like", "ip_like"))
    assert model.prior[ip] < 0.1 and model.reliability[card, "cx"][1][0] > model.reliability[card, "cx"][1][1]


def test_added_forms(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 please", "account GB29NWBK60161331926819", "call 0301234567 today", "order 1234567890", "token=ab12345678cd 12345678.5", "FOOBAR12 ABCD"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[x.kind], texts[r.doc_id][x.s : x.e]) for x in r.spans] for r in pii.find(docs, Scratch(spark, "t").save).collect()}
    assert got[0] == [("iban_like", "DE89 3704 0044 0532 0130 00")] and got[1] == [("iban_like", "GB29NWBK60161331926819")]
    assert got[2] == [("number_like", "0301234567")] and got[3] == got[4] == got[5] == []


def test_expectation_maximisation_tells_good_labelers(spark):
    rows = [("call tel (415) 555-%04d" % i, i) for i in range(300)] + [("order 015 015 %04d" % i, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "text string, doc_id long")
    model = pii.learn(pii.candidates(pii.extract(df, df["text"])).select("_cands"))
    k = pii.KINDS.index("phone_like")
    assert model.reliability[k, "cx"][1][0] > model.reliability[k, "cx"][1][1]
    spans = {r.doc_id: len(r.spans) for r in pii.find(df, Scratch(spark, "t").save).collect()}
    assert all(spans[i] == 1 for i in range(300)) and not any(spans[1000 + i] for i in range(300))
