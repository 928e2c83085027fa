"""The wide forms of personal data, in a corpus full of them and in one where they are rare."""

import random
import re

from gridloom.llm import pii

SCHEMA = "doc_id long, text string"


def test_wide_forms_are_redacted_where_they_are_common(spark):
    rnd = random.Random(8)
    phone = lambda: f"({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}"
    rows = [(i, f"call {phone()} or write bob{i} (at) mail{i} (dot) com and a{i}@b.org from 10.0.0.{i % 256} end") for i in range(300)]
    rows += [(1000, "card 4222222222222 end"), (1001, "card 4222222222223 end"), (1002, "look (at) this. Then go"), (1003, "no 4111 1111 1111 1112 end")]
    got = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(300)} == {"call [phone] or write [email] and [email] from [ip] end"}
    assert got[1000] == "card [card] end"
    assert all(got[i] == dict(rows)[i] for i in (1001, 1002, 1003))


def test_a_rare_kind_beside_a_common_one_keeps_its_threshold(spark):
    """Ten national numbers among thousands of addresses, one of them repeated in a third of the rows."""
    rows = [(i, "same@copy.org" if i % 3 == 0 else f"a{i}@b.org") for i in range(6000)] + [(10_000 + i, f"call (843) 555-10{i:02d} end") for i in range(10)]
    got = pii.redacted(spark.createDataFrame(rows, SCHEMA), max_sample=400).where("doc_id >= 10000").collect()
    assert {r.text for r in got} == {"call [phone] end"}


def test_a_log_of_twelve_thousand_spans(spark):
    """One text far longer than a block of any running total, with spans that touch and nest; spans and redaction by hand."""
    line = lambda i: f"é {i} user{i}@host{i % 7}.example.com 10.{i % 256}.{i // 256 % 256}.7 +1 (843) 555-{i % 9000 + 1000} 4111111111111111 a1@b.c10.0.0.{i % 256}\n"
    text = "".join(line(i) for i in range(2400))
    row = pii.personal_data(spark.createDataFrame([(1, text)], SCHEMA)).first()
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert row.n_email == len(email) == 4800 and row.n_phone == row.n_card == 2400 and row.n_ip > 2400
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(","))]
    assert [(a, b) for k, a, b in spans if k == "email"] == email and [s[1] for s in spans] == sorted(s[1] for s in spans)
    merged = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    want, at = "", 0
    for kind, a, b in merged:
        want, at = want + text[at:a] + f"[{kind}]", b
    assert pii.redacted(spark.createDataFrame([(1, text)], SCHEMA)).first().text == want + text[at:]
