import hashlib
import re

import pytest

from framesift.llm import privacy

FIXED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(kind, value):
    digits = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FIXED.items() for m in re.finditer(p, text or "") if checked(k, m[0])]


TEXTS = [None, "", "no data", "a@b.c_d@e.f", "x.34@mail7.example.com, y", "a@b a@b. a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 000.0255.01.1 1.2.3", "1.2.3.4@5.6.7",
         "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 4111111111111111", "+1 (377) 555-0271 +12 +1()()2 +123456789012345678", "+1(((((", "é𝄞 a@b.co 𝄞 1.1.1.1",
         "\x01a@b.c\x02 \x01\x01", "a" * 60_000 + "@" + "b" * 50_000, "a.b@" * 3000, "1." * 20_000, "1 " * 20_000, "+1" * 5000, "%" * 50_000 + " a@b.c", "a@b.c" * 400, "12\n34", "5500005555555559 " * 300]


@pytest.fixture(scope="module")
def spans(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return {r.doc_id: r for r in privacy.examined(rows).select("_row.doc_id", privacy.joined_spans(privacy.F.col("spans")).alias("s"), "term_spans").collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_base_spans_against_plain_patterns(spans, i):
    assert spans[i].s.split(",") == (brute(TEXTS[i]) or [""])


def planted():
    """Agent seven always appears with one address; the other words meet it by chance."""
    rows = []
    for i in [*range(40), *range(200, 400)]:
        rows.append((i, f"report {i} about harbour weather and trade number{i} today"))
    for i in range(40, 46):
        rows.append((i, f"letter {i} Kestrel wrote from the harbour to boss@secret.example.com about weather item{i}"))
    rows += [(100 + i, "copied words unique stand here with lone@secret.example.org often") for i in range(30)]
    return rows


def test_terms_that_give_an_entity_away(spark, docs_of):
    rows = planted()
    got = {r.doc_id: r for r in privacy.examined(docs_of(rows)).select("_row.doc_id", "spans", "term_spans").collect()}
    for i, text in rows:
        words = {s.value.lower() for s in got[i].term_spans}
        if 40 <= i < 46:
            assert {"kestrel", "letter", "wrote"} <= words and not words & {"harbour", "weather", "about"}
            assert all(text[s.start:s.end] == s.value for s in [*got[i].spans, *got[i].term_spans])
        else:
            assert not words  # clean texts, and copies of one text, give nothing away
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs_of(rows)).collect()}
    assert "[EMAIL]" in clean[40] and "[TERM]" in clean[40] and "Kestrel" not in clean[40] and "secret" not in clean[40]
    assert clean[0] == rows[0][1]


def test_sanitised_survives_odd_tables(spark, docs_of):
    odd = docs_of([(None, None), (1, ""), (2, "a@b.co"), (2, "a@b.co")]).selectExpr("*", "1 AS spans", "'t' AS terms", "2 AS _hash")
    out = privacy.sanitised(odd)
    assert out.columns == odd.columns
    assert sorted(repr(r.text) for r in out.collect()) == sorted(["None", "''", "'[EMAIL]'", "'[EMAIL]'"])
    assert privacy.sanitised(docs_of([])).count() == 0


def test_query_digest(spark):
    rows = privacy.op2(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in FIXED]


def test_copying_a_letter_clears_no_name(spark, docs_of):
    rows = planted() + [(500 + i, planted()[240][1]) for i in range(30)]
    assert "Kestrel" in rows[240][1]
    got = {r.doc_id: {s.value.lower() for s in r.term_spans} for r in privacy.examined(docs_of(rows)).select("_row.doc_id", "term_spans").collect()}
    assert all("kestrel" in got[i] for i in [*range(40, 46), *range(500, 530)])
    assert not any(got[i] for i in [*range(40), *range(200, 400), *range(100, 130)])


def test_many_spans_are_replaced_in_order(spark, docs_of):
    """Lists longer than one step, overlapping kinds, and a text with very many matches."""
    rows = [(i, " ".join(f"w{j} é a{j}@b.co" for j in range(n)) + " +4111 1111 1111 1111 end") for i, n in enumerate((0, 1, 63, 64, 65, 130, 4000))]
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs_of(rows)).collect()}
    for i, text in rows:
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute(text)))
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert clean[i] == "".join(out) + text[at:]


def test_a_name_of_an_address_is_hidden_where_it_stands_alone(spark, docs_of):
    rows = [(i, f"common words of text {i} and") for i in range(60)] + [(100, "write to Zaphod at zaphod.12@mail.example.com and common"), (101, "x" * 70_000 + " of mail and@mail.example.org and")]
    got = {r.doc_id: [s.value for s in r.term_spans] for r in privacy.examined(docs_of(rows)).select("_row.doc_id", "term_spans").collect()}
    assert got[100] == ["Zaphod"] and got[101] == [] and not any(got[i] for i in range(60))
