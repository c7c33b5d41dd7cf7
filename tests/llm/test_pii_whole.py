import math
import random

from pyspark.sql import functions as F

from covenant.llm import pii
from covenant.llm.pii import TERM, pii_spans, sanitise

FILL = [f"plain{i}" for i in range(40)]


def common_rows(n=1_000):
    """Texts of common words only, none of them near an entity."""
    rnd = random.Random(6)
    return [(i, " ".join(rnd.choices(FILL, k=12))) for i in range(n)]


def term_words(docs, **limits):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    return {(r.doc_id, texts[r.doc_id][s.start:s.end]) for r in pii_spans(docs, **limits).collect() for s in r.spans if s.kind == TERM}


def test_entities_of_one_text_and_recurring_units(make_docs):
    """Every address occurs in one text only; "helpdesk" goes with their domain, "quorvath" stands in one text: no evidence."""
    rows = common_rows() + [(5000 + i, f"{FILL[i]} helpdesk {FILL[i + 1]} user{i}@desk.example.org") for i in range(8)]
    rows += [(6000, f"{FILL[0]} quorvath {FILL[1]} some.one@mail.example.net")]
    want = {(5000 + i, "helpdesk") for i in range(8)}
    assert term_words(make_docs(rows)) == want
    # copies of a text are no evidence
    assert term_words(make_docs(rows + rows[-1:] * 30)) == want
    assert term_words(make_docs(rows), confidence=4.5) == set()


def test_evidence_does_not_follow_from_the_size_of_the_corpus(make_docs):
    """Words of one or two texts that hold entities stay clean in a small corpus and in one eight times as large."""
    for n in (200, 1600):
        rnd = random.Random(n)
        rows = [(i, f"{rnd.choice(FILL)} once{i} twice{i // 2} " + (f"u{i}@host{i}.example.org" if i % 10 < 2 else "none")) for i in range(n)]
        assert term_words(make_docs(rows)) == set()


def test_chance(spark):
    got = spark.range(1).select(*[pii.log_chance(F.lit(a), F.lit(b), 0.1) for a, b in ((3, 3), (5, 10), (1, 10), (0, 4))]).first()
    assert abs(got[0] - 3 * math.log(0.1)) < 1e-12 and got[2] == got[3] == 0
    exact = sum(math.comb(10, k) * 0.1 ** k * 0.9 ** (10 - k) for k in range(5, 11))
    assert math.log(exact) <= got[1] < 0


def test_words_that_no_unit_can_make_up_for_meet_none(make_docs, monkeypatch):
    """Of hundreds of words, many of them beside entities, only what such texts hold beyond chance is kept and joined."""
    sizes, stage = {}, pii.stage_table

    def staged(df, name, **more):
        out = stage(df, name, **more)
        if "term" in out.columns:
            sizes[name] = out.count()
        return out
    monkeypatch.setattr(pii, "stage_table", staged)
    rows = common_rows() + [(5000 + i, f"{FILL[i]} helpdesk once{i} user{i}@desk.example.org") for i in range(12)]
    rows += [(7000 + i, f"{FILL[i % 40]} seldom{i} pair{i // 2} " + (f"u{i}@host{i}.example.org" if i % 2 else "none")) for i in range(200)]
    assert term_words(make_docs(rows)) == {(5000 + i, "helpdesk") for i in range(12)}
    assert set(sizes.values()) == {1}


def test_bound(spark):
    got = spark.range(1).select(*[pii.lower_bound(F.lit(a), F.lit(b), 1.645) for a, b in ((1, 1), (20, 20), (5, 10))]).first()
    for g, (a, b) in zip(got, ((1, 1), (20, 20), (5, 10))):
        z2, p = 1.645 ** 2, a / b
        assert abs(g - (p + z2 / 2 / b - 1.645 * math.sqrt(p * (1 - p) / b + z2 / 4 / b / b)) / (1 + z2 / b)) < 1e-12


def test_terms_far_from_the_entity_and_without_it(make_docs):
    """"farlow" stands far from the entity, and in one text without any."""
    far = " ".join(FILL)
    rows = common_rows() + [(5000 + i, f"farlow {FILL[i]} {far} user{i}@desk.example.org farlow") for i in range(12)]
    rows += [(7000, f"{FILL[3]} Farlow {FILL[5]}")]
    docs = make_docs(rows)
    assert term_words(docs) == {(5000 + i, "farlow") for i in range(12)} | {(7000, "Farlow")}
    texts = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert texts[7000] == f"{FILL[3]} [WORD] {FILL[5]}"
    assert texts[5000] == f"[WORD] {FILL[0]} {far} [EMAIL] [WORD]"
    assert texts[0] == rows[0][1]
