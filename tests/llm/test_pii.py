import hashlib
import math
import random
import re
from collections import Counter

import pytest

from covenant.llm import pii
from covenant.llm.pii import KINDS, pii_report, pii_spans, sanitise


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [(re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
        (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
        (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15)]


def base(text):
    return sorted((m.start(), k, m.end()) for k, (rx, ok) in enumerate(BASE) for m in rx.finditer(text or "") if ok(m[0]))


def line(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def word_spans(rows):
    """Disclosing words by plain counting over whole texts, per text."""
    word = re.compile(r"[^\W_]+")
    texts = sorted({t or "" for _, t in rows})
    n, holds, places, bags = len(texts), {}, {}, {}
    for t in texts:
        spans = base(t)
        clean = list(t)
        for a, _, b in spans:
            clean[a:b] = " " * (b - a)
        clean = "".join(clean)
        places[t] = [(m[0].lower(), m.start(), m.end()) for m in word.finditer(clean)]
        bags[t] = {w for w, _, _ in places[t]}
        units = set()
        for a, k, b in spans:
            v = t[a:b].lower()
            group = v.split("@")[-1] if k == 0 else ".".join(v.split(".")[:2]) if k == 1 else digits(v)[:6 if k == 2 else 4]
            units |= {("e", k, v), ("g", k, group), ("k", k)}
        holds[t] = units
    docs_t, docs_u = Counter(w for t in texts for w in bags[t]), Counter(u for t in texts for u in holds[t])
    rate = sum(bool(holds[t]) for t in texts) / n
    both, size, tests = Counter(), {}, 0
    for t in texts:
        mine = {t if docs_u[u] == 1 else u: docs_u[u] for u in holds[t] if docs_u[u] < n}
        tests += len(mine) * len(bags[t])
        for u, c in mine.items():
            for w in bags[t]:
                if docs_t[w] <= c ** pii.THRESHOLD * n ** (1 - pii.THRESHOLD) * (1 + 1e-9):
                    both[w, u] += 1
                    size[u] = c
    flagged, z2 = set(), pii.CONFIDENCE ** 2
    for (w, u), k in both.items():
        m, p = docs_t[w], k / docs_t[w]
        low = (p + z2 / 2 / m - pii.CONFIDENCE * math.sqrt(p * (1 - p) / m + z2 / 4 / m / m)) / (1 + z2 / m)
        kl = sum(x * math.log(x / y) for x, y in ((p, rate), (1 - p, 1 - rate)) if x > 0)
        chance = -m * kl if p > rate else 0.0
        if math.log2(low * n / size[u]) / math.log2(n / size[u]) >= pii.THRESHOLD and chance <= math.log(pii.ALPHA / tests):
            flagged.add(w)
    return {t: {(a, 4, b) for w, a, b in places[t] if w in flagged} for t in texts}


def rows_for_test():
    rnd = random.Random(4)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004",
            "+1 (555) 010-9999", "+4912345678", "+", "12", "é", "😀", " ", " word ", ".", "-", "\n", "9" * 25]
    rows = [(100 + i, "".join(rnd.choices(bits, k=rnd.randint(1, 15)))) for i in range(300)]
    # "zyxbert" stands only where one address does, "people" everywhere; each "only<i>" in one text
    rows += [(500 + i, f"note {i} by zyxbert to people, only{i}, at secret.person@example.org about topic{i}") for i in range(14)]
    rows += [(600 + i, f"many people talk about things number {i}") for i in range(900)]
    rows += [(900, "a" * 3_000 + "@"), (901, "1" * 3_000), (902, "a@b.c " * 300), (903, "1.1." * 1_000)]
    return rows


def test_against_brute_force(make_docs, odd_rows, monkeypatch):
    rows = odd_rows + rows_for_test()
    added = word_spans(rows)
    assert any(added.values())
    want = sorted(((i, *[sum(s[1] == k for s in base(t)) for k in range(4)], hashlib.sha256(line(base(t)).encode()).hexdigest(),
                    line(set(base(t)) | added.get(t or "", set()))) for i, t in rows), key=repr)
    for bound in (pii.BROADCAST_BYTES, -1):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", bound)
        got = [tuple(r) for r in pii_report(make_docs(rows)).collect()]
        assert sorted(got, key=repr) == want


@pytest.mark.parametrize("bound", [pii.BROADCAST_BYTES, -1])
def test_sanitised_texts(make_docs, odd_rows, monkeypatch, bound):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", bound)
    rows = odd_rows + rows_for_test()
    docs = make_docs(rows)
    out = sanitise(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert out.count() == len(rows)
    assert by[2] is None and by[6] == dict(rows)[6]
    assert "zyxbert" not in by[500] and "[EMAIL]" in by[500] and "people" in by[500] and "only0" in by[500]
    assert by[600] == dict(rows)[600]
    assert not any(BASE[0][0].search(t) for t in by.values() if t)


def test_empty(make_docs):
    assert pii_spans(make_docs([])).collect() == []
    assert sanitise(make_docs([])).collect() == []
