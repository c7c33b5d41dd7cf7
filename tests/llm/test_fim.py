"""Fill-in-middle: boundary sets, brute-force rows and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from covenant.llm import fim


@pytest.mark.parametrize("kind, low", [
    (fim.ArrayContainer, list(range(0, 60000, 17))), (fim.BitmapContainer, list(range(0, 65536, 3))),
    (fim.RunContainer, list(range(65536))), (fim.RunContainer, [*range(5, 900), *range(2000, 2300), 65535]), (fim.ArrayContainer, [65535])])
def test_container_select(kind, low):
    made = fim.container(np.array(low))
    assert type(made) is kind
    assert [made.select(k) for k in range(len(low))] == low


def test_boundary_set_select():
    rng = random.Random(2)
    values = sorted({rng.randrange(1 << 20) for _ in range(3000)} | set(range(70_000, 140_000)) | set(range(300_000, 370_000, 2)) | {1 << 31})
    made = fim.BoundarySet(np.array(values))
    assert len(made) == len(values) and {type(c) for c in made.containers} == {fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer}
    for k in [0, 1, len(values) - 1, *rng.sample(range(len(values)), 500)]:
        assert made.select(k) == values[k]
    assert len(fim.BoundarySet(np.zeros(0, np.int64))) == 0


def brute(key, text, seed="7", spm=50, rate=100):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(odd_rows):
    rng = random.Random(8)
    rows = list(odd_rows) + [(20, "a\n\n\nb"), (21, "\n"), (22, "x <P> y\nz"), (23, "<S>"), (24, "ends <\nS> <M\n>"), (25, "\r\n\x0b\x85 é\n𝄞𝄞\nz"),
                             (26, "<"), (27, "\n" * 70_000 + "z"), (28, "<M>\n"), (29, "a<\n<\n<P\n")]
    return rows + [(100 + i, "".join(rng.choice(("a", "\n", "é", "𝄞", "<", "P>")) for _ in range(rng.randrange(60)))) for i in range(200)]


@pytest.mark.parametrize("options", [{}, {"seed": "x", "fim_percent": 40, "spm_percent": 90}])
def test_matches_brute_force(make_docs, odd_rows, options):
    rows = rows_of(odd_rows)
    out = fim.fill_in_middle(make_docs(rows).withColumn("n", F.lit("old")).withColumn("t", F.lit(1)), **options)
    assert "lang" in out.columns and out.columns.count("n") == 1
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()), key=str)
    names = {"seed": "seed", "fim_percent": "rate", "spm_percent": "spm"}
    want = sorted(((k, t, *brute(k, t, **{names[o]: v for o, v in options.items()})) for k, t in rows), key=str)
    assert got == want
    assert {g[3] for g in got} == {"plain", "psm", "spm"}


def test_round_trip_and_digests(make_docs, odd_rows):
    rows = rows_of(odd_rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = sorted(((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fim.fill_in_middle_report(make_docs(rows)).collect()), key=str)
    assert got == sorted(((k, sha(brute(k, t)[-1]), sha(t)) for k, t in rows), key=str)


def test_empty_table_and_long_lines(make_docs):
    assert fim.fill_in_middle_report(make_docs([])).count() == 0
    text = ("x" * 300_000 + "\n") * 8
    r = fim.fill_in_middle(make_docs([(3, text)], extra=False)).first()
    assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(3, text)
