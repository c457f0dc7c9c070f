import random

import duckdb
import numpy as np
import pytest

from readlog.llm import license_scan as scan

SCHEMA = "doc_id long, text string, labels string, score string, number int, n int, block int"
TESTDATA = "/root/testdata/sf0.001"


def plain(rows, templates=scan.TEMPLATES, phrases=scan.PHRASES, percent=scan.PERCENT):
    out = []
    for doc_id, text in rows:
        ws = scan.words_of(text or "")
        places = [(i, label) for words, label in ((scan.words_of(t), label) for t, label in phrases) for i in range(len(ws)) if ws[i : i + len(words)] == words]
        found, score = {label for _, label in places}, 1.0 if places else 0.0
        base = ",".join(sorted(found))
        for label, t in templates:
            words = scan.words_of(t)
            size = scan.size_class(len(words))
            for at in range(0, len(ws), size):
                shared = len(set(words) & set(ws[at : at + 2 * size]))
                if 100 * shared >= percent * len(set(words)):
                    found.add(label)
                    score = max(score, shared / len(set(words)))
        starts = [i for i, _ in places]
        out.append((doc_id, len(ws), len(places), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(found)), score))
    return sorted(out, key=repr)


def result(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "l", "s", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, scan.scan(frame, **options).collect()), key=repr)


def notices():
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))
    full = {label: text for label, text in scan.TEMPLATES}
    rows = [None, "", " \n\t", "CC BY", "cc-by cc\nBY x", "cc" + "ß by", "All rights reserved. All RIGHTS reserved", "GNU Lesser General Public License", "rights reserved", "ccby cc b y", "license " * 3000, "All rights reserved " * 2000]
    rows += [f"{prose(40)}\n{t}\n{prose(30)}" for _, t in scan.TEMPLATES]
    rows += [prose(k) + " " + full["mit"].replace(" ", "\n * ").upper() + prose(500) for k in (1, 63, 64, 65, 127, 128, 129)]
    for _, t in scan.TEMPLATES:  # some words less
        words = scan.words_of(t)
        rows += [" ".join(w for w in words if w not in r.sample(words, gone)) for gone in (1, 2, 4)]
    rows.append(prose(9000) + full["isc"] + prose(9000))
    return [(i, t) for i, t in enumerate(rows)] + [(3, "CC BY"), (None, "released under the MIT License"), (None, None)]


def test_scan_against_plain(spark):
    rows = notices()
    got = result(spark, rows)
    assert got == plain(rows)
    assert {x for r in got for x in r[6].split(",")} == {"", *(label for label, _ in scan.TEMPLATES), *(label for _, label in scan.PHRASES)}


def test_empty_table_and_no_templates(spark):
    assert result(spark, []) == []
    rows = notices()[:12]
    assert result(spark, rows, templates=()) == plain(rows, templates=())
    assert result(spark, rows, templates=(), phrases=()) == plain(rows, templates=(), phrases=())


def test_too_many_words(monkeypatch):
    monkeypatch.setattr(scan, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        scan.vocabulary((("x", "a b c d"),), ())


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_join_loses_nothing(percent):
    r = np.random.default_rng(percent)
    for _ in range(20):
        templates = [(i, sorted(r.choice(30, r.integers(1, 12), replace=False).tolist())) for i in range(8)]
        blocks = {b: sorted(r.choice(30, r.integers(1, 25), replace=False).tolist()) for b in range(0, 60, 2)}
        entries = [(b, x) for b, xs in blocks.items() for x in xs]
        block, template, shared = scan.Join(templates, 30, percent)(*np.array(entries).T)
        want = {(b, i, len(set(xs) & set(t))) for b, xs in blocks.items() for i, t in templates if 100 * len(set(xs) & set(t)) >= percent * len(t)}
        assert set(zip(block.tolist(), template.tolist(), shared.tolist(), strict=True)) == want and len(block) == len(want)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{TESTDATA}/documents.parquet'")
    rows = con.sql(scan.oracle())
    got = scan.op13_license_scan(spark, TESTDATA).select(*rows.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows.fetchall(), key=repr)
