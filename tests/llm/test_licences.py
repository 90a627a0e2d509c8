import re
import textwrap

from affinity.llm.licences import TEMPLATES, op8_license_scans, python_bigrams, scan


def brute(rows, least=0.8):
    sets = {k: python_bigrams(v) for k, v in TEMPLATES.items()}
    out = {}
    for d, t in set(rows):
        if t is None:
            continue
        m = re.sub("\x02?[ \t\r\f\x0b]*\n\\s*", "\x01", re.sub("([.!?])[ \t\r\f\x0b]+", "\\1\x02", t))
        units = [("text", m)] * ("\x01" in m) + [("line", x) for x in m.split("\x01") if "\x02" in x] + [("sentence", x) for x in re.split("[\x01\x02]", m)]
        for name, s in sets.items():
            found = [(2 * len(g & s) / (len(g) + len(s)), u) for u, x in units if (g := python_bigrams(x)) and 2 * len(g & s) >= least * (len(g) + len(s))]
            if found:
                out[d, t, name] = (round(max(found)[0], 6), max(found)[1], len(found))
    return sorted((-1 if d is None else d, n, *v) for (d, t, n), v in out.items())


def test_matches_brute_force(spark):
    texts = list(TEMPLATES.values())
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, f"Some code here. And more!\n{t}\nfoo bar baz.") for i, t in enumerate(texts)]
    rows += [(200 + i, t.replace(" the ", " a ")) for i, t in enumerate(texts)]
    rows += [(300, None), (301, ""), (302, " \n."), (303, "License"), (304, "MIT License. " * 300), (305, "Released under the MIT License. Released under the MIT License.\nReleased  UNDER the-MIT license"), (None, texts[2]), (0, texts[2])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(1, texts[1], "x")], "doc_id long, text string, licence string").repartition(3)  # row 1 is there twice
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.licence, r.dice, r.unit, r.n_units) for r in scan(docs).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_passages(rows, least=0.8):
    """All runs of two or more sentences besides the other units."""
    sets = {k: python_bigrams(v) for k, v in TEMPLATES.items()}
    out = {(d, n): (dice, unit, count) for d, n, dice, unit, count in brute(rows, least)}
    for d, t in rows:
        m = re.sub("\x02?[ \t\r\f\x0b]*\n\\s*", "\x01", re.sub("([.!?])[ \t\r\f\x0b]+", "\\1\x02", t))
        spans, k = {"text": [], "line": [], "sentence": []}, 0
        for line in m.split("\x01"):
            first = k
            for x in line.split("\x02"):
                if python_bigrams(x):
                    spans["sentence"].append((k, k + 1, x))
                    k += 1
            if "\x02" in line:
                spans["line"].append((first, k, line))
        spans["text"] = [(0, k, m)] * ("\x01" in m)
        s = [x for _, _, x in spans["sentence"]]
        for name, marks in sets.items():
            score = lambda x: 2 * len((g := python_bigrams(x)) & marks) / max(1, len(g) + len(marks))  # noqa: B023, E731
            taken = [(i, j) for kind in spans.values() for i, j, x in kind if score(x) >= least]
            runs = sorted((j, i, v) for i in range(k) for j in range(i + 2, k + 1) if (v := score(" ".join(s[i:j]))) >= least)
            if not runs:
                continue
            last, n = 0, 0
            for j, i, _ in runs:
                if i >= last and all(j <= a or b <= i for a, b in taken):
                    last, n = j, n + 1
            top = round(max(v for _, _, v in runs), 6)
            dice, unit, count = out.get((d, name), (0, "passage", 0))
            out[d, name] = (max(dice, top), "passage" if top > dice else unit, count + n)
    return sorted((d, n, *v) for (d, n), v in out.items())


def test_wrapped_licences_match_brute_force(spark):
    code = "\n".join(f"x{i} = call(of the, {i % 7}); in no event" for i in range(20))
    wrap = lambda t: textwrap.fill(t, 78, initial_indent=" * ", subsequent_indent=" * ")
    rows = [(i, f"Head line\n{wrap(t)}\n{code}") for i, t in enumerate(TEMPLATES.values())]
    mit, isc = wrap(TEMPLATES["mit text"]), wrap(TEMPLATES["isc text"])
    rows += [(100, f"{code}\n{mit}\n{mit}\n{code}\n{isc}\n{mit}"), (101, f"{TEMPLATES['mit text']}\n{code}\n{mit}"), (102, "MIT License. " * 40), (103, mit.replace("the", "a") + "\n" + code)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.licence, r.dice, r.unit, r.n_units) for r in scan(docs, passages=True).collect())
    assert got == brute_passages(rows)
    long = {k for k, v in TEMPLATES.items() if len(v) > 150}
    assert len(long) == 7 and {(i, k) for i, k in enumerate(TEMPLATES) if k in long} <= {(d, k) for d, k, *_ in got}


def test_query_finds_a_wrapped_licence(spark, tmp_path):
    text = textwrap.fill(TEMPLATES["apache-2.0 header"], 78) + "\n" + "x = call(y)\n" * 80
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ("apache-2.0 header", 1.0, "passage", 1) in [(r.licence, r.dice, r.unit, r.n_units) for r in op8_license_scans(spark, str(tmp_path)).collect()]


def test_many_copies_in_one_text(spark):
    wrap = textwrap.fill(TEMPLATES["mit text"], 90)
    rows = [(1, "\n".join([wrap] * 40)), (2, "\n".join([wrap, "x = call(y)"] * 2)), (3, f"{TEMPLATES['isc text']}\n{wrap}\n" * 2), (4, "Released under the.\n" + "no.\n" * 12 + "the MIT License.\n" + wrap)]
    got = sorted((r.doc_id, r.licence, r.dice, r.unit, r.n_units) for r in scan(spark.createDataFrame(rows[1:], "doc_id long, text string"), passages=True).collect())
    assert got == brute_passages(rows[1:])
    other = "\n".join(f"name{i} = value{i}" for i in range(200))  # so that the whole text is no licence
    many = [(n, "\n".join([other] + [wrap] * n)) for n in (40, 400)]
    rows = scan(spark.createDataFrame(many, "doc_id long, text string"), passages=True).where("licence = 'mit text'").collect()
    assert {(r.doc_id, r.dice, r.unit) for r in rows} == {(40, 1.0, "passage"), (400, 1.0, "passage")}
    assert all(r.doc_id <= r.n_units <= 1.5 * r.doc_id for r in rows)  # a part of a copy can be enough
