import random
import re

import duckdb
import pandas as pd

from affinity.llm import sentences
from affinity.llm.sentences import dedup_sentences


def parts(t):
    """Sentences as (text up to the next one, words)."""
    b = t.encode()
    out = []
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", b):
        before = b[: m.start()]
        gap = before[len(before.rstrip(b" \t\n\r\x0b\x0c")) :]
        if not out or out[-1][1][-1][-1:] in (b".", b"!", b"?") or b"\n" in gap:
            out.append([m.start() if out else 0, []])
        out[-1][1].append(bytes(c + 32 if 65 <= c <= 90 else c for c in m[0]))
    ends = [x[0] for x in out[1:]] + [len(b)]
    return [(b[x[0] : e], tuple(x[1])) for x, e in zip(out, ends)]


def brute(rows, run, least):
    spans = {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        p = parts(t or "")
        for i in range(len(p) - run + 1):
            if sum(len(w) for _, w in p[i : i + run]) >= least:
                spans.setdefault(tuple(w for _, w in p[i : i + run]), []).append((d, t, i))
    gone = {}
    for places in spans.values():
        for d, t, i in places[1:]:
            gone.setdefault((d, t), set()).update(range(i, i + run))
    out = []
    for d, t in rows:
        p, g = parts(t or ""), gone.get((d, t), set())
        out.append((-1 if d is None else d, len(p), len(g), (t if not g else b"".join(x for i, (x, _) in enumerate(p) if i not in g).decode()) or ""))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    say = lambda: " ".join(r.choice("ka Lo mié unt ñu exo".split()) + str(r.randint(0, 30)) for _ in range(r.randint(1, 9))) + r.choice([".", "!", "?", "", "...", "\n"])
    shared = [[say() for _ in range(r.randint(2, 6))] for _ in range(5)]
    rows = []
    for i in range(120):
        s = [say() for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(s))
            s[k:k] = r.choice(shared)
        rows.append((i * 5 % 600, r.choice([" ", "\n", "  "]).join(s)))
    return rows + [(900, None), (901, ""), (902, " \n "), (None, rows[3][1]), (903, rows[3][1] + " End."), (903, rows[3][1] + " End."), (904, "Same line here again. " * 50)]


def result(spark, rows, parts_, **kw):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int").repartition(parts_)
    return sorted((-1 if x.doc_id is None else x.doc_id, x.n_sentences, x.n_removed, x.text or "") for x in dedup_sentences(docs, **kw).collect())


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows, 3) == brute(rows, 2, 10)


def test_other_lengths_and_many_sends(spark, monkeypatch):
    monkeypatch.setattr(sentences, "FLUSH", 50)
    rows = corpus(2)
    assert result(spark, rows, 2, run=3, least=1) == brute(rows, 3, 1)


def test_empty(spark):
    assert dedup_sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(x) for x in dedup_sentences(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, None)]


def brute_grown(rows, run, least):
    """All runs that are too short without their first or without their last sentence."""
    spans = {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        p = parts(t or "")
        enough = lambda i, j: j - i >= run and sum(len(w) for _, w in p[i:j]) >= least
        found = [(i, j) for i in range(len(p)) for j in range(i + 1, len(p) + 1) if enough(i, j) and not (enough(i + 1, j) and enough(i, j - 1))]
        for i, j in found or [(0, len(p))] * bool(p):
            spans.setdefault(tuple(w for _, w in p[i:j]), []).append((d, t, i, j))
    gone = {}
    for places in spans.values():
        for d, t, i, j in sorted(places, key=lambda x: (x[0] is None, x[0] or 0))[1:]:
            gone.setdefault((d, t), set()).update(range(i, j))
    out = []
    for d, t in rows:
        p, g = parts(t or ""), gone.get((d, t), set())
        out.append((-1 if d is None else d, len(p), len(g), (t if not g else b"".join(x for i, (x, _) in enumerate(p) if i not in g).decode()) or ""))
    return sorted(out)


def test_grown_runs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sentences, "FLUSH", 500)
    rows = corpus(3) + [(910 + i, t) for i, t in enumerate(["Yes.", "No way. Yes.", "no  way. yes.", "yes."])]
    assert result(spark, rows, 3, grow=True) == brute_grown(rows, 2, 10)


def test_query_cuts_short_sentences_and_whole_texts(spark, tmp_path):
    shout = " ".join(f"WORD{i}!!" for i in range(30))  # one-word sentences
    tail = "This sentence has quite a few more words than ten in it. Ka. Lo. Mi."
    line = "one sentence without an end " * 4
    texts = [shout, shout, f"Start. {shout} End.", tail, tail, line, line, "Too short.", "Too short.", "Other one."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.text) for r in sentences.op4_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, shout), 1: (30, ""), 2: (30, "Start. End."), 3: (0, tail), 4: (4, ""), 5: (0, line), 6: (1, ""), 7: (0, "Too short."), 8: (1, ""), 9: (0, "Other one.")}


def test_the_largest_id_and_no_id(spark):
    """Large ids beside null ones stay exact; rows without an id come after others."""
    rows = corpus(4)[:40]
    text = max((t for _, t in rows if t), key=len)
    top = 2**63 - 1
    docs = spark.createDataFrame([(top - 1, text), (top, text), (None, text + " Other words."), (None, None)], "doc_id long, text string")
    got = dedup_sentences(docs, grow=True).collect()
    assert {x.doc_id for x in got} == {top - 1, top, None}
    by_id = {x.doc_id: x for x in got if x.text is not None}
    assert by_id[top - 1].n_removed == 0 and by_id[top].n_removed == by_id[top].n_sentences > 0 and by_id[None].n_removed > 0


def test_sql_states_the_query(spark, tmp_path):
    """Grown runs, texts hashed as a whole, white space of all kinds and stops inside words."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(5)) if i != 123]
    odd = ["  a.b c! d\x0b\n\n e?? \r\n f .", "\t\n", "A.B C! d e?? f .", "x" * 40, "\u00c9t\u00e9 \u00e9t\u00e9. \u00c9T\u00c9 \u00e9t\u00e9\u2003b. " * 9, "\n\nYes.\nNo", "yes. no", "One.\x0cTwo \x85 three"]
    rows += [(1000 + i, t) for i, t in enumerate(odd + odd)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted((d, n, r, t or "") for d, n, r, t in con.sql(sentences.SQL).fetchall())
    got = sorted((x.doc_id, x.n_sentences, x.n_removed, x.text or "") for x in sentences.op4_substring_dedup(spark, str(tmp_path)).collect())
    assert got == want and sum(r for _, _, r, _ in got) > 100


def test_many_rows_without_an_id(spark):
    """Each of many rows without an id, and of many with one id, is told from the others."""
    say = lambda k: f"Number {k} is the first sentence here. And then there is a second one, number {k}."
    docs = [(d, say(k)) for k in range(60) for d in (None, 7)] + [(3, say(0)), (None, say(99)), (None, say(99))]
    got = dedup_sentences(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), grow=True).collect()
    cut = lambda d: sorted(x.n_removed for x in got if x.doc_id == d)
    assert cut(3) == [0] and cut(7) == [0] * 59 + [2] and cut(None) == [0, 0] + [2] * 60 and len(got) == len(docs)
