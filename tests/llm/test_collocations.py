"""Collocations against brute force; flows, paths, hash collisions, large counts."""

import collections
import random
import re

import pytest

DOC = "doc_id long, text string, lang string, home string, key string, k int, phrase string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "h", "x", 1, "p") for i, t, g in rows], DOC).repartition(3)


def pieces(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [p for p in (re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", low)) if p]


def counts(rows, n):
    f = collections.defaultdict(collections.Counter)
    for _, t, g in rows:
        for p in pieces(t):
            for k in range(1, n + 1):
                for i in range(len(p) - k + 1):
                    f[g or "und"][tuple(p[i : i + k])] += 1
    return f


def brute(rows, n, least, percent, top):
    out = []
    for lang, f in counts(rows, n).items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        heavy = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in heavy.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner.get(p[i : i + k], 0), a)
        found = []
        for p, a in heavy.items():
            if 100 * inner.get(p, 0) >= percent * a and p in inner:
                continue
            s, k, x, y = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), x, y))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, total, -s))
    return sorted(out)


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["The", "the", "É", "日本", "x\vy"]
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    make = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", " "]) for _ in range(k))
    out = []
    for i in range(120):
        t = make(rng.randint(0, 90)) + (" " + line if i % 5 == 0 else "") + (" " + line[: rng.randint(5, 40)] if i % 7 == 0 else "")
        out.append((i, t, rng.choice(["en", "de", None, "und"])))
    out += [(None, None, "en"), (3, "", "fr"), (4, "  \n", "fr"), (5, "a a a a a a a a a a a a a a", "fr"), (6, make(9000), "en")]
    return out + [(7, "same same words here", "en")] * 15


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("n", "least", "top"), [(3, 10, 2000), (3, 3, 25), (4, 3, 2000), (2, 4, 50), (5, 2, 400)])
def test_collocations_equal_brute_force(spark, n, least, top):
    from tessella.llm.collocations import collocations

    rows = corpus()
    assert result(collocations(frame(spark, rows), n, least, 50, top, n_homes=4)) == brute(rows, n, least, 50, top)


def test_counts_from_flow(spark):
    from tessella.llm.collocations import phrase_counts

    rows = corpus(5)
    got, totals = phrase_counts(frame(spark, rows), n=4, at_least=6, n_homes=5)
    want = {(g, " ".join(p)): c for g, f in counts(rows, 4).items() for p, c in f.items() if c >= 6}
    assert {(r.lang, r.phrase): r.a for r in got.collect()} == want
    assert {r.lang: r.n for r in totals.collect() if r.n} == {g: sum(c for p, c in f.items() if len(p) == 1) for g, f in counts(rows, 4).items() if f}


def test_paths_are_compact(spark):
    from tessella.llm.collocations import paths, phrase_counts

    line = "a b c d e f g h i j k l m n o p"
    rows = [(i, f"{line}. x{i} {line}", "en") for i in range(10)] + [(20 + i, "q f g h z", "en") for i in range(5)]
    found, _ = phrase_counts(frame(spark, rows), n=3, at_least=5)
    got = sorted((" ".join(r.words), r.a) for r in paths(found).collect())
    # The path branches at "f g" and "g h", which the other texts enter and leave.
    assert got == [("a b c d e f g", 20), ("f g h", 25), ("g h i j k l m n o p", 20), ("g h z", 5), ("q f g", 5)]


def test_collisions_change_nothing(spark, monkeypatch):
    import numpy as np

    from tessella.llm import collocations as c

    real = c.word_hashes
    clash = lambda w, *a: real(w, *a) & np.uint64(7)
    rows = corpus(9)
    home = c._Home.__init__

    def blunt(self, t, n):
        keep, c.word_hashes = c.word_hashes, clash
        try:
            home(self, t, n)
        finally:
            c.word_hashes = keep

    import pyarrow as pa

    table = pa.table({"home": [0] * len(rows), "text": [t for _, t, _ in rows], "lang": [g for _, _, g in rows]})
    monkeypatch.setattr(c._Home, "__init__", blunt)
    sent = c._send(3, 3, 4)(table)
    assert sent.num_rows
    flags = [c._heavy(4)(sent.filter(pa.array([(k, b) == key for k, b in zip(sent["k"].to_pylist(), sent["bucket"].to_pylist())]))) for key in {*zip(sent["k"].to_pylist(), sent["bucket"].to_pylist())}]
    got = collections.Counter()
    level = collections.Counter()
    rows_out = c._flows(3, 3)(table, pa.concat_tables(flags)).to_pylist()
    for k in (3, 2, 1):
        now = collections.Counter()
        for (g, p), f in level.items():
            now[g, " ".join(p.split(" ")[:k])] += f
        for r in rows_out:
            if r["k"] == k:
                now[r["lang"], r["phrase"]] += r["flow"]
        level = now
        got.update(now)
    want = {(g, " ".join(p)): n for g, f in counts(rows, 3).items() for p, n in f.items() if n >= 4}
    assert {p: n for p, n in got.items() if n >= 4} == want


def test_empty(spark):
    from tessella.llm.collocations import collocations

    assert result(collocations(frame(spark, []))) == []


def test_scores_are_exact(spark):
    """Products of large counts, by the expression that scores."""
    from tessella.llm.collocations import SCORE

    rows = [(10**12 + 7, 10**13 + 1, 3 * 10**12 + 11), (99_999_999_999_999, 10**14, 10**14), (10, 10, 10), (11, 3 * 10**9 + 1, 12)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, l long, r long").selectExpr(f"{SCORE} AS s").collect()]
    assert sorted(got) == sorted(10**6 * a * a // (x * y) for a, x, y in rows)
