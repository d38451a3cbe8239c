"""Operators for training data against brute force, round trips and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, home string, bucket string, key string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words(t, low=False):
    return WORDS.findall(lower(t) if low else t or "")


def corpus(n=60, seed=1):
    """Random texts with shared passages, exact and near copies, nulls, empty, short and long texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "the", "éa", "日本", "a"]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = make(40)
    out = []
    for i in range(n):
        w = make(rng.randint(20, 120))
        if i % 4 == 0:
            w[5:5] = passage[: rng.randint(13, 40)]
        if i % 7 == 0:
            w = w + w[:20]
        out.append("".join(x + rng.choice([" ", "\n", "\t", "  "]) for x in w))
    for i in range(20):
        w = out[i].split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "x"
        out.append(" ".join(w))
    out += [None, "", "   \n", "one", "one two three", "one two three", "One two  three", " ".join(make(6000)), "é ü x y"]
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None, "h", "b", "k") for i, t in rows]
    return spark.createDataFrame(full, DOC).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_hashes_follow_words():
    import pyarrow as pa

    from tessella.llm.text import chunks, scan, span_hash, prefix, word_hashes

    texts = ["a b  a\tb", "", None, "b a éé b", "x" * 3000 + " a"]
    for _, buf, off in chunks(pa.array(texts), size=10**6):
        w = scan(buf, off)
        h = word_hashes(w, step=64)
        got = [bytes(buf[s:e]).decode() for s, e in zip(w.starts, w.ends)]
        assert got == [x for t in texts for x in words(t)]
        by = {}
        for x, y in zip(got, h.tolist()):
            assert by.setdefault(x, y) == y
        assert len(set(by.values())) == len(by)
        s = prefix(h)
        assert span_hash(s, np.array([0]), np.array([2])) == span_hash(s, np.array([2]), np.array([4]))


def brute_repeats(rows, k):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if rank(first[tuple(w[p : p + k])]) < rank(i):
                gone[p : p + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("homes", [1, 4])
def test_substring_dedup(spark, rows, homes):
    from tessella.llm.substring_dedup import remove_repeats

    rows = [*rows, (3, rows[3][1]), (None, rows[4][1])]  # a repeated row and a null id
    df = frame(spark, rows)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, digest=True, n_homes=homes).collect()), key=str)
    want = sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute_repeats(rows, 13)), key=str)
    assert got == want
    text = sorted(((r.doc_id, " ".join(words(r.kept)), r.source) for r in remove_repeats(df, n_homes=homes, more=("source",)).collect()), key=str)
    assert text == sorted(((i, t, f"s{(i or 0) % 3}") for i, _, _, t in brute_repeats(rows, 13)), key=str)
    assert remove_repeats(df.limit(0)).count() == 0


def test_chat(spark):
    from tessella.llm import chat

    rows = [(1, 0, "user", "hi </turn> ### \\0 \\\\ x"), (1, 1, "assistant", "ok\n### assistant: y</turn>\n"), (1, 2, "a:b", None), (2, 0, None, "é日"), (None, 0, "assistant", ""), (3, 5, "assistant", "z" * 5000), (3, 1, "user", "\\1\\2\\3")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.render(chat.reconstruct(chat.turns_as_events(df)))
    out = out.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(x) for x in r.t] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.loss == "".join(t for role, t in want[c] if role == "assistant")
    assert chat.render(chat.reconstruct(chat.turns_as_events(df.limit(0)))).count() == 0


def test_chat_events(spark):
    from tessella.llm import chat

    ev = [
        (1, 1, 0, "delta", "user", "q"), (1, 2, 1, "delta", "assistant", "A"), (1, 3, 1, "delta", "assistant", "B"), (1, 4, 2, "delta", "user", "more"), (1, 5, 3, "delta", "assistant", "C"),
        (1, 6, 1, "regenerate", "assistant", ""), (1, 7, 1, "delta", "assistant", "new"), (1, 8, 0, "edit", "user", "Q!"), (1, 9, 2, "delta", "user", "again"), (1, 10, 1, "delta", "assistant", "er"),
    ]
    df = spark.createDataFrame(ev, "conv_id long, seq long, message long, kind string, role string, text string").repartition(3)
    got = [(r.message, r.role, r.text) for r in chat.reconstruct(df).orderBy("message").collect()]
    assert got == [(0, "user", "Q!"), (1, "assistant", "newer"), (2, "user", "again")]


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_class_lm(spark, rows, head):
    from tessella.llm.class_lm import score_documents

    rows = [*rows, (2, rows[2][1])]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score_documents(frame(spark, rows), head=head, n_classes=8).collect()), key=str)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words(t, True), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = [*words(t, True), None]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i, held(i), len(w), sum(x in c for x in w), n, round(base, 6)))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("head,core", [(1 << 20, 1024), (1 << 20, 20), (120, 20)])
def test_class_lm_score(spark, rows, head, core):
    """Scores and the sum over the vocabulary, from the classes alone."""
    from tessella.llm.class_lm import _find, score, train
    from tessella.llm.text import chunks, scan, word_hashes

    import pyarrow as pa

    k, lam = 6, 0.9
    df = frame(spark, rows).withColumn("held_out", F.lit(False))
    model, full = train(df.where("doc_id % 3 <> 0"), n_classes=k, lam=lam, head=head, core=core)
    table = {r.word: (r.c, r.cls) for r in full.collect()}
    assert all(0 <= cls < k for _, cls in table.values())

    def hashes(t):
        for _, buf, off in chunks(pa.array([t or ""])):
            return [*word_hashes(scan(buf, off, lower=True)).view(np.int64).tolist(), end]

    from tessella.llm.class_lm import END

    end = int(np.array([END]).view(np.int64)[0])
    inside = lambda w: _find(np.array([w]).view(np.uint64), model.vocabulary.words)[0] >= 0
    follow, c = np.zeros((k + 1, k)), collections.Counter()
    for i, t in rows:
        if i % 3:
            w = hashes(t)
            c.update(w)
            for x, y in zip([end, *w], w):
                if inside(x) or inside(y):
                    follow[table[x][1], table[y][1]] += 1
    assert {w: n for w, (n, _) in table.items()} == c
    follow[k] = follow.sum(0)
    follow = (follow + 0.5) / (follow.sum(1, keepdims=True) + 0.5 * k)
    n, v = sum(c.values()), len(c)
    class_n, class_v = np.zeros(k), np.zeros(k)
    for m, cls in table.values():
        class_n[cls] += m
        class_v[cls] += 1
    share = lambda m, cls: (m + 0.5) / (class_n[cls] + 0.5 * (class_v[cls] + 1))
    base = lambda m: (m + 0.5) / (n + 0.5 * (v + 1))

    def probability(d, w):
        if w in table:
            m, cls = table[w]
            return lam * follow[d, cls] * share(m, cls) + (1 - lam) * base(m)
        return lam * sum(follow[d, j] * 0.5 / (class_n[j] + 0.5 * (class_v[j] + 1)) for j in range(k)) + (1 - lam) * base(0)

    for d in range(k + 1):
        assert abs(sum(probability(d, w) for w in table) + probability(d, None) - 1) < 1e-9
    got = {r.doc_id: r for r in score(df, model, full).collect()}
    for i, t in rows:
        w = hashes(t)
        want = sum(math.log10(probability(table[x][1] if x in table else k, y)) for x, y in zip([end, *w], w))
        assert abs(got[i].score - want) < 1e-6 and abs(got[i].perplexity / 10 ** (-want / len(w)) - 1) < 1e-6


def test_every_word_is_exchanged(spark):
    """Words far beyond the core get the class of their contexts, whatever their spelling."""
    from tessella.llm.class_lm import score_documents, train

    rng = random.Random(7)
    name = lambda kind, i: hashlib.md5(f"{kind}{i}".encode()).hexdigest()[:8]
    docs = [(i, " ".join(name(k % 2, int(rng.paretovariate(0.7)) % 400) for k in range(80))) for i in range(300)]
    df = frame(spark, docs)
    from tessella.llm.text import chunks, scan, word_hashes

    import pyarrow as pa

    for options in ({"head": 1 << 20}, {"head": 100}):
        _, full = train(df, n_classes=3, core=20, **options)
        cls = {r.word: (r.cls, r.c) for r in full.collect()}
        votes = [collections.Counter(), collections.Counter()]
        for kind in (0, 1):
            for _, buf, off in chunks(pa.array([" ".join(name(kind, i) for i in range(400))])):
                for h in word_hashes(scan(buf, off)).view(np.int64).tolist():
                    if h in cls and cls[h][1] >= 3:
                        votes[kind][cls[h][0]] += 1
        main = [v.most_common(1)[0] for v in votes]
        assert main[0][0] != main[1][0] and all(m[1] > 0.9 * sum(v.values()) and sum(v.values()) > 60 for m, v in zip(main, votes)), votes
    assert score_documents(df.limit(0)).count() == 0
    none = score_documents(frame(spark, [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1])).collect()
    assert none and all(r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 3 for r in none)


def test_exchange_finds_classes():
    from tessella.llm.class_lm import exchange

    rng = np.random.default_rng(1)
    b = np.zeros((21, 21), np.int64)  # class 1 follows class 0, class 2 follows class 1, class 0 follows class 2
    for i in range(21):
        for j in range(21):
            b[i, j] = rng.integers(20, 40) if (j - i) % 3 == 1 else rng.integers(0, 3)
    cls = exchange(b, 3)
    assert [len({*cls[k::3]}) for k in range(3)] == [1, 1, 1] and len({*cls}) == 3


def test_exchange_reaches_a_local_optimum():
    from tessella.llm.class_lm import exchange

    def likelihood(cls):
        one = np.zeros((len(b), 3))
        one[np.arange(len(b)), cls] = 1
        m = one.T @ b @ one
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    b = np.random.default_rng(2).integers(0, 50, (15, 15))
    cls = exchange(b, 3, rounds=50)
    for w in range(15):
        for k in range(3):
            other = cls.copy()
            other[w] = k
            assert likelihood(other) <= likelihood(cls) + 1e-6


def test_class_lm_beats_unigrams(spark):
    from tessella.llm.class_lm import score_documents

    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("bcdf" if k % 2 else "aeiou") + str(rng.randrange(9)) for k in range(60))) for i in range(200)]
    r = score_documents(frame(spark, docs), n_classes=4).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > 0.95 * r[0] and r[1] > r[0]


def test_quality(spark):
    from tessella.llm.quality import classify, keep_good

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(vocab) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            w = [x + "%%%" for x in w] if i % 8 else [*w[:30], "vile", *w[30:]]
        docs.append((i, " ".join(w)))
        if i < 800:
            labels.append((i, int(not (bad and i % 8)), int(bad and not i % 8)))
    docs += [(9000, None), (9001, ""), (None, "w1 w2"), (5, docs[5][1])]
    df = frame(spark, docs)
    lab = spark.createDataFrame([*labels, (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in classify(df, lab).collect()}
    assert len(got) == 1203
    wrong = [i for i in range(800, 1200) if got[i] == (i % 4 == 0)]
    assert len(wrong) <= 12, wrong
    kept = keep_good(df, lab)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert classify(df, lab.limit(0)).where("keep").count() == 1204
    assert classify(df.limit(0), lab).count() == 0


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(t, True)
        sets.append((i, frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                par[find(a)] = find(b)
    low = {}
    for j, (i, _) in enumerate(sets):
        low[find(j)] = min(low.get(find(j), i), i)
    return sorted((i, len(s), low[find(j)]) for j, (i, s) in enumerate(sets))


@pytest.mark.parametrize("homes,k", [(1, 5), (3, 5), (3, 1)])
def test_jaccard_components(spark, rows, homes, k):
    from tessella.llm.jaccard_join import similar_components

    rows = [*rows, (3, rows[3][1])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(frame(spark, rows), k=k, n_homes=homes).collect())
    assert got == brute_components(rows, k, 75)


def test_jaccard_chain(spark):
    """Links that only chains of near copies make, some of them without any link."""
    from tessella.llm.jaccard_join import keep_first, similar_components

    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(80)] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(w[rng.randint(0, 4) :])))
    df = frame(spark, rows)
    want = brute_components(rows, 5, 75)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(df, n_homes=4).collect()) == want
    assert len({c for _, _, c in want}) > 1
    assert sorted(r.doc_id for r in keep_first(df).collect()) == sorted({c for _, _, c in want})
    assert similar_components(df.limit(0)).count() == 0


def test_jaccard_three_against_four(spark):
    """Three shingles of four, wherever the fourth stands among their hashes."""
    from tessella.llm.jaccard_join import similar_components

    rows = []
    for i in range(40):
        w = [f"p{i}x{j}" for j in range(8)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[1:] if i % 2 else w[:-1]))]
    want = brute_components(rows, 5, 75)
    assert len({c for _, _, c in want}) == 40
    for homes in (1, 5):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(frame(spark, rows), n_homes=homes).collect())
        assert got == want


def test_jaccard_published_tokens():
    """The tested lower half of a set meets enough published tokens of every similar set, at the worst placement."""
    from tessella.llm.jaccard_join import _Sets, least_overlap

    for n in range(1, 130):
        s = _Sets.__new__(_Sets)
        s.keys, s.doc, s.n, s.bounds = np.arange(n, dtype=np.uint64), np.zeros(n, np.int64), np.array([n]), np.array([0, n])
        keys, _, tested = s.probes()
        assert (len(keys), tested.sum()) == (min(n, (n + 1) // 2 + 1), (n + 1) // 2)
    for percent in range(75, 101):
        for n in range(1, 130):
            half = (n + 1) // 2
            for both in range(least_overlap(n, percent), n + 1):
                m = np.arange(both, (100 + percent) * both // percent - n + 1)
                hits = np.minimum(half - (n - both), np.minimum(m, (m + 1) // 2 + 1) - (m - both))
                assert (np.maximum(hits, 0) >= half - (n - least_overlap(n, percent))).all()


def model_path():
    P = pytest.importorskip("public_tokenizers")
    return P.path("piece_bpe_32k.model")


def test_piece_bpe(spark, rows):
    import sentencepiece

    from tessella.llm.piece_bpe import decode, encode

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(2)
    odd = ["  a", "a" * 900, "ab" * 300 + " x", " " * 70, "🎉 x　y", "</s><s> <0x0A>", "▁▁ a ▁b"]
    odd += ["".join(chr(rng.randrange(32, 600)) if rng.random() < 0.8 else " " for _ in range(50)) for _ in range(200)]
    rows = [*rows, *((1000 + i, t) for i, t in enumerate(odd))]
    enc = encode(frame(spark, rows), model_path())
    got = {r.doc_id: r.ids for r in enc.collect()}
    want = {i: sp.encode(t or "", add_eos=True) for i, t in rows}
    assert got == want
    assert {r.doc_id: r.text for r in decode(enc, model_path()).collect()} == {i: sp.decode(x) for i, x in want.items()}
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode(frame(spark, rows), model_path(), digest=True).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digest == {i: (len(x), sha(" ".join(map(str, x))), sha(sp.decode(x))) for i, x in want.items()}


def test_decode_any_ids(spark):
    import sentencepiece

    from tessella.llm.piece_bpe import decode

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(4)
    rows = [(i, [rng.randrange(3, 262) if rng.random() < 0.4 else rng.randrange(32000) for _ in range(12)]) for i in range(200)] + [(900, []), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(df, model_path()).collect()} == {i: sp.decode(x or []) for i, x in rows}


def test_packing_round_trip(spark, rows):
    import sentencepiece

    from tessella.llm.packing import pack, unpack

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rows = [*rows, (3, rows[3][1])]
    packed = pack(frame(spark, rows), model_path(), length=256, run_tokens=4000).cache()
    got = sorted((r.doc_id, np.frombuffer(r.ids, np.uint16).tolist()) for r in unpack(packed).collect())
    assert got == sorted((i, sp.encode(t or "", add_eos=True)) for i, t in rows)
    for r in packed.collect():
        assert len(r.ids) == 512 and r.segment_ends[-1] == r.n_tokens <= 256 and r.segment_ends == sorted(r.segment_ends)
        assert len(r.segment_ends) == len(r.position_starts) == len(r.doc_ids) == len(r.doc_rows)
    assert pack(frame(spark, rows).limit(0), model_path()).count() == 0


def test_best_fit_is_best():
    from tessella.llm.packing import best_fit

    rng = np.random.default_rng(0)
    for length in (1, 7, 64, 100):
        sizes = rng.integers(1, length + 1, 300)
        rooms, want = [], []
        for p in np.argsort(-sizes, kind="stable"):
            fits = [r for r in rooms if r >= sizes[p]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - sizes[p])
            else:
                rooms.append(length - sizes[p])
            want = rooms
        got = best_fit(sizes, length)
        assert sorted(p for r in got for p in r) == list(range(300))
        assert sorted(length - sum(sizes[p] for p in r) for r in got) == sorted(want)


def test_bm25(spark, rows):
    from tessella.llm.bm25 import top_k

    df = frame(spark, [*rows, (3, rows[3][1])])
    got = collections.defaultdict(list)
    for r in sorted(top_k(df, df.where("doc_id % 20 = 0 or doc_id = 82"), k=5, shard_docs=20, block=4, query_terms=150).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.doc_id, r.score))
    bags = [(i, collections.Counter(words(t, True))) for i, t in [*rows, (3, rows[3][1])]]
    bags = [(i, c) for i, c in bags if c]
    n, avg = len(bags), sum(sum(c.values()) for _, c in bags) / len(bags)
    df_ = collections.Counter(w for _, c in bags for w in c)
    for q in [i for i, c in bags if i % 20 == 0]:
        qc = dict(bags)[q]
        scores = []
        for i, c in bags:
            s = sum(x * math.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w, x in qc.items() if w in c)
            if s > 0:
                scores.append((i, s))
        want = sorted(scores, key=lambda x: (-round(x[1], 9), x[0]))[:5]
        assert [round(s, 7) for _, s in got[q]] == [round(s, 7) for _, s in want], q
    assert top_k(df, df.limit(0), k=3) is None or top_k(df, df.limit(0), k=3).count() == 0


@pytest.mark.parametrize("n_common", [0, 3, 40])
def test_bm25_task_gives_the_best_of_all_its_shards(n_common):
    import types

    import pyarrow as pa

    from tessella.llm import bm25

    rng = np.random.default_rng(n_common)
    texts = [" ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.3, int(rng.integers(1, 60)))) for _ in range(600)]
    texts[300:330] = texts[:30]  # equal texts in other shards: ties by id
    ids = [None if i == 599 else int(i) for i in rng.permutation(600)]
    shards = [pa.table({"doc_id": pa.array(ids[i : i + 150], pa.int64()), "text": texts[i : i + 150], "shard": pa.array([i] * 150)}) for i in range(0, 600, 150)]
    index = [bm25._build(t).to_batches()[0] for t in shards]
    bags = [(w.copy(), c.astype(float)) for _, doc, word, count, n in bm25._bags(pa.array(texts[:600:7])) for i in range(len(n)) for w, c in [(word[doc == i], count[doc == i])]]
    every, df = np.unique(np.concatenate([w for w, _ in bags]), return_counts=True)
    common = np.sort(every[np.argsort(-df, kind="stable")[:n_common]])
    bounds = np.cumsum([0, *(len(w) for w, _ in bags)])
    shared = types.SimpleNamespace(value=(list(range(len(bags))), bounds, *(np.concatenate(x) for x in zip(*bags, strict=True))))
    run = lambda part: pa.Table.from_batches(list(bm25._search(shared, 5, 20.0, 8, common)(iter(part)))).to_pylist()
    key = lambda r: (r["query"], -r["score"], math.inf if r["doc_id"] is None else r["doc_id"])
    one_by_one = sorted((r for x in index for r in run([x])), key=key)
    want = [r for i, r in enumerate(one_by_one) if i < 5 or one_by_one[i - 5]["query"] != r["query"]]
    got = run(index)
    assert len(got) <= 5 * len(bags) < len(one_by_one)
    assert sorted(got, key=key) == want


@pytest.mark.parametrize("block", [3, 200])
def test_mixing(spark, block):
    from tessella.llm.mixing import mix, take

    rng = random.Random(6)
    rows = [(i, " ".join(["x"] * rng.randint(0, 60)) if i % 13 else None, None if i % 5 == 4 else "aAbé"[i % 5 % 4]) for i in range(300)]
    rows += [(7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(3)
    got = mix(df, block=block).collect()
    assert sorted((r.taken, r.doc_id) for r in got) == sorted((r.taken, r.doc_id) for r in mix(df, block=block).collect())
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * w[s] / sum(w[x] for x in order if x not in full) for s in order}
        over = {s for s in order if target[s] > 2 * size[s] + 1e-9} - full
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows)
    for s in order:
        assert abs(taken[s] - target[s]) <= 60, (s, taken[s], target[s])
    copies = take(df, block=block)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)
    assert mix(df.limit(0)).count() == 0


def test_mixing_expectation(spark):
    from tessella.llm.mixing import mix

    df = spark.createDataFrame([(i, "x " * (1 + i % 4), "s") for i in range(40)] + [(100 + i, "x " * 10, "t") for i in range(40)], "doc_id long, text string, source string")
    total = collections.Counter()
    for seed in range(12):
        for r in mix(df, weights=(1, 9), share=0.7, seed=seed).where("source = 's'").collect():
            total[r.doc_id % 4] += r.copies
    counts = [total[i] / 120 for i in range(4)]
    assert max(counts) - min(counts) < 0.25  # every size has the same expected copies


def test_ego_join(spark):
    from tessella.llm.ego_join import near_duplicates

    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 12)).astype(np.float32)
    near = x[:60] + 0.08 * rng.normal(size=(60, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *near, *x[:5], *(3 * x[5:9])])]
    rows += [(900, None), (901, []), (902, [0.0] * 12), (903, [0.0] * 12), (904, [float("nan")] * 12), (905, [None] + [1.0] * 11), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (2, x[2].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).repartition(3)
    ok = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links, par = collections.Counter(), list(range(len(ok)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for a in range(len(ok)):
        for b in range(a):
            if len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= 0.95:
                links[a] += 1
                links[b] += 1
                par[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(ok):
        low[find(a)] = min(low.get(find(a), i), i)
    want = [(i, links[a], low[find(a)], low[find(a)] == i) for a, (i, _) in enumerate(ok)]
    bad = [i for i, v in rows if not (v and None not in v and np.isfinite(v).all() and any(v))]
    want += [(i, 0, i, True) for i in bad]
    for block in (16, 2048):
        assert sorted(map(tuple, near_duplicates(df, block=block).collect())) == sorted(want)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    from tessella.llm.components import components

    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(200, 240)] + [(50, 50), (None, 3), (60, 61)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {i: 100 for i in range(200, 240)} | {61: 60}


def test_pipeline_and_entry(spark):
    import __spark_entry__ as e
    import corpus_pipeline as p

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert len(p.STAGES) == 5
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 50
