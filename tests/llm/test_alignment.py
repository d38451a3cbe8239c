"""Alignment of tokenizers against the two libraries and a plain loop; the fragment monoid."""

import collections
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from tessella.llm.alignment import _byte_of_char

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte, docs = _byte_of_char(), []
    for i, text in rows:
        groups, links = [], []
        if text:
            raw = b" " + text.encode()
            x = [(t, bytes(byte[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(t, bytes([int(p[1:-1], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode()) for t in b.encode(text) for p in [b.id_to_piece(t)]]
            if b"".join(z for _, z in x) == raw == b"".join(z for _, z in y):
                ends = [list(np.cumsum([len(z) for _, z in s])) for s in (x, y)]
                shared = sorted(set(ends[0]) & set(ends[1]))
                for low, high in zip([0, *shared], shared):
                    groups.append("|".join(",".join(str(t) for (t, _), e in zip(s, end) if low < e <= high) for s, end in zip((x, y), ends)))
                j = 0
                for (t, z), e in zip(x, ends[0]):
                    while j < len(y) and ends[1][j] - len(y[j][1]) < e:
                        if ends[1][j] > e - len(z):
                            links.append((t, y[j][0]))
                        if ends[1][j] > e:
                            break
                        j += 1
                docs.append((i, len(x), len(y), groups, links))
                continue
        docs.append((i, 0, 0, [], []))
    count = collections.Counter(p for d in docs for p in set(d[4]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, n, m, len(g), len(p), sum(count[q] == best[q[0]] for q in p), sum(count[q] for q in p), ";".join(g)) for i, n, m, g, p in docs]


def texts(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "日本語", "l'été", "it's", "x\ty", "<|endoftext|>", "</s>", "123456", "\n\n", "  ", "!?", "ﬁn", "é", " ", "　z", "😀", "a b", "\r\n", "   q"]
    make = lambda k: rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(k))
    out = [make(rng.randint(1, 60)) for _ in range(60)]
    out += [None, "", " ", "  ", "a ", " a", "\n", "▁", "a▁b", "it▁ is", "x" * 5000, "ab" * 3000 + " " + "-" * 4000, make(3000), "word " * 3000, out[0], out[0]]
    return [*enumerate(out), (None, "no id"), (3, out[3])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "p") for i, t in rows], "doc_id long, text string, row long, pair string").repartition(3)


def run(spark, rows, **how):
    from tessella.llm.alignment import align

    out = align(frame(spark, rows), A, B, **how)
    return sorted((tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=repr)


def test_alignment_equals_the_libraries(spark):
    rows = texts()
    want = sorted(brute(rows), key=repr)
    assert sum(r[3] > 0 for r in want) > 60 and any(r[3] == 0 and t for r, t in zip(brute(rows), [t for _, t in rows]))
    # Whole texts; then texts cut anywhere, composed in one round and in several.
    for size in (1 << 20, 997, 61):
        assert run(spark, rows, chunk_bytes=size) == want


def test_digest_and_empty(spark):
    rows = texts()[:8] + [(100, None)]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)]
    assert run(spark, rows, digest=True) == sorted(want, key=repr)
    assert run(spark, [(None, None)][:0]) == []


def test_fragments_compose_associatively():
    from tessella.llm.alignment import _NONE, Aligner, Fragment, Tokenizers
    from tessella.llm.piece_bpe import Model

    model = Model(B)
    with open(A) as f:
        both = Tokenizers(f.read(), model)
    work = Aligner(len(both.a.lengths), model.size)
    text = "Tokenization, naïve 日本語 l'été! " * 6
    buf = np.frombuffer(text.encode(), np.uint8)
    t, bad, off = both.tokens(buf, np.array([0, len(buf)]))
    assert not bad.any()
    rng = random.Random(1)
    whole = work.fragment(t).whole(work)
    for _ in range(20):
        cut = [0, *sorted(rng.sample(range(1, int(off[-1])), 9)), int(off[-1])]
        parts = [work.fragment(t.between(a, b)) for a, b in zip(cut, cut[1:])]
        join = lambda x, y: x.compose(y, work)
        k = rng.randint(1, 8)
        tree = join(functools.reduce(join, parts[:k]), functools.reduce(join, parts[k:]))
        unit = Fragment(_NONE, None)
        for f in (functools.reduce(join, parts), tree, join(unit, join(tree, unit))):
            got = f.whole(work)
            assert (got.text, got.n_a, got.n_b, got.n_groups) == (whole.text, whole.n_a, whole.n_b, whole.n_groups)
            assert got.keys.tolist() == whole.keys.tolist() and got.times.tolist() == whole.times.tolist()


def test_parts_are_token_boundaries():
    from tessella.llm.alignment import parts

    buf = np.frombuffer(" a b  c\n d  e　 f".encode(), np.uint8)
    at = np.flatnonzero(parts(buf, np.array([0, len(buf)])))
    assert [bytes(buf[i : i + 2]) for i in at] == [b" a", b" b", b"  "]


@pytest.mark.parametrize("size", [8, 40])
def test_long_stretches_are_not_cut(size):
    from tessella.llm.alignment import _pieces

    class Context:
        @staticmethod
        def partitionId():
            return 0

    import pyarrow as pa
    import pyspark

    keep, pyspark.TaskContext.get = pyspark.TaskContext.get, staticmethod(lambda: Context)
    try:
        text = "x" * 50 + " " + "y z " * 20
        rows = [r for b in _pieces(size)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})]) for r in b.to_pylist()]
    finally:
        pyspark.TaskContext.get = keep
    assert rows[0]["low"] == 0 and rows[-1]["high"] == len(text) + 1
    assert all(a["high"] == b["low"] for a, b in zip(rows, rows[1:]))
    assert rows[0]["high"] == 51
