"""Words, sets and rows that hashes of a weaker kind, or ids alone, would take for each other."""

import hashlib
import math
import random
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from .test_llm import brute_components, brute_repeats, frame, model_path, words


def thue_morse(n, x="a", y="b"):
    """Two strings of 2**n letters on which every polynomial modulo 2**64 agrees from n = 10 on."""
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_word_hashes_are_no_polynomials():
    import numpy as np
    import pyarrow as pa

    from tessella.llm.text import chunks, scan, span_digests, word_hashes

    for n in range(4, 13):
        pair = thue_morse(n)
        for _, buf, off in chunks(pa.array([" ".join(pair)])):
            w = scan(buf, off)
            for lane in (0, 1):
                a, b = word_hashes(w, lane).tolist()
                assert a != b
    rng = random.Random(0)
    text = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 20))) for _ in range(5000))]
    for _, buf, off in chunks(pa.array(text)):
        w = scan(buf, off)
        for lane in (0, 1):
            h = word_hashes(w, lane)
            assert len(set(h.tolist())) == len(set(text[0].split()))
        h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
        d = span_digests(h, np.array([0, 3, 5]), np.array([3, 3, 3]), step=4)
        assert d[0] == d[1] != d[2]


def test_repeats_of_colliding_words(spark):
    from tessella.llm.substring_dedup import remove_repeats

    x, y = thue_morse(10)
    rest = [f"r{i}" for i in range(12)]
    rows = [(1, " ".join([x, *rest])), (2, " ".join([y, *rest])), (3, " ".join([x, *rest]))]
    got = {r.doc_id: r.n_removed for r in remove_repeats(frame(spark, rows), n_homes=2).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_jaccard_of_colliding_words(spark):
    from tessella.llm.jaccard_join import similar_components

    x, y = thue_morse(10)
    rows = [(1, f"{x} b c d e"), (2, f"{y} b c d e"), (3, f"{y}  b c d e")]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(frame(spark, rows)).collect()) == brute_components(rows, 5, 75)


def test_counts_of_colliding_words(spark):
    from tessella.llm.bm25 import top_k
    from tessella.llm.class_lm import score_documents

    x, y = thue_morse(10)
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1][:3]  # training documents
    rows = list(zip(ids, [f"{x} c", f"{y} c", f"{y} d"]))
    got = {r.doc_id: r.base_score for r in score_documents(frame(spark, rows)).collect()}
    c, n, v = {x: 1, y: 2, "c": 2, "d": 1}, 9, 5
    base = lambda t: sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in [*(c[w] for w in t.split()), 3])
    assert all(abs(got[i] - base(t)) < 1e-9 for i, t in rows)
    df = frame(spark, rows)
    found = top_k(df, df.where(F.col("doc_id") == ids[2]), k=3).collect()
    assert sorted(r.doc_id for r in found) == ids[1:]


def test_pieces_of_colliding_segments(spark):
    import sentencepiece

    from tessella.llm.piece_bpe import encode

    x, y = thue_morse(10)
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rows = [(1, x), (2, y), (3, f"{y} {x}")]
    assert {r.doc_id: r.ids for r in encode(frame(spark, rows).coalesce(1), model_path()).collect()} == {i: sp.encode(t, add_eos=True) for i, t in rows}


def test_pieces_when_hashes_collide(monkeypatch):
    """With a hash of few values, segments are told apart by their bytes."""
    import numpy as np
    import pyarrow as pa
    import sentencepiece

    from tessella.llm import piece_bpe

    true = piece_bpe.word_hashes
    monkeypatch.setattr(piece_bpe, "word_hashes", lambda w: true(w) % np.uint64(61))
    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=model_path()), piece_bpe.Coder(piece_bpe.Model(model_path())), random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(120)]
    for part in (texts[:60], texts[60:]):
        for rows, buf, offsets in piece_bpe.chunks(pa.array(part)):
            ids, bounds = coder.encode(buf, offsets)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [sp.encode(t, add_eos=True) for t in part[rows]]


def test_long_segments_take_part_in_the_rounds():
    import pyarrow as pa
    import sentencepiece

    from tessella.llm.piece_bpe import Coder, Model, chunks

    rng = random.Random(8)
    texts = ["a" * 3000, "ab" * 1500 + "c", "".join(rng.choice("abcdefghé日") for _ in range(5000)), "the" * 700 + " x"]
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=model_path()), Coder(Model(model_path()))
    for rows, buf, offsets in chunks(pa.array(texts)):
        ids, bounds = coder.encode(buf, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [sp.encode(t, add_eos=True) for t in texts[rows]]


@pytest.mark.parametrize("homes", [1, 5])
def test_many_rows_of_one_id(spark, homes):
    """Null and repeated ids stand in several homes."""
    from tessella.llm.substring_dedup import remove_repeats

    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(50)]
    rows = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(20)] + passage[rng.randrange(20) : rng.randrange(25, 50)] + [rng.choice(vocab) for _ in range(9)]
        rows.append((rng.choice([None, 7, 7, 8, 9, i]), " ".join(w)))
    rows += rows[:6]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(frame(spark, rows), digest=True, n_homes=homes).collect()), key=str)
    assert got == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute_repeats(rows, 13)), key=str)


def test_keep_first_decides_by_row(spark):
    from tessella.llm.jaccard_join import keep_first

    rng = random.Random(2)
    a, b = ([rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(60)] for _ in range(2))
    rows = [(3, " ".join(a)), (5, " ".join([*a, "q"])), (5, " ".join(b)), (5, " ".join(b)), (None, " ".join(a)), (None, None), (None, None), (8, " "), (6, "x y"), (7, "X y")]
    df = frame(spark, rows).withColumn("component", F.lit(1)).withColumn("_n", F.lit("mine"))
    kept = keep_first(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, " ".join(a)), (5, " ".join(b)), (None, None), (None, None), (8, " "), (6, "x y")], key=str)
    assert keep_first(df.limit(0)).count() == 0
    null = keep_first(frame(spark, [(None, " ".join(a)), (None, " ".join([*a, "q"])), (None, " ".join(b))]))
    assert null.count() == 2 and words(null.collect()[0].text)


@pytest.mark.parametrize("change", [lambda t: t.strip(), lambda t: " ".join(t.split(" ")).replace("  ", " "), lambda t: unicodedata.normalize("NFKC", t), None])
def test_models_that_normalise_are_refused(monkeypatch, change):
    import sentencepiece

    from tessella.llm.piece_bpe import Model

    class Other(sentencepiece.SentencePieceProcessor):
        """The public model with another normaliser, or without a space first."""

        def normalize(self, text):
            return "▁" + change(text).replace(" ", "▁") if change else text.replace(" ", "▁")

    assert Model(model_path()).size == 32_000
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="keep texts as they are"):
        Model(model_path())


def test_vectors_are_told_apart_by_themselves(spark):
    """Equal vectors are one class whatever their ids, repeated ids included; near ones link, others do not."""
    from tessella.llm.ego_join import near_duplicates

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1e-3]), (None, [1.0, 0.0]), (5, None), (6, [0.0, -1.0])]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "n_links", "component_id").collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 1, 1), (2, 3, 1), (3, 1, 1), (4, 3, 1), (None, 3, 1), (5, 0, 5), (6, 0, 6)], key=repr)
