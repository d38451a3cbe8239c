"""The content-addressed archive: exact round trips, revisits, edge cases, damage."""

import hashlib

import pytest
from pyspark.errors import PythonException

PAGES = "page_id long, url string, html string, digest string, part int, salt string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "s", 2) for i, u, h in rows], PAGES).repartition(3)


def rows():
    big, embedded = "<p>é</p>" * 60, "a\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 3\r\n\r\nabc" + "z" * 100
    out = [(i, f"http://a.example/{i}?q=x: y", big) for i in range(5, 40)]
    out += [(1, "u", "tiny"), (2, "u", "tiny"), (3, None, None), (4, "", ""), (None, "u", big), (50, "line\r\nbreak", embedded), (51, "日本", embedded), (52, "u", "x" * 99), (53, "u", "x" * 99), (54, "u", "y" * 100), (55, "u", "y" * 100)]
    return out + [(60, "same", "s" * 300)] * 4 + [(61, "long", "long text " * 200_000)]


def expected(rows):
    first, out = {}, []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and d in first
        out.append((i, len(raw), d, "revisit" if again else "response", first[d] if again else None))
        first.setdefault(d, i)
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_archive_restores_records(spark, tmp_path):
    from tessella.llm import warc

    warc.write_archive(pages(spark, rows()), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({h or "" for _, _, h in rows()})
    assert got(warc.read_archive(spark, str(tmp_path / "a"))) == expected(rows())
    full = warc.read_archive(spark, str(tmp_path / "a"), content=True).collect()
    assert len({r.record_id for r in full}) == len(full)
    ids = {r.record_id: r for r in full}
    for r in full:
        assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        fields, block = warc.parse_record(r.record)
        assert len(block) == int(fields["content-length"])
        if r.record_type == "revisit":
            assert ids[r.refers_to_record].payload == r.payload and ids[r.refers_to_record].record_type == "response"
    # WARC files, as any reader takes them, plain and compressed.
    for how in ("none", "gzip"):
        warc.export_warc(spark, str(tmp_path / "a"), str(tmp_path / how), how)
        back = warc.read_warc(spark, str(tmp_path / how))
        assert got(back) == expected(rows())
        assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in full)


def test_hot_payload_in_many_parts(spark, tmp_path, monkeypatch):
    from tessella.llm import warc

    monkeypatch.setattr(warc, "PER_PART", 7)
    some = [(i, "u", "h" * 200) for i in range(300)] + [(1000 + i, "u", None) for i in range(100)]
    warc.write_archive(pages(spark, some), str(tmp_path / "a"))
    assert got(warc.read_archive(spark, str(tmp_path / "a"))) == expected(some)


def test_empty_table(spark, tmp_path):
    from tessella.llm import warc

    warc.write_archive(pages(spark, []), str(tmp_path / "a"))
    assert got(warc.read_archive(spark, str(tmp_path / "a"))) == []


def test_damage_is_found(spark, tmp_path):
    import zstandard
    from pyspark.sql import functions as F

    from tessella.llm import warc

    warc.write_archive(pages(spark, [(1, "u", "a" * 200), (2, "u", "b" * 200)]), str(tmp_path / "a"))
    p = spark.read.parquet(str(tmp_path / "a/payloads")).toPandas()
    p.loc[0, "frame"] = zstandard.ZstdCompressor().compress(b"c" * 200)
    spark.createDataFrame(p, "digest binary, n_bytes long, parts int, frame binary").write.mode("overwrite").parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(PythonException, match="differs from its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
