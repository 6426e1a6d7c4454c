import hashlib
import tarfile
import zlib

from meshspan.llm.media import decode_png, encode_png, media_columns, padded, read_header


def test_round_trip_of_the_format():
    for raw in (b"", b"a", b"x" * 576, bytes(range(255)) * 50):
        p = padded(raw)
        assert len(p) % 576 == 0 and len(p) and p.rstrip(b"\xff") == raw
        image = encode_png(p)
        assert decode_png(image) == p and read_header(image[:33]) == (576, len(p) // 576, 8)


def test_media_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "z" * 5000), (5, "héllo"), (5, "héllo"), (None, "n" * 576)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, shard string").repartition(3)
    got = media_columns(df, shard_bytes=1000).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        p = padded((t or "").encode())
        for r in by_id[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest())
            assert r.digest == r.payload_sha256 and r.tail_crc32 == zlib.crc32(p[-32:])
            path = r["shard"].removeprefix("file://").removeprefix("file:")
            with open(path, "rb") as f:
                f.seek(r.offset)
                image = f.read(r.length)
            assert hashlib.sha256(image).hexdigest() == r.media_sha256 and decode_png(image) == p
            with tarfile.open(path) as tar:
                assert f"{r.digest}.png" in tar.getnames()
    assert len({(r["shard"], r.offset) for r in got}) == 4
    assert media_columns(df.limit(0)).count() == 0
