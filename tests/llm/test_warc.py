"""Archives: byte-exact round trips, frames and offsets, revisits, broken files, odd rows."""

import hashlib
import io
import os
import random
import struct

import pyarrow as pa
import pytest
import zstandard

from trackhouse.llm import warc
from trackhouse.sources.storage import listed


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(f"<p>word{rng.randrange(300)}</p>" for _ in range(rng.randrange(1, 200))).encode() for _ in range(n)]


def written(payloads):
    out = io.BytesIO()
    archive = warc._Archive(out)
    for i, p in enumerate(payloads):
        archive.add(warc.record(str(i), f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), None))
    archive.close()
    return out.getvalue()


@pytest.mark.parametrize("payloads", [[b""], [b"x"], texts(3), texts(400), texts(5) + [b"\r\n\r\n" * 100], [os.urandom(3_000_000)] * 3])
def test_frames_and_records(payloads):
    data = written(payloads)
    found = list(warc.records(pa.BufferReader(data)))
    assert [r.payload for _, _, r in found] == payloads
    magic, length = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_FRAME and found[0][0] == 8 + length
    ends = [offset + stored for offset, stored, _ in found]
    assert [offset for offset, _, _ in found[1:]] == ends[:-1] and ends[-1] == len(data)
    # Every record is a frame of its own.
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + length]))
    unpack = zstandard.ZstdDecompressor(dict_data=words)
    for (offset, stored, r), payload in zip(found, payloads):
        assert unpack.decompress(data[offset : offset + stored]).endswith(payload + b"\r\n\r\n")


def test_dictionary_pays():
    payloads = texts(3000)
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    alone = sum(len(plain.compress(warc.record(str(i), None, p, hashlib.sha256(p).hexdigest(), None))) for i, p in enumerate(payloads))
    assert len(written(payloads)) < 0.8 * alone


def test_broken_archives():
    data = written(texts(4))
    for cut in (len(data) - 1, len(data) - 60, 5):
        with pytest.raises(ValueError, match="inside a frame"):
            list(warc.records(pa.BufferReader(data[:cut])))
    good = warc.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    for broken in (good.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"), good[:-2], b"WARC/9" + good, good.replace(b"sha256:2", b"sha256:3")):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(broken)


def plain(rows):
    out = []
    for i, _, html in rows:
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        payload = (html or "").encode()
        refers = min(same) if len(payload) >= 100 and same and min(same) != i else None
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


def test_round_trip_of_odd_rows(spark, tmp_path):
    big, small = "é" * 50, "y" * 99
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * 20) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: 1 50% \x7f", ""), (3, "again", rows[3][2]), (3, "again", rows[3][2]), (None, "n", rows[5][2])]
    rows += [(None, "n", "only without an id " * 9), (None, "n", "only without an id " * 9), (200, "a", small), (201, "a", small)]
    rows += [(203, "a", big), (202, "a", big), (300, "long", "0123456789" * 900_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int").repartition(4)
    place = warc.write_archives(frame, str(tmp_path / "w"))
    read = warc.read_archives(spark, place).cache()
    got = [(int(r.id) if r.id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers) if r.refers else None) for r in read.collect()]
    assert sorted(map(repr, got)) == plain(rows)
    assert {r.target_uri for r in read.collect()} == {u for _, u, _ in rows}
    for r in read.where("record_type = 'response'").collect():
        assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
        again = warc.read_record(r.archive, r.offset, r.stored)
        assert again.payload == r.payload and again.fields["WARC-Record-ID"] == r.record_id
    # A revisit names the record of its response.
    names = {r.id: r.record_id for r in read.where("record_type = 'response'").collect()}
    first = read.where("record_type = 'revisit'").first()
    assert warc.read_record(first.archive, first.offset, first.stored).fields["WARC-Refers-To"] == names[first.refers]


def test_archives_are_cut_and_hot_payloads_fold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    monkeypatch.setattr(warc, "LEARNED", 5_000)
    archive = written_rows = [(i, "u", "hot " * 100 if i % 3 else f"<b>{random.Random(i).random()}</b>" * 8) for i in range(2000)]
    writer = warc.ArchiveWriter(str(tmp_path / "w"), False)
    batch = pa.RecordBatch.from_pylist([{"id": str(i), "url": u, "html": h, "digest": hashlib.sha256(h.encode()).hexdigest(), "refers": None} for i, u, h in archive])
    done = writer.write(iter([batch]))
    assert listed(str(tmp_path / "w"), ".warc.zst") == []
    writer.commit([done, None])
    names = listed(str(tmp_path / "w"), ".warc.zst")
    assert len(names) == len(done.files) > 1 and os.listdir(tmp_path / "w") and not any(n.startswith("_staged") for n in os.listdir(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w"), with_payload=False)
    assert read.count() == len(written_rows) and read.where("payload is not null").count() == 0


def test_failed_job_leaves_nothing(spark, tmp_path):
    writer = warc.ArchiveWriter(str(tmp_path / "w"), False)
    batch = pa.RecordBatch.from_pylist([{"id": "1", "url": "u", "html": "x", "digest": "d", "refers": None}])
    writer.write(iter([batch]))
    writer.abort([])
    assert os.listdir(tmp_path / "w") == []


def test_empty_table(spark, tmp_path):
    place = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, place).collect() == []
