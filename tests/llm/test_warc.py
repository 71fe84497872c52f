"""WARC bundles: against SQL and a plain version, round trips, seeks, damaged files, odd rows."""

import hashlib
import io
import random
from collections import defaultdict
from pathlib import Path

import pytest
import zstandard
from test_corpus import SF, sql

from tessella.llm import queries, warc

PAGES = "page_id long, url string, html string, sha1 string, h string, key string"


@pytest.fixture
def pages(spark):
    """Pages with clashing extra columns."""
    return lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(3)


def odd_pages():
    big, other = "<p>é世</p>" * 200, "b" * 999
    rows = [(i, f"https://e.example/{i}", big) for i in range(40)] + [(50 + i, "u", other) for i in range(3)]
    rows += [(60, "u", "c" * 1000), (61, "v", "c" * 1000), (61, "w", "c" * 1000), (62, None, None), (63, "a\r\nb c", ""), (64, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    rows += [(70, "same", "d" * 2000)] * 5 + [(None, "n", "e" * 1500), (None, None, "e" * 1500), (71, "long", "long é " * 300_000)]
    return rows


def by_hand(rows):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    groups, out = defaultdict(list), []
    for i, u, html in rows:
        groups[(html or "").encode()].append((i, u))
    for payload, members in groups.items():
        digest = hashlib.sha1(payload).hexdigest()
        key = lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or "")
        first, *rest = sorted(members, key=key, reverse=True)
        out.append((first[0], len(payload), digest, "response", None))
        out += [(i, len(payload), digest, *(("revisit", first[0]) if len(payload) >= 1000 else ("response", None))) for i, _ in rest]
    return sorted(map(repr, out))


def digest_rows(found):
    return sorted(repr((r.page_id, r.payload_bytes, r.sha1, r.type, r.refers_page)) for r in found.collect())


def test_query_against_sql(spark):
    found = queries.op13_warc(spark, SF)
    want = sql(warc.RECORDS_SQL).select(*found.columns).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
@pytest.mark.parametrize("frame,bundle", [(1, 1), (3000, 500), (1 << 20, 64 << 20)])
def test_round_trip(spark, pages, tmp_path, broadcast_rows, frame, bundle):
    rows = odd_pages()
    records = warc.deduplicated(pages(rows), broadcast_rows=broadcast_rows)
    index = warc.write_bundles(records, str(tmp_path), frame_bytes=frame, bundle_bytes=bundle)
    found = warc.read_bundles(index, payload=True)
    assert digest_rows(found) == by_hand(rows)
    assert warc.unresolved(found).isEmpty()
    texts = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    stored = found.where("type = 'response'").collect()
    assert all(bytes(r.payload) == texts[r.sha1] for r in stored)
    assert index.select("record_id").distinct().count() == len(rows)
    if frame == 1:
        assert index.select("bundle", "frame").distinct().count() == len(rows)


def test_fetch_by_identifier(spark, pages, tmp_path):
    rows = odd_pages()
    index = warc.archive(spark, pages(rows), str(tmp_path))
    every = index.collect()
    some = random.Random(1).sample(every, 9)
    wanted = spark.createDataFrame([(r.record_id,) for r in some] * 2 + [("absent",)], "record_id string")
    got = warc.fetch(index, wanted).collect()
    assert sorted(r.record_id for r in got) == sorted(r.record_id for r in some)
    for r in some:
        data = Path(r.bundle.removeprefix("file://")).read_bytes()
        frame = warc.read_frame(io.BytesIO(data), warc.seek_table(io.BytesIO(data), len(data))[r.frame])
        (one,) = warc.parsed(frame[r.start : r.start + r.length])
        assert one[2]["warc-record-id"] == f"<{r.record_id}>"


def test_bundles_are_plain_zstandard(spark, pages, tmp_path):
    """Any reader of frames can read a bundle from its start; the seek table is skipped."""
    index = warc.write_bundles(warc.deduplicated(pages(odd_pages())), str(tmp_path), frame_bytes=2000)
    named = {r.bundle for r in index.select("bundle").collect()}
    files = list(tmp_path.glob("bundles/*.warc.zst"))
    assert {f"file://{f}" for f in files} == named
    for f in files:
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True) as reader:
            whole = reader.read()
        kinds = [h["warc-type"] for _, _, h, _ in warc.parsed(whole)]
        assert kinds[0] == "warcinfo" and len(kinds) - 1 == index.where(index.bundle == f"file://{f}").count()


def test_bundles_that_no_index_names_are_not_read(spark, pages, tmp_path):
    index = warc.archive(spark, pages(odd_pages()), str(tmp_path))
    (tmp_path / "bundles" / "left-by-a-lost-task.warc.zst").write_bytes(b"half a frame")
    assert digest_rows(warc.read_bundles(index)) == by_hand(odd_pages())


def test_damage_is_found():
    class File(io.BytesIO):
        def close(self):
            self.all = self.getvalue()

    file = File()
    writer = warc.BundleWriter(file, frame_bytes=100)
    places = [writer.add(b"%d" % i * 60) for i in range(6)]
    writer.close()
    assert places == [(0, 0), (0, 60), (1, 0), (1, 60), (2, 0), (2, 60)]
    whole = file.all
    table = warc.seek_table(io.BytesIO(whole), len(whole))
    assert [warc.read_frame(io.BytesIO(whole), e) for e in table] == [b"0" * 60 + b"1" * 60, b"2" * 60 + b"3" * 60, b"4" * 60 + b"5" * 60]
    with pytest.raises(ValueError):
        warc.seek_table(io.BytesIO(whole[:-1] + b"x"), len(whole))
    at, size, plain, check = table[1]
    with pytest.raises(ValueError):
        warc.read_frame(io.BytesIO(whole), (at, size, plain, check ^ 1))
    with pytest.raises(ValueError):
        list(warc.parsed(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))


def test_no_pages(spark, pages, tmp_path):
    index = warc.archive(spark, pages([(1, "u", "x")]).limit(0), str(tmp_path))
    assert index.isEmpty() and warc.read_bundles(index).isEmpty()
    assert warc.fetch(index, index.select("record_id")).isEmpty()
