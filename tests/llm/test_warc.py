import gzip
import hashlib
import io
import zlib

import pytest

from vaultshift.llm import warc as X


def pages(spark):
    big = "<p>é</p>" * 40
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, big), (4, "u\r\n%0A", None), (5, "", ""), (6, "x", "y" * 99), (7, "x", "y" * 99),
            (8, "x", "y" * 100), (9, "x", "y" * 100), (None, "n", big), (None, "m", "only " * 30), (1, "http://b", big), (10, "WARC/1.1\r\n\r\n", "WARC/1.1\r\n\r\n" * 9000)]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    rows, d = pages(spark)
    at = X.archive_dir(spark)
    X.write_archive(X.with_revisits(d), at)
    got = X.read_archive(spark, at).collect()
    assert len(got) == len(rows)
    want = []
    for k, url, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(body) >= 100 and same and min(same) != k
        want.append((f"<urn:page:{'' if k is None else k}>", "revisit" if again else "response", url,
                     f"<urn:page:{min(same)}>" if again else None, hashlib.sha256(body).hexdigest(), len(body), b"" if again else body))
    assert sorted(map(repr, want)) == sorted(repr((r.record_id, r.record_type, r.target_uri, r.refers_to, r.payload_digest[7:], r.payload_length,
                                                   bytes(r.payload))) for r in got)


def test_push_down_and_payload_left_out(spark):
    _, d = pages(spark)
    at = X.archive_dir(spark)
    X.write_archive(X.with_revisits(d), at)
    some = X.read_archive(spark, at, payload=False).where("record_type = 'revisit' and target_uri in ('http://a', 'x')")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan and "http://a" not in plan  # no filter of Spark's own is left
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:3>", "<urn:page:9>"]
    assert {r.payload for r in some.collect()} == {None}
    assert X.read_archive(spark, at).where("payload_length = 99").count() == 2
    assert X.read_archive(spark, at).where("target_uri is null").count() == 1


def test_unwanted_records_are_not_inflated():
    big = b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(40_000))
    data = b"".join(X.member(X.encode_record({"WARC-Type": t, "WARC-Record-ID": str(i)}, big)) for i, t in enumerate(["a", "b", "a"]))

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    s = Counting(data)
    assert [f["WARC-Record-ID"] for f, p in X.records(s, lambda f: f["WARC-Type"] == "none", True)] == []
    assert s.taken < 3000
    s = Counting(data)
    assert [p for f, p in X.records(s, lambda f: f["WARC-Type"] == "b", True)] == [big]
    assert s.taken < len(data) / 2
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3  # plain gzip members for any other reader


def test_several_files_and_none(spark):
    d = spark.range(50).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('x', id), 300) AS html")
    at = X.archive_dir(spark)
    rows = X.with_revisits(d)
    rows.sparkSession.dataSource.register(X.WarcDataSource)
    rows.select(*X.SCHEMA.names).repartition(3).write.format("warc").option("roll", "500").mode("append").save(at)
    back = X.read_archive(spark, at)
    assert back.count() == 50 and back.rdd.getNumPartitions() > 3
    none = X.archive_dir(spark)
    X.write_archive(X.with_revisits(d.limit(0)), none)
    assert X.read_archive(spark, none).count() == 0


@pytest.mark.parametrize("value", ["a\r\nb", "%0A%", "é: ü"])
def test_header_escapes(value):
    assert X._unescaped(X._escaped(value)) == value


def foreign(http: bool = True):
    """Records as other programs write them: odd spellings, folded lines, HTTP answers, payloads that look like records."""
    inner = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [b"", b"x", b"\r\n\r\n" * 9, inner, gzip.compress(inner, 0), bytes(range(256)) * 900, "é".encode() * 70_000, inner * 3000]
    out, want = [], []
    for i, body in enumerate(bodies):
        head = f"HTTP/1.1 200 OK\r\nServer: n{i}"
        block = head.encode() + b"\r\n\r\n" + body if http else body
        fields = [f"warc-type:{'response' if i % 2 else 'resource'}", f"WARC-RECORD-ID: <urn:uuid:{i}>", f"WARC-Target-URI: http://h/{i}?q=%0A%25",
                  "WARC-Date: 2020-01-01T00:00:00Z", "X-Folded: one", "\ttwo", f"content-length:   {len(block)}"]
        fields.append("Content-Type: application/http; msgtype=response" if http else "Content-Type: text/plain")
        out.append("\r\n".join(["WARC/1.0", *fields]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
        want.append((f"<urn:uuid:{i}>", "response" if i % 2 else "resource", f"http://h/{i}?q=%0A%25", "2020-01-01T00:00:00Z", len(block),
                     head if http else None, body))
    return out, want


def named_member(data: bytes) -> bytes:
    buffer = io.BytesIO()
    with gzip.GzipFile("with a name.warc", "wb", fileobj=buffer) as f:
        f.write(data)
    return buffer.getvalue()


LAYOUTS = {
    "plain.warc": lambda r: b"".join(r),
    "each.warc.gz": lambda r: b"".join(gzip.compress(x) for x in r),
    "named.warc.gz": lambda r: b"".join(named_member(x) for x in r),
    "one.warc.gz": lambda r: gzip.compress(b"".join(r)),
    "blocks.warc.gz": lambda r: b"".join(gzip.compress(b"".join(r)[i:i + 1000]) for i in range(0, len(b"".join(r)), 1000)),
    "own.warc.gz": lambda r: b"".join(X.member(x) for x in r) + bytes(600),
    "mixed.warc.gz": lambda r: X.member(r[0]) + gzip.compress(b"".join(r[1:4])) + b"".join(X.member(x) for x in r[4:]),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_archives_of_others_by_record(layout):
    for http in (True, False):
        made, want = foreign(http)
        data = LAYOUTS[layout](made)
        got = [(r.fields["WARC-Record-ID"], r.fields["X-Folded"], r.http_head(), r.rest()) for r in X.walk(io.BytesIO(data))]
        assert got == [(w[0], "one two", w[5], w[6]) for w in want]
        odd = [f["WARC-Record-ID"] for f, _ in X.records(io.BytesIO(data), lambda f: f["WARC-Type"] == "response", False)]
        assert odd == [w[0] for w in want if w[1] == "response"]
        # every offset is a place to begin and to end
        starts = [r.offset for r in X.walk(io.BytesIO(data)) if r.offset is not None]
        parts = [x for a, b in zip(starts, [*starts[1:], None]) for x in X.records(io.BytesIO(data), lambda f: True, True, a, b)]
        assert [p[0]["WARC-Record-ID"] for p in parts] == [w[0] for w in want]
        with pytest.raises((ValueError, EOFError)):
            list(X.records(io.BytesIO(data.rstrip(b"\0")[:-40]), lambda f: True, True))


def test_a_changed_byte_is_found():
    body = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(200))
    for make in (X.member, gzip.compress):
        data = make(X.encode_record({"WARC-Type": "response"}, body))
        for place in (10 + 6, len(data) // 3, len(data) // 2, len(data) - 6) if make is X.member else (len(data) // 2, len(data) - 6):
            changed = bytearray(data)
            changed[place] ^= 1
            with pytest.raises((ValueError, zlib.error)):
                list(X.records(io.BytesIO(bytes(changed)), lambda f: True, True))
    with pytest.raises(ValueError, match="no record"):
        list(X.records(io.BytesIO(b"GET / HTTP/1.1\r\n\r\n"), lambda f: True, True))


def test_folders_lists_and_parts_of_archives_of_others(spark, tmp_path):
    made, want = foreign()
    (tmp_path / "deep").mkdir()
    for i, (name, layout) in enumerate(LAYOUTS.items()):
        (tmp_path / ("deep" if i % 2 else ".") / name).write_bytes(layout(made))
    (tmp_path / "notes.txt").write_text("no archive")
    columns = ["record_id", "record_type", "target_uri", "date", "content_length", "http_head", "payload"]

    def rows(df):
        return sorted(repr(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in df.select(*columns).collect())

    whole = X.read_archive(spark, str(tmp_path))
    assert whole.rdd.getNumPartitions() == len(LAYOUTS) and rows(whole) == sorted(map(repr, want * len(LAYOUTS)))
    at = str(tmp_path / "index" / "offsets.json")
    X.index_archive(spark, str(tmp_path), at, split=3000)
    cut = X.read_archive(spark, str(tmp_path), index=at)
    assert cut.rdd.getNumPartitions() > len(LAYOUTS) + 4 and rows(cut) == rows(whole)
    assert X.read_archive(spark, str(tmp_path), payload=False, index=at).where("record_type = 'response' and content_length > 100").count() == sum(
        w[1] == "response" and w[4] > 100 for w in want) * len(LAYOUTS)
    assert rows(X.read_archive(spark, str(tmp_path / "plain.warc"))) == sorted(map(repr, want))
    assert X.read_archive(spark, str(tmp_path), files='["plain.warc", "deep/each.warc.gz"]').count() == 2 * len(want)
    # and what was read is written and read again
    back = X.archive_dir(spark)
    X.write_archive(whole.where("record_type = 'response'"), back)
    assert rows(X.read_archive(spark, back)) == rows(whole.where("record_type = 'response'"))


def test_written_records_have_what_the_format_asks_for(spark):
    rows, d = pages(spark)
    at = X.archive_dir(spark)
    d.sparkSession.dataSource.register(X.WarcDataSource)
    X.with_revisits(d).select(*X.SCHEMA.names).coalesce(1).write.format("warc").option("split", "300").mode("append").save(at)
    back = X.read_archive(spark, at)
    assert back.rdd.getNumPartitions() > 2 and back.count() == len(rows)
    assert back.where("date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$'").count() == len(rows)
    fs, base = X.filesystem(at)
    blob = b"".join(gzip.decompress(fs.open_input_file(x.path).read()) for x in fs.get_file_info(X.pafs.FileSelector(base)) if x.path.endswith(".gz"))
    assert blob.count(b"WARC-Profile: http") == back.where("record_type = 'revisit'").count() > 0


def test_clashing_columns_of_pages(spark):
    d = spark.createDataFrame([(1, "http://a", "y" * 120, "n", 5, "z"), (2, " u ", "y" * 120, None, 6, "z")],
                              "page_id long, url string, html string, body string, `first` int, payload string").selectExpr(
        "*", "1 AS digest", "2 AS bytes", "3 AS copies", "4 AS k", "5 AS n", "'x' AS record_type", "'x' AS target_uri")
    at = X.archive_dir(spark)
    X.write_archive(X.with_revisits(d), at)
    assert sorted((r.record_id, r.record_type, r.target_uri) for r in X.read_archive(spark, at).collect()) == [
        ("<urn:page:1>", "response", "http://a"), ("<urn:page:2>", "revisit", " u ")]
