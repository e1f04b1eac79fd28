import base64
import hashlib
import random

from tallyloom.llm import warc as W
from tallyloom.llm.common import fresh_dir

SCHEMA = "page_id long, url string, html string, payload string"


def brute(rows, least=0):
    groups = {}
    for p, _, h, _ in rows:
        groups.setdefault(h or "", []).append(p)
    out = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        top = max(ids, default=None)
        again = len(data) >= least and top is not None and p != top
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def rows():
    r = random.Random(1)
    noise = ["".join(chr(r.randrange(1, 0x2000)) for _ in range(r.randrange(4000))) for _ in range(30)]
    rows = [(i, f"http://x/{i} \r\nWARC/1.1", h, "p") for i, h in enumerate(noise)]
    rows += [(100, None, None, None), (101, "u", "", None), (102, "u", "same", None), (103, "u", "same", None), (103, "u", "same", None), (None, "u", "same", None), (None, "u", "lone", None)]
    rows += [(200, "u", "HTTP/1.1 200 OK\r\n\r\nContent-Length: 9\r\n\r\n", None), (201, "u", "\x1f\x8b\x08" * 2000, None), (202, "u", "long " * 400_000, None)]
    return rows


def test_query_against_brute_force(spark, put):
    d = put(pages=spark.createDataFrame(rows(), SCHEMA))
    got = [tuple(r) for r in W.op3_warc(spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute(rows())


def test_any_split_gives_every_record_once(spark):
    df = spark.createDataFrame(rows()[:-1], SCHEMA)
    manifest = W.write_archives(W.with_revisits(df, min_revisit_bytes=1), fresh_dir(spark, "warc"))
    for split in (97, 5_000, 1 << 30):
        got = W.read_archives(manifest, split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows()[:-1], 1)
        assert all(bytes(r.payload).decode() == (dict((p, h or "") for p, _, h, _ in rows())[r.page_id]) for r in got if r.record_type == "response" and r.page_id is not None)


def test_false_magic_inside_a_member_is_passed_over(tmp_path):
    stored = W.member(1, "u", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03" * 50, False, None, level=0)
    data = stored + W.member(2, "u", b"x", False, None)
    (tmp_path / "a.gz").write_bytes(data)
    for start in range(0, len(data)):
        got = [r[0] for r in W.read_range(f"file://{tmp_path}/a.gz", start, len(data))]
        assert got == ([1, 2] if start == 0 else [2] if start <= len(stored) else [])


def test_empty(spark, put):
    assert W.op3_warc(spark, put(pages=spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_members_are_read_in_a_small_window_and_broken_ones_are_gone_over(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 4096)
    monkeypatch.setattr(W, "INFLATE_BYTES", 1024)
    r = random.Random(4)
    long, short = r.randbytes(300_000), b"short"
    good = W.member(1, "u", long, False, None)
    # A member whose end is damaged, with a whole record inside its bytes: the reader goes back for it.
    broken = W.member(2, "u", r.randbytes(100_000), False, None)
    broken = broken[:60_000] + W.member(3, "u", short, False, None) + b"\0" * 5000
    data = good + broken + W.member(4, "u", long, False, None)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    held = []
    drop = W.Window.drop
    monkeypatch.setattr(W.Window, "drop", lambda self, at: (drop(self, at), held.append(len(self.data)))[0])
    got = list(W.read_range(path.as_uri(), 0, len(data)))
    assert [(x[0], x[4], x[6]) for x in got] == [(1, len(long), long), (3, len(short), short), (4, len(long), long)]
    assert max(held) < 5 * 4096
