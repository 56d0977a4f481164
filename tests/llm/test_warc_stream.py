"""Archives that others wrote, read as streams."""

import gzip
import hashlib
import random

import pytest

from panelwright.llm import warc


def _record(i, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.fixture
def payloads():
    rng = random.Random(11)
    made = [b"", b"\r\n\r\n", b"\r", b"\r\n\r", b"\n\r\n\r\n\r\r\n", b"WARC/1.0\r\n\r\n", bytes(range(256)) * 300, b"\xff\xfe\r\n\r\n\x00"]
    # separators, whole and broken off, wherever a reader's buffer may end
    made += [b"".join(rng.choice([b"\r", b"\n", b"\r\n", b"\r\n\r\n", b"x", b"\xe9"]) for _ in range(rng.choice([3, 50, 90_000]))) for _ in range(40)]
    return made + [b"y" * (3 << 20) + b"\r\n\r"]


@pytest.mark.parametrize("by_member", [True, False])
def test_bytes_come_back(spark, tmp_path, payloads, by_member):
    for part in range(3):
        records = [_record(i, p) for i, p in enumerate(payloads) if i % 3 == part]
        (tmp_path / f"{part}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)) if by_member else gzip.compress(b"".join(records)))
    got = warc.read_archives(spark, str(tmp_path), with_payload=True).select("record_id", "payload", "payload_bytes").collect()
    assert {r.record_id: bytes(r.payload) for r in got} == {f"<r{i}>": p for i, p in enumerate(payloads)}
    assert len(got) == len(payloads) and all(r.payload_bytes == len(r.payload) for r in got)


@pytest.mark.parametrize("cut", [60, 9])
def test_a_record_that_breaks_off_is_an_error(spark, tmp_path, cut):
    (tmp_path / "0.warc.gz").write_bytes(gzip.compress(_record(0, b"whole") + _record(1, b"z" * 100)[:-cut]))
    with pytest.raises(Exception, match="breaks off"):
        warc.read_archives(spark, str(tmp_path)).collect()
