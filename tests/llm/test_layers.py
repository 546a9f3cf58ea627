"""Layers that are glued, damaged, wide, followed by others, or many times escaped."""

import base64
import gzip
import time
import zlib

import pytest
import zstandard

from agorascope.llm import secrets

SECRET = "password=hunter2hunter2"


def b64(raw):
    return base64.b64encode(raw).decode()


def spans(text):
    return [f[:3] for f in secrets.find(text)[0] if f[1] == 0]


@pytest.mark.parametrize("raw", [
    SECRET.encode("utf-16-le"), SECRET.encode("utf-16-be"), SECRET.encode("utf-16"), ("é " + SECRET).encode("utf-16-le"),
    b"\xff\xfe\x80" + SECRET.encode() + b"\xff", bytes(range(32)) * 3 + SECRET.encode() + bytes(50),
    "日本語".encode() + SECRET.encode(), SECRET.encode() + b" \xc3",
])
def test_bytes_that_are_no_text(raw):
    code = b64(raw)
    found = spans(f"see {code} there")
    assert len(found) == 1 and 4 <= found[0][0] < found[0][2] <= 4 + len(code)
    inside = raw.find(SECRET.encode())
    if inside >= 0:  # the span is that of the characters which write the secret
        assert found[0] == (4 + inside * 4 // 3, 0, 4 - (-(inside + len(SECRET)) * 4 // 3))


@pytest.mark.parametrize("glue", ["/", "/a/", "/ab-", "/abc_", "https://h/", "k+", "xy"])
def test_glued_runs(glue):
    code = b64(f"  {SECRET}".encode())
    assert len(spans(glue + code)) == 1
    for packed in (gzip.compress(SECRET.encode()), zstandard.compress(SECRET.encode())):
        assert len(spans(glue + b64(packed))) == 1


@pytest.mark.parametrize("first", [gzip.compress(b"nothing here"), zlib.compress(b"nothing"), zstandard.compress(b"nothing")])
def test_after_the_last_member(first):
    for rest in (SECRET.encode(), b"\n\n" + SECRET.encode(), gzip.compress(SECRET.encode()), zstandard.compress(SECRET.encode())):
        code = b64(first + rest)
        assert spans(code) == [(0, 0, len(code))]


def test_named_references():
    for text in ("password&equals;hunter2hunter2", "password&colon;&quot;hunter2hunter2", "password&amp;amp;#61;hunter2hunter2"):
        assert spans(text) == [(0, 0, len(text))]
    assert spans("a &nosuch; b & c &amp d") == []


def test_long_chains_take_linear_time():
    start = time.process_time()
    for n in (1, 2, 300_000):
        for text in ("password%" + "25" * n + "3dhunter2hunter2", "password&" + "amp;" * n + "#61;hunter2hunter2"):
            assert spans(text) == [(0, 0, len(text))]
    assert time.process_time() - start < 20
