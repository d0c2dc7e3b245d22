"""Numbered lines and torn ends against a plain reader, for any size of a split."""

import json
import os

import pytest
from sievework.sources.log import judged_lines, load, numbered_lines

FILES = {
    "a.jsonl": b'{"id": "x", "n": 1}\n\n{"id": "y"}\r\n   \n{"id": "x", "n": 2}\n' + "".join(json.dumps({"id": f"k{i % 40}", "t": "é" * (i % 60)}, ensure_ascii=False) + "\n" for i in range(300)).encode(),
    "b.jsonl": b'{"id": "y", "n": 9}\n{"n": 3}\n{"n": 3}\n{"id": "z", "to',
    "c.jsonl": b'{"id": "w"}\n{"id": "v"}',
    "d.jsonl": b"",
    "e.jsonl": b"\n",
    "f.jsonl": b'{"id"',
}


def plain(folder):
    out = {}
    for name in sorted(os.listdir(folder)):
        raw = open(f"{folder}/{name}", "rb").read()
        pieces = raw.split(b"\n")
        ended = pieces.pop() == b""
        if not ended:
            pieces.append(raw.rsplit(b"\n", 1)[-1])
        for no, line in enumerate(pieces, 1):
            text = line.removesuffix(b"\r").decode()
            try:
                fine = isinstance(json.loads(text), dict)
            except ValueError:
                fine = False
            out[name, no] = (text, "blank" if not text.strip() else "record" if fine else "torn" if not ended and no == len(pieces) else "bad")
    return out


@pytest.fixture
def folder(tmp_path):
    for name, raw in FILES.items():
        (tmp_path / name).write_bytes(raw)
    return tmp_path


@pytest.mark.parametrize("split", [37, 100, 1000, 1 << 27])
def test_lines(spark, folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {(os.path.basename(r.path), r.line_no): (r.line, r.state) for r in judged_lines(numbered_lines(spark, f"{folder}")).collect()}
        assert got == plain(folder)
        first = {}
        for (name, no), (text, state) in sorted(plain(folder).items()):
            if state == "record":
                first.setdefault(json.loads(text).get("id") or (name, no), (name, no))
        assert {(os.path.basename(r.path), r.line_no) for r in load(spark, f"{folder}", "id").collect()} == set(first.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_line(spark, folder):
    (folder / "g.jsonl").write_bytes(b'{"id": 1}\n[1, "secret"]\n{"id": 2}\n')
    with pytest.raises(Exception, match=r"no JSON object: .*g.jsonl:2") as e:
        load(spark, f"{folder}").collect()
    assert "secret" not in str(e.value)
