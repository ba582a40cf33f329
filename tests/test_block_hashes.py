"""Hashes of files in blocks against hashlib."""

import hashlib
import random

import pytest

from fieldframe.sources import files as S
from fieldframe.sources import sha256


def test_a_hash_goes_on_from_its_state():
    own, data = sha256.Sha256(), bytes(range(256)) * 9
    for a in range(0, len(data), 37):
        own = sha256.Sha256(own.state)
        own.update(data[a:a + 37])
    assert own.hexdigest() == hashlib.sha256(data).hexdigest() == own.hexdigest()
    assert sha256.Sha256().hexdigest() == hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, draw = tmp_path_factory.mktemp("files"), random.Random(3)
    made = {
        "random": draw.randbytes(70_000), "ends": draw.randbytes(5_000) + b"\n", "two ends": b"\r\n" * 4_000 + b"\n\n", "lines": b"\n" * 6_000, "mark": b"\xef\xbb\xbfa,b\n" * 3_000,
        "mark only": b"\xef\xbb\xbf" + b"z" * 5_000, "one line": bytes(20_000), "small": b"abc\n", "packed.gz": draw.randbytes(9_000), "edge": b"x" * 4095 + b"\n" + b"y" * 4096}
    for name, data in made.items():
        (root / name).write_bytes(data)
    return root, {name: hashlib.sha256(data).hexdigest() for name, data in made.items()}


def test_blocks_give_the_hash_of_the_whole_file(spark, folder, monkeypatch):
    """Every task gets one block, as the blocks of a file are hashed in rounds."""
    root, want = folder
    rounds, deal = [], sha256._continued
    monkeypatch.setattr(sha256, "_continued", lambda states: rounds.append(1) or deal(states))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = S.fingerprints(spark, str(root), block=4096).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rounds) == -(-70_000 // 4096)
    assert {r.path.split("/")[-1]: r.sha256 for r in got} == want


def test_files_over_the_limit_are_not_read(spark, folder):
    root, want = folder
    got = {r.path.split("/")[-1]: r.sha256 for r in S.fingerprints(spark, str(root), largest=8_000, block=4096).collect()}
    assert got == {name: h if (root / name).stat().st_size <= 8_000 else None for name, h in want.items()}
