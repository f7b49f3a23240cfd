"""Files and members of archives, by what is stored."""

import hashlib

from strandline.sources import tables as T


def test_inventory_hashes_what_files_hold(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.bin").write_bytes(b"\x00\xff")
    (tmp_path / "in" / "deep" / "b.bin").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["sha256"]) for r in T.hash_inventory(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.bin": (2, hashlib.sha256(b"\x00\xff").hexdigest()), "b.bin": (1, hashlib.sha256(b"x").hexdigest())}


def test_members_of_archives_are_hashed_one_by_one(spark, tmp_path):
    path = str(tmp_path / "members")
    texts = {f"doc_id={k}": "ä\n" * k for k in range(25)}
    T.write_members(spark.createDataFrame(list(texts.items()), "name string, body string").coalesce(1), path, "name", "body", per_file=10)
    assert len(list((tmp_path / "members").glob("*.parquet"))) == 3
    found = T.hash_members(spark, path)
    assert {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["sha256"]) for r in found.collect()} == {n: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for n, t in texts.items()}
    declared = spark.createDataFrame([("doc_id=1", 3, hashlib.sha256("ä\n".encode()).hexdigest()), ("doc_id=2", 5, "x"), ("lost=3", 1, "x")], "name string, size_bytes bigint, sha256 string")
    status = {r["name"]: r["status"] for r in T.verify_artifacts(declared, found).collect()}
    assert status.pop("doc_id=1") == "verified" and status.pop("doc_id=2") == "size_differs" and status.pop("lost=3") == "missing" and set(status.values()) == {"undeclared"} and len(status) == 23
