import hashlib
import random

from docmill.sources.documents import scan_files, with_digest
from workload.queries import QUERIES


def test_files_beyond_what_a_reader_holds_are_digested(spark, tmp_path):
    """Whole files, read in pieces: their digests are those of their bytes, in order."""
    rng = random.Random(3)
    held = {
        "a.parquet": rng.randbytes(300_000),
        "b.parquet": b"\n\n\r\n" + rng.randbytes(50_000) + b"\n",
        "c.parquet": b"\xef\xbb\xbfmarked\n\nlines",
        "d.parquet": b"\xef\xbb\xbf\n",
        "e.parquet": b"\xef\xbb\xbf",
        "f.parquet": b"x",
        "g.parquet": b"\n",
        "sub/a.parquet": b"another\n",
    }
    (tmp_path / "sub").mkdir()
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        rows = with_digest(scan_files(spark, str(tmp_path), "*.parquet"), spark, str(tmp_path), "*.parquet")
        found = {r.path.split(f"{tmp_path}/")[1]: (r.length, r.bytes, r.md5) for r in rows.drop("content").collect()}
        assert found == {k: (len(v), len(v), hashlib.md5(v).hexdigest()) for k, v in held.items()}
        assert QUERIES["scan_documents"](spark, str(tmp_path)).count() == len(held)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
