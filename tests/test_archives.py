"""Archives whose entries are dealt out, against the reader of whole archives."""

import io
import random
import zipfile

from lodestone.sources import archives, ingest


def packed(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in files:
            z.writestr(name, text)
    return out.getvalue()


def listed(spark, tmp_path, contents):
    rows = []
    for corpus, (name, data) in contents.items():
        (tmp_path / name).write_bytes(data)
        rows.append((corpus, str(tmp_path / name)))
    return spark.createDataFrame(rows, "corpus string, archive string")


def test_same_files_as_from_whole_archives(spark, tmp_path):
    rng = random.Random(1)
    some = [(f"root/d{k % 3}/f{k}.{rng.choice(['py', 'md', 'bin', 'ts'])}", f"text {k} é\n" * rng.randrange(40)) for k in range(120)]
    some += [("root/node_modules/x.py", "no"), ("root/big.py", "x\n" * (1 << 22)), ("root/empty.py", ""), ("root/dir/", ""), ("root/min.js", "x" * 30_000)]
    contents = {"a": ("a.zip", packed(some)), "b": ("b.zip", packed([("x/y.py", "pass"), ("z.py", "pass")], zipfile.ZIP_STORED)), "none": ("none.zip", packed([]))}
    table = listed(spark, tmp_path, contents)
    whole = spark.createDataFrame([(c, bytearray(d)) for c, (_, d) in contents.items()], "corpus string, content binary")
    expected = {tuple(r) for r in ingest.read_zips(whole).select("corpus", "path", "src").collect()}
    for share in (archives.SHARE, 500):
        files, bad = archives.read_archives(table, share)
        assert {tuple(r) for r in files.select("corpus", "path", "src").collect()} == expected and expected
        assert bad.collect() == []
    wanted = archives.entries(table).where("packed IS NOT NULL")
    assert wanted.count() == 120 + 4 + 2


def test_what_cannot_be_read_is_told(spark, tmp_path):
    data = bytearray(packed([(f"f{k}.py", f"print({k})\n" * 50) for k in range(4)], zipfile.ZIP_STORED))
    data[data.index(b"print(2)") + 3] ^= 255
    strange = packed([("a.py", "x = 1\n" * 99)], zipfile.ZIP_BZIP2)
    table = listed(spark, tmp_path, {"hurt": ("hurt.zip", bytes(data)), "odd": ("odd.zip", strange), "text": ("text.zip", b"not an archive")})
    table = table.unionByName(spark.createDataFrame([("gone", str(tmp_path / "gone.zip")), ("null", None)], "corpus string, archive string"))
    files, bad = archives.read_archives(table)
    assert {(r["corpus"], r["path"]) for r in files.collect()} == {("hurt", f"f{k}.py") for k in (0, 1, 3)}
    told = {(r["corpus"], r["path"], r["error"].split(":")[0]) for r in bad.collect()}
    assert told == {("hurt", "f2.py", "damaged"), ("odd", "a.py", "packed by method 12"), ("text", None, "no archive"), ("gone", None, "no archive")}
    none = archives.read_archives(table.where("false"))
    assert none[0].count() == 0 and none[1].count() == 0
