"""The store of texts: lookups that open one part, and a search that ends early."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from lodestone.operators import search
from lodestone.sources import stored

FILE = "corpus string, path string, src string"


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["needle", "plain", "other", "text"])
    rows = [("c", f"d{k % 7}/f{k:04}.txt", "\n".join(" ".join(word() for _ in range(3)) for _ in range(rng.randrange(1, 6)))) for k in range(3000)]
    rows += [("odd/name=1", "a b.txt", "Needle"), ("odd/name=1", "z.txt", None), ("c", "d0/f0000.txt", ""), (None, "x", "needle"), ("c", None, "needle")]
    return spark.createDataFrame(rows, FILE).repartition(5)


@pytest.fixture(scope="module")
def kept(files):
    return stored.store(files)


def rows_of(df):
    return sorted((r["corpus"], r["path"], r["line"], r["col"], r["context"]) for r in df.collect())


@pytest.mark.parametrize(("query", "limit"), [("needle", 300), ("needle", 10**6), ("NEEDLE plain", 500), ("nowhere", 300), ("needle", 1)])
def test_same_rows_as_the_whole_search(files, kept, query, limit):
    clean = files.where("corpus = 'c' AND path IS NOT NULL").groupBy("corpus", "path").agg({"src": "max"}).withColumnRenamed("max(src)", "src")
    expected = search.literal_search(clean, query, limit)
    found = kept.search("c", query, limit)
    assert rows_of(found.matches) == rows_of(expected)
    told = search.search_summary(expected).first()
    assert (found.files, found.n_matches) == ((told["files"], told["matches"]) if told else (0, 0))


def test_it_reads_no_further_than_it_must(kept):
    one = kept.search("c", "needle", 300)
    assert one.truncated and one.files_read == stored.PART and one.n_matches >= 300
    all_ = kept.search("c", "nowhere")
    assert not all_.truncated and all_.files_read == 3000
    far = kept.search("c", "needle", 10**6)
    assert not far.truncated and far.files_read == 3000
    assert kept.search("none", "x").n_matches == 0
    assert [r["line"] for r in kept.search("odd/name=1", "needle").matches.collect()] == [1]


def test_one_path_opens_one_part_and_one_row_group(spark, files, kept):
    path = "d3/f1004.txt"
    found = kept.text("c", path)
    assert [r["src"] for r in found.collect()] == [r["src"] for r in files.where(f"path = '{path}'").collect()]
    opened = {f.split("/part=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(opened) == 1 and "PushedFilters: [IsNotNull(path), EqualTo(path" in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    (part,) = opened
    (file,) = glob.glob(f"{kept.folder.removeprefix('file:')}/corpus=c/part={part}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    holds = [g for g in range(meta.num_row_groups) if meta.row_group(g).column(0).statistics.min <= path <= meta.row_group(g).column(0).statistics.max]
    assert len(holds) == 1
    assert kept.text("c", "no such path").count() == 0 and kept.text("none", path).count() == 0
    assert [r["src"] for r in kept.text("odd/name=1", "z.txt").collect()] == [""]
    wanted = spark.createDataFrame([("c", path), ("c", path), ("c", "nope"), ("odd/name=1", "a b.txt"), (None, path)], "corpus string, path string")
    assert sorted(r["path"] for r in kept.texts(wanted).collect()) == ["a b.txt", path]


def test_an_empty_store(files):
    none = stored.store(files.where("false"))
    assert none.search("c", "x").n_matches == 0 and none.text("c", "x").count() == 0
