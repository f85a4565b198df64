from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pointerloom.operators.records import hvt_windows
from pointerloom.plans import queries
from pointerloom.plans.pipeline import explore_root, read_samples, read_sequences
from pointerloom.schema import DATASET_DIRS
from pointerloom.sources import catalogue as cat
from pointerloom.sources import listing, texts
from pointerloom.sources.delimited import read_ck, read_hmi, read_hvt
from pointerloom.sources.documents import read_documents
from pointerloom.sources.sink import write_files, write_samples, write_sequences
from pointerloom.sources.viewport import parse_sidecars, read_viewports


def put(root: Path, name: str, text: str) -> Path:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0]


S1 = "cursor timestamp xpos ypos event\n0 350 5 2 click\n0 90 5 2 scroll\n\n0 100 1 2 mousemove\n"


def test_ck_files(spark, tmp_path):
    put(tmp_path, "u1/s1.csv", S1)
    put(tmp_path, "u1/deep/s2.csv", 'event note timestamp ypos xpos\r\nscroll "a ""b"" c" 1 2 \r\nblur x bad 4 5\r\n')
    rows = read_ck(spark, str(tmp_path)).collect()
    got = {(stem(r.session_id), r.tie): (r.timestamp, r.event, r.xpos, r.ypos) for r in rows}
    assert got == {
        ("s1", 0): (350.0, "click", 5.0, 2.0), ("s1", 1): (90.0, "scroll", 5.0, 2.0),
        ("s1", 2): (100.0, "mousemove", 1.0, 2.0),
        ("s2", 0): (1.0, "scroll", None, 2.0), ("s2", 1): (None, "blur", 5.0, 4.0),
    }


def test_ck_file_without_a_column_fails(spark, tmp_path):
    put(tmp_path, "s.csv", "timestamp event xpos\n1 click 2\n")
    with pytest.raises(Exception, match="missing column"):
        read_ck(spark, str(tmp_path)).collect()


def test_rows_are_numbered_across_splits(spark, tmp_path):
    text = "velocity;distance\n" + "".join(f"{i};{i % 7}\n" for i in range(20_000))
    put(tmp_path, "big.csv", text)
    put(tmp_path, "small.csv", "distance\n3\n\n4\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        splits = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct()
        assert splits.count() > 10
        records = read_hvt(spark, str(tmp_path), max_rows=None)
        big = records.where(F.col("session_id").endswith("big.csv"))
        assert big.count() == 20_000 and big.where("row_idx != velocity").count() == 0
        small = {r.row_idx: (r.velocity, r.distance, r.has_velocity) for r in
                 records.where(F.col("session_id").endswith("small.csv")).collect()}
        assert small == {0: (None, 3.0, False), 1: (None, 4.0, False)}
        assert read_hvt(spark, str(tmp_path), max_rows=100).count() == 102
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_hvt_files(spark, tmp_path):
    put(tmp_path, "h1.csv", "velocity;distance\n" + "1;2\n" * 11)
    put(tmp_path, "h2.csv", "velocity;distance\n" + "1;2\n" * 10)
    put(tmp_path, "h3.csv", "x;distance\n" + "1;2\n" * 11)
    put(tmp_path, "h4.csv", "")
    got = {stem(r.session_id): (r.meanVelocity, r.totalTrajectoryLength)
           for r in hvt_windows(read_hvt(spark, str(tmp_path))).collect()}
    assert got == {"h1": (0.2, 0.01), "h3": (0.0, 0.01)}


def test_hmi_delimiters(spark, tmp_path):
    files = {
        "semi": "epoch;x\n1;a\n2;b\n3;c\n", "comma": "initepoch,x\n1,a\n2,b\n",
        "semitime": "timestamp;x\n1;a\n2;b\n", "commatime": "x,timestamp\na,7\nb,8\n",
        "single": "timestamp\n5\n6\n", "none": "a,b\n1,2\n", "both": "initepoch;epoch\n1;10\n2;20\n",
    }
    for name, text in files.items():
        put(tmp_path, f"{name}.csv", text)
    got = {}
    for r in read_hmi(spark, str(tmp_path)).orderBy("row_idx").collect():
        got.setdefault(stem(r.session_id), []).append(r.epoch)
    assert got == {"semi": ["1", "2", "3"], "comma": ["1", "2"], "commatime": ["7", "8"],
                   "single": ["5", "6"], "both": ["10", "20"]}
    assert read_hmi(spark, str(tmp_path), max_records=1).count() == 5


@pytest.mark.parametrize("xml,want", [
    ("<d><window>1366x768</window><document>1349x2400</document></d>", (1366, 768, 1349, 2400)),
    ("<d><window> 10x20 </window><document>full</document></d>", (10, 20, 1366, 2000)),
    ("<d><window>axb</window><document>1349x2400</document></d>", (1366, 768, 1366, 2000)),
    ("<d><window>full</window><document>9x8</document></d>", (1366, 768, 9, 8)),
    ("<d><window>800x600</window><document>x9</document></d>", (800, 600, 1366, 2000)),
    ("<d><window>1366dx7</window></d>", (1366, 768, 1366, 2000)),
    ("<d><window>5x6x7</window></d>", (5, 6, 1366, 2000)),
    ("<d><deep><window>5x6</window></deep></d>", (1366, 768, 1366, 2000)),
    ("<d><window>5x6", (1366, 768, 1366, 2000)),
    ("", (1366, 768, 1366, 2000)),
])
def test_sidecars(spark, xml, want):
    df = spark.createDataFrame([("s", xml)], "session_id string, value string")
    assert tuple(parse_sidecars(df).first())[1:] == want


def test_sidecars_by_path(spark, tmp_path):
    put(tmp_path, "a.csv.d/s1.csv", S1)
    put(tmp_path, "a.xml.d/s1.xml", "<d>\n<window>640x480</window>\n</d>\n")
    put(tmp_path, "b/s2.csv", S1)
    sessions = read_ck(spark, str(tmp_path))
    got = read_viewports(spark, str(tmp_path), sessions).collect()
    assert [(stem(r.session_id), r.vp_w) for r in got] == [("s1", 640.0)]


@pytest.fixture
def data_root(tmp_path):
    root = tmp_path / "store" / "raw"
    events = "".join(f"0 {t} {t % 50} {t % 30} mousemove\n" for t in range(0, 4000, 40))
    put(root, f"{DATASET_DIRS['CK']}/u1/s1.csv", "cursor timestamp xpos ypos event\n" + events)
    put(root, f"{DATASET_DIRS['CK']}/u1/s1.xml", "<d><window>640x480</window></d>")
    put(root, f"{DATASET_DIRS['CK']}/u2/s2.csv", S1)
    put(root, f"{DATASET_DIRS['HVT']}/h1.csv", "velocity;distance\n" + "1;2\n" * 21)
    put(root, f"nested/{DATASET_DIRS['HMI']}/other.csv", "epoch;x\n" + "1;a\n" * 9)
    put(root, f"nested/{DATASET_DIRS['HMI']}/sequences.csv", "epoch;x\n" + "1;a\n" * 4)
    put(root, f"{DATASET_DIRS['AP']}/p.json", '[{"stay_seconds":1},{"stay_seconds":2,"previous_url":""}]')
    return root


def test_lookup(spark, data_root):
    store = str(data_root.parent)
    assert cat.resolve_dataset_root(spark, store) == str(data_root)
    assert cat.is_dataset_present(spark, store)
    assert not cat.is_dataset_present(spark, str(data_root / "nested" / "nowhere"))
    assert cat.resolve_dataset_root(spark, "/tmp/no-such-folder") == "/tmp/no-such-folder"
    assert cat.find_dataset_dir(spark, store, DATASET_DIRS["CK"]).endswith(f"raw/{DATASET_DIRS['CK']}")
    assert cat.find_dataset_dir(spark, str(data_root), DATASET_DIRS["HMI"]).endswith(
        f"nested/{DATASET_DIRS['HMI']}"
    )
    assert cat.find_dataset_dir(spark, str(data_root), "absent") == f"{data_root}/absent"


def test_lookup_in_a_hidden_folder_and_beside(spark, tmp_path):
    put(tmp_path, f"one/.data/raw/{DATASET_DIRS['AP']}/p.json", "[]")
    assert cat.is_dataset_present(spark, str(tmp_path / "one"))
    assert cat.resolve_dataset_root(spark, str(tmp_path / "one")) == f"{tmp_path}/one/.data/raw"
    assert cat.find_dataset_dir(spark, f"{tmp_path}/one", DATASET_DIRS["AP"]).endswith(f"one/.data/raw/{DATASET_DIRS['AP']}")
    put(tmp_path, f"two/{DATASET_DIRS['HVT']}/h.csv", "velocity\n1\n")
    (tmp_path / "two" / "sub").mkdir()
    assert cat.find_dataset_dir(spark, f"{tmp_path}/two/sub", DATASET_DIRS["HVT"]) == f"{tmp_path}/two/{DATASET_DIRS['HVT']}"
    assert not cat.is_dataset_present(spark, f"{tmp_path}/two/sub")


def test_catalogue(spark, data_root):
    files = cat.source_catalogue(spark, str(data_root.parent))
    got = {r.source: (r.n_files, r.present) for r in cat.source_presence(files).collect()}
    assert got == {"CK": (2, True), "HVT": (1, True), "HMI": (2, True), "AP": (1, True)}
    names = lambda df: [stem(r.path) for r in df.orderBy("path").collect()]
    assert names(cat.select_files(files, "HMI")) == ["other", "sequences"]
    assert names(cat.select_files(files, "HMI", 1)) == ["other"]
    assert names(cat.select_files(files, "HMI", 0)) == ["other", "sequences"]
    assert names(cat.select_files(files, "HMI", preferred=True)) == ["sequences"]
    assert names(cat.select_files(files, "AP", preferred=True)) == ["p"]
    nothing = cat.source_presence(cat.source_catalogue(spark, "/tmp/no-such-folder"))
    assert {(r.n_files, r.present) for r in nothing.collect()} == {(0, False)}


def test_whole_pipeline(spark, data_root, tmp_path):
    samples = read_samples(spark, str(data_root.parent))
    counts = {r.source: r["count"] for r in samples.groupBy("source").count().collect()}
    assert counts == {"CK": 14, "HVT": 3, "HMI": 8 + 3, "AP": 2}
    write_samples(samples, str(tmp_path / "samples"))
    back = spark.read.parquet(str(tmp_path / "samples"))
    assert back.count() == 30 and dict(back.dtypes)["meanVelocity"] == "float"
    runs = read_sequences(spark, str(data_root.parent))
    assert runs.count() == 23
    write_sequences(runs, str(tmp_path / "runs"))
    assert dict(spark.read.parquet(str(tmp_path / "runs")).dtypes)["features"] == "array<array<float>>"
    assert read_sequences(spark, str(data_root.parent), max_sequences=5).count() == 5
    assert read_sequences(spark, str(data_root.parent), scope="session").count() == 14 - 7 + 8 - 7
    assert read_samples(spark, str(data_root.parent), max_files=1).count() == 14 + 3 + 8 + 2
    assert read_samples(spark, str(data_root.parent), preferred=True).count() == 14 + 3 + 3 + 2


def test_first_look(spark, data_root):
    tables = explore_root(spark, str(data_root.parent))
    assert {r.source: r.n_samples for r in tables["counts"].collect()} == {"CK": 14, "HVT": 3, "HMI": 3, "AP": 2}
    assert tables["correlation"].count() == 81 and tables["range"].count() == 36


def test_empty_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_samples(spark, str(tmp_path))


def test_documents(spark, tmp_path):
    put(tmp_path, "a/x.json", "[\n1]")
    put(tmp_path, "a/x.txt", "no")
    assert [(stem(r.session_id), r.value) for r in read_documents(spark, str(tmp_path)).collect()] == [("x", "[\n1]")]


def test_files_that_spark_leaves_out_are_named(spark, tmp_path):
    put(tmp_path, "ck/b.csv", S1)
    put(tmp_path, "ck/_a.csv", S1)
    put(tmp_path, "ck/deep/_part/c.csv", S1)
    put(tmp_path, "ck/_k=1.csv", S1)
    put(tmp_path, "ck/.hidden/_h.csv", S1)
    put(tmp_path, "ck/_SUCCESS", "")
    for read in (read_ck, read_hvt, read_hmi):
        with pytest.raises(ValueError) as error:
            read(spark, str(tmp_path / "ck"))
        names = str(error.value)
        assert "/_a.csv" in names and "/_part/c.csv" in names
        assert not any(n in names for n in ("b.csv", "_k=1", "_h.csv", "_SUCCESS"))
    with pytest.raises(ValueError, match="/_a.csv"):
        read_ck(spark, [f"{tmp_path}/ck/b.csv", f"{tmp_path}/ck/_a.csv"])
    assert read_ck(spark, f"{tmp_path}/ck/deep/_part").count() == 3
    put(tmp_path, "ap/_p.json", "[]")
    with pytest.raises(ValueError, match="/_p.json"):
        read_documents(spark, str(tmp_path / "ap"))


def test_sidecars_that_spark_leaves_out_are_named(spark, tmp_path):
    put(tmp_path, "s1.csv", S1)
    put(tmp_path, "s1.xml", "<d><window>640x480</window></d>")
    put(tmp_path, "_s2.xml", "<d><window>640x480</window></d>")
    one = read_ck(spark, str(tmp_path))
    assert read_viewports(spark, str(tmp_path), one).count() == 1
    two = one.select(F.replace("session_id", F.lit("s1.csv"), F.lit("_s2.csv")).alias("session_id"))
    with pytest.raises(ValueError, match="/_s2.xml"):
        read_viewports(spark, str(tmp_path), two)


@pytest.mark.parametrize("place", ["{}/_a.csv", "raw/{}/_a.csv", "raw/x/y/{}/_a.csv"])
def test_roots_with_files_that_spark_leaves_out(spark, tmp_path, place):
    put(tmp_path, place.format(DATASET_DIRS["CK"]), S1)
    put(tmp_path, f"raw/{DATASET_DIRS['HVT']}/h1.csv", "velocity;distance\n" + "1;2\n" * 21)
    for read in (read_samples, explore_root):
        with pytest.raises(ValueError, match="a.csv"):
            read(spark, str(tmp_path))


def test_family_below_a_folder_that_spark_leaves_out(spark, tmp_path):
    put(tmp_path, f"raw/_old/{DATASET_DIRS['HVT']}/h1.csv", "velocity;distance\n" + "1;2\n" * 21)
    put(tmp_path, f"raw/{DATASET_DIRS['AP']}/p.json", "[]")
    assert read_samples(spark, str(tmp_path)).where("source = 'HVT'").count() == 3


def test_many_files_in_few_folders(spark, tmp_path):
    """A file per part, not a folder each: listing and committing folders took most of the time."""
    rows = [(k, float(t), "a;b" if t else None) for k in range(60) for t in (2, 0, 1)]
    df = spark.createDataFrame(rows, "part long, velocity double, distance string")
    root = queries._in_files(df, str(tmp_path / "hvt"), ";", ["velocity"])
    files = sorted(tmp_path.rglob("*.csv"))
    assert len(files) == 60 and len({f.parent for f in files}) <= spark.sparkContext.defaultParallelism
    assert not [f for f in tmp_path.rglob("*") if f.is_file() and f not in files]
    assert next(f for f in files if f.name == "part=7.csv").read_text() == 'velocity;distance\n0.0;\n1.0;"a;b"\n2.0;"a;b"\n'
    got = read_hvt(spark, root).select(queries._file_number("session_id").alias("part"), "row_idx", "velocity")
    assert sorted(map(tuple, got.collect())) == [(k, t, float(t)) for k in range(60) for t in range(3)]
    assert write_files(df.selectExpr("part", "distance as line").limit(0), f"{tmp_path}/none") == 0


def test_lists_of_files_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """Spark's readers hold every file in the driver, which ran out of memory; here tasks list and open them."""
    monkeypatch.setattr(listing, "NEAR", 3)
    root = tmp_path / "store" / "raw"
    for k in range(40):
        put(root, f"{DATASET_DIRS['CK']}/d{k % 5}/e/s{k}.csv", "cursor timestamp xpos ypos event\n0 1 2 3 click\n0 9999 2 3 click\n")
        put(root, f"deep/{DATASET_DIRS['HVT']}/d{k % 5}/h{k}.csv", "velocity;distance\n" + "1;2\n" * 11)
        put(root, f"{DATASET_DIRS['AP']}/d{k % 5}/p{k}.json", '[{"stay_seconds":1}]')
    put(root, f"{DATASET_DIRS['CK']}/d0/e/s0.xml", "<d><window>640x480</window></d>")
    put(root, f"{DATASET_DIRS['CK']}/.d/s.csv", S1)
    store = str(root.parent)
    files, samples = cat.source_catalogue(spark, store), read_samples(spark, store)
    ck, ap = f"{root}/{DATASET_DIRS['CK']}", f"{root}/{DATASET_DIRS['AP']}"
    sessions = files.selectExpr("file_path session_id")
    for df in (files, samples, read_ck(spark, ck), read_documents(spark, ap), read_viewports(spark, ck, sessions)):
        assert not [f for f in df.inputFiles() if f.endswith((".csv", ".json", ".xml"))]
    assert {r.source: r["count"] for r in files.groupBy("source").count().collect()} == {"CK": 40, "HVT": 40, "AP": 40}
    assert read_ck(spark, ck).select("session_id").distinct().count() == 40
    assert read_viewports(spark, ck, sessions).count() == 1
    assert {r.source: r["count"] for r in samples.groupBy("source").count().collect()} == {"HVT": 40, "AP": 40}


def test_what_is_read_from_files_is_not_taken_for_small(spark, tmp_path, monkeypatch):
    """By the size of a list of files Spark would broadcast their lines, through the driver."""
    monkeypatch.setattr(texts, "SMALL_BYTES", 0)
    put(tmp_path, "a/s1.csv", S1)
    put(tmp_path, "b/p.json", "[]")
    for df in (read_ck(spark, f"{tmp_path}/a"), read_documents(spark, f"{tmp_path}/b")):
        assert "BroadcastHashJoin" not in df.join(df, "session_id")._jdf.queryExecution().sparkPlan().toString()


def test_names_are_those_of_sparks_readers(spark, tmp_path):
    names = ["plain-1_~.csv", "a b#é.csv", "s%20[2]{x}.csv", "q?|^`\\.csv", "(!$&'*+,;=:@).csv", "  x.csv"]
    for k, name in enumerate(names):
        put(tmp_path, f"d {k}/{name}", S1)
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select(
        "path", "_metadata.file_path", "length", F.col("modificationTime").alias("modified")
    ).collect()
    assert len(want) == len(names)
    assert sorted(cat.list_files(spark, [str(tmp_path)]).collect()) == sorted(want)
    assert {r.session_id for r in read_ck(spark, str(tmp_path)).collect()} == {r.file_path for r in want}
    assert read_ck(spark, [r.path for r in want]).count() == 3 * len(names)


TEXTS = [b"", b"\n", b"one", b"h x\r\n1 2\r\n\r\n3 4", b"\xef\xbb\xbfh\n1\n\n\n22\n", b"h\r1\r22\r333\r", b"\n\nh\n" + b"long" * 9 + b"\n\xff\n1"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("read_bytes", [1, 2, 7, 1000])
def test_each_line_is_in_one_piece(monkeypatch, tmp_path, text, read_bytes):
    monkeypatch.setattr(texts, "READ_BYTES", read_bytes)
    (tmp_path / "t").write_bytes(text)
    want = [x for x in text.removeprefix(b"\xef\xbb\xbf").replace(b"\r", b"\n").split(b"\n") if x]
    for size in range(1, len(text) + 2):
        pieces = [(a, min(a + size, len(text))) for a in range(0, len(text), size)]
        got = [line for a, b in pieces for lines in texts._lines(str(tmp_path / "t"), a, b) for line in lines]
        assert got == want, size


def test_lines_are_those_of_sparks_reader(spark, tmp_path):
    for k, text in enumerate(TEXTS):
        (tmp_path / f"t{k}.csv").write_bytes(text)
    lines = spark.read.text(str(tmp_path)).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("f"), F.hex("value").alias("x"))
    want = {(r.f, r.x) for r in lines.where("x != ''").collect()}
    blocks = texts.line_blocks(listing.walk(spark, listing.full_names(spark, str(tmp_path))))
    rows = blocks.select(F.element_at(F.split("session_id", "/"), -1).alias("f"), F.hex("header").alias("h"), F.explode("lines").alias("x")).collect()
    headers = {(r.f, r.h) for r in blocks.select(F.element_at(F.split("session_id", "/"), -1).alias("f"), F.hex("header").alias("h")).collect()}
    assert {(r.f, r.x.hex().upper()) for r in rows} | headers == {w for w in want if w[0] in {h[0] for h in headers}}
    assert {h[0] for h in headers} == {"t3.csv", "t4.csv", "t5.csv", "t6.csv"}


def test_files_in_a_store_that_only_spark_reads(spark, data_root):
    """The same samples as by tasks, with Spark's own readers."""
    mount = f"fs.viewfs.mounttable.logs{data_root.parent.parent.name.replace('_', '')}.link./in"
    spark.sparkContext._jsc.hadoopConfiguration().set(mount, f"file://{data_root.parent}")
    root = f"viewfs://{mount.split('.')[3]}/in"
    plain = lambda df: sorted(
        map(str, df.withColumn("session_id", F.element_at(F.split("session_id", "/"), -1)).collect())
    )
    assert plain(read_samples(spark, root)) == plain(read_samples(spark, str(data_root.parent)))
    put(data_root, f"{DATASET_DIRS['CK']}/_s3.csv", S1)
    with pytest.raises(ValueError, match="/_s3.csv"):
        read_samples(spark, root)
