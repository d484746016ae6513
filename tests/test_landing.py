"""Feed order over files and splits, and records that cannot be read."""

import pytest

from tidewatch.sources import landing, readers


@pytest.fixture()
def small_splits(spark):
    """Files are cut into many splits, which Spark deals to tasks by size."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "700")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def _folder(tmp_path, files):
    folder = tmp_path / "feed"
    folder.mkdir()
    for name, lines in files.items():
        (folder / name).write_text("k,v\n" + "".join(f"{x}\n" for x in lines))
    return str(folder)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_numbers_follow_files_and_lines(spark, tmp_path, small_splits, monkeypatch, broadcast):
    monkeypatch.setattr(landing, "BROADCAST_SPLITS", broadcast)
    sizes = {"c.csv": 5, "a.csv": 3, "b.csv": 900, "d.csv": 250, "empty.csv": 0}
    folder = _folder(tmp_path, {n: [f"{n}-{i},{'x' * (i % 40)}" for i in range(k)] for n, k in sizes.items()})
    landed = readers.land_csv(spark, folder, multi_line=False)
    assert landed.table.select("source_file").inputFiles()  # it is a written table
    rows = sorted(map(tuple, landed.rows.select("row_index", "source_file", "file_row", "k").collect()))
    want = [(n, i + 1, f"{n}-{i}") for n in sorted(sizes) for i in range(sizes[n])]
    assert rows == [(k, *w) for k, w in enumerate(want)]
    files = {r.source_file: (r.records, r.malformed) for r in landed.files.collect()}
    assert files == {n: (k, 0) for n, k in sizes.items()}  # a header alone is a file of 0 records
    assert landed.counts() == (sum(sizes.values()), 0)


def test_first_row_wins_across_files(spark, tmp_path, small_splits):
    big = [f"k{i},from-b" for i in range(500)]
    folder = _folder(tmp_path, {"a.csv": ["k400,from-a"], "b.csv": big, "c.csv": ["k1,from-c", "k9999,from-c"]})
    from tidewatch.operators.dedup import dedup

    feed = readers.read_csv_feed(spark, folder, multi_line=False)
    first = {r.k: r.v for r in dedup(feed, ["k"]).collect()}
    last = {r.k: r.v for r in dedup(feed, ["k"], "last").collect()}
    assert (first["k400"], first["k1"], first["k9999"]) == ("from-a", "from-b", "from-c")
    assert (last["k400"], last["k1"], last["k2"]) == ("from-b", "from-c", "from-b")


@pytest.mark.parametrize("multi_line", [False, True])
def test_ragged_records_are_kept_apart(spark, tmp_path, multi_line):
    lines = ["1,a", "2,b,c", "3", '4,"x, ""y"""', '5,"a,b",c', "", "6,f"]
    folder = _folder(tmp_path, {"a.csv": lines})
    landed = readers.land_csv(spark, folder, keep_blank=True, multi_line=multi_line)
    rows = {r.file_row: (r.k, r.v) for r in landed.rows.collect()}
    assert rows == {1: ("1", "a"), 3: ("3", ""), 4: ("4", 'x, "y"'), 6: ("6", "f")}
    bad = {r.file_row: r.raw_data.strip() for r in landed.malformed.collect()}
    assert bad == {2: "2,b,c", 5: '5,"a,b",c'}
    assert landed.counts() == (6, 2)


def test_a_quoted_line_break_is_never_lost(spark, tmp_path):
    folder = _folder(tmp_path, {"a.csv": ["1,a", '2,"two', 'lines"', "3,c"]})
    whole = readers.land_csv(spark, folder, multi_line=True)
    assert [(r.k, r.v) for r in whole.rows.orderBy("row_index").collect()] == [
        ("1", "a"), ("2", "two\nlines"), ("3", "c")]
    cut = readers.land_csv(spark, folder, multi_line=False)
    assert [r.k for r in cut.rows.orderBy("row_index").collect()] == ["1", "3"]
    assert [r.raw_data for r in cut.malformed.orderBy("row_index").collect()] == ['2,"two', 'lines"']


def test_broken_documents_keep_their_text(spark, tmp_path):
    lines = ['{"signals":[{"title":"a"},{"title":"b"}]}', '{"title": "open', '{"data":[]}',
             '{"title":"c","date":"2024-01-01"}']
    (tmp_path / "f.json").write_text("\n".join(lines) + "\n")
    landed = readers.land_json(spark, str(tmp_path / "f.json"), multi_line=False)
    rows = [(r.file_row, r.title, r.signal_date) for r in landed.rows.orderBy("row_index").collect()]
    assert rows == [(1, "a", None), (2, "b", None), (4, "c", "2024-01-01")]
    assert [(r.file_row, r.raw_data) for r in landed.malformed.collect()] == [(3, lines[1])]
    (tmp_path / "g.json").write_text("[{]")
    assert readers.land_json(spark, str(tmp_path / "g.json")).malformed.first().raw_data == "[{]"


@pytest.mark.parametrize("multi_line", [False, True])
def test_quotes_inside_bare_fields_are_text(spark, tmp_path, multi_line):
    lines = ['1,5" pipe', '2,"a ""b"""', '3,"""x"', "k,v", '4,6" and 7"']
    folder = _folder(tmp_path, {"a.csv": lines, "b.csv": ["k,v"]})
    rows = readers.land_csv(spark, folder, multi_line=multi_line).rows.orderBy("row_index").collect()
    assert [(r.k, r.v) for r in rows] == [
        ("1", '5" pipe'), ("2", 'a "b"'), ("3", '"x'), ("k", "v"), ("4", '6" and 7"'), ("k", "v")]


def test_headers_that_differ_are_refused(spark, tmp_path):
    folder = _folder(tmp_path, {"a.csv": ["1,2"]})
    (tmp_path / "feed" / "b.csv").write_text("v,k\n1,2\n")
    with pytest.raises(ValueError, match="headers differ"):
        readers.land_csv(spark, folder, multi_line=False)
