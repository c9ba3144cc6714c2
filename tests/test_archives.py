"""Archives as a data source: round trips, spans, pruning and broken files."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import zips


def xml(i, size=20):
    return f'<?xml version="1.0"?>\n<doc id="{i}">' + f"é{i} " * size + "</doc>\n"


def archive(path, entries, method=zipfile.ZIP_DEFLATED):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", method) as z:
        for name, text in entries:
            z.writestr(name, text)


@pytest.mark.parametrize("compression", ["deflate", "none"])
def test_round_trip(spark, tmp_path, compression):
    """Every document comes back as it was, its archive cut into many spans, and without binaryFile in the plan."""
    docs = spark.range(500).select((F.lit(2000) + F.col("id") % 7).alias("year"), F.concat(F.lit('<?xml version="1.0"?><d>'), F.col("id"), F.repeat(F.lit(" ü<?pi?>"), (F.col("id") % 90).cast("int")), F.lit("</d>")).alias("xml"))
    folder = f"{tmp_path}/a"
    zips.write_archives(docs.repartition(3), folder, compression=compression)
    assert not [f for _, _, names in os.walk(folder) for f in names if f[0] in "._"]
    found = zips.read_archives(spark, folder, span=1500)
    assert found.select("year", "xml").exceptAll(docs.select(F.col("year").cast("int"), "xml")).count() == 0 and found.count() == 500
    assert found.groupBy("path", "at").count().where("count > 1").count() == 0
    assert found.where("(year > 2004) <> (dtd_version = 4)").count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "binaryFile" not in plan
    if compression == "none":
        assert found.rdd.getNumPartitions() > 20
    zips.write_archives(docs.limit(5), folder, overwrite=True)
    assert zips.read_archives(spark, folder).count() == 5


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_pieces_of_spans(block):
    """Whatever the spans and blocks, each document comes once, from the span in which it starts."""
    text = (" head " + "".join(xml(i, i) for i in range(9)) + "<?xm <?xml?>").encode()
    places = [0, *[i for i in range(len(text)) if text.startswith(b"<?xml", i)]]
    want = [(a, text[a:b]) for a, b in zip(places, [*places[1:], len(text)], strict=True)]
    for span in (1, 5, 40, 10_000):
        got = []
        for low in range(0, len(text), span):
            stream = io.BytesIO(text[low:])
            got += list(zips.pieces(stream.read, low, min(low + span, len(text)), block))
        assert got == want
    assert list(zips.pieces(io.BytesIO(b" \n ").read, 0, None)) == []


def test_entries_and_broken_archives(spark, tmp_path):
    folder = f"{tmp_path}/b"
    archive(f"{folder}/2004/one.zip", [("readme.txt", "none"), ("a.xml", xml(1) + xml(2)), ("b.XML", xml(3))])
    archive(f"{folder}/2005/two.zip", [("a.xml", xml(4))], zipfile.ZIP_STORED)
    archive(f"{folder}/2005/none.zip", [("a.txt", xml(5))])
    archive(f"{folder}/other/three.zip", [("a.xml", xml(6))])
    archive(f"{folder}/2005/four.dat", [("a.xml", xml(7))])
    archive(f"{folder}/2005/_hidden.zip", [("a.xml", xml(8))])
    with open(f"{folder}/2005/broken.zip", "wb") as f:
        f.write(b"PK\x03\x04 not an archive")
    with open(f"{folder}/2005/empty.zip", "wb"):
        pass
    ids = lambda df: sorted(int(x) for x in df.select(F.regexp_extract("xml", 'id="([0-9]+)"', 1)).toPandas().iloc[:, 0])
    assert ids(zips.read_archives(spark, folder)) == [1, 2, 4]
    assert ids(zips.read_archives(spark, folder, entries="all", span=90)) == [1, 2, 3, 4]
    assert ids(zips.read_archives(spark, f"{tmp_path}/absent")) == []
    rows = {r["dtd_version"] for r in zips.read_archives(spark, folder).where("year = 2004").collect()}
    assert rows == {2}


def test_year_filter_opens_its_archives_only(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    folder = f"{tmp_path}/c"
    for year in range(2001, 2006):
        archive(f"{folder}/{year}/x.zip", [("a.xml", xml(year))])
    reader = zips.ArchiveReader({"path": folder})
    rest = list(reader.pushFilters([GreaterThan(("year",), 2002), In(("year",), (2001, 2003, 2005)), StringContains(("xml",), "x")]))
    assert [type(f) for f in rest] == [StringContains]
    assert [p.year for p in reader.partitions()] == [2003, 2005]
    assert zips.meets(1, EqualTo(("year",), 1))
    with open(f"{folder}/2001/x.zip", "r+b") as f:
        f.truncate(10)  # nobody looks
    found = zips.read_archives(spark, folder).where("year >= 2003 and year < 2005")
    assert sorted(r["year"] for r in found.collect()) == [2003, 2004] and found.rdd.getNumPartitions() == 2


def test_failed_job_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/d"
    writer = zips.ArchiveWriter({"path": folder}, False)
    import pyarrow as pa

    message = writer.write(iter([pa.RecordBatch.from_pydict({"year": pa.array([2001, 2001, None, 2002], pa.int32()), "xml": [xml(1), None, xml(2), xml(3)]})]))
    assert len(message.files) == 2 and zips.read_archives(spark, folder).count() == 0
    writer.abort([message, None])
    assert [f for _, _, names in os.walk(folder) for f in names] == []
