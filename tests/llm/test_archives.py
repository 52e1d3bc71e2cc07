import base64
import gzip
import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from flowlake.llm import queries, warc  # noqa: E402
from flowlake.sources.durable import fresh_path  # noqa: E402

SCHEMA = "page_id bigint, url string, html string, digest string, size int, kind string, record binary, shard int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", b"", 2, "i") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows):
    """Brute force: (page_id, bytes, digest, type, refers_to) of every row."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    first, out = {}, []
    for key, _, html in order:
        d = digest(html)
        again = d in first
        out.append((key, len((html or "").encode()), d, "revisit" if again else "response", first[d] if again else None))
        first.setdefault(d, key)
    return sorted(out, key=repr)


def got(found):
    return sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()), key=repr)


def files(folder):
    path = folder.removeprefix("file://")
    return {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".gz")}


def pages(n, seed=3):
    rng = random.Random(seed)
    copies = [f"<p>{'copy ' * rng.randint(0, 300)}{i}</p>" for i in range(4)]
    rows = []
    for i in range(n):
        text = copies[0] if i % 3 == 0 else rng.choice(copies) if i % 5 == 0 else f"<p>{rng.random()} {'wörd ' * rng.randint(0, 400)}</p>"
        rows.append((i * 7 % 1009, f"http://a.example/{i % 11}?q=ä b\r\nX: {i}", text))
    return rows


def test_round_trip_matches_brute_force_in_many_files(spark):
    rows = pages(600)
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write(frame(spark, rows).repartition(7), folder, shard_bytes=60_000, file_bytes=9_000).collect()
    assert len({m["shard"] for m in manifest}) > 5 and len(manifest) > len({m["shard"] for m in manifest})
    assert sum(m["records"] for m in manifest) == len(rows)
    assert got(warc.read(spark, folder)) == plain(rows)
    assert not os.path.exists(f"{folder}/_temporary")
    held = files(folder)
    assert sorted(held) == sorted(m["name"] for m in manifest)
    assert all(len(held[m["name"]]) == m["bytes"] and hashlib.sha1(held[m["name"]]).hexdigest() == m["sha1"] for m in manifest)
    # a file is over the limit only when it holds a single record
    assert all(m["bytes"] <= 9_000 or m["records"] == 1 for m in manifest)
    whole = {r["id"]: r for r in warc.read(spark, folder, payloads=True).collect() if r["record_type"] == "response"}
    texts = {r[0]: r[2] for r in rows}
    assert all(r["payload"].decode() == texts[k] for k, r in whole.items())
    # the archives are ordered by id across files
    ids = [int(line.split()[1]) for n in sorted(held) for line in gzip.decompress(held[n]).split(b"\r\n") if line.startswith(b"X-Source-Id:")]
    assert ids == sorted(r[0] for r in rows)


def test_archives_do_not_depend_on_the_layout_of_the_input(spark):
    rows = pages(300)
    folders = []
    for parts in (1, 9):
        random.Random(parts).shuffle(rows)
        folders.append(fresh_path(spark, "warc-test"))
        warc.write(frame(spark, rows).repartition(parts), folders[-1], shard_bytes=50_000, file_bytes=20_000)
    assert files(folders[0]) == files(folders[1]) and len(files(folders[0])) > 3


def test_awkward_pages(spark):
    rows = [
        (5, "http://a/1", None),
        (4, "http://a/2", ""),
        (None, None, "no id"),
        (None, "http://a/3", "no id"),
        (9, None, "seven"),
        (9, None, "seven"),
        (8, "http://a/4 ü\n", "long " * 400_000),
        (7, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    ]
    folder = fresh_path(spark, "warc-test")
    warc.write(frame(spark, rows), folder)
    assert got(warc.read(spark, folder)) == plain(rows)
    with pytest.raises(FileExistsError):
        warc.write(frame(spark, rows), folder)
    least = fresh_path(spark, "warc-test")
    warc.write(frame(spark, rows), least, least=1)
    kinds = {r["id"]: r["record_type"] for r in warc.read(spark, least).where("payload_bytes = 0").collect()}
    assert kinds == {4: "response", 5: "response"}
    nothing = fresh_path(spark, "warc-test")
    assert warc.write(frame(spark, []), nothing).count() == 0
    assert warc.read(spark, nothing).count() == 0


def test_text_ids_and_damaged_files(spark):
    rows = [("b%/ é", "http://a", "one"), ("a", "http://b", "one"), ("c", None, "two")]
    folder = fresh_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), folder)
    assert got(warc.read(spark, folder, "string")) == plain(rows)
    name = next(iter(files(folder)))
    path = f"{folder.removeprefix('file://')}/{name}"
    data = open(path, "rb").read()
    with open(path, "wb") as out:
        out.write(data[:-20])
    with pytest.raises(Exception, match="ends inside a record|not the file|not a whole"):
        warc.read(spark, folder, "string").collect()


def test_registered_archive_query(spark, small):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    found = queries.op11_warc(spark, small)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)
