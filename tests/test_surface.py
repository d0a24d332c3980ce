import json
import threading
import urllib.error
import urllib.request
import zipfile

import pytest

from seqrec import cli, reports, serving
from seqrec.sources import archive


def test_unpack(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ml/ratings.csv", "userId,movieId,rating,timestamp\n")
    assert archive.unpack(tmp_path / "a.zip", tmp_path / "o", "ml").exists()
    assert archive.fetch((tmp_path / "a.zip").as_uri(), tmp_path / "c" / "b.zip").exists()
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "")
    with pytest.raises(ValueError):
        archive.unpack(tmp_path / "bad.zip", tmp_path / "p", "ml")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(10, 0.5)], "k long, recall double")
    text = reports.write(tmp_path / "r.md", "R", {"history": None, "n": 1234}, {"M": df}).read_text()
    assert "- history: unlimited" in text and "- n: 1,234" in text and "| 10 | 0.500000 |" in text


def test_server(spark):
    served = spark.createDataFrame([(123, 1, 5, "T", [0, 1], 0.5), (123, 2, 6, "U", [0, 2], 0.4)], "query_id long, rank long, item_id long, title string, semantic_id array<int>, score double")
    s = serving.server(serving.lookup(served.cache()))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}/recommendations/users"
    got = json.load(urllib.request.urlopen(f"{url}/123?k=1"))
    assert [i["item_id"] for i in got["items"]] == [5] and got["latency_ms"] >= 0
    assert json.load(urllib.request.urlopen(f"{url}/9"))["items"] == []
    for path, code in (("/0", 422), ("/1?k=0", 422), ("/x/y", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(url + path)
        assert e.value.code == code
    s.shutdown()
    with pytest.raises(FileNotFoundError):
        serving.require_paths({"codec": "/nowhere/codec"})


def test_commands(spark, tmp_path):
    lines = [f"{u},{(u * 3 + i * (1 + u % 4)) % 12},{4.5 if (u + i) % 4 else 2.0},{i}" for u in range(1, 13) for i in range(10)]
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n" + "\n".join(lines))
    d = str(tmp_path)
    cli.main(["preprocess", "--ratings", f"{d}/r.csv", "--out", f"{d}/s", "--report", f"{d}/1.md", "--max-history", "0"])
    cli.main(["baseline", "--splits", f"{d}/s", "--report", f"{d}/2.md"])
    cli.main(["semantic-ids", "--splits", f"{d}/s", "--out", f"{d}/c", "--report", f"{d}/3.md", "--depth", "2", "--branching", "4"])
    cli.main(["recommend", "--splits", f"{d}/s", "--codec", f"{d}/c", "--out", f"{d}/g", "--report", f"{d}/4.md", "--k", "3"])
    assert "| 10 | 12 |" in (tmp_path / "2.md").read_text() and "invalid_rate" in (tmp_path / "4.md").read_text()
    assert spark.read.parquet(f"{d}/g").count() > 0
