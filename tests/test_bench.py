import json

import pytest

from tessera.bench import runner
from tessera.bench.checksum import checksum


def test_checksum(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, None), (2, -0.0, "x")], "a int, b double, c string")
    b = spark.createDataFrame([(2, 0.0, "x"), (1, 0.3, None)], "a int, b double, c string")
    assert checksum(a) == checksum(b) and checksum(a)[0] == 2
    assert checksum(a) != checksum(b.limit(1).union(b.limit(1)))
    assert checksum(a.limit(0)) == (0, 0)


def test_fill():
    assert runner.fill("SELECT * FROM [a] x, [b]", ["a", "b"]) == "SELECT * FROM a x, b"
    with pytest.raises(KeyError):
        runner.fill("[c]", ["a"])


def test_modes(spark, sf_dir, tmp_path, capsys):
    base = {"tables": {"nation": f"{sf_dir}/nation.parquet"}, "queries": {"q": "SELECT count(*) AS n FROM [nation]"}}
    for mode in ({"repetitions": 2, "checksums": {"q": [1, 0]}}, {"mode": "throughput", "rates": [4], "seconds": 0.5}, {"mode": "trace", "trace": [[0, "q"], [0.1, "q"]]}):
        p = tmp_path / "c.json"
        p.write_text(json.dumps(base | mode))
        assert runner.main([str(p)]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("query\t") and out[1].endswith("False") and out[2].startswith("4\t") and len(out) == 5
