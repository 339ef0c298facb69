"""Places of lines in files that are read in many blocks."""

from panelcast.sources import exports


def test_lines_of_many_blocks_keep_their_order(spark, tmp_path):
    files = {"long.csv": [f"line {i}" + "x" * (i % 90) for i in range(5000)], "short.csv": ["﻿Date,Value\r", "", "2024-01-01,1"], "empty.csv": []}
    for name, lines in files.items():
        (tmp_path / name).write_bytes("".join(f"{line}\n" for line in lines).encode())
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = exports.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    for name, lines in files.items():
        own = sorted((r["pos"], r["line"]) for r in got if r["file"].endswith(name))
        assert own == [(i, line.removeprefix("﻿").removesuffix("\r")) for i, line in enumerate(lines)]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 1 and len({r["file"] for r in got}) == 2
