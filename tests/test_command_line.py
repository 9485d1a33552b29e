"""The command line over the session catalog."""

import pytest

from lakejobs.__main__ import main


def test_seed_check_and_query(spark, folder, capsys):
    spark.sql("DROP TABLE IF EXISTS cli.airlines")
    main(["seed", "cli"])
    main(["check", "cli", "airlines", "--catalog", "spark_catalog", "--order-by", "code"])
    shown = capsys.readouterr().out
    assert "120000" in shown and "American Airlines" in shown
    main(
        [
            "query",
            "cli.airlines",
            "every=SELECT code, year_id FROM airlines",
            "west=SELECT description, origin FROM airlines WHERE dest = 'SEA'",
            "newest=SELECT origin, max(year_id) AS last FROM airlines GROUP BY origin",
            "broken=SELECT nothing FROM airlines",
            "--out",
            folder,
        ]
    )
    shown = capsys.readouterr().out
    assert "EqualTo(dest,SEA)" in shown and "nothing" in shown
    found = {n: spark.read.json(f"{folder}/{n}").count() for n in ("every", "west", "newest")}
    assert found == {"every": 3, "west": 1, "newest": 3}


def test_script_file(spark, folder, capsys):
    with open(f"{folder}/s.sql", "w") as f:
        f.write("-- demo\nCREATE DATABASE IF NOT EXISTS cli2;\nDROP TABLE IF EXISTS cli2.t;\n")
        f.write("CREATE TABLE cli2.t USING parquet AS\nSELECT 1 AS a")
    main(["script", f"{folder}/s.sql", "--count", "cli2.t"])
    assert ">>> CREATE TABLE cli2.t USING parquet AS\n" in capsys.readouterr().out


def test_command_is_needed():
    with pytest.raises(SystemExit):
        main([])
