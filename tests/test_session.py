"""Staged tables go when their scope ends, but those kept."""

from pathlib import Path

from hazardline.session import Staging, drop_staged, shared_dir, stage_table


def test_scope_deletes_what_it_does_not_keep(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    outside = stage_table(spark.range(5), "outside")
    with Staging(spark) as scope:
        inner = stage_table(spark.range(7), "inner")
        kept = scope.keep(stage_table(inner.where("id > 2"), "kept"))
    names = {p.name.split("-")[0] for p in folder.iterdir()}
    assert {"outside", "kept"} <= names and "inner" not in names
    assert kept.count() == 4 and outside.count() == 5
    drop_staged(outside, kept)
    assert not {"outside", "kept"} & {p.name.split("-")[0] for p in folder.iterdir()}


def test_folders_by_value(spark):
    table = stage_table(spark.range(9).selectExpr("id", "cast(id % 3 as int) AS part"), "parts", by="part")
    assert table.where("part = 1").count() == 3 and len(table.where("part = 1").inputFiles()) <= len(table.inputFiles())
    drop_staged(table)
