"""The ingest query numbers its rows in the order of the file."""

from annolens.plans.catalog import QUERIES


def test_ingest_numbers_every_row_of_the_file(spark, tmpdir_path):
    rows = [((i * 37) % 101 + (70_000 if i % 2 else 0), "en" if i % 3 else "de", f"src{i % 4}", f"Text\tof {i}.") for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    docs.repartition(5).write.parquet(f"{tmpdir_path}/documents.parquet")
    got = QUERIES["annotation_tsv_ingest"](spark, tmpdir_path).collect()
    ids = sorted(r[0] for r in rows)
    assert sorted((int(r["source_row"]), r["file_row"]) for r in got) == [(d, n) for n, d in enumerate(ids, 1)]
    assert all(r["in_order"] for r in got)
