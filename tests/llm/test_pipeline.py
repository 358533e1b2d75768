import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from airlattice.llm.decontam import find_leaks
from airlattice.llm.common import Scratch
from tests.llm.test_neardup import brute
from tests.llm.util import SF, awkward, docs, labels

NAMES = [f"op{i}_" for i in range(1, 14)]


def test_registered():
    names = E.queries()
    assert all(sum(n.startswith(p) for n in names) == 1 for p in NAMES) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]


def test_mixing_oracle(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.sql(E.oracle_sql()["op4_mixing"]).df().sort_values("doc_id", ignore_index=True)
        got = E.queries()["op4_mixing"](spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
        assert got[want.columns.tolist()].astype(want.dtypes.to_dict()).equals(want)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder with awkward documents among the given ones."""
    to = tmp_path_factory.mktemp("sf")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs(spark, [(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in awkward()], clash=False)
    given.unionByName(more).write.parquet(f"{to}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", to)
    return str(to)


def test_stages_take_effect(spark, folder):
    scratch = Scratch(spark)
    stages = dict(corpus_pipeline.STAGES)
    before = spark.read.parquet(f"{folder}/documents.parquet")
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = scratch.save(stages["quality"](spark, before, folder), "good")
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    right = [(i in kept) == (q == 1) for i, q in y.items()]
    assert good.columns == before.columns and sum(right) / len(right) >= 0.97

    single = scratch.save(stages["near_dedup"](spark, good, folder), "single")
    rows = [tuple(r) for r in good.collect()]
    want = {i for i, (_, _, keep) in brute(rows, 5).items() if keep}
    assert sorted(r["doc_id"] for r in single.where("doc_id IS NOT NULL").collect()) == sorted(want)

    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    clean = scratch.save(stages["decontamination"](spark, single, folder), "clean")
    leaks = {r["doc_id"] for r in find_leaks(single, items).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect()} - leaks

    masked = scratch.save(stages["secrets"](spark, clean, folder), "masked")
    assert masked.schema.names == before.columns and masked.count() == clean.count()
    assert masked.where("text RLIKE '(?i)token = \"[0-9a-f]{40}\"'").count() == 0

    mixed = stages["mixing"](spark, masked, folder).toPandas()
    assert set(mixed.doc_id.dropna()) <= {r["doc_id"] for r in masked.collect()} and (mixed.taken > 0).all()
    assert (mixed.taken <= 2 * mixed["size"]).all()


def test_rows_without_or_with_repeated_ids(spark):
    """Equal texts go and secrets are masked whatever the ids; texts that share an id are documents of their own."""
    stages = dict(corpus_pipeline.STAGES)
    text = " ".join(f"word{k}" for k in range(40))
    secret = "password = 'kj3Hs92LmQx7Zt4P'"
    rows = [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (7, text, "en", "a", 1), (7, f"another one {secret} of that id", "en", "a", 1),
            (None, f"nothing else {secret} to see", "en", "a", 1), (3, text, "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_secrets", F.lit(1)).withColumn("row_number", F.lit(2))
    single = stages["near_dedup"](spark, df, SF)
    assert single.columns == df.columns
    assert sorted(((r["doc_id"], r["text"][:7]) for r in single.collect()), key=str) == [(3, "word0 w"), (7, "another"), (None, "nothing")]
    masked = stages["secrets"](spark, df, SF)
    assert masked.columns == df.columns and masked.count() == 6
    assert masked.where("text LIKE '%kj3Hs92LmQx7Zt4P%'").count() == 0 and masked.where("text LIKE '%[SECRET]%'").count() == 2


def test_run_equals_stages_and_empty(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert len(got) > 50 and set(got.columns) == {"doc_id", "size", "source", "source_size", "target", "taken"}
    docs(spark, [], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
