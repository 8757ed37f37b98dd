import corpus_pipeline
from pyspark.sql import functions as F

from resolvescope.llm import decontamination, simhash, toxicity
from resolvescope.llm.common import read_table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_one_after_the_other(spark):
    docs = read_table(spark, SF, "documents")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert sorted(kept.columns) == sorted(COLUMNS)
        before, after = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (docs, kept))
        assert after.items() <= before.items()
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        sizes.append(len(after))
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(read_table(spark, SF, "documents"), read_table(spark, SF, "labels")).collect()}
    assert sizes[0] == sum(p == 0 for p in scored.values())
    left = docs.collect()
    groups = simhash.near_duplicates(docs).collect()
    assert all(r["component_id"] == r["doc_id"] for r in groups)
    assert decontamination.find_overlaps(docs, read_table(spark, SF, "benchmark")).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in mixed.select("doc_id").collect()} <= {r["doc_id"] for r in left}
    assert mixed.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, mixed.select(*run.columns).collect()))


def test_every_query_runs(spark):
    import __spark_entry__ as entry

    names = {f"op{n}" for n in range(1, 14)}
    assert names <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()
    found = entry.queries()["op6_toxicity"](spark, SF).agg(F.count("*")).first()[0]
    assert found == read_table(spark, SF, "documents").count()


def test_benchmark_stage_with_repeated_and_missing_ids(spark, docs):
    leak = read_table(spark, SF, "benchmark").first()["text"]
    frame = docs([(1, leak), (1, "a clean text"), (None, leak), (None, "another clean text"), (2, None)])
    kept = corpus_pipeline.drop_benchmark_passages(spark, frame, SF)
    assert kept.columns == frame.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "a clean text"), (None, "another clean text"), (2, None)}


def test_stages_keep_columns_with_clashing_names(spark, table):
    """Repeated rows, missing ids and columns that are named like the stages' own."""
    leak = read_table(spark, SF, "benchmark").first()["text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, _row int, overlapping string, score string"
    texts = [(1, leak), (1, "a clean text of some words"), (2, "a clean text of some words"), (None, leak), (None, "another clean text"), (None, "another clean text"), (3, None)]
    frame = table([(i, t, "en", "src1", 3, "r", "k", 4, "o", "s") for i, t in texts], schema)
    benchmark = corpus_pipeline.drop_benchmark_passages(spark, frame, SF)
    assert benchmark.columns == frame.columns and {tuple(r)[2:] for r in benchmark.collect()} == {("en", "src1", 3, "r", "k", 4, "o", "s")}
    single = corpus_pipeline.drop_near_duplicates(spark, frame, SF)
    assert single.columns == frame.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in single.collect()))) == sorted(map(repr, [(1, leak), (1, "a clean text of some words"), (None, "another clean text"), (3, None)]))
    toxic = corpus_pipeline.drop_toxic(spark, frame, SF)
    assert toxic.columns == frame.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), SF).collect() == []
