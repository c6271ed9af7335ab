"""The corpus pipeline, stage by stage, against plain versions of each decision."""

import itertools
import random

import corpus_pipeline
import pyarrow as pa
import pytest
from capweave.llm.common import BATCH_BYTES, scratch, small_batches, stored
from capweave.llm.langid import first_of_each
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_simhash import closed, fingerprint
from test_text_ops import DE, EN, contained, relined


def corpus():
    rng = random.Random(12)
    word = lambda i: (EN, DE)[i % 2][rng.randrange(16)] + rng.choice(["", "s", "en", "ly", "ung"])
    text = lambda i, n: " ".join(word(i) for _ in range(n))
    rows = [(i, f"{text(i, 60)}\n{text(i, 30)}", ("en", "de")[i % 2], "abc"[i % 3]) for i in range(90)]
    rows = [(i, t + ("\nshare this page with all" if i % 4 == 0 else ""), la, s) for i, t, la, s in rows]
    rows += [(100 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(5)]  # copies
    for i in range(5, 12):  # near copies
        w = rows[i][1].split(" ")
        w[10] = "edited"
        rows.append((100 + i, " ".join(w), rows[i][2], rows[i][3]))
    items = [(n, text(n, 30)) for n in range(4)]
    rows += [(200 + n, f"{text(n, 50)} {t} {text(n, 20)}", "en", "a") for n, t in items]
    rows += [(300, None, "en", "a"), (301, "12 !!", "en", "b"), (302, "", None, None), (None, text(0, 40), "en", "a")]
    return rows, items


def similarity(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    rows, items = corpus()
    out = tmp_path_factory.mktemp("sf")
    make(rows).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_stages(spark, folder):
    stages, docs, columns = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet"), None
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    as_rows = lambda df: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
    step = lambda name, df: spark.createDataFrame(stages[name](spark, df, folder).collect(), df.schema)
    was = as_rows(docs)

    got = step("language_id", docs)
    assert got.columns == docs.columns and sorted(map(str, as_rows(got))) == sorted(str(r) for r in was if r[1] and any(c.isalpha() for c in r[1]))
    docs, was = got, as_rows(got)

    got = step("line_dedup", docs)
    want = relined(was, 0.1, 5)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted(w[:2] for w in want) and not any("share this" in (r["text"] or "") for r in got.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    docs, was = got, as_rows(got)

    got = step("near_dedup", docs)
    known = [r for r in was if r[0] is not None]
    fps = [fingerprint(r[1]) for r in known]
    linked = [(a, b) for a, b in itertools.combinations(range(len(known)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2 or similarity(known[a][1], known[b][1]) >= 0.8]
    ids = [r[0] for r in known]
    roots = closed(ids, [(ids[a], ids[b]) for a, b in linked])
    assert sorted(str(r[0]) for r in as_rows(got)) == sorted([str(i) for i in ids if roots[i] == i] + ["None"]) and len(roots) > len(set(roots.values())) + 10
    docs, was = got, as_rows(got)

    got = step("decontaminate", docs)
    bad = {x[0] for x in contained([(r[0], r[1]) for r in was], corpus()[1])}
    assert bad == {"200", "201", "202", "203"} and sorted(str(r[0]) for r in as_rows(got)) == sorted(str(r[0]) for r in was if str(r[0]) not in bad)

    last = stages["mix_sources"](spark, got, folder)
    taken = last.collect()
    columns = [*got.columns, "mix_copies", "mix_finish"]
    total = sum(len(r[1].split()) for r in as_rows(got) if r[0] is not None or True)
    assert last.columns == columns and abs(sum(len(r["text"].split()) * r["mix_copies"] for r in taken) - total) < 3 * 95
    run = corpus_pipeline.run(spark, folder)
    assert run.columns == columns and sorted(((r["doc_id"], r["mix_copies"]) for r in run.collect()), key=str) == sorted(((r["doc_id"], r["mix_copies"]) for r in taken), key=str)


def test_empty_tables(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_first_of_each(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 7 == 0]) for i in range(5000)] * 2 + [(9000, "c")], "_k long, _l string")
    order = rows.distinct().withColumn("h", F.xxhash64(F.lit(3), "_k")).orderBy("h", "_k").collect()
    want = sorted((r["_k"], r["_l"]) for la in "abc" for r in [x for x in order if x["_l"] == la][:900])
    assert sorted(map(tuple, first_of_each(rows, 900).collect())) == want


def test_scratch_keeps_the_last_table_only(spark):
    with scratch(spark):
        with scratch(spark, keep=1):
            gone, kept = stored(spark.range(3)).inputFiles(), stored(spark.range(4))
        assert kept.count() == 4
        with pytest.raises(AnalysisException):
            spark.read.parquet(*gone)
        path = kept.inputFiles()[0]
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "decontaminate"])
def test_batches_of_long_texts_stay_small(spark, folder, name):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "n"])

    own = spark.newSession()
    dict(corpus_pipeline.STAGES)[name](own, own.read.parquet(f"{folder}/documents.parquet"), folder)
    long = own.range(2000, numPartitions=1).select("id", F.expr("repeat('word ', 2000)").alias("text"))
    got = long.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r["n"] for r in got) == 2000 and max(r["bytes"] for r in got) < 1.1 * BATCH_BYTES


def test_smaller_batches_stay_as_they_are(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    small_batches(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
