"""The pipeline's stages against plain Python, stage by stage, and its edge cases."""

import corpus_pipeline as cp
import pytest

from . import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(brute.odd_documents(), brute.SCHEMA).write.parquet(f"{d}/documents.parquet")
    items = [(1, brute.words(70, 1)), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_id = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = cp.identify_language(spark, docs, folder)
    now = by_id(kept)
    assert kept.columns == docs.columns and not {6, 7, 8, 16, 17} & set(now) and {1, 2, 4, 5, 11} <= set(now)
    lines = cp.remove_repeated_lines(spark, kept, folder)
    want = {i: t for i, t in brute.line_dedup(now).items() if brute.WORD.search(t)}
    assert by_id(lines) == want and lines.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    one = cp.keep_one_of_near_copies(spark, lines, folder)
    classes = brute.jaccard_classes(want)
    assert set(by_id(one)) == {i for i, (_, c) in classes.items() if c == i}
    clean = cp.remove_benchmark_leaks(spark, one, folder)
    item = brute.shingles(brute.words(70, 1))
    assert set(by_id(clean)) == {i for i, t in by_id(one).items() if 100 * len(brute.shingles(t) & item) < 80 * len(item)}
    assert {r.doc_id for r in cp.pack_sequences(spark, clean, folder).collect()} == set(by_id(clean))
    assert {r.doc_id for r in cp.run(spark, folder).collect()} == set(by_id(clean))


def test_stages_on_repeats_nulls_and_nothing(spark, folder):
    odd = spark.createDataFrame(brute.with_repeats(brute.odd_documents()), brute.SCHEMA)
    for docs in (odd, odd.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert cp.STAGES[-1][1](spark, docs, folder).count() >= docs.count() * bool(docs.count())


def test_stages_on_clashing_columns(spark, folder):
    """Every stage gives the same rows with columns of any name, and keeps those (the last one leaves them out)."""
    from .test_documents import CLASH, clashing, values

    docs = spark.createDataFrame(brute.with_repeats(brute.odd_documents()), brute.SCHEMA)
    for name, stage in cp.STAGES:
        plain, clash = stage(spark, docs, folder), stage(spark, clashing(docs), folder)
        last = name == cp.STAGES[-1][0]
        columns = ["doc_id", "doc_tokens"] if last else docs.columns
        got, want = values(clash, columns), values(plain, columns)
        assert set(got) == set(want) and (last or got == want), name
        assert last or clash.columns == [*docs.columns, *CLASH]


def test_registered():
    import __spark_entry__ as e

    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in e.queries()) == 1 for n in names) and "pipeline" in e.queries()
    assert [n for n, _ in cp.STAGES] == ["language", "line_dedup", "near_copies", "decontamination", "packing"]


def test_a_written_table_relieves_the_driver(spark):
    """What nothing refers to any more is gone from the driver when a table has been written (before: it stayed until the heap was full)."""
    from stitchlake.llm._store import discard, materialize

    discard(materialize(spark.range(10), "warm"))
    seen = spark._jvm.java.lang.ref.WeakReference("a string that the driver's JVM alone has made")
    assert seen.get()
    table = materialize(spark.range(10), "relieved")
    assert seen.get() is None and table.count() == 10
    discard(table)
