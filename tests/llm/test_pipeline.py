"""The pipeline's stages, each against what brute force says of its input."""

import pytest

import corpus_pipeline as pipeline
from quire.llm import substring
from tests.llm.test_operators import brute_check_packing, brute_groups, prose, words


def test_stages(spark, sf_dir):
    assert [name for name, _ in pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "repeated_spans", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = pipeline.materialize(stage(spark, kept, sf_dir), name)
        assert kept.columns == columns
        after = {r.doc_id: r for r in kept.collect()}
        assert after.keys() <= before.keys()
        if name == "near_duplicates":
            want = brute_groups(list(before.items()), 5, 80)
            assert set(after) == {i for i, r in want.items() if i == r}
        elif name == "repeated_spans":
            assert after.keys() == before.keys()
            seen = set()
            for i in sorted(after):
                own = words(before[i])
                windows = [tuple(own[p : p + 50]) for p in range(len(own) - 49)]
                gone = {j for p, w in enumerate(windows) if w in seen for j in range(p, p + 50)}
                assert words(after[i].text) == [x for j, x in enumerate(own) if j not in gone]
                seen |= set(windows)
        else:
            assert len(after) > 0.8 * len(before)
    assert substring.WINDOW == 50
    packed = pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept.count()


#: Nulls, empty, blank and short texts, repeated rows, equal texts under other ids, a very long text.
ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 34"), (5, prose(1, 80)), (5, prose(1, 80)), (6, prose(1, 80)), (None, prose(2, 80)), (None, None), (7, prose(3, 20_000)), (8, prose(3, 20_000) + " end"), (9, "one"), (10, f"new {prose(1, 80)} words {prose(9, 300)}")]
CLASH = ("lang_pred", "toxic_predicted", "_place", "n_removed", "kept_text", "h", "a.b")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "aa" if t else None, None, None if t is None else len(t), *CLASH) for i, t in ODD]
    fields = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {fields}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 1), (5, None, 0), (6, 0, None), (None, 0, 1), (7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def passed_through(df, odd):
    assert df.columns == odd.columns
    assert all(tuple(r[c] for c in CLASH) == CLASH for r in df.collect())


def test_language_stage_on_odd_rows(spark, odd, folder):
    kept = pipeline.language(spark, odd, folder)
    passed_through(kept, odd)
    assert texts(kept) == sorted([d for d in ODD if any(c.isalpha() for c in d[1] or "") and d[1] != "one"] + [d for d in texts(kept) if d[1] == "one"], key=repr)
    assert pipeline.language(spark, odd.where("lang IS NULL"), folder).count() == 0
    assert pipeline.language(spark, odd.where("false"), folder).count() == 0


def test_toxicity_stage_on_odd_rows(spark, odd, folder):
    # One toxic label among texts that share every word teaches no lexicon: all stay.
    kept = pipeline.toxic(spark, odd, folder)
    passed_through(kept, odd)
    assert texts(kept) == sorted(ODD, key=repr)
    assert pipeline.toxic(spark, odd.where("false"), folder).count() == 0


def test_near_duplicate_stage_on_odd_rows(spark, odd, folder):
    kept = pipeline.near_duplicates(spark, odd, folder)
    passed_through(kept, odd)
    want = brute_groups(ODD, 5, 80)
    assert texts(kept) == sorted({d for d in ODD if d[0] is not None and want[d[0]] == d[0]} | {d for d in ODD if d[0] is None}, key=repr)
    assert pipeline.near_duplicates(spark, odd.where("false"), folder).count() == 0


def test_span_stage_on_odd_rows(spark, odd, folder):
    kept = pipeline.repeated_spans(spark, odd, folder)
    passed_through(kept, odd)
    want, windows = [], []
    for j, u in ODD:
        w = words(u)
        windows.append((j, {tuple(w[p : p + 50]) for p in range(len(w) - 49)}))
    for i, t in ODD:
        own = words(t)
        others = set().union(*(w for j, w in windows if i is not None and j is not None and j < i))
        gone = {j for p in range(len(own) - 49) if tuple(own[p : p + 50]) in others for j in range(p, p + 50)}
        want.append((i, " ".join(w for j, w in enumerate(own) if j not in gone) if gone else t))
    assert texts(kept) == sorted(want, key=repr)
    assert {(r.n_chars, None if r.text is None else len(r.text)) for r in kept.collect()} == {(None if t is None else len(t),) * 2 for _, t in want}
    assert pipeline.repeated_spans(spark, odd.where("false"), folder).count() == 0


def test_packing_stage_on_odd_rows(spark, odd, folder):
    found = pipeline.pack(spark, odd, folder).collect()
    brute_check_packing(ODD, found, odd.rdd.getNumPartitions())
    assert pipeline.pack(spark, odd.where("false"), folder).count() == 0
