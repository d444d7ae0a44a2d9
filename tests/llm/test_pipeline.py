"""The pipeline's stages, one after the other, each held against brute force on its own input."""

from collections import defaultdict

import pyarrow.parquet as pq

from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_ngram_join import brute as groups

PASSAGE = 200


def cut(rows):
    raws = {k: (t or "").encode() for k, t in rows}
    seen = defaultdict(int)
    for r in raws.values():
        for i in range(len(r) - PASSAGE + 1):
            seen[r[i : i + PASSAGE]] += 1
    out = {}
    for k, r in raws.items():
        gone = bytearray(len(r))
        for i in range(len(r) - PASSAGE + 1):
            if seen[r[i : i + PASSAGE]] > 1:
                gone[i : i + PASSAGE] = b"\1" * PASSAGE
        parts, at = [], 0
        for i in range(len(r) + 1):
            if i == len(r) or gone[i]:
                parts.append(r[at:i].decode(errors="ignore"))
                at = i + 1
        out[k] = ("".join(parts), any(gone))
    return out


def test_stages(spark, sf):
    import corpus_pipeline
    from lateloom.llm import toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    given = [(i, f"own text number {i} " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(5)]
    more = spark.createDataFrame([(900_000 + i, t, "en", "s", len(t)) for i, t in given] + [(900_010, "", "en", "s", 0), (900_011, None, "en", "s", None), (900_012, "you idiot moron clown", "en", "s", 21)], docs.schema)
    docs = docs.unionByName(more).unionByName(more.where("doc_id = 900000"))
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    step = lambda name, x: stages[name](spark, x, sf)
    rows = lambda x: [(r.doc_id, r.text) for r in x.collect()]

    clean = step("toxicity", docs).cache()
    assert clean.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    kept = {k for k, _ in rows(clean)}
    assert {900_010, 900_011, *(900_000 + i for i in range(5))} <= kept
    wrong = sum((k in kept) == bool(v) for k, v in labels.items())
    assert wrong / len(labels) < 0.15 and toxicity.FIT_ROWS > 0

    single = step("ngram_jaccard_join", clean).cache()
    want = sorted({k for k, n, c in groups(rows(clean), 5, 80) if k == c or not n})
    assert sorted(k for k, _ in rows(single)) == want and single.columns == columns

    short = step("suffix_array_dedup", single).cache()
    expected = {k: t for k, (t, changed) in cut(rows(single)).items() if not changed or t.strip()}
    got = dict(rows(short))
    assert {k: v or "" for k, v in got.items()} == expected and got[900_011] is None and short.columns == columns
    assert all(r.n_chars == len(r.text) for r in short.where("n_chars is not null and text is not null").collect() if r.text != dict(rows(single))[r.doc_id])

    safe = step("benchmark_decontamination", short).cache()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    leaked = {d for d, _, _, _ in leaks(rows(short), items)}
    assert {k for k, _ in rows(safe)} == set(got) - leaked and leaked and safe.columns == columns

    packed = step("best_fit_packing", safe).collect()
    assert {r.doc_id for r in packed} == {k for k, _ in rows(safe)}
    assert max(r.offset + r.length for r in packed) <= 1024


def test_run(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_stages_tell_rows_apart(spark, sf):
    """Rows with the same doc_id, or none, and different texts are documents of their own; extra columns of any name stay."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    text = lambda i, n=60: " ".join(f"w{i}x{k}" for k in range(n))
    item = pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()[0]
    near = text(3) + " end"
    rows = [(1, text(1)), (1, text(2)), (9, near), (9, text(4)), (5, text(3)), (None, text(5)), (None, text(5)), (None, text(6)), (7, text(7) + " " + item), (7, text(8)), (8, ""), (8, None), (8, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row int, own_text string, was_null boolean, kept_text string, `__text` string, c0 string, key string"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, "o", False, "k", "t", "c", "y") for k, t in rows], columns).coalesce(1)
    got = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, sf).collect()), key=str)
    less = lambda *gone: sorted((r for i, r in enumerate(rows) if i not in gone), key=str)
    assert got("toxicity") == less()
    assert got("ngram_jaccard_join") == less(2, 6)  # of 5 and 9 the least id stays, of a repeated row one
    assert got("benchmark_decontamination") == less(8)
    for name in ("toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination"):
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns and {(r.row, r.own_text, r.was_null, r.kept_text, r.c0, r.key) for r in out.collect()} == {(1, "o", False, "k", "c", "y")}
    cut = stages["suffix_array_dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in cut if r.doc_id in (1, 7)) == sorted((k, t) for k, t in rows if k in (1, 7))
    assert sorted(str(r.text) for r in cut if r.doc_id == 8) == ["", "None", "None"]
    assert stages["best_fit_packing"](spark, docs, sf).count() == len(rows)


def test_results_live_beside_each_other(spark, sf):
    """A stage's result can be read after other stages, or the same one again, have run."""
    import corpus_pipeline

    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    frame = lambda ids: spark.createDataFrame([(i, text(i), "en", "s", 9) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        a = stage(spark, frame([1, 2, 2, 3]), sf)
        b = stage(spark, frame([4, 5, 6, 7, 8]), sf)
        assert b.count() >= 4 and a.count() in (1, 2, 3, 4), name
        assert b.count() >= 4 and a.where("doc_id = 3").count() == 1, name
