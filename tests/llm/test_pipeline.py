import random

import corpus_pipeline
from licensum.llm import simhash
from tests.llm.helpers import ODD, documents, folder
from tests.llm.test_simhash import brute_components, fingerprint, near_rows


def corpus():
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "stone river cloud maple winter garden silver".split() for b in "bridge water light path field house song".split()]
    rows = [(i, " ".join(rng.choices(vocabulary, k=120)).capitalize() + ".", "en", rng.choice("abc")) for i in range(80)]
    exact = [(100 + i, rows[i][1].replace(" ", "  "), "en", "a") for i in range(5)]
    near = []
    for i in range(20, 30):
        text = rows[i][1].split()
        text[-1 if i % 2 else rng.randrange(120)] = "changed"
        near.append((200 + i, " ".join(text), "en", "b"))
    junk = [(300 + i, " ".join(w + "$$$" for w in rng.choices(vocabulary, k=60)), "en", "c") for i in range(10)]
    return rows, exact, near, junk


def near_kept(rows):
    """The smallest id of each component of fingerprints within three bits."""
    return set(brute_components(rows, [fingerprint(r[1]) for r in rows]))


def test_stages(spark, tmp_path):
    rows, exact, near, junk = corpus()
    odd = [(1000 + r[0], *r[1:]) for r in ODD[1:5]]
    path = folder(spark, tmp_path, rows + exact + near + junk + odd)
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        assert name == ("quality rules", "exact dedup", "near dedup", "mixing", "bpe")[i]
        if i < 4:
            assert docs.columns == columns
            docs.write.parquet(str(tmp_path / f"stage{i}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    good = {r[0] for r in rows}
    assert set(seen[0]) == good | {r[0] for r in exact + near} | {1005}
    assert len(set(seen[1])) == len(seen[1]) == 91
    assert {100, 101, 102, 103, 104} <= set(seen[1])  # of equal texts the longer original stays
    assert seen[2] == sorted(near_kept([r for r in rows + exact + near + odd if r[0] in set(seen[1])]))
    assert len(seen[2]) < len(seen[1])
    assert len(set(seen[3]) - set(seen[2])) == 0
    assert len(seen[3]) > len(seen[2])
    assert seen[4] == seen[3]


def test_near_rows(spark):
    rows = near_rows(160, 2)
    left = simhash.drop_near_duplicates(documents(spark, rows))
    kept = {r.doc_id for r in left.collect()}
    assert kept == near_kept(rows)
    assert len(kept) == left.count() < 160


def test_odd_rows(spark):
    df = documents(spark, ODD)
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "7", "8", "None"]  # texts without words are linked
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def test_addresses_beside_columns_of_the_same_names(spark, tmp_path):
    rows = [(1, "one two three", 1, "a", "m"), (1, "one two three", 1, "a", "m"), (2, "one  two three", 2, None, None), (None, None, None, None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line long, file string, _metadata string")
    df.write.parquet(str(tmp_path / "docs"))
    for docs in (spark.read.parquet(str(tmp_path / "docs")), df):
        left = corpus_pipeline.exact_duplicates(spark, docs, "")
        assert left.columns == df.columns
        assert {tuple(r) for r in left.collect()} == {rows[2], rows[3]} and left.count() == 2
