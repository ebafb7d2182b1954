"""Stages on rows that the given tables do not have."""

import random

from pyspark.sql import functions as F

from usagelens.llm import stages, store

SCHEMA = "doc_id long, text string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, len(t)) for d, t in rows], SCHEMA).repartition(3)


def say(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_rows_without_an_id_and_repeated_rows(spark, sf_dir):
    copy, own = say(1, 40), say(2, 40)
    docs = table(spark, [(None, copy), (None, copy), (9, copy), (5, copy), (5, copy), (None, own), (7, say(3, 40)), (7, say(4, 40)), (None, "")])
    left = sorted([(str(r.doc_id), r.text) for r in stages.near_duplicates(spark, docs, sf_dir).collect()])
    assert left == sorted([("5", copy), ("None", own), ("7", say(3, 40)), ("7", say(4, 40)), ("None", "")])
    left = sorted([(str(r.doc_id), r.text) for r in stages.repeated_passages(spark, docs.filter("text <> ''"), sf_dir).collect()])
    assert left == sorted([("5", copy), ("None", own), ("7", say(3, 40)), ("7", say(4, 40))])


def test_contaminated_rows_without_an_id_go(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").limit(2).collect()
    docs = table(spark, [(None, items[0].text), (None, say(5, 40)), (3, items[1].text), (3, say(6, 40))])
    left = sorted((str(r.doc_id), r.text) for r in stages.decontaminate(spark, docs, sf_dir).collect())
    assert left == sorted([("None", say(5, 40)), ("3", say(6, 40))])


def test_only_characters_that_are_cut_through_go(spark, sf_dir):
    """The last bytes of é and ĩ, and the first of é and è, are equal."""
    passage = say(7, 20)
    docs = [
        (1, "é" + passage + "é"), (2, "\ufffd junk ĩ" + passage + "è far \ufffd"), (3, "\ufffd\ufffd own"),
        (4, "x" + say(8, 20) + "é" + say(9, 20)), (5, say(8, 20) + "è" + say(9, 20)), (6, "ab" + say(8, 20) + "è 𝄞"),
        (7, "\ufffd keep ũ" + passage + " \ufffd"),
    ]
    left = {r.doc_id: (r.text, r.n_chars) for r in stages.repeated_passages(spark, table(spark, docs), sf_dir).collect()}
    texts = dict(docs) | {2: "\ufffd junk  far \ufffd", 6: "ab 𝄞", 7: "\ufffd keep  \ufffd"}
    del texts[5]
    assert left == {d: (t, len(t)) for d, t in texts.items()}


def test_differing_rows_of_one_id_keep_their_own_text(spark, sf_dir):
    passage = say(10, 20)
    docs = table(spark, [(1, passage), (2, "first-" + passage), (2, "second+" + passage)])
    assert sorted(r.text for r in stages.repeated_passages(spark, docs, sf_dir).collect()) == sorted([passage, "first-", "second+"])


def test_columns_of_any_name_stay(spark, sf_dir):
    """Names that the stages use themselves, nulls, a very long text, rows without an id."""
    names = ["_row", "_at", "spans", "_spans", "_kept", "_score", "component_id", "n_removed", "key", "ids", "_row2"]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").first().text
    long = say(20, 60000)
    texts = [(1, long), (2, None), (3, ""), (4, "few words"), (5, say(21, 50)), (6, say(21, 50) + " more"), (7, item), (8, say(22, 30) + " " + " ".join(long.split()[:40]))]
    for extra in ([], [(None, say(23, 40)), (4, say(24, 40))]):
        rows = texts + extra
        df = spark.createDataFrame([(d, t, None if t is None else len(t), *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(rows)], SCHEMA + "".join(f", `{n}` string" for n in names))
        for stage, gone in ((stages.near_duplicates, {5}), (stages.repeated_passages, set()), (stages.decontaminate, {6})):
            out = stage(spark, df.repartition(2), sf_dir)
            assert out.columns == df.columns
            got = {r["_row"]: r for r in out.collect()}
            assert {int(r[4:]) for r in got} == set(range(len(rows))) - gone
            for name, r in got.items():
                i = int(name[4:])
                assert r["doc_id"] == rows[i][0] and [r[n] for n in names] == [f"{n}{i}" for n in names]
                if stage is not stages.repeated_passages or i not in (5, 7):
                    assert r["text"] == rows[i][1]
        encoded = stages.encode(spark, df, sf_dir)
        assert set(names) - {"ids"} <= set(encoded.columns)
        assert {r["_row"]: r.n_pieces is None for r in encoded.collect()} == {f"_row{i}": t is None for i, (_, t) in enumerate(rows)}


def test_empty_table(spark, sf_dir):
    docs = table(spark, []).withColumn("_row", F.lit(1))
    for stage in (stages.near_duplicates, stages.repeated_passages, stages.decontaminate, stages.encode):
        assert stage(spark, docs, sf_dir).collect() == []


def test_step_tables_go_when_a_stage_ends(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark, purpose: str(tmp_path / f"{purpose}-{len(list(tmp_path.iterdir()))}-{random.random()}"))
    docs = table(spark, [(i, say(30 + i % 5, 60)) for i in range(20)])
    for stage, purpose in ((stages.near_duplicates, "gone"), (stages.repeated_passages, "spans"), (stages.decontaminate, "contaminated")):
        held = {p.name for p in tmp_path.iterdir()}
        out = stage(spark, docs, sf_dir)
        assert [n.split("-")[0] for n in {p.name for p in tmp_path.iterdir()} - held] == [purpose]
        assert out.count() == (5 if purpose != "contaminated" else 20)
