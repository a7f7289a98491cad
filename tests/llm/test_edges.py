"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns; the pipeline's stages."""

import collections
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat, fingerprints, language, mixing, neighbours, ngram_join, packing, quality, secrets, toxicity
from ledgerloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, node long, key string, value string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    long = "word other third " * 40_000
    rows = [
        (1, "the cat sat on the mat today", "en", "a"), (2, "the cat sat on the mat today", "en", "a"), (2, "the cat sat on the mat today", "en", "a"), (3, None, "en", None), (4, "", None, "b"),
        (5, " \n\t ", "de", "b"), (6, long, "en", "a"), (None, "no id but text here now", "en", "a"), (7, "kurz", "de", None), (8, "😀 é\u0000x", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 1, "k", "v", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_toxicity(spark, odd, empty):
    data = odd.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("doc_id"), "text", (F.col("lang") == "de").cast("int").alias("label"))
    for model in (toxicity.train(data), toxicity.train(data.limit(0)), toxicity.train(data.where("label = 0"))):
        got = [r[0] for r in odd.select(toxicity.score_column(model)).collect()]
        assert len(got) == 10 and all(0 <= s <= 1 for s in got)
    assert empty.select(toxicity.score_column(model)).collect() == []


@pytest.mark.parametrize("name", ["op1_toxicity", "op5_quality", "op9_language"])
def test_scoring_queries_on_odd_tables(spark, odd, empty, tmp_path, name):
    """Clashing extra columns, repeated rows, null ids (held out, never learned from) and no rows at all."""
    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs, n in ((odd, 10), (empty, 0)):
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert all(r["held_out"] for r in got if r["doc_id"] is None)


def test_quality(spark, odd, empty):
    data = odd.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("doc_id"), "text", (F.col("lang") == "de").cast("int").alias("label"))
    for model in (quality.train(data), quality.train(data.limit(0))):
        got = [r[0] for r in odd.select(quality.score_column(model)).collect()]
        assert len(got) == 10 and all(0 <= s <= 1 for s in got)
    assert empty.select(quality.score_column(model)).collect() == []


def test_language(spark, odd, empty):
    for data in (odd, empty):
        model = language.train(data)
        got = [r[0] for r in odd.select(language.predict_columns(model)).collect()]
        assert [r["lang_pred"] for r in got][3:6] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got)


def test_ngram_join(spark, odd, empty):
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.near_duplicates(odd).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8)]
    assert ngram_join.near_duplicates(empty).collect() == []
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8]


def test_chat(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, t int")).collect() == []
    twice = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5)], "conv_id long, turn long, role string, text string, t int")
    assert chat.format_conversations(twice).first()["formatted"] == "<|user|>a<|sep|>a<|end|>"


def test_packing(spark, odd, empty):
    got = packing.pack(odd, capacity=1000).collect()
    assert sum(r["n_words"] for r in got) == 7 * 3 + 120_000 + 6 + 1 + 2 and len({r["bin_id"] for r in got if r["doc_id"] in (1, 2)}) == 3
    assert packing.pack(empty).collect() == []


def test_fingerprints(spark, odd, empty):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(odd).collect()}
    assert got[1] == got[2] and got[3] == got[4] == got[5] == "" and len(got[7]) == 2 * fingerprints.BINS
    assert fingerprints.fingerprint(empty).collect() == [] and fingerprints.with_next(empty.select("doc_id", "text")).collect() == []
    one = spark.createDataFrame([(5, "a b c")], "doc_id long, text string")
    assert fingerprints.with_next(one).first()["next_text"] == "a b c"


def test_likeness_of_blank_texts(spark):
    df = spark.range(1).select(fingerprints.signature(F.lit(" ")).alias("a"), fingerprints.signature(F.lit("x y")).alias("b"))
    assert tuple(df.select(fingerprints.likeness(F.col("a"), F.col("a")), fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.likeness(F.col("b"), F.col("b"))).first()) == (1.0, 0.0, 1.0)


def test_neighbours(spark):
    bad = [None, [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], [1.0]]
    rows = [(100 + i, v, 1.0) for i, v in enumerate(bad)] + [(0, [1.0, 0.0], 1.0), (3, [1.0, 1.0], 1.0), (2, [1.0, 1.0], 1.0), (7, [0.0, 1.0], 1.0), (300, None, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 7)]
    assert neighbours.search(df.limit(0)).collect() == []


def test_mixing(spark, odd, empty):
    got = mixing.mix(odd)
    assert got.columns == [*odd.columns, "mix_phase", "mix_slot", "mix_position"] and got.count() == 10
    assert mixing.mix(empty).collect() == []
    again = mixing.mix(got.withColumn("row", F.lit(1)).withColumn("s", F.lit("z")).withColumn("plan", F.lit(0)))
    assert again.columns == [*odd.columns, "row", "s", "plan", "mix_phase", "mix_slot", "mix_position"] and again.select("mix_position").distinct().count() == 10


def test_mixing_of_many_rows_with_one_key(spark):
    """Rows of one (or no) key are still cut into ranges, and every row keeps a place of its own."""
    df = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a' AS source", "id AS n_chars")
    got = mixing.mix(df)
    assert got.select("mix_position").distinct().count() == 3000


def test_secrets(spark, odd, empty):
    model = secrets.train(secrets.labelled_findings(spark, 300))
    assert secrets.scan(odd, model).collect() == [] and secrets.scan(empty, model).collect() == []
    again = secrets.redact(odd, secrets.scan(odd, model))
    assert again.columns == odd.columns and again.count() == 10


def test_stages_take_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Null ids, texts and sources, repeated rows, a very long text, columns that clash with those made inside."""
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clash = odd.withColumns({c: F.lit("x") for c in ("row", "mix_slot", "__tie", "component", "first", "h", "s", "path", "score2", "cluster")})
    for docs in (odd, clash, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            n = out.count()
            assert n == (0 if docs is empty else {"ngram_join": 8, "secrets": 10, "mixing": 10}.get(name, n)), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == (0 if docs is empty else 9)


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def stage(spark, name, docs, sf):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect()


def test_stage_toxicity_against_plain_scores(spark, sf, docs):
    """A document stays if a plain sum over its words with the model's weights gives less than 0.3."""
    model = toxicity.train_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    want = []
    for r in docs.collect():
        n = collections.Counter(f for w in "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split() for f in toxicity.word_features(w))
        z = model.intercept + sum(weight.get(f, 0.0) * (1 + math.log(k)) for f, k in n.items())
        want += [r["doc_id"]] if 1 / (1 + math.exp(-z)) < 0.3 else []
    assert sorted(r["doc_id"] for r in stage(spark, "toxicity", docs, sf)) == sorted(want) and 0 < len(want) < docs.count()


def test_stage_ngram_join_against_all_pairs(spark, sf, docs):
    """The smallest id of every component of all pairs with five-word shingles and similarity 0.8."""
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, first = sorted(sets), {i: i for i in sets}
    for _ in range(3):
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
    got = stage(spark, "ngram_join", docs, sf)
    assert sorted(r["doc_id"] for r in got) == [i for i in ids if first[i] == i] and len(got) < len(ids)


def test_stage_secrets_against_plain_replacement(spark, sf, docs):
    """Texts with the found values replaced at their places, one by one; everything else as it was."""
    found = secrets.scan(docs, secrets.train(secrets.labelled_findings(spark))).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["doc_id"]].append((r["start"] - 1, r["value"]))
    got = {r["doc_id"]: r for r in stage(spark, "secrets", docs, sf)}
    for r in docs.collect():
        text = r["text"]
        for at, value in sorted(by[r["doc_id"]], reverse=True):
            assert text[at : at + len(value)] == value
            text = text[:at] + "[SECRET]" + text[at + len(value) :]
        assert got[r["doc_id"]]["text"] == text and got[r["doc_id"]]["n_chars"] == (len(text) if by[r["doc_id"]] else r["n_chars"])
    assert len(got) == docs.count() and by


def test_stage_mixing_against_a_sort(spark, sf, docs):
    """All rows, in the order of their places; within a source in the order of a hash of id and text."""
    got = stage(spark, "mixing", docs, sf)
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.collect()))
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"), F.xxhash64("text")).alias("h")).collect()}
    for source in {r["source"] for r in got}:
        own = [r["doc_id"] for r in got if r["source"] == source]
        assert own == sorted(own, key=h.get)


def test_run_is_the_stages_one_after_another(spark, sf, docs):
    for name, one in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(one(spark, docs, sf).collect(), one(spark, docs, sf).schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("weights", [{"hot": 1, "cold": 1}, {"hot": 9, "cold": 1}])
def test_bins_follow_the_mix(spark, monkeypatch, tmp_path, weights):
    """Shards of the packing are ranges of what the mixing stage wrote, whose target weights show in the first ones."""
    monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights, raising=False)
    rows = [(i, f"word{i} " * (1 + i % 5), "hot" if i % 3 else "cold", 1) for i in range(7_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    order = [r["doc_id"] for r in mixed.collect()]
    mixed.write.parquet(f"{tmp_path}/mixed")
    monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {"hot": 1, "cold": 99})  # says nothing to the packing
    got = {}
    for r in stage(spark, "packing", spark.read.parquet(f"{tmp_path}/mixed"), ""):
        got.setdefault(r["mix_from"], set()).add(r["doc_id"])
        assert int(r["bin_id"].split("-")[0]) * 2_048 == r["mix_from"]
    assert {k: got[k] for k in sorted(got)} == {at: set(order[at : at + 2_048]) for at in range(0, 7_000, 2_048)}
    hot = sum(i % 3 > 0 for i in got[0]) / 2_048
    assert abs(hot - weights["hot"] / sum(weights.values())) < 0.03


def test_another_order_gives_other_bins(spark, tmp_path):
    """The order of the stored rows alone decides: files with several parts and names beyond five digits, and rows in memory."""
    rows = [(i, f"word{i} " * (1 + i % 5), "s", 1) for i in range(5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    shards = {}
    for name, by in (("up", "doc_id"), ("down", -F.col("doc_id"))):
        docs.orderBy(by).write.option("maxRecordsPerFile", 700).parquet(f"{tmp_path}/{name}")
        for r in stage(spark, "packing", spark.read.parquet(f"{tmp_path}/{name}"), ""):
            shards.setdefault(name, {}).setdefault(r["mix_from"], set()).add(r["doc_id"])
    assert shards["up"] == {at: set(range(at, min(5_000, at + 2_048))) for at in range(0, 5_000, 2_048)}
    assert shards["down"] == {at: set(range(max(0, 5_000 - at - 2_048), 5_000 - at)) for at in range(0, 5_000, 2_048)}
    again = {}
    for r in stage(spark, "packing", docs.orderBy("doc_id").coalesce(1), ""):
        again.setdefault(r["mix_from"], set()).add(r["doc_id"])
    assert again == shards["up"]
