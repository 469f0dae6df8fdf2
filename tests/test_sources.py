import json

import pytest
from pyspark.sql import functions as F

from pressgauge.config import RAW_COLUMNS, Settings, load_settings
from pressgauge import session
from pressgauge.operators import candidates, cleaning, scoring
from pressgauge.operators.encoding import hashing_encoder
from pressgauge.plans import pipeline
from pressgauge.session import shared_dir, stage
from pressgauge.sources import readers, tables, writers

SF = "/root/testdata/sf0.001"


def test_raw_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    header = ",".join(RAW_COLUMNS)
    blank = {c: "" for c in RAW_COLUMNS}
    row = blank | {"unique_article_id": "u1", "article_text": '"two\nlines, ""quoted"""', "like_count": "3", "LAD": "NaN", "owner": "null"}
    path.write_text(header + "\n" + ",".join(row[c] for c in RAW_COLUMNS) + "\n" + ",".join(blank.values()) + "\n")
    first, second = sorted(readers.read_raw_csv(spark, str(path)).collect(), key=lambda r: r.unique_article_id or "z")
    assert first.article_text == 'two\nlines, "quoted"' and first.like_count == 3
    assert first.LAD is None and first.owner is None and second.unique_article_id is None
    assert readers.read_raw_csv(spark, str(path), limit=1).count() == 1


def test_boundaries(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    hole = [[0.1, 0.1], [0.2, 0.1], [0.1, 0.1]]
    feature = lambda props, geometry: {"type": "Feature", "properties": props, "geometry": geometry}
    features = [
        feature({"LAD23NM": "P"}, {"type": "Polygon", "coordinates": [ring, hole]}),
        feature({"LAD22NM": "M"}, {"type": "MultiPolygon", "coordinates": [[ring], [ring, hole]]}),
        feature({"LAD23NM": "Dot"}, {"type": "Point", "coordinates": [0, 0]}),
        feature({"LAD23NM": "", "LAD22NM": "None"}, None),
    ]
    path = tmp_path / "b.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    places = readers.read_boundaries(spark, str(path))
    assert sorted(r.name for r in places.collect()) == ["Dot", "M", "None", "P"]
    rings = [(r.name, r.ring_index, len(r.ring)) for r in readers.outer_rings(places).collect()]
    assert sorted(rings) == [("M", 0, 4), ("M", 1, 4), ("P", 0, 4)]


def test_sinks_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("b", 'say "x"\nand, y', 2.0), ("a", None, 1.0)], "k string, t string, v double")
    writers.write_csv(frame, str(tmp_path / "c"), order=["k"])
    assert sorted(readers.read_result_csv(spark, str(tmp_path / "c"), frame.schema).collect(), key=lambda r: r.k) == sorted(frame.collect(), key=lambda r: r.k)
    writers.write_json(frame, str(tmp_path / "j"))
    lines = [json.loads(line) for p in (tmp_path / "j").glob("part*") for line in p.read_text().splitlines()]
    assert {line["k"]: line["t"] for line in lines}["a"] is None
    writers.write_table(frame, str(tmp_path / "p"))
    assert readers.preview(spark, str(tmp_path / "p"), ["k"], n=1).collect()[0].k == "a"


def test_vector_parity(spark):
    lookup = spark.createDataFrame([("a",), ("b",)], "story_key string")
    vecs = spark.createDataFrame([("a", [1.0]), ("c", [2.0])], "story_key string, embedding array<float>")
    got = {(r.story_key, r.missing_from) for r in readers.check_vector_parity(lookup, vecs).collect()}
    assert got == {("b", "vectors"), ("c", "lookup")}
    with pytest.raises(ValueError):
        readers.attach_vectors(lookup, vecs)
    assert readers.attach_vectors(lookup.where("story_key = 'a'"), vecs.where("story_key = 'a'")).count() == 1


def test_stage_keeps_rows_and_uses_the_shared_folder(spark):
    frame = spark.range(10).toDF("x")
    staged = stage(frame, "t")
    assert staged.count() == 10 and staged.dtypes == frame.dtypes
    assert shared_dir(spark) in staged.inputFiles()[0]


def test_settings_from_a_file(tmp_path):
    settings = {
        "runtime": {"text_min_length": 10, "chunk_size": 5},
        "filters": {"strong_keywords": ["x"]},
        "risk": {"prior_strength": 3.0, "weights": {"surprise_z": 1.0}},
        "profiles": {"econ_positive_anchors": ["p"]},
    }
    topics = {"topics": [{"name": "t", "keywords": ["k"]}]}
    (tmp_path / "s.json").write_text(json.dumps(settings))
    (tmp_path / "t.json").write_text(json.dumps(topics))
    cfg = load_settings(tmp_path / "s.json", tmp_path / "t.json")
    assert (cfg.text_min_length, cfg.strong_keywords, cfg.prior_strength, cfg.weight_surprise) == (10, ("x",), 3.0, 1.0)
    assert cfg.positive_anchors == ("p",) and cfg.panel_topics == ["t", "other_econ"]
    with pytest.raises(ValueError):
        Settings(run_mode="other")


def test_nothing_is_lost_by_default(spark):
    cfg = tables.DOC_MODEL_SETTINGS
    assert Settings().run_mode == cfg.run_mode == "full" and Settings().text_for_embedding_chars is None
    rows = stage(candidates.filter_candidates(cleaning.clean_articles(tables.raw_documents(spark, SF), cfg), cfg), "rows")
    scores = pipeline.score_candidates(rows, hashing_encoder(64), cfg)
    losses = pipeline.stage_losses(rows, scores, scoring.score_articles(rows, scores)).collect()
    assert [r.lost for r in losses] == [0, 0] and all(r.rows_in > 0 for r in losses)


def test_staged_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "staged_dir", lambda _: str(tmp_path / "app"))
    made = session.stage(spark.range(3).toDF("x"), "short_lived")
    assert made.count() == 3 and (tmp_path / "app").exists()
    session.remove_staged(spark)
    assert not (tmp_path / "app").exists()
    session.remove_staged(spark)


def test_pipeline_and_reuse(spark, tmp_path):
    cfg = tables.DOC_MODEL_SETTINGS.with_(run_mode="dev", embedding_story_cap=60)
    out = str(tmp_path / "out")
    raw = tables.raw_documents(spark, SF)
    made = pipeline.build_tables(spark, raw, hashing_encoder(128), cfg, out)
    lookup = made["story_lookup"].collect()
    assert len(lookup) == 60 and sorted(r.embedding_row for r in lookup) == list(range(60))
    assert made["scored_articles"].select("story_key").distinct().count() == 60
    index = made["regional_topic_index"]
    assert index.count() % len(cfg.panel_topics) == 0
    places = spark.createDataFrame([("SRC1",), ("nowhere",)], "name string")
    pipeline.write_results(index, made["scored_articles"], cfg, f"{out}/results", places)
    assert pipeline.is_complete(spark, f"{out}/cleaned_articles") and not pipeline.is_complete(spark, f"{out}/nothing")
    for name in ("candidate_summary", "candidate_profile", "vector_profile", "story_score_summary", "scoring_profile", "stage_losses"):
        assert spark.read.json(f"{out}/{name}").count() >= 1
    assert made["scored_articles"].columns == scoring.SCORED_COLUMNS
    labels = readers.read_result_csv(spark, f"{out}/results/leader_label_places", "region_key string, name string, label string")
    assert {r.name: r.label for r in labels.collect()}["nowhere"] == "No positive topic signal"
    before = made["cleaned_articles"].inputFiles()
    again = pipeline.build_tables(spark, raw, hashing_encoder(128), cfg, out, reuse=True)
    assert again["cleaned_articles"].inputFiles() == before
    with pytest.raises(ValueError):
        readers.require_rows(index.limit(0), "empty")


def test_all_boundaries_are_written_by_many_tasks(spark, tmp_path):
    from pressgauge.plans.catalog import write_boundaries

    places = spark.createDataFrame(
        [(f"r{i}", "Point" if i % 4 == 2 else None if i % 4 == 3 else "Polygon", "[0,0]" if i % 4 == 2 else None if i % 4 == 3 else "[[[0,0],[1,0],[0,0]]]") for i in range(40)],
        "name string, geometry_type string, coordinates string",
    ).repartition(4)
    write_boundaries(places, str(tmp_path / "g"))
    assert len(list((tmp_path / "g").glob("part*"))) == 4
    back = readers.read_boundaries(spark, str(tmp_path / "g"), lines=True)
    assert sorted(back.collect(), key=str) == sorted(places.collect(), key=str)
    assert readers.outer_rings(back).count() == 20


class Counted:
    """A frame whose column `name` counts how often it is computed."""

    def __init__(self, df, name):
        self.times = df.sparkSession.sparkContext.accumulator(0)
        times = self.times

        @F.udf("string")
        def seen(value):
            times.add(1)
            return value

        self.df = df.withColumn(name, seen.asNondeterministic()(name))


def test_raw_texts_are_read_once(spark, tmp_path):
    cfg = tables.DOC_MODEL_SETTINGS
    raw = stage(tables.raw_documents(spark, SF), "raw")
    counted = Counted(raw, "article_text")
    made = pipeline.build_tables(spark, counted.df, hashing_encoder(64), cfg, str(tmp_path / "out"))
    assert counted.times.value == raw.count()
    report = spark.read.json(str(tmp_path / "out/cleaning_report")).first()
    flags = cleaning.derive_flags(raw, cfg)
    plain = cleaning.cleaning_report(flags, raw.columns, made["cleaned_articles"], cfg)
    plain.write.json(str(tmp_path / "plain"))
    assert report == spark.read.schema(spark.read.json(str(tmp_path / "out/cleaning_report")).schema).json(str(tmp_path / "plain")).first()
    summary = spark.read.json(str(tmp_path / "out/candidate_summary")).first().asDict()
    assert summary == candidates.candidate_summary(candidates.flag_candidates(made["cleaned_articles"], cfg)).first().asDict()


def files_read(df):
    """Files that the scans of a collected frame have read."""
    plan = df._jdf.queryExecution().executedPlan()
    waiting, total = [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan], 0
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numFiles").value()
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_examples_of_a_stored_table_read_few_files(spark, tmp_path):
    cfg = tables.DOC_SETTINGS.with_(example_rows=2)
    articles = cleaning.clean_articles(tables.raw_documents(spark, SF), cfg)
    articles.repartition(12).write.parquet(str(tmp_path / "a"))
    written = spark.read.parquet(str(tmp_path / "a"))
    found = cleaning.example_rows(written, cfg)
    assert found.collect() == cleaning.example_rows(articles, cfg).collect()
    assert len(list((tmp_path / "a").glob("part*"))) == 12 and files_read(found) <= cfg.example_rows


def test_reuse_notices_settings_files_and_encoder(spark, tmp_path):
    cfg, out = tables.DOC_MODEL_SETTINGS, str(tmp_path / "out")
    tables.raw_documents(spark, SF).repartition(3).write.parquet(str(tmp_path / "raw"))
    names = ("cleaned_articles", "story_lookup", "story_embeddings", "story_scores", "regional_topic_index")

    def build(cfg, encoder):
        made = pipeline.build_tables(spark, spark.read.parquet(str(tmp_path / "raw")), encoder, cfg, out, reuse=True)
        return {name: sorted(made[name].inputFiles()) for name in names}

    first = build(cfg, hashing_encoder(64))
    assert build(cfg, hashing_encoder(64)) == first
    other = build(cfg, hashing_encoder(32))
    assert [n for n in names if other[n] == first[n]] == ["cleaned_articles", "story_lookup"]
    changed = build(cfg.with_(text_min_length=cfg.text_min_length + 400), hashing_encoder(32))
    assert not [n for n in names if changed[n] == other[n]]
    file = next((tmp_path / "raw").glob("part-00001*"))
    spark.read.parquet(str(file)).limit(20).coalesce(1).write.parquet(str(tmp_path / "less"))
    file.write_bytes(next((tmp_path / "less").glob("part*")).read_bytes())
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    spark.catalog.clearCache()
    again = build(cfg.with_(text_min_length=cfg.text_min_length + 400), hashing_encoder(32))
    assert not [n for n in names if again[n] == changed[n]]
    # an encoder without a name, and input from no files, are never trusted
    plain = hashing_encoder(32)
    assert pipeline.encoded_origin("key", plain) and pipeline.encoded_origin("key", lambda *a: plain(*a)) is None
    assert pipeline.origin(spark.createDataFrame([(1,)], "x int"), cfg) is None
    assert not pipeline.is_current(spark, None, f"{out}/cleaned_articles")
