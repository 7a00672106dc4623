"""Queries over whole tables: nothing of the input is left out."""

from lumitide import queries as core
from lumitide.queries import views

SF = "/root/testdata/sf0.001"


def test_all_samples_are_mixed_and_concatenated(spark):
    pcm = views.samples(spark, SF)
    n, clips = pcm.count(), pcm.select("clip_id").distinct().count()
    mixed = core.queries()["mix_two"](spark, SF).selectExpr("i div 64 AS clip", "i % 64 AS at")
    assert mixed.select("clip").distinct().count() == clips and mixed.agg({"at": "max"}).first()[0] == 33
    both = core.queries()["concat_audio"](spark, SF)
    assert both.count() == 2 * n and both.select("source").distinct().count() == clips


def test_regions_of_all_subjects_at_all_hours(spark):
    users = views.masks(spark, SF).where("not occluded").select("subject").distinct().count()
    got = core.queries()["mask_regions_hold"](spark, SF)
    assert got.select("subject").distinct().count() == users and got.select("at_us").distinct().count() == 720
    assert core.queries()["union_roi"](spark, SF).select("at_us").distinct().count() == 720


def test_all_frames_are_concatenated_and_run(spark):
    frames = views.frames(spark, SF).count()
    assert core.queries()["concat_clips"](spark, SF).count() == 2 * frames
    vectors = views.table(spark, SF, "embeddings").count()
    assert core.queries()["graph_run"](spark, SF).count() == 2 * vectors and core.queries()["plan_run"](spark, SF).count() == vectors
