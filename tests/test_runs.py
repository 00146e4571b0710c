"""Shards, checkpoints, resumed runs, jobs, archives."""

import hashlib
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import cli
from parley.functions import images, text
from parley.operators import mapping
from parley.plans import jobs
from parley.sources import checkpoints, corpus
from parley.streaming import resume


def rows(spark, n=10):
    return spark.range(n).select(F.col("id").alias("row_index"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("persona"))


def test_shards(spark):
    got = [sorted(r["row_index"] for r in resume.shard(rows(spark), 3, k).collect()) for k in range(3)]
    assert got == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]
    for n, k in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            resume.shard(rows(spark), n, k)


def test_head(spark):
    assert [corpus.head(rows(spark), n).count() for n in (None, 0, 3, 99)] == [10, 0, 3, 10]


def test_checkpoint_reading(spark, tmp_path):
    p = tmp_path / "c"
    assert checkpoints.read_text(spark, str(p)).count() == 0
    p.mkdir()
    (p / "a.json").write_text('{"row_index": 0, "enhanced_description": "x"}\n\n{"row_index": 2, "enhanced_description": "é"}\n{"row_index": 0, "enhanced_description": "y"}\n')
    assert dict(map(tuple, checkpoints.read_text(spark, str(p)).collect())) == {0: "y", 2: "é"}
    (p / "b.json").write_text('{"row_index": 1}\n')
    with pytest.raises(Exception, match="malformed checkpoint line 1"):
        checkpoints.read_text(spark, str(p)).collect()


def stub(crash_at=None):
    """A model; nested, since workers cannot import this file."""

    def build():
        def predict(prompt):
            if prompt.endswith("p3"):
                raise RuntimeError("no")
            if crash_at is not None and prompt.endswith(f"p{crash_at}"):
                import os

                os._exit(1)  # the worker dies
            return f"<answer>{prompt[-2:]}!</answer>"

        return predict

    return build


build = stub()


def test_text_run_resumes_and_falls_back(spark, tmp_path):
    p, df = str(tmp_path / "c"), rows(spark)
    assert resume.run_text(df, "persona", text.text_prompt, build, p, limit=4) == {"rows": 4, "failed": 1}
    with pytest.raises(ValueError, match="Missing 6"):
        resume.merge_text(df, p)
    with pytest.raises(ValueError, match=r"Missing checkpoint for shards: \[4, 5, 6\]"):
        resume.merge_text(df, p, shards=7)
    resume.run_text(df, "persona", text.text_prompt, build, p, shards=2, index=1)
    resume.run_text(df, "persona", text.text_prompt, build, p, shards=3, index=None)
    got = {r["row_index"]: r["enhanced_persona_revised"] for r in resume.merge_text(df, p).collect()}
    assert len(got) == 10 and got[1] == "p1!" and got[3] == text.TEXT_PROMPT + "p3"
    assert checkpoints.read_lines(spark, p, checkpoints.TEXT).count() == 10
    resume.run_text(df, "persona", text.text_prompt, build, p, limit=2, force=True)
    assert checkpoints.read_text(spark, p).count() == 2


def test_a_dead_worker_loses_the_open_chunk_only(spark, tmp_path):
    p = str(tmp_path / "c")
    df = rows(spark, 120).coalesce(1)
    with pytest.raises(Exception):  # noqa: B017
        resume.write_texts(df, F.col("persona"), stub(117), p)
    assert {r["row_index"] for r in checkpoints.read_text(spark, p).collect()} == set(range(100))
    assert resume.run_text(df, "persona", text.text_prompt, build, p)["rows"] == 20
    assert resume.merge_text(df, p).count() == 120


def test_shards_are_tasks(spark):
    d = resume.fanned_out(rows(spark, 20), 4).withColumn("task", F.spark_partition_id())
    assert {(r["row_index"] % 4, r["task"]) for r in d.collect()} == {(k, k) for k in range(4)}


def test_plain_cleaning_is_the_columns(spark):
    texts = ["<answer> a  b</ANSWER>", "<think>x\ny</think>z", "a\u3000b\u4e00c", "</think>q", "", " \u001c x", "no < tags >"]
    d = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in d.select(text.clean_output(F.col("t"))).collect()] == [text.clean_text(x) for x in texts]


def test_stream_resumes(spark, tmp_path):
    src, p = tmp_path / "in", str(tmp_path / "c")
    df = rows(spark)
    df.where("row_index < 5").write.parquet(str(src))
    args = (spark, str(src), "row_index long, persona string", text.text_prompt, "persona", build, p, str(tmp_path / "s"))
    resume.stream_text(*args).awaitTermination()
    df.write.mode("append").parquet(str(src))
    resume.stream_text(*args).awaitTermination()
    assert checkpoints.read_text(spark, p).count() == 10 and checkpoints.read_lines(spark, p, checkpoints.TEXT).count() == 10


PIXELS = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)


def png(kind, pixels, how=0):
    """A PNG of one filter type for all lines, by the definition of the filters."""
    import struct
    import zlib

    h, w, n = pixels.shape
    flat, body = pixels.reshape(h, w * n).astype(int), b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * n, int)
        left = np.concatenate([np.zeros(n, int), flat[y][:-n]])
        corner = np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - corner
        near = [min(((abs(p[i] - left[i]), 0, left[i]), (abs(p[i] - up[i]), 1, up[i]), (abs(p[i] - corner[i]), 2, corner[i])))[2] for i in range(w * n)]
        guess = [0 * left, left, up, (left + up) // 2, np.array(near)][how]
        body += bytes([how]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    part = lambda name, b: struct.pack(">I", len(b)) + name + b + struct.pack(">I", zlib.crc32(name + b))
    palette = part(b"PLTE", bytes(range(30))) if kind == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + palette + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def test_images_become_rgb():
    for how in range(5):
        assert (images.decode_png(png(2, PIXELS, how)) == PIXELS).all()
        alpha = np.concatenate([PIXELS, PIXELS[:, :, :1]], axis=2)
        assert (images.decode_png(images.rgb_png(png(6, alpha, how))) == PIXELS).all()
    gray = images.decode_png(images.rgb_png(png(0, PIXELS[:, :, :1])))
    assert (gray == PIXELS[:, :, :1].repeat(3, axis=2)).all()
    assert images.decode_png(images.rgb_png(png(3, np.full((2, 2, 1), 4, np.uint8))))[0, 0].tolist() == [12, 13, 14]
    assert images.rgb_png(png(2, PIXELS)) == png(2, PIXELS)

    class Holder:
        def __init__(self, found):
            self.images = found

    class Result:
        def __init__(self, found):
            self.request_output = Holder(found)

    assert images.rgb_png(Result([png(2, PIXELS)])) == images.rgb_png(Holder([png(2, PIXELS)])) == png(2, PIXELS)
    for bad in (None, b"", Result([]), Holder(None), b"GIF89a", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises((ValueError, KeyError)):
            images.rgb_png(bad)


def drawing(picture, batched=False, lose=None):
    def draw():
        def generate(prompt):
            if prompt.endswith("p2"):
                raise RuntimeError("no")
            return picture

        class Result:
            def __init__(self, k):
                self.request_id, self.images = f"{k}_x", [picture]

        def generate_all(prompts):
            if lose is not None and any(p.endswith(lose) for p in prompts):
                return []
            return [Result(k) for k in reversed(range(len(prompts)))]

        return generate_all if batched else generate

    return draw


def test_images_skip_failures_and_need_their_file(spark, tmp_path):
    folder, df = tmp_path / "o", rows(spark, 4).withColumnRenamed("persona", "persona-id")
    run = lambda: resume.run_images(df, "persona-id", text.image_prompt(F.col("`persona-id`")), drawing(png(2, PIXELS)), str(folder))
    assert run() == {"rows": 4, "failed": 1}
    read = lambda: checkpoints.read_images(spark, str(folder / "checkpoint"), str(folder / "images"))
    assert sorted(r["row_index"] for r in read().collect()) == [0, 1, 3]
    (folder / "images" / "000000001.png").unlink()
    assert sorted(r["row_index"] for r in read().collect()) == [0, 3]
    run()
    assert sorted(r["row_index"] for r in read().collect()) == [0, 1, 3]
    with pytest.raises(ValueError, match="Missing 1"):
        resume.merge_images(df, str(folder))
    merged = resume.merge_images(df, str(folder), 2).collect()
    assert {bytes(r["persona-image"]["bytes"]) for r in merged} == {png(2, PIXELS)} and len(merged) == 2


def test_batches_come_back_whole(spark, tmp_path):
    folder, df = str(tmp_path / "o"), rows(spark, 5).coalesce(1).withColumnRenamed("persona", "persona-id")
    prompt = F.col("`persona-id`")
    with pytest.raises(Exception, match="0 results of"):
        resume.run_batches(df, "persona-id", prompt, drawing(png(2, PIXELS), True, "p3"), folder, 2)
    read = lambda: sorted(r["row_index"] for r in checkpoints.read_images(spark, f"{folder}/checkpoint", f"{folder}/images").collect())
    kept = read() if (tmp_path / "o").exists() else []  # what was written stays
    assert len(kept) % 2 == 0 and 3 not in kept
    assert resume.run_batches(df, "persona-id", prompt, drawing(png(2, PIXELS), True), folder, 2) == {"rows": 5 - len(kept), "failed": 0} and read() == [0, 1, 2, 3, 4]


def test_request_order():
    class R:
        def __init__(self, i):
            self.request_id = i

    assert [r.request_id for r in resume.in_request_order([R("1_b"), R("0_a")], 2)] == ["0_a", "1_b"]
    assert resume.in_request_order(["x", "y"], 2) == ["x", "y"] and resume.request_position("12_ab_c") == 12
    for bad in ([R("0_a")], [R("0_a"), R("0_b")], [R("0_a"), R("2_b")], [R("x_1"), R("1_b")], [R(None), R("1_b")]):
        with pytest.raises(ValueError):
            resume.in_request_order(bad, 2)


def test_row_index_is_dense_and_in_order(spark):
    d = spark.range(500).select((F.col("id") * 7 % 501).alias("k"))
    got = [(r["k"], r["row_index"]) for r in corpus.with_row_index(d, ["k"], parts=7).collect()]
    assert [i for _, i in sorted(got)] == list(range(500))


def test_corpus_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(0, "a", "train"), (1, "b", "test")], "row_index long, x string, split string")
    corpus.write_corpus(d, str(tmp_path / "c"))
    assert corpus.read_back(d, str(tmp_path / "c")) == []
    assert corpus.read_back(d.withColumn("y", F.lit(1)), str(tmp_path / "c")) != []
    assert corpus.read_split(spark, str(tmp_path / "c"), d.schema, "train", ["x"], 1).count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        corpus.require_columns(d, ["z"])
    corpus.write_corpus(d.limit(1), str(tmp_path / "c"), config="small")
    assert corpus.read_back(d.limit(1), str(tmp_path / "c"), "small") == [] and corpus.read_split(spark, str(tmp_path / "c"), d.schema, config="small").count() == 1
    corpus.stage_for_review(d, str(tmp_path / "r"), "n/x", "why")
    assert spark.read.parquet(str(tmp_path / "r/data")).count() == 2 and spark.read.json(str(tmp_path / "r/request")).first()["message"] == "why"
    m = spark.createDataFrame([("c",), ("a",), ("é",), ("b",)], "persona_revised string").withColumn("persona-id", F.sha2("persona_revised", 256))
    assert [r["persona_revised"] for r in mapping.in_order(m).orderBy("row_index").collect()] == ["a", "b", "c", "é"]
    mapping.write_mapping(m, str(tmp_path / "m"))
    assert [r["persona_revised"] for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["a", "b", "c", "é"]
    known = spark.createDataFrame([("a",), (None,)], "p string")
    assert mapping.enrich_by_join(known, lambda c: c, {"i": "p"}, m).where("i is not null").count() == 1
    with pytest.raises(Exception, match="p is not in the mapping: q"):
        mapping.enrich_by_join(spark.createDataFrame([("q",)], "p string"), lambda c: c, {"i": "p"}, m).collect()
    corpus.write_single(d, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 1
    assert corpus.columns_like(d, "SPL") == ["split"] and corpus.existing_columns(d, ["x", "q"]) == ["x"]


def test_archives(spark, tmp_path):
    name = tmp_path / "a.tgz"
    with tarfile.open(name, "w:gz") as t:
        for n, body in (("./x/train.txt", "1 a"), ("x/valid.txt", "1 é")):
            data = body.encode()
            info = tarfile.TarInfo(n)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert dict(map(tuple, corpus.tar_members(spark, str(name), {"train": "x/train.txt", "validation": "./x/valid.txt"}).collect())) == {"train": "1 a", "validation": "1 é"}
    with pytest.raises(Exception, match="archive lacks"):
        corpus.tar_members(spark, str(name), {"t": "nope"}).collect()
    digest = hashlib.sha256(name.read_bytes()).hexdigest()
    assert corpus.digests(spark, str(name)).first()["sha256"] == digest == corpus.file_digest(name)
    target = tmp_path / "cache" / "a.tgz"
    corpus.fetch_archive(lambda: iter([name.read_bytes()]), target, digest)
    corpus.fetch_archive(lambda: pytest.fail("cached"), target, digest)
    target.write_bytes(b"bad")
    with pytest.raises(ValueError):
        corpus.fetch_archive(lambda: iter([b"worse"]), target, digest)
    assert [x.name for x in target.parent.iterdir()] == ["a.tgz"]


CONFIG = {
    "output_root": "o", "split": "train", "persona_id_column": "persona-id", "image_column": "img", "generation_params": {"width": 8, "seed": 1},
    "datasets": {"d": {"repo_id": "n/d", "columns": {"original": "a", "enhanced": "b"}}}, "models": {"m": {"repo_id": "x/m", "dataset_suffix": "M", "generation_params": {"seed": 2, "extra_arg": 3, "negative_prompt": "no"}}},
}


def test_jobs(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(json.dumps(CONFIG))
    table = jobs.job_table(spark, jobs.load_config(p))
    found = table.orderBy("ordinal").collect()
    assert [(j["target"], j["prompt_column"], jobs.parameters(j)["seed"], j["output"]) for j in found] == [("n/d-M-original", "a", 2, "o/n/d-M-original/images"), ("n/d-M-enhanced", "b", 2, "o/n/d-M-enhanced/images")]
    s = jobs.with_sampling(table).first()
    assert {k: s[k] for k in jobs.SAMPLING} == {"width": 8, "height": 1024, "seed": 2, "num_inference_steps": 50, "guidance_scale": 4.0, "cfg_scale": 4.0} and s["extra"] == {"extra_arg": "3"} and s["negative_prompt"] == "no"
    assert jobs.job_table(spark, CONFIG | {"models": {}}).count() == 0
    p.write_text("- 1")
    with pytest.raises(ValueError):
        jobs.load_config(p)
    assert jobs.id_list("0,1, 2") == ["0", "1", "2"]
    with pytest.raises(ValueError):
        jobs.id_list(" , ")


def test_attempts():
    class Engine:
        def __init__(self, log):
            self.log = log

        def close(self):
            self.log.append("closed")

    log, starts = [], iter([True, False, False, False])

    def start():
        if next(starts):
            raise RuntimeError("no device")
        log.append("started")
        return Engine(log)

    def run(engine, job, force):
        log.append((job, force))
        if (job, log.count((job, True)) + log.count((job, False))) == ("a", 1) or job == "c":
            raise RuntimeError("no")

    assert jobs.run_jobs(["a", "b"], start, run, force=True) == []
    assert log == ["started", ("a", True), "closed", "started", ("a", False), ("b", True), "closed"]
    log.clear()
    assert jobs.run_jobs(["c"], lambda: Engine(log), run, attempts=2) == ["c"] and log == [("c", False), "closed", ("c", False), "closed"]


def test_failures_do_not_stop_later_jobs(spark):
    table, done = jobs.job_table(spark, CONFIG).orderBy("ordinal").collect(), []

    def run(engine, job, force):
        if job["variant"] == "original":
            raise RuntimeError("no")
        done.append(job["target"])

    with pytest.raises(RuntimeError, match="n/d-M-original"):
        jobs.run_all(table, lambda job: object(), run)
    assert done == ["n/d-M-enhanced"]
    broken = CONFIG | {"datasets": {"x": {"repo_id": "x", "columns": {"original": "a", "enhanced": "b"}}}}
    with pytest.raises(RuntimeError, match="dataset without namespace"):
        jobs.run_all(jobs.job_table(spark, broken).collect(), lambda job: object(), run)


def test_command_lines(spark, tmp_path):
    """The stages from the command line, with models found by name in each worker."""
    (tmp_path / "stub_models.py").write_text("def texts(model_path=None, device=None):\n    return lambda p: '<answer>' + p[-2:] + (model_path or '') + '</answer>'\n\ndef pictures(**_):\n    import zlib\n    return lambda p: PNG\n\ndef batches(model=None, params=None):\n    return lambda ps: [PNG for _ in ps]\n\nPNG = " + repr(png(2, PIXELS)) + "\n")
    spark.sparkContext.addPyFile(str(tmp_path / "stub_models.py"))
    source = str(tmp_path / "d.parquet")
    rows(spark, 6).withColumn("persona-id", F.concat(F.lit("id"), "row_index")).withColumn("b", F.col("persona")).write.parquet(source)
    out, final = str(tmp_path / "o"), str(tmp_path / "f")
    common = ["--input", source, "--output-dir", out]
    shard = ["text", "run-shard", *common, "--column", "persona", "--model", "stub_models:texts", "--num-shards", "2", "--shard-index"]
    cli.main([*shard, "1", "--model-path", "z"], spark)
    with pytest.raises(ValueError, match=r"Missing checkpoint for shards: \[0\]"):
        cli.main(["text", "merge", *common, "--num-shards", "2", "--final-output-dir", final], spark)
    cli.main([*shard, "0"], spark)
    cli.main(["text", "merge", *common, "--num-shards", "2", "--final-output-dir", final, "--push-pr", "--target-repo-id", "n/x"], spark)
    got = {r["row_index"]: r["enhanced_persona_revised"] for r in spark.read.parquet(f"{final}/dataset").collect()}
    assert got == {k: f"p{k}" + "z" * (k % 2) for k in range(6)}
    assert spark.read.json(f"{final}/review/request").first()["target"] == "n/x" and spark.read.parquet(f"{final}/review/data").count() == 6
    cli.main(["images", "run", "--input", source, "--output-dir", out + "i", "--gpus", "0,1", "--column", "persona", "--model", "stub_models:pictures", "--final-output-dir", final + "i", "--limit", "3"], spark)
    assert spark.read.parquet(f"{final}i/dataset").count() == 3
    config = tmp_path / "c.yaml"
    config.write_text(json.dumps(CONFIG | {"output_root": str(tmp_path / "m"), "datasets": {"d": {"repo_id": "n/d", "columns": {"original": "persona", "enhanced": "b"}}}}))
    cli.main(["matrix", "--config", str(config), "--gpus", "0,1", "--data", str(tmp_path), "--model", "stub_models:batches", "--limit", "3"], spark)
    assert {spark.read.parquet(f"{tmp_path}/m/n/d-M-{v}/final/dataset").count() for v in jobs.VARIANTS} == {3}
    for bad in (["text", "run", "--gpus", " , ", *common], ["images", "merge", *common, "--num-shards", "2", "--limit", "-1"], ["matrix"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)
    with pytest.raises(ValueError, match="no model"):
        cli.loaded("stub_models_missing:x")
