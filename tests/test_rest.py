"""Continuity, caches, reports, streams of lines, servers, media and the whole analysis."""

import base64
import io
import json
import os
import uuid
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from scriptloom import cli
from scriptloom.errors import BackendError, ConfigurationError, ExternalToolError, ModelOutputError
from scriptloom.functions import numbers as N
from scriptloom.operators import continuity as K
from scriptloom.operators import memo, render
from scriptloom.plans import analysis, catalog, windows
from scriptloom.schema import CHUNK
from scriptloom.sources import backends, media, prompts, sinks
from scriptloom.sources.publish import there
from scriptloom.streaming import responses

SF = "/root/testdata/sf0.001"


def test_continuity_same_in_python_and_spark(spark):
    chunks = catalog.conversation_chunks(spark, SF)
    rows = K.with_continuity(chunks).orderBy("media_id", "index").collect()
    before = {}
    for r in rows:
        past = before.setdefault(r["media_id"], [])
        assert r["continuity"] == K.continuity(past)
        past.append(r.asDict(recursive=True))


def test_memo(spark):
    work = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    cache = spark.createDataFrame([(1, "old"), (1, "old")], "k int, v string")
    assert sorted(str(r["k"]) for r in memo.pending(work, cache, ["k"]).collect()) == ["2", "None"]
    whole, fresh = memo.resumed(work, cache.distinct(), ["k"], lambda d: d.withColumn("v", F.lit("new")), lambda d: d.withColumn("v", F.upper("v")))
    assert sorted(r["v"] for r in whole.collect()) == ["OLD", "new", "new"] and fresh.count() == 2
    a = spark.range(1).select(N.stable_key(x=F.lit("ä"), y=F.lit(None).cast("int"))).first()[0]
    assert len(a) == 16


def test_report(spark):
    kind = spark.createDataFrame([], CHUNK).schema
    seg = {"start": 1.0, "end": 2.0, "speaker": "A", "text": "Hi.", "translation": None, "inferred_timestamp": None}
    audio = {k: None for k in kind["audio"].dataType.names}
    visual = {"summary": "Sum", "shots": [{"start": 0.0, "end": 1.0, "description": "Door", "visible_text": ["EXIT"]}], "people": [], "objects": [" "], "setting": None}
    rows = [
        ("m", 0, 0.0, 30.0, audio | {"transcript": "Hi.", "segments": [seg], "non_speech_audio": ["bang"]}, visual),
        ("m", 1, 28.0, 30.0, audio | {"transcript": "One two. Three four.", "translation": "T", "segments": [seg | {"text": "One two."}]}, None),
        ("m", 2, 56.0, 4.0, audio | {"transcript": "Alone."}, None),
    ]
    chunks = spark.createDataFrame(rows, kind)
    docs = spark.createDataFrame([("m", "a.mp4", "video", 60.0, "none", "none")], "media_id string, source string, media_type string, duration_seconds double, backend string, model string")
    text = render.markdown(docs, chunks).first()["markdown"]
    assert text.index("`00:00:00.000` **Visual:** Door Visible text: EXIT") < text.index("`00:00:01.000` **A:** Hi.")
    assert text.count("One two. Three four.") == 1 and "*Translation:* T" in text and "**Transcript:** Alone." in text and "**Non-speech audio:** bang" in text
    assert "Objects" not in text and text.endswith("Alone.\n") and text.startswith("# Video Analysis\n")
    assert len(json.loads(render.documents_json(docs, chunks).first()["json"])["chunks"]) == 3


def test_streams(spark):
    chat = lambda c: "data: " + json.dumps({"choices": [{"delta": {"content": c}}]})
    lines = [": ping", "", chat("hello "), chat([{"type": "text", "text": "wor"}, "ld"]), "data: [DONE]", "data: broken"]
    assert responses.read_sse(x.encode() for x in lines) == "hello world"
    assert responses.read_ndjson(['{"message": {"content": "a"}}', " ", '{"message": {}}', '{"message": {"content": "b"}, "done": true}']) == "ab"
    for bad in ("data: {", 'data: {"error": "no"}'):
        with pytest.raises(BackendError):
            responses.read_sse([bad])
    table = [("a", i, x) for i, x in enumerate(lines)] + [("b", 0, "data: {"), ("c", 0, 'data: {"error": "no"}'), ("d", 0, ": x")]
    got = {r["response_id"]: r for r in responses.sse(spark.createDataFrame(table, "response_id string, pos int, line string")).collect()}
    assert got["a"]["text"] == "hello world" and got["b"]["text"] is None and got["c"]["error"] == "no" and got["d"]["text"] == ""


class Reply(io.BytesIO):
    def __iter__(self):
        return iter(self.getvalue().splitlines(keepends=True))


def opener(replies, seen):
    def open_(request, timeout):
        seen.append((request.get_method(), request.full_url, json.loads(request.data) if request.data else None))
        if request.get_method() == "GET":
            return Reply(b"ok")
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return Reply(json.dumps({"choices": [{"message": {"content": reply}}]}).encode())

    return open_


def test_visual_retry_and_prompt_order(tmp_path):
    picture = tmp_path / "f.jpg"
    picture.write_bytes(b"x")
    seen = []
    server = backends.ChatServer("m", "http://h:1/v1/", stream=False, opener=opener(['{"shots": [', '{"summary": "ok", "shots": []}'], seen))
    got = server.describe("v", start=0.0, seconds=30.0, frames=[str(picture)], transcript="said", continuity=None, user_context="ctx")
    posts = [s for s in seen if s[0] == "POST"]
    assert got["summary"] == "ok" and [p[2]["max_tokens"] for p in posts] == [4096, 6144] and posts[0][1] == "http://h:1/v1/chat/completions"
    parts = posts[0][2]["messages"][1]["content"]
    assert [p["type"] for p in parts] == ["image_url", "text"] and parts[1]["text"].index("ctx") < parts[1]["text"].index("said")


def test_audio_has_no_retry_and_prompt_first(tmp_path):
    sound = tmp_path / "a.wav"
    sound.write_bytes(b"x")
    seen = []
    server = backends.ChatServer("m", stream=False, opener=opener(["{"], seen))
    with pytest.raises(ModelOutputError):
        server.transcribe(str(sound), start=0.0, seconds=30.0)
    assert [p["type"] for p in seen[-1][2]["messages"][1]["content"]] == ["text", "input_audio"] and len(seen) == 2


def test_transport(tmp_path):
    calls = []

    def failing(error):
        def open_(request, timeout):
            calls.append(request.get_method())
            raise error

        return open_

    for error, posts, gets in ((URLError("x"), 1, 3), (HTTPError("u", 503, "busy", {}, io.BytesIO(b"")), 3, 3), (HTTPError("u", 400, "bad", {}, io.BytesIO(b"")), 1, 1)):
        client = backends.JsonClient("http://h", opener=failing(error), sleep=lambda s: None)
        for ask, n in ((lambda: client.post("/p", {}, str), posts), (lambda: client.get("/g"), gets)):
            calls.clear()
            with pytest.raises(BackendError):
                ask()
            assert len(calls) == n


def test_media(spark, tmp_path):
    got = {r["name"]: r for r in catalog.media_probe(spark, SF).limit(0).collect()}
    assert got == {}
    cover = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 9, "disposition": {"attached_pic": 1}}], "format": {"duration": "12.5"}}
    row = media.probed(spark.createDataFrame([(json.dumps(cover),), ("{}",)], "probe string")).collect()
    assert row[0]["media_type"] == "audio" and row[0]["width"] == 0 and row[0]["duration_seconds"] == 12.5 and row[1]["error"]
    calls = media.decode_commands("ffmpeg", "in", 28.0, 30.0, "v.mp4", "a.wav", 1.0, 721)
    assert len(calls) == 2 and calls[0].index("-ss") < calls[0].index("-i") and "720" in " ".join(calls[0]) and "16000" in calls[1]
    with pytest.raises(ConfigurationError):
        media.decode_commands("ffmpeg", "in", 0, 1, "v", None, 0, 720)
    with pytest.raises(ConfigurationError):
        media.require("no-such-tool-at-all")


def test_analysis(spark):
    class Fake:
        def load(self):
            pass

        def transcribe(self, audio, *, start, seconds, language, translate_to):
            return {"transcript": f"hello from {os.path.basename(audio)}", "segments": []}

        def describe(self, video, *, start, seconds, frames, transcript, continuity, user_context):
            return {"summary": f"{user_context}|{transcript}|{len(continuity)}", "shots": [{"start": start, "end": start + 1, "description": "d"}]}

    info = spark.createDataFrame([("m", "a.mp4", "video", 60.0), ("n", "b.wav", "audio", 20.0)], "media_id string, source string, media_type string, duration_seconds double")
    chunks = spark.createDataFrame([("m", i, 28.0 * i, 30.0, "v", f"x{i}.wav", None) for i in range(2)] + [("n", 0, 0.0, 20.0, None, None, None)], "media_id string, index int, start_seconds double, duration_seconds double, video_path string, audio_path string, frame_paths array<string>")
    config = analysis.Config("out", backend="llama-cpp", user_context=" be  brief ", source_language="en")
    docs, whole = analysis.analyze(info, chunks, config, Fake)
    rows = {(r["media_id"], r["index"]): r for r in whole.collect()}
    assert rows["m", 0]["visual"]["summary"].endswith("|0") and not rows["m", 1]["visual"]["summary"].endswith("|0") and rows["m", 1]["visual"]["summary"].startswith("be brief|")
    assert rows["n", 0]["audio"]["language"] == "en" and rows["n", 0]["visual"]["shots"] == []
    got = {r["media_id"]: r for r in docs.collect()}
    assert "x0" in got["m"]["transcript"] and got["n"]["transcript"] == "" and got["n"]["translation"] is None


def test_analysis_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Fake:
        def transcribe(self, audio, *, start, seconds, language, translate_to):
            (calls / f"audio-{uuid.uuid4().hex}").touch()
            return {"transcript": f"said at {start}", "segments": []}

        def describe(self, video, *, start, seconds, frames, transcript, continuity, user_context):
            (calls / f"visual-{uuid.uuid4().hex}").touch()
            return {"summary": f"{user_context} {start}", "shots": [{"start": start, "end": start + 1, "description": "d"}]}

    info = spark.createDataFrame([("m", "a.mp4", "video", 60.0)], "media_id string, source string, media_type string, duration_seconds double")
    chunks = spark.createDataFrame([("m", i, 28.0 * i, 30.0, "v", f"x{i}.wav", None) for i in range(2)], "media_id string, index int, start_seconds double, duration_seconds double, video_path string, audio_path string, frame_paths array<string>")

    def asked(context, **more):
        before = sorted(p.name for p in calls.iterdir())
        config = analysis.Config("out", backend="llama-cpp", user_context=context, **more)
        _, whole = analysis.analyze(info, chunks, config, Fake, cache=str(tmp_path / "cache"))
        rows = sorted(whole.collect(), key=lambda r: r["index"])
        assert [r["visual"]["summary"] for r in rows] == [f"{context} 0.0", f"{context} 28.0"]
        new = {p.name for p in calls.iterdir()} - set(before)
        return sum(n.startswith("audio") for n in new), sum(n.startswith("visual") for n in new)

    assert asked("one") == (2, 2)
    assert asked("one") == (0, 0)
    assert asked("two") == (0, 2)  # a changed context asks for pictures alone
    assert asked("two", seed=8) == (2, 2)
    for file in (tmp_path / "cache").rglob("*.json"):
        file.write_text("{")  # broken files count as missing
    assert asked("one") == (2, 2) and not list((tmp_path / "cache").rglob("*.part"))


@pytest.mark.parametrize("bad", [{"backend": "x"}, {"chunk_seconds": 31}, {"fps": 0}, {"max_edge": 100}, {"max_new_tokens": 1}, {"context_size": 1}, {"timeout_seconds": 0}, {"media_mode": "x"}, {"backend": "ollama", "media_mode": "file-url"}])
def test_config(bad):
    with pytest.raises(ConfigurationError):
        analysis.Config("out", **bad).validate()


def test_cli(capsys):
    args = cli.parser().parse_args(["analyze", "a.mp4", "--context", "talk"])
    assert cli.config_of(args).user_context == "talk"
    assert cli.main(["prepare", "/no/such/file"]) == 2 and "error:" in capsys.readouterr().err


def test_prompts():
    assert "null" in prompts.audio_prompt(None, None, 30) and "30.000" in prompts.audio_prompt("en", "de", 30)
    assert "Context" not in prompts.visual_prompt(30.0, 30) and "1.000" in prompts.visual_prompt(30.0, 30)


def test_command_line_offers_no_backend_that_is_not_there():
    import pytest

    from scriptloom.cli import config_of, parser

    for name in ("llama-cpp", "ollama"):
        assert config_of(parser().parse_args(["analyze", "x", "--backend", name, "--model", "m"])).analyzer()
    with pytest.raises(SystemExit):
        parser().parse_args(["analyze", "x", "--backend", "transformers"])


def test_media_files_end_to_end(spark, tmp_path):
    """Probing, decoding and pictures with a stand-in for the external tools."""
    calls = tmp_path / "calls"
    calls.mkdir()
    reply = json.dumps({"streams": [{"index": 0, "codec_type": "video", "width": 4, "height": 2, "disposition": {"attached_pic": 0}}, {"index": 1, "codec_type": "audio"}], "format": {"duration": "40.5"}})

    def fake(command):
        (calls / uuid.uuid4().hex).write_text(json.dumps(command))
        if command[0] == "ffprobe":
            return reply
        target = command[-1]
        for name in [target.replace("%06d", f"{i:06d}") for i in (2, 1)] if "%06d" in target else [target]:
            with open(name, "w") as f:
                f.write("x")
        return ""

    source = tmp_path / "talk one.mp4"
    source.write_text("x")
    files = media.media_files(spark, str(source)).withColumns({"media_id": F.lit("m"), "source": F.lit(str(source))})
    info = media.probed(media.probe_files(files, run=fake))
    row = info.first()
    assert (row["duration_seconds"], row["width"], row["has_audio"], row["has_video"], row["error"]) == (40.5, 4, True, True, None)
    plan = windows.plan_chunks(info.drop("modified"), chunk=30.0, overlap=2.0)
    out = media.decode_chunks(plan, str(tmp_path / "chunks"), run=fake).orderBy("index").collect()
    assert [os.path.basename(r["audio_path"]) for r in out] == ["chunk-000000.wav", "chunk-000001.wav"] and [len(r["frame_paths"]) for r in out] == [2, 2]
    assert out[0]["frame_paths"] == sorted(out[0]["frame_paths"]) and all(there(p) for r in out for p in (r["audio_path"], r["video_path"], *r["frame_paths"]))
    asked = [json.loads(p.read_text()) for p in calls.iterdir()]
    sound = [c for c in asked if c[-1].endswith(".wav")]
    assert len(sound) == 2 and sorted(c[c.index("-ss") + 1] for c in sound) == ["0.000000", "28.000000"] and all("16000" in c for c in sound)
    n = len(asked)
    media.decode_chunks(plan, str(tmp_path / "chunks"), run=fake).collect()
    again = [json.loads(p.read_text())[0] for p in calls.iterdir()]
    assert again.count("ffmpeg") == sum(c[0] == "ffmpeg" for c in asked) and len(again) >= n  # finished files are used again
    told = media.manifest(media.decode_chunks(plan, str(tmp_path / "chunks"), run=fake), ["source", "size"], ["duration_seconds", "has_video"], ["start_seconds", "video_path"]).first()
    made = json.loads(told["manifest"])
    assert made["preparation"] == {"source": str(source), "size": 1} and [c["start_seconds"] for c in made["chunks"]] == [0.0, 28.0]

    def broken(command):
        return "" if "%06d" in command[-1] else fake(command)

    with pytest.raises(Exception, match="no usable pictures"):
        media.decode_chunks(plan, str(tmp_path / "other"), run=broken).collect()
    with pytest.raises(ExternalToolError, match="false failed"):
        media.run_tool(["false"])


def test_urls(spark):
    df = spark.createDataFrame([("/r/a b/c?.jpg", bytearray(b"x" * 60)), (None, None)], "path string, content binary")
    rows = df.select(media.image_url("file-url", F.col("path"), F.col("content"), "/r").alias("u"), media.image_url("base64", F.col("path"), F.col("content"), None).alias("b")).collect()
    assert rows[0]["u"] == "file://a%20b/c%3F.jpg" and rows[0]["b"] == "data:image/jpeg;base64," + base64.b64encode(b"x" * 60).decode() and rows[1]["u"] is None
    with pytest.raises(Exception, match="outside the media root"):
        df.select(media.file_url(F.col("path"), "/elsewhere")).collect()


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("/x/one.mp4", "# One\n", '{"a": 1}'), ("/x/two.wav", "# Two\n", '{"a": 2}')], "source string, markdown string, json string")
    sinks.write_reports(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.analysis.json", "one.analysis.md", "two.analysis.json", "two.analysis.md"]
    assert sinks.read_json(tmp_path / "out" / "two.analysis.json") == {"a": 2} and (tmp_path / "out" / "one.analysis.md").read_text() == "# One\n"
    same = spark.createDataFrame([("/x/one.mp4", "# One\n", "{}"), ("/y/one.wav", "# Other\n", "{}"), ("/y/.hidden", "# H\n", "{}")], "source string, markdown string, json string")
    sinks.write_reports(same, str(tmp_path / "same"))
    assert sorted(p.read_text() for p in (tmp_path / "same").glob("*.md")) == ["# H\n", "# One\n", "# Other\n"] and (tmp_path / "same" / ".hidden.analysis.md").exists()
    with pytest.raises(ConfigurationError):
        sinks.staged(type("F", (), {"sparkSession": type("S", (), {"conf": {"x": 1}, "sparkContext": type("C", (), {"master": "yarn"})})})())


def test_command_line_end_to_end(spark, tmp_path, monkeypatch, capsys):
    """Bad media end with code 2; good ones give their files, and documents tell their settings."""
    source = tmp_path / "talk.wav"
    source.write_text("x")
    replies = {"good": '{"streams": [{"codec_type": "audio"}], "format": {"duration": "40"}}', "bad": '{"streams": [], "format": {}}'}
    monkeypatch.setattr(media, "require", lambda tool: tool)

    class Fake:
        def transcribe(self, audio, *, start, seconds, language, translate_to):
            return {"transcript": "gamma delta" if start else "alpha beta", "segments": []}

    decode = lambda plan, folder, fps, edge: plan.withColumns({"video_path": F.lit(None).cast("string"), "audio_path": F.lit("a.wav"), "frame_paths": F.array().cast("array<string>")})
    monkeypatch.setattr(media, "decode_chunks", decode)
    monkeypatch.setattr(analysis.Config, "analyzer", lambda self: Fake())
    for kind, code in (("bad", 2), ("good", 0)):
        monkeypatch.setattr(media, "probe_files", lambda files, kind=kind: files.withColumn("probe", F.lit(replies[kind])))
        assert cli.main(["analyze", str(source), "-o", str(tmp_path / "out"), "--context", " my  talk "]) == code
        assert ("no audio or video stream" in capsys.readouterr().err) == (kind == "bad")
    made = json.loads((tmp_path / "out" / "talk.analysis.json").read_text())
    settings = json.loads(made["settings"]) if isinstance(made["settings"], str) else made["settings"]
    assert made["transcript"] == "alpha beta gamma delta" and settings["user_context"] == "my talk" and {"audio_segment_version", "audio_timestamp_version", "visual_context_version"} <= set(settings)
    assert "gamma delta" in (tmp_path / "out" / "talk.analysis.md").read_text()
    assert cli.said("a\n  File x\nscriptloom.errors.BackendError: no answer\n") == "no answer" and cli.said("first\nsecond") == "first"
