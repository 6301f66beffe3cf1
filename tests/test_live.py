"""Live replies: late, repeated and shuffled lines, replies that break off, a restart from the checkpoint."""

import datetime
import random

from scriptloom.streaming import live, responses

NOON = datetime.datetime(2024, 5, 1, 12)
LINES = "response_id string, pos int, line string, at timestamp"


def reply(name, words, start, end=True):
    lines = [f'data: {{"choices": [{{"delta": {{"content": "{w} "}}}}]}}' for w in words] + (["data: [DONE]"] if end else [])
    return [(name, i, line, NOON + datetime.timedelta(seconds=start + i)) for i, line in enumerate(lines)]


def test_stream_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    whole = [reply(f"r{k}", [f"w{k}", *"abcde"[: k % 6]], start=3 * k, end=k % 4 != 3) for k in range(20)]
    whole.append([("bad", 0, "data: {broken", NOON), ("bad", 1, "data: [DONE]", NOON)])
    rows = [r for lines in whole for r in lines]
    stream = sorted(rows, key=lambda r: (r[3] + datetime.timedelta(seconds=rng.uniform(0, 20)))) + [(None, 1, "data: x", NOON), ("r1", None, "data: x", NOON)]
    stream += rng.sample(rows[-40:], 10)  # once more, late
    source, checkpoint, sink = (str(tmp_path / n) for n in ("in", "state", "out"))

    def put(part):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(source)

    def run():
        lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source)
        q = live.replies(lines, patience=45.0, lateness="60 seconds").writeStream.option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(sink)
        q.awaitTermination(150)
        assert q.exception() is None

    n = len(stream)
    for a, b in ((0, n // 3), (n // 3, n // 2)):
        put(stream[a:b])
    run()
    early = spark.read.schema(live.OUT).parquet(sink).count()
    put(stream[n // 2 :])
    put([("later", 0, "data: x", NOON + datetime.timedelta(hours=1))])  # moves the watermark on
    put([("later", 1, "data: x", NOON + datetime.timedelta(hours=1, seconds=1))])
    run()  # a new query, from the checkpoint
    got = sorted(tuple(r) for r in spark.read.schema(live.OUT).parquet(sink).collect())
    batch = {r["response_id"]: r for r in responses.sse(spark.createDataFrame(rows, LINES)).collect()}
    assert 0 < early < len(got) and [g[0] for g in got] == sorted(batch)
    for name, text, error, complete in got:
        assert text == batch[name]["text"] and (error is None) == (batch[name]["error"] is None)
        assert complete == (name == "bad" or int(name[1:]) % 4 != 3)


def test_end_marks():
    assert live._sse_ends(" data: [DONE] ") and not live._sse_ends("[DONE]")
    assert live._ndjson_ends('{"done": true}') and not any(map(live._ndjson_ends, ('{"done": false}', "x", "[]", "")))
