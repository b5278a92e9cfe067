import json
import random
import subprocess
import sys

from pyspark.sql import functions as F

from skald.api import Conversation
from skald.operators import importance
from skald.sources.jsonl import detect, detect_adapter, numbered_lines, read_log
from skald.sources.store import StateStore
from skald.sources.tail import ByteRange, last_line_end, read_lines
from skald.streaming.pipeline import follow, index_batch

TEXTS = ["We decided on redis", "the redis is slow", "Actually, use kafka", "moving on", "ok", "we're using kafka for queues", "not a, but b", "the plan is kafka"]


def lines(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(json.dumps({"id": f"m{i}", "role": r.choice(["user", "assistant"]), "content": r.choice(TEXTS) + " é" * r.randrange(3), "timestamp": f"2026-01-01T00:{i // 60:02}:{i % 60:02}.000Z"}, ensure_ascii=False))
        if r.random() < 0.1:
            out.append(r.choice(["", "{bad", '{"id":1}', out[-1]]))
    return out


def test_lines_of_byte_ranges(tmp_path):
    path = tmp_path / "log"
    text = "\n".join(["é" * (i % 7) for i in range(200)]) + "\npartial"
    path.write_text(text)
    size = len(text.encode())
    for step in (1, 7, 64, size):
        got = [x for a in range(0, size, step) for x in read_lines(str(path), ByteRange(a, min(a + step, size)))]
        assert [v for _, v in got] == text.split("\n")
    assert last_line_end(str(path)) == size - len("partial") and last_line_end(str(tmp_path / "none")) == 0


def test_numbered_lines_of_several_splits(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sorted((r.offset, r.value) for r in numbered_lines(spark, str(path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [int(v.split()[1]) for _, v in rows] == list(range(3000)) and len({o for o, _ in rows}) == 3000


def run(spark, log, state):
    q = follow(spark, str(log), str(state), "s1", mode="catchup")
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    all_lines = lines(90)
    data = ("\n".join(all_lines) + "\n").encode()
    log, state = tmp_path / "log.jsonl", tmp_path / "state"
    log.write_bytes(b"")
    at = 0
    for step in (1500, 2111, 1, len(data)):
        with log.open("ab") as f:
            f.write(data[at : at + step])
        at += step
        run(spark, log, state)
    run(spark, log, state)  # nothing new
    store = StateStore(spark, str(state))
    rows = store.read("messages").collect()
    assert sorted(x.id for x in rows) == sorted(f"m{i}" for i in range(90))
    batch = importance.score(read_log(spark, str(log), "s1"))
    expected = {x.id: (x.state_delta, x.reference_frequency, x.trajectory_discontinuity, x.total) for x in batch.collect()}
    # history is bounded by what the model looks back on, so piecewise scores are those of one pass
    assert {x.id: (x.importance_state_delta, x.importance_reference_freq, x.importance_trajectory_disc, x.importance_total) for x in rows} == expected
    entities = {x.id: x.reference_count for x in store.read("entities").collect()}
    assert sum(entities.values()) == sum(len(x.entity_ids) for x in rows) > 0
    chat = Conversation(spark, str(state), "s1")
    status = json.loads(chat.call("get_status")["content"])
    assert status["messages"] == 90 and status["entities"] == len(entities) and status["decisions"] > 0 and status["tombstones"] > 0
    recent = json.loads(chat.call("get_recent_messages", {"n": 0})["content"])
    assert [x["id"] for x in recent] == [f"m{i}" for i in range(89, 79, -1)]
    assert "## Entities" in chat.get_context_frame() and "## Recent Messages" in chat.get_context_frame()
    store.add_relations(spark.createDataFrame([(1, "redis", "kafka", "feeds", "t", "t")] * 2, store.read("entity_relations").schema), 0)
    chat.index_relation("redis", "kafka", "feeds")
    assert chat.get_session() == {"id": "s1", "started_at": min(x.timestamp for x in rows), "ended_at": max(x.timestamp for x in rows), "message_count": 90}
    answer = json.loads(chat.call("search_conversation", {"query": "is redis slow", "k": 8})["content"])
    assert len(answer["results"]) == 8 and answer["stats"]["relations"] == 1
    assert {x["type"] for x in answer["results"]} >= {"message"} and any("Context: " in x["content"] for x in answer["results"])
    assert chat.call("get_entities")["content"] != "[]" and chat.call("get_decisions")["content"] != "[]" and chat.call("get_corrections")["content"] != "[]"
    assert chat.call("nothing") == {"content": "Unknown tool: nothing", "isError": True} and chat.call("search_conversation")["isError"]
    assert chat.get_important_messages(3).count() == 3 and chat.get_relations("redis").count() == 1 and chat.search_similar("kafka", 2).count() == 2


def test_late_rows_score_alike_in_batch_and_stream(spark, tmp_path):
    rows = [json.loads(x) for x in lines(60, 5) if x.startswith('{"id": "')]
    r = random.Random(2)
    for x in r.sample(rows, 15):
        x["timestamp"] = f"2025-12-31T{r.randrange(24):02}:00:00.000Z"
    log, state = tmp_path / "log.jsonl", tmp_path / "state"
    for a, b in ((0, 20), (20, 21), (21, len(rows))):
        with log.open("a") as f:
            f.write("".join(json.dumps(x) + "\n" for x in rows[a:b]))
        run(spark, log, state)
    found = {x.id: x.importance_total for x in StateStore(spark, str(state)).read("messages").collect()}
    assert found == {x.id: x.total for x in importance.score(read_log(spark, str(log), "s1")).collect()} and len(found) == len({x["id"] for x in rows})


def test_repeated_micro_batches_write_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i}", f"s{i % 3}", i, "user", TEXTS[i % 8], f"t{i:02}", False) for i in range(24)], "id string, session_id string, seq bigint, role string, content string, timestamp string, has_tool boolean")
    store = StateStore(spark, str(tmp_path / "state"))
    for batch, some in ((0, rows.filter("seq < 10")), (1, rows.filter("seq >= 8")), (1, rows.filter("seq >= 8")), (2, rows)):
        index_batch(some, store, batch)
    assert sorted(x.id for x in store.read("messages").collect()) == sorted(f"m{i}" for i in range(24))
    assert {x.id: x.message_count for x in store.read("sessions").collect()} == {"s0": 8, "s1": 8, "s2": 8}
    once = StateStore(spark, str(tmp_path / "once"))
    index_batch(rows, once, 0)
    for table in ("messages", "entities", "decisions"):
        assert sorted(map(str, store.read(table).collect())) == sorted(map(str, once.read(table).collect()))


def test_shorter_file_is_read_anew(spark, tmp_path):
    log, state = tmp_path / "log.jsonl", tmp_path / "state"
    log.write_text("\n".join(lines(30)) + "\n")
    run(spark, log, state)
    log.write_text(json.dumps({"id": "new", "role": "user", "content": "x", "timestamp": "2027"}) + "\n")
    run(spark, log, state)
    assert StateStore(spark, str(state)).read("messages").filter(F.col("id") == "new").count() == 1


def test_longer_replacement_is_read_anew(spark, tmp_path):
    log, state = tmp_path / "log.jsonl", tmp_path / "state"
    log.write_text("\n".join(lines(5)) + "\n")
    run(spark, log, state)
    log.write_text("".join(json.dumps({"id": f"n{i}", "role": "user", "content": "x", "timestamp": "2027"}) + "\n" for i in range(60)))
    run(spark, log, state)
    assert StateStore(spark, str(state)).read("messages").filter("id like 'n%'").count() == 60


def test_detection(spark, tmp_path):
    good = lines(1)[0]
    assert detect([good, "x"]) and not detect([]) and not detect(["{}", good])
    path = tmp_path / "x.jsonl"
    path.write_text("\n\n" + good)
    assert detect_adapter(spark, str(path)) == "jsonl"


def test_cli(tmp_path):
    import skald

    root = skald.__path__[0].rsplit("/", 1)[0]
    out = subprocess.run([sys.executable, "-m", "skald.cli", "init", "talk"], cwd=tmp_path, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.returncode == 0 and (tmp_path / "talk.jsonl").exists()


def test_watched_folder(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    q = follow(spark, str(folder), str(state), "s1", mode="watch")
    try:
        for k in range(2):
            part = lines(20, k)
            (tmp_path / "part").write_text("\n".join(x.replace('"m', f'"p{k}m') for x in part))
            (tmp_path / "part").rename(folder / f"part{k}.jsonl")
            q.processAllAvailable()
    finally:
        q.stop()
    rows = StateStore(spark, str(state)).read("messages").orderBy("seq").collect()
    assert [x.id for x in rows] == [f"p{k}m{i}" for k in range(2) for i in range(20)]
