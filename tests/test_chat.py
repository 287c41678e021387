import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from millrace.sources import chat
from millrace.streaming import ingest


@pytest.fixture
def bridge():
    groups: dict[str, list[dict]] = {}
    broken: set[str] = set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            call, _, query = self.path[1:].partition("?")
            asked = dict(urllib.parse.parse_qsl(query))
            if call == "get_group_list":
                reply = {"status": "ok", "data": [{"group_id": int(g)} for g in groups]}
            elif asked["group_id"] in broken:
                reply = {"status": "failed", "wording": "overloaded"}
            elif asked["group_id"] not in groups:
                reply = {"status": "failed", "wording": "群不存在"}
            else:
                upto = int(asked["message_seq"])
                found = [m for m in groups[asked["group_id"]] if not upto or m["message_seq"] <= upto][-int(asked["count"]) :]
                reply = {"status": "ok", "data": {"messages": found}}
            body = json.dumps(reply).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", groups, broken
    server.shutdown()


def said(group, first, last):
    out = []
    for seq in range(first, last + 1):
        message = [{"type": "text", "data": {"text": f"g{group} m{seq}"}}] if seq % 3 else f"plain {seq}"
        out.append({"message_seq": seq, "message_id": 10_000 * int(group) + seq, "user_id": 7, "time": 1_700_000_000 + seq, "sender": {"nickname": "n"}, "message": message, "raw_message": ""})
    return out


def ids(rows):
    return sorted(int(r.message_id) for r in rows)


def test_history_from_several_starts(spark, bridge):
    base, groups, broken = bridge
    groups["1"], groups["2"], groups["3"] = said("1", 1, 40), said("2", 1, 5), []
    out = chat.history(spark, base, count=10, starts=(0, 12, 25)).collect()
    assert ids(out) == sorted([*range(10_003, 10_013), *range(10_016, 10_026), *range(10_031, 10_041), *range(20_001, 20_006)])
    texts = {int(r.message_id): r.content_raw for r in out}
    assert texts[10_040] == "g1 m40" and texts[10_039] == "plain 39" and {r.group_id for r in out} == {"1", "2"}
    assert ids(chat.history(spark, base, ("2", "99")).collect()) == list(range(20_001, 20_006))
    broken.add("2")
    with pytest.raises(Exception, match="overloaded"):
        chat.history(spark, base, ("2",)).collect()


def test_stream_over_restarts_and_failures(spark, bridge, tmp_path):
    base, groups, broken = bridge
    groups["1"] = said("1", 1, 25)
    sink = ingest.parquet_sink(str(tmp_path / "out"))
    run = lambda write=sink: ingest.write_batches(chat.live(spark, base, count=10), write, str(tmp_path / "state")).awaitTermination()
    run()
    groups["1"] += said("1", 26, 40)
    groups["2"] = said("2", 3, 4)

    def failing(df, batch):
        sink(df.limit(3), batch)
        raise RuntimeError("lost within the batch")

    with pytest.raises(Exception, match="lost within"):
        run(failing)
    groups["1"] += said("1", 41, 43)  # comes while the lost batch is open
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert ids(rows) == sorted([*range(10_001, 10_044), 20_003, 20_004])
    broken.add("1")
    with pytest.raises(Exception, match="overloaded"):
        run()
