"""Command line, socket service and streams."""

import json
import os
import socket
import struct
import threading

from palimpsest import cli
from palimpsest.engine import Engine
from palimpsest.server import Server
from palimpsest.sources.repository import Repository
from palimpsest.streaming.appender import append_stream


def test_command_line(spark, tmp_path, capsys):
    at = ["-C", str(tmp_path)]
    assert cli.main([*at, "init"]) == 0 and cli.main([*at, "init"]) == 1
    assert cli.main([*at, "commit", "-m", 'say "hi"', "--set", "status=ok", "--set", "odd key=1=2"]) == 0
    assert cli.main([*at, "commit"]) == 0 and cli.main([*at, "commit", "--set", "bad"]) == 1
    assert cli.main([*at, "branch", "b", "--from", "main"]) == 0 and cli.main([*at, "checkout", "b"]) == 0
    assert cli.main([*at, "migrate"]) == 0
    capsys.readouterr()
    assert cli.main([*at, "query", 'MATCH (c {status: "ok"}) SELECT c.message; USE BRANCH b']) == 0
    out = capsys.readouterr().out
    assert "--- result 2 ---" in out and 'say "hi"' in out and "(2 row(s))" in out
    assert cli.main(["-C", str(tmp_path / "no"), "query", "USE HEAD"]) == 1
    assert "error: io error" in capsys.readouterr().err


def call(s, body):
    data = body if isinstance(body, bytes) else json.dumps(body).encode()
    s.sendall(struct.pack(">I", len(data)) + data)
    head = s.recv(4)
    if not head:
        return None
    (n,) = struct.unpack(">I", head)
    got = b""
    while len(got) < n:
        got += s.recv(n - len(got))
    return json.loads(got)


def test_socket_service(spark, tmp_path):
    repo = Repository.init(spark, str(tmp_path / "r"))
    with Server(repo, ("127.0.0.1", 0)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address) as s:
            hello = call(s, {"id": 1, "method": "hello"})
            assert hello["ok"] and "get" in hello["result"]["methods"]
            tip = call(s, {"id": 2, "method": "refs", "params": {}})["result"]["branches"][0]["tip"]
            made = call(s, {"id": 3, "method": "query", "params": {"sql": 'COMMIT { status: "ok" } MESSAGE "m"; MATCH (c) WHERE c.status = "ok" SELECT c.message'}})["result"]["results"]
            assert made[0]["type"] == "mutation" and made[1]["rows"] == [["m"]] and made[0]["hash"] != tip
            got = call(s, {"id": 4, "method": "get", "params": {"hash": made[0]["hash"]}})["result"]
            assert got["type"] == "commit" and got["len"] > 0 and got["payload_base64"]
            for body, error in [({"id": 5, "method": "nope"}, "unknown method 'nope'"), ({"id": 6, "method": "query"}, "params.sql required"), ({"id": 7, "method": "get", "params": {}}, "params.hash required")]:
                assert call(s, body) == {"id": body["id"], "ok": False, "error": error}
            assert not call(s, {"id": 8, "method": "query", "params": {"sql": "MATCH"}})["ok"]
            assert call(s, b"not json") is None
        server.shutdown()
    assert Repository(spark, repo.path).head()[1].hash == made[0]["hash"]


def test_stream_of_changes(spark, tmp_path):
    repo = Repository.init(spark, str(tmp_path / "r"))
    source = str(tmp_path / "in")
    os.makedirs(source)
    schema = "document string, key string, value string, at long"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        append_stream(repo, spark.readStream.schema(schema).json(source), str(tmp_path / "marks"), once=True).awaitTermination()

    run([("d1", "k", "1", 1), ("d1", "k", "2", 2), ("d2", "x", "9", 1)])
    run([("d1", "y", "3", 3)])
    e = Engine(repo)
    assert e.execute_one("USE BRANCH d1 SELECT _.k, _.y").rows() == [("2", "3")] and e.execute_one("USE BRANCH d2 SELECT _.x, _.k").rows() == [("9", None)]
    assert len(e.execute_one("TRAVERSE ANCESTORS(BRANCH d1)").rows()) == 3
    e.execute('CHECKOUT BRANCH d1; COMMIT {k: "4"}')
    assert e.execute_one("USE HEAD SELECT _.k, _.y").rows() == [("4", "3")]
