import json
import plistlib
import socket
import struct
import threading

import pytest

from sessionlake import cli, config, doctor
from sessionlake.api import serve
from sessionlake.archive import Archive
from sessionlake.bench_data import generated_archive
from sessionlake.daemon import MOST_BYTES, Daemon, ask, receive
from sessionlake.service import Service

from .test_archive import codex


def test_settings_layers(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('database_path = "file"\nwatch_interval_seconds = 9\ndefault_agents = ["Codex", "open-code"]\n')
    c = config.resolve({"output_format": "md"}, {"SESSIONLAKE_DATABASE_PATH": "env"}, str(f))
    assert (c.database_path, c.watch_interval_seconds, c.default_agents, c.output_format) == ("env", 9, ("codex", "opencode"), "markdown")
    assert config.resolve({"database_path": "cli"}, {"SESSIONLAKE_DATABASE_PATH": "env"}, str(f)).database_path == "cli"
    f.write_text("typo = 1\n")
    for bad in (lambda: config.resolve({}, {}, str(f)), lambda: config.resolve({"output_format": "xml"}, {}), lambda: config.resolve({"tokenizer_extension": "x"}, {})):
        with pytest.raises(ValueError):
            bad()


def test_json_lines_service(spark, tmp_path):
    codex(tmp_path / "src", "a1")
    a = Archive(spark, str(tmp_path / "arch"))
    a.ingest(("codex",), str(tmp_path / "src"))
    asked = ["{", "[]", '{"op":"fly"}', '{"op":"search","query":" "}', '{"op":"search","query":"deploy"}', '{"op":"list","cursor":"x"}', '{"op":"show","id":"codex:a1","from":0,"to":0}', '{"op":"stats"}', '{"op":"reconstruct","id":"none","out":"/nowhere"}', '{"op":"show"}', '{"op":"show","id":"missing"}', '{"op":"show","id":"codex:a1","kind":"user, tool_call"}', '{"op":"show","id":"codex:a1","kind":["nothing"]}', '{"op":"show","id":"codex:a1","from":-1}', '{"op":"list","limit":1,"agent":"codex"}', '{"op":"list","limit":"1"}']
    out = [json.loads(x) for x in serve(a, asked)]
    assert [x.get("error", {}).get("code") for x in out[:10]] == ["invalid_json", "invalid_argument", "unsupported_operation", "invalid_argument", None, "invalid_argument", None, None, "invalid_argument", "invalid_argument"]
    assert "stats" in out[2]["error"]["details"]["supported"] and out[4]["result"][0]["id"] == "codex:a1" and len(out[6]["result"]["events"]) == 1 and out[7]["result"]["sessions"] == 1
    assert out[10] == {"ok": True, "result": None} and [e["kind"] for e in out[11]["result"]["events"]] == ["user", "tool_call"]
    assert [x["error"]["code"] for x in (out[12], out[13], out[15])] == ["invalid_argument"] * 3 and out[14]["result"]["sessions"][0]["events"] == 5


def test_socket_service(spark, tmp_path):
    codex(tmp_path / "src", "a1")
    a = Archive(spark, str(tmp_path / "arch"))
    with pytest.raises(ValueError):
        Daemon(a, "192.0.2.1:0")
    d = Daemon(a, socket_path=str(tmp_path / "s.sock"), reconstruct_root=str(tmp_path / "out"))
    threading.Thread(target=d.run, daemon=True).start()
    with socket.socket(socket.AF_UNIX) as c:
        c.connect(str(tmp_path / "s.sock"))
        assert ask(c, {"op": "ingest", "agents": ["codex"], "root": str(tmp_path / "src")})["result"]["ingested"] == 1
        assert ask(c, {"op": "reindex"})["result"] == {"indexed": 3} and ask(c, {"op": "search", "query": " "})["error"]["code"] == "invalid_argument"
        assert ask(c, {"op": "show", "id": "codex:a1"})["result"]["session"]["id"] == "codex:a1" and ask(c, {"op": "stats"})["result"]["events"] == 5
        assert ask(c, {"op": "reconstruct", "id": "codex:a1", "out": "../x"})["error"]["code"] == "invalid_argument"
        assert len(ask(c, {"op": "reconstruct", "id": "codex:a1", "out": "x"})["result"]) == 1 and (tmp_path / "out/x/rollout-a1.jsonl").exists()
        c.sendall(struct.pack(">I", MOST_BYTES + 1))
        assert json.loads(receive(c))["error"]["code"] == "invalid_argument"
    d.server.shutdown()
    assert not Daemon(a, "127.0.0.1:0").answer(b'{"op":"reconstruct","id":"x","out":"y"}')["ok"]


def test_operating_system_service(tmp_path):
    said = []

    def run(command):
        said.append(command)
        return 0, "active"

    s = Service(["sessionlake", "watch", "--root", "/a b"], str(tmp_path), "linux", run)
    assert s.status()["installed"] is False and s.install()["installed"] and "ExecStart=sessionlake watch --root '/a b'" in s.file.read_text()
    assert s.start()["ok"] and s.stop()["ok"] and s.status()["message"] == "active" and not s.uninstall()["installed"] and not s.file.exists()
    assert said[0] == ["systemctl", "--user", "daemon-reload"] and ["systemctl", "--user", "disable", "--now", "sessionlake-watch"] in said
    mac = Service(["x"], str(tmp_path), "darwin", run)
    assert mac.install()["ok"] and plistlib.loads(mac.file.read_bytes())["ProgramArguments"] == ["x"]


def test_doctor_looks_at_everything(spark, tmp_path):
    codex(tmp_path / "src", "a1")
    a = Archive(spark, str(tmp_path / "arch"))
    a.ingest(("codex",), str(tmp_path / "src"))
    roots = {"codex": str(tmp_path / "src"), "pi": str(tmp_path / "none")}
    r = doctor.report(a, ("codex", "pi"), roots=roots)
    assert r["healthy"] and [(x["exists"], x["discovered"]) for x in r["agents"]] == [(True, 1), (False, 0)] and r["tokenizer"]["available"] and r["database"]["lag_ms"] == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "src/rollout-b.jsonl").write_text("{")
    a.ingest(("codex",), str(tmp_path / "src"))
    assert not doctor.report(a, ("codex", "pi"), roots=roots)["healthy"] and not doctor.report(a, ("pi",), interval_seconds=0, roots=roots)["watch"]["ready"]


def test_command_line(spark, tmp_path):
    codex(tmp_path / "src", "a1")
    ask = lambda *argv: cli.run(cli.parser().parse_args(["--database-path", str(tmp_path / "arch"), *argv]), spark)
    assert ask("ingest", "--agent", "codex", "--root", str(tmp_path / "src"))["ingested"] == 1
    assert [e["kind"] for e in ask("show", "codex:a1")["events"]] == ["user", "assistant"]
    assert len(ask("show", "codex:a1", "--include-tools")["events"]) == 5 and ask("show", "none") is None
    assert ask("search", "deploy")[0]["id"] == "codex:a1" and "sessions" not in ask("completion", "bash")["script"].split("'")[0]
    ask("reindex")
    assert ask("search", "site deployed")[0]["id"] == "codex:a1" and ask("search", "deplo*")[0]["hits"] == 2
    assert cli.shown([{"a": 1}, {"a": 2}], "jsonl") == '{"a": 1}\n{"a": 2}' and cli.shown({"a": 1}, "markdown").startswith("```json")


def test_generated_archive_is_searchable(spark, tmp_path):
    s, e = generated_archive(spark, 200, changed=True)
    assert (s.count(), e.count()) == (200, 1202)
    a = Archive(spark, str(tmp_path / "bench"))
    a.write(s, e)
    a.reindex()
    assert {r["title"] for r in a.search("parser regression", as_of_ms=1_800_000_000_000).collect()} == {"parser benchmark"}
