import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from promptlens.operators import generation, spans
from promptlens.sources.config import GenerationConfig, load_yaml

GOOD = ({"experiment": {"expected_prompts": 3, "repetitions": 2}, "generation": {"batch_size": 4}}, {"models": {"a": {"repo_id": "x/a"}, "b": {"repo_id": "x/b"}}})


def test_generation_config(tmp_path):
    c = GenerationConfig.from_dicts(*GOOD, keys=["b"])
    assert list(c.models) == ["b"] and (c.batch_size, c.repetitions) == (4, 2)
    c.check_count(3)
    c.check_count(1, limit=1)
    with pytest.raises(ValueError):
        c.check_count(2)
    for bad in ({"experiment": {}}, {"experiment": {"expected_prompts": 0}, "generation": {}}, {"experiment": {"expected_prompts": 1, "prompt_mode": "chat"}, "generation": {}}, {"experiment": {"expected_prompts": 1, "prefix": "x"}, "generation": {}}):
        with pytest.raises(ValueError):
            GenerationConfig.from_dicts(bad, GOOD[1])
    with pytest.raises(ValueError):
        GenerationConfig.from_dicts(*GOOD, keys=["z"])
    (tmp_path / "a.yaml").write_text("models:\n  a: {repo_id: x}\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    assert load_yaml(f"{tmp_path}/a.yaml")["models"]["a"]["repo_id"] == "x"
    with pytest.raises(ValueError):
        load_yaml(f"{tmp_path}/b.yaml")


def test_http_generator():
    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send(b'{"models": [{"name": "m:latest"}]}')

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send(b"no json" if asked["prompt"] == "bad" else json.dumps({"response": f"{asked['prompt']}/{asked['options']['seed']}"}).encode())

        def send(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert generation.http_generator(url, "m")(["x", "bad", "y"], 7) == ["x/7", None, "y/7"]
    assert generation.server_has(url, "m") and not generation.server_has(url, "n") and not generation.server_has("http://127.0.0.1:1", "m")
    server.shutdown()


def test_pilot(spark):
    texts = spark.createDataFrame([(str(i), f"text {i} by Ann" if i % 2 else f"Odd Name {i}") for i in range(40)], "text_id string, text_full string")
    sample = spans.pilot_sample(texts, 10, "Odd Name")
    assert sample.where("sample_kind = 'random'").count() == 10 and sample.where("sample_kind = 'diagnostic'").count() == 1 and sample.select("text_id").distinct().count() == 11
    rows, times = spans.pilot(sample, lambda part: [[(t.find("Ann"), t.find("Ann") + 3, "PERSON")] if "Ann" in t else [] for t in part])
    assert times["texts"] == 11 and rows.count() == sample.where("text_full like '%Ann'").count()
