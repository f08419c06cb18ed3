import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from codequarry.functions.calls import embedded_once, summarised_once
from codequarry.functions.models import HttpEmbedder, HttpSummariser
from codequarry.index import Index
from codequarry.schema import ErrorCode, QuarryError


class Service(ThreadingHTTPServer):
    """Embeds and summarises; answers only `left` more calls, and fails the first call for each of `shaky` texts."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.texts, self.calls, self.left, self.shaky, self.lock = [], 0, 10**9, set(), threading.Lock()
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        s, body = self.server, json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        texts = body.get("input") or [body["messages"][0]["content"]]
        with s.lock:
            s.calls += 1
            shaky = s.shaky & set(texts)
            s.shaky -= shaky
            s.left -= 1
            ok = s.left >= 0 and not shaky
            if ok:
                s.texts += texts
        self.send_response(200 if ok else 503)
        self.end_headers()
        data = {"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(texts)], "choices": [{"message": {"content": f"about {len(texts[0])}"}}]}
        self.wfile.write(json.dumps(data).encode() if ok else b"{}")

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    s = Service()
    yield s
    s.shutdown()


def frame(spark, n, copies=1):
    return spark.createDataFrame([(k, "x" * (k % n)) for k in range(n * copies)], "id long, text string").repartition(3)


def test_equal_texts_are_sent_once(spark, service, tmp_path):
    embed = HttpEmbedder(service.base, "m")
    rows = frame(spark, 50, 6)
    got = {r.id: r.vec for r in embedded_once(rows, embed, f"{tmp_path}/a", "m", 2, batch=8, callers=2).collect()}
    assert len(got) == 300 and all(abs(v[0] * (1 + (k % 50) ** 2) ** 0.5 - k % 50) < 1e-3 for k, v in got.items())
    assert sorted(service.texts) == sorted("x" * k for k in range(50))
    embedded_once(rows, embed, f"{tmp_path}/a", "m", 2).collect()
    assert len(service.texts) == 50
    embedded_once(rows.limit(1), embed, f"{tmp_path}/a", "m2").collect()  # another model
    assert len(service.texts) == 51


def test_no_task_gathers_a_wave(spark, service, tmp_path):
    """Each wave of requests was written by one task, so as one file, before."""
    rows = frame(spark, 400)
    got = embedded_once(rows, HttpEmbedder(service.base, "m"), f"{tmp_path}/a", "m", 2, batch=10, callers=4, wave=2)
    assert got.where("vec IS NOT NULL").count() == 400 and sorted(service.texts) == sorted("x" * k for k in range(400))
    files = [len(list(w.glob("*.parquet"))) for w in tmp_path.glob("a-todo/*-waves/wave=*")]
    assert files == [4] * 5


def test_what_a_dying_service_answered_is_kept(spark, service, tmp_path):
    embed, rows = HttpEmbedder(service.base, "m"), frame(spark, 160)
    service.left = 10
    with pytest.raises(QuarryError, match="HTTPError"):
        embedded_once(rows, embed, f"{tmp_path}/a", "m", batch=8, callers=2, tries=1, wave=4).collect()
    answered = list(service.texts)
    assert 40 < len(answered) <= 80
    service.left = 10**9
    assert embedded_once(rows, embed, f"{tmp_path}/a", "m", batch=8, callers=2, wave=4).where("vec IS NOT NULL").count() == 160
    assert len(service.texts) == 160 and sorted(service.texts) == sorted("x" * k for k in range(160))


def test_retries_and_widths(spark, service, tmp_path):
    embed, rows = HttpEmbedder(service.base, "m"), frame(spark, 20)
    service.shaky = {"x" * 3, "x" * 17}
    assert embedded_once(rows, embed, f"{tmp_path}/a", "m", batch=4, wait=0.01).where("vec IS NOT NULL").count() == 20
    calls = service.calls
    with pytest.raises(QuarryError) as e:
        embedded_once(rows, embed, f"{tmp_path}/b", "m", width=3, batch=4, callers=1).collect()
    assert e.value.code == ErrorCode.EMBEDDING_MISMATCH and service.calls == calls + 1  # neither sent again nor followed by others
    assert embedded_once(rows.limit(0), embed, f"{tmp_path}/c", "m").count() == 0


def test_a_failed_summary_is_asked_for_again(spark, service, tmp_path):
    rows = spark.createDataFrame([(k, "f", t) for k, t in enumerate(["a", "a", "bb", None, "zz"])], "id long, name string, text string")
    say = HttpSummariser(service.base, "m")
    service.left = 2
    first = {r.id: r.summary for r in summarised_once(rows, say, f"{tmp_path}/s", "m", callers=1, tries=1).collect()}
    assert sum(v is not None for v in first.values()) in (2, 3) and len(service.texts) == 2
    service.left = 10**9
    second = {r.id: r.summary for r in summarised_once(rows, say, f"{tmp_path}/s", "m", callers=1).collect()}
    assert len(service.texts) == 4 and second[0] == second[1] and None not in second.values()
    assert summarised_once(rows, HttpSummariser(), f"{tmp_path}/t", "none").where("summary = ''").count() == 5


def test_a_failed_synchronisation_goes_on_where_it_stopped(spark, service, tmp_path):
    for k in range(80):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / f"src/f{k}.py").write_text(f"def f{k}(): return {k % 3}\n")
    index = Index(spark, str(tmp_path / "index"), HttpEmbedder(service.base, "m"), "m", callers=1)
    index._bind(True)
    service.left = 3  # one of them for the width
    with pytest.raises(QuarryError):
        index.sync(str(tmp_path / "src"))
    assert index.table("units").count() == 0 and len(service.texts) == 2 + 64
    service.left = 10**9
    index.sync(str(tmp_path / "src"))
    assert index.table("unit_embeddings").count() == 80 and len([t for t in service.texts if t]) == 80
    index.rebuild(str(tmp_path / "src"))
    assert len([t for t in service.texts if t]) == 160
