import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph import cli
from quillgraph.config import Config, load_user, save_user
from quillgraph.errors import ConfigError, ProviderError
from quillgraph.operators.store import Store
from quillgraph.plans.engine import NO_ANSWER, KnowledgeBase
from quillgraph.providers import HttpProvider, ScriptedProvider, provider
from quillgraph.sources import loaders
from quillgraph.streaming.ingest import event_windows, ingest_stream, new_content, text_stream

SCRIPT = ScriptedProvider(
    {
        "Split the": "[]",
        "Question: Describe the glaze": '{"a": "The glaze of Ostrava Kilns is ash green (F1).", "f": ["F1"]}',
        "Ostrava Kilns was founded": json.dumps([{"subject": "Ostrava Kilns", "predicate": "was founded by", "object": "Edda Quill", "confidence": 0.95}, {"subject": "Edda Quill", "predicate": "was born in", "object": "Brno", "confidence": 0.9}, {"subject": "Ostrava Kilns", "predicate": "uses glaze", "object_value": "ash green", "confidence": 0.8}, {"subject": "x", "predicate": "unsure of", "object_value": "y", "confidence": 0.2}]),
    }
)


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, Config(kb_dir=f"file://{tmp_path}/kb", concurrency=2), SCRIPT)


def test_ingest_and_ask(spark, kb, tmp_path):
    (tmp_path / "a.txt").write_text("Ostrava Kilns was founded by Edda Quill. She was born in Brno.")
    assert kb.ingest(str(tmp_path / "a.txt")) == {"documents": 1, "skipped": 0, "facts": 3, "entities": 3}
    assert kb.ingest(str(tmp_path / "a.txt")) == {"documents": 0, "skipped": 1, "facts": 0, "entities": 0}
    assert kb.stats() == {"documents": 1, "entities": 3, "facts": 3, "relationships": 2}
    qs = spark.createDataFrame([(1, "Where was the founder of Ostrava Kilns born?"), (2, "Describe the glaze of Ostrava Kilns"), (3, "What of the moon?"), (4, None)], "qid long, text string")
    got = {r.qid: r for r in kb.ask(qs).collect()}
    assert (got[1].answer, got[1].tier, got[1].tokens_used, len(got[1].fact_ids)) == ("Brno", "walk", 0, 2)
    assert got[2].answer == "The glaze of Ostrava Kilns is ash green." and got[2].tier == "model" and len(got[2].fact_ids) == 1 and got[2].confidence > 0.5 and got[2].tokens_used > 0
    assert got[3].answer == got[4].answer == NO_ANSWER
    again = {r.qid: r for r in kb.ask(qs).collect()}
    assert again[1].tier == again[2].tier == "cache" and again[1].answer == "Brno" and again[1].fact_ids == got[1].fact_ids
    # New facts are another version, and the cache is keyed on it.
    kb.store.write("facts", kb.store.read("facts").where("predicate <> 'was born in'"))
    assert kb.query("Where was the founder of Ostrava Kilns born?")["tier"] != "cache"
    assert list(kb.stream("Who founded Ostrava Kilns?")) == ["Edda", "Quill"]
    cases = spark.createDataFrame([(1, "Who founded Ostrava Kilns?", ["edda"], ["Edda Quill"])], "qid long, text string, expected array<string>, expected_entities array<string>")
    report = kb.evaluate(cases).first()
    assert (report.n, report.pass_rate, report.mean_recall) == (1, 1.0, 1.0)


def test_store_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kb")
    assert s.version("entities") is None and s.read("entities").count() == 0
    row = spark.createDataFrame([("1", "a")], "id string, name string").withColumns({"entity_type": F.lit("t"), "aliases": F.array(F.lit("b")), "description": F.lit(None).cast("string"), "created_at": F.current_timestamp()})
    first = s.write("entities", row)
    held = s.read("entities")
    second = s.write("entities", row.withColumn("name", F.lit("z")))
    assert first != second and [r.name for r in held.collect()] == ["a"] and [r.name for r in s.read("entities").collect()] == ["z"]
    s.delete()
    assert s.version("entities") is None


def test_loaders(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "a.csv").write_text("name,year\nKiln,1971\nDrift, \n")
    (tmp_path / "b.json").write_text('[{"a": {"b": [1, null]}}, true]')
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n\nbroken\n{"x": 2}\n')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "n" / "d.md").write_text("# T\nbody")
    (tmp_path / "e.html").write_text("<body><nav>menu</nav><p>outside</p><article><h1>Title</h1><p>" + "words " * 20 + "</p><script>x()</script></article></body>")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = {}
    for r in loaders.load(spark, str(tmp_path)).collect():
        got.setdefault(r.source.rsplit("/", 1)[-1], []).append((r.seq, r.content))
    assert sorted(got["a.csv"]) == [(0, "Columns: name, year\n\nRow 1:, name=Kiln, year=1971"), (1, "Row 2:, name=Drift, year=")]
    assert sorted(got["b.json"]) == [(0, "a.b[0]=1; a.b[1]=None"), (1, "=True")] and sorted(got["c.jsonl"]) == [(0, "x=1"), (1, "x=2")]
    assert got["d.md"] == [(0, "# T\nbody")] and got["f.docx"] == [(0, "One\n\nx | y")] and "bad.json" not in got
    assert got["e.html"][0][1].startswith("Title\nwords") and "menu" not in got["e.html"][0][1] and "outside" not in got["e.html"][0][1]
    assert [r.content for r in loaders.load(spark, [{"a": 1}, str(tmp_path / "c.jsonl")]).collect()] == ["a=1", "x=1", "x=2"]
    with pytest.raises(ValueError):
        loaders.load(spark, "x.zip")
    page = loaders.load(spark, "https://a.example", lambda url: b"<body>" + b"prose " * 20 + b"</body>").collect()
    assert page[0].source == "https://a.example"


def test_html_corner_cases():
    assert loaders.html_text(None) is None and loaders.html_text("<p>short</p>") is None
    long = "plenty of words " * 5
    assert loaders.html_text(f"<div role=main><p>{long}<p>more</div><main>{long}</main>").startswith("plenty")
    assert loaders.html_text(f"<body><br><img><p>a &amp; b</p>{long}") == f"a & b\n{long.strip()}"


def test_config(tmp_path, monkeypatch):
    assert Config(max_subgraph_nodes=1).max_subgraph_nodes == 5
    c = Config.from_env({"QUILLGRAPH_HOP_DEPTH": "3", "QUILLGRAPH_QUERY_CACHE": "no", "QUILLGRAPH_UNKNOWN": "x", "OTHER": "1"})
    assert c.hop_depth == 3 and c.query_cache is False
    with pytest.raises(ConfigError):
        Config.from_dict({"hop_depth": "many"})
    with pytest.raises(ConfigError):
        Config(min_confidence=2)
    (tmp_path / "c.yaml").write_text("quillgraph:\n  token_budget: 900\n")
    assert Config.from_yaml(str(tmp_path / "c.yaml")).token_budget == 900
    path = tmp_path / "u" / "config.json"
    save_user({"provider": "groq"}, path)
    save_user({"model": "m"}, path)
    assert load_user(path) == {"provider": "groq", "model": "m"} and path.stat().st_mode & 0o777 == 0o600


def test_providers(monkeypatch):
    assert provider("none") is None and isinstance(provider("Mercury"), HttpProvider) and provider("mercury").model == "mercury"
    with pytest.raises(ProviderError):
        provider("nobody")
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    with pytest.raises(ProviderError):
        provider("groq").complete([dict(role="user", content="x")])


def test_http_styles(monkeypatch):
    import io
    import urllib.error

    monkeypatch.setenv("K", "secret")
    sent, faults = [], [urllib.error.URLError("down")]

    def urlopen(request, timeout):
        if faults:
            raise faults.pop()
        sent.append((request.full_url, json.loads(request.data), request.headers))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "hi"}}], "content": [{"text": "hi"}], "message": {"content": "hi"}}).encode())

    monkeypatch.setattr("urllib.request.urlopen", urlopen)
    monkeypatch.setattr("time.sleep", lambda s: None)
    messages = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    for style in ("openai", "messages", "local"):
        assert HttpProvider("http://x", "m", "K", style).complete(messages) == "hi"
    assert [u for u, _, _ in sent] == ["http://x/chat/completions", "http://x/messages", "http://x/api/chat"] and sent[1][1]["system"] == "s"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("QUILLGRAPH_HOME", str(tmp_path / "home"))
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    monkeypatch.setattr(cli, "provider", lambda *a: SCRIPT)
    (tmp_path / "a.txt").write_text("Ostrava Kilns was founded by Edda Quill.")
    at = ["--kb", f"file://{tmp_path}/kb"]
    assert cli.main([*at, "ingest", str(tmp_path / "a.txt")]) == 0 and cli.main([*at, "query", "Who", "founded", "Ostrava", "Kilns?"]) == 0
    assert "Edda Quill" in capsys.readouterr().out
    for command in (["stats"], ["entities", "--search", "edda"], ["facts", "--entity", "ostrava kilns"], ["config"], ["connect", "groq"], ["clear", "--yes"]):
        assert cli.main([*at, *command]) == 0
    assert "was founded by" in capsys.readouterr().out


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, t in enumerate(("Same  text", "same text", "other", " ")):
        (folder / f"{i}.txt").write_text(t)
    seen = []
    ingest_stream(text_stream(spark, f"file://{folder}"), lambda df, n: seen.extend(r.content for r in df.collect()), f"file://{tmp_path}/cp").awaitTermination(60)
    assert len(seen) == 2 and "other" in seen
    assert new_content(text_stream(spark, f"file://{folder}")).isStreaming
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_windows(events).agg(F.sum("n")).first()[0] == events.count()
