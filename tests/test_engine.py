import json

from pyspark.sql import functions as F

from srclake.plans.engine import Engine
from srclake.streaming import sync
from tests.conftest import rows

FILES = {
    "pkg/store.py": 'TABLE = {}\n\n\ndef find_user(name):\n    """Looks a user up by login name."""\n    return TABLE[name]\n',
    "pkg/login.py": 'from pkg.store import find_user\n\n\nclass Gate:\n    def login(self, name, password):\n        """Checks the password of a user."""\n        user = find_user(name)\n        return user["password"] == password\n',
    "web/app.js": "function main(a) {\n  fetch(a)\n}\n",
    "lone.py": "x = 1\n",
}


def make(spark, tmp_path, **options):
    for name, text in FILES.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "store"), **options)
    return engine, engine.ingest("demo", str(tmp_path / "repo"), "u1")


def test_engine(spark, tmp_path):
    e, row = make(spark, tmp_path)
    assert row["num_files"] == 4 and row["num_chunks"] >= 5
    assert [r["repo_id"] for r in e.list_repos().collect()] == ["demo"]
    asked = e.ask("demo", "how does login check the `password`?", 2)
    assert asked["intent"] == "login" and asked["relevant_files"] and 0.35 <= asked["confidence_score"] <= 0.98
    assert {"src": "pkg/login.py", "dst": "pkg/store.py", "relationship": "imports"} in asked["dependency_relationships"]
    assert "lone.py" in e.ask("demo", "find dead code")["answer"]
    assert asked["functions"] and set(asked["functions"]) <= {"Gate.login", "find_user"}
    assert "4 source files" in e.ask("demo", "overview please")["answer"]
    report = 'Traceback:\n  File "pkg/store.py", line 6, in find_user\nKeyError: \'bob\''
    found = e.localize("demo", report)
    assert found["error_type"] == "KeyError" and found["candidates"][0]["file_path"] == "pkg/store.py" and found["candidates"][0]["confidence_score"] > 0.5
    assert "pkg/store.py:6" in found["root_cause_explanation"]
    patch = e.generate_patch("demo", report)
    assert patch["status"] == "pending" and patch["syntax_valid"] and patch["has_changes"] and patch["git_diff"].startswith("diff --git")
    assert e.set_patch_status(patch["patch_id"], "approved", "x = 2\n")["git_diff"].endswith("+x = 2\n")
    assert patch["rag_context_chunks"][0]["file"] == "pkg/store.py"
    assert e.set_patch_status(patch["patch_id"], "applied")["status"] == "applied" and (tmp_path / "repo/pkg/store.py").read_text() == "x = 2\n"
    assert len(list((tmp_path / "repo/pkg").glob("store.py.*.bak"))) == 1
    (tmp_path / "repo/pkg/store.py").unlink()
    assert e.set_patch_status(patch["patch_id"], "applied")["status"] == "approved"
    assert [r["status"] for r in e.list_patches("demo").collect()] == ["approved"] and e.set_patch_status("no", "rejected") is None
    assert e.history("chat", "demo").count() == 3 and e.history("bugs", "demo").count() == 2
    assert e.blast_radius("demo", "pkg/store.py") == ["pkg/login.py"]
    stats = e.analytics("demo")
    assert stats["files"] == 4 and stats["bugs"] == 2 and 10 <= stats["health_score"] <= 100 and stats["language_distribution"]["python"] == 3
    assert "find_user" in e.docs("demo") and e.docs("demo", "html").startswith("<!DOCTYPE")
    assert e.graph("demo")["nodes"].count() > 4
    again = Engine(spark, str(tmp_path / "store"))
    assert again.retrieve("demo", "password of a user", 1)[0]["file_path"] == "pkg/login.py"


def test_sync_equals_rebuild(spark, tmp_path):
    e, _ = make(spark, tmp_path)
    assert e.sync("demo", str(tmp_path / "repo")) == []
    (tmp_path / "repo/lone.py").write_text("def fresh():\n    return 2\n")
    (tmp_path / "repo/web/app.js").unlink()
    (tmp_path / "repo/new.go").write_text("package x\n")
    assert [(r["rel_path"], r["change"]) for r in e.sync("demo", str(tmp_path / "repo"))] == [("lone.py", "modified"), ("new.go", "added"), ("web/app.js", "deleted")]
    fresh = Engine(spark, str(tmp_path / "other"))
    fresh.ingest("demo", str(tmp_path / "repo"))
    columns = ["file_path", "kind", "name", "code"]
    assert rows(e.tables("demo")["chunks"].select(*columns)) == rows(fresh.tables("demo")["chunks"].select(*columns))
    # What was parsed before is kept, and what follows from it is what a rebuild gives; chunk_seq ascends in the order of places.
    for name in ("facts", "edges"):
        assert rows(e.tables("demo")[name]) == rows(fresh.tables("demo")[name])
    for x in (e, fresh):
        placed = [r[:4] for r in x.tables("demo")["chunks"].orderBy("chunk_seq").select("file_path", "start_line", "name", "end_line").collect()]
        assert placed == sorted(placed)


def test_files_are_parsed_once(spark):
    from srclake.operators import chunking

    files = spark.createDataFrame([("r", "a.py", "python", "def f(): pass\n"), ("r", "b.py", "python", "x ="), ("r", "c.go", "go", "package c\n"), ("r", "d.py", "python", None)], "repo_id string, rel_path string, language string, content string")
    made = chunking.chunk(files)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert rows(made.select("file_path", "kind", "name", "code")) == [("a.py", "function", "f", "def f(): pass"), ("b.py", "block", "b.py", "x ="), ("c.go", "block", "c.go", "package c\n"), ("d.py", "block", "d.py", None)]


def test_repository_is_ingested_again(spark, tmp_path):
    import shutil

    import pytest

    from srclake.plans.engine import UnknownRepository

    make(spark, tmp_path)
    shutil.rmtree(tmp_path / "store" / "files%2Fdemo")
    again = Engine(spark, str(tmp_path / "store"))
    assert again.tables("demo")["files"].count() == 4
    with pytest.raises(UnknownRepository):
        again.tables("nothing")


def test_model_answers(spark, tmp_path):
    prompts = []
    e, _ = make(spark, tmp_path, generate=lambda p: prompts.append(p) or "```python\nfixed = 1\n```\nBecause.")
    assert e.ask("demo", "what does find_user do")["answer"].startswith("```") and "Question: what does find_user do" in prompts[0]
    patch = e.generate_patch("demo", "KeyError in find_user")
    assert "Error type: KeyError" in prompts[1] and "### pkg/store.py :: find_user" in prompts[1]
    assert patch["llm_generated"] and patch["snippet_patch"] == "fixed = 1" and patch["explanation"] == "Because."


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()

    def put(name, *files):
        (source / name).write_text("\n".join(json.dumps({"repo_id": "r", "rel_path": p, "content": c, "ingested_at": f"2024-01-0{d} 00:00:00"}) for p, c, d in files))
        sync.sync(sync.read(spark, str(source)), store, str(tmp_path / "cp")).awaitTermination()

    put("1.json", ("a", "1", 1), ("a", "2", 2), ("b", "1", 1))
    put("2.json", ("a", "2", 3), ("b", "9", 3))
    assert rows(spark.read.parquet(f"{store}/files").select("rel_path", "content")) == [("a", "2"), ("b", "9")]
    assert rows(spark.read.parquet(f"{store}/changes").select("rel_path", "change")) == [("a", "added"), ("b", "added"), ("b", "modified")]
    # A batch that failed between its changes and the table is run again: nothing is lost, nothing is doubled.
    for name in ("1", ".1.crc"):
        (tmp_path / "cp/commits" / name).unlink(missing_ok=True)
    sync.sync(sync.read(spark, str(source)), store, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(f"{store}/changes").select("rel_path", "change")) == [("a", "added"), ("b", "added"), ("b", "modified")]
    assert rows(spark.read.parquet(f"{store}/files").select("rel_path", "content")) == [("a", "2"), ("b", "9")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sync.activity(events).agg(F.sum("n")).first()[0] == events.count()
