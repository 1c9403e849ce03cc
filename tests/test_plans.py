"""Formation, context, review and the verbs, end to end on small projects."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.plans import context, formation, review
from factloom.plans.analyze import LIMITS, analyze
from factloom.queries.project import SHOP as PROJECT
from factloom.sources import bundle, config


@pytest.fixture(scope="module")
def tables(spark):
    return analyze(spark.createDataFrame(PROJECT, "file_id string, path string, text string"))


def test_formation(tables):
    out = formation.form_domains(tables)
    assert {r.key for r in out["domains"].collect()} >= {"orders"}
    kinds = {r.key: r.kind for r in out["domains"].collect()}
    assert kinds.get("health", "crossCutting") == "crossCutting"
    assert {r.key for r in out["clusters"].collect()} == {"orders", "health"}
    for r in out["pairs"].collect():
        assert r.left_key < r.right_key and 0 <= r.combined <= 1
    with pytest.raises(ValueError):
        formation.form_domains(tables, "other")


def test_context(spark, tables, tmp_path):
    rows = context.packets(tables).collect()
    assert {r.domain for r in rows} == {"orders", "web"}
    assert any("resourceAccess" in r.tags for r in rows) and all(len(r.line) <= 160 for r in rows)
    chosen = context.chunks(tables, 400)
    for c, n in chosen.groupBy("chunk_id").agg(F.sum("size")).collect():
        required = sum(r.size for r in rows if r.required)
        assert n <= 400 + required
    context.write_chunks(chosen, str(tmp_path / "c"))
    assert context.read_chunks(spark, str(tmp_path / "c")).count() == chosen.count()
    assert {r.coverage for r in context.coverage(tables, context.chunks(tables)).collect()} == {"full"}
    assert context.sniff('{"overview": {}}') == "analysis" and context.sniff("[") == "unknown"


@pytest.mark.parametrize(
    "text,found",
    [
        ('{"domains": [{"id": "a"}]}', "a"),
        ('noise\n{"domains": [{"id": "a"}]}\n', "a"),
        ('```json\n{"domains": [{"id": "a"}]}\n```', "a"),
        ('{"type": "x", "result": "{\\"domains\\": [{\\"id\\": \\"a\\"}]}"}', "a"),
        ('{"other": 1}\n{"domains": [{"id": "a"}]}', "a"),
        ("nothing", None),
        (None, None),
        ('{"x": "{{{"}', None),
    ],
)
def test_parse_response(text, found):
    got = review.parse_response(text)
    assert (got["domains"][0]["id"] if got else None) == found


def test_review(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")

    def call(prompt):
        if "two" in prompt:
            raise RuntimeError("down")
        if "retry" in prompt:
            return '{"domains": [{"id": "d", "label": "D"}]}'
        return json.dumps({"domains": [{"id": "a", "label": "A", "canonical": "b"}, {"id": "b", "label": "B", "canonical": "a"}, {"id": "x", "label": "X"}, {"id": "c", "label": "bad\nlabel"}]})

    chunks = spark.createDataFrame([("1", "one"), ("2", "two")], "chunk_id string, prompt string")
    again = lambda missing: missing.agg(F.lit("3").alias("chunk_id"), F.concat(F.lit("retry "), F.array_join(F.collect_list("id"), ",")).alias("prompt"))
    accepted, warnings = review.review(chunks, known, call, again)
    assert {(r.id, r.label, r.canonical) for r in accepted.collect()} == {("a", "A", "a"), ("b", "B", "a"), ("d", "D", "d")}
    assert {tuple(r) for r in warnings.collect()} == {("x", "unknown id"), ("c", "bad label"), ("2", "RuntimeError: down")}


def test_verbs(spark, tmp_path):
    for _, path, text in PROJECT:
        (tmp_path / "p" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / path).write_text(text)
    project = str(tmp_path / "p")
    cli.main(["analyze", project, str(tmp_path / "a")], spark)
    assert spark.read.parquet(str(tmp_path / "a" / "domains")).count() == 2
    cli.main(["bundle", project, str(tmp_path / "b")], spark)
    assert bundle.read_bundle(spark, str(tmp_path / "b"))["domains"].count() == 2
    cli.main(["context", project, str(tmp_path / "c")], spark)
    cli.main(["domains", project], spark)


def test_results(spark, tables, tmp_path):
    """Results replace the old one whole or not at all; the stream and the folder have the same rows."""
    import io

    from factloom.plans import overview
    from factloom.sources import results

    sections = {"domains": tables.domains, "diagnostics": tables.diagnostics}
    folder = f"file://{tmp_path}/result"
    sizes = results.write_result(spark, sections, folder)
    assert spark.read.json(f"{folder}/domains").count() == tables.domains.count()
    with pytest.raises(results.TooLarge):
        results.write_result(spark, {"domains": tables.domains.limit(1)}, folder, limit=5)
    assert spark.read.json(f"{folder}/domains").count() == tables.domains.count()
    results.write_result(spark, {"domains": tables.domains.limit(1)}, folder)
    assert spark.read.json(f"{folder}/domains").count() == 1 and not (tmp_path / "result.old").exists()
    out = io.StringIO()
    assert results.print_result(sections, out) == sum(sizes.values()) and len(out.getvalue().splitlines()) == tables.domains.count() + tables.diagnostics.count()
    with pytest.raises(results.TooLarge):
        results.print_result(sections, io.StringIO(), limit=5)
    results.compute_only(sections)
    for place in ("service/shop/clean", "shop"):
        bundle.write_bundle(spark, {"domains": tables.domains}, f"file://{tmp_path}/all/{place}", {"domains": "bucket"})
    assert results.find_bundle(spark, f"file://{tmp_path}/all", "shop") == f"file://{tmp_path}/all/shop"
    assert results.find_bundle(spark, f"file://{tmp_path}/all", "other") is None
    steps = spark.createDataFrame([("scan", 0, 1.5, "ok")], "step string, ord int, seconds double, status string")
    for project in ("a", "b", "a"):
        results.record_run(spark, f"file://{tmp_path}/runs", project, steps)
    listed = results.workspaces(spark, f"file://{tmp_path}/runs").collect()
    assert [(r.project, r.runs) for r in listed] == [("a", 2), ("b", 1)]
    assert overview.saved_map(overview.clean(tables, overview.features(tables))).count() == tables.domains.count()


def test_scan_limits(spark, tmp_path):
    """The number of files stops the scan, one that goes beyond the bytes is skipped; both are said."""
    for name, size in (("a.py", 10), ("b.py", 500), ("c.py", 10), ("d.py", 10)):
        (tmp_path / name).write_text("x = 1\n".ljust(size, "#"))
    settings = {"scan": {"includeHidden": False, "maxFileSizeBytes": 1000}, "limits": {"maxFiles": 3, "maxTotalBytes": 100}}
    t, large = cli.read(spark, str(tmp_path), settings)
    assert sorted(r.path for r in t.files.collect()) == ["a.py", "c.py"]
    assert sorted((r.path, r.code) for r in large.collect()) == [("b.py", "ANALYSIS_LIMIT_REACHED"), ("d.py", "ANALYSIS_LIMIT_REACHED")]


def test_analysis_limits_from_a_file(spark, tmp_path):
    """A limit of the analysis has one default, and a configuration file sets it."""
    assert not set(config.DEFAULTS["limits"]) & set(LIMITS)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("def f():\n    pass\n\n\ndef g():\n    pass\n")
    (tmp_path / "c.toml").write_text("[limits]\nmaxUnits = 1\n")
    for settings, said in ((config.load(), []), (config.load(tmp_path / "c.toml"), ["units: 1"])):
        t, _ = cli.read(spark, str(tmp_path / "p"), settings)
        assert [r.message for r in t.diagnostics.where("code = 'ANALYSIS_LIMIT_REACHED'").collect()] == said
