"""Reports of files with more findings than are joined at once."""

import hashlib
import json

import pytest

from pagelens.operators import reports


@pytest.fixture
def findings(spark, monkeypatch):
    monkeypatch.setattr(reports, "PIECE", 3)
    rows = [(f"f{k % 2}.html", k % 5 if k % 7 else None, k % 5 if k % 7 else None, f"rule/{'abc'[k % 3]}", "fail" if k % 2 else "review", "m\"<") for k in range(40)]
    return spark.createDataFrame(rows, "path string, line int, column int, rule_id string, outcome string, message string").repartition(5)


def test_sarif_parts_are_the_log(findings):
    parts = reports.sarif_results(findings)
    assert all(len(json.loads(f"[{r.value}]")) <= 3 for r in parts.collect())
    rows = findings.collect()
    for log in reports.as_sarif(findings).collect():
        run = json.loads(log.value)["runs"][0]
        own = [r for r in rows if r.path == log.path]
        assert [r["id"] for r in run["tool"]["driver"]["rules"]] == sorted({r.rule_id for r in own})
        at = [(r["locations"][0]["physicalLocation"].get("region", {}).get("startLine", -1), r["ruleId"]) for r in run["results"]]
        assert at == sorted((-1 if r.line is None else r.line, r.rule_id) for r in own)
        counts = {}
        marks = set()
        for r in own:
            counts[r.rule_id] = counts.get(r.rule_id, 0) + 1
            marks.add(hashlib.sha256(f"{r.rule_id}\n{r.path}\n{r.message}\n{counts[r.rule_id]}".encode()).hexdigest()[:32])
        assert {r["partialFingerprints"]["finding"] for r in run["results"]} == marks


def test_no_row_of_parts_grows_with_a_file(spark):
    """A file's findings are joined by many tasks, not in one group."""
    rows = spark.range(0, 20000, 1, 4).selectExpr("'f' AS path", "id AS line", "1 AS column", "'r' AS rule_id", "'fail' AS outcome", "'m' AS message")
    sizes = [r.n for r in reports.sarif_results(rows).selectExpr("json_array_length('[' || value || ']') AS n").collect()]
    assert sum(sizes) == 20000 and max(sizes) <= reports.PIECE
    assert [json.loads(r.value)["runs"][0]["results"][-1]["locations"][0]["physicalLocation"]["region"]["startLine"] for r in reports.as_sarif(rows).collect()] == [19999]


def test_junit_and_svrl_in_order(findings):
    rows = sorted(findings.collect(), key=lambda r: (-1 if r.line is None else r.line))
    for report in reports.as_junit(findings).collect():
        own = [r for r in rows if r.path == report.path]
        assert f'tests="{len(own)}" failures="{sum(r.outcome == "fail" for r in own)}"' in report.value
        places = [c.split('"')[0].rpartition(" at ")[2] if " at " in c.split('"')[0] else "" for c in report.value.split(' name="')[2:]]
        assert places == ["" if r.line is None else f"{r.line}:{r.column}" for r in own]
    for report in reports.as_svrl(findings).collect():
        assert report.value.count("<svrl:failed-assert") == sum(r.path == report.path for r in rows)
