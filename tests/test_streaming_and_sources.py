from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.sources.report import markdown, mode_averages, write_csv
from codeloom.sources.tree import ignore_patterns, source_files
from codeloom.streaming import watch as w


@pytest.mark.parametrize(("waited", "due"), [(0, 80), (420, 500), (421, 500), (495, 505)])
def test_flush_delay(waited, due):
    assert waited + w.flush_delay(0, waited) == due


def events(spark, folder, rows):
    frame = pd.DataFrame(rows, columns=["repo", "path", "ms"])
    spark.createDataFrame(frame).select("repo", "path", F.timestamp_millis("ms").alias("at")).coalesce(1).write.mode("append").parquet(folder)


def test_debounce_flushes_quiet_and_long_bursts(spark, tmp_path):
    folder = str(tmp_path / "in")
    burst = [("r", f"f{i % 3}.ts", 1000 + 40 * i) for i in range(20)]
    events(spark, folder, [("r", "a.ts", 100), ("r", "a.ts", 150), ("q", "z.ts", 120), ("r", "b.ts", 400), *burst, ("r", "end.ts", 9000), ("q", "end.ts", 9000)])
    stream = spark.readStream.schema("repo string, path string, at timestamp").parquet(folder)
    query = w.debounced(stream).writeStream.format("memory").queryName("flushes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted((r.repo, r.flush_ms, r.paths) for r in spark.table("flushes").collect())
    assert ("q", 200, ["z.ts"]) in got and ("r", 230, ["a.ts"]) in got and ("r", 480, ["b.ts"]) in got
    assert ("r", 1500, ["f0.ts", "f1.ts", "f2.ts"]) in got


def test_watch_applies_last_state_of_each_path(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("src/a.ts", "h1", 1), ("src\\a.ts", "h2", 2), ("./src/b.ts", None, 3), ("src/c.ts", "same", 4), ("src/d.d.ts", "x", 5), ("node_modules/e.ts", "x", 6), ("gone.ts", None, 7)]
    spark.createDataFrame(rows, "path string, content_hash string, seq long").coalesce(1).write.parquet(folder)
    current = spark.createDataFrame([("src/b.ts", "b"), ("src/c.ts", "same"), ("src/z.ts", "z")], "path string, content_hash string")
    seen = []
    stream = spark.readStream.schema("path string, content_hash string, seq long").parquet(folder)
    query = w.watch(stream, lambda: current, lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(60)
    assert sorted(seen) == [("src/a.ts", "added", "h2"), ("src/b.ts", "removed", None)]


def test_source_tree(spark, tmp_path):
    for name in ("src/a.ts", "src/b.tsx", "src/c.d.ts", "src/d.js", "node_modules/x/e.ts", "dist/f.ts", "src/gen/g.ts", "deep/src/h h.ts"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"// {name}\n")
    rows = {r.path: r.content for r in source_files(spark, str(tmp_path), "# own\nsrc/gen/\n*.tsx").collect()}
    assert rows == {"src/a.ts": "// src/a.ts\n", "deep/src/h h.ts": "// deep/src/h h.ts\n"}
    assert "(?:^|/)dist(?:/|$)" in ignore_patterns()
    kept = {r.path for r in source_files(spark, str(tmp_path), "src/gen/\n!src/gen/\n*.tsx\n!b.tsx\n!dist").collect()}
    assert kept == {"src/a.ts", "src/b.tsx", "src/gen/g.ts", "dist/f.ts", "deep/src/h h.ts"}


def test_reports(spark, tmp_path):
    rows = [("traditional", 'say "hi"', 100, 0.5, 10), ("graph", "b", 40, 0.1, 5), ("traditional", "c", 300, 0.5, 30)]
    runs = spark.createDataFrame(rows, "mode string, question string, total_tokens long, cost_usd double, response_time_ms long")
    row = mode_averages(runs).first()
    assert row.traditional_total_tokens == 200 and row.total_tokens_reduction == pytest.approx(80)
    assert "| total_tokens | 200.00 | 40.00 | 80.0 % |" in markdown(mode_averages(runs)).first().markdown
    assert mode_averages(runs.limit(0)).first().cost_usd_reduction == 0
    write_csv(runs, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"say ""hi"""' in text and "0.500000" in text
