from plumbline.operators import memory
from plumbline.streaming import risk


def test_stream_equals_one_pass(spark, tmp_path):
    rows = [(f"Case {i % 3}", i / 10, ("FABRICATED", "SUPPORTED", "UNVERIFIABLE")[i % 3], i) for i in range(12)] + [("", 0.1, "FABRICATED", 99)]
    df = spark.createDataFrame(rows, "case_name string, ccs double, tier string, seq long")
    landed, index, checkpoint = (str(tmp_path / n) for n in ("landed", "index", "checkpoint"))
    for part in (df.where("seq < 6"), df.where("seq >= 6")):
        part.write.mode("append").parquet(landed)
        risk.ingest(spark, landed, df.schema, index, checkpoint)
    expected = memory.risk_table(memory.risk_index(memory.risk_rows(df)))
    order = lambda x: sorted((r["key"], round(r["avg_ccs"], 9), r["n"], r["last_tier"]) for r in x.collect())
    assert order(risk.read(spark, index)) == order(expected)
    risk.compact(spark, index, str(tmp_path / "whole"))
    assert order(risk.read(spark, str(tmp_path / "whole"))) == order(expected)


def test_running_means_go_on_over_files_and_failures(spark, tmp_path, monkeypatch):
    from plumbline.streaming.running import ROW, RunningMeans

    rows = [(f"k{i % 3}" if i % 7 else None, i, None if i % 11 == 5 else float(i * i % 13)) for i in range(60)]
    means = RunningMeans(spark, f"file://{tmp_path}/means")
    landed, checkpoint = f"file://{tmp_path}/landed", f"file://{tmp_path}/checkpoint"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], ROW).coalesce(1).write.parquet(f"{landed}/{k}")
        if k == 1:  # stopped between its two writes: the batch comes again
            write = RunningMeans.take

            def stopping(self, batch, number):
                write(self, batch, number)
                raise RuntimeError("stopped")

            monkeypatch.setattr(RunningMeans, "take", stopping)
            try:
                means.follow(landed, checkpoint)
            except Exception as failure:
                assert "stopped" in str(failure)
            else:
                raise AssertionError("the batch did not fail")
            monkeypatch.undo()
        means.follow(landed, checkpoint)
    expected, sums = [], {}
    for key, seq, value in rows:
        total, n = sums.get(key, (0.0, 0))
        sums[key] = total, n = (total + (value or 0.0), n + (value is not None))
        expected.append((seq, key, n, round(total / n, 9) if n else None))
    got = sorted((r["seq"], r["key"], r["n"], r["run_avg"] if r["run_avg"] is None else round(r["run_avg"], 9)) for r in means.steps().collect())
    assert got == expected
